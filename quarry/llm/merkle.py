"""Merkle dataset manifest: a hash tree over every source's rows and one over the sources.

A node has its tree, its index in the level and the number of nodes in the
level, so the indices of its siblings are arithmetic: index XOR 1 in a binary
tree, offsets by slot otherwise.  Every level joins its nodes with themselves on
(tree, index) once for each sibling; then the nodes of slot zero emit the
parents.  All trees grow together, a level a round, until each has one node.

A row's proof is the list of its siblings from its leaf to the root.  It is
handed down from the root: children join their parent's list on (tree, index)
and put their own siblings in front, so a level's lists move once.

Scale: texts are read once, for their digests.  Rows get their index from
a range partition by (source, id); no source is sorted in one task.  Joins are
on a node's own index, so a source that holds a third of all rows is spread over
all tasks.  Levels shrink by the arity, and what moves adds up to about one and
a half rows of 32-byte digests and siblings per document.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import pick, stored
from quarry.operators.ids import assign_ids

ARITY = 3
#: the fields of a leaf, in order
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: rows of one source that share a key when its first rank is looked up
RUN_BITS = 18


def digest(raw: Column) -> Column:
    """The sha256 of bytes, as 32 bytes."""
    return F.unhex(F.sha2(raw, 256))


def hexed(raw: Column) -> Column:
    return F.lower(F.hex(raw))


def node_hash(*parts: Column) -> Column:
    """H of digests: they are concatenated as hex text."""
    return digest(hexed(F.concat(*parts)).cast("binary"))


def leaf_hash(values: Sequence[Column]) -> Column:
    """H of values: ``-`` for null, else the number of UTF-8 bytes, ``:`` and the value."""

    def told(v: Column) -> Column:
        raw = v.cast("string").cast("binary")
        return F.when(v.isNull(), F.lit(b"-")).otherwise(F.concat(F.octet_length(raw).cast("string").cast("binary"), F.lit(b":"), raw))

    return digest(F.concat(*[told(v) for v in values]))


def sibling_indices(index: Column, arity: int) -> list[Column]:
    """Indices of the other slots of a node's run: the next slot, the one after it, and so on around."""
    if arity == 2:
        return [index.bitwiseXOR(F.lit(1).cast("long"))]
    slot = index % arity
    return [index - slot + (slot + j) % arity for j in range(1, arity)]


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """``nodes`` (tree, idx, n, h, ...) with left and right: the digests of the run's nodes before and behind."""
    others = nodes.select(F.col("tree").alias("t"), F.col("idx").alias("i"), F.col("h").alias("o"))
    met = nodes
    for j, index in enumerate(sibling_indices(F.col("idx"), arity), 1):
        other = others.toDF(f"t{j}", f"i{j}", f"o{j}")
        met = met.join(other, (F.col("tree") == F.col(f"t{j}")) & (index == F.col(f"i{j}")), "left").drop(f"t{j}", f"i{j}")
    slot, none = F.col("idx") % arity, F.lit(b"")

    def at(s: int, wanted: Column) -> Column:
        """The digest in slot ``s``, where it is wanted."""
        held = none
        for j in range(1, arity):
            held = F.when(slot == (s - j) % arity, F.coalesce(f"o{j}", none)).otherwise(held)
        return F.when(wanted, held).otherwise(none)

    left = F.concat(*[at(s, slot > s) for s in range(arity)])
    right = F.concat(*[at(s, slot < s) for s in range(arity)])
    return met.select(*nodes.columns, left.alias("left"), right.alias("right"))


def grow(leaves: DataFrame, arity: int, name: str) -> list[DataFrame]:
    """The levels from the leaves up, each with its siblings, written once.

    ``leaves`` has tree, idx, n, h and what is carried with a leaf.  A node
    that is alone in its level (n = 1) is its tree's top and goes no further.
    """
    levels, nodes = [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    while True:
        level = stored(with_siblings(nodes, arity), f"{name}-{len(levels)}")
        levels.append(level)
        if most <= 1:
            return levels
        h = node_hash(F.col("h"), F.col("right")).alias("h")
        nodes = level.where((F.col("n") > 1) & (F.col("idx") % arity == 0)).select("tree", parent("idx", arity).alias("idx"), F.ceil(F.col("n") / arity).alias("n"), h)
        most = -(-most // arity)


def parent(idx: str, arity: int) -> Column:
    return F.floor(F.col(idx) / arity)


def tops(levels: list[DataFrame]) -> DataFrame:
    """(tree, level, h): every tree's top node."""
    each = [x.where("n = 1").select("tree", F.lit(k).alias("level"), "h") for k, x in enumerate(levels)]
    return reduce(DataFrame.unionAll, each)


def handed_down(levels: list[DataFrame], paths: DataFrame, arity: int, name: str) -> DataFrame:
    """The leaves with steps, (left, right) level by level up to their tree's top and on by the top's own steps.

    Lists of all levels but the leaves' are written, so plans don't grow.
    ``paths`` has tree, level and steps of every top, and columns that are handed down too.
    """
    more = [c for c in paths.columns if c not in ("tree", "level", "steps")]
    key = [F.col("tree").alias("t"), F.col("idx").alias("i"), F.lit(False).alias("top"), "steps", *more]
    above = None
    for k in range(len(levels) - 1, -1, -1):
        ends = paths.where(F.col("level") == k).select(F.col("tree").alias("t"), F.lit(0).cast("long").alias("i"), F.lit(True).alias("top"), "steps", *more)
        above = ends if above is None else ends.unionAll(above.select(*key))
        alone = F.col("n") == 1
        met = levels[k].join(above, (F.col("tree") == F.col("t")) & (F.when(alone, 0).otherwise(parent("idx", arity)) == F.col("i")) & (alone == F.col("top")))
        steps = F.when(alone, F.col("steps")).otherwise(F.concat(F.array(F.struct("left", "right")), "steps"))
        above = met.withColumn("steps", steps).drop("t", "i", "top", "n", "left", "right")
        if k:
            above = stored(above, f"{name}-{k}")
    return above


def fold(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf and its siblings."""
    return F.aggregate(steps, leaf, lambda h, s: node_hash(s["left"], h, s["right"]))


def proof_hash(steps: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: hexed(F.concat(s["left"], s["right"]))), "").cast("binary"), 256)


def manifest(
    docs: DataFrame,
    fields: Sequence[str] = FIELDS,
    key: str = "doc_id",
    by: str = "source",
    arity: int = ARITY,
    claims: Mapping[str, Callable[..., Column]] | None = None,
) -> DataFrame:
    """Per row: the key, leaf, subroot, root (32-byte digests), steps, and the columns of ``claims``.

    A leaf hashes ``fields``; any of them may be null.  Leaves of one value of
    ``by`` (null is one) ascend by key, nulls first, then by leaf, so rows that
    are the same are interchangeable.  ``claims`` gives more digests by functions
    of the fields' columns, in the order of ``fields``, to be checked with
    ``fold`` against the row's steps.  Texts may be of any length.  An empty
    table gives no rows; other columns are not read, whatever their names.
    """
    at = {f: f"f{i}" for i, f in enumerate(dict.fromkeys([*fields, key, by]))}
    read = pick(docs, **{alias: name for name, alias in at.items()})
    cols = [F.col(at[f]) for f in fields]
    given = {f"claim{i}": f(*cols) for i, f in enumerate((claims or {}).values())}
    rows = stored(read.select(F.col(at[key]).alias("key"), F.col(at[by]).cast("string").alias("by"), leaf_hash(cols).alias("h"), *[c.alias(a) for a, c in given.items()]), "merkle-rows")
    ranked = assign_ids(rows, ["by", "key", "h"], id_col="rank").withColumn("run", F.shiftright("rank", RUN_BITS))
    # first rank and rows of each value, looked up by (value, run of ranks)
    runs = ranked.groupBy("by", "run").agg(F.min("rank").alias("a"), F.count(F.lit(1)).alias("m"))
    same = Window.partitionBy("by")
    heads = runs.select(F.col("by").alias("b"), F.col("run").alias("r"), F.min("a").over(same).alias("tree"), F.sum("m").over(same).alias("n"))
    leaves = ranked.join(heads, F.col("by").eqNullSafe(F.col("b")) & (F.col("run") == F.col("r"))).select(
        "tree", (F.col("rank") - F.col("tree")).alias("idx"), "n", "h", "key", *given
    )
    levels = grow(leaves, arity, "merkle-rows-level")
    subroots = stored(tops(levels), "merkle-subroots")
    trees = assign_ids(subroots.select(F.col("tree").alias("of"), "level", "h"), ["of"], id_col="idx")
    above = grow(trees.select(F.lit(0).cast("long").alias("tree"), "idx", F.lit(subroots.count()).cast("long").alias("n"), "h", "of", "level"), arity, "merkle-trees-level")
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    root = tops(above).select("tree", F.col("level"), none.alias("steps"), F.col("h").alias("root"))
    paths = handed_down([above[0].withColumnRenamed("level", "own"), *above[1:]], root, arity, "merkle-trees-path")
    ends = paths.select(F.col("of").alias("tree"), F.col("own").alias("level"), "steps", F.col("h").alias("subroot"), "root")
    out = handed_down(levels, stored(ends, "merkle-ends"), arity, "merkle-rows-path")
    return out.select("key", F.col("h").alias("leaf"), "subroot", "root", "steps", *given).toDF(key, "leaf", "subroot", "root", "steps", *(claims or {}))
