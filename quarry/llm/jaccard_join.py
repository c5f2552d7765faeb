"""N-gram Jaccard join: near-duplicate groups of documents by word shingles.

Texts with the same set of shingles are one node.  Shingles have a global
order: common ones (in a bounded sample; the sample decides the order only,
never the result) come last, the others by hash.  Two sets that are 80 %
similar share one of the first 20 % (plus one) shingles of either in this
order, so only these prefixes are joined.

* Prefix shingles of two or more nodes are the postings.  Postings of three or
  more -- groups of near copies -- don't give all their pairs.  In a few rounds
  each node is compared with one centre of its postings, first with the node
  that has the fewest shingles of its own; then nodes outside a posting's main
  component are compared with the nodes of other components there.  Pairs inside
  a component can't change the result.
* The places of a shingle in two sets bound what the sets share, which drops
  most pairs exactly where they meet.  The others are given once, at their first
  shingle; then the shared prefix shingles of a pair are counted.
* Overlaps are counted by vertical partitioning: sets are cut into
  ``FRAGMENTS`` ranges of the global order, the overlap of two sets is counted
  in every range separately, and the counts are summed per pair.

Scale: one shuffle of a fifth of the shingles; everything after it handles
nodes that share a rare shingle.  Nothing is gathered per shingle or group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import pick, positional, row_key, stored
from quarry.llm.connect import components
from quarry.llm.shingles import Shingler

PERCENT = 80
FRAGMENTS, FIRST = 8, 2
ROUNDS = 3
#: shingles of a posting's node that tell whether a pair was given before
BEFORE = 8
#: columns of a posting that decide which of its pairs may be similar
KEPT = ("node", "n", "i", "r", "top", "end")
#: documents whose shingles are counted for the global order, and the most shingles that are put last
SAMPLE_DOCS, COMMON = 20_000, 200_000
COMMON_COUNT = 3
#: more rows than this are joined by shuffling
BROADCAST_ROWS = 1_000_000


def _bounded(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcasting if it has few enough rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def common_shingles(texts: DataFrame) -> np.ndarray:
    """Sorted shingles that ``COMMON_COUNT`` texts of a sample of about ``SAMPLE_DOCS`` share; the most common ones, at most ``COMMON``."""
    share = SAMPLE_DOCS / max(1, texts.count())

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh = Shingler()
        for batch in batches:
            for raw in batch.column("raw"):
                yield pa.RecordBatch.from_arrays([pa.array(sh.distinct(raw.as_py()).view(np.int64))], names=["s"])

    sample = texts if share >= 1 else texts.where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < int(share * (1 << 30)))
    counted = sample.select("raw").mapInArrow(shingles, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= COMMON_COUNT)
    rows = counted.orderBy(F.desc("n"), "s").limit(COMMON).select("s").toPandas()["s"]
    return np.sort(rows.to_numpy(dtype=np.int64).view(np.uint64))


def ordered(shingles: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, int]:
    """Sorted shingles in the global order, and how many of them are rare."""
    last = np.isin(shingles, common, assume_unique=True) if len(common) else np.zeros(len(shingles), dtype=bool)
    return np.concatenate((shingles[~last], shingles[last])), int(len(shingles) - last.sum())


def set_table(texts: DataFrame, common: np.ndarray) -> DataFrame:
    """(doc_id, d, t, n, node, p, cut_common, cut, prefix): every text's set and, once per task and node, its prefix."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        sh, seen = Shingler(), set()
        for whole in batches:
            for lo in range(0, whole.num_rows, 1000):
                batch = whole.slice(lo, 1000)
                out: list[list] = [[] for _ in range(6)]
                for raw in batch.column("raw"):
                    s = sh.distinct(raw.as_py())
                    n = len(s)
                    if not n:
                        row = (0, None, None, None, None, None)
                    else:
                        node = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)
                        p = n - (-(-PERCENT * n // 100)) + 1
                        o, rare = ordered(s, common)
                        new = node not in seen
                        seen.add(node)
                        row = (n, node, p, int(p > rare), int(o[p - 1]) - (1 << 63), o[:p].view(np.int64).tolist() if new else None)
                        if len(seen) > 1_000_000:
                            seen.clear()
                    for c, x in zip(out, row, strict=True):
                        c.append(x)
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c) for c in ("doc_id", "d", "t")], *[pa.array(c, k) for c, k in zip(out, types, strict=True)]],
                    names=["doc_id", "d", "t", "n", "node", "p", "cut_common", "cut", "prefix"],
                )

    return stored(texts.mapInArrow(run, f"doc_id {kind}, d long, t long, n long, node long, p long, cut_common int, cut long, prefix array<long>"), "sets")


def postings(sets: DataFrame) -> DataFrame:
    """(s, node, n, i, size, r, c, before): prefix shingles that two or more nodes have, one row per node.

    ``i``: place of the shingle in the node's set; ``r``: of the node's ``c``
    shingles here, those before it; ``before``: the last ``BEFORE`` of these.
    """
    names = ["s", "node", "n", "i"]

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by (s, node), the different ones whose s has another node."""
        held, follows = None, False  # the last row so far; whether the one before it has its s
        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in names]
            if held is not None:
                cols = [np.concatenate((x, c)) for x, c in zip(held, cols, strict=True)]
            if not len(cols[0]):
                continue
            new = np.ones(len(cols[0]), dtype=bool)
            new[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            cols = [c[new] for c in cols]
            same = cols[0][1:] == cols[0][:-1]
            multi = np.concatenate(([follows], same)) | np.concatenate((same, [False]))
            follows = bool(same[-1]) if len(same) else follows
            held = [c[-1:] for c in cols]
            yield pa.RecordBatch.from_arrays([pa.array(c[:-1][multi[:-1]]) for c in cols], names=names)
        if held is not None and follows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in held], names=names)

    rows = sets.where("prefix IS NOT NULL").select(F.posexplode("prefix").alias("i", "s"), "node", "n")
    multi = stored(rows.repartition("s").sortWithinPartitions("s", "node").mapInArrow(shared, "s long, node long, n long, i int"), "postings")
    sized = multi.join(multi.groupBy("s").agg(F.count(F.lit(1)).alias("size")), "s")
    of = Window.partitionBy("node")
    up = of.orderBy("i")
    ranked = {"r": F.row_number().over(up) - 1, "c": F.count(F.lit(1)).over(of), "before": F.collect_list("s").over(up.rowsBetween(-BEFORE, -1))}
    return stored(sized.withColumns(ranked), "postings")


def fragments(texts: DataFrame, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, k, seg): the sets of ``nodes`` (node), cut by the top bits of the hash, from one text of each.

    ``rows`` is the set table.  Repeated rows share the key; a node's segments
    from all of them are one (only segments of such nodes are shuffled for it).
    """
    wanted = rows.where("prefix IS NOT NULL").select("node", "d", "t").join(nodes.distinct(), "node", "left_semi").groupBy("node").agg(F.min(F.struct("d", "t")).alias("k"))
    keys = stored(wanted.select("node", F.col("k.d").alias("d"), F.col("k.t").alias("t")), "wanted")
    keys = rows.select("d", "t").join(_bounded(keys), ["d", "t"]).groupBy("node", "d", "t").agg((F.count(F.lit(1)) > 1).alias("many"))
    found = texts.select("d", "t", "raw").join(_bounded(stored(keys, "wanted")), ["d", "t"]).select("node", "many", "raw")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sh, shift = Shingler(), np.uint64(64 - FRAGMENTS.bit_length() + 1)
        for batch in batches:
            done = set()
            for node, many, raw in zip(batch.column("node").to_pylist(), batch.column("many").to_pylist(), batch.column("raw"), strict=True):
                if node in done:
                    continue
                done.add(node)
                s = sh.distinct(raw.as_py())
                part = s >> shift
                ks, first = np.unique(part, return_index=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([node] * len(ks), pa.int64()), pa.array([many] * len(ks)), pa.array(ks.astype(np.int32)), pa.array([x.view(np.int64) for x in np.split(s, first[1:])], pa.list_(pa.int64()))],
                    names=["node", "many", "k", "seg"],
                )

    segs = stored(found.mapInArrow(cut, "node long, many boolean, k int, seg array<long>"), "fragments")
    once = stored(segs.where("many").drop("many").dropDuplicates(["node", "k"]), "fragments")
    return segs.where("NOT many").drop("many").unionByName(once)


def _overlaps(pairs: DataFrame, segs: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with ``more``: shared shingles in the ranges of ``segs``."""
    left = segs.join(_bounded(pairs.select("a", "b")), F.col("node") == F.col("a")).select("a", "b", "k", F.col("seg").alias("x"))
    met = left.join(segs.select(F.col("node").alias("b"), "k", F.col("seg").alias("y")), ["b", "k"])
    counts = met.select("a", "b", F.size(F.array_intersect("x", "y")).alias("c")).groupBy("a", "b").agg(F.sum("c").alias("more"))
    return pairs.join(counts, ["a", "b"], "left").withColumn("more", F.coalesce("more", F.lit(0)))


def similar(pairs: DataFrame, segs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b; both with segments) those whose Jaccard similarity is ``PERCENT`` or more.

    The overlaps in the last ``FIRST`` ranges are summed first; where these and
    all shingles of the other ranges are too few, the others aren't counted.
    """
    first, rest = segs.where(F.col("k") >= FRAGMENTS - FIRST), segs.where(F.col("k") < FRAGMENTS - FIRST)
    seen = first.groupBy("node").agg(F.sum(F.size("seg")).alias("seen"))
    known = sizes.select("node", "n").join(seen, "node", "left").select("node", "n", (F.col("n") - F.coalesce("seen", F.lit(0))).alias("left"))
    ka, kb = (known.select(*[F.col(c).alias(x if c == "node" else f"{c}_{x}") for c in known.columns]) for x in "ab")

    def enough(both):
        return 100 * both >= PERCENT * (F.col("n_a") + F.col("n_b") - both)

    some = _overlaps(pairs.join(ka, "a").join(kb, "b"), first).withColumnRenamed("more", "both")
    open_pairs = stored(some.where(enough(F.col("both") + F.least("left_a", "left_b"))), "open_pairs")
    return _overlaps(open_pairs, rest).where(enough(F.col("both") + F.col("more"))).select("a", "b")


def _can(x: str, y: str) -> Column:
    """Whether two nodes may be similar by what can be shared before and from a shingle of both on.

    What they share before it is among the postings of both there; from it on it
    is in neither's rest, nor in what the one whose prefix ends first can share.
    """
    n = F.col(f"n_{x}") + F.col(f"n_{y}")
    rest = [F.col(f"top_{i}") - F.col(f"r_{i}") for i in (x, y)]
    first = F.when(F.col(f"end_{x}") <= F.col(f"end_{y}"), rest[0]).otherwise(rest[1])
    most = F.least(f"r_{x}", f"r_{y}") + F.least(first, *[F.col(f"n_{i}") - F.col(f"i_{i}") for i in (x, y)])
    return 100 * most >= PERCENT * (n - most)


def _labelled(rows: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _divided(rows: DataFrame) -> DataFrame:
    """Rows of the postings that have nodes of two components."""
    several = rows.groupBy("s").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("s")
    return rows.join(several, "s", "left_semi")


def _with_fragments(segs: DataFrame | None, texts: DataFrame, pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """``segs`` and those of the nodes of ``pairs`` that it lacks."""
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    if segs is None:
        return fragments(texts, nodes, rows)
    return segs.unionByName(fragments(texts, stored(nodes.join(segs.select("node").distinct(), "node", "left_anti"), "lacking"), rows))


def _pairs(left: DataFrame, right: DataFrame, condition: str) -> DataFrame:
    """(a, b), a < b: nodes of different components that share a posting, where ``condition`` holds of the
    rows x of ``left`` and y of ``right`` and their bounds allow similarity.

    A pair is given at the first shingle that both have; where that lies further
    back than ``before`` reaches, it is given again.
    """
    x, y = (rows.select("s", *[F.col(c).alias(f"{c}_{i}") for c in rows.columns if c != "s"]) for rows, i in ((left, "x"), (right, "y")))
    fresh = ~F.arrays_overlap("before_x", "before_y")
    met = x.join(y, "s").where((F.col("comp_x") != F.col("comp_y")) & _can("x", "y") & fresh & F.expr(condition))
    return met.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b"))


def near_links(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Links (a, b) between nodes: enough of them to connect every component."""
    posts = postings(rows)
    sizes = rows.where("prefix IS NOT NULL").select("node", "n", "p", "cut_common", "cut").dropDuplicates(["node"])
    # prefix shingles without a posting aren't in any set whose prefix ends later
    ends = sizes.select("node", "p", F.struct("cut_common", "cut").alias("end"))
    posts = posts.join(ends, "node").withColumn("top", F.col("n") - F.col("p") + F.col("c"))
    posts = stored(posts.withColumn("own", 1 - F.col("c") / F.col("p")).select("s", "size", *KEPT, "before", "own"), "postings")
    links = texts.sparkSession.createDataFrame([], "a long, b long")
    labels, segs = None, None
    large = posts.where(F.col("size") > 2).drop("size", "before")
    for r in range(ROUNDS):
        # what has no shingles of its own, like the text that a group was copied from, is nearest to the others
        order = F.struct("own", "node") if r == 0 else F.struct(F.xxhash64("node", F.lit(r)), "node")
        now = large if labels is None else _divided(_labelled(large.drop("comp"), labels))
        large = now = stored(now if labels is not None else _labelled(now, None), "large")
        centre = now.groupBy("s").agg(F.min(F.struct(order, *KEPT, "comp")).alias("z"))
        centre = centre.select("s", *[F.col(f"z.{c}").alias(f"{c}_z") for c in (*KEPT, "comp")])
        here = now.select("s", *[F.col(c).alias(f"{c}_x") for c in (*KEPT, "comp")])
        met = here.join(centre, "s").where((F.col("comp_x") != F.col("comp_z")) & _can("x", "z"))
        best = met.groupBy("node_x", "node_z").agg(F.count(F.lit(1)).alias("c")).groupBy("node_x").agg(F.max_by("node_z", F.struct("c", "node_z")).alias("a"))
        stars = stored(best.select("a", F.col("node_x").alias("b")), "stars")
        if stars.isEmpty():
            break
        segs = _with_fragments(segs, texts, stars, rows)
        links = stored(links.union(similar(stars, segs, sizes)), "links")
        labels = stored(components(links), "labels")
    # every pair of nodes of different components, once for each posting that has both
    now = stored(_divided(_labelled(posts.drop("own"), labels)), "divided")
    main = now.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("c")).groupBy("s").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"))
    now = stored(now.join(main, "s"), "divided")
    # one of the two is outside the posting's main component; if both are, they are taken in one order
    met = _pairs(now.where("comp != main"), now, "comp_y = main_y OR node_x < node_y")
    met = stored(met.distinct(), "met")
    both = met.select(F.col("a").alias("node")).union(met.select("b")).distinct()
    prefix = posts.join(both, "node", "left_semi").groupBy("node").agg(F.collect_list("s").alias("posted"))
    kinds = ("n", "p", "cut_common", "cut", "posted")
    ia, ib = (sizes.join(prefix, "node").select(F.col("node").alias(i), *[F.col(c).alias(f"{c}_{i}") for c in kinds]) for i in "ab")
    known = met.join(ia, "a").join(ib, "b").withColumn("v", F.size(F.array_intersect("posted_a", "posted_b")))
    # of the set whose prefix ends first, all that isn't in the prefix may be shared, and no more
    a_first = F.struct("cut_common_a", "cut_a") <= F.struct("cut_common_b", "cut_b")
    most = F.col("v") + F.when(a_first, F.col("n_a") - F.col("p_a")).otherwise(F.col("n_b") - F.col("p_b"))
    most = F.least(most, "n_a", "n_b")
    pairs = stored(known.where(100 * most >= PERCENT * (F.col("n_a") + F.col("n_b") - most)).select("a", "b"), "pairs")
    segs = _with_fragments(segs, texts, pairs, rows)
    return stored(links.union(similar(pairs, segs, sizes)), "links")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, d, t (row key), n_shingles, comp (the group's node), component_id for every row.

    Two texts link when their sets of distinct five-word shingles (of A-Z
    lowered words) are 80 % similar; a shorter text is one shingle.
    ``component_id`` is the smallest doc_id that links reach, null ids left
    out.  Null texts and texts without words have the empty set, are linked
    with nothing and keep their own id.  Repeated rows are equal texts, so one
    component.  Sets are told apart by 64-bit hashes.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    d, t = row_key(F.col("doc_id"), F.col("text"))
    texts = rows.select("doc_id", d.alias("d"), t.alias("t"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))
    sets = set_table(texts, common_shingles(texts))
    labels = stored(components(near_links(texts, sets)), "labels")
    joined = stored(_labelled(sets.select("doc_id", "d", "t", F.col("n").alias("n_shingles"), "node"), labels), "labelled")
    least = joined.where("node IS NOT NULL").groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    return joined.join(least, "comp", "left").select("doc_id", "d", "t", "n_shingles", "comp", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates, the one with the smallest id; rows without words all stay."""
    base, at = positional(docs)
    d, t = row_key(F.col(at[id_col]), F.col(at[text_col]))
    groups = stored(near_groups(docs, id_col, text_col).select("doc_id", "d", "t", "comp"), "groups")
    first = groups.where("comp IS NOT NULL").groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull(), "d", "t")).alias("k"))
    stay = first.select("comp", F.col("k.d").alias("kd"), F.col("k.t").alias("kt"))
    empty = groups.where("comp IS NULL").select(F.lit(None).cast("long"), "d", "t").distinct()
    keyed = base.withColumns({"kd": d, "kt": t}).join(_bounded(stay.union(empty)), ["kd", "kt"])
    # rows repeated as they are share the key: one of a group is left, all of those without words
    row = F.struct(*base.columns)
    one = keyed.where("comp IS NOT NULL").groupBy("comp").agg(F.first(row).alias("r")).select("r.*")
    return one.unionByName(keyed.where("comp IS NULL").select(*base.columns)).toDF(*docs.columns)
