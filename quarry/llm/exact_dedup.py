"""Exact dedup: texts are equal if their recipes of content-defined chunks are.

A text without white space is cut into chunks where its bytes say so: a chunk
ends behind a run of ``RUN`` bytes that leave a small remainder by ``MODULUS``,
at ``LEAST`` bytes at the earliest and ``MOST`` at the latest.  So the same passage
is cut alike wherever it stands, and a chunk that many documents hold is one
row of the chunk table.

A chunk's identifier is its hash, verified: distinct contents of one hash are
numbered, and only where a hash has more than one content do occurrences look
their number up.  A document's recipe is the ordered list of its identifiers;
documents with equal recipes are a group.  All steps are DataFrame functions.

Scale: a text is cut once and its chunks written; chunk contents move once
more, after each task has dropped its repeats, to be verified.  What is grouped
and joined from then on are recipes, eight bytes a chunk.  Groups are added up
by (recipe, salt) first, and results go back the same way, so a group that
holds a third of all rows is spread over ``SALTS`` keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import positional, stored

#: white space that does not count
SPACE = "[\\x20\\x09-\\x0D]+"
LEAST, MOST = 256, 4096
RUN, MODULUS = 3, 8
#: bits of a chunk's hash
BITS = 64
SALTS = 256


def cut_pattern(least: int = LEAST, most: int = MOST) -> str:
    """A regular expression for one chunk of a text whose characters are bytes.

    A byte ends a run if it is 1 or 2 modulo ``MODULUS``; a chunk without such
    a run ends at ``most`` bytes or with the text.
    """
    ends = "".join(f"\\x{b:02x}" for b in range(256) if b % MODULUS in (1, 2))
    return f"(?s).{{{least - RUN},{most - RUN}}}?[{ends}]{{{RUN}}}|.{{1,{most}}}"


def chunks(text: Column, least: int = LEAST, most: int = MOST) -> Column:
    """The chunks of a text, each as a string of one character a byte; none for an empty text."""
    as_bytes = F.decode(text.cast("binary"), "ISO-8859-1")
    return F.regexp_extract_all(as_bytes, F.lit(cut_pattern(least, most)), F.lit(0))


def chunk_hash(chunk: Column, bits: int = BITS) -> Column:
    return F.shiftrightunsigned(F.xxhash64(chunk), 64 - bits)


def with_recipes(cut: DataFrame) -> DataFrame:
    """row, doc_id, points, text_sha256 and the recipe: the ordered verified identifiers of the chunks."""
    light = ["row", "doc_id", "points", "text_sha256"]
    both = F.arrays_zip(F.col("hashes").alias("h"), F.col("chunks").alias("chunk"))
    contents = cut.select(F.explode(both).alias("p")).select("p.h", "p.chunk").distinct()
    # verified here: every other hash has one content
    several = stored(contents.groupBy("h").agg(F.count(F.lit(1)).alias("contents")).where("contents > 1").select("h"), "chunk-clashes")
    if several.isEmpty():
        return cut.select(*light, F.transform("hashes", lambda h: F.struct(h.alias("h"), F.lit(0).alias("number"))).alias("recipe"))
    number = F.row_number().over(Window.partitionBy("h").orderBy("chunk")) - 1
    clash = contents.join(several, "h").select("h", "chunk", number.alias("number"))
    at = cut.select("row", F.posexplode(both).alias("pos", "p")).select("row", "pos", "p.h", "p.chunk")
    numbers = at.join(clash.where("number > 0"), ["h", "chunk"]).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("pos", "number"))).alias("told"))
    told = F.coalesce("told", F.create_map().cast("map<int, int>"))
    recipe = F.transform("hashes", lambda h, i: F.struct(h.alias("h"), F.coalesce(F.col("told")[i], F.lit(0)).alias("number")))
    return cut.select(*light, "hashes").join(numbers, "row", "left").withColumn("told", told).select(*light, recipe.alias("recipe"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, most: int = MOST, bits: int = BITS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 and n_chunks for every row.

    Texts are equal if they are the same without ASCII white space; null counts
    as empty, and empty texts are one group.  Of a group the row with the most
    code points stays, then the one with the smallest id (null ids last); of
    rows that still tie, repeated ones, exactly one stays.  Very long texts are
    cut like any other.  An empty table gives no rows; other columns are not
    read, whatever their names.
    """
    base, names = positional(docs)
    text = F.coalesce(F.col(names[text_col]).cast("string"), F.lit(""))
    whole = base.select(
        F.monotonically_increasing_id().alias("row"), F.col(names[id_col]).alias("doc_id"), F.length(text).alias("points"), F.regexp_replace(text, SPACE, "").alias("norm")
    )
    read = whole.select("row", "doc_id", "points", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), chunks(F.col("norm"), least, most).alias("chunks"))
    cut = stored(read.withColumn("hashes", F.transform("chunks", lambda c: chunk_hash(c, bits))), "chunks")
    rows = with_recipes(cut).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    # the smallest of these is the row that stays
    place = F.struct((-F.col("points")).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("row"))
    parts = rows.groupBy("recipe", "salt").agg(F.count(F.lit(1)).alias("size"), F.min(place).alias("first"))
    groups = parts.groupBy("recipe").agg(F.sum("size").alias("group_size"), F.min("first").alias("first"))
    told = parts.select("recipe", "salt").join(groups, "recipe")
    return rows.join(told, ["recipe", "salt"]).select(
        "doc_id",
        F.col("first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
        F.size("recipe").cast("long").alias("n_chunks"),
    )
