"""Line dedup: windows of three consecutive lines that occur before are removed.

Every run of three lines of a document is one window, named by a 128-bit hash
of its line hashes.  The first occurrence of a window, in the order (doc_id,
position; null ids last), stays; the three lines of every later occurrence are
covered, and covered lines are merged into runs and cut out.  Windows of one
document that repeat inside it count too.  All steps are DataFrame functions.

Scale: occurrences are pre-aggregated per map task, so a window on every page
is one partial row per task; the join back is a plain equi join that adaptive
execution can split.  Texts are shuffled once, to meet their covered runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import positional, row_key

LINES = 3


def covered_starts(docs: DataFrame) -> DataFrame:
    """(_d, _t, starts): per document the sorted positions of its later window occurrences.

    ``docs`` has _d, _t (row key), _id and _text.
    """
    lines = F.split("_text", "\n", -1)
    hashed = docs.where(F.col("_text").isNotNull()).select(
        "_d", "_t", "_id",
        F.transform(lines, lambda x: F.xxhash64(x)).alias("_a"),
        F.transform(lines, lambda x: F.xxhash64(F.lit(1), x)).alias("_b"),
    )

    def window(i):
        a, b = F.col("_a"), F.col("_b")
        return F.struct(
            i.alias("pos"),
            F.xxhash64(*[a[i + k] for k in range(LINES)]).alias("h1"),
            F.xxhash64(*[b[i + k] for k in range(LINES)]).alias("h2"),
        )

    windows = hashed.where(F.size("_a") >= LINES).select(
        "_d", "_t", "_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("_a") - LINES), window)).alias("w")
    ).select("w.h1", "w.h2", F.struct(F.col("_id").isNull().alias("n"), F.col("_d"), F.col("_t"), F.col("w.pos").alias("pos")).alias("at"))
    repeated = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first")).where("n > 1").drop("n")
    later = windows.join(repeated, ["h1", "h2"]).where("at > first")
    return later.groupBy("at._d", "at._t").agg(F.array_sort(F.collect_set("at.pos")).alias("starts"))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the text cut, plus n_lines, n_removed and n_spans (long) at the end.

    Null text stays null with 0 lines; an empty text is one empty line; a text
    of fewer than three lines is unchanged; a text whose lines are all covered
    becomes empty.  Rows with equal id and text are one document: all of them
    get the same result.  Other columns pass through, whatever their names.
    """
    base, at = positional(docs)
    d, t = row_key(F.col(at[id_col]), F.col(at[text_col]))
    keyed = base.withColumns({"_d": d, "_t": t, "_id": F.col(at[id_col]), "_text": F.col(at[text_col])})
    hits = covered_starts(keyed.select("_d", "_t", "_id", "_text")).select(
        F.col("_d").alias("_hd"), F.col("_t").alias("_ht"),
        F.expr(f"filter(starts, (p, i) -> i = 0 OR p - starts[i - 1] > {LINES})").alias("_from"),
        F.expr(f"transform(filter(starts, (p, i) -> i = size(starts) - 1 OR starts[i + 1] - p > {LINES}), p -> p + {LINES - 1})").alias("_to"),
    )
    met = keyed.join(hits, (F.col("_d") == F.col("_hd")) & (F.col("_t") == F.col("_ht")), "left").withColumn("_lines", F.split("_text", "\n", -1))
    kept = F.expr(
        "array_join(flatten(transform(sequence(0, size(_from)), k -> slice(_lines, "
        "if(k = 0, 1, _to[k - 1] + 2), "
        "if(k = size(_from), size(_lines), _from[k]) - if(k = 0, 0, _to[k - 1] + 1)))), '\\n')"
    )
    removed = F.expr("aggregate(zip_with(_from, _to, (a, b) -> cast(b - a + 1 AS BIGINT)), 0L, (x, y) -> x + y)")
    hit = F.col("_from").isNotNull()
    out = [
        F.when(hit, kept).otherwise(F.col("_text")).alias(c) if c == at[text_col] else F.col(c) for c in base.columns
    ]
    return met.select(
        *out,
        F.when(F.col("_text").isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long"),
        F.when(hit, removed).otherwise(F.lit(0)).cast("long"),
        F.when(hit, F.size("_from")).otherwise(F.lit(0)).cast("long"),
    ).toDF(*docs.columns, "n_lines", "n_removed", "n_spans")
