"""Store audits and bookkeeping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.session import checkpoint_root


def distinct_sources(chunks: DataFrame, file: str = "file") -> DataFrame:
    """A3: the source files present in the chunk table."""
    return chunks.select(file).distinct()


def xref_missing_sources(sources: DataFrame, chunks: DataFrame, file: str = "file") -> DataFrame:
    """Sources with no chunk in the store, sorted."""
    return sources.select(file).distinct().join(distinct_sources(chunks, file), file, "left_anti").orderBy(file)


def audit_id_consistency(meta_ids: DataFrame, vector_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """One row: entry counts, ids only in metadata, ids only in the vector
    store, and whether the two agree (full outer join on id + one aggregate)."""
    m = meta_ids.select(id_col).distinct().withColumn("_m", F.lit(1))
    v = vector_ids.select(id_col).distinct().withColumn("_v", F.lit(1))
    j = m.join(v, id_col, "full_outer")
    out = j.agg(
        F.count("_m").alias("meta_entries"),
        F.count("_v").alias("vector_entries"),
        F.count(F.when(F.col("_v").isNull(), 1)).alias("missing_in_vectors"),
        F.count(F.when(F.col("_m").isNull(), 1)).alias("missing_in_meta"),
    )
    return out.withColumn("consistent", (F.col("missing_in_vectors") == 0) & (F.col("missing_in_meta") == 0))


def union_increment(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored chunks plus the new ones."""
    return old.unionByName(new, allowMissingColumns=True)


def ingest_report(existing: DataFrame, new: DataFrame, records: DataFrame, raw: str = "raw_text",
                  unparsable: DataFrame | None = None, vec: str = "embedding") -> DataFrame:
    """A4: existing chunks, new chunks, skipped records (empty ones and rows of
    ``unparsable``), vectors added (new rows that have one) -- one aggregate
    over a tagged union, no cross join."""
    c = T.clean_text(F.coalesce(F.col(raw), F.lit("")))
    tagged = (
        existing.select(F.lit("e").alias("t"))
        .unionByName(new.select(F.lit("n").alias("t")))
        .unionByName(records.filter(c == "").select(F.lit("s").alias("t")))
    )
    if vec in new.columns:
        tagged = tagged.unionByName(new.filter(F.col(vec).isNotNull()).select(F.lit("v").alias("t")))
    if unparsable is not None:
        tagged = tagged.unionByName(unparsable.select(F.lit("s").alias("t")))
    return tagged.agg(
        F.count(F.when(F.col("t") == "e", 1)).alias("existing"),
        F.count(F.when(F.col("t") == "n", 1)).alias("new_chunks"),
        F.count(F.when(F.col("t") == "s", 1)).alias("skipped_docs"),
        F.count(F.when(F.col("t") == "v", 1)).alias("vectors_added"),
    )


def write_observed(records: DataFrame, ingest: Callable[[DataFrame], DataFrame], path: str, raw: str = "raw_text") -> tuple[int, int, int, int]:
    """A4 without a second scan: write ``ingest(records)`` to ``path`` and count on the way.

    Returns (kept, skipped, unparsable, new chunks): records with a text,
    empty ones, rows whose ``ok`` is false, and chunks written.  The records
    are counted where they are first read, the chunks in the write itself.
    Input that holds nothing counts as zeros.
    """
    c = T.clean_text(F.coalesce(F.col(raw), F.lit("")))
    ok = F.col("ok") if "ok" in records.columns else F.lit(True)
    seen, written = Observation(), Observation()
    counted = records.observe(
        seen,
        F.count(F.when(ok & (c != ""), 1)).alias("kept"),
        F.count(F.when(ok & (c == ""), 1)).alias("skipped"),
        F.count(F.when(~ok, 1)).alias("unparsable"),
    )
    checkpoint_root(records.sparkSession)
    # one pass over the records, whatever the ingest reads them for
    held = counted.checkpoint()
    out = ingest(held.where(ok) if "ok" in records.columns else held)
    out.observe(written, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    first = seen.get if not held.isEmpty() else {"kept": 0, "skipped": 0, "unparsable": 0}
    n = 0 if records.sparkSession.read.schema(out.schema).parquet(path).isEmpty() else written.get["n"]
    return first["kept"], first["skipped"], first["unparsable"], n
