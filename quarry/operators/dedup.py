"""Exact dedup, anti join against the store, last-write-wins.

Dedup is one aggregate that carries the surviving row: the partial (map-side)
aggregate turns a boilerplate chunk that repeats on every page into one row per
map task, so a hot hash never lands whole in one task, and no join back is
needed.  Every hash survives exactly once, whatever the ids are: null, repeated
or of any size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.ids import assign_ids
from quarry.session import checkpoint_root


def with_chunk_hash(df: DataFrame, text: str = "chunk_text") -> DataFrame:
    """md5 hex of the UTF-8 text (same hex as Python's hashlib)."""
    return df.withColumn("chunk_hash", F.md5(F.col(text)))


def dedup_exact(
    df: DataFrame,
    text: str = "chunk_text",
    order_cols: Sequence[str] = ("doc_id", "chunk_pos"),
) -> DataFrame:
    """A1: keep the first row (by ``order_cols``, nulls first) for each md5 of ``text``.

    Adds ``chunk_hash``.  Rows that agree in ``order_cols`` and text are one.
    """
    h = df if "chunk_hash" in df.columns else with_chunk_hash(df, text)
    rest = [c for c in h.columns if c != "chunk_hash"]
    first = h.groupBy("chunk_hash").agg(F.min_by(F.struct(*rest), F.struct(*order_cols)).alias("_r"))
    return first.select(*[F.col("chunk_hash") if c == "chunk_hash" else F.col("_r").getField(c).alias(c) for c in h.columns])


def dedup_with_ids(
    df: DataFrame,
    text: str = "chunk_text",
    order_cols: Sequence[str] = ("doc_id", "chunk_pos"),
    start=0,
    id_col: str = "id",
    existing: DataFrame | None = None,
) -> DataFrame:
    """A1, J1 (hashes of ``existing`` go), W1.

    The anti join sees every hash once, so a hot one is no hot key.  Survivors
    are checkpointed; ids depend only on their order and hash, so that light
    table is numbered and joined back on the unique hash.
    """
    checkpoint_root(df.sparkSession)
    kept = dedup_exact(df, text, order_cols)
    if existing is not None:
        kept = new_chunks_only(kept, existing)
    kept = kept.checkpoint()
    numbered = assign_ids(kept.select(*order_cols, "chunk_hash"), [*order_cols, "chunk_hash"], start, id_col)
    return kept.join(numbered.select("chunk_hash", id_col), "chunk_hash")


def new_chunks_only(new: DataFrame, existing: DataFrame, key: str = "chunk_hash") -> DataFrame:
    """Drop rows whose hash is already stored (left anti join)."""
    return new.join(existing.select(key), key, "left_anti")


def last_write_wins(df: DataFrame, key_cols: Sequence[str], arrival: str) -> DataFrame:
    """A5: one row per key; the latest ``arrival`` survives, of ties the largest row.

    The surviving row is carried through the aggregate, so ties leave one row.
    Columns that can't be compared (maps) can't break a tie.
    """
    rest = [f.name for f in df.schema.fields if f.name not in key_cols]
    ordered = [f.name for f in df.schema.fields if f.name in rest and "map<" not in f.dataType.simpleString()]
    last = df.groupBy(*key_cols).agg(F.max_by(F.struct(*rest), F.struct(arrival, *[c for c in ordered if c != arrival])).alias("_r"))
    return last.select(*[F.col(c) if c in key_cols else F.col("_r").getField(c).alias(c) for c in df.columns])
