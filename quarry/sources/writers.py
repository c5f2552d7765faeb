"""Writers (S6-S9).  All paths are shared storage (``scratch_path`` or a
caller-provided location); writes are whole-job and idempotent per mode."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import dedup


def write_pages(df: DataFrame, path: str, key_cols: Sequence[str] = ("slug",), arrival: str = "page_id") -> None:
    """Page records as JSON, one record per key; a later write replaces an
    earlier one (A5), the directory is overwritten."""
    dedup.last_write_wins(df, list(key_cols), arrival).write.mode("overwrite").json(path)


def write_feed(df: DataFrame, path: str) -> None:
    """Overwrite a JSON feed (UTF-8, non-ASCII kept as is)."""
    df.write.mode("overwrite").option("encoding", "UTF-8").json(path)


def write_store(chunks: DataFrame, path: str, mode: str = "append") -> None:
    """Append new chunks + vectors (incremental) or overwrite (rebuild)."""
    if mode not in ("append", "overwrite"):
        raise ValueError("mode must be 'append' or 'overwrite'")
    chunks.write.mode(mode).parquet(path)


def write_cache(df: DataFrame, path: str) -> None:
    """Write the query cache ``(query, embedding)`` as Parquet."""
    df.select("query", "embedding").write.mode("overwrite").parquet(path)


def write_cache_json(df: DataFrame, path: str) -> None:
    """The cache as JSON objects ``{query: [floats]}``, one a line in as many
    files as there are partitions; no row or task holds the whole cache."""
    df.select(F.to_json(F.create_map("query", "embedding")).alias("value")).write.mode("overwrite").text(path)
