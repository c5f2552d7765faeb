"""Column picking, row keys and written intermediates shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import scratch_path


def positional(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with columns c0, c1, ... and the map from the old names.

    Operators work on positional names, so extra columns of the input can have
    any name (also one that differs from ours only in case) without clashing.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(reversed([*zip(df.columns, names, strict=True)]))


def pick(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the columns named as values, renamed to the keys."""
    out, at = positional(df)
    return out.select(*[F.col(at[name]).alias(alias) for alias, name in wanted.items()])


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` written as Parquet to the cluster's shared checkpoint folder and read again; ``options`` are the writer's."""
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """Two never-null longs that name a row by its content.

    Rows with the same id and the same text share the key: the operators treat
    them as copies of one document.  The key survives recomputation, unlike
    row numbers of a scan.
    """
    return F.coalesce(doc_id.cast("long"), F.lit(0)), F.xxhash64(text, doc_id, doc_id.isNull())


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod ``modulus``; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null")).cast("binary")) % modulus
