"""Dense ids in a fixed order (W1) and the next free id (A2).

``row_number() over (order by k)`` without ``partitionBy`` runs in one task.
Instead: range-partition on the order key, number rows inside each partition,
materialise that once (reliable checkpoint), and add per-partition offsets.
The offsets table has one row per partition, so broadcasting it is bounded by
the partition count, not by the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import checkpoint_root

_LOCAL_MASK = (1 << 33) - 1


def next_id(chunks: DataFrame, id_col: str = "id") -> Column:
    """A2 as an aggregate expression: ``coalesce(max(id) + 1, 0)``."""
    return F.coalesce(F.max(F.col(id_col)) + 1, F.lit(0).cast("long"))


def next_id_value(chunks: DataFrame, id_col: str = "id") -> int:
    """A2 evaluated (one aggregate row to the driver)."""
    return int(chunks.agg(next_id(chunks, id_col).alias("n")).first()["n"])


def assign_ids(
    df: DataFrame,
    order_cols: Sequence[str],
    start: int | Column = 0,
    id_col: str = "id",
    num_partitions: int | None = None,
) -> DataFrame:
    """``id = start + row_number() over (order by order_cols) - 1``.

    ``order_cols`` must be unique per row (ids are then deterministic across
    retries).  ``start`` may be an int or a scalar Column (e.g. a subquery).
    """
    # AQE may size the range exchange (partition ids are read after it)
    parts = df.repartitionByRange(num_partitions, *order_cols) if num_partitions else df.repartitionByRange(*order_cols)
    # Partition ids and positions are materialised once (reliable checkpoint in
    # the shared checkpoint folder): the per-partition counts and the rows then
    # read the same copy.  Re-evaluating the range exchange could sample other
    # boundaries from a differently ordered input and number rows twice.
    checkpoint_root(df.sparkSession)
    ranked = (
        parts.sortWithinPartitions(*order_cols)
        .withColumn("_pid", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_MASK)))
        .checkpoint()
    )
    counts = ranked.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_pid",
        (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_off"),
    )
    start_col = start if isinstance(start, Column) else F.lit(int(start))
    return (
        ranked.join(F.broadcast(offsets), "_pid")
        .withColumn(id_col, (start_col + F.col("_off") + F.col("_local")).cast("long"))
        .drop("_pid", "_local", "_off")
    )
