"""Session helpers: a local session for tests/bench and a shared scratch area.

Scratch data (round trips, lineage cuts, streaming checkpoints) lives under the
folder the cluster names in ``spark.checkpoint.dir``.  A folder of our own is
created only when the session has none (local tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def local_session(cpus: str | int = "*", shuffle_partitions: int = 8, app: str = "quarry") -> SparkSession:
    """A local[N] session configured the way the tests and the bench expect."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # reliable checkpoints (id numbering, crawl rounds, micro-batches) are
        # removed once their DataFrames are garbage collected
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and written intermediates.

    Reads ``spark.checkpoint.dir`` (or the context's checkpoint dir).  When
    neither is set, a local session gets a fresh folder under the system temp
    dir; on a cluster, where such a folder isn't shared, this raises.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="quarry-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the checkpoint root (never reused)."""
    root = checkpoint_root(spark)
    # no mkdir here: the root may be a URI (file:, hdfs:, s3a:); writers create it
    return f"{root}/quarry-scratch/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame) -> DataFrame:
    """Round-robin an under-partitioned input over the cluster's cores.

    A small parquet file with one row group scans as one task; the per-row
    text work that follows (chunking, hashing, HTML extraction) would then run
    on one core.  On a large input the scan already yields more partitions
    than cores and this is a no-op (no shuffle is added).
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df


def table(spark: SparkSession, sf_dir: str, name: str, parallel: bool = True) -> DataFrame:
    """One driver table (parquet) from an sf directory, spread over the cores."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if parallel else df
