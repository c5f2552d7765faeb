"""Structured Streaming jobs.

Both run the batch operators inside ``foreachBatch`` with a reliable
checkpoint location under the session's checkpoint folder.  An epoch writes
its own folders (``run=.../epoch=...``) and overwrites them when it is
replayed, and reads its tables without them; so a failure between two writes
leaves nothing behind that a replay would count.  Records delivered again under
another checkpoint add nothing: R1 drops chunks whose hash is stored (J1), R2
admits keys that are not yet in the cache and logs only events not yet logged.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.operators import embed
from quarry.plans import jobs
from quarry.session import scratch_path
from quarry.sources.buckets import BucketedTable

DOC_RECORD_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
REQUEST_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("key", T.StringType())])


def _run_name(checkpoint: str) -> str:
    """A stream's name in its tables: one for each checkpoint location."""
    return hashlib.md5(checkpoint.encode()).hexdigest()[:12]


def _epoch(table: str, run: str, epoch_id: int) -> str:
    """The folder that holds what one epoch of one run has written, and nothing else."""
    return f"{table}/run={run}/epoch={epoch_id}"


def _before(spark: SparkSession, table: str, run: str, epoch_id: int) -> DataFrame | None:
    """The table without what this epoch wrote before it was replayed; None if nothing is there.

    Decided by data files, not by markers that a committer may leave out."""
    jvm = spark.sparkContext._jvm
    glob = jvm.org.apache.hadoop.fs.Path(f"{table}/run=*/epoch=*/*.parquet")
    found = glob.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(glob)
    if not found:
        return None
    rows = spark.read.parquet(table)
    return rows.filter(~((F.col("run").cast("string") == run) & (F.col("epoch") == epoch_id))).drop("run", "epoch")


def stream_ingest(spark: SparkSession, src: str, store: str, checkpoint: str | None = None,
                  schema: T.StructType = DOC_RECORD_SCHEMA, max_files_per_trigger: int | None = None,
                  with_embedding: bool = True, limit: int = 512, page_records: bool = False,
                  buckets: int | None = None) -> None:
    """Pick up new record files, add only unseen chunks, continue ids.

    The store is bucketed by chunk hash (``BucketedTable``), so J1 moves a
    batch's hashes to their buckets and nothing that is stored.

    ``page_records=True`` reads crawler output (one pretty-printed page record
    per ``*.json`` file, any of the HTML/PDF/feed shapes); otherwise JSON
    lines ``(doc_id, text)``.  Runs until the files available now are
    processed (``availableNow``)."""
    if page_records:
        from quarry.sources.readers import PAGE_RECORD_SCHEMA

        schema = PAGE_RECORD_SCHEMA
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    if page_records:
        reader = reader.option("multiLine", True).option("pathGlobFilter", "*.json")
        from quarry.sources.readers import record_ok, record_place

        stream = reader.json(src).select(*record_place(), "*").withColumn("ok", record_ok())
    else:
        stream = reader.json(src)

    checkpoint = checkpoint or scratch_path(spark, "ckpt-ingest")
    run = _run_name(checkpoint)

    def process(batch: DataFrame, epoch_id: int) -> None:
        recs = jobs.records_from_page_json(batch) if page_records else jobs.documents_as_records(batch)
        new = jobs.ingest_incremental(recs, stored.rows((run, epoch_id)), limit, with_embedding=with_embedding)
        stored.put(new, run, epoch_id)

    with BucketedTable(spark, store, "chunk_hash", buckets) as stored:
        q = (stream.writeStream.foreachBatch(process)
             .option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
        q.awaitTermination()


def stream_query_cache(spark: SparkSession, src: str, cache: str, checkpoint: str | None = None,
                       cap: int | None = 1000, max_files_per_trigger: int | None = None,
                       schema: T.StructType = REQUEST_SCHEMA, hits_log: str | None = None) -> None:
    """R2: a request stream against the query cache: look up every request,
    embed the misses, admit new keys (in arrival order) while the cache holds
    fewer than ``cap`` entries (None: without a limit).  The cache table is ``(query, first_arrival,
    embedding)``; an optional hit log records ``(event_id, query, hit)``."""
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(src)

    checkpoint = checkpoint or scratch_path(spark, "ckpt-cache")
    run = _run_name(checkpoint)

    def process(batch: DataFrame, epoch_id: int) -> None:
        have = _before(spark, cache, run, epoch_id)
        firsts = batch.groupBy("key").agg(F.min("event_id").alias("first_arrival"))
        if have is not None:
            firsts = firsts.join(have.select(F.col("query").alias("key")), "key", "left_anti")
        admitted = firsts
        if cap is not None:
            room = max(cap - (have.count() if have is not None else 0), 0)
            admitted = firsts.orderBy("first_arrival", "key").limit(room)
        vecs = embed.embed_text(admitted.withColumnRenamed("key", "query"), "query", "embedding")
        vecs.select("query", "first_arrival", "embedding").write.mode("overwrite").parquet(_epoch(cache, run, epoch_id))
        if hits_log:
            mine = spark.read.schema("query string, first_arrival long").parquet(_epoch(cache, run, epoch_id))
            cached = mine.select(F.col("query").alias("key"), F.col("first_arrival").alias("_f"), F.lit(True).alias("_in"))
            if have is not None:  # cached before this batch: every request hits
                cached = cached.unionByName(have.select(F.col("query").alias("key"), F.lit(None).cast("long").alias("_f"), F.lit(True).alias("_in")))
            log = batch.join(cached, "key", "left").select(
                "event_id", F.col("key").alias("query"),
                (F.coalesce("_in", F.lit(False)) & (F.col("_f").isNull() | (F.col("event_id") > F.col("_f")))).alias("hit"))
            logged = _before(spark, hits_log, run, epoch_id)
            if logged is not None:
                log = log.join(logged.select("event_id"), "event_id", "left_anti")
            log.write.mode("overwrite").parquet(_epoch(hits_log, run, epoch_id))

    q = (stream.writeStream.foreachBatch(process)
         .option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
