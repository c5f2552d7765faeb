"""Bucketed stores: joins on the key don't move them, epochs replace themselves, any session opens them."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import dedup
from quarry.session import scratch_path
from quarry.sources.buckets import BucketedTable
from quarry.streaming import jobs as SJ


def _rows(spark, lo, hi):
    return spark.range(lo, hi).select("id", F.md5(F.col("id").cast("string")).alias("chunk_hash"), F.array(F.lit(0.5)).alias("v"))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_anti_join_leaves_the_store_where_it_is(spark):
    folder = scratch_path(spark, "buckets")
    with BucketedTable(spark, folder, "chunk_hash", 5) as t:
        assert t.rows() is None
        t.put(_rows(spark, 0, 300), "a", 0)
        t.put(_rows(spark, 300, 400), "a", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        with BucketedTable(spark, folder, "chunk_hash", 64) as t:  # an old table keeps its count
            assert t.buckets == 5
            new = dedup.new_chunks_only(_rows(spark, 390, 410), t.rows())
            plan = _plan(new)
            at = plan.index("Bucketed: true")
            assert plan.count("Exchange") == 1 and plan.index("Exchange") < at and "ReadSchema: struct<chunk_hash:string>" in plan[at:]
            assert sorted(r["id"] for r in new.collect()) == list(range(400, 410))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert spark.read.parquet(folder).count() == 400


def test_an_epoch_replaces_what_it_wrote(spark):
    folder = scratch_path(spark, "buckets")
    with BucketedTable(spark, folder, "chunk_hash", 3) as t:
        t.put(_rows(spark, 0, 10), "a", 0)
        t.put(_rows(spark, 10, 20), "a", 1)
        t.put(_rows(spark, 10, 15), "a", 1)
        assert t.rows().count() == 15 and t.rows(("a", 1)).count() == 10 and t.rows(("b", 1)).count() == 15
        t.put(_rows(spark, 0, 0), "b", 0)
        assert t.rows().count() == 15
    with pytest.raises(ValueError):
        BucketedTable(spark, folder, "id")
    plain = scratch_path(spark, "plain")
    _rows(spark, 0, 3).write.parquet(f"{plain}/run=a/epoch=0")
    with pytest.raises(ValueError):
        BucketedTable(spark, plain, "chunk_hash")


def test_a_stream_killed_in_an_epoch_goes_on_without_loss(spark, monkeypatch):
    src, store, ckpt = (scratch_path(spark, n) for n in ("b-src", "b-store", "b-ckpt"))
    texts = [(i, f"Sentence number {i}. And one that all share.") for i in range(20)]
    spark.createDataFrame(texts, "doc_id long, text string").write.json(src)
    put = BucketedTable.put

    def dies(self, df, run, epoch):
        put(self, df, run, epoch)
        raise RuntimeError("killed after the write, before the epoch is committed")

    monkeypatch.setattr(BucketedTable, "put", dies)
    with pytest.raises(Exception, match="killed"):
        SJ.stream_ingest(spark, src, store, ckpt, with_embedding=False, limit=3, buckets=4)
    monkeypatch.setattr(BucketedTable, "put", put)
    SJ.stream_ingest(spark, src, store, ckpt, with_embedding=False, limit=3)
    SJ.stream_ingest(spark, src, store, scratch_path(spark, "b-again"), with_embedding=False, limit=3)
    got = spark.read.parquet(store)
    assert got.count() == got.select("chunk_hash").distinct().count() == 21
    assert sorted(r["id"] for r in got.select("id").collect()) == list(range(21))


def test_a_control_character_is_no_sentence_break(spark):
    from quarry.functions import text as T

    rows = spark.createDataFrame([("a\u0001b. c!  d",)], "t string").select(T.split_sentences(F.col("t")).alias("s")).first()
    assert rows["s"] == ["a\u0001b.", "c!", "d"]
