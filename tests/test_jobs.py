"""Job invariants: idempotent ingest, replay-safe streams, caps, audits, crawl."""

from pyspark.sql import functions as F

from quarry.operators import audit, cache, links
from quarry.plans import jobs
from quarry.session import scratch_path
from quarry.streaming import jobs as SJ

SF = "/root/testdata/sf0.001"


def _records(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    return jobs.documents_as_records(docs)


def test_ingest_twice_adds_nothing(spark):
    recs = _records(spark)
    run1 = jobs.ingest_incremental(recs, None, with_embedding=False).checkpoint()
    run2 = jobs.ingest_incremental(recs, run1, with_embedding=False)
    assert run1.count() > 0 and run2.count() == 0
    ids = [r.id for r in run1.orderBy("id").collect()]
    assert ids == list(range(len(ids)))


def test_rebuild_store_is_consistent(spark):
    st = jobs.ingest_rebuild(_records(spark))
    rep = audit.audit_id_consistency(st.select("id"), st.select("id")).first()
    assert rep.consistent and rep.meta_entries == st.count()
    broken = audit.audit_id_consistency(st.select("id"), st.filter(F.col("id") % 2 == 0).select("id")).first()
    assert not broken.consistent and broken.missing_in_vectors > 0 and broken.missing_in_meta == 0


def test_stream_replay_is_noop(spark):
    src, store, ckpt = scratch_path(spark, "t-src"), scratch_path(spark, "t-store"), scratch_path(spark, "t-ckpt")
    spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").write.json(src)
    SJ.stream_ingest(spark, src, store, ckpt, with_embedding=False)
    n1 = spark.read.parquet(store).count()
    # a fresh checkpoint replays every file: the hash anti join keeps the store unchanged
    SJ.stream_ingest(spark, src, store, scratch_path(spark, "t-ckpt2"), with_embedding=False)
    assert spark.read.parquet(store).count() == n1 > 0


def test_cache_admission_cap(spark):
    log = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c"), (5, "b"), (6, "c"), (7, "d")],
                                "arrival long, key string")
    out = {r.arrival: (r.admitted, r.hit) for r in cache.cache_admission(log, "key", "arrival", cap=2).collect()}
    assert out == {1: (True, False), 2: (True, False), 3: (True, True), 4: (False, False), 5: (True, True),
                   6: (False, False), 7: (False, False)}


def test_crawl_with_start_urls(spark):
    pages = spark.createDataFrame([
        ("http://h.example.com/", '<a href="/a">a</a>'),
        ("http://h.example.com/a", '<a href="b">b</a><a href="http://other.example.com/x">x</a>'),
        ("http://h.example.com/b", '<a href="/">home</a><a href="/b">self</a>'),
        ("http://h.example.com/island", "<p>none</p>"),
    ], "url string, html string")
    edges = links.follow_filter(links.page_edges(pages))
    starts = spark.createDataFrame([("http://h.example.com/",)], "u string")
    got = {r.url: r.depth for r in links.crawl_reach(edges, pages, starts).collect()}
    assert got == {"http://h.example.com/": 0, "http://h.example.com/a": 1, "http://h.example.com/b": 2}
    frontier = {r.dst_url for r in links.link_frontier(links.page_edges(pages), pages).collect()}
    assert frontier == {"http://other.example.com/x"}


def test_stream_ingest_page_records(spark):
    import json
    import os
    import tempfile

    src = tempfile.mkdtemp(prefix="quarry-crawl-")
    recs = {
        "root.json": {"url": "http://h.example.com/", "title": "Home", "meta": {"description": "d", "keywords": None},
                      "text_lines": ["Welcome to the campus library.", "Apply now."], "article_texts": []},
        "news.json": {"url": "http://h.example.com/news", "title": "News", "meta": {"description": None},
                      "text_lines": ["nav"], "article_texts": ["A club event this week. Join us!"]},
        "doc.json": {"url": "http://h.example.com/a.pdf", "type": "pdf", "content": "Course one.\nModule two."},
        "empty.json": {"url": "http://h.example.com/e", "text_lines": [], "article_texts": []},
    }
    for name, rec in recs.items():
        with open(os.path.join(src, name), "w", encoding="utf-8") as f:
            json.dump(rec, f, indent=2)
    with open(os.path.join(src, "broken.json"), "w") as f:
        f.write("{oops")
    store = scratch_path(spark, "t-crawl-store")
    SJ.stream_ingest(spark, src, store, scratch_path(spark, "t-crawl-ckpt"), with_embedding=True, page_records=True)
    rows = spark.read.parquet(store).orderBy("id").collect()
    texts = {r.file: r.chunk_text for r in rows}
    assert texts == {"doc.json": "Course one. Module two.", "news.json": "A club event this week. Join us!",
                     "root.json": "Welcome to the campus library. Apply now."}
    assert [r.id for r in rows] == [0, 1, 2] and [r.file for r in rows] == ["doc.json", "news.json", "root.json"]
    assert rows[2].tags == ["admissions", "facilities"] and len(rows[0].embedding) == 384


def test_cache_admission_with_loaded_cache(spark):
    log = spark.createDataFrame([(1, "a"), (2, "z"), (3, "b"), (4, "z"), (5, "c"), (6, "b")], "arrival long, key string")
    initial = spark.createDataFrame([("z",)], "query string")
    out = {r.arrival: (r.admitted, r.hit)
           for r in cache.cache_admission(log, "key", "arrival", cap=2, initial=initial).collect()}
    # z is cached from the start (room for one new key: a)
    assert out == {1: (True, False), 2: (True, True), 3: (False, False), 4: (True, True), 5: (False, False),
                   6: (False, False)}


def test_stream_query_cache_matches_batch(spark):
    rows = [(i, f"k{(i * 7) % 11}") for i in range(1, 61)]
    log = spark.createDataFrame(rows, "event_id long, key string")
    src, cache_path, hits = scratch_path(spark, "t-req"), scratch_path(spark, "t-cache"), scratch_path(spark, "t-hits")
    for lo in (1, 21, 41):  # three deliveries in arrival order
        log.filter((F.col("event_id") >= lo) & (F.col("event_id") < lo + 20)).coalesce(1).write.mode("append").parquet(src)
    SJ.stream_query_cache(spark, src, cache_path, cap=5, max_files_per_trigger=1, hits_log=hits)
    batch = {r.event_id: r.hit for r in cache.cache_admission(log, "key", "event_id", cap=5).collect()}
    streamed = {r.event_id: r.hit for r in spark.read.parquet(hits).collect()}
    assert streamed == batch
    admitted = {r.key for r in cache.cache_admission(log, "key", "event_id", cap=5).filter("admitted").collect()}
    assert {r.query for r in spark.read.parquet(cache_path).collect()} == admitted
