"""Store identity, request keys, crawl depth, stream replays: rows that ids and markers must not decide."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import dedup, links
from quarry.plans import jobs
from quarry.session import checkpoint_root, scratch_path
from quarry.sources import readers
from quarry.streaming import jobs as SJ


def _records(spark, rows):
    return jobs.documents_as_records(spark.createDataFrame(rows, "doc_id long, text string"))


def test_any_doc_ids_give_unique_store_ids(spark):
    rows = [(2**40, "alpha beta"), (2**40 + 1, "gamma"), (2**62, "delta"), (7, "epsilon"), (7, "zeta"), (7, "epsilon"), (None, "eta"), (None, "eta"), (-1, "gamma")]
    st = jobs.ingest_rebuild(_records(spark, rows)).select("id", "doc_id", "chunk_text").collect()
    assert sorted(r.id for r in st) == list(range(6))
    assert sorted(r.chunk_text for r in st) == ["alpha beta", "delta", "epsilon", "eta", "gamma", "zeta"]
    assert {r.doc_id for r in st if r.chunk_text in ("gamma", "eta")} == {-1, None}


def test_records_of_one_file_and_equal_names_stay_apart(spark):
    folder = scratch_path(spark, "t-pages")
    page = lambda i: (f"http://h.example.com/{i}", f"Title {i}", [f"text of page {i}"])
    for part, ids in (("a", (1, 2, 3)), ("b", (4, 5, 6))):
        df = spark.createDataFrame([page(i) for i in ids], "url string, title string, text_lines array<string>")
        df.coalesce(1).write.json(f"{folder}/{part}")
    rec = jobs.records_from_page_json(readers.read_page_json(spark, folder, multi_line=False))
    st = jobs.ingest_rebuild(rec).collect()
    assert sorted(r.id for r in st) == list(range(6))
    assert {(r.url, r.title, r.chunk_text) for r in st} == {(f"http://h.example.com/{i}", f"Title {i}", f"text of page {i}") for i in range(1, 7)}


def test_last_write_wins_keeps_one_of_ties(spark):
    df = spark.createDataFrame([("k", 3, "a"), ("k", 3, "b"), ("k", 1, "c"), ("m", 1, None)], "key string, at int, v string")
    assert sorted(map(tuple, dedup.last_write_wins(df, ["key"], "at").collect())) == [("k", 3, "b"), ("m", 1, None)]


@pytest.mark.parametrize("keys", [[(0, 100000), (1, 0)], [("a/b", "c"), ("a", "b/c")], [(5, None), (None, 5)]])
def test_requests_keep_their_own_context(spark, keys):
    st = jobs.ingest_rebuild(_records(spark, [(1, "apples grow on trees"), (2, "boats sail on lakes")])).checkpoint()
    kind = "string" if isinstance(keys[0][0], str) else "long"
    req = spark.createDataFrame([(*keys[0], "apples trees"), (*keys[1], "boats lakes")], f"k1 {kind}, k2 {kind}, prompt string")
    out = {(r.k1, r.k2): r.text for r in jobs.rag_prompts(req, st, key=("k1", "k2"), k=1, rerank_k=1).collect()}
    assert "apples grow" in out[keys[0]] and "boats sail" not in out[keys[0]]
    assert "boats sail" in out[keys[1]] and "apples grow" not in out[keys[1]]


def test_crawl_has_no_depth_cap_and_drops_fragments(spark):
    n = 25
    pages = spark.createDataFrame(
        [(f"http://h.example.com/{i}", f'<a href="/{i + 1}#x">n</a><a href="http://sub.example.org/">o</a>') for i in range(n)], "url string, html string")
    edges = links.follow_filter(links.page_edges(pages), domains=["example.com"])
    starts = spark.createDataFrame([("http://h.example.com/0#top",)], "u string")
    assert {r.url: r.depth for r in links.crawl_reach(edges, pages, starts).collect()} == {f"http://h.example.com/{i}": i for i in range(n)}
    assert {r.dst_url for r in links.link_frontier(edges, pages).collect()} == {f"http://h.example.com/{n}"}
    assert links.follow_filter(links.page_edges(pages), domains=["example.org"]).count() == 0


def test_stream_ingest_needs_no_markers(spark):
    src, store = scratch_path(spark, "t-src"), scratch_path(spark, "t-store")
    spark.createDataFrame([(1, "One text."), (2, "Two texts.")], "doc_id long, text string").write.json(src)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    try:
        for k in range(2):
            SJ.stream_ingest(spark, src, store, scratch_path(spark, f"t-ckpt{k}"))
    finally:
        conf.unset("mapreduce.fileoutputcommitter.marksuccessfuljobs")
    rows = spark.read.parquet(store).collect()
    assert sorted(r.id for r in rows) == [0, 1] and all(len(r.embedding) == 384 for r in rows)


def test_requests_delivered_again_are_logged_once(spark):
    src, cache, hits = (scratch_path(spark, f"t-{x}") for x in ("req", "cache", "hits"))
    log = spark.createDataFrame([(-1, "a"), (0, "b"), (1, "a"), (2, "c")], "event_id long, key string")
    log.coalesce(1).write.parquet(src)
    for k in range(2):
        SJ.stream_query_cache(spark, src, cache, scratch_path(spark, f"t-qckpt{k}"), cap=None, hits_log=hits)
    assert sorted((r.event_id, r.hit) for r in spark.read.parquet(hits).collect()) == [(-1, False), (0, False), (1, True), (2, False)]
    assert spark.read.parquet(cache).count() == 3


def test_a_replayed_epoch_overwrites_what_it_wrote(spark):
    """The cache write of an epoch went through, its log write didn't: the replay starts the epoch anew."""
    src, cache, hits, ckpt = (scratch_path(spark, f"t-{x}") for x in ("req", "cache", "hits", "ckpt"))
    log = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "event_id long, key string")
    log.coalesce(1).write.parquet(src)
    run = SJ._run_name(ckpt)
    spark.createDataFrame([("a", 1, [0.0])], "query string, first_arrival long, embedding array<float>").write.parquet(SJ._epoch(cache, run, 0))
    SJ.stream_query_cache(spark, src, cache, ckpt, cap=10, hits_log=hits)
    assert sorted((r.event_id, r.hit) for r in spark.read.parquet(hits).collect()) == [(1, False), (2, True), (3, False)]
    assert sorted(r.query for r in spark.read.parquet(cache).collect()) == ["a", "b"]


def test_checkpoint_folder_is_never_local_on_a_cluster(spark):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": staticmethod(lambda k, d=None: None)})

    with pytest.raises(ValueError, match="checkpoint"):
        checkpoint_root(Session())


def test_pdf_pages_are_not_parsed_as_html(spark):
    from quarry.plans.pages import extract_pages

    pages = spark.createDataFrame([(1, "http://h.example.com/a.pdf", '<a href="/x">bytes</a>'), (2, "http://h.example.com/b", '<a href="/y">b</a>')], "page_id long, url string, html string")
    content = spark.createDataFrame([("http://h.example.com/a.pdf", "Line one\nLine two")], "url string, content string")
    out = {r.page_id: r for r in extract_pages(pages, pdf_content=content).collect()}
    assert not out[1].links and (out[1].type, out[1].content) == ("pdf", "Line one\nLine two")
    assert out[2].links == ["http://h.example.com/y"] and out[2].type is None and out[2].content is None


def test_cached_queries_give_the_same_hits(spark):
    from quarry.operators import embed

    st = jobs.ingest_rebuild(_records(spark, [(i, f"word{i} word{i + 1} common") for i in range(12)])).checkpoint()
    qs = spark.createDataFrame([(i, f"word{2 * i}") for i in range(6)] + [(6, None)], "qid long, qtext string")
    cache = embed.embed_text(qs.where("qid < 3").select(F.col("qtext").alias("query")), "query", "embedding")
    rows = [sorted(map(tuple, jobs.search_topk(qs, st, k=3, n=2, cache=c).collect())) for c in (None, cache)]
    assert rows[0] == rows[1] and len(rows[0]) == 14
