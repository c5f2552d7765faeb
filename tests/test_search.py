"""Top-k, MMR and id invariants."""

import numpy as np
from pyspark.sql import functions as F

from quarry.operators import ids, rerank, search


def _vecs(spark, n, dim, seed):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, dim))
    m[3] = m[5]  # equal scores: ties broken by the smaller id
    m[7] = 0  # zero vector
    return spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(m)], "id long, embedding array<double>"), m


def test_topk_matches_numpy(spark):
    corpus, m = _vecs(spark, 60, 8, 1)
    q = np.random.default_rng(2).normal(size=(5, 8))
    qdf = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(q)], "qid long, qvec array<double>")
    got = search.topk_inner_product(qdf, corpus.repartition(4), k=10, query_block=3).collect()
    for qi in range(5):
        keys = np.floor(m @ q[qi] * 1e6 + 0.5)
        order = sorted(range(60), key=lambda i: (-keys[i], i))[:10]
        mine = [r.id for r in sorted((r for r in got if r.qid == qi), key=lambda r: r.rank)]
        assert mine == order


def test_fewer_than_k(spark):
    corpus, _ = _vecs(spark, 60, 8, 1)
    small = corpus.limit(3)
    qdf = spark.createDataFrame([(0, [1.0] * 8)], "qid long, qvec array<double>")
    assert search.topk_inner_product(qdf, small, k=10).count() == 3


def test_mmr_lambda_one_is_topk(spark):
    corpus, m = _vecs(spark, 40, 6, 3)
    qdf = spark.createDataFrame([(0, [1.0, 0.5, 0.0, 0.0, 0.0, 0.0])], "qid long, qvec array<double>")
    hits = search.topk_inner_product(qdf, corpus, k=10, carry=["embedding"])
    cands = rerank.with_query_similarity(hits, qdf)
    picks = rerank.mmr_rerank(cands, k=4, lambda_param=1.0).orderBy("pick").collect()
    by_sim = cands.orderBy(F.col("sim").desc(), "rank").limit(4).collect()
    assert [p.id for p in picks] == [c.id for c in by_sim]


def test_assign_ids_dense(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 % 5003).alias("k")).repartition(7)
    out = ids.assign_ids(df, ["k"], start=100)
    rows = out.orderBy("k").collect()
    assert [r.id for r in rows] == list(range(100, 100 + len(rows)))


def test_assign_ids_tiny_inputs(spark):
    # regression: tiny inputs once lost rows when AQE coalesced the range exchange
    for n in (1, 2, 3, 17):
        df = spark.range(0, n).select(((F.col("id") * 7919) % 100003).alias("k"))
        assert sorted(r.id for r in ids.assign_ids(df, ["k"], 5).collect()) == list(range(5, 5 + n))


def test_mmr_numpy_matches_jvm_fold(spark):
    corpus, m = _vecs(spark, 80, 6, 5)
    rng = np.random.default_rng(9)
    q = rng.normal(size=(6, 6))
    qdf = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(q)], "qid long, qvec array<double>")
    hits = search.topk_inner_product(qdf, corpus, k=10, carry=["embedding"])
    for lam in (0.5, 0.2, 1.0):
        a = rerank.mmr_select(hits, qdf, k=4, lambda_param=lam).collect()
        b = rerank.mmr_rerank(rerank.with_query_similarity(hits, qdf), k=4, lambda_param=lam).collect()
        key = lambda r: (r.qid, r.pick)
        assert [(r.qid, r.pick, r.id) for r in sorted(a, key=key)] == [(r.qid, r.pick, r.id) for r in sorted(b, key=key)]


def test_store_refuses_other_model(spark):
    import pytest
    from pyspark.errors import PySparkException
    from py4j.protocol import Py4JJavaError

    from quarry.plans import jobs

    docs = spark.createDataFrame([(1, "alpha beta gamma. delta."), (2, "beta gamma")], "doc_id long, text string")
    store = jobs.ingest_rebuild(jobs.documents_as_records(docs))
    assert {r.model_id for r in store.collect()} == {"hashing-md5-384"}
    q = spark.createDataFrame([(1, "beta")], "qid long, qtext string")
    assert jobs.search_topk(q, store, k=2, n=2).count() == 2

    def other(texts):
        return np.ones((len(texts), 384))

    other.model_id = "another-model"
    with pytest.raises((PySparkException, Py4JJavaError)) as err:
        jobs.search_topk(q, store, k=2, n=2, embedder=other).collect()
    assert "another model" in str(err.value)


def test_queries_that_do_not_fit_meet_in_cells(spark, monkeypatch):
    """The joined form gives what the broadcast form gives; neither shuffles the corpus more than once."""
    import numpy as np
    from pyspark.sql import functions as F

    from quarry.operators import search as SR

    rng = np.random.default_rng(4)
    vecs = rng.integers(-3, 4, size=(400, 6)).astype(float)  # many ties
    corpus = spark.createDataFrame([(int(i), v.tolist() if i % 50 else v.tolist()[:4]) for i, v in enumerate(vecs)], "id long, embedding array<double>").repartition(5)
    queries = spark.createDataFrame([(int(i), vecs[i].tolist()) for i in range(0, 400, 3)] + [(1000, None)], "qid long, qvec array<double>")
    monkeypatch.setattr(SR, "CORPUS_BLOCK", 37)
    monkeypatch.setattr(SR, "CELL_BLOCKS", 2)
    monkeypatch.setattr(SR, "SCORES", 5000)
    scans = SR.topk_inner_product(queries, corpus, k=7)
    joined = SR.topk_inner_product(queries, corpus, k=7, query_block=20, broadcast_bytes=0)
    want = {}
    full = vecs.copy()
    full[::50, 4:] = 0
    for q in range(0, 400, 3):
        keys = np.floor(full @ vecs[q] * 1e6 + 0.5)
        want[q] = sorted(range(400), key=lambda i: (-keys[i], i))[:7]
    for out in (scans, joined):
        got = {}
        for r in out.orderBy("qid", "rank").collect():
            got.setdefault(r["qid"], []).append(r["id"])
        assert got == want
    a, b = (sorted(map(tuple, SR.score_summary(queries, corpus, broadcast_bytes=n).collect())) for n in (1 << 20, 0))
    assert a == b and all(r[1] == 400 for r in a)


def test_no_corpus_vector_is_shuffled(spark):
    """Up to 10,000 queries of 384 numbers: the corpus is scored where it is read."""
    import re

    from quarry.operators import search as SR

    assert 10_000 * 384 * 8 <= SR.BROADCAST_BYTES
    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, embedding array<double>")
    queries = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "qid long, qvec array<double>")
    plan = SR.topk_inner_product(queries, corpus, k=3)._jdf.queryExecution().executedPlan().toString()
    below = plan[re.search(r"Exchange", plan).start():]
    assert len(re.findall("Exchange", plan)) == 1 and "MapInArrow" in below
    assert "embedding" not in re.search(r"Exchange [^\n]*", plan).group()


def test_empty_corpus_and_no_queries(spark):
    from quarry.operators import search as SR

    corpus = spark.createDataFrame([(1, [1.0])], "id long, embedding array<double>")
    queries = spark.createDataFrame([(1, [1.0])], "qid long, qvec array<double>")
    for size in (0, 1 << 20):
        assert SR.topk_inner_product(queries, corpus.where("id < 0"), broadcast_bytes=size).count() == 0
        assert SR.topk_inner_product(queries.where("qid < 0"), corpus, broadcast_bytes=size).count() == 0
        assert SR.topk_inner_product(queries, corpus, broadcast_bytes=size).count() == 1


def test_close_scores_do_not_depend_on_32_bits(spark):
    """Scores that 32-bit floats can't tell apart, and numbers that they can't hold, rank as with 64 bits; few keys leave a task."""
    from quarry.operators import search as SR

    rng = np.random.default_rng(8)
    vecs = np.tile(rng.normal(size=12), (900, 1)) + rng.normal(size=(900, 12)) * 1e-7
    for scale in (1.0, 1e20):
        rows = vecs * scale
        corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "id long, embedding array<double>").repartition(3)
        q = rng.normal(size=(30, 12)) * (1.0 if scale == 1.0 else 1e-20)
        queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, qvec array<double>")
        keys = np.floor(np.einsum("ij,kj->ik", q, rows) * 1e6 + 0.5)
        want = {i: keys[i, np.lexsort((np.arange(900), -keys[i]))[:5]].tolist() for i in range(30)}
        for size in (1 << 20, 0):
            got = {i: [] for i in range(30)}
            for r in SR.topk_inner_product(queries, corpus, k=5, broadcast_bytes=size).orderBy("qid", "rank").collect():
                got[r["qid"]].append(r["score_key"])
            assert got == want
            ends = {r["qid"]: (r["n_scored"], r["max_score"], r["min_score"]) for r in SR.score_summary(queries, corpus, broadcast_bytes=size).collect()}
            assert ends == {i: (900, keys[i].max() / 1e6, keys[i].min() / 1e6) for i in range(30)}


def test_cells_reach_tasks_row_by_row(spark):
    """A task gets vectors, not pairs of blocks: the batches that it holds don't grow with the queries."""
    from quarry.operators import search as SR

    corpus = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "id long, embedding array<float>")
    queries = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(5)], "qid long, qvec array<float>")
    met = SR._met(queries, corpus, "id", "embedding")
    assert met.schema["vec"].dataType.simpleString() == "array<float>" and met.where("query").groupBy("cell").count().distinct().count() == 1
