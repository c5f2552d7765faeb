"""Every registered query against its SQL oracle on the smallest tables."""

import math

import pytest

import __spark_entry__ as E

FAST = ["clean_text", "chunk_words", "dedup_exact", "assign_ids", "embed_text", "topk_inner_product",
        "search_topk", "page_text_lines", "page_links_abs", "extract_pages", "extract_pages_pdf", "link_allowed_start", "stream_cache_log", "crawl_reach", "chunk_sentences",
        "detect_intent", "take_while_session", "cache_admission", "mmr_rerank", "ingest_incremental"]


def _norm(v):
    if isinstance(v, float):
        return round(v, 6) if not math.isnan(v) else "nan"
    return v


def _rows(cols, recs):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(_norm(r[i]) for i in order) for r in recs), key=repr)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, duck, name):
    from conftest import SF_SMALL

    df = E.queries()[name](spark, SF_SMALL)
    res = duck.execute(E.oracle_sql()[name])
    o_cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(o_cols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(o_cols, res.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "score" in df.columns


def test_every_query_has_oracle_or_is_listed():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
