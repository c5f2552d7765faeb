"""End-to-end jobs (C1-C6) as DataFrame plans.

Every job is a function of DataFrames; the catalog (``plans/catalog.py``) binds
them to the driver tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import cache as cache_ops
from quarry.operators import chunking, dedup, embed, ids, search
from quarry.session import checkpoint_root

RECORD_META = ("file", "url", "title", "meta_description")


def documents_as_records(docs: DataFrame) -> DataFrame:
    """Driver ``documents`` as page records: the text is the record's ``content``."""
    return docs.select(
        "doc_id",
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".json")).alias("file"),
        F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("title"),
        F.lit(None).cast("string").alias("meta_description"),
        F.col("text").alias("raw_text"),
    )


def prepare_text(records: DataFrame, raw: str = "raw_text") -> tuple[DataFrame, DataFrame]:
    """F6 + F7: clean, then split into (kept, skipped)."""
    cleaned = records.withColumn("clean_text", T.clean_text(F.coalesce(F.col(raw), F.lit(""))))
    kept = cleaned.filter(F.col("clean_text") != "")
    skipped = cleaned.filter(F.col("clean_text") == "")
    return kept, skipped


def skip_report(records: DataFrame, raw: str = "raw_text") -> DataFrame:
    """F7 report: one row with the kept and skipped record counts."""
    c = T.clean_text(F.coalesce(F.col(raw), F.lit("")))
    return records.agg(
        F.count(F.when(c != "", 1)).alias("kept"),
        F.count(F.when(c == "", 1)).alias("skipped"),
    )


def word_chunks(records: DataFrame, max_words: int = 150, overlap: int = 10) -> DataFrame:
    """F5-F7 + G1 on page records; chunk texts stripped and non-empty."""
    keys = ["doc_id", *[c for c in RECORD_META if c in records.columns]]
    # windows of non-empty words are already stripped and non-empty, and an
    # empty text yields no window, so no extra filter is needed here
    cleaned = records.withColumn("clean_text", T.clean_text(F.coalesce(F.col("raw_text"), F.lit(""))))
    return chunking.chunk_words(cleaned, "clean_text", keys, max_words, overlap)


def sentence_chunks(records: DataFrame, limit: int = 512) -> DataFrame:
    """F5-F7 + G2-G4 on page records."""
    keys = ["doc_id", *[c for c in RECORD_META if c in records.columns]]
    cleaned = records.withColumn("clean_text", T.clean_text(F.coalesce(F.col("raw_text"), F.lit(""))))
    return chunking.chunk_sentences(cleaned, "clean_text", keys, limit)


def finish_chunks(chunks: DataFrame, start: int | Column = 0, with_embedding: bool = True,
                  dim: int = embed.DEFAULT_DIM, embedder=None, existing: DataFrame | None = None) -> DataFrame:
    """A1 -> J1 -> W1 -> F8 (-> E1/E2): dedup, chunks not in ``existing``, dense ids, tags, embeddings."""
    with_ids = dedup.dedup_with_ids(chunks, "chunk_text", ("doc_id", "chunk_pos"), start, existing=existing)
    tagged = with_ids.withColumn("tags", T.infer_tags(F.col("chunk_text")))
    if not with_embedding:
        return tagged
    return embed.embed_text(tagged, "chunk_text", "embedding", dim, embedder).withColumn(
        "model_id", F.lit(embed.model_id(embedder, dim)))


def ingest_rebuild(records: DataFrame, max_words: int = 150, overlap: int = 10,
                   with_embedding: bool = True, embedder=None) -> DataFrame:
    """Full rebuild: word windows, first-seen dedup, ids from 0, tags, vectors."""
    return finish_chunks(word_chunks(records, max_words, overlap), 0, with_embedding, embedder=embedder)


def ingest_incremental(records: DataFrame, existing: DataFrame | None, limit: int = 512,
                       with_embedding: bool = True, embedder=None) -> DataFrame:
    """Sentence chunks, first-seen dedup, minus hashes already stored (J1),
    ids continuing after the stored maximum (A2), tags, vectors.  Returns the
    new rows only; running it again on the union adds nothing."""
    start = int(existing.agg(ids.next_id(existing)).first()[0]) if existing is not None else 0
    return finish_chunks(sentence_chunks(records, limit), start, with_embedding, embedder=embedder,
                         existing=None if existing is None else existing.select("chunk_hash"))


def query_vectors(queries: DataFrame, qid: str, text: str, dim: int = embed.DEFAULT_DIM, embedder=None,
                  cache: DataFrame | None = None) -> DataFrame:
    """J3 (with a ``cache`` of ``query, embedding``) and E1 for a table of query texts -> ``(qid, qvec)``."""
    q = queries.select(F.col(qid).alias("qid"), F.coalesce(F.col(text), F.lit("")).alias("qtext"))
    if cache is not None:
        found = cache_ops.cache_lookup(q.withColumnRenamed("qtext", "query"), cache, "query", dim=dim, embedder=embedder)
        return found.select("qid", "qvec")
    return embed.embed_text(q, "qtext", "qvec", dim, embedder).select("qid", "qvec")


def search_topk(queries: DataFrame, store: DataFrame, k: int = 10, n: int = 4,
                qid: str = "qid", text: str = "qtext", carry: Sequence[str] = ("doc_id",), embedder=None,
                cache: DataFrame | None = None) -> DataFrame:
    """C4: J3/E1 -> T1 -> J2 -> T2 for a table of queries."""
    qv = query_vectors(queries, qid, text, embedder=embedder, cache=cache)
    hits = search.topk_inner_product(qv, store, k=k, carry=list(carry), model_id=embed.model_id(embedder))
    return search.retrieve_best(hits, n)


def search_mmr(queries: DataFrame, store: DataFrame, k: int = 10, rerank_k: int = 4, lambda_param: float = 0.5,
               qid: str = "qid", text: str = "qtext", qvecs: DataFrame | None = None, embedder=None,
               cache: DataFrame | None = None) -> DataFrame:
    """E1 -> T1 (k candidates, carrying their vectors and texts) -> query
    cosine -> T3 MMR picks ``rerank_k``.  Returns ``qid, pick, rank, id, chunk_text``."""
    from quarry.operators import rerank

    qv = qvecs if qvecs is not None else query_vectors(queries, qid, text, embedder=embedder, cache=cache)
    # the query vectors are read twice (search, query cosine): keep them
    # instead of running the embedder again
    checkpoint_root(store.sparkSession)
    qv = qv.checkpoint()
    hits = search.topk_inner_product(qv, store, k=k, carry=["embedding", "chunk_text"],
                                     model_id=embed.model_id(embedder))
    return rerank.mmr_select(hits, qv, rerank_k, lambda_param, carry=["chunk_text"])


def rag_prompts(requests: DataFrame, store: DataFrame, key: Sequence[str] = ("request_id",), prompt: str = "prompt",
                k: int = 10, rerank_k: int = 4, lambda_param: float = 0.5, embedder=None,
                cache: DataFrame | None = None) -> DataFrame:
    """F11 -> F9 (short-circuit) -> C5 -> F10 -> A6 -> F12 for a table of
    requests.  Returns ``key..., kind in {error, intent, prompt}, text``.

    The intent and empty-prompt checks run before retrieval, so only the
    remaining requests are embedded and scored."""
    from quarry.operators import dialog

    key = list(key)
    v = dialog.validate_prompts(requests.select(*key, prompt), prompt)
    it = T.detect_intent(F.col("prompt_clean"))
    v = v.withColumn("_intent", it["response"])
    errors = v.filter(F.col("status") == "error").select(*key, F.lit("error").alias("kind"), F.col("error").alias("text"))
    intents = v.filter((F.col("status") == "ok") & F.col("_intent").isNotNull()).select(
        *key, F.lit("intent").alias("kind"), F.col("_intent").alias("text"))
    # dense ids name the requests, whatever their keys are (of any type, null or repeated)
    ask = v.filter((F.col("status") == "ok") & F.col("_intent").isNull()).select(*key, "prompt_clean").withColumn(
        "_row", F.monotonically_increasing_id())
    ask = ids.assign_ids(ask, ["_row"], 0, "qid").select(*key, "qid", "prompt_clean")
    qv = query_vectors(ask, "qid", "prompt_clean", embedder=embedder, cache=cache)
    picks = search_mmr(None, store, k, rerank_k, lambda_param, qvecs=qv, embedder=embedder)
    ctx = dialog.context_concat(
        picks.select("qid", F.col("pick").alias("rank"), T.clean_qa_lines("chunk_text").alias("chunk_text")))
    prompts = ask.join(ctx, "qid", "left").select(
        *key, F.lit("prompt").alias("kind"),
        T.build_prompt(F.coalesce(F.col("context"), F.lit("")), F.col("prompt_clean")).alias("text"))
    return errors.unionByName(intents).unionByName(prompts)


def records_from_page_json(pages: DataFrame) -> DataFrame:
    """Page-record JSON rows (``read_page_json``) -> ingest records.

    Unparsable files are dropped (callers count ``ok = false`` as skipped).
    Every record is a source of its own, numbered in the order (full path,
    place in the file) with the same range-partitioned numbering as chunk ids:
    files with several records and equal names below different folders stay
    apart."""
    place = ["path", "block"] if {"path", "block"} <= set(pages.columns) else ["file"]
    rec = pages.filter(F.col("ok")).select(
        *place, *(["file"] if "file" not in place else []), F.monotonically_increasing_id().alias("_row"),
        "url", "title", F.col("meta.description").alias("meta_description"),
        T.select_text_source(F.col("article_texts"), F.col("text_lines"), F.col("content")).alias("raw_text"),
    )
    numbered = ids.assign_ids(rec, [*place, "_row"], 0, "doc_id")
    return numbered.select("doc_id", "file", "url", "title", "meta_description", "raw_text")
