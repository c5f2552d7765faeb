"""Query catalog: one Spark plan and one DuckDB oracle per operator key.

``QUERIES[name](spark, sf_dir) -> DataFrame`` reads the driver tables (plus
literal fixture rows where the tables lack a case) and runs the operator over
whole tables.  ``ORACLE[name]`` is the same computation restated in SQL.
Arrays are emitted as joined strings and integers as bigint so both engines
produce the same schema; scores are compared as rounded doubles.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.functions import text as T
from quarry.functions import urls as U
from quarry.functions import vectors as V
from quarry.operators import audit, chunking, dedup, embed, ids, search
from quarry.operators import cache as CA
from quarry.operators import dialog as D
from quarry.operators import links as L
from quarry.operators import rerank as RR
from quarry.operators import sentences as SE
from quarry.operators import subwords as SW
from quarry.plans import fixtures as FX
from quarry.plans import jobs
from quarry.plans import pages as PG
from quarry.plans import sqltext as S
from quarry.session import scratch_path, table
from quarry.sources import readers as RD
from quarry.sources import versions as VS
from quarry.sources import writers as WR
from quarry.streaming import jobs as SJ

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn

    return deco


def _vec(c="embedding"):
    """A vector as text: the non-zero components, index:millionths."""
    parts = F.transform(c, lambda x, i: F.when(x != 0, F.concat_ws(":", i.cast("string"), F.floor(x.cast("double") * 1e6 + 0.5).cast("string"))))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), ",")


def _vec_sql(key: str, rows: str) -> str:
    """``(key, vec)`` of rows (key, bucket, w) of a sparse embedding."""
    return f"(SELECT {key}, string_agg(bucket || ':' || CAST(floor(w * 1e6 + 0.5) AS BIGINT), ',' ORDER BY bucket) AS vec FROM {rows} GROUP BY 1)"


def _r6(c):
    return F.round(c.cast("double"), 6)


# ---------------------------------------------------------------- shared SQL
MAXW, OVERLAP = 150, 10
STEP = MAXW - OVERLAP

SQL_WORD_CHUNKS = f"""
word_docs AS (
  SELECT doc_id, {S.words(S.clean('text'))} AS w FROM documents WHERE {S.clean('text')} <> ''
), word_chunks AS (
  SELECT doc_id, CAST(s // {STEP} AS BIGINT) AS chunk_pos,
         array_to_string(w[s + 1 : s + {MAXW}], ' ') AS chunk_text
  FROM (SELECT doc_id, w, unnest(range(0, len(w), {STEP})) AS s FROM word_docs)
), first_chunks AS (
  SELECT *, md5(chunk_text) AS chunk_hash FROM word_chunks
  QUALIFY row_number() OVER (PARTITION BY md5(chunk_text) ORDER BY doc_id, chunk_pos) = 1
), store AS (
  SELECT CAST(row_number() OVER (ORDER BY doc_id, chunk_pos) - 1 AS BIGINT) AS id, * FROM first_chunks
)"""


def _store(spark: SparkSession, sf: str, with_embedding: bool = True) -> DataFrame:
    recs = jobs.documents_as_records(table(spark, sf, "documents"))
    return jobs.ingest_rebuild(recs, MAXW, OVERLAP, with_embedding=with_embedding)


# ---------------------------------------------------------------- sources
@register("scan_raw_pages", "SELECT page_id, url, html FROM pages")
def q_scan_raw_pages(spark, sf):
    return RD.read_pages(spark, f"{sf}/pages.parquet")


@register(
    "scan_vectors",
    """SELECT vec_id AS id, CAST(len(embedding) AS BIGINT) AS dims,
       round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS sq_norm
       FROM embeddings""",
)
def q_scan_vectors(spark, sf):
    v = RD.read_vectors(spark, f"{sf}/embeddings.parquet", id_col="vec_id")
    return v.select("id", F.size("embedding").cast("long").alias("dims"),
                    _r6(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("sq_norm"))


# ---------------------------------------------------------------- text
@register("clean_text", f"SELECT doc_id, {S.clean('text')} AS clean_text FROM documents")
def q_clean_text(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_text("text").alias("clean_text"))


@register(
    "skip_empty_docs",
    f"""SELECT CAST(count(*) FILTER (WHERE c <> '') AS BIGINT) AS kept,
              CAST(count(*) FILTER (WHERE c = '') AS BIGINT) AS skipped
       FROM (SELECT {S.clean("coalesce(text, '')")} AS c FROM
             (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {FX.BLANK_DOCS.sql()}))""",
)
def q_skip_empty_docs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(FX.BLANK_DOCS.df(spark))
    return jobs.skip_report(docs.withColumnRenamed("text", "raw_text"))


@register(
    "infer_tags",
    f"""SELECT doc_id, {S.tags('text')} AS tags FROM
        (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM {FX.TAG_TEXTS.sql()})""",
)
def q_infer_tags(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text").unionByName(FX.TAG_TEXTS.df(spark))
    return docs.select("doc_id", F.array_join(T.infer_tags("text"), ",").alias("tags"))


# ---------------------------------------------------------------- chunking
@register("chunk_words", f"WITH {SQL_WORD_CHUNKS.strip()} SELECT doc_id, chunk_pos, chunk_text FROM word_chunks")
def q_chunk_words(spark, sf):
    recs = jobs.documents_as_records(table(spark, sf, "documents"))
    return jobs.word_chunks(recs, MAXW, OVERLAP).select("doc_id", F.col("chunk_pos").cast("long"), "chunk_text")


# ---------------------------------------------------------------- dedup / ids
@register("dedup_exact", f"WITH {SQL_WORD_CHUNKS.strip()} SELECT doc_id, chunk_pos, chunk_hash FROM first_chunks")
def q_dedup_exact(spark, sf):
    recs = jobs.documents_as_records(table(spark, sf, "documents"))
    ch = jobs.word_chunks(recs, MAXW, OVERLAP)
    return dedup.dedup_exact(ch).select("doc_id", F.col("chunk_pos").cast("long"), "chunk_hash")


@register("assign_ids", f"WITH {SQL_WORD_CHUNKS.strip()} SELECT id, doc_id, chunk_pos FROM store")
def q_assign_ids(spark, sf):
    recs = jobs.documents_as_records(table(spark, sf, "documents"))
    d = dedup.dedup_exact(jobs.word_chunks(recs, MAXW, OVERLAP)).select("doc_id", "chunk_pos")
    return ids.assign_ids(d, ["doc_id", "chunk_pos"], 0).select("id", "doc_id", F.col("chunk_pos").cast("long"))


@register(
    "next_id",
    """SELECT CAST(coalesce(max(vec_id) + 1, 0) AS BIGINT) AS next_id FROM embeddings
       UNION ALL SELECT CAST(coalesce(max(vec_id) + 1, 0) AS BIGINT) FROM embeddings WHERE vec_id < 0""",
)
def q_next_id(spark, sf):
    e = table(spark, sf, "embeddings")
    full = e.agg(ids.next_id(e, "vec_id").alias("next_id"))
    empty = e.filter(F.col("vec_id") < 0).agg(ids.next_id(e, "vec_id").alias("next_id"))
    return full.unionByName(empty)


# ---------------------------------------------------------------- embedding
@register(
    "embed_text",
    f"""WITH {S.sparse_embedding_cte('emb', 'documents', 'doc_id', 'text')}
        SELECT doc_id, bucket, round(w, 6) AS weight FROM emb""",
)
def q_embed_text(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    e = embed.embed_text(docs, "text", "embedding", keep_text=False)
    return e.select("doc_id", F.posexplode("embedding").alias("bucket", "w")).filter(F.col("w") != 0).select(
        "doc_id", F.col("bucket").cast("long"), _r6(F.col("w")).alias("weight")
    )


@register(
    "l2_normalize",
    """SELECT vec_id, CAST(i - 1 AS BIGINT) AS pos, round(CAST(embedding[i] AS DOUBLE) / n, 6) AS value
       FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i,
                    sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS n
             FROM embeddings)""",
)
def q_l2_normalize(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode(V.l2_normalize("embedding")).alias("pos", "value")).select(
        "vec_id", F.col("pos").cast("long"), _r6(F.col("value")).alias("value")
    )


@register(
    "cosine_similarity",
    """WITH anchors AS (SELECT label, min(vec_id) AS anchor FROM embeddings GROUP BY label),
       a AS (SELECT e.vec_id, e.embedding AS v, x.embedding AS u, x.vec_id AS anchor_id
             FROM embeddings e JOIN anchors USING (label) JOIN embeddings x ON x.vec_id = anchors.anchor),
       d AS (SELECT vec_id, anchor_id,
               list_sum(list_transform(range(1, len(v) + 1), lambda i: CAST(v[i] AS DOUBLE) * CAST(u[i] AS DOUBLE))) AS ip,
               sqrt(list_sum(list_transform(v, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nv,
               sqrt(list_sum(list_transform(u, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS nu FROM a)
       SELECT vec_id, anchor_id, round(CASE WHEN nv = 0 OR nu = 0 THEN 0 ELSE ip / (nv * nu) END, 6) AS cos FROM d""",
)
def q_cosine_similarity(spark, sf):
    e = table(spark, sf, "embeddings")
    anchors = e.groupBy("label").agg(F.min("vec_id").alias("anchor_id"))
    av = anchors.join(e.select(F.col("vec_id").alias("anchor_id"), F.col("embedding").alias("u")), "anchor_id")
    j = e.join(av, "label")
    return j.select("vec_id", "anchor_id", _r6(V.cosine_similarity("embedding", "u")).alias("cos"))


# ---------------------------------------------------------------- search
SQL_SELF_SCORES = """
scores AS (
  SELECT q.vec_id AS qid, c.vec_id AS id,
         CAST(floor(list_sum(list_transform(range(1, len(q.embedding) + 1),
              lambda i: CAST(q.embedding[i] AS DOUBLE) * CAST(c.embedding[i] AS DOUBLE))) * 1000000 + 0.5) AS BIGINT) AS k
  FROM embeddings q, embeddings c
), ranked AS (
  SELECT qid, id, k, row_number() OVER (PARTITION BY qid ORDER BY k DESC, id) AS rank FROM scores
)"""


def _self_queries(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), e.select(
        F.col("vec_id").alias("id"), "embedding"
    )


@register(
    "topk_inner_product",
    f"""WITH {SQL_SELF_SCORES.strip()}
        SELECT qid, CAST(rank AS BIGINT) AS rank, id, k / 1000000 AS score FROM ranked WHERE rank <= 10""",
)
def q_topk_inner_product(spark, sf):
    qv, corpus = _self_queries(spark, sf)
    hits = search.topk_inner_product(qv, corpus, k=10)
    return hits.select("qid", F.col("rank").cast("long"), "id", "score")


@register(
    "similarity_cross",
    f"""WITH {SQL_SELF_SCORES.strip()}
        SELECT qid, CAST(count(*) AS BIGINT) AS n_scored, max(k) / 1000000 AS max_score, min(k) / 1000000 AS min_score
        FROM scores GROUP BY qid""",
)
def q_similarity_cross(spark, sf):
    qv, corpus = _self_queries(spark, sf)
    return search.score_summary(qv, corpus)


SQL_DOC_SEARCH = f"""
{SQL_WORD_CHUNKS.strip()},
{S.sparse_embedding_cte('cemb', 'store', 'id', 'chunk_text')},
{S.sparse_embedding_cte('qemb', 'benchmark', 'item_id', 'text')},
doc_dots AS (
  SELECT qemb.item_id AS qid, cemb.id, sum(qemb.w * cemb.w) AS ip FROM qemb JOIN cemb USING (bucket) GROUP BY 1, 2
), doc_scores AS (
  SELECT q.item_id AS qid, s.id, CAST(floor(coalesce(d.ip, 0) * 1000000 + 0.5) AS BIGINT) AS k
  FROM benchmark q CROSS JOIN store s LEFT JOIN doc_dots d ON d.qid = q.item_id AND d.id = s.id
), doc_ranked AS (
  SELECT qid, id, k, row_number() OVER (PARTITION BY qid ORDER BY k DESC, id) AS rank FROM doc_scores
), doc_hits AS (
  SELECT * FROM doc_ranked WHERE rank <= 10
)"""


def _doc_hits(spark, sf, k=10, carry=()):
    store = _store(spark, sf)
    qv = jobs.query_vectors(table(spark, sf, "benchmark"), "item_id", "text")
    return store, search.topk_inner_product(qv, store, k=k, carry=list(carry))


@register(
    "hits_with_metadata",
    f"""WITH {SQL_DOC_SEARCH.strip()}
        SELECT h.qid, CAST(h.rank AS BIGINT) AS rank, h.id, s.doc_id, CAST(s.chunk_pos AS BIGINT) AS chunk_pos, s.chunk_hash
        FROM doc_hits h JOIN store s USING (id)""",
)
def q_hits_with_metadata(spark, sf):
    store, hits = _doc_hits(spark, sf)
    meta = store.select("id", "doc_id", "chunk_pos", "chunk_hash")
    j = search.hits_with_metadata(hits.select("qid", "rank", "id"), meta)
    return j.select("qid", F.col("rank").cast("long"), "id", "doc_id", F.col("chunk_pos").cast("long"), "chunk_hash")


@register(
    "retrieve_best",
    f"""WITH {SQL_DOC_SEARCH.strip()}
        SELECT qid, CAST(rank AS BIGINT) AS rank, id, k / 1000000 AS score FROM doc_hits WHERE rank <= 4""",
)
def q_retrieve_best(spark, sf):
    _, hits = _doc_hits(spark, sf)
    return search.retrieve_best(hits, 4).select("qid", F.col("rank").cast("long"), "id", "score")


# ---------------------------------------------------------------- composite
@register(
    "ingest_rebuild",
    f"""WITH {SQL_WORD_CHUNKS.strip()}, {S.sparse_embedding_cte('semb', 'store', 'id', 'chunk_text')}
        SELECT id, doc_id, CAST(chunk_pos AS BIGINT) AS chunk_pos, chunk_hash, {S.tags('chunk_text')} AS tags, coalesce(vec, '') AS vec
        FROM store LEFT JOIN {_vec_sql('id', 'semb')} USING (id)""",
)
def q_ingest_rebuild(spark, sf):
    st = _store(spark, sf)
    return st.select("id", "doc_id", F.col("chunk_pos").cast("long"), "chunk_hash",
                     F.array_join("tags", ",").alias("tags"), _vec().alias("vec"))


@register(
    "search_topk",
    f"""WITH {SQL_DOC_SEARCH.strip()}
        SELECT h.qid, CAST(h.rank AS BIGINT) AS rank, h.id, s.doc_id, h.k / 1000000 AS score, s.chunk_text
        FROM doc_hits h JOIN store s USING (id) WHERE h.rank <= 4""",
)
def q_search_topk(spark, sf):
    store = _store(spark, sf)
    out = jobs.search_topk(table(spark, sf, "benchmark"), store, k=10, n=4, qid="item_id", text="text",
                           carry=("doc_id", "chunk_text"))
    return out.select("qid", F.col("rank").cast("long"), "id", "doc_id", "score", "chunk_text")


# ================================================================ pages

SQL_ALLPAGES = f"allpages AS (SELECT page_id, url, html FROM pages UNION ALL SELECT * FROM {FX.PAGES_EXTRA.sql()})"


def _allpages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", "html").unionByName(FX.PAGES_EXTRA.df(spark))


def _rows_sql(key_cols: str, list_expr: str, src: str, val: str) -> str:
    return (f"SELECT {key_cols}, CAST(unnest(range(len(l))) AS BIGINT) AS pos, unnest(l) AS {val} "
            f"FROM (SELECT {key_cols}, {list_expr} AS l FROM {src})")


def _explode(df, key_cols, arr, val):
    return df.select(*key_cols, F.posexplode(arr).alias("pos", val)).withColumn("pos", F.col("pos").cast("long"))


@register("page_title", f"WITH {SQL_ALLPAGES} SELECT page_id, {S.title('html')} AS title FROM allpages")
def q_page_title(spark, sf):
    return _allpages(spark, sf).select("page_id", H.page_title("html").alias("title"))


@register("page_meta_description",
          f"WITH {SQL_ALLPAGES} SELECT page_id, {S.meta('html', 'description')} AS description FROM allpages")
def q_page_meta_description(spark, sf):
    return _allpages(spark, sf).select("page_id", H.page_meta("html", "description").alias("description"))


@register("page_meta_keywords",
          f"WITH {SQL_ALLPAGES} SELECT page_id, {S.meta('html', 'keywords')} AS keywords FROM allpages")
def q_page_meta_keywords(spark, sf):
    return _allpages(spark, sf).select("page_id", H.page_meta("html", "keywords").alias("keywords"))


@register("page_text_lines", f"WITH {SQL_ALLPAGES} " + _rows_sql("page_id", S.element_text_lines(S.body("html")), "allpages", "line"))
def q_page_text_lines(spark, sf):
    return _explode(_allpages(spark, sf), ["page_id"], H.page_text_lines("html"), "line")


@register("page_text_clean",
          f"WITH {SQL_ALLPAGES} SELECT page_id, array_to_string({S.text_nodes(S.body('html'))}, chr(10)) AS text_clean FROM allpages")
def q_page_text_clean(spark, sf):
    return _allpages(spark, sf).select("page_id", H.page_text_clean("html").alias("text_clean"))


@register("page_desc_divs",
          f"WITH {SQL_ALLPAGES}, {S.element_texts_ctes('allpages', 'page_id', 'html', 'div', 'desc', 'dd')} "
          + _rows_sql("page_id", "texts", "dd", "text"))
def q_page_desc_divs(spark, sf):
    df = H.with_desc_divs(_allpages(spark, sf), "html", "desc_divs", "desc")
    return _explode(df, ["page_id"], "desc_divs", "text")


@register("page_desc_divs_ad",
          f"WITH {SQL_ALLPAGES}, {S.element_texts_ctes('allpages', 'page_id', 'html', 'div', 'ad', 'dd')} "
          + _rows_sql("page_id", "texts", "dd", "text"))
def q_page_desc_divs_ad(spark, sf):
    df = H.with_desc_divs(_allpages(spark, sf), "html", "desc_divs", "ad")
    return _explode(df, ["page_id"], "desc_divs", "text")


@register("page_article_texts",
          f"WITH {SQL_ALLPAGES}, {S.element_texts_ctes('allpages', 'page_id', 'html', 'article', None, 'ar')} "
          + _rows_sql("page_id", "texts", "ar", "text"))
def q_page_article_texts(spark, sf):
    df = H.with_article_texts(_allpages(spark, sf), "html", "article_texts")
    return _explode(df, ["page_id"], "article_texts", "text")


@register("page_links_raw", f"WITH {SQL_ALLPAGES} " + _rows_sql("page_id", S.attr_list("html", "a", "href"), "allpages", "href"))
def q_page_links_raw(spark, sf):
    return _explode(_allpages(spark, sf), ["page_id"], H.page_links_raw("html"), "href")


SQL_LINKS = f"""{SQL_ALLPAGES}, raw_links AS (
  {_rows_sql("page_id, url", S.attr_list("html", "a", "href"), "allpages", "href")}
), abs_links AS (
  SELECT page_id, url AS src_url, pos, href, {S.url_join('url', 'href')} AS dst_url FROM raw_links
)"""


@register("page_links_abs", f"WITH {SQL_LINKS} SELECT page_id, pos, dst_url FROM abs_links")
def q_page_links_abs(spark, sf):
    df = _allpages(spark, sf)
    return _explode(df, ["page_id", "url"], H.page_links_raw("html"), "href").select(
        "page_id", "pos", U.url_join(F.col("url"), F.col("href")).alias("dst_url"))


@register("page_images", f"WITH {SQL_ALLPAGES} " + _rows_sql("page_id", S.attr_list("html", "img", "src"), "allpages", "src"))
def q_page_images(spark, sf):
    return _explode(_allpages(spark, sf), ["page_id"], H.page_images("html"), "src")


SQL_ROUTES = f"routes AS (SELECT url, NULL::VARCHAR AS content_type FROM pages UNION ALL SELECT * FROM {FX.ROUTES.sql()})"


def _routes(spark, sf):
    return table(spark, sf, "pages").select("url", F.lit(None).cast("string").alias("content_type")).unionByName(
        FX.ROUTES.df(spark))


@register("route_content_type", f"WITH {SQL_ROUTES} SELECT url, content_type, {S.route('url', 'content_type')} AS kind FROM routes")
def q_route_content_type(spark, sf):
    return _routes(spark, sf).select("url", "content_type", U.route_content_type("url", "content_type").alias("kind"))


@register("page_slug",
          f"WITH {SQL_ROUTES} SELECT url, content_type, {S.slug('url', S.route('url', 'content_type'))} AS slug FROM routes")
def q_page_slug(spark, sf):
    r = _routes(spark, sf)
    return r.select("url", "content_type", U.page_slug("url", U.route_content_type("url", "content_type")).alias("slug"))


SQL_PDF = f"""pdf_in AS (
  SELECT 'doc-' || doc_id || '.pdf' AS url, CAST(0 AS BIGINT) AS page_no, text AS page_text, NULL::VARCHAR AS error FROM documents
  UNION ALL SELECT * FROM {FX.PDF_PAGES.sql()}
), pdf_pages AS (
  SELECT url, page_no, error,
         array_to_string(list_filter(list_transform({S.split_lines("coalesce(page_text, '')")}, lambda x: {S.ustrip('x')}),
                                     lambda x: x <> ''), chr(10)) AS pj
  FROM pdf_in
)"""


@register("pdf_line_normalize", f"""WITH {SQL_PDF}
  SELECT url, CASE WHEN max(error) IS NOT NULL THEN 'Error extracting PDF text: ' || max(error)
                   ELSE coalesce(string_agg(pj, chr(10) ORDER BY page_no) FILTER (WHERE pj <> ''), '') END AS content
  FROM pdf_pages GROUP BY url""")
def q_pdf_line_normalize(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("url"),
        F.lit(0).cast("long").alias("page_no"), F.col("text").alias("page_text"),
        F.lit(None).cast("string").alias("error"))
    return PG.pdf_line_normalize(docs.unionByName(FX.PDF_PAGES.df(spark)))


# ---------------------------------------------------------------- link predicates
DOMAINS = ["example.com"]


def _edges(spark, sf):
    return L.page_edges(_allpages(spark, sf).select("url", "html"))


def _flag_query(flag_sql: str, name: str) -> str:
    return f"WITH {SQL_LINKS} SELECT src_url, pos, dst_url, {flag_sql} AS {name} FROM abs_links"


def _same_host_sql():
    return f"({S.url_part('dst_url', 2)} = {S.url_part('src_url', 2)})"


def _subpath_sql():
    p = S.url_part("dst_url", 3)
    return f"({p} = '/' OR starts_with({p}, '/'))"


@register("link_same_host", _flag_query(_same_host_sql(), "same_host"))
def q_link_same_host(spark, sf):
    e = _edges(spark, sf)
    return e.select("src_url", F.col("pos").cast("long"), "dst_url", U.link_same_host("src_url", "dst_url").alias("same_host"))


@register("link_allowed_subpath", _flag_query(_subpath_sql(), "allowed"))
def q_link_allowed_subpath(spark, sf):
    e = _edges(spark, sf)
    return e.select("src_url", F.col("pos").cast("long"), "dst_url",
                    U.link_allowed_subpath("src_url", "dst_url", ["/"]).alias("allowed"))


# pages whose links are all followed, whatever their path
START_URLS = ["http://fx.example.com/", "http://fx.example.com/dir/sub/page.html?x=1#top"]
SUBPATHS = ["/en/", "/c2"]


def _starts_sql():
    p = S.url_part("dst_url", 3)
    under = " OR ".join(f"starts_with({p}, {S.q(x)})" for x in SUBPATHS)
    return f"({under} OR src_url IN ({', '.join(map(S.q, START_URLS))}))"


@register("link_allowed_start", _flag_query(_starts_sql(), "allowed"))
def q_link_allowed_start(spark, sf):
    e = _edges(spark, sf)
    return e.select("src_url", F.col("pos").cast("long"), "dst_url",
                    U.link_allowed_subpath("src_url", "dst_url", SUBPATHS, START_URLS).alias("allowed"))


@register("link_not_self", _flag_query("(dst_url <> src_url)", "not_self"))
def q_link_not_self(spark, sf):
    e = _edges(spark, sf)
    return e.select("src_url", F.col("pos").cast("long"), "dst_url", U.link_not_self("src_url", "dst_url").alias("not_self"))


def _domain_sql(domains):
    host = f"lower(regexp_extract({S.url_part('dst_url', 2)}, '^(?:[^@]*@)?(\\[[^\\]]*\\]|[^:]*)', 1))"
    return "(" + " OR ".join(f"{host} = {S.q(d)} OR ends_with({host}, {S.q('.' + d)})" for d in domains) + ")"


@register("link_allowed_domain", _flag_query(_domain_sql(DOMAINS), "allowed_domain"))
def q_link_allowed_domain(spark, sf):
    e = _edges(spark, sf)
    return e.select("src_url", F.col("pos").cast("long"), "dst_url",
                    U.link_allowed_domain("dst_url", DOMAINS).alias("allowed_domain"))


SQL_FOLLOW = f"""{SQL_LINKS}, follow AS (
  SELECT src_url, dst_url FROM abs_links WHERE {_same_host_sql()} AND {_subpath_sql()} AND dst_url <> src_url
)"""


def _bare(c: str) -> str:
    return S.request_key(c)


@register("link_frontier", f"""WITH {SQL_FOLLOW}
  SELECT DISTINCT {_bare('dst_url')} AS dst_url FROM follow WHERE {_bare('dst_url')} NOT IN (SELECT {_bare('url')} FROM allpages)""")
def q_link_frontier(spark, sf):
    pages = _allpages(spark, sf)
    return L.link_frontier(L.follow_filter(L.page_edges(pages.select("url", "html"))), pages)


# one start page (a page of a captured cycle, besides the pages nobody links to) and a chain longer than any cap
CHAIN = [(f"http://chain.example.com/{i}", f'<a href="/{i + 1}#part">next</a>') for i in range(20)]
# the last page links to a captured one under another form of its address
CHAIN += [("http://chain.example.com/20", '<a href="/q?b=%7ex+y&amp;a=1#z">q</a>'), ("http://chain.example.com/q?a=1&b=~x%20y", "")]
CRAWL_START = "http://chain.example.com/0"


@register("crawl_reach", f"""WITH RECURSIVE {SQL_FOLLOW}, known AS (
  SELECT url, {_bare('url')} AS u FROM allpages UNION SELECT url, {_bare('url')} FROM {S.values(CHAIN, [("url", "VARCHAR"), ("html", "VARCHAR")])}
), ce AS (
  SELECT DISTINCT {_bare('src_url')} AS src_url, {_bare('dst_url')} AS dst_url FROM follow
  WHERE {_bare('src_url')} IN (SELECT u FROM known) AND {_bare('dst_url')} IN (SELECT u FROM known) AND {_bare('src_url')} <> {_bare('dst_url')}
  UNION SELECT 'http://chain.example.com/' || i, 'http://chain.example.com/' || (i + 1) FROM range(0, {len(CHAIN) - 2}) t(i)
  UNION SELECT '{CHAIN[-2][0]}', 'http://chain.example.com/q?a=1&b=~x+y'
), starts AS (
  SELECT DISTINCT u FROM known WHERE u NOT IN (SELECT dst_url FROM ce) OR u = '{CRAWL_START}'
), reach(u, depth) AS (
  SELECT u, 0 FROM starts
  UNION
  SELECT ce.dst_url, reach.depth + 1 FROM reach JOIN ce ON ce.src_url = reach.u WHERE reach.depth < (SELECT count(*) FROM known)
)
SELECT url, CAST(min(depth) AS BIGINT) AS depth FROM reach JOIN known USING (u) GROUP BY url""")
def q_crawl_reach(spark, sf):
    pages = _allpages(spark, sf).select("url", "html").unionByName(spark.createDataFrame(CHAIN, "url string, html string"))
    edges = L.follow_filter(L.page_edges(pages))
    bare = pages.select(U.request_key(F.col("url")).alias("u")).distinct()
    links = edges.filter(U.request_key(F.col("src_url")) != U.request_key(F.col("dst_url")))
    starts = bare.join(links.select(U.request_key(F.col("dst_url")).alias("u")), "u", "left_anti").union(
        spark.createDataFrame([(CRAWL_START,)], "u string"))
    return L.crawl_reach(edges, pages, starts).select("url", F.col("depth").cast("long"))


# ---------------------------------------------------------------- page records
def _records_sql() -> str:
    return f"""{SQL_ALLPAGES},
{S.element_texts_ctes('allpages', 'page_id', 'html', 'div', 'desc', 'dd')},
{S.element_texts_ctes('allpages', 'page_id', 'html', 'article', None, 'ar')},
recs AS (
  SELECT p.page_id, p.url, {S.slug('p.url', "'html'")} AS slug, {S.title('p.html')} AS title,
         {S.meta('p.html', 'description')} AS description, {S.meta('p.html', 'keywords')} AS keywords,
         array_to_string({S.element_text_lines(S.body('p.html'))}, chr(10)) AS text,
         array_to_string(dd.texts, chr(10) || '--' || chr(10)) AS desc_divs,
         array_to_string(ar.texts, chr(10) || '--' || chr(10)) AS article_texts,
         array_to_string({S.attr_list('p.html', 'a', 'href')}, ' ') AS links_raw,
         array_to_string({S.attr_list('p.html', 'img', 'src')}, ' ') AS images,
         array_to_string(list_transform({S.attr_list('p.html', 'a', 'href')}, lambda h: {S.url_join('p.url', 'h')}), ' ') AS links_abs,
         {S.element_text_lines(S.body('p.html'))} AS text_list, ar.texts AS article_list
  FROM allpages p JOIN dd USING (page_id) JOIN ar USING (page_id)
), latest AS (
  SELECT * FROM recs QUALIFY page_id = max(page_id) OVER (PARTITION BY slug)
)"""


SEP = "\n--\n"


def _flat_records(rec):
    return rec.select(
        "page_id", "url", "slug", "title", F.col("meta.description").alias("description"),
        F.col("meta.keywords").alias("keywords"), F.array_join("text_lines", "\n").alias("text"),
        F.array_join("desc_divs", SEP).alias("desc_divs"), F.array_join("article_texts", SEP).alias("article_texts"),
        F.array_join("links_raw", " ").alias("links_raw"), F.array_join("images", " ").alias("images"),
    )


REC_COLS = "page_id, url, slug, title, description, keywords, text, desc_divs, article_texts, links_raw, images"


@register("extract_pages", f"WITH {_records_sql()} SELECT {REC_COLS} FROM latest")
def q_extract_pages(spark, sf):
    return _flat_records(PG.extract_pages(_allpages(spark, sf)))


SQL_PDF_TYPE = "CASE WHEN page_id % 5 = 0 THEN 'Application/PDF; version=1.7' ELSE 'text/html' END"


@register("extract_pages_pdf", f"""WITH {SQL_ALLPAGES}, kinds AS (
    SELECT page_id, url, html, {S.route('url', SQL_PDF_TYPE)} AS kind FROM allpages
  ), slugs AS (SELECT *, {S.slug('url', 'kind')} AS slug FROM kinds
  ), latest AS (SELECT * FROM slugs QUALIFY page_id = max(page_id) OVER (PARTITION BY slug)
  ), pdf_pages AS (
    SELECT url, page_id AS page_no, array_to_string(list_filter(list_transform({S.split_lines("coalesce(html, '')")}, lambda x: {S.ustrip('x')}),
                                                                lambda x: x <> ''), chr(10)) AS pj
    FROM kinds WHERE kind = 'pdf' AND page_id % 10 = 0
  ), pdf AS (SELECT url, coalesce(string_agg(pj, chr(10) ORDER BY page_no) FILTER (WHERE pj <> ''), '') AS content FROM pdf_pages GROUP BY url)
  SELECT page_id, url, slug, kind, CASE WHEN kind = 'pdf' THEN 'pdf' END AS type, CASE WHEN kind = 'html' THEN {S.title('html')} END AS title,
         CASE WHEN kind = 'html' THEN array_to_string({S.element_text_lines(S.body('html'))}, chr(10)) END AS text,
         CASE WHEN kind = 'pdf' THEN coalesce(content, '') END AS content
  FROM latest LEFT JOIN pdf USING (url)""")
def q_extract_pages_pdf(spark, sf):
    """C1 with PDF responses: every fifth page was sent as a PDF, and the text of every second one of these could be read."""
    pages = _allpages(spark, sf).withColumn("ct", F.expr(SQL_PDF_TYPE))
    read = pages.where("page_id % 10 = 0").select("url", F.col("page_id").alias("page_no"), F.col("html").alias("page_text"),
                                                  F.lit(None).cast("string").alias("error"))
    rec = PG.extract_pages(pages, "ct", PG.pdf_line_normalize(read))
    html = F.col("kind") == "html"
    return rec.select("page_id", "url", "slug", "kind", "type", F.when(html, F.col("title")).alias("title"),
                      F.when(html, F.array_join("text_lines", "\n")).alias("text"), "content")


@register("last_write_wins", f"WITH {SQL_ALLPAGES} SELECT {S.slug('url', chr(39) + 'html' + chr(39))} AS slug, "
          "CAST(max(page_id) AS BIGINT) AS page_id FROM allpages GROUP BY 1")
def q_last_write_wins(spark, sf):
    p = _allpages(spark, sf).select("page_id", U.page_slug("url", F.lit("html")).alias("slug"))
    return dedup.last_write_wins(p, ["slug"], "page_id").select("slug", "page_id")


# ================================================================ dialog

SQL_CONV = f"conv AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM {FX.CONV_EXTRA.sql()})"


def _conv(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(FX.CONV_EXTRA.df(spark))


_INTENT_SQL, _RESPONSE_SQL = S.intent_case("text")


@register("detect_intent", f"""WITH {SQL_CONV}
  SELECT conv_id, turn, {_INTENT_SQL} AS intent, {_RESPONSE_SQL} AS response FROM conv WHERE role = 'user'""")
def q_detect_intent(spark, sf):
    c = _conv(spark, sf).filter(F.col("role") == "user")
    it = T.detect_intent(F.col("text"))
    return c.select("conv_id", "turn", it["intent"].alias("intent"), it["response"].alias("response"))


@register("clean_qa_lines", f"""WITH {SQL_CONV}
  SELECT conv_id, turn, {S.clean_qa('text')} AS cleaned FROM conv WHERE role = 'assistant'""")
def q_clean_qa_lines(spark, sf):
    c = _conv(spark, sf).filter(F.col("role") == "assistant")
    return c.select("conv_id", "turn", T.clean_qa_lines("text").alias("cleaned"))


@register("validate_prompts", f"""WITH {SQL_CONV}
  SELECT conv_id, turn, {S.ustrip("coalesce(text, '')")} AS prompt_clean,
         CASE WHEN {S.ustrip("coalesce(text, '')")} <> '' THEN 'ok' ELSE 'error' END AS status,
         CASE WHEN {S.ustrip("coalesce(text, '')")} <> '' THEN NULL ELSE 'Empty prompt' END AS error
  FROM conv WHERE role = 'user'""")
def q_validate_prompts(spark, sf):
    c = _conv(spark, sf).filter(F.col("role") == "user")
    return D.validate_prompts(c, "text").select("conv_id", "turn", "prompt_clean", "status", "error")


def _prompt_sql(ctx: str, query: str) -> str:
    pre, rest = T.DEFAULT_PROMPT_TEMPLATE.split("{context}", 1)
    mid, post = rest.split("{query}", 1)
    return f"({S.q(pre)} || {ctx} || {S.q(mid)} || {query} || {S.q(post)})"


@register("build_prompt", f"""WITH {SQL_CONV}
  SELECT u.conv_id, u.turn, {_prompt_sql("coalesce(" + S.clean_qa('a.text') + ", '')", 'u.text')} AS prompt
  FROM conv u LEFT JOIN conv a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'""")
def q_build_prompt(spark, sf):
    c = _conv(spark, sf)
    u = c.filter(F.col("role") == "user").select("conv_id", "turn", "text")
    a = c.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), T.clean_qa_lines("text").alias("ctx"))
    j = u.join(a, ["conv_id", "turn"], "left")
    return j.select("conv_id", "turn", T.build_prompt(F.coalesce(F.col("ctx"), F.lit("")), F.col("text")).alias("prompt"))


@register("truncate_at_stop", f"""WITH {SQL_CONV}
  SELECT conv_id, turn, {S.truncate_at_stop('text')} AS text FROM conv WHERE role = 'assistant'""")
def q_truncate_at_stop(spark, sf):
    c = _conv(spark, sf).filter(F.col("role") == "assistant")
    return c.select("conv_id", "turn", T.truncate_at_stop(F.col("text")).alias("text"))


@register("assemble_stream", f"""WITH {SQL_CONV}
  SELECT conv_id, turn, t AS text FROM (SELECT conv_id, turn, {S.truncate_at_stop('text')} AS t FROM conv
  WHERE role = 'assistant') WHERE t <> ''""")
def q_assemble_stream(spark, sf):
    c = _conv(spark, sf).filter(F.col("role") == "assistant")
    t = c.select("conv_id", "turn", T.truncate_at_stop(F.col("text")).alias("t"))
    pieces = D.stream_pieces(t, ["conv_id", "turn"], "t")
    return D.assemble_stream(pieces, ["conv_id", "turn"], "seq", "piece")


@register("transcript", f"""WITH {SQL_CONV}
  SELECT conv_id, turn, CASE role WHEN 'user' THEN 'You' WHEN 'assistant' THEN 'Bot'
         ELSE upper(left(coalesce(role, ''), 1)) || lower(substr(coalesce(role, ''), 2)) END AS sender,
         (CASE role WHEN 'user' THEN 'You' WHEN 'assistant' THEN 'Bot'
          ELSE upper(left(coalesce(role, ''), 1)) || lower(substr(coalesce(role, ''), 2)) END) || ': ' || coalesce(text, '') AS line
  FROM conv""")
def q_transcript(spark, sf):
    return D.transcript(_conv(spark, sf)).select("conv_id", "turn", "sender", "line")


@register("take_while_session", f"""WITH {SQL_CONV}, firsts AS (
    SELECT conv_id, min(turn) AS fe FROM conv WHERE role = 'user' AND lower(text) IN ('exit', 'quit') GROUP BY conv_id)
  SELECT c.conv_id, c.turn FROM conv c LEFT JOIN firsts f USING (conv_id) WHERE f.fe IS NULL OR c.turn < f.fe""")
def q_take_while_session(spark, sf):
    return D.take_while_session(_conv(spark, sf)).select("conv_id", "turn")


# ================================================================ sentences, incremental ingest, audit
def _clean_docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_text("text").alias("text"))


SQL_SENT_ROWS = f"""sent_rows AS (
  SELECT doc_id, CAST(unnest(range(len(s))) AS BIGINT) AS sent_pos, unnest(s) AS sentence
  FROM (SELECT doc_id, {S.sentences(S.clean('text'))} AS s FROM documents)
)"""


@register("split_sentences", f"WITH {SQL_SENT_ROWS} SELECT * FROM sent_rows")
def q_split_sentences(spark, sf):
    return chunking.explode_sentences(_clean_docs(spark, sf)).withColumn("sent_pos", F.col("sent_pos").cast("long"))


# the driver tables have no abbreviations: two frequent words become some
ABBREVIATED = "replace(replace(text, ' the ', ' prof. '), ' of ', ' e.g. ')"
SQL_TYPES = f"""toks AS (
  SELECT unnest({S.words(S.clean(ABBREVIATED))}) AS t FROM documents
), parts AS (
  SELECT lower(regexp_extract(t, '{S.WORD_TYPE}', 1)) AS type, regexp_extract(t, '{S.WORD_TYPE}', 2) AS stop FROM toks
), counts AS (
  SELECT type, count(*) FILTER (stop <> '') AS n_stop, count(*) FILTER (stop = '') AS n_plain FROM parts WHERE type <> '' GROUP BY type
), rate AS (
  SELECT CAST(sum(n_stop) AS DOUBLE) / sum(n_stop + n_plain) AS p FROM counts
), types AS (
  SELECT type, n_stop, n_plain, len(replace(type, '.', '')) AS n_letters, len(type) - n_letters + 1 AS inner_stops,
         -2.0 * (n_stop * ln(p) + n_plain * ln(1 - p) - n_stop * ln(0.99) - n_plain * ln(1 - 0.99))
         * exp(-n_letters) * inner_stops * pow(CAST(n_letters AS DOUBLE), -n_plain) AS score
  FROM counts, rate
)"""


@register("learn_abbreviations", f"""WITH {SQL_TYPES}
  SELECT type, CAST(n_stop AS BIGINT) AS n_stop, CAST(n_plain AS BIGINT) AS n_plain, floor(score * 1000 + 0.5) / 1000 AS score
  FROM types WHERE n_stop > 0 AND score >= 0.3""")
def q_learn_abbreviations(spark, sf):
    types = SE.abbreviation_types(_abbreviated(spark, sf)).where(f"n_stop > 0 AND score >= {SE.THRESHOLD}")
    return types.select("type", "n_stop", "n_plain", (F.floor(F.col("score") * 1000 + 0.5) / 1000).alias("score"))


def _abbreviated(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", T.clean_text(F.expr(ABBREVIATED)).alias("text"))


@register("split_sentences_learned", f"""WITH {SQL_TYPES}, abbr AS (
  SELECT list(type) AS known FROM types WHERE n_stop > 0 AND score >= 0.3
), cut AS (
  SELECT doc_id, regexp_extract_all({S.clean(ABBREVIATED)}, '{S.PIECE}') AS p FROM documents
), flagged AS (
  SELECT doc_id, p, list_transform(p, lambda x: coalesce(list_contains(known, lower(regexp_extract(x, '{S.LAST}', 1))), false)) AS f FROM cut, abbr
), begun AS (
  SELECT doc_id, p, list_filter(range(1, len(p) + 1), lambda i: i = 1 OR NOT f[i - 1]) AS s FROM flagged
), whole AS (
  SELECT doc_id, list_filter(list_transform(range(1, len(s) + 1), lambda j: {S.ustrip("array_to_string(list_slice(p, s[j], coalesce(s[j + 1], len(p) + 1) - 1), '')")}),
         lambda x: x <> '') AS s FROM begun
)
  SELECT doc_id, CAST(unnest(range(len(s))) AS BIGINT) AS sent_pos, unnest(s) AS sentence FROM whole""")
def q_split_sentences_learned(spark, sf):
    """Abbreviations learned from all documents, then all documents split with them."""
    docs = _abbreviated(spark, sf)
    known = SE.learn_abbreviations(docs).select("type").checkpoint()
    return SE.split_sentences_learned(docs, known).withColumn("sent_pos", F.col("sent_pos").cast("long"))


VOCABULARY_WORDS = 5000


@register("count_subwords", f"""WITH RECURSIVE toks AS (
  SELECT doc_id, unnest({S.words('text')}) AS w FROM documents
), top AS (
  SELECT w FROM toks GROUP BY w ORDER BY count(*) DESC, w LIMIT {VOCABULARY_WORDS}
), vocab AS (
  SELECT DISTINCT unnest([w, left(w, 1), '##' || right(w, 1), '##' || right(w, 2), '##' || right(w, 3)]) AS piece FROM top
), words AS (
  SELECT DISTINCT w FROM toks
), starts AS (
  SELECT w, unnest(range(len(w))) AS o FROM words WHERE len(w) <= 100
), tries AS (
  SELECT w, o, unnest(range(1, len(w) - o + 1)) AS n FROM starts
), best AS (
  SELECT w, o, max(n) AS n FROM tries JOIN vocab ON piece = (CASE WHEN o > 0 THEN '##' ELSE '' END) || substr(w, o + 1, n) GROUP BY w, o
), cut AS (
  SELECT w, CAST(0 AS BIGINT) AS o, 0 AS k FROM words
  UNION ALL
  SELECT c.w, c.o + b.n, c.k + 1 FROM cut c JOIN best b ON b.w = c.w AND b.o = c.o
), sizes AS (
  SELECT w, coalesce(max(k) FILTER (o = len(w)), 1) AS k FROM cut GROUP BY w
)
  SELECT d.doc_id, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_tokens
  FROM documents d LEFT JOIN toks t ON t.doc_id = d.doc_id LEFT JOIN sizes s ON s.w = t.w GROUP BY d.doc_id""")
def q_count_subwords(spark, sf):
    """Whole documents counted in pieces of a vocabulary that the corpus gives: its commonest words, their first letters and endings."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    counts = docs.select(F.explode(T.usplit_words("text")).alias("w")).groupBy("w").count()
    words = [r["w"] for r in counts.orderBy(F.desc("count"), "w").limit(VOCABULARY_WORDS).collect()]
    pieces = {p for w in words for p in (w, w[0], *("##" + w[-k:] for k in (1, 2, 3)))}
    counted = SW.count_subwords(docs, pieces, limit=2**31 - 1)
    return counted.select("doc_id", F.col("n_tokens").cast("long").alias("n_tokens"))


@register("count_tokens", f"""WITH {SQL_SENT_ROWS}
  SELECT doc_id, sent_pos, CAST(least(512, len({S.words('sentence')})) AS BIGINT) AS n_tokens FROM sent_rows""")
def q_count_tokens(spark, sf):
    s = chunking.explode_sentences(_clean_docs(spark, sf))
    return s.select("doc_id", F.col("sent_pos").cast("long"), T.count_tokens(F.col("sentence"), 512).cast("long").alias("n_tokens"))


@register("chunk_sentences", f"WITH {S.sentence_chunk_ctes('documents', 'sc')} SELECT * FROM sc")
def q_chunk_sentences(spark, sf):
    recs = jobs.documents_as_records(table(spark, sf, "documents"))
    return jobs.sentence_chunks(recs).select("doc_id", F.col("chunk_pos").cast("long"), "chunk_text")


BENCH_DOC_OFFSET = 1_000_000_000

SQL_INC = f"""docs2 AS (
  SELECT doc_id, text FROM documents UNION ALL SELECT {BENCH_DOC_OFFSET} + item_id, text FROM benchmark
  UNION ALL SELECT * FROM {FX.BLANK_DOCS.sql()}
), {S.sentence_chunk_ctes('documents', 'c1')}, {S.sentence_chunk_ctes('docs2', 'c2')},
r1_first AS (
  SELECT doc_id, chunk_pos, chunk_text, md5(chunk_text) AS chunk_hash
  FROM c1 QUALIFY row_number() OVER (PARTITION BY md5(chunk_text) ORDER BY doc_id, chunk_pos) = 1
), r1 AS (
  SELECT CAST(row_number() OVER (ORDER BY doc_id, chunk_pos) - 1 AS BIGINT) AS id, * FROM r1_first
), c2_new AS (
  SELECT *, md5(chunk_text) AS chunk_hash FROM c2 WHERE md5(chunk_text) NOT IN (SELECT chunk_hash FROM r1)
), r2_first AS (
  SELECT * FROM c2_new QUALIFY row_number() OVER (PARTITION BY chunk_hash ORDER BY doc_id, chunk_pos) = 1
), r2 AS (
  SELECT CAST((SELECT coalesce(max(id) + 1, 0) FROM r1) + row_number() OVER (ORDER BY doc_id, chunk_pos) - 1 AS BIGINT) AS id,
         doc_id, chunk_pos, chunk_text, chunk_hash
  FROM r2_first
), final_store AS (SELECT * FROM r1 UNION ALL SELECT * FROM r2)"""


def _inc_inputs(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    bench = table(spark, sf, "benchmark").select((F.lit(BENCH_DOC_OFFSET) + F.col("item_id")).alias("doc_id"), "text")
    more = docs.unionByName(bench).unionByName(FX.BLANK_DOCS.df(spark))
    return jobs.documents_as_records(docs), jobs.documents_as_records(more)


def _inc_runs(spark, sf):
    first, second = _inc_inputs(spark, sf)
    run1 = jobs.ingest_incremental(first, None).checkpoint()
    run2 = jobs.ingest_incremental(second, run1)
    return first, second, run1, run2


SQL_INC_VEC = f"""{SQL_INC}, {S.sparse_embedding_cte('semb', 'final_store', 'id', 'chunk_text')},
  final_vec AS (SELECT f.*, coalesce(v.vec, '') AS vec FROM final_store f LEFT JOIN {_vec_sql('id', 'semb')} v USING (id))"""


@register("ingest_incremental", f"""WITH {SQL_INC_VEC}
  SELECT id, doc_id, chunk_pos, chunk_hash, {S.tags('chunk_text')} AS tags, vec FROM final_vec""")
def q_ingest_incremental(spark, sf):
    _, _, run1, run2 = _inc_runs(spark, sf)
    return run1.unionByName(run2).select("id", "doc_id", F.col("chunk_pos").cast("long"), "chunk_hash",
                                         F.array_join("tags", ",").alias("tags"), _vec().alias("vec"))


@register("new_chunks_only", f"WITH {SQL_INC} SELECT doc_id, chunk_pos, chunk_hash FROM c2_new")
def q_new_chunks_only(spark, sf):
    first, second = _inc_inputs(spark, sf)
    old = dedup.with_chunk_hash(jobs.sentence_chunks(first))
    new = dedup.with_chunk_hash(jobs.sentence_chunks(second))
    return dedup.new_chunks_only(new, old).select("doc_id", F.col("chunk_pos").cast("long"), "chunk_hash")


@register("union_increment", f"WITH {SQL_INC} SELECT id, chunk_hash FROM final_store")
def q_union_increment(spark, sf):
    _, _, run1, run2 = _inc_runs(spark, sf)
    return audit.union_increment(run1, run2).select("id", "chunk_hash")


@register("ingest_report", f"""WITH {SQL_INC}
  SELECT (SELECT CAST(count(*) AS BIGINT) FROM r1) AS existing, (SELECT CAST(count(*) AS BIGINT) FROM r2) AS new_chunks,
         (SELECT CAST(count(*) AS BIGINT) FROM docs2 WHERE {S.clean("coalesce(text, '')")} = '') AS skipped_docs,
         (SELECT CAST(count(*) AS BIGINT) FROM r2) AS vectors_added""")
def q_ingest_report(spark, sf):
    _, second, run1, run2 = _inc_runs(spark, sf)
    return audit.ingest_report(run1, run2, second)


@register("ingest_observed", f"""WITH {SQL_INC}
  SELECT CAST(count(*) FILTER (WHERE c <> '') AS BIGINT) AS kept, CAST(count(*) FILTER (WHERE c = '') AS BIGINT) AS skipped,
         CAST(0 AS BIGINT) AS unparsable, (SELECT CAST(count(*) AS BIGINT) FROM r2) AS new_chunks
  FROM (SELECT {S.clean("coalesce(text, '')")} AS c FROM docs2)""")
def q_ingest_observed(spark, sf):
    """The report of an incremental run, counted while its chunks are written."""
    _, second, run1, _ = _inc_runs(spark, sf)
    report = audit.write_observed(second, lambda r: jobs.ingest_incremental(r, run1), scratch_path(spark, "observed"))
    return spark.createDataFrame([report], "kept long, skipped long, unparsable long, new_chunks long")


@register("distinct_sources", f"WITH {SQL_WORD_CHUNKS.strip()} SELECT DISTINCT 'doc-' || doc_id || '.json' AS file FROM store")
def q_distinct_sources(spark, sf):
    return audit.distinct_sources(_store(spark, sf))


@register("xref_missing_sources", f"""WITH {SQL_WORD_CHUNKS.strip()}
  SELECT 'doc-' || doc_id || '.json' AS file FROM documents
  EXCEPT SELECT 'doc-' || doc_id || '.json' FROM store""")
def q_xref_missing_sources(spark, sf):
    recs = jobs.documents_as_records(table(spark, sf, "documents"))
    return audit.xref_missing_sources(recs.select("file"), _store(spark, sf))


@register("audit_id_consistency", f"""WITH {SQL_INC},
  m AS (SELECT DISTINCT id FROM final_store), v AS (SELECT id FROM r1 UNION SELECT -1 - item_id FROM benchmark)
  SELECT (SELECT CAST(count(*) AS BIGINT) FROM m) AS meta_entries, (SELECT CAST(count(*) AS BIGINT) FROM v) AS vector_entries,
         (SELECT CAST(count(*) AS BIGINT) FROM m WHERE id NOT IN (SELECT id FROM v)) AS missing_in_vectors,
         (SELECT CAST(count(*) AS BIGINT) FROM v WHERE id NOT IN (SELECT id FROM m)) AS missing_in_meta,
         (SELECT count(*) FROM m WHERE id NOT IN (SELECT id FROM v)) = 0
           AND (SELECT count(*) FROM v WHERE id NOT IN (SELECT id FROM m)) = 0 AS consistent""")
def q_audit_id_consistency(spark, sf):
    """Metadata of both runs against the vectors of the first and vectors that
    no chunk has: ids are missing on either side."""
    _, _, run1, run2 = _inc_runs(spark, sf)
    stray = table(spark, sf, "benchmark").select((-1 - F.col("item_id")).alias("id"))
    return audit.audit_id_consistency(run1.select("id").unionByName(run2.select("id")), run1.select("id").unionByName(stray))


# ================================================================ cache, rerank, RAG

ADMISSION_CAP = 500  # below the distinct-key count of the log, so the cap is exercised


@register("cache_admission", f"""WITH lg AS (SELECT event_id, event_type || '/' || user_id AS key FROM events),
  firsts AS (SELECT key, min(event_id) AS fst FROM lg GROUP BY key),
  adm AS (SELECT key FROM firsts ORDER BY fst, key LIMIT {ADMISSION_CAP})
  SELECT l.event_id, l.key, (a.key IS NOT NULL) AS admitted, (a.key IS NOT NULL AND l.event_id > f.fst) AS hit
  FROM lg l JOIN firsts f USING (key) LEFT JOIN adm a USING (key)""")
def q_cache_admission(spark, sf):
    ev = table(spark, sf, "events").select("event_id", F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("key"))
    return CA.cache_admission(ev, "key", "event_id", ADMISSION_CAP).select("event_id", "key", "admitted", "hit")


@register("cache_lookup", """WITH qs AS (
    SELECT 'bench' AS src, CAST(item_id AS VARCHAR) AS qid, text AS query FROM benchmark
    UNION ALL SELECT 'user', conv_id || '/' || turn, text FROM conversations WHERE role = 'user')
  SELECT src, qid, EXISTS (SELECT 1 FROM benchmark b WHERE b.text = qs.query) AS hit FROM qs""")
def q_cache_lookup(spark, sf):
    b = table(spark, sf, "benchmark")
    users = table(spark, sf, "conversations").filter(F.col("role") == "user")
    qs = b.select(F.lit("bench").alias("src"), F.col("item_id").cast("string").alias("qid"), F.col("text").alias("query")).unionByName(
        users.select(F.lit("user").alias("src"), F.concat_ws("/", "conv_id", "turn").alias("qid"),
                     F.col("text").alias("query")))
    cache = embed.embed_text(b.select(F.col("text").alias("query")), "query", "embedding")
    return CA.cache_lookup(qs, cache, "query").select("src", "qid", "hit")


def _doc_candidates(spark, sf):
    store = _store(spark, sf)
    qv = jobs.query_vectors(table(spark, sf, "benchmark"), "item_id", "text")
    hits = search.topk_inner_product(qv, store, k=10, carry=["embedding", "chunk_text"])
    return store, qv, hits


SQL_MMR = f"""{SQL_DOC_SEARCH.strip()}, qe AS (SELECT item_id AS qk, bucket, w FROM qemb),
{S.mmr_ctes('doc_hits', 'qe', 'cemb')}"""


@register("candidate_self_join", f"""WITH {SQL_MMR}
  SELECT c.qid, CAST(c.r AS BIGINT) AS rank, (SELECT max(cos) FROM pc WHERE pc.qid = c.qid AND pc.r1 = c.r AND pc.r2 <> c.r) AS max_cos
  FROM cands c""")
def q_candidate_self_join(spark, sf):
    _, qv, hits = _doc_candidates(spark, sf)
    cands = RR.with_query_similarity(hits, qv)
    return RR.candidate_self_join(cands).select("qid", F.col("rank").cast("long"), "max_cos")


@register("mmr_rerank", f"WITH {SQL_MMR} SELECT qid, pick, CAST(rank AS BIGINT) AS rank, id FROM mmr_picks")
def q_mmr_rerank(spark, sf):
    _, qv, hits = _doc_candidates(spark, sf)
    return RR.mmr_select(hits, qv, 4, 0.5).select("qid", "pick", F.col("rank").cast("long"), "id")


@register("search_mmr", f"""WITH {SQL_MMR}
  SELECT p.qid, p.pick, CAST(p.rank AS BIGINT) AS rank, p.id, s.chunk_text FROM mmr_picks p JOIN store s USING (id)""")
def q_search_mmr(spark, sf):
    store = _store(spark, sf)
    out = jobs.search_mmr(table(spark, sf, "benchmark"), store, 10, 4, 0.5, qid="item_id", text="text")
    return out.select("qid", "pick", F.col("rank").cast("long"), "id", "chunk_text")


def _rag_sql() -> str:
    pc = S.ustrip("coalesce(text, '')")
    _, resp = S.intent_case("pc")
    return f"""WITH {SQL_CONV}, {SQL_WORD_CHUNKS.strip()},
req AS (SELECT conv_id, turn, {pc} AS pc FROM conv WHERE role = 'user'),
req2 AS (SELECT *, {resp} AS intent_resp FROM req),
ask AS (SELECT row_number() OVER (ORDER BY conv_id, turn) AS qid, conv_id, turn, pc FROM req2 WHERE pc <> '' AND intent_resp IS NULL),
{S.sparse_embedding_cte('cemb', 'store', 'id', 'chunk_text')},
{S.sparse_embedding_cte('qemb', 'ask', 'qid', 'pc')},
dots AS (SELECT qemb.qid, cemb.id, sum(qemb.w * cemb.w) AS ip FROM qemb JOIN cemb USING (bucket) GROUP BY 1, 2),
scores AS (
  SELECT a.qid, s.id, CAST(floor(coalesce(d.ip, 0) * 1000000 + 0.5) AS BIGINT) AS k
  FROM ask a CROSS JOIN store s LEFT JOIN dots d ON d.qid = a.qid AND d.id = s.id
), rk AS (SELECT qid, id, k, row_number() OVER (PARTITION BY qid ORDER BY k DESC, id) AS rank FROM scores),
doc_hits AS (SELECT * FROM rk WHERE rank <= 10),
qe AS (SELECT qid AS qk, bucket, w FROM qemb),
{S.mmr_ctes('doc_hits', 'qe', 'cemb')},
ctx AS (
  SELECT p.qid, string_agg({S.clean_qa('s.chunk_text')}, chr(10) || chr(10) ORDER BY p.pick) AS context
  FROM mmr_picks p JOIN store s USING (id) GROUP BY p.qid
)
SELECT conv_id, turn, 'error' AS kind, 'Empty prompt' AS text FROM req2 WHERE pc = ''
UNION ALL SELECT conv_id, turn, 'intent', intent_resp FROM req2 WHERE pc <> '' AND intent_resp IS NOT NULL
UNION ALL SELECT a.conv_id, a.turn, 'prompt', {_prompt_sql("coalesce(ctx.context, '')", 'a.pc')}
FROM ask a LEFT JOIN ctx USING (qid)"""


@register("rag_prompts", _rag_sql())
def q_rag_prompts(spark, sf):
    store = _store(spark, sf)
    req = _conv(spark, sf).filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    return jobs.rag_prompts(req, store, key=("conv_id", "turn"))


# ================================================================ sources and sinks (round trips)


@register("write_page_json", f"""WITH {_records_sql()}
  SELECT url, title, description, keywords, text, desc_divs, article_texts, links_abs AS links, images FROM latest""")
def q_write_page_json(spark, sf):
    path = scratch_path(spark, "pages-json")
    WR.write_pages(PG.page_records(_allpages(spark, sf)), path)
    back = RD.read_page_json(spark, path, multi_line=False)
    return back.select(
        "url", "title", F.col("meta.description").alias("description"), F.col("meta.keywords").alias("keywords"),
        F.array_join("text_lines", "\n").alias("text"), F.array_join("desc_divs", SEP).alias("desc_divs"),
        F.array_join("article_texts", SEP).alias("article_texts"), F.array_join("links", " ").alias("links"),
        F.array_join("images", " ").alias("images"))


@register("scan_page_json", f"""WITH {_records_sql()}
  SELECT url, title, CAST(len(text_list) AS BIGINT) AS n_text_lines, true AS ok FROM latest""")
def q_scan_page_json(spark, sf):
    path = scratch_path(spark, "pages-json")
    WR.write_pages(PG.page_records(_allpages(spark, sf)), path)
    back = RD.read_page_json(spark, path, multi_line=False)
    return back.select("url", "title", F.size("text_lines").cast("long").alias("n_text_lines"), "ok")


@register("write_feed", f"""WITH {SQL_ALLPAGES}
  SELECT url, {S.title('html')} AS title, {S.meta('html', 'description')} AS description,
         {S.meta('html', 'keywords')} AS keywords, array_to_string({S.element_text_lines(S.body('html'))}, chr(10)) AS text,
         array_to_string({S.attr_list('html', 'a', 'href')}, ' ') AS links,
         array_to_string({S.attr_list('html', 'img', 'src')}, ' ') AS images FROM allpages""")
def q_write_feed(spark, sf):
    path = scratch_path(spark, "feed")
    WR.write_feed(PG.feed_records(_allpages(spark, sf)), path)
    back = RD.read_page_json(spark, path, multi_line=False)
    return back.select(
        "url", "title", F.col("meta.description").alias("description"), F.col("meta.keywords").alias("keywords"),
        F.array_join("text_lines", "\n").alias("text"), F.array_join("links", " ").alias("links"),
        F.array_join("images", " ").alias("images"))


@register("select_text_source", f"""WITH {_records_sql()}
  SELECT 'page' AS src, page_id AS sid,
         CASE WHEN len(article_list) > 0 THEN array_to_string(article_list, ' ')
              WHEN len(text_list) > 0 THEN array_to_string(text_list, ' ') ELSE '' END AS raw_text FROM recs
  UNION ALL SELECT 'doc', doc_id, text FROM documents""")
def q_select_text_source(spark, sf):
    rec = PG.page_records(_allpages(spark, sf))
    pages = rec.select(F.lit("page").alias("src"), F.col("page_id").alias("sid"),
                       T.select_text_source(F.col("article_texts"), F.col("text_lines"), F.lit(None).cast("string")).alias("raw_text"))
    docs = table(spark, sf, "documents").select(F.lit("doc").alias("src"), F.col("doc_id").alias("sid"),
                                                T.select_text_source(F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>"),
                                                                     F.col("text")).alias("raw_text"))
    return pages.unionByName(docs)


@register("scan_chunk_metadata", f"""WITH {SQL_WORD_CHUNKS.strip()}
  SELECT id, 'doc-' || doc_id || '.json' AS file, chunk_text, {S.tags('chunk_text')} AS tags FROM store""")
def q_scan_chunk_metadata(spark, sf):
    path = scratch_path(spark, "chunks-json")
    st = _store(spark, sf)
    st.select("id", "file", "url", "title", "meta_description", "chunk_text", "tags").write.mode("overwrite").json(path)
    back = RD.read_chunks(spark, path, fmt="json", multi_line=False)
    return back.select("id", "file", "chunk_text", F.array_join("tags", ",").alias("tags"))


@register("versioned_store", f"""WITH {SQL_INC_VEC} SELECT CAST(1 AS BIGINT) AS version, id, chunk_hash, vec FROM final_vec
    WHERE id < (SELECT count(*) FROM r1) UNION ALL SELECT 2, id, chunk_hash, vec FROM final_vec""")
def q_versioned_store(spark, sf):
    """Two commits and a write that dies before its own: every version reads as it was committed."""
    root = scratch_path(spark, "versions")
    _, _, run1, run2 = _inc_runs(spark, sf)
    VS.write_version(run1, root)
    VS.write_version(run2, root)
    VS.stage(run1, root)
    parts = [VS.read_version(spark, root, v).select(F.lit(v).cast("long").alias("version"), "id", "chunk_hash", _vec().alias("vec")) for v in VS.versions(spark, root)]
    return functools.reduce(DataFrame.unionByName, parts)


@register("write_vector_store", f"WITH {SQL_INC_VEC} SELECT id, chunk_hash, vec FROM final_vec")
def q_write_vector_store(spark, sf):
    path = scratch_path(spark, "store")
    _, _, run1, run2 = _inc_runs(spark, sf)
    WR.write_store(run1, path, "overwrite")
    WR.write_store(run2, path, "append")
    return RD.read_chunks(spark, path).select("id", "chunk_hash", _vec().alias("vec"))


SQL_CACHE = f"""{S.sparse_embedding_cte('bemb', 'benchmark', 'text', 'text')}
  SELECT text AS query, CAST(384 AS BIGINT) AS dims, CAST(count(*) AS BIGINT) AS nnz,
         string_agg(bucket || ':' || CAST(floor(w * 1e6 + 0.5) AS BIGINT), ',' ORDER BY bucket) AS vec FROM bemb GROUP BY text"""


def _bench_cache(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("text").alias("query")).distinct()
    return embed.embed_text(b, "query", "embedding")


def _cache_out(df):
    return df.select("query", F.size("embedding").cast("long").alias("dims"),
                     F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("nnz"), _vec().alias("vec"))


@register("write_embedding_cache", f"WITH {SQL_CACHE}")
def q_write_embedding_cache(spark, sf):
    path = scratch_path(spark, "cache")
    WR.write_cache(_bench_cache(spark, sf), path)
    return _cache_out(spark.read.parquet(path))


@register("scan_embedding_cache", f"WITH {SQL_CACHE}")
def q_scan_embedding_cache(spark, sf):
    path = scratch_path(spark, "cache-json")
    WR.write_cache_json(_bench_cache(spark, sf), path)
    return _cache_out(RD.read_embedding_cache(spark, path, multi_line=False))


@register("ingest_pages", f"""WITH {_records_sql()}, src AS (
  SELECT url, title, description, row_number() OVER (ORDER BY page_id) - 1 AS doc_id,
         CASE WHEN len(article_list) > 0 THEN array_to_string(article_list, chr(10)) ELSE array_to_string(text_list, chr(10)) END AS raw
  FROM latest
), pdocs AS (
  SELECT doc_id, {S.words(S.clean('raw'))} AS w FROM src WHERE {S.clean('raw')} <> ''
), pchunks AS (
  SELECT doc_id, i AS chunk_pos, array_to_string(list_slice(w, i * {STEP} + 1, i * {STEP} + {MAXW}), ' ') AS chunk_text
  FROM (SELECT doc_id, w, unnest(range(0, CAST(floor((len(w) - 1) / {STEP}) AS BIGINT) + 1)) AS i FROM pdocs WHERE len(w) > 0)
), pfirst AS (
  SELECT * FROM pchunks QUALIFY row_number() OVER (PARTITION BY md5(chunk_text) ORDER BY doc_id, chunk_pos) = 1
)
SELECT row_number() OVER (ORDER BY f.doc_id, f.chunk_pos) - 1 AS id, s.url, s.title, s.description AS meta_description, f.chunk_text
FROM pfirst f JOIN src s USING (doc_id)""")
def q_ingest_pages(spark, sf):
    """Pages -> page records (C1) -> page JSON -> records (F5) -> chunks -> store, a folder for each page."""
    path = scratch_path(spark, "page-files")
    rec = PG.extract_pages(_allpages(spark, sf)).select("page_id", "url", "title", "meta", "text_lines", "article_texts")
    # the path gives the order of the sources
    rec.select(F.format_string("%012d", F.col("page_id") + 1_000_000).alias("page"), "*").drop("page_id").write.partitionBy("page").json(path)
    st = jobs.ingest_rebuild(jobs.records_from_page_json(RD.read_page_json(spark, path, multi_line=False)), MAXW, OVERLAP)
    return st.select("id", "url", "title", "meta_description", "chunk_text")


# ================================================================ streaming


@register("stream_ingest", f"WITH {SQL_INC_VEC} SELECT id, chunk_hash, vec FROM final_vec")
def q_stream_ingest(spark, sf):
    """Records arrive in two deliveries (the corpus, then the benchmark
    passages plus blank records); each run of the stream picks up only the
    new files and appends only unseen chunks."""
    src, store = scratch_path(spark, "ingest-src"), scratch_path(spark, "ingest-store")
    ckpt = scratch_path(spark, "ckpt-ingest")
    docs = table(spark, sf, "documents").select("doc_id", "text")
    more = table(spark, sf, "benchmark").select((F.lit(BENCH_DOC_OFFSET) + F.col("item_id")).alias("doc_id"), "text") \
        .unionByName(FX.BLANK_DOCS.df(spark))
    docs.write.mode("append").json(src)
    SJ.stream_ingest(spark, src, store, ckpt)
    more.write.mode("append").json(src)
    SJ.stream_ingest(spark, src, store, ckpt)
    return spark.read.parquet(store).select("id", "chunk_hash", _vec().alias("vec"))


STREAM_CAP = ADMISSION_CAP


@register("stream_query_cache", f"""WITH lg AS (SELECT event_id, event_type || '/' || user_id AS key FROM events),
  firsts AS (SELECT key, min(event_id) AS fst FROM lg GROUP BY key)
  SELECT key AS query, fst AS first_arrival FROM firsts ORDER BY fst, key LIMIT {STREAM_CAP}""")
def q_stream_query_cache(spark, sf):
    cache, _ = _replayed_requests(spark, sf)
    return spark.read.parquet(cache).select("query", "first_arrival")


def _replayed_requests(spark, sf, log=False):
    """(cache, hit log): the request log is delivered in four arrival-ordered files and replayed
    through the streaming cache, one file per micro-batch."""
    src, cache = scratch_path(spark, "requests"), scratch_path(spark, "qcache")
    hits = scratch_path(spark, "qhits") if log else None
    ev = table(spark, sf, "events", parallel=False).select(
        "event_id", F.concat_ws("/", "event_type", F.col("user_id").cast("string")).alias("key"))
    b = ev.agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi")).first()
    lo, hi, parts = int(b["lo"]), int(b["hi"]), 4
    step = (hi - lo) // parts + 1
    for i in range(parts):  # deliveries in arrival order; together they hold every request
        ev.filter((F.col("event_id") >= lo + i * step) & (F.col("event_id") < lo + (i + 1) * step)) \
            .coalesce(1).write.mode("append").parquet(src)
    SJ.stream_query_cache(spark, src, cache, cap=STREAM_CAP, max_files_per_trigger=1, hits_log=hits)
    return cache, hits


@register("stream_cache_log", f"""WITH lg AS (SELECT event_id, event_type || '/' || user_id AS key FROM events),
  firsts AS (SELECT key, min(event_id) AS fst FROM lg GROUP BY key),
  adm AS (SELECT key, fst FROM firsts ORDER BY fst, key LIMIT {STREAM_CAP}),
  {S.sparse_embedding_cte('qemb', 'adm', 'key', 'key')}
  SELECT l.event_id, l.key AS query, (a.key IS NOT NULL AND l.event_id > a.fst) AS hit, CASE WHEN a.key IS NOT NULL THEN coalesce(v.vec, '') END AS vec
  FROM lg l LEFT JOIN adm a USING (key) LEFT JOIN {_vec_sql('key', 'qemb')} v USING (key)""")
def q_stream_cache_log(spark, sf):
    """R2's hit log, with the vector that the cache holds for each request."""
    cache, hits = _replayed_requests(spark, sf, log=True)
    kept = spark.read.parquet(cache).select("query", _vec().alias("vec"))
    return spark.read.parquet(hits).select("event_id", "query", "hit").join(kept, "query", "left")


@register("context_concat", f"""WITH {SQL_DOC_SEARCH.strip()}
  SELECT h.qid, string_agg({S.clean_qa('s.chunk_text')}, chr(10) || chr(10) ORDER BY h.rank) AS context
  FROM doc_hits h JOIN store s USING (id) WHERE h.rank <= 4 GROUP BY h.qid""")
def q_context_concat(spark, sf):
    store = _store(spark, sf)
    best = jobs.search_topk(table(spark, sf, "benchmark"), store, k=10, n=4, qid="item_id", text="text",
                            carry=("chunk_text",))
    return D.context_concat(best.select("qid", "rank", T.clean_qa_lines("chunk_text").alias("chunk_text")))
