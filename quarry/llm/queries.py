"""The registered opN queries: each applies its operator to its whole table and gives the contract's columns."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, exact_dedup, hpylm, jaccard_join, langid, license_scan, line_dedup, merkle, mtree, packing, sharding, spelling, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql.strip()
        return f

    return add


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public tokenizer files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


OP1_SQL = """
WITH l AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), w AS (
  SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS win
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l)
), r AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w
), c AS (
  SELECT DISTINCT doc_id, i + s.j AS i FROM r, (SELECT unnest([0, 1, 2]) AS j) s WHERE k > 1
), x AS (
  SELECT l.doc_id, p.i, l.ls[p.i] AS line, c.i IS NOT NULL AS gone,
         c.i IS NOT NULL AND lag(c.i) OVER (PARTITION BY l.doc_id ORDER BY p.i) IS NULL AS opens
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l) p
  JOIN l ON l.doc_id = p.doc_id LEFT JOIN c ON c.doc_id = p.doc_id AND c.i = p.i
)
SELECT d.doc_id, coalesce(max(len(l.ls)), 0)::BIGINT AS n_lines,
       coalesce(sum(gone::INT), 0)::BIGINT AS n_removed, coalesce(sum(opens::INT), 0)::BIGINT AS n_spans,
       CASE WHEN max(d.text) IS NOT NULL THEN coalesce(string_agg(line, chr(10) ORDER BY x.i) FILTER (WHERE NOT gone), '') END AS text
FROM documents d LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id
GROUP BY d.doc_id
"""


@query("op1_line_dedup", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "n_spans", "text")


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(read(spark, sf_dir, "documents"))


@query("op5_ring_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.ring_shards(read(spark, sf_dir, "documents"), shards=40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard"
    )


@query("op6_mixture_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path())


@query("op10_suffix_dedup")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_jaccard_join")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_groups(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP9_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e)
  WHERE q.vec_id % 20 = 0
)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
WHERE rank <= 20
"""


@query("op9_mtree_top_k", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_k(read(spark, sf_dir, "embeddings"))


@query("op4_decontaminate")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "start", "n_words", "hamming", "similarity")


@query("op7_hpylm_score")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hpylm.score(read(spark, sf_dir, "documents"))


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""


@query("op13_exact_dedup", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


#: unsigned crc32 of a text's UTF-8 bytes, bit by bit (reflected polynomial 0xEDB88320)
CRC_SQL = """
xor(list_reduce(list_prepend(4294967295::BIGINT, range(0, 8 * strlen({s}))), lambda c, i:
  CASE WHEN xor(c, CASE WHEN i % 8 = 0 THEN ('0x' || substr(hex(encode({s})), (i // 4 + 1)::BIGINT, 2))::BIGINT ELSE 0 END) % 2 = 1
       THEN xor(xor(c, CASE WHEN i % 8 = 0 THEN ('0x' || substr(hex(encode({s})), (i // 4 + 1)::BIGINT, 2))::BIGINT ELSE 0 END) // 2, 3988292384)
       ELSE xor(c, CASE WHEN i % 8 = 0 THEN ('0x' || substr(hex(encode({s})), (i // 4 + 1)::BIGINT, 2))::BIGINT ELSE 0 END) // 2 END), 4294967295)
""".strip()


def leaf_sql(text: str) -> str:
    def told(c: str) -> str:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c} END"

    return "sha256(" + " || ".join(told(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP11_SQL = f"""
WITH RECURSIVE r AS (
  SELECT doc_id, source, {leaf_sql("text")} AS leaf, {leaf_sql("replace(text, chr(10), '')")} AS cut,
         {CRC_SQL.format(s="doc_id::VARCHAR")} % 2 = 0 AS tampered,
         row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY source) AS n,
         dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree FROM documents
), a(tree, lev, idx, n, h) AS (
  SELECT tree, 0, idx, n, leaf FROM r
  UNION ALL
  SELECT tree, lev + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM a WHERE n > 1 GROUP BY tree, lev, idx // 3, n
), s AS (
  SELECT tree, lev AS top, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n FROM a WHERE n = 1
), b(lev, idx, n, h) AS (
  SELECT 0, idx, n, subroot FROM s
  UNION ALL
  SELECT lev + 1, idx // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY idx)) FROM b WHERE n > 1 GROUP BY lev, idx // 3, n
), whole AS (
  SELECT tree, lev, idx, n, h FROM a UNION ALL SELECT 0, lev, idx, n, h FROM b
), sib AS (
  SELECT tree, lev, idx, n,
         coalesce(string_agg(h, '') OVER (PARTITION BY tree, lev, idx // 3 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
         coalesce(string_agg(h, '') OVER (PARTITION BY tree, lev, idx // 3 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM whole WHERE n > 1
), f(doc_id, tree, lev, idx, n, h, proof) AS (
  SELECT doc_id, tree, 0, idx, n, CASE WHEN tampered THEN cut ELSE leaf END, '' FROM r
  UNION ALL
  SELECT f.doc_id, CASE WHEN f.n > 1 THEN f.tree ELSE 0 END, CASE WHEN f.n > 1 THEN f.lev + 1 ELSE 0 END,
         CASE WHEN f.n > 1 THEN f.idx // 3 ELSE s.idx END, CASE WHEN f.n > 1 THEN (f.n + 2) // 3 ELSE s.n END,
         CASE WHEN f.n > 1 THEN sha256(sib.l || f.h || sib.r) ELSE f.h END, CASE WHEN f.n > 1 THEN f.proof || sib.l || sib.r ELSE f.proof END
  FROM f LEFT JOIN sib ON sib.tree = f.tree AND sib.lev = f.lev AND sib.idx = f.idx LEFT JOIN s ON s.tree = f.tree
  WHERE f.n > 1 OR f.tree > 0
)
SELECT r.doc_id, r.leaf, s.subroot, b.h AS root, sha256(f.proof) AS proof_sha256, f.h AS folded_root, f.h = b.h AS verified
FROM r JOIN s ON s.tree = r.tree JOIN b ON b.n = 1 JOIN f ON f.doc_id = r.doc_id AND f.tree = 0 AND f.n = 1
"""


@query("op11_merkle_manifest", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    def tampered(doc_id, source, lang, n_chars, text):
        hit = F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0
        # only a text with a line break is another one after it
        changed = F.when(hit & F.contains(text, F.lit("\n")), F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
        return merkle.leaf_hash([doc_id, source, lang, n_chars, changed])

    proved = merkle.manifest(read(spark, sf_dir, "documents"), claims={"claimed": tampered})
    folded = proved.withColumn("folded", merkle.fold(F.col("claimed"), F.col("steps")))
    return folded.select(
        "doc_id",
        *[merkle.hexed(F.col(c)).alias(c) for c in ("leaf", "subroot", "root")],
        merkle.proof_hash(F.col("steps")).alias("proof_sha256"),
        merkle.hexed(F.col("folded")).alias("folded_root"),
        (F.col("folded") == F.col("root")).alias("verified"),
    )


OP12_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents
), d AS (
  SELECT run, n, {CRC_SQL.format(s="key")} AS h FROM (SELECT doc_id, run, doc_id || ':' || run AS key, count(*) AS n FROM runs GROUP BY doc_id, run)
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word, n FROM d
  ) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cut c JOIN v ON v.word = c.rest
  UNION SELECT v.word, c.word, c.n FROM cut c JOIN v ON v.word = c.rest
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, encode(other)) AS other, max(n) AS m FROM near GROUP BY word
), f AS (
  SELECT v.word, CASE WHEN m >= 2 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * n THEN m END AS form_n FROM v LEFT JOIN best USING (word)
), w(word, root) AS (
  SELECT word, word FROM f
  UNION ALL
  SELECT w.word, f.form FROM w JOIN f ON f.word = w.root WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, w.root, f.n, f.n_near, f.form_n FROM f JOIN w USING (word) JOIN f e ON e.word = w.root AND e.form IS NULL
"""


@query("op12_spelling_groups", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(read(spark, sf_dir, "documents"), noise=spelling.NOISE)
