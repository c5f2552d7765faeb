import random

from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm.queries import ORACLE, QUERIES

import __spark_entry__ as entry
import messy


def test_queries_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert names["pipeline"] is corpus_pipeline.run
    assert set(ORACLE) <= set(QUERIES)


def test_stages_on_awkward_rows(spark, tmp_path):
    df = messy.table(spark)
    df.toDF(*df.columns[:-1], "more").write.parquet(f"{tmp_path}/documents.parquet")
    passage = " ".join(messy.rows()[4][1].split()[:40])
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, kept = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{i}")
        docs = spark.read.parquet(f"{tmp_path}/stage{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        kept.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    language, lines, near, clean, packed = kept
    assert {9, 10, 11, 15, 20}.isdisjoint(language) and {1, 12, 32} <= language
    assert lines == language
    assert 1 in near and not {2, 3, 4, 13} & near
    assert not {5, 8} & clean and {1, 12, 16, 32} <= clean
    assert packed == clean


def test_unlearned_scripts_are_rejected(spark):
    docs, rng = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), random.Random(1)
    scripts = ((0x4E00, 0x9000), (0x430, 0x450), (0x3B1, 0x3C9), (0x5D0, 0x5EA), (0x10D0, 0x10F0))
    texts = [" ".join("".join(chr(rng.randrange(*s)) for _ in range(rng.randint(2, 8))) for _ in range(n)) for s in scripts for n in (3, 20, 100) for _ in range(12)]
    other = spark.createDataFrame([(10**9 + i, t, None, "x", len(t)) for i, t in enumerate(texts)], docs.schema)
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs.unionByName(other), "").select("doc_id").collect()}
    assert len([i for i in kept if i >= 10**9]) <= 1
    letters = {r["doc_id"] for r in docs.where(F.col("text").rlike("[a-z]{3}")).select("doc_id").collect()}
    assert len(letters & kept) >= 0.99 * len(letters)
