"""The corpus pipeline: language ID, line dedup, near-duplicate removal, decontamination, packing.

``STAGES`` lists (name, function); every function takes (spark, docs, sf_dir)
and returns a DataFrame that is written as Parquet and read again as the next
stage's documents.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, jaccard_join, langid, line_dedup, packing
from quarry.llm.common import stored
from quarry.llm.queries import read, tokenizer_path

#: the share of texts with no trigram of a learned language that may pass
UNLEARNED = 1e-3


def min_language_score(labels: int) -> float:
    """The best of so many cosines that noise alone passes only ``UNLEARNED`` of the time.

    The cosine of a text that shares no trigram with a prototype has deviation
    1 / sqrt(``DIMS``).
    """
    return NormalDist().inv_cdf(1 - UNLEARNED / labels) / math.sqrt(langid.DIMS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in a learned language; null texts and texts without a letter go.

    A text is rejected too if its best cosine is below ``min_language_score``.
    Where no row has a label, nothing can be learned and nothing is rejected.
    """
    protos = langid.learned(docs)
    if not protos:
        return docs
    out = langid.predict(docs, protos)
    n = len(docs.columns)
    named = out.toDF(*[f"c{i}" for i in range(n)], "lang_pred", "score")
    return named.where((F.col("lang_pred") != langid.UND) & (F.col("score") >= min_language_score(len(protos)))).drop("lang_pred", "score").toDF(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of repeated three-line windows; n_chars follows the text."""
    out = line_dedup.line_dedup(docs)
    n = len(docs.columns)
    named = out.toDF(*[f"c{i}" for i in range(n)], "n_lines", "n_removed", "n_spans")
    text = f"c{docs.columns.index('text')}"
    cols = [F.length(text).cast("long").alias(f"c{i}") if c == "n_chars" else F.col(f"c{i}") for i, c in enumerate(docs.columns)]
    return named.select(*cols).toDF(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of every group that shingle links connect; texts without words stay."""
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no item of the benchmark table."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: language ID, shingle joins, fingerprints and tokens aren't SQL: tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
