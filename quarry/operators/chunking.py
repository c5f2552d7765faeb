"""Chunking operators.

All chunking is per row (one document at a time) with higher-order functions, or
in an Arrow step where these would run a pattern for every sentence: no shuffle,
and the exploded rows carry only keys and the chunk text, never a copy of the
source document.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from quarry.functions import text as T

# Letters of the texts whose parts a task holds at a time.
LETTERS = 1 << 20


def chunk_words(
    df: DataFrame,
    text: str = "text",
    keys: Sequence[str] = ("doc_id",),
    max_words: int = 150,
    overlap: int = 10,
) -> DataFrame:
    """G1: sliding word windows of ``max_words`` words advancing by
    ``max_words - overlap``; trailing short windows are kept.

    Returns ``keys + (chunk_pos int, chunk_text string)``.
    """
    step = max_words - overlap
    if step <= 0:
        raise ValueError("overlap must be less than max_words")
    # words live in their own column so the window lambda reads them, not re-splits
    w = df.select(*keys, T.usplit_words(F.col(text)).alias("_w"))
    n = F.size("_w")
    windows = F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")),
        lambda i: F.array_join(F.slice("_w", i * step + 1, max_words), " "),
    )
    return w.select(*keys, F.posexplode(F.when(n > 0, windows)).alias("chunk_pos", "chunk_text"))


def sentence_spans(
    sentences: Column,
    limit: int = 512,
    counter: Callable[[Column], Column] | None = None,
    counts: Column | None = None,
) -> Column:
    """G3 core: greedy packing of sentences into chunks of at most ``limit``
    tokens (a sentence counts at most ``limit``).  ``counts``: the sentences'
    token counts, where they aren't to be had sentence by sentence.

    The fold runs over an array of ints (token counts) and its state keeps only
    the 1-based start position of every chunk, so a long text costs a step per
    sentence and an array append per chunk.  Returns the start positions
    (array<int>, increasing).
    """
    count = counter or (lambda s: T.count_tokens(s, limit))
    lens = F.transform(sentences, count) if counts is None else counts
    lens = F.transform(lens, lambda n: F.least(F.lit(limit), n))
    init = F.struct(F.lit(0).alias("cur"), F.lit(0).alias("pos"), F.array().cast("array<int>").alias("starts"))

    def step(acc, ln):
        pos = acc["pos"] + 1
        new_chunk = (F.size(acc["starts"]) == 0) | (acc["cur"] + ln > limit)
        return F.struct(
            F.when(new_chunk, ln).otherwise(acc["cur"] + ln).alias("cur"),
            pos.alias("pos"),
            F.when(new_chunk, F.array_append(acc["starts"], pos)).otherwise(acc["starts"]).alias("starts"),
        )

    return F.aggregate(lens, init, step)["starts"]


def spans_to_chunks(sentences: Column, starts: Column) -> Column:
    """Join the sentences of each chunk (chunk c spans starts[c] .. starts[c+1]-1)."""
    n = F.size(sentences)
    return F.transform(
        starts,
        lambda st, i: F.array_join(
            F.slice(sentences, st, F.coalesce(F.try_element_at(starts, i + 2), n + 1) - st), " "),
    )


def explode_parts(df: DataFrame, text: str, keys: Sequence[str], cut: Callable[[str], list[str]], pos: str, out: str) -> DataFrame:
    """``keys + (pos int, out string)``: the parts that ``cut`` makes of every row's text, none of a null one."""
    keys = list(keys)
    rows = df.select(*keys, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, at, parts, size = [], [], [], 0
            for i in range(batch.num_rows):
                t = batch.column(len(keys))[i].as_py()
                if t is not None:
                    found = cut(t)
                    of.extend([i] * len(found))
                    at.extend(range(len(found)))
                    parts.extend(found)
                    size += len(t)
                if size > LETTERS or i == batch.num_rows - 1:
                    index = pa.array(of, pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*[batch.column(k).take(index) for k in range(len(keys))], pa.array(at, pa.int32()), pa.array(parts, pa.string())], names=[*keys, pos, out])
                    of, at, parts, size = [], [], [], 0

    schema = ST.StructType([*rows.schema.fields[:-1], ST.StructField(pos, ST.IntegerType()), ST.StructField(out, ST.StringType())])
    return rows.mapInArrow(run, schema)


def sentence_packer(limit: int) -> Callable[[str], list[str]]:
    """G2, G4 and G3 for one text: what ``split_sentences``, ``count_tokens`` and ``sentence_spans`` give (Python's
    white space is ``T.WS``)."""
    ends = re.compile(rf"[.!?]{T.WS}+")

    def pack(text: str) -> list[str]:
        chunks, cur, at = [], 0, 0
        for stop, after in [*[(m.start() + 1, m.end()) for m in ends.finditer(text)], (len(text), len(text))]:
            sentence, at = text[at:stop].strip(), after
            if not sentence:
                continue
            n = min(limit, len(sentence.split()))
            if not chunks or cur + n > limit:
                chunks.append([])
                cur = 0
            chunks[-1].append(sentence)
            cur += n
        return [" ".join(c) for c in chunks]

    return pack


def chunk_sentences(
    df: DataFrame,
    text: str = "text",
    keys: Sequence[str] = ("doc_id",),
    limit: int = 512,
    splitter: Callable[[Column], Column] = T.split_sentences,
    counter: Callable[[Column], Column] | None = None,
    measure: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Sentence split (G2) -> token counts (G4) -> greedy packing.

    ``counter`` counts a sentence inside a lambda; ``measure`` counts all sentences of
    a text at once (Arrow steps can't run in lambdas).

    Returns ``keys + (chunk_pos int, chunk_text string)``; chunk texts are
    stripped and empty ones dropped.
    """
    if splitter is T.split_sentences and counter is None and measure is None:
        return explode_parts(df, text, keys, sentence_packer(limit), "chunk_pos", "chunk_text")
    # stage the arrays in their own projections: a lambda that reads a column
    # does not re-run the splitter or the fold per chunk
    st = df.select(*keys, splitter(F.col(text)).alias("_s"))
    if measure is not None:
        st = st.withColumn("_n", measure(F.col("_s")))
    counts = F.col("_n") if measure is not None else None
    st = st.select(*keys, "_s", sentence_spans(F.col("_s"), limit, counter, counts).alias("_starts"))
    chunks = F.when(F.size("_s") > 0, spans_to_chunks(F.col("_s"), F.col("_starts")))
    return (
        st.select(*keys, F.posexplode(chunks).alias("chunk_pos", "chunk_text"))
        .withColumn("chunk_text", T.ustrip(F.col("chunk_text")))
        .filter(F.col("chunk_text") != "")
    )


def explode_sentences(df: DataFrame, text: str = "text", keys: Sequence[str] = ("doc_id",),
                      splitter: Callable[[Column], Column] = T.split_sentences) -> DataFrame:
    """G2 as rows: ``keys + (sent_pos int, sentence string)``."""
    return df.select(*keys, F.posexplode(splitter(F.col(text))).alias("sent_pos", "sentence"))
