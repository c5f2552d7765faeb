"""Subword token counts (G4): greedy longest match of pieces in an Arrow step.

A word is cut from the left, each time at the longest piece of the vocabulary;
pieces after the first carry a prefix.  A word that can't be cut so is one
unknown token, as is one that is longer than ``longest``.  The vocabulary goes to tasks as a trie, so
a position costs the letters of the longest piece there; words already cut are
remembered by the Python worker up to a bound that changes no count.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the tokenizer: the mark of inner pieces, the longest word that is cut, the longest sequence.
INNER = "##"
LONGEST_WORD = 100
LIMIT = 512
VOCABULARY = 1_000_000
REMEMBERED = 100_000


def trie(pieces: Iterable[str]) -> dict:
    """Nested dicts by letter; the key ``""`` ends a piece."""
    root: dict = {}
    for piece in pieces:
        node = root
        for letter in piece:
            node = node.setdefault(letter, {})
        node[""] = True
    return root


def subword_counter(spark: SparkSession, vocabulary: Iterable[str], inner: str = INNER, limit: int = LIMIT,
                    longest: int = LONGEST_WORD) -> Callable[[Column], Column]:
    """A counter of arrays of sentences for ``chunk_sentences(..., measure=...)``: ``array<string>`` to ``array<int>``.

    Words are those between white space; a sentence counts at most ``limit``.  Null sentences count 0, a null array is null.
    ``vocabulary`` holds at most ``VOCABULARY`` pieces, which are broadcast.
    """
    pieces = set(vocabulary)
    if len(pieces) > VOCABULARY:
        raise ValueError(f"more than {VOCABULARY} pieces")
    first = trie(p for p in pieces if p and not p.startswith(inner))
    later = trie(p[len(inner):] for p in pieces if p.startswith(inner) and len(p) > len(inner))
    sent = spark.sparkContext.broadcast((first, later))

    @F.arrow_udf("array<int>")
    def count(texts: pa.Array) -> pa.Array:
        head, tail = sent.value
        known: dict[str, int] = {}

        def cut(word: str) -> int:
            if len(word) > longest:
                return 1
            at = n = 0
            while at < len(word):
                node, end, i = (tail if at else head), 0, at
                while i < len(word) and (node := node.get(word[i])) is not None:
                    i += 1
                    if "" in node:
                        end = i
                if not end:
                    return 1
                at, n = end, n + 1
            return n

        def tokens(sentence: str | None) -> int:
            total = 0
            for w in (sentence or "").split():
                if (n := known.get(w)) is None:
                    n = cut(w)
                    if len(known) < REMEMBERED:
                        known[w] = n
                total += n
            return min(limit, total)

        # one text at a time is in Python
        rows = (row.as_py() for row in texts)
        return pa.array([None if row is None else [tokens(s) for s in row] for row in rows], pa.list_(pa.int32()))

    return count


def count_subwords(df: DataFrame, vocabulary: Iterable[str], text: str = "text", out: str = "n_tokens", inner: str = INNER,
                   limit: int = LIMIT, longest: int = LONGEST_WORD) -> DataFrame:
    """The rows with the number of subword tokens of a text (null: 0), at most ``limit``."""
    counter = subword_counter(df.sparkSession, vocabulary, inner, limit, longest)
    return df.withColumn(out, counter(F.array(F.col(text)))[0])
