"""Sentences with learned abbreviations.

Abbreviations are learned without labels, after Kiss and Strunk (Computational
Linguistics 32:4, 2006): a type is one if it comes with a full stop nearly always
(a log-likelihood ratio against the corpus's rate of full stops), is short and
has stops inside; each occurrence without one counts against it.  Counts are one
aggregate over the corpus: words are counted as they are written, in every task
first, and each different word is looked at once.

A full stop after a learned abbreviation doesn't end a sentence; what follows it isn't looked at.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import text as T
from quarry.operators import chunking
from quarry.session import checkpoint_root

# Fixed values of the published method: the rate of full stops after an abbreviation, and the least score of one.
ABBREVIATION_RATE = 0.99
THRESHOLD = 0.3
# Up to this many abbreviations are part of the plan; more are joined.
LISTED = 1000
# Different words that a task counts before it passes them on.
COUNTED = 100_000

LETTERS = "A-Za-zÀ-ÿ"
CORE = rf"[{LETTERS}](?:[{LETTERS}.]*[{LETTERS}])?"
TOKEN = rf"^[^{LETTERS}0-9.]*({CORE})(\.?)[^{LETTERS}0-9.]*$"
PIECE = rf"(?s).+?(?:[.!?]{T.WS}+|\z)"
LAST = rf"(?s)^(?:.*{T.WS})?[^{LETTERS}0-9.]*({CORE})\.{T.WS}+$"


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(t, n)``: how often every word, as it is written, is in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["t", "n"])

        for batch in batches:
            for t in batch.column(0):
                seen.update((t.as_py() or "").split())
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
        yield out()

    return df.select(text).mapInArrow(run, "t string, n long").groupBy("t").agg(F.sum("n").alias("n"))


def abbreviation_types(df: DataFrame, text: str = "text", rate: float = ABBREVIATION_RATE) -> DataFrame:
    """``(type, n_stop, n_plain, score)`` for every lower-cased word type of the texts.

    Null and empty texts have no words; an empty table gives no rows.
    """
    parts = word_counts(df, text).select(F.lower(F.regexp_extract("t", TOKEN, 1)).alias("type"), F.regexp_extract("t", TOKEN, 2).alias("stop"), "n").where("type <> ''")
    # read for the rate and for the scores
    checkpoint_root(df.sparkSession)
    counts = parts.groupBy("type").agg(
        F.sum(F.when(F.col("stop") != "", F.col("n")).otherwise(0)).alias("n_stop"), F.sum(F.when(F.col("stop") == "", F.col("n")).otherwise(0)).alias("n_plain")).checkpoint()
    stops, plain = counts.agg(F.coalesce(F.sum("n_stop"), F.lit(0)), F.coalesce(F.sum("n_plain"), F.lit(0))).first()
    p = min(max(stops / max(stops + plain, 1), 1e-9), 1 - 1e-9)
    k, m = F.col("n_stop"), F.col("n_plain")
    ratio = -2.0 * (k * F.log(F.lit(p)) + m * F.log(F.lit(1 - p)) - k * F.log(F.lit(rate)) - m * F.log(F.lit(1 - rate)))
    letters = F.length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    inner = F.length("type") - letters + 1
    return counts.withColumn("score", ratio * F.exp(-letters) * inner * F.pow(letters.cast("double"), -m))


def learn_abbreviations(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(type, score)``: the types that are abbreviations."""
    return abbreviation_types(df, text).where((F.col("n_stop") > 0) & (F.col("score") >= threshold)).select("type", "score")


def _last_type(piece: Column) -> Column:
    """The lower-cased type in front of the full stop that ends a piece; empty if there is none."""
    return F.lower(F.regexp_extract(piece, LAST, 1))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas read it."""
    return F.transform(F.array(value), body)[0]


def split_with(text: Column, abbreviations: Column) -> Column:
    """Sentences of a text, none ended by a type of the array ``abbreviations``; stripped, empties dropped, null for null."""

    def join(b: Column) -> Column:
        n = F.size(b["p"])
        starts = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | ~F.element_at(b["joined"], F.greatest(i - 1, F.lit(1))))
        whole = _let(starts, lambda s: F.transform(
            s, lambda at, i: F.array_join(F.slice(b["p"], at, F.coalesce(F.try_element_at(s, i + 2), n + 1) - at), "")))
        return F.when(n > 0, whole).otherwise(F.array().cast("array<string>"))

    def pieces(p: Column) -> Column:
        flags = F.transform(p, lambda x: F.array_contains(abbreviations, _last_type(x)))
        return _let(F.struct(p.alias("p"), flags.alias("joined")), join)

    cut = _let(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)), pieces)
    return F.when(text.isNotNull(), F.filter(F.transform(cut, T.ustrip), lambda s: s != ""))


def abbreviation_splitter(abbreviations: Sequence[str]) -> Callable[[Column], Column]:
    """A splitter (G2) for ``chunk_sentences`` and ``explode_sentences`` that knows these types, at most ``LISTED``."""
    if len(abbreviations) > LISTED:
        raise ValueError(f"more than {LISTED} abbreviations: use split_sentences_learned")
    known = F.array(*[F.lit(a.lower()) for a in sorted(abbreviations)]).cast("array<string>")
    return lambda text: split_with(text, known)


def sentence_cutter(abbreviations: Sequence[str]) -> Callable[[str], list[str]]:
    """``split_with`` for one text and fixed types."""
    known = frozenset(abbreviations)
    ends, last = re.compile(rf"[.!?]{T.WS}+"), re.compile(rf"[^{LETTERS}0-9.]*({CORE})")

    def joined(piece: str) -> bool:
        """Whether a type that is known stands at the end of a piece, whose full stop is cut off."""
        m = None if piece[-1].isspace() else last.fullmatch(piece.rsplit(None, 1)[-1])
        return m is not None and m[1].lower() in known

    def cut(text: str) -> list[str]:
        out, start, at = [], 0, 0
        while at < len(text):
            m = ends.search(text, at + 1)
            if m is None:
                break
            if text[m.start()] != "." or not joined(text[at : m.start()]):
                out.append(text[start : m.end()])
                start = m.end()
            at = m.end()
        return [s for s in map(str.strip, [*out, text[start:]]) if s]

    return cut


def split_sentences_learned(df: DataFrame, abbreviations: DataFrame, text: str = "text", key: str = "doc_id", listed: int = LISTED) -> DataFrame:
    """``(key, sent_pos, sentence)`` of every row's text, given a table of abbreviations (``type``).

    Up to ``listed`` types go to the tasks.  If there are more, every text
    gets those of its own words by two joins; the sentences are the same.
    """
    found = [r["type"] for r in abbreviations.select("type").distinct().limit(listed + 1).collect()]
    docs = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"))
    if len(found) <= listed:
        return chunking.explode_parts(docs, "_t", ["_k"], sentence_cutter(found), "sent_pos", "sentence").withColumnRenamed("_k", key)
    ends = docs.select("_k", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("_t", F.lit(PIECE), F.lit(0)), _last_type))).alias("type"))
    own = ends.where("type <> ''").join(abbreviations.select("type").distinct(), "type").groupBy("_k").agg(F.collect_set("type").alias("_a"))
    met = docs.join(own.withColumnRenamed("_k", "_o"), F.col("_k").eqNullSafe(F.col("_o")), "left")
    met = met.withColumn("_a", F.coalesce("_a", F.array().cast("array<string>")))
    cut = met.select("_k", split_with(F.col("_t"), F.col("_a")).alias("_s"))
    return cut.select(F.col("_k").alias(key), F.posexplode("_s").alias("sent_pos", "sentence"))
