"""Spelling variants: words that differ by one inserted, deleted or replaced letter.

Two such words have letter counts at a squared distance of at most two, and
lengths that differ by one at most.  Words are put into blocks by their length,
and within it by how many letters they have of each of ``GROUPS`` groups of the
alphabet; one edit moves a word to the same block, one letter from group to
group, or one letter more or less in one group, so only such adjacent blocks
meet.  A NumPy product of two blocks' letter-count matrices (a Gram matrix) gives
the squared distances of all their words; pairs at most two apart are verified
letter by letter.

Every pair of blocks gives at most one row per word: how many near words it
found there and the most frequent of them.  Near pairs themselves are never
written.

Scale: words are counted per task before they are shuffled.  A block with too
many words or letters is dealt into pieces by hash, and pieces meet in an equi
join, so a matrix is bounded whatever the vocabulary.  Forms lead to words at least
twice as frequent, so they end after the logarithm of the largest count; roots
are found by doubling steps.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import pick, stored

LETTERS = "A-Za-zÀ-ÿ"
#: code points and occurrences a word has at least
MIN_LENGTH, MIN_COUNT = 5, 3
#: one word in so many of a document is noised
NOISE = 97
#: groups of letters: a letter's group is its code point modulo this
GROUPS = 5
#: words and letters of a piece of a block
PIECE_WORDS, PIECE_LETTERS = 1024, 1 << 16
#: different words a task counts before it passes them on
TASK_WORDS = 1 << 19
#: characters of a text that are split into words at a time
SPAN = 1 << 20


def spans(text: str, size: int = SPAN) -> Iterator[str]:
    """A text in parts of about ``size`` that end behind a run of letters."""
    gap, lo = re.compile(f"[^{LETTERS}]"), 0
    while lo < len(text):
        cut = gap.search(text, lo + size)
        hi = cut.start() if cut else len(text)
        yield text[lo:hi]
        lo = hi


def noised(word: str, crc: int, noise: int) -> str:
    """The word without one letter, if ``noise`` divides the checksum."""
    if not noise or crc % noise:
        return word
    at = crc % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, id_col: str, text_col: str, noise: int, min_length: int, min_count: int) -> DataFrame:
    """(word, n): words of enough letters and occurrences over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, total = re.compile(f"[{LETTERS}]+"), {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for key, raw in zip(batch.column("key"), batch.column("raw"), strict=True):
                start = zlib.crc32(key.as_py() + b":")
                for span in spans(raw.as_py().lower().decode("utf-8", "replace")):
                    here: dict[str, int] = {}
                    for w in runs.findall(span):
                        here[w] = here.get(w, 0) + 1
                    for w, n in here.items():
                        w = noised(w, zlib.crc32(w.encode(), start), noise)
                        if len(w) >= min_length:
                            total[w] = total.get(w, 0) + n
                if len(total) >= TASK_WORDS:
                    yield flush()
                    total.clear()
        yield flush()

    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary").alias("key")
    rows = pick(docs, doc_id=id_col, text=text_col).where(F.col("text").isNotNull()).select(key, F.col("text").cast("binary").alias("raw"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)


def alphabet() -> str:
    """All letters a counted word can have: those of ``LETTERS`` after A-Z are lowered."""
    return "".join(chr(c) for c in [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)])


def block_of(word: Column) -> Column:
    """How many letters of each group a word has; they add up to its length."""
    groups = ["".join(c for c in alphabet() if ord(c) % GROUPS == g) for g in range(GROUPS)]
    return F.array(*[F.length(word) - F.length(F.translate(word, g, "")) for g in groups])


def adjacent(block: Column) -> Column:
    """Blocks that hold words one edit away from a block's: itself, those of words one letter longer, and of the blocks of its length those that sort behind it."""

    def changed(more: int, fewer: int | None = None) -> Column:
        return F.array(*[block[g] + F.lit(int(g == more) - int(g == fewer)) for g in range(GROUPS)])

    longer = [changed(g) for g in range(GROUPS)]
    moved = [F.when(block[g] > 0, changed(more, g)) for g in range(GROUPS) for more in range(g)]
    return F.array_compact(F.array(block, *longer, *moved))


def pieces(words: DataFrame, piece_words: int, piece_letters: int) -> DataFrame:
    """(block, piece, of, length, raw, ns): the words of a block, dealt over ``of`` pieces by hash.

    ``raw`` holds the words in their order, one byte a letter.
    """
    dealt = words.select("word", "n", block_of(F.col("word")).alias("block"))
    size = F.greatest(F.ceil(F.count(F.lit(1)) / piece_words), F.ceil(F.sum(F.length("word")) / piece_letters))
    counts = dealt.groupBy("block").agg(size.alias("of"))
    rows = dealt.join(counts, "block").withColumn("piece", F.pmod(F.xxhash64("word"), "of"))
    held = rows.groupBy("block", "piece", "of").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("w"))
    raw = F.encode(F.array_join("w.word", ""), "ISO-8859-1")
    return held.select("block", "piece", "of", F.length(F.col("w")[0]["word"]).alias("length"), raw.alias("raw"), F.col("w.n").alias("ns"))


class Piece:
    """Words of one length as rows of letters, with their letter counts and squared norms."""

    def __init__(self, length: int, raw: bytes, ns: np.ndarray):
        self.letters = np.frombuffer(raw, dtype=np.uint8).reshape(-1, length)
        self.ns, m = ns, len(self.letters)
        at = np.arange(m)[:, None] * 256 + self.letters
        # counts below 2,048 keep all sums exact in 32 bits
        self.counts = np.bincount(at.ravel(), minlength=m * 256).reshape(m, 256).astype(np.float32 if length < 2048 else np.float64)
        self.squares = (self.counts**2).sum(axis=1)
        self.used = self.counts.any(axis=0)
        # places in the order (largest n, smallest word); rows are in the order of words
        self.rank = np.empty(m, dtype=np.int64)
        self.order = np.argsort(-ns, kind="stable")
        self.rank[self.order] = np.arange(m)

    def word(self, row: int) -> str:
        return self.letters[row].tobytes().decode("latin-1")


def near(a: Piece, b: Piece, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``a`` and ``b`` whose words are one edit apart; ``b`` has ``a``'s length or one letter more."""
    cols = a.used | b.used
    gram = a.counts[:, cols] @ b.counts[:, cols].T
    apart = a.squares[:, None] + b.squares[None, :] - 2 * gram
    # at distance zero are anagrams, which one edit can't make of each other
    i, j = np.nonzero((apart > 0) & (apart <= 2))
    if same:
        i, j = i[i < j], j[i < j]
    length, found = a.letters.shape[1], []
    step = max(1, (1 << 22) // length)
    for lo in range(0, len(i), step):
        x, y = a.letters[i[lo : lo + step]], b.letters[j[lo : lo + step]]
        if y.shape[1] == length:
            found.append((x != y).sum(axis=1) == 1)
        else:
            front = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
            back = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            found.append(front + back >= length)
    ok = np.concatenate(found) if found else np.zeros(0, dtype=bool)
    return i[ok], j[ok]


def near_words(met: DataFrame) -> DataFrame:
    """(word, near, best_n, best): per word and pair of pieces how many near words there are, and the first of them by (largest n, word).

    ``met`` has of two pieces length, raw and ns, and those of the other with ``2`` behind; ``same`` tells that they are one.
    """

    def told(a: Piece, b: Piece, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[str, int, int, str]]:
        n = np.bincount(i, minlength=len(a.ns))
        best = np.full(len(a.ns), len(b.ns))
        np.minimum.at(best, i, b.rank[j])
        for row in np.flatnonzero(n).tolist():
            at = b.order[best[row]]
            yield a.word(row), int(n[row]), int(b.ns[at]), b.word(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, Piece | None] = (b"", None)
        for batch in batches:
            for k in range(batch.num_rows):
                length, raw, length2, raw2, same = (batch.column(c)[k].as_py() for c in ("length", "raw", "length2", "raw2", "same"))
                if raw != last[0]:
                    last = (raw, Piece(length, raw, batch.column("ns")[k].values.to_numpy()))
                a = last[1]
                b = a if same else Piece(length2, raw2, batch.column("ns2")[k].values.to_numpy())
                i, j = near(a, b, same)
                if len(i) and same:
                    rows = [*told(a, a, np.concatenate((i, j)), np.concatenate((j, i)))]
                elif len(i):
                    rows = [*told(a, b, i, j), *told(b, a, j, i)]
                else:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["word", "near", "best_n", "best"])

    return met.mapInArrow(run, "word string, near long, best_n long, best string")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the rows of ``forms`` (word, form): where following forms ends.

    Every round doubles the steps taken; a word that has reached a word without
    a form leaves the rounds.
    """
    names = ["word", "at"]
    left, done = stored(forms.toDF(*names), "spelling-forms"), []
    while not left.isEmpty():
        reached = reduce(DataFrame.unionAll, done, left).toDF("w", "next")
        step = stored(left.join(reached, F.col("at") == F.col("w"), "left").select("word", F.coalesce("next", "at").alias("at"), F.col("next").isNull().alias("end")), "spelling-steps")
        done.append(step.where("end").select(*names))
        left = step.where(~F.col("end")).select(*names)
    return reduce(DataFrame.unionAll, done, left).toDF("word", "root")


def spelling_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    noise: int = 0,
    min_length: int = MIN_LENGTH,
    min_count: int = MIN_COUNT,
    piece_words: int = PIECE_WORDS,
    piece_letters: int = PIECE_LETTERS,
) -> DataFrame:
    """word, form, root, n, n_near and form_n for every word of the texts.

    A word is a longest run of letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z
    lowered; with ``noise``, one letter is deleted from the runs whose checksum
    with the id it divides (a null id counts as the text ``null``).  Words have
    at least ``min_length`` letters and ``min_count`` occurrences.  The form is
    the near word with the largest n, of ties the smallest, if that is at least
    twice the word's n.  Null and empty texts have no words; repeated rows count
    each; very long texts are read in spans, very long words meet in small
    pieces.  An empty table gives no rows; other columns are not read.
    """
    words = stored(word_counts(docs, id_col, text_col, noise, min_length, min_count), "spelling-words")
    held = stored(pieces(words, piece_words, piece_letters), "spelling-pieces")
    sizes = held.select("block", "of").distinct()
    others = sizes.select(F.explode(adjacent(F.col("block"))).alias("block2"), "block", "of").join(sizes.toDF("block2", "of2"), "block2")
    pairs = others.select("block", "block2", "of2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of") - 1)).alias("piece")).select(
        "block", "piece", "block2", F.explode(F.sequence(F.lit(0).cast("long"), F.col("of2") - 1)).alias("piece2")
    )
    pairs = pairs.where((F.col("block") != F.col("block2")) | (F.col("piece") <= F.col("piece2")))
    body = held.select("block", "piece", "length", "raw", "ns")
    same = ((F.col("block") == F.col("block2")) & (F.col("piece") == F.col("piece2"))).alias("same")
    met = pairs.join(body, ["block", "piece"]).join(body.toDF(*[f"{c}2" for c in body.columns]), ["block2", "piece2"])
    found = near_words(met.select("length", "raw", "ns", "length2", "raw2", "ns2", same))
    best = found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w"))).alias("b"))
    frequent = -F.col("b.n") >= 2 * F.col("n")
    told = stored(
        words.join(best, "word", "left").select(
            "word", F.when(frequent, F.col("b.w")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(frequent, -F.col("b.n")).alias("form_n")
        ),
        "spelling-told",
    )
    ends = roots(told.where("form IS NOT NULL").select("word", "form"))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
