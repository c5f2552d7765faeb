"""Exact substring dedup by a depth-limited radix sort of text windows.

A byte goes if a window of ``THRESHOLD`` bytes around it starts anywhere else
too.  Equal windows are found as a most-significant-digit radix sort finds
equal suffixes down to a depth: the first pass splits by a short digit, each
further pass splits only groups that still have two members by a longer one,
and no pass looks deeper than the threshold; groups left after the last digit
are exactly the repeated windows.

Not every window is a row.  The first digit of a window is its smallest
``DIGIT``-byte substring in hash order, the anchor.  Equal windows have equal
anchors at equal offsets, and neighbouring windows mostly share theirs, so
one row stands for a run of windows with one anchor:

* ``hi`` hashes the bytes that all windows of the run share (the digit): a run
  that is alone with its digit has no repeated window and leaves the sort.
* ``u`` hashes the bytes that any of them covers: runs with equal ``u`` have
  equal windows throughout and are taken whole.

What remains are open runs, at the edges of repeats.  They are cut into runs of
``STEP`` offsets and sorted by their longer digits, then into single windows,
whose digit is the whole window.  Of closed runs with an open run's digit, one
for each ``u`` goes along to be matched.  ``u`` has 128 bits; ``hi`` may collide, which
costs time only.

Scale: a pass shuffles narrow rows, about two for every ``THRESHOLD - DIGIT``
bytes of text in the first and fewer later; texts are shuffled to meet their
own rows.  Counts are pre-aggregated; joins are equi joins that adaptive
execution can split.  No group is gathered: a group is only counted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import pick, row_key, stored

THRESHOLD = 400
DIGIT = 128
STEP = 16
#: windows of a text that are looked at together
CHUNK = 1 << 18
_POSITION = np.uint64((1 << 20) - 1)
_RUN = "d long, t long, p long, first long, last long, hi long, u binary, open boolean"


class Anchors:
    """Runs of windows with one anchor."""

    def __init__(self, threshold: int, digit: int):
        n = CHUNK + threshold
        base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        self.threshold, self.digit = threshold, digit
        self.power = np.cumprod(np.full(n, base, dtype=np.uint64))
        self.back = np.cumprod(np.full(n, inverse, dtype=np.uint64))

    def hashes(self, data: np.ndarray) -> np.ndarray:
        """A mixed 64-bit hash of the ``digit`` bytes at every position."""
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.power[: len(data)], out=sums[1:])
        h = (sums[self.digit :] - sums[: -self.digit]) * self.back[: len(sums) - self.digit]
        for shift, factor in ((32, 0xD6E8FEB86659FD93), (29, 0xA0761D6478BD642F), (32, 0)):
            h ^= h >> np.uint64(shift)
            if factor:
                h *= np.uint64(factor)
        return h

    def runs(self, raw: bytes) -> Iterator[tuple[int, int, int, int]]:
        """(anchor, first window, last window, hash of the anchor's digit)."""
        total = len(raw) - self.threshold + 1
        width = self.threshold - self.digit + 1
        for lo in range(0, total, CHUNK):
            m = min(CHUNK, total - lo)
            h = self.hashes(np.frombuffer(raw, dtype=np.uint8, count=m + self.threshold - 1, offset=lo))
            # order by hash, then the leftmost; both depend on the window's content alone
            key = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
            full = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
            full[: len(key)] = key
            blocks = full.reshape(-1, width)
            ahead = np.minimum.accumulate(blocks, axis=1).ravel()
            behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
            at = (np.minimum(behind[:m], ahead[width - 1 : width - 1 + m]) & _POSITION).astype(np.int64)
            ends = np.flatnonzero(np.diff(at))
            firsts, lasts = np.concatenate(([0], ends + 1)), np.concatenate((ends, [m - 1]))
            p = at[firsts]
            yield from zip((p + lo).tolist(), (firsts + lo).tolist(), (lasts + lo).tolist(), h[p].view(np.int64).tolist(), strict=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 6 + [pa.binary(), pa.bool_()]
    cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["d", "t", "p", "first", "last", "hi", "u", "open"])


def _map(df: DataFrame, rows_of: Callable[[], Callable[..., Iterator[tuple]]], columns: list[str]) -> DataFrame:
    """Run rows from a function of the named columns, in batches of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, out = rows_of(), []
        for batch in batches:
            for args in zip(*[batch.column(c) for c in columns], strict=True):
                for row in f(*[a.as_py() for a in args]):
                    out.append(row)
                    if len(out) >= 20_000:
                        yield _batch(out)
                        out = []
        yield _batch(out)

    return df.mapInArrow(run, _RUN)


def first_pass(texts: DataFrame, threshold: int, digit: int) -> DataFrame:
    def rows_of():
        import xxhash

        anchors = Anchors(threshold, digit)

        def rows(d, t, raw):
            for p, first, last, hi in anchors.runs(raw):
                yield d, t, p, first, last, hi, xxhash.xxh3_128_digest(raw[first : last + threshold]), True

        return rows

    return _map(texts.where(F.octet_length("raw") >= threshold), rows_of, ["d", "t", "raw"])


def next_pass(texts: DataFrame, left: DataFrame, threshold: int, step: int) -> DataFrame:
    """The runs that are left, cut into runs of ``step`` offsets from their anchors, with their longer digits."""

    def rows_of():
        import xxhash

        def rows(d, t, raw, runs):
            for r in runs:
                p = r["p"]
                for k in range((p - r["last"]) // step, (p - r["first"]) // step + 1):
                    # windows start k * step ... k * step + step - 1 bytes before the anchor; all of them share start..stop
                    start, stop = p - k * step, p - k * step - step + 1 + threshold
                    first, last = max(r["first"], stop - threshold), min(r["last"], start)
                    hi = xxhash.xxh3_64_intdigest(raw[start:stop], seed=k)
                    yield d, t, p, first, last, hi - (1 << 63), xxhash.xxh3_128_digest(raw[first : last + threshold], seed=k), r["open"]

        return rows

    lists = left.groupBy("d", "t").agg(F.collect_set(F.struct("p", "first", "last", "open")).alias("runs"))
    return _map(texts.join(lists, ["d", "t"]), rows_of, ["d", "t", "raw", "runs"])


def sorted_out(runs: DataFrame, name: str) -> DataFrame:
    """Runs whose digit occurs twice, with ``whole``: all their windows are repeated."""
    twice = runs.groupBy("hi").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("hi")
    kept = runs.join(twice, "hi", "left_semi")
    equal = kept.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("u", F.lit(True).alias("whole"))
    return stored(kept.join(equal, "u", "left").withColumn("whole", F.coalesce("whole", F.lit(False))), name)


def for_next_pass(done: DataFrame) -> DataFrame:
    """Open runs that aren't whole, and of the others with the digit of such a run one for each ``u``."""
    run = F.struct("d", "t", "p", "first", "last")
    unsolved = done.where("open AND NOT whole")
    closed = done.where("whole OR NOT open").groupBy("u", "hi").agg(F.min(run).alias("r"))
    with_them = closed.join(unsolved.select("hi").distinct(), "hi", "left_semi").select("r.*", F.lit(False).alias("open"))
    return unsolved.select("d", "t", "p", "first", "last", "open").unionByName(with_them)


def repeated_spans(texts: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT, step: int = STEP) -> DataFrame:
    """(d, t, a, b): byte ranges of ``texts`` (d, t, raw) that repeated windows cover; they may overlap."""
    passes = [sorted_out(stored(first_pass(texts, threshold, digit), "runs"), "pass1")]
    left = stored(for_next_pass(passes[0]), "left")
    # the texts of the runs that are left, so that the next passes shuffle these alone
    near = stored(texts.join(left.select("d", "t").distinct(), ["d", "t"], "left_semi"), "edge_texts")
    passes.append(sorted_out(stored(next_pass(near, left, threshold, step), "runs"), "pass2"))
    left = stored(for_next_pass(passes[1]), "left")
    passes.append(sorted_out(stored(next_pass(near, left, threshold, 1), "runs"), "pass3"))
    out = None
    for p in passes:
        spans = p.where("open AND whole").select("d", "t", F.col("first").alias("a"), (F.col("last") + threshold).alias("b"))
        out = spans if out is None else out.unionByName(spans)
    return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and touching ranges joined."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(
    docs: DataFrame, threshold: int = THRESHOLD, digit: int = DIGIT, step: int = STEP, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, kept (binary: what is left of the UTF-8 bytes), n_bytes, n_removed, spans (array of start, stop).

    Null texts are empty; texts shorter than the threshold stay whole.  Rows
    with equal id and text are documents of their own: each is the other's
    repeat.  Columns other than id and text are not read.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    d, t = row_key(F.col("doc_id"), F.col("text"))
    texts = rows.select("doc_id", d.alias("d"), t.alias("t"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"))
    spans = repeated_spans(texts.select("d", "t", "raw"), threshold, digit, step)
    lists = spans.groupBy("d", "t").agg(F.collect_set(F.struct("a", "b")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 500):
                batch = whole.slice(lo, 500)
                kept, sizes, gone, found = [], [], [], []
                for raw, spans in zip(batch.column("raw").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                    cuts = merged([(s["a"], s["b"]) for s in spans or ()])
                    edges = [0, *[x for cut in cuts for x in cut], len(raw)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                    sizes.append(len(raw))
                    gone.append(len(raw) - len(kept[-1]))
                    found.append([{"start": a, "stop": b} for a, b in cuts])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))],
                    names=["doc_id", "kept", "n_bytes", "n_removed", "spans"],
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return texts.join(lists, ["d", "t"], "left").select("doc_id", "raw", "spans").mapInArrow(
        run, f"doc_id {kind}, kept binary, n_bytes long, n_removed long, spans array<struct<start: long, stop: long>>"
    )
