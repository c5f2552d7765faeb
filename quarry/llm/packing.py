"""Mixture-controlled packing by deficit round-robin over source queues.

Each source is a queue of tokens, its documents laid end to end.  A window is a
sequence of ``LENGTH`` tokens.  In every window each queue is owed its target
share; it takes whole tokens, and the fraction it is still owed is its deficit,
carried into the next window.  The largest queue is served last and fills the
window up, so every window is full.  When r tokens are left in all, floor(r x share)
are left of a queue, exactly what adding up quanta and deficits from the end
gives; so every task knows the schedule from the queue totals alone, and
deficits carry over partitions without passing a counter along.

Scale: texts are tokenized once and the ids written to the shared folder.
Queues are laid out by partition, so no document moves: only token counts per
(partition, source) are added up, and the pieces follow by arithmetic.
"""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import pick, stored

LENGTH = 2048
END_ID = 1
#: queues; sources beyond the largest share the last one, where they take turns document by document.  LENGTH / QUEUES tokens are more than the roundings of a window.
QUEUES = 40
#: words whose ids a Python worker remembers, and the longest of them in bytes
MEMO_WORDS, MEMO_BYTES = 1_000_000, 64


class WordIds:
    """Token ids of texts by words between ASCII white space, which the tokenizer drops; each new word is encoded once.

    The tokenizer lowers letters and parts punctuation from letters and digits,
    so words are remembered in lower case and without one full stop or comma at
    their end.  Values are little-endian 16- or 32-bit ids.
    """

    #: a word of its own, between words that are encoded together
    BETWEEN = b"\x01"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tok.get_vocab_size() <= 0x10000 else "<u4"
        self.memo: dict[bytes, bytes] = {}
        self.between = self.ids(self.BETWEEN.decode())
        suffix = getattr(self.tok.model, "end_of_word_suffix", None)
        self.last = np.zeros(self.tok.get_vocab_size(), dtype=bool)
        if suffix:
            self.last[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True
        self.stops = {c: self.ids(chr(c)).tobytes() for c in b".,"}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)

    def cut(self, words: list[str], glue: str, ends: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]) -> Iterator[bytes]:
        """Ids of words that are encoded together; ``ends`` gives the stops and starts of their ids."""
        width = np.dtype(self.kind).itemsize
        for lo in range(0, len(words), 512):
            part = words[lo : lo + 512]
            ids = self.ids(glue.join(part))
            stops, starts = ends(ids)
            if len(starts) != len(part):
                yield from (self.ids(w).tobytes() for w in part)
                continue
            raw = ids.tobytes()
            yield from (raw[a:b] for a, b in zip((starts * width).tolist(), (stops * width).tolist(), strict=True))

    def by_suffix(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stops = np.flatnonzero(self.last[ids]) + 1
        return stops, np.concatenate(([0], stops[:-1]))

    def by_separator(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(ids == self.between[0])
        return np.append(at, len(ids)), np.concatenate(([0], at + 1))

    def learn(self, words: set[bytes]) -> None:
        memo, stops = self.memo, self.stops
        ends = {w: w[:-1] for w in words if w[-1] in stops and w[-2:-1].isalnum()}
        cores = {w for w in {*(words - ends.keys()), *ends.values()} if w not in memo}
        texts = {w: w.decode("utf-8") for w in cores}
        # letters alone are one run, whose last id has the end-of-word suffix
        letters = [w for w, x in texts.items() if x.isalpha()]
        others = [w for w, x in texts.items() if not x.isalpha() and self.BETWEEN not in w]
        memo.update(zip(letters, self.cut([texts[w] for w in letters], " ", self.by_suffix), strict=True))
        memo.update(zip(others, self.cut([texts[w] for w in others], f" {self.BETWEEN.decode()} ", self.by_separator), strict=True))
        memo.update((w, self.ids(x).tobytes()) for w, x in texts.items() if self.BETWEEN in w)
        for w, core in ends.items():
            memo[w] = memo[core] + stops[w[-1]]

    def texts(self, raws: list[bytes]) -> list[bytes]:
        """Ids of every text."""
        split = [raw.lower().split() for raw in raws]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new: set[bytes] = set()
        for words in split:
            new.update(words)
        new = {w for w in new if w not in self.memo}
        self.learn(new)
        out = [b"".join(map(self.memo.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > MEMO_BYTES:
                del self.memo[w]
        return out


def worker_words(path: str) -> WordIds:
    """The words of a tokenizer that this Python worker knows, kept for its next tasks."""
    kept = sys.modules.setdefault("_packing_words", types.ModuleType("_packing_words")).__dict__
    if path not in kept:
        kept[path] = WordIds(path)
    return kept[path]


def token_table(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, source key, pid, start in (pid, source), n, ids), written once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pid, at = worker_words(tokenizer), TaskContext.get().partitionId(), {}
        end = np.array([END_ID], dtype=words.kind).tobytes()
        width = len(end)
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                ids = [x + end for x in words.texts([x or b"" for x in batch.column("raw").to_pylist()])]
                starts, ns = [], []
                for key, x in zip(batch.column("skey").to_pylist(), ids, strict=True):
                    starts.append(at.get(key, 0))
                    ns.append(len(x) // width)
                    at[key] = starts[-1] + ns[-1]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("skey"), pa.array([pid] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(ns, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "skey", "pid", "start", "n", "ids"],
                )

    rows = pick(docs, doc_id="doc_id", text="text", source="source").select(
        "doc_id", F.col("text").cast("binary").alias("raw"), F.xxhash64(F.col("source").cast("string")).alias("skey")
    )
    return stored(rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, skey long, pid int, start long, n long, ids binary"), "tokens")


def phases(totals: list[int], weights: list[int], length: int) -> list[tuple[int, list[int]]]:
    """(first window, tokens per queue) of stretches in which the targets can be kept.

    With weights equal to the totals there is one stretch.  Else a stretch ends
    where a queue runs dry; that window is topped up from the others, and the
    targets go on among the queues that are left.
    """
    left, first, out = list(totals), 0, []
    while any(left):
        live = [j for j, n in enumerate(left) if n]
        w = {j: max(1, weights[j]) for j in live}
        all_w, rest = sum(w.values()), sum(left)
        if all(left[j] * all_w == rest * w[j] for j in live):
            take = left
        else:
            most = min(left[j] * all_w // w[j] for j in live) // length * length
            fill = most or min(length, rest)
            take = [0] * len(left)
            for j in live:
                take[j] = min(left[j], fill * w[j] // all_w)
            for j in sorted(live, key=lambda j: -w[j]):
                take[j] += min(left[j] - take[j], fill - sum(take))
        out.append((first, list(take)))
        first += -(-sum(take) // length)
        left = [a - b for a, b in zip(left, take, strict=True)]
    return out


class Schedule:
    """Which tokens of which queue a window holds."""

    def __init__(self, plan: list[tuple[int, list[int]]], length: int):
        self.plan, self.length = plan, length
        self.before: list[list[int]] = []  # tokens per queue before each phase
        done = [0] * len(plan[0][1]) if plan else []
        for _, take in plan:
            self.before.append(done)
            done = [a + b for a, b in zip(done, take, strict=True)]
        self.memo: dict[int, list[int]] = {}

    def phase_of(self, window: int) -> int:
        lo, hi = 0, len(self.plan)
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.plan[mid][0] <= window else (lo, mid)
        return lo

    def taken(self, window: int) -> list[int]:
        """Tokens each queue has given before ``window``."""
        if window not in self.memo:
            if len(self.memo) > 50_000:
                self.memo.clear()
            k = self.phase_of(window)
            first, take = self.plan[k]
            total = sum(take)
            rest = max(total - (window - first) * self.length, 0)
            big = max(range(len(take)), key=take.__getitem__)
            # rounded from the end, so what is left of a queue never grows, nor in a short last window
            part = [t - rest * t // total for t in take]
            part[big] += total - rest - sum(part)
            self.memo[window] = [a + b for a, b in zip(self.before[k], part, strict=True)]
        return self.memo[window]

    def windows(self) -> int:
        return self.plan[-1][0] + -(-sum(self.plan[-1][1]) // self.length)

    def find(self, queue: int, token: int) -> int:
        """The window that holds a queue's token."""
        lo, hi = 0, self.windows()
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.taken(mid)[queue] <= token else (lo, mid)
        return lo

    def pieces(self, queue: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """(offset in the document, length, window, offset in the window) of a queue's tokens start..start+n."""
        at, window = start, self.find(queue, start)
        while at < start + n:
            now, then = self.taken(window), self.taken(window + 1)
            stop = min(start + n, then[queue])
            if stop > at:
                yield at - start, stop - at, window, sum(then[:queue]) - sum(now[:queue]) + at - now[queue]
            at, window = max(at, stop), window + 1


def take_turns(tokens: DataFrame, parts: DataFrame, rates: DataFrame) -> DataFrame:
    """(pid, skey, start, at): places in their shared queue of the documents of the sources of ``rates`` (skey, rate).

    Each turn is that of the source that has had least for its rate, which is
    the order of the documents' middles in their source, divided by its rate.
    """
    before = Window.partitionBy("skey").orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)
    bases = parts.join(rates, "skey").select("pid", "skey", "rate", (F.sum("n").over(before) - F.col("n")).alias("base"))
    order = ["turn", "skey", "pid", "start"]
    turns = tokens.select("pid", "skey", "start", "n").join(bases, ["pid", "skey"]).withColumn("turn", (F.col("base") + F.col("start") + F.col("n") / 2) / F.col("rate"))
    dealt = stored(turns.select(*order, "n").repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "turns")
    sums = dealt.groupBy("part").agg(F.sum("n").alias("m"))
    firsts = sums.select("part", (F.sum("m").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("first"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return dealt.withColumn("b", F.sum("n").over(inside) - F.col("n")).join(F.broadcast(firsts), "part").select("pid", "skey", "start", (F.col("first") + F.col("b")).alias("at"))


def pack(docs: DataFrame, tokenizer: str, weights: Mapping[str, int] | None = None, length: int = LENGTH) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, queue.

    ``weights`` gives whole-number targets by source (others: 1); without it
    every window has the mixture of the whole corpus.  Null or empty texts are
    the end id alone; null sources are one source; repeated rows are packed one
    by one; an empty table gives no rows.  Only the last sequence is short.
    """
    tokens = token_table(docs, tokenizer)
    parts = stored(tokens.groupBy("pid", "skey").agg(F.sum("n").alias("n")), "token_counts")
    largest = parts.groupBy("skey").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "skey").limit(QUEUES + 1).collect()
    many = len(largest) > QUEUES
    own = {r["skey"]: i for i, r in enumerate(largest[: QUEUES - 1] if many else largest)}
    queue = F.lit(QUEUES - 1)
    for key, i in own.items():
        queue = F.when(F.col("skey") == key, F.lit(i)).otherwise(queue)
    queued = parts.withColumn("queue", queue)
    by_queue = {r["queue"]: r["n"] for r in queued.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    totals = [by_queue.get(i, 0) for i in range(max(by_queue, default=-1) + 1)]
    if weights is None:
        targets = totals
    else:
        by_key = {r["k"]: int(weights[r["s"]]) for r in docs.sparkSession.createDataFrame([(s,) for s in weights], "s string").select("s", F.xxhash64("s").alias("k")).collect()} if weights else {}
        targets = [by_key.get(k, 1) for k in own]  # own queues are numbered in this order
    rates = None
    if many:
        tail = parts.where(~F.col("skey").isin([*own])).groupBy("skey").agg(F.sum("n").alias("rate"))
        if weights is not None:
            given = docs.sparkSession.createDataFrame([*by_key.items()], "skey long, rate long")
            tail = tail.drop("rate").join(F.broadcast(given), "skey", "left").select("skey", F.greatest(F.coalesce("rate", F.lit(1)), F.lit(1)).alias("rate"))
        rates = stored(tail, "rates")
        if weights is not None:
            targets.append(int(rates.agg(F.sum("rate")).first()[0]))
    schedule = Schedule(phases(totals, targets, length), length)
    # a queue's tokens lie in the order (partition, source): offsets over partitions, then over the sources of one partition
    by_pid = queued.groupBy("queue", "pid").agg(F.sum("n").alias("m")).select(
        "queue", "pid", (F.sum("m").over(Window.partitionBy("queue").orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")).alias("a")
    )
    offsets = queued.withColumn(
        "b", F.sum("n").over(Window.partitionBy("queue", "pid").orderBy("skey").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    ).join(by_pid, ["queue", "pid"]).select("pid", "skey", "queue", (F.col("a") + F.col("b")).alias("base"))
    if many:
        offsets = offsets.where(F.col("queue") < QUEUES - 1)
    laid = tokens.join(offsets, ["pid", "skey"]).select("doc_id", "queue", (F.col("base") + F.col("start")).alias("at"), "n", "ids")
    if many:
        turns = tokens.join(take_turns(tokens, parts, rates), ["pid", "skey", "start"])
        laid = laid.unionByName(turns.select("doc_id", F.lit(QUEUES - 1).alias("queue"), "at", "n", "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(8)]
            for doc, q, at, n, ids in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "queue", "at", "n", "ids")], strict=True):
                wide = np.frombuffer(ids, dtype=f"<u{len(ids) // n}").astype("<u4").tobytes()
                for start, size, window, offset in schedule.pieces(q, at, n):
                    row = (doc, start, size, zlib.crc32(wide[4 * start : 4 * (start + size)]), n, window, offset, q)
                    for c, x in zip(cols, row, strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], batch.schema.field("doc_id").type), *[pa.array(c, pa.int64()) for c in cols[1:7]], pa.array(cols[7], pa.int32())],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"],
            )

    kind = laid.schema["doc_id"].dataType.simpleString()
    return laid.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue int")
