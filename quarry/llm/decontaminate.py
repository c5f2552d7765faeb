"""Benchmark decontamination: SimHash windows, multi-index Hamming search, exact weighted shingles.

Items and documents become words (letters lowered, ASCII punctuation dropped)
and five-word shingles.  The SimHash of a window is the majority of its
shingles' hash bits.  A document is fingerprinted at every word for every
window size in use.  Sizes come from a ladder: an item's windows are the
largest step that its kept share (``PERCENT``) fills, at its head and its tail,
so sizes grow with the logarithm of item lengths.

A fingerprint within ``RADIUS`` bits of an item's agrees with it up to
``RADIUS // BLOCKS`` bits in one of ``BLOCKS`` blocks; tables from every block
value to the windows of items that near it find every such fingerprint, none is
missed.  Full distances are taken of these pairs only, under one in a hundred of
all pairs of positions and windows.  Besides, windows are dealt along the item so
closely that one of them is unchanged in every copy that is similar enough
(``run_length``); their fingerprints are found as they are.  The item-sized
windows around a hit are verified by weighted Jaccard similarity (weights: how
often a shingle occurs).

Scale: a map-only pass over the documents; nothing is shuffled.  Items go to
the tasks in blocks of bounded size (bytes and number), one pass for each block.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import pick, positional, row_key
from quarry.llm.shingles import WORDS, Shingler

PERCENT = 80
RADIUS, BLOCKS = 11, 4
LADDER = [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 15, 17, 20, 23, 27, 31, 36, 42, 49, 57, 64]
#: bytes of item texts in one pass
ITEM_BYTES = 16 << 20
#: items in one pass (their tables take about 4 KB each)
ITEM_ROWS = 50_000
#: pairs of positions and windows whose distances are taken at once
PAIRS = 1 << 20
#: words that are fingerprinted together
CHUNK = 1 << 14
_DROP = string.punctuation.encode()


def plain(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, _DROP)


def window_size(shingles: int) -> int:
    """The window of an item with so many shingles."""
    return max(s for s in LADDER if s <= max(1, -(-PERCENT * shingles // 100)))


def run_length(shingles: int) -> int:
    """Shingles in a row that stay unchanged in every copy that is ``PERCENT`` % similar.

    With u unmatched shingles of the item and v of the copy, 100 u + ``PERCENT`` v
    is at most 100 - ``PERCENT`` times the item's.  A change inside costs
    ``WORDS`` - 1 of either; the longest run is shortest when changes are spread
    evenly.
    """
    cuts = (100 - PERCENT) * shingles // ((100 + PERCENT) * (WORDS - 1))
    unmatched = ((100 - PERCENT) * shingles - PERCENT * (WORDS - 1) * cuts) // 100
    return -(-(shingles - unmatched) // (cuts + 1))


def fingerprints(shingles: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """(size, SimHash of the window at every position) for rising sizes.

    Set bits are counted for all windows and all 64 bits at once, with one
    word for each binary digit of the counts.
    """
    n, planes = len(shingles), []
    carry, spare = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.uint64)
    wanted = set(sizes)
    for size in range(1, min(max(sizes), n) + 1):
        m = n - size + 1
        if size.bit_length() > len(planes):
            planes.append(np.zeros(n, dtype=np.uint64))
        carry[:m] = shingles[size - 1 :]
        for p in planes:
            np.bitwise_and(p[:m], carry[:m], out=spare[:m])
            np.bitwise_xor(p[:m], carry[:m], out=p[:m])
            carry, spare = spare, carry
        if size in wanted:
            # a majority is a carry out of the count plus a constant
            rest = (1 << len(planes)) - (size // 2 + 1)
            out = np.zeros(m, dtype=np.uint64)
            for i, p in enumerate(planes):
                (np.bitwise_or if rest >> i & 1 else np.bitwise_and)(out, p[:m], out=out)
            yield size, out


def _near(value: int, bits: int, radius: int) -> set[int]:
    """All values within ``radius`` bits."""
    found = {value}
    for _ in range(radius):
        found |= {v ^ (1 << b) for v in found for b in range(bits)}
    return found


class BlockIndex:
    """Fingerprints by block values: for every value of a block those that have it up to ``radius // BLOCKS`` bits."""

    BITS = 64 // BLOCKS
    MASK = np.uint64((1 << BITS) - 1)

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        near = np.array(sorted(_near(0, self.BITS, radius // BLOCKS)), dtype=np.uint64)
        self.starts, self.windows, self.some = [], [], []
        for b in range(BLOCKS):
            keys = (self.block(prints, b)[:, None] ^ near[None, :]).ravel().astype(np.uint32)
            counts = np.bincount(keys, minlength=1 << self.BITS)
            self.windows.append((np.argsort(keys, kind="stable") // len(near)).astype(np.int32))
            self.starts.append(np.concatenate(([0], np.cumsum(counts))))
            self.some.append(counts > 0)

    def block(self, prints: np.ndarray, b: int) -> np.ndarray:
        return (prints >> np.uint64(b * self.BITS)) & self.MASK

    def pairs(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(positions, windows) that agree in a block; pairs that agree in several come several times."""
        for b in range(BLOCKS):
            values = self.block(prints, b)
            at = np.flatnonzero(self.some[b][values])
            if not len(at):
                continue
            values = values[at].astype(np.int64)
            first = self.starts[b][values]
            n = self.starts[b][values + 1] - first
            ends = np.cumsum(n)
            cuts = [0, *(np.flatnonzero(np.diff(ends // PAIRS)) + 1).tolist(), len(at)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                m, before = n[lo:hi], ends[lo] - n[lo]
                rows = np.arange(ends[hi - 1] - before) + np.repeat(first[lo:hi] - (ends[lo:hi] - m - before), m)
                yield np.repeat(at[lo:hi], m), self.windows[b][rows]

    def hits(self, prints: np.ndarray) -> list[tuple[int, int, int]]:
        """(window, position, distance) of all within the radius, each once, sorted."""
        found: set[tuple[int, int, int]] = set()
        for at, w in self.pairs(prints):
            dist = np.bitwise_count(prints[at] ^ self.prints[w])
            close = np.flatnonzero(dist <= self.radius)
            found.update(zip(w[close].tolist(), at[close].tolist(), dist[close].tolist(), strict=True))
        return sorted(found)


class Items:
    """Benchmark items by shingle width and window size."""

    def __init__(self, items: list[tuple]):
        """``items``: (id, text)."""
        self.items, keyed, along = [], {}, {}
        shinglers = {}
        for item_id, text in items:
            words = plain(text).split()
            if not words:
                continue
            width = min(WORDS, len(words))
            sh = shinglers.setdefault(width, Shingler(width))
            s = sh.windows(sh.word_hashes(b" ".join(words)))
            size = window_size(len(s))
            k = len(self.items)
            self.items.append((item_id, len(words), s, Counter(s.tolist())))
            run = run_length(len(s))
            small = max(x for x in LADDER if x <= (run + 1) // 2)
            prints = dict(fingerprints(s, [small, size]))
            for at in {*range(0, len(s) - small, run - small + 1), len(s) - small} if len(s) > 1 else ():
                along.setdefault((width, small), {}).setdefault(int(prints[small][at]), set()).add((k, at))
            prints = prints[size]
            for at in sorted({0, len(s) - size}):
                keyed.setdefault((width, size), []).append((int(prints[at]), k, at))
        bits = 64 // BLOCKS
        self.index = {}
        for (width, size), rows in keyed.items():
            # a single shingle is its own fingerprint: equal or not
            radius = RADIUS if size > 1 else 0
            index = BlockIndex(np.array([f for f, _, _ in rows], dtype=np.uint64), radius)
            self.index.setdefault(width, {})[size] = (index, [(k, at) for _, k, at in rows])
        self.along = {}
        for (width, size), found in along.items():
            values = np.array(sorted(found), dtype=np.uint64)
            table = np.zeros(1 << bits, dtype=bool)
            table[values & np.uint64((1 << bits) - 1)] = True
            self.along.setdefault(width, {})[size] = (table, values, found)

    def candidates(self, width: int, shingles: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(position, item, Hamming distance, shift) of windows within the radius; the item would start ``shift`` before the position."""
        along = self.along.get(width, {})
        bits, sizes = 64 // BLOCKS, sorted({*self.index[width], *along})
        mask = np.uint64((1 << bits) - 1)
        for lo in range(0, len(shingles), CHUNK):
            part = shingles[lo : lo + CHUNK + sizes[-1] - 1]
            for size, prints in fingerprints(part, sizes):
                prints = prints[:CHUNK]
                if size in along:
                    table, values, found = along[size]
                    at = np.flatnonzero(table[prints & mask])
                    for i in at[np.isin(prints[at], values)].tolist():
                        for k, shift in found[int(prints[i])]:
                            yield lo + i, k, 0, shift
                if size not in self.index[width]:
                    continue
                index, rows = self.index[width][size]
                for w, i, dist in index.hits(prints):
                    k, shift = rows[w]
                    yield lo + i, k, dist, shift

    def best(self, k: int, shingles: np.ndarray, start: int) -> tuple[float, int]:
        """(similarity, start) of the most similar item-sized window, the first of these, of all that a hit at ``start`` can belong to."""
        s, mine = self.items[k][2:]
        n = len(s)
        # words put in or left out before the hit move it, each by one of the unmatched shingles
        moved = (100 - PERCENT) * n // (100 + PERCENT)
        lo, hi = max(0, start - moved), max(0, min(len(shingles) - n, start + moved))
        span = shingles[lo : hi + n]
        size = min(n, len(span))
        if (100 + PERCENT) * int(np.isin(span, s).sum()) < PERCENT * (n + size):
            return 0.0, start
        span = span.tolist()
        theirs = Counter(span[:size])
        both = most = sum(min(c, theirs[x]) for x, c in mine.items())
        first = lo
        for i in range(hi - lo):
            gone, new = span[i], span[i + n]
            both -= theirs[gone] <= mine.get(gone, 0)
            theirs[gone] -= 1
            both += theirs[new] < mine.get(new, 0)
            theirs[new] += 1
            if both > most:
                most, first = both, lo + i + 1
        return most / (n + size - most), first


def find(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, d, t (row key), item_id, start, n_words, hamming, similarity: items that documents contain.

    One row for each document and item, of the window with the largest
    similarity (the first of these); ``start`` and ``n_words`` are words.
    Similarity is ``PERCENT`` % or more.  Null or empty texts and items contain
    nothing; items of fewer than five words are one shingle; repeated rows are
    answered one by one, repeated items are one.  Very long texts are searched
    whole, in chunks.  An empty table of documents or items gives an empty one.
    """
    rows = pick(docs, doc_id=id_col, text=text_col)
    d, t = row_key(F.col("doc_id"), F.col("text"))
    texts = rows.select("doc_id", d.alias("d"), t.alias("t"), "text").where("text IS NOT NULL")
    wanted = pick(items, item_id=item_col, text=item_text_col).where("text IS NOT NULL").distinct()
    kinds = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, d long, t long, item_id {wanted.schema['item_id'].dataType.simpleString()}"
    total, count = wanted.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    passes = int(max((total or 0) // ITEM_BYTES, count // ITEM_ROWS)) + 1
    out = None
    for b in range(passes):
        block = [tuple(r) for r in wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == b).collect()]
        found = texts.mapInArrow(_search(block), f"{kinds}, start long, n_words long, hamming int, similarity double")
        out = found if out is None else out.unionByName(found)
    return out


def _search(block: list[tuple]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block)
        shinglers = {w: Shingler(w) for w in items.index}
        for whole in batches:
            for lo in range(0, whole.num_rows, 256):
                batch = whole.slice(lo, 256)
                out = [*_found(items, shinglers, batch.column("text"))]
                if not out:
                    continue
                at, ks, *found = zip(*out, strict=True)
                ids = pa.array([items.items[k][0] for k in ks])
                types = [pa.int64(), pa.int64(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(c).take(pa.array(at)) for c in ("doc_id", "d", "t")], ids, *[pa.array(c, k) for c, k in zip(found, types, strict=True)]],
                    names=["doc_id", "d", "t", "item_id", "start", "n_words", "hamming", "similarity"],
                )

    return run


def _found(items: Items, shinglers: dict[int, Shingler], texts: pa.Array) -> Iterator[tuple]:
    """(row, item, start, words, Hamming distance, similarity) over a batch of texts.

    The shingles of all texts are fingerprinted in one array; windows over the
    edge of a text are cut off before they are verified.
    """
    words = [plain(t.as_py()) for t in texts]
    for width, sh in shinglers.items():
        hashes = [sh.word_hashes(w) for w in words]
        parts = [sh.windows(h) if len(h) >= width else h[:0] for h in hashes]
        edges = np.cumsum([0, *map(len, parts)])
        everything = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
        best: dict[tuple[int, int], tuple] = {}
        tried = set()
        for place, k, dist, shift in items.candidates(width, everything):
            n, at = len(items.items[k][2]), place - shift
            for row in {int(np.searchsorted(edges, max(0, x), side="right")) - 1 for x in (at, place, at + n - 1)}:
                if row >= len(parts):
                    continue
                size = len(parts[row])
                start = max(0, min(at - int(edges[row]), size - n))
                if not size or (row, k, start) in tried:
                    continue
                tried.add((row, k, start))
                s, start = items.best(k, parts[row], start)
                if 100 * s >= PERCENT and (s, -start) > best.get((row, k), (0.0, 0))[:2]:
                    best[row, k] = (s, -start, dist)
        for (row, k), (s, start, dist) in sorted(best.items()):
            yield row, k, -start, min(items.items[k][1], len(hashes[row])), dist, s


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that contain an item; null texts stay, other columns pass through."""
    base, at = positional(docs)
    d, t = row_key(F.col(at[id_col]), F.col(at[text_col]))
    bad = find(docs, items, id_col, text_col).select(F.col("d").alias("kd"), F.col("t").alias("kt")).distinct()
    return base.withColumns({"_d": d, "_t": t}).join(bad, (F.col("_d") == F.col("kd")) & (F.col("_t") == F.col("kt")), "left_anti").select(*base.columns).toDF(*docs.columns)
