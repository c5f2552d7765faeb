import random
from collections import Counter

import numpy as np
import pyarrow as pa

from quarry.llm.decontaminate import RADIUS, BlockIndex, Items, _found, clean, find, fingerprints, plain
from quarry.llm.shingles import Shingler

import messy


def brute(rows, items):
    """(doc, item) whose best item-sized window is 80 % similar."""
    out = set()
    for i, t in rows:
        w = plain(t).split()
        for item, text in items:
            v = plain(text).split()
            k = min(5, len(v))
            if not v or len(w) < k:
                continue
            a, b = ([tuple(x[j : j + k]) for j in range(len(x) - k + 1)] for x in (v, w))
            for j in range(max(1, len(b) - len(a) + 1)):
                x, y = Counter(a), Counter(b[j : j + len(a)])
                both = sum((x & y).values())
                if both >= 0.8 * (x.total() + y.total() - both):
                    out.add((i, item))
    return out


def test_fingerprints_are_majorities():
    rng = np.random.default_rng(1)
    s = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
    for size, prints in fingerprints(s, [1, 2, 7, 20, 64]):
        assert len(prints) == 90 - size + 1
        bits = ((s[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(int)
        for i in (0, 5, 90 - size):
            want = (2 * bits[i : i + size].sum(axis=0) > size).tolist()
            assert [bool(int(prints[i]) >> b & 1) for b in range(64)] == want


def test_finds_passages(spark):
    rng = random.Random(3)
    items = [(k, messy.words(rng, n)) for k, n in enumerate((15, 22, 38, 59, 120, 3))] + [(90, None), (91, ""), (92, "!!!"), (0, "again the same id"), (3, None)]
    texts = [messy.words(rng, 60) for _ in range(8)]
    rows = [(k, f"{texts[k % 8]}{sep}{t}{sep}{texts[(k + 3) % 8]}") for sep in (" ", "\n") for k, t in items if t]
    rows = [(100 + i, t) for i, (_, t) in enumerate(rows)]
    long = items[4][1].split()
    long[60] = "changed"
    rows += [(200, items[3][1].upper()), (201, items[2][1].replace(" ", "*** ")), (202, " ".join(long)), (203, " ".join(items[3][1].split()[:-4])), (204, items[0][1]), (204, items[0][1])]
    rows += [(None, items[1][1]), (300, None), (301, "")] + [(400 + i, t) for i, t in enumerate(texts)]
    data = [(i, t, None, None, 0, "", 0, "", "") for i, t in rows]
    df, bench = messy.table(spark, data), spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, TEXT string")
    got = find(df, bench).collect()
    want = brute(rows, items)
    assert {(r["doc_id"], r["item_id"]) for r in got} == want
    assert len([r for r in got if r["doc_id"] == 204 and r["item_id"] == 0]) == 2
    dirty = {i for i, _ in want}
    kept = clean(df, bench)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((i for i, _ in rows if i not in dirty), key=repr)


def test_recall_of_changed_copies():
    rng = random.Random(8)
    items = [(k, messy.words(rng, n)) for k, n in enumerate((12, 24, 40, 50, 60, 85, 130, 200, 300, 400))]
    rows = []
    for _, text in items:
        w, most = text.split(), max(1, len(text.split()) // 45)
        for where in ("head", "middle", "tail", "ends", "spread"):
            for kind in ("replaced", "left out", "put in"):
                for edits in {1, most - 1, most} - {0}:
                    copy, n = list(w), len(w)
                    ends = [x for j in range(edits) for x in (5 * j, n - 1 - 5 * j)][:edits]
                    at = {"head": [5 * j for j in range(edits)], "middle": [n // 2 - 5 * (j - edits // 2) for j in range(edits)], "tail": [n - 1 - 5 * j for j in range(edits)], "ends": ends, "spread": [(2 * j + 1) * n // (2 * edits) for j in range(edits)]}[where]
                    for i in sorted({min(n - 1, max(0, i)) for i in at}, reverse=True):
                        copy[i : i + (kind != "put in")] = [] if kind == "left out" else [f"new{rng.random()}"]
                    rows.append((len(rows), f"{messy.words(rng, 20)} {' '.join(copy)} {messy.words(rng, 20)}"))
    rows += [(-1 - k, " ".join(t.split()[len(t.split()) // 10 : -(len(t.split()) // 12)])) for k, t in items]
    index = Items(items)
    found = _found(index, {w: Shingler(w) for w in index.index}, pa.array([t for _, t in rows]))
    got = {(rows[row][0], items[k][0]) for row, k, *_ in found}
    want = brute(rows, items)
    assert len(want) > 200
    assert got == want


def test_empty_tables(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    assert find(messy.table(spark, []), bench).count() == 0
    assert find(messy.table(spark), bench.limit(0)).count() == 0


def test_index_finds_all_within_the_radius():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    seen = rng.integers(0, 1 << 64, 4000, dtype=np.uint64)
    for i in range(3000):  # of all distances around the radius
        flips = np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, i % 16, replace=False).astype(np.uint64)) if i % 16 else np.uint64(0)
        seen[i] = prints[i % 300] ^ flips
    dist = np.bitwise_count(prints[:, None] ^ seen[None, :])
    want = [(int(w), int(i), int(dist[w, i])) for w, i in np.argwhere(dist <= RADIUS)]
    assert len(want) > 2000
    assert BlockIndex(prints, RADIUS).hits(seen) == want


def test_index_leaves_out_most_pairs():
    rng = np.random.default_rng(6)
    prints, seen = rng.integers(0, 1 << 64, 50_000, dtype=np.uint64), rng.integers(0, 1 << 64, 500, dtype=np.uint64)
    pairs = sum(len(at) for at, _ in BlockIndex(prints, RADIUS).pairs(seen))
    assert pairs < len(prints) * len(seen) / 100
    assert BlockIndex(prints[:0], RADIUS).hits(seen) == []
