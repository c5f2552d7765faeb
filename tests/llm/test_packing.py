import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quarry.llm.packing import Schedule, pack, phases
from quarry.llm.queries import tokenizer_path

import messy


def ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("weights", [None, {"s1": 3, "s2": 1}])
def test_pieces_hold_every_id_once(spark, weights):
    out = pack(messy.table(spark), tokenizer_path(), weights).collect()
    want = Counter((i, tuple(ids(t))) for i, t, *_ in messy.rows())
    lengths = Counter((i, len(x)) for i, x in want.elements())
    pieces = defaultdict(list)
    for r in out:
        pieces[r["doc_id"], r["doc_tokens"]].append(r)
    left = Counter()
    for (i, x), n in want.items():
        raw = np.array(x, dtype="<u4").tobytes()
        rows = pieces[i, len(x)]
        for r in rows:
            if zlib.crc32(raw[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]:
                left[i, len(x)] += r["length"]
        assert sum(r["length"] for r in rows) == len(x) * lengths[i, len(x)]
        assert n >= 1
    assert all(left[k] >= k[1] * n for k, n in lengths.items())
    by_sequence = defaultdict(list)
    for r in out:
        by_sequence[r["sequence_id"]].append(r)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for s, rows in by_sequence.items():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == 2048 or (at < 2048 and s == max(by_sequence))


def test_windows_keep_the_mixture():
    totals = [10_000, 50_000, 333, 1, 70_000]
    s = Schedule(phases(totals, totals, 2048), 2048)
    for w in range(1, s.windows()):
        now = s.taken(w)
        assert sum(now) == 2048 * w
        assert all(abs(x - 2048 * w * t / sum(totals)) <= len(totals) for x, t in zip(now, totals, strict=True))
    assert s.taken(s.windows()) == totals


def test_targets_hold_until_a_queue_is_dry():
    totals = [100_000, 20_000, 50_000]
    s = Schedule(phases(totals, [1, 1, 2], 2048), 2048)
    first = [b - a for a, b in zip(s.taken(3), s.taken(4), strict=True)]
    assert sum(first) == 2048 and abs(first[0] - 512) <= 1 and abs(first[2] - 1024) <= 2
    assert s.taken(s.windows()) == totals
    assert all(a <= b for w in range(s.windows()) for a, b in zip(s.taken(w), s.taken(w + 1), strict=True))


@pytest.mark.parametrize("weights", [None, {"s45": 5, "s50": 3, "s01": 4}])
def test_sources_of_the_shared_queue_keep_their_shares(spark, weights):
    rows = [(1000 * s + k, "one two three four five six seven eight " * 5, None, f"s{s:02}", 0, "", 0, "", "") for s in range(60) for k in range(60 if s < 39 else 40)]
    out = pack(messy.table(spark, rows).coalesce(4), tokenizer_path(), weights).collect()
    assert sorted({r["queue"] for r in out}) == list(range(40))
    assert sum(r["length"] for r in out) == len(rows) * out[0]["doc_tokens"]
    size, had = out[0]["doc_tokens"], Counter()
    w = weights or {}
    shared = sorted((r for r in out if r["queue"] == 39), key=lambda r: (r["sequence_id"], r["offset"]))
    for r in shared:
        source = f"s{r['doc_id'] // 1000:02}"
        had[source] += r["length"]
        if max(had.values()) >= 40 * size:  # one runs dry
            break
        for s in (range(39, 60) if had.total() > 60 * size else ()):
            mine, all_w = w.get(f"s{s:02}", 1), sum(w.get(f"s{t:02}", 1) for t in range(39, 60))
            assert abs(had[f"s{s:02}"] - had.total() * mine / all_w) <= 4 * size
    if weights:
        first = [r for r in out if r["sequence_id"] == 0]
        assert abs(sum(r["length"] for r in first if r["queue"] == 39) - 2048 * 27 / (27 + 42)) <= 40


def test_empty_table(spark):
    assert pack(messy.table(spark, []), tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_no_queue_runs_backwards(seed):
    """Random totals with short last windows: what is taken never shrinks and windows are gapless."""
    rng = random.Random(seed)
    for _ in range(40):
        totals = [int(10 ** rng.uniform(0, 5)) for _ in range(rng.randint(1, 40))]
        weights = totals if rng.random() < 0.5 else [rng.randint(1, 9) for _ in totals]
        s = Schedule(phases(totals, weights, 2048), 2048)
        rows = [s.taken(w) for w in range(s.windows() + 1)]
        assert rows[0] == [0] * len(totals) and rows[-1] == totals
        for w, (a, b) in enumerate(zip(rows, rows[1:], strict=False)):
            assert all(x <= y for x, y in zip(a, b, strict=True))
            assert sum(b) - sum(a) == 2048 or (w == len(rows) - 2 and sum(b) - sum(a) < 2048)
    at = defaultdict(list)
    for q, n in enumerate(totals):
        for lo in range(0, n, 700):
            for _, size, window, offset in s.pieces(q, lo, min(700, n - lo)):
                at[window].append((offset, size))
    for pieces in at.values():
        pieces.sort()
        assert pieces[0][0] == 0 and all(a + b == c for (a, b), (c, _) in zip(pieces, pieces[1:], strict=False))
