import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.llm.suffix_dedup import remove_repeats

import messy


def brute(rows, n):
    texts = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[p : p + n] for _, b in texts for p in range(len(b) - n + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        spans = sum(gone[p] and not (p and gone[p - 1]) for p in range(len(b)))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("threshold", "digit", "step"), [(400, 128, 16), (40, 11, 4)])
def test_matches_brute_force(spark, threshold, digit, step):
    rng = random.Random(4)
    part = [messy.words(rng, 60) for _ in range(5)]
    rows = [r[:2] for r in messy.rows() if r[0] != 30]
    for k in range(25):  # pieces of shared passages at random places
        a, b = sorted(rng.sample(range(len(part[k % 5])), 2))
        rows.append((5000 + k, messy.words(rng, rng.randint(0, 50)) + part[k % 5][a:b] + messy.words(rng, 5) + part[(k + 1) % 5][a : a + threshold]))
    df = messy.table(spark, [(i, t, None, None, 0, "", 0, "", "") for i, t in rows])
    out = remove_repeats(df, threshold, digit, step).select("doc_id", "n_bytes", "n_removed", F.size("spans").alias("n"), "kept").collect()
    assert sorted(((r[0], r[1], r[2], r[3], bytes(r[4])) for r in out), key=repr) == brute(rows, threshold)


def test_empty_table(spark):
    assert remove_repeats(messy.table(spark, [])).count() == 0
