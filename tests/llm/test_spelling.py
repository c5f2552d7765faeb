import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quarry.llm import spelling
from quarry.llm.spelling import Piece, near, roots, spelling_groups

import messy


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, noise=0, min_length=5, min_count=3):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if i is None else i}:{w}".encode())
            if noise and h % noise == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= min_length and n >= min_count}
    form, found = {}, {}
    for w, n in words.items():
        mates = [x for x in words if abs(len(x) - len(w)) < 2 and one_edit(w, x)]
        best = min(mates, key=lambda x: (-words[x], x), default=None)
        found[w] = len(mates)
        form[w] = best if best and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, found[w], words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(3)
    base = ["".join(rng.choice("abcdeéÀ÷") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    base += ["w" * 3000, "w" * 3001, "w" * 2999 + "v", "wordé", "wordÉ"]
    out = []
    for k in range(400):
        words = []
        for _ in range(40):
            w = base[int(rng.random() ** 3 * len(base))]
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abé") + w[at:], w[:at] + rng.choice("abé") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 and w.isascii() else w)
        out.append((k % 350 if k % 9 else None, rng.choice([" ", "\n", ", ", "1", "_"]).join(words)))
    return [*out, *(r[:2] for r in messy.rows())]


def table(spark, rows):
    return messy.table(spark, [(i, t, None, None, 0, "x", 0, "b", "T") for i, t in rows])


@pytest.mark.parametrize(("noise", "piece_words"), [(0, 1024), (7, 3)])
def test_matches_brute_force(spark, noise, piece_words):
    """Also where blocks are dealt over many pieces."""
    out = spelling_groups(table(spark, corpus()), noise=noise, piece_words=piece_words, piece_letters=4096)
    want = brute(corpus(), noise)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == want
    assert any(w[1] for w in want) and any(w[2] != w[1] for w in want if w[1])


def test_near_equals_edits_of_random_words():
    rng = random.Random(1)
    words = sorted({"".join(rng.choice("abc") for _ in range(4)) for _ in range(60)})
    longer = sorted({"".join(rng.choice("abc") for _ in range(5)) for _ in range(90)})

    def piece(ws):
        return Piece(len(ws[0]), "".join(ws).encode("latin-1"), np.arange(len(ws)))

    for a, b in ((words, words), (words, longer)):
        i, j = near(piece(a), piece(b), a is b)
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {
            (x, y) for x in range(len(a)) for y in range(len(b)) if (a is not b or x < y) and one_edit(a[x], b[y])
        }


def test_long_chain_of_forms(spark):
    chain = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(37)], "word string, form string")
    assert {tuple(r) for r in roots(chain).collect()} == {(f"w{k}", "w37") for k in range(37)}


def test_spans_cut_no_word():
    text = "aaa bbbb ccccc, ééé d" * 20
    for size in (1, 2, 5, 1000):
        parts = list(spelling.spans(text, size))
        assert "".join(parts) == text
        assert sum((re.findall("[a-zé]+", p) for p in parts), []) == re.findall("[a-zé]+", text)


def test_empty_table(spark):
    assert spelling_groups(messy.table(spark, [])).count() == 0
