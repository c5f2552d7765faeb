import hashlib
import re
from collections import defaultdict

import pytest

from quarry.llm import exact_dedup as X

import messy


def brute(rows):
    groups = defaultdict(list)
    for k, (i, t) in enumerate(rows):
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i or 0, k))
    out = []
    for norm, members in groups.items():
        best = min(members)
        for m in members:
            keep = None if best[1] else best[2]
            out.append((None if m[1] else m[2], keep, len(members), m == best, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(out):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in out.collect()), key=repr)


def rows():
    more = [(100, " "), (101, "one\ttwo"), (102, "ONE two"), (103, "o n e t w o"), (104, "o n e t w o "), (105, "x" * 5001), (106, "x" * 2500 + "\n" + "x" * 2500), (107, "one two")]
    long = [t for _, t, *_ in messy.rows() if t and len(t) > 50_000][0]
    more += [(110, long.replace(" ", "\n")), (111, long[:-1]), (112, long + "z"), (113, "z" + long), (114, long[:40_000] + long[40_001:])]
    return [*messy.rows(), *((i, t, None, None, 0, "x", 0, "b", "T") for i, t in more)]


@pytest.mark.parametrize(("least", "most", "bits"), [(X.LEAST, X.MOST, X.BITS), (4, 16, 64), (4, 16, 5), (X.LEAST, X.MOST, 1)])
def test_matches_brute_force(spark, least, most, bits):
    """Also where nearly all chunks share their hash with another content."""
    out = X.exact_dedup(messy.table(spark, rows()), least=least, most=most, bits=bits)
    assert got(out) == brute([r[:2] for r in rows()])


def test_one_group_holds_most_rows(spark):
    data = [(k, "a b c" if k % 3 else f"text {k}", None, None, 1, "", 0, "", "") for k in range(900)]
    assert got(X.exact_dedup(messy.table(spark, data))) == brute([r[:2] for r in data])


def test_chunks_follow_the_content(spark):
    """The chunks lie end to end, and an insertion changes only those around it."""
    long = [t for _, t, *_ in messy.rows() if t and len(t) > 50_000][0]
    df = spark.createDataFrame([(long,), ("inserted " + long,), ("語" * 3000,), ("",)], "text string")
    a, b, c, d = (r[0] for r in df.select(X.chunks(df.text)).collect())
    assert "".join(a).encode("latin-1").decode() == long and "".join(c).encode("latin-1").decode() == "語" * 3000 and d == []
    assert all(len(x) <= X.MOST for x in a + c) and len(a) > 20
    assert len(set(a) - set(b)) <= 2


def test_empty_table(spark):
    assert X.exact_dedup(messy.table(spark, [])).count() == 0


def test_no_python_in_the_plan(spark):
    plan = X.exact_dedup(messy.table(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
