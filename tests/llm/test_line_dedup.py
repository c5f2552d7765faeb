from collections import defaultdict

from quarry.llm.line_dedup import line_dedup

import messy


def brute(rows):
    docs = {(i is None, i or 0, t) for i, t in rows if t is not None}
    first, later = {}, defaultdict(set)
    for d in sorted(docs):
        ls = d[2].split("\n")
        for p in range(len(ls) - 2):
            w = tuple(ls[p : p + 3])
            if w in first:
                later[d].update((p, p + 1, p + 2))
            else:
                first[w] = True
    out = []
    for i, t in rows:
        if t is None:
            out.append((i, None, 0, 0, 0))
            continue
        gone, ls = later[i is None, i or 0, t], t.split("\n")
        spans = sum(p in gone and p - 1 not in gone for p in range(len(ls)))
        out.append((i, "\n".join(x for p, x in enumerate(ls) if p not in gone), len(ls), len(gone), spans))
    return sorted(out, key=repr)


def test_matches_brute_force_and_keeps_all_columns(spark):
    df = messy.table(spark)
    out = line_dedup(df)
    assert out.columns == [*df.columns, "n_lines", "n_removed", "n_spans"]
    got = [(r[0], r[1], r[-3], r[-2], r[-1]) for r in out.collect()]
    assert sorted(got, key=repr) == brute([r[:2] for r in messy.rows()])
    assert any(g[3] for g in got)


def test_empty_table(spark):
    assert line_dedup(messy.table(spark, [])).count() == 0
