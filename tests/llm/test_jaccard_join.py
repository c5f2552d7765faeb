import random

from quarry.llm import jaccard_join
from quarry.llm.connect import components

import messy


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    ids = [min((rows[i][0] for i in g if rows[i][0] is not None), default=None) for g in groups.values()]
    every = [(rows[i][0], len(sets[i]), c) for g, c in zip(groups.values(), ids, strict=True) for i in g]
    return sorted(every, key=repr), sorted(ids, key=repr)


def data():
    rng = random.Random(9)
    rows = [r[:2] for r in messy.rows()]
    text = messy.words(rng, 220).split()
    for k in range(60):  # a group of near copies; some link only through others
        copy = list(text)
        for _ in range(k % 9):
            copy[rng.randrange(len(copy))] = f"w{rng.random()}"
        rows.append((1000 + k, " ".join(copy)))
    passage = messy.words(rng, 30)  # many texts share a passage and nothing else
    rows += [(2000 + k, f"{messy.words(rng, 60)} {passage}") for k in range(50)]
    return [(i, t, None, None, 0, "", k, "", "") for k, (i, t) in enumerate(rows)]


def test_matches_brute_force(spark):
    rows = data()
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_groups(messy.table(spark, rows)).collect()]
    want, _ = brute([r[:2] for r in rows])
    assert sorted(got, key=repr) == want
    assert len({c for _, _, c in want}) < len(want) - 40


def test_one_of_each(spark):
    rows = [r for r in data() if (r[0] or 0) < 1000]
    df = messy.table(spark, rows)
    kept = jaccard_join.one_of_each(df)
    assert kept.columns == df.columns
    # texts without words are groups of their own
    _, groups = brute([r[:2] for r in rows])
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == groups


def test_repeated_rows_in_many_partitions(spark):
    rng, rows = random.Random(4), []
    for g in range(12):
        text = messy.words(rng, 200).split()
        half = text[:130] + messy.words(rng, 70).split()  # similarity about 0.47
        near = [*text[:190], *messy.words(rng, 10).split()]
        rows += [(None if g % 3 == 0 else 10 * g + k, " ".join(x)) for k, x in enumerate((text, half, near)) for _ in range(4)]
    centre = messy.words(rng, 200).split()
    for k in range(50):  # postings of more than 32 nodes
        copy = list(centre)
        copy[k * 4] = f"w{k}"
        half = centre[:130] + messy.words(rng, 70).split()
        rows += [(1000 + k, " ".join(copy)), *[(2000 + k, " ".join(half))] * 3]
    data = [(i, t, None, None, 0, "", k, "", "") for k, (i, t) in enumerate(rows)]
    df = messy.table(spark, data).repartition(24)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_groups(df).collect()]
    assert sorted(got, key=repr) == brute(rows)[0]


def test_empty_table(spark):
    assert jaccard_join.near_groups(messy.table(spark, [])).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7), (200, 200), (104, 103)]
    out = {r["node"]: r["comp"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 103, 104)}}


def test_the_sample_decides_no_result(spark, monkeypatch):
    """Whatever texts give the order of the shingles, the groups are those of brute force."""
    rows = data()
    want, _ = brute([r[:2] for r in rows])
    for docs, common in ((5, 3), (40, 0)):
        monkeypatch.setattr(jaccard_join, "SAMPLE_DOCS", docs)
        monkeypatch.setattr(jaccard_join, "COMMON", common)
        got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_groups(messy.table(spark, rows)).collect()]
        assert sorted(got, key=repr) == want


def test_pairs_are_given_once(spark, monkeypatch):
    rng = random.Random(3)
    text = messy.words(rng, 200).split()
    rows = []
    for k in range(30):  # copies of one text, most pairs of them just too different to link
        copy = list(text)
        for at in rng.sample(range(200), 3):
            copy[at] = f"w{rng.random()}"
        rows.append((k, " ".join(copy), None, None, 0, "", k, "", ""))
    given, pairs = [], jaccard_join._pairs

    def counted(*args):
        out = pairs(*args)
        given.extend((r["a"], r["b"]) for r in out.collect())
        return out

    monkeypatch.setattr(jaccard_join, "_pairs", counted)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.near_groups(messy.table(spark, rows)).collect()]
    assert sorted(got, key=repr) == brute([r[:2] for r in rows])[0]
    assert given and len(given) <= 2 * len(set(given))
