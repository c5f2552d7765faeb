import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quarry.llm import merkle

import messy


def h(x):
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(row):
    i, t, lang, source, n = row[:5]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t)))


def tree(leaves, arity):
    """(root, proofs) by plain lists."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = range(i - i % arity, min(len(level), i - i % arity + arity))
            proofs[k].append(("".join(level[j] for j in run if j < i), "".join(level[j] for j in run if j > i)))
            at[k] = i // arity
        level = [h("".join(level[j : j + arity])) for j in range(0, len(level), arity)]
    return level[0], proofs


def brute(rows, arity):
    sources = defaultdict(list)
    for r in rows:
        sources[r[3]].append(r)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    built = {s: sorted(((r[0] is not None, r[0] or 0, leaf(r)) for r in sources[s])) for s in order}
    subs = [tree([x[2] for x in built[s]], arity) for s in order]
    root, above = tree([s[0] for s in subs], arity)
    out = []
    for s, (sub, proofs), up in zip(order, subs, above, strict=True):
        for (known, i, x), p in zip(built[s], proofs, strict=True):
            out.append((i if known else None, x, sub, root, tuple(p + up)))
    return sorted(out, key=repr)


def got(out):
    cols = [F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")]
    steps = F.transform("steps", lambda s: F.struct(F.lower(F.hex(s["left"])).alias("l"), F.lower(F.hex(s["right"])).alias("r"))).alias("steps")
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["l"], s["r"]) for s in r["steps"])) for r in out.select("doc_id", *cols, steps).collect()), key=repr)


@pytest.mark.parametrize("arity", [2, 3, 5])
def test_matches_brute_force(spark, arity):
    assert got(merkle.manifest(messy.table(spark), arity=arity)) == brute(messy.rows(), arity)


@pytest.mark.parametrize("n", [1, 3, 10, 28])
def test_one_source_of_every_size(spark, n):
    data = [(k * 7 % 31, f"t{k}", None, "s", k, "", 0, "", "") for k in range(n)]
    out = merkle.manifest(messy.table(spark, data)).withColumn("ok", merkle.fold(F.col("leaf"), F.col("steps")) == F.col("root"))
    assert got(out.drop("ok")) == brute(data, 3)
    assert all(r["ok"] for r in out.collect())


def test_many_sources_and_a_tampered_row(spark):
    data = [(k, f"text\n{k}", "en", None if k < 40 else f"s{k % 23}é", k, "", 0, "", "") for k in range(200)]

    def changed(i, source, lang, n, text):
        return merkle.leaf_hash([i, source, lang, n, F.when(i % 50 == 0, F.concat(text, F.lit("!"))).otherwise(text)])

    out = merkle.manifest(messy.table(spark, data), claims={"claimed": changed})
    assert got(out) == brute(data, 3)
    ok = {r["doc_id"]: r["ok"] for r in out.select("doc_id", (merkle.fold(F.col("claimed"), F.col("steps")) == F.col("root")).alias("ok")).collect()}
    assert ok == {k: k % 50 != 0 for k in range(200)}


def test_query_on_awkward_rows(spark, tmp_path):
    import zlib

    from quarry.llm.queries import QUERIES

    spark.createDataFrame([r[:5] for r in messy.rows()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    rows = QUERIES["op11_merkle_manifest"](spark, str(tmp_path)).collect()
    assert len(rows) == len(messy.rows())
    cut = {r[0] for r in messy.rows() if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and "\n" in (r[1] or "")}
    assert cut and all(r["verified"] == (r["doc_id"] not in cut) for r in rows if r["doc_id"] != 23)
    want = {(x[1], h("".join(a + b for a, b in x[4]))) for x in brute(messy.rows(), 3)}
    assert {(r["leaf"], r["proof_sha256"]) for r in rows} == want


def test_empty_table(spark):
    assert merkle.manifest(messy.table(spark, [])).count() == 0
