"""Request keys, and the crawl's bucketed tables."""

import random
import re

from pyspark.sql import functions as F

from quarry.functions import urls as U
from quarry.operators import links as L
from quarry.session import scratch_path


def keys(spark, urls):
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    return [r[0] for r in df.select(U.request_key("u")).collect()]


def test_request_key_forms(spark):
    same = [
        ["http://h/p?b=2&a=1", "HTTP://H:80/p?a=1&b=2#top", "http://h:/p?a=1&&b=2"],
        ["https://u@h/a~b/%C3%A9?x=", "https://u@H:443/a%7eb/%c3%a9?x", "https://u@h/%61~b/é?x="],
        ["http://h/?q=a+b", "http://h?q=a%20b", "http://h/?q=a b"],
    ]
    for forms in same:
        assert len(set(keys(spark, forms))) == 1
    other = ["http://h/p?a=1&a=2", "http://h/p?a=2", "http://h/p?a=1", "http://H/P?a=1", "http://h:8080/p?a=1", "https://h/p?a=1", "http://h/p", "http://h/p/", "http://h/a%2Fb", "http://h/a/b"]
    assert len(set(keys(spark, other))) == len(other)
    assert keys(spark, [None, "", "http://h/100%/%zz"]) == [None, "/", "http://h/100%/%zz"]
    # a key is its own key
    once = keys(spark, [u for forms in same for u in forms] + other)
    assert keys(spark, once) == once


def brute(edges, pages, starts):
    found, depth, last = {u: 0 for u in starts if u in pages}, 0, set(starts) & pages
    while last:
        depth += 1
        last = {d for s, d in edges if s in last and d in pages and d not in found}
        found |= {u: depth for u in last}
    return found


def test_reach_equals_a_search_on_random_graphs(spark):
    rng = random.Random(2)
    for n, m in ((1, 0), (40, 70), (60, 40)):
        pages = {f"http://h/{i}" for i in range(n)}
        edges = {(f"http://h/{rng.randrange(n)}", f"http://h/{rng.randrange(n + 5)}") for _ in range(m)}
        starts = ["http://h/0", "http://h/0", "http://h/none"]
        p = spark.createDataFrame([(u,) for u in sorted(pages)], "url string")
        e = spark.createDataFrame([*edges] or [("x", "y")], "src_url string, dst_url string")
        out = L.crawl_reach(e, p, spark.createDataFrame([(u,) for u in starts], "url string")).collect()
        assert {r["url"]: r["depth"] for r in out} == brute(edges, pages, starts)


def test_nothing_to_reach(spark):
    p = spark.createDataFrame([], "url string")
    assert L.crawl_reach(spark.createDataFrame([], "src_url string, dst_url string"), p).count() == 0
    names = [t.name for t in spark.catalog.listTables() if t.name.startswith("quarry_")]
    assert names == []


def test_no_round_shuffles_the_tables(spark):
    """Only the candidates are exchanged, also where nothing is small enough to be broadcast."""
    tables = L._Buckets(spark, scratch_path(spark, "crawl-plan"))
    small = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        tables.add("edges", spark.range(1000).select(F.col("id").alias("src"), ((F.col("id") * 7 + 1) % 1000).alias("dst")), "src")
        tables.add("reached", spark.range(3).select(F.col("id").alias("page"), F.lit(0).alias("depth")), "page", ["depth"])
        tables.add("reached", L.next_round(tables, 1), "page", ["depth"])
        new = L.next_round(tables, 2)
        plan = new._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"Exchange ", plan)) == 1 and "Bucketed: true" in plan.replace("Bucketed: false", "")
        # the one exchange has the candidates below it: a distinct aggregate
        assert re.search(r"Exchange hashpartitioning\(page.*\n.*HashAggregate", plan)
        assert {r["page"] for r in new.collect()} == {(x * 7 + 1) % 1000 for x in ((y * 7 + 1) % 1000 for y in range(3))} - {0, 1, 2, 8, 15}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", small)
        tables.forget("edges", "reached")
