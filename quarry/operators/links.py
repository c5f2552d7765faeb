"""Link graph operators: page edges, the frontier (J6) and reachability.

Reachability is a breadth-first search written as repeated joins over numbered
pages.  Edges lie in a table bucketed by their source, reached pages in one
bucketed by the page and partitioned by depth, with equal bucket counts.  A round
joins the pages of the last depth with the edges and drops pages that were
reached before, both bucket by bucket: neither table is shuffled in any
round, only the new candidates are, eight bytes each.  Rounds go on until one
reaches nothing new.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions import html as H
from quarry.functions import urls as U
from quarry.operators import ids
from quarry.session import scratch_path


def page_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``(src_url, pos, href, dst_url)`` for every ``a[href]`` of every page (P8 + P9)."""
    raw = pages.select(F.col(url).alias("src_url"), H.page_links_raw(F.col(html)).alias("_hrefs"))
    ex = raw.select("src_url", F.posexplode("_hrefs").alias("pos", "href"))
    # url_join runs in a code-generated projection (its repeated URL parts are
    # computed once there); the one-element explode above it keeps later
    # filters on dst_url from being inlined below, where they would re-run it
    ex = ex.withColumn("_h", U.clean_href("href"))
    resolved = ex.select("src_url", "pos", "href", U.join_clean(F.col("src_url"), F.col("_h")).alias("_d"))
    return resolved.select("src_url", "pos", "href", F.explode(F.array("_d")).alias("dst_url"))


def follow_filter(edges: DataFrame, subpaths: Sequence[str] = ("/",), start_urls: Sequence[str] = (),
                  domains: Sequence[str] = ()) -> DataFrame:
    """The crawler's link rules: same host (F1), allowed subpath or start page
    (F2), not a self link (F3), a host of the allowed domains if any are given (F4)."""
    s, d = F.col("src_url"), F.col("dst_url")
    ok = U.link_same_host(s, d) & U.link_allowed_subpath(s, d, subpaths, start_urls) & U.link_not_self(s, d)
    return edges.filter(ok & U.link_allowed_domain(d, domains) if domains else ok)


def link_frontier(edges: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """Distinct link targets that are not captured pages yet, as requests
    (``request_key``): fragments, the order of query arguments and escaping don't make
    an address."""
    known = pages.select(U.request_key(F.col(url)).alias("dst_url"))
    return edges.select(U.request_key(F.col("dst_url")).alias("dst_url")).distinct().join(known, "dst_url", "left_anti")


def numbered_pages(known: DataFrame, folder: str) -> DataFrame:
    """``(u, page)``: addresses with dense numbers, written once."""
    ids.assign_ids(known, ["u"], 0, "page").write.parquet(f"{folder}/pages")
    return known.sparkSession.read.parquet(f"{folder}/pages")


class _Buckets:
    """Tables of one crawl, bucketed by page number in the crawl's folder; catalog names last as long as the crawl."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder
        self.count = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.prefix = f"quarry_{uuid.uuid4().hex[:12]}"

    def add(self, name: str, df: DataFrame, key: str, by: Sequence[str] = ()) -> None:
        writer = df.repartition(self.count, key).write.mode("append").bucketBy(self.count, key)
        (writer.partitionBy(*by) if by else writer).option("path", f"{self.folder}/{name}").saveAsTable(f"{self.prefix}_{name}")

    def table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.prefix}_{name}")

    def forget(self, *names: str) -> None:
        """Drop the names; the files stay."""
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.prefix}_{name}")


def next_round(tables: _Buckets, depth: int) -> DataFrame:
    """``(page, depth)``: pages first reached at ``depth``, from those reached one step before."""
    last = tables.table("reached").where(F.col("depth") == depth - 1).select(F.col("page").alias("src"))
    met = last.join(tables.table("edges"), "src").select(F.col("dst").alias("page")).distinct()
    return met.join(tables.table("reached").select("page"), "page", "left_anti").select("page", F.lit(depth).alias("depth"))


def crawl_reach(edges: DataFrame, pages: DataFrame, start_urls: DataFrame | None = None, url: str = "url") -> DataFrame:
    """Captured pages reachable from the start urls, with their BFS depth.

    ``edges`` are ``(src_url, dst_url)`` already filtered by the follow rules.
    Only edges between captured pages matter; addresses are compared as
    requests (``request_key``), and every captured url with a reached address
    is returned.  Without ``start_urls``, the roots are the captured pages no
    other captured page links to.
    """
    spark = pages.sparkSession
    captured = pages.select(F.col(url).alias("url"), U.request_key(F.col(url)).alias("u")).distinct()
    folder = scratch_path(spark, "crawl")
    known = numbered_pages(captured.select("u").distinct(), folder)
    e = edges.select(U.request_key(F.col("src_url")).alias("u"), U.request_key(F.col("dst_url")).alias("to")).where("u <> to").distinct()
    e = e.join(known.toDF("u", "src"), "u").select("src", F.col("to").alias("u")).join(known.toDF("u", "dst"), "u").select("src", "dst")
    tables = _Buckets(spark, folder)
    try:
        tables.add("edges", e, "src")
        if start_urls is None:
            starts = known.select("page").join(tables.table("edges").select(F.col("dst").alias("page")), "page", "left_anti")
        else:
            starts = known.join(start_urls.select(U.request_key(F.col(start_urls.columns[0])).alias("u")).distinct(), "u").select("page")
        depth, new = 0, starts.select("page", F.lit(0).alias("depth"))
        while True:
            tables.add("reached", new, "page", ["depth"])
            if tables.table("reached").where(F.col("depth") == depth).isEmpty():
                break
            depth += 1
            new = next_round(tables, depth)
    finally:
        tables.forget("edges", "reached")
    if not depth:
        return captured.select("url", F.lit(0).alias("depth")).where(F.lit(False))
    reached = spark.read.schema("page long, depth int").parquet(f"{folder}/reached")
    return captured.join(known, "u").join(reached, "page").select("url", "depth")
