"""Headline-query benchmark.

Runs the headline jobs at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line.  Each query is executed in
full through the ``noop`` sink (no collect to the driver); the reported time
is the best of ``$BENCH_REPEAT`` runs after one warm-up run of the session;
the cache is cleared before every run, so no run reuses persisted blocks.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from quarry.plans.catalog import QUERIES  # noqa: E402
from quarry.session import local_session  # noqa: E402

HEADLINE = [
    "ingest_rebuild",
    "ingest_incremental",
    "search_topk",
    "search_mmr",
    "rag_prompts",
    "extract_pages",
    "topk_inner_product",
    "chunk_sentences",
    "crawl_reach",
    "cache_admission",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="quarry-bench")
    names = [n for n in HEADLINE if n in QUERIES]
    # warm-up: JVM, Python workers, file listing
    QUERIES["clean_text"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for n in names:
        best = None
        for _ in range(repeat):
            spark.catalog.clearCache()  # no run may reuse blocks persisted by an earlier one
            t0 = time.time()
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            dt = time.time() - t0
            best = dt if best is None else min(best, dt)
        times[n] = round(best, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
