"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rankscope.plans import catalog  # noqa: E402
from rankscope.session import local_session, temporary_tables  # noqa: E402

HEADLINE = ["a01_message_histogram", "a03_trace_totals", "a08_per_rank", "a09_links", "o01_top_links",
            "o05_collective_roots", "j02_pair_p2p", "g01_late_senders", "g03_late_broadcasters",
            "a20_barrier_spreads", "p01_phases", "w07_chunk_id", "t05_register_time", "t08_sort_timeline",
            "f22_pattern_report", "o06_issues"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8)))
    spark = local_session(cpus, partitions=max(8, cpus), app="rankscope-bench")
    catalog.QUERIES["a03_trace_totals"](spark, sf_dir).collect()  # starts executors and code paths
    took = {}
    for name in HEADLINE:
        spark.catalog.clearCache()
        start = time.perf_counter()
        with temporary_tables(spark):
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
