"""Time the headline queries and print one JSON line.

Each query is built and written to the noop sink: one warm-up, then the median of
``BENCH_RUNS`` (3). The time includes planning and the jobs a query starts itself.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from feedloom.plans.queries import registered
from feedloom.session import local_session

HEADLINE = [
    "knn_top5", "knn_batch", "knn_approx", "dedup_in_run", "new_items", "items_clean", "xml_items", "top_today",
    "top_fallback", "top_per_day", "digest_chunks", "enrich_offline", "embedding_upsert", "feed_add",
    "feed_delete_cascade", "rule_report", "truncate_text", "split_text", "daily_run", "stream_ingest",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores)
    timings = {}
    for name in names:
        seconds = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registered()[name](spark, folder).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(seconds[1:]), 3)
        print(name, timings[name], file=sys.stderr, flush=True)
    scale = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "total_query_time", "value": round(sum(timings.values()), 3), "unit": "sec",
        "queries": timings, "sf": float(scale) if scale.replace(".", "").isdigit() else scale,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
