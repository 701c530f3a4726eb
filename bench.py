"""Wall time of every query at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and its whole result computed (a noop write) once to warm up and then BENCH_RUNS times;
the median counts. BENCH_QUERIES restricts the run to some names.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from corpusflow.plans.workloads import QUERIES
from corpusflow.session import build_session


def seconds(spark, query, folder: str) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = os.environ.get("BENCH_QUERIES", "").split() or list(QUERIES)
    spark = build_session("bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in wanted:
        seconds(spark, QUERIES[name], folder)
        times[name] = round(statistics.median(seconds(spark, QUERIES[name], folder) for _ in range(runs)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of all queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
