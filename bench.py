"""Time the registered queries and print one JSON line.

Environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local threads), BENCH_QUERIES
(comma-separated names; default all), BENCH_RUNS (timed runs after one warm-up; median taken).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tuneprep import build_session  # noqa: E402
from tuneprep.plans import QUERIES  # noqa: E402


def run(query, spark, sf_dir: str) -> float:
    """Build the query and evaluate all of its columns without collecting them."""
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run(QUERIES[name], spark, sf_dir)
        times[name] = round(statistics.median(
            run(QUERIES[name], spark, sf_dir) for _ in range(runs)
        ), 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
