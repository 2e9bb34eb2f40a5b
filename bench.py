"""Benchmark of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

HEADLINE = (
    "rollup_hourly", "rollup_daily", "rebucket_daily_tz", "sessionize", "sleep_daily",
    "samples_in_workout", "split_avg_hr", "splits_km", "upsert_samples", "asof_timezone",
)


def main() -> None:
    from pulseframe import catalog
    from pulseframe.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cpus)
    queries = catalog.queries()
    seconds = {}
    for name in names:
        times = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            # every row is produced, none is kept
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            if attempt:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus), "runs": runs,
    }))


if __name__ == "__main__":
    main()
