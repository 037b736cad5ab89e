"""Time the ten reports: prints one JSON line.

``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores; ``BENCH_RUNS`` repeats
every query and keeps the fastest run.
"""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from hubflow.catalog.reports import REPORTS
from hubflow.session import local_session


def timed(build, runs: int) -> float:
    best = float("inf")
    for _ in range(runs):
        began = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - began)
    return round(best, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cpus, app="bench")
    # The first job of a session pays for class loading, not for a query.
    REPORTS["r04_compensation_extract"].query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {name: timed(lambda c=check: c.query(spark, sf_dir), runs) for name, check in REPORTS.items()}
    result = {
        "metric": "ten_reports_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
