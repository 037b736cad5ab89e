"""Time three reports in plain and in tuned form, and count their exchanges: ``python compare_plans.py [data dir]``."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, "tests")

import as_written  # noqa: E402
from bench import timed  # noqa: E402

from hubflow import plans  # noqa: E402
from hubflow.catalog import reports as R  # noqa: E402
from hubflow.session import local_session  # noqa: E402
from hubflow.sources.samples import MEASURED_AS_OF, SINCE, WEEKLY_AS_OF, Samples  # noqa: E402


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(8, app="compare")
    t = Samples(spark, sf_dir)
    transit = [t(n) for n in ("shipping_order", "sla_mart", "dim_warehouse", "hub_scan_dirty", "trip_route", "stop_map")]
    dates = {"as_of": WEEKLY_AS_OF, "since": SINCE, "lookback_days": (WEEKLY_AS_OF - SINCE).days}
    backlog = [t(n) for n in ("shipping_order", "hub_scan", "dim_warehouse", "dim_ward")]
    places = {"now": R.NOW, "hub_names": R.BACKLOG_HUBS, "provinces": R.PROVINCES, "lookback_days": 365}
    weights = [t(n) for n in ("completed_mart", "sorter_log")]
    forms = {
        "transit SLA": (lambda: as_written.transit_sla(*transit, **dates), lambda: plans.transit_sla_weekly(*transit, **dates)),
        "delivery backlog": (
            lambda: as_written.delivery_backlog(*backlog, **places),
            lambda: plans.delivery_backlog(*backlog, **places),
        ),
        "weight-gap summary": (
            lambda: as_written.weight_summary(*weights, as_of=MEASURED_AS_OF),
            lambda: plans.weight_gap_summary(*weights, as_of=MEASURED_AS_OF),
        ),
    }
    for threshold in ("10MB", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for name, pair in forms.items():
            for form, build in zip(("plain", "tuned"), pair, strict=True):
                plan = build()._jdf.queryExecution().executedPlan().toString()
                exchanges = len(re.findall(r"[+:]- Exchange (?:hash|range|Single|Round)", plan))
                scans = len(re.findall(r"FileScan", plan))
                print(f"{name:20} {form} broadcast<={threshold:5} {timed(build, runs):7.2f}s {exchanges} exchanges {scans} scans", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
