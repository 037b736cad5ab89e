"""Tables that a run keeps for the next ones: daily partials, minutes bucketed by order, logs partitioned by day, key bits."""

from __future__ import annotations

from datetime import date, datetime

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from hubflow import plans
from hubflow.catalog import CHECKS
from hubflow.catalog import reports as R
from hubflow.operators import arrivals, measures, partials
from hubflow.operators.keyset import KeyBits
from hubflow.operators.windows import partition_window
from hubflow.sources.samples import MEASURED_AS_OF, Samples
from hubflow.sources.schemas import read_parquet
from hubflow.sources.staging import bucketed
from verify import connect, differences


@pytest.fixture(scope="module")
def t(spark):
    return Samples(spark, SMALL)


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


BACKLOG = {"now": R.NOW, "hub_names": R.BACKLOG_HUBS, "provinces": R.PROVINCES, "lookback_days": 365}


def test_days_written_one_by_one_and_again_after_late_rows_give_the_report(spark, t, con, tmp_path):
    path = str(tmp_path / "last_scans")
    recent = partition_window(t("hub_scan"), "dt", date(2001, 5, 25)).cache()
    days = sorted(date.fromisoformat(r.dt) for r in recent.select("dt").distinct().collect())
    on_time = recent.filter(F.xxhash64("package_code") % 3 != 0)
    halves = days[: len(days) // 2], days[len(days) // 2 :]
    for part in halves:
        partials.store_days(partials.last_scan_partials(on_time), path, part)
    kept = spark.read.parquet(path)
    arguments = {**BACKLOG, "lookback_days": (R.NOW.date() - date(2001, 5, 25)).days}
    whole = lambda log: sorted(map(str, plans.delivery_backlog(t("shipping_order"), log, t("dim_warehouse"), t("dim_ward"), **arguments).collect()))
    merged = lambda rows: sorted(map(str, plans.delivery_backlog(t("shipping_order"), rows, t("dim_warehouse"), t("dim_ward"), partials=True, **arguments).collect()))
    assert merged(kept) == whole(on_time)
    late = sorted(date.fromisoformat(r.dt) for r in recent.exceptAll(on_time).select("dt").distinct().collect())
    partials.store_days(partials.last_scan_partials(recent), path, late)
    after = spark.read.parquet(path)
    assert merged(after) == whole(recent)
    assert sum(r.isNotNull for r in after.select(F.col("ibh_from_receive").isNotNull().alias("isNotNull")).collect()) > 0
    # Only the days of a run are read.
    assert "PartitionFilters: [isnotnull(dt#" in plan(partition_window(after, "dt", days[-3]).select("order_code"))
    recent.unpersist()


def test_arrival_partials_collapse_a_day_and_lose_no_minimum(table):
    at = lambda h: datetime(2024, 1, 1, h)
    ddl = "order_code string, warehouse_id string, action_time timestamp_ntz, package_code string, trip_code string, action_category string, dt string"
    scans = table(
        ddl,
        ("o", "1", at(3), "k", "t", "receive", "2024-01-01"),
        ("o", "1", at(2), "k", "t", "receive", "2024-01-01"),
        ("o", "1", at(1), "k", "t", "receive", "2024-01-02"),
        ("o", "1", at(5), "k", "t", "unpack", "2024-01-01"),
        ("o", "1", at(4), "l", "u", "unpack", "2024-01-01"),
        ("o", "1", at(0), "l", "u", "export", "2024-01-01"),
        ("p", "2", at(6), None, None, "receive", "2024-01-01"),
    )
    found = {(r.dt, r.order_code, r.trip_code, r.action_category): r.action_time.hour for r in partials.arrival_partials(scans).collect()}
    assert found == {
        ("2024-01-01", "o", "t", "receive"): 2,
        ("2024-01-02", "o", "t", "receive"): 1,
        ("2024-01-01", "o", None, "unpack"): 4,
        ("2024-01-01", "p", None, "receive"): 6,
    }


def test_both_weight_reports_share_bucketed_minutes_without_an_exchange(spark, t, con):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    minutes = bucketed(measures.day_minutes(t("sorter_log")), "weight_minutes_test", "order_code", 8)
    try:
        for name, report in (("r09_weight_gap_summary", plans.weight_gap_summary), ("r10_weight_gap_detail", plans.weight_gap_detail)):
            assert not differences(report(t("completed_mart"), minutes, as_of=MEASURED_AS_OF, minutes=True), con, CHECKS[name].statement())
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        cohort = measures.completed_cohort(t("completed_mart"), plans.weights.month_to_date_window(MEASURED_AS_OF))
        found = plan(measures.order_weights(measures.stored_minutes(minutes, cohort, date(2023, 10, 1)), same_hub=True))
        # The only exchanges are those of the cohort: copies go, then it meets the buckets.
        above = found.split("Scan parquet spark_catalog.default.weight_minutes_test")[0]
        chain = [line for line in above.splitlines() if "Exchange" in line]
        assert "Bucketed: true" in found and not chain, found
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE weight_minutes_test")


def test_partitioned_log_is_pruned_and_gives_the_report(spark, t, con, tmp_path):
    path = str(tmp_path / "hub_scan")
    partition_window(t("hub_scan"), "dt", date(2000, 7, 25)).repartition("dt").write.partitionBy("dt").parquet(path)
    log = read_parquet(spark, "hub_scan", path)
    report = plans.delivery_backlog(t("shipping_order"), log, t("dim_warehouse"), t("dim_ward"), **BACKLOG)
    assert not differences(report, con, CHECKS["r07_delivery_backlog"].statement())
    read = partition_window(log, "dt", date(2000, 8, 2), date(2000, 8, 5))
    assert "PartitionFilters: [isnotnull(dt#" in plan(read)
    assert {r.dt.isoformat() for r in read.select("dt").distinct().collect()} <= {"2000-08-02", "2000-08-03", "2000-08-04"}
    # Days that only another table knows prune as the query runs.
    days = spark.createDataFrame([(date(2000, 8, 3), "late"), (date(2000, 9, 9), "late")], "dt date, why string").filter("why = 'late'")
    assert "dynamicpruning" in plan(log.join(F.broadcast(days), "dt").select("order_code"))


def test_key_bits_hold_every_key_and_few_others(spark):
    keys = spark.range(0, 30_000, 3).select(F.concat(F.lit("k"), F.col("id")).alias("k")).union(spark.createDataFrame([(None,), ("k0",)], "k string"))
    rows = spark.range(60_000).select(F.concat(F.lit("k"), F.col("id")).alias("k")).union(spark.createDataFrame([(None,)], "k string"))
    kept = rows.filter(KeyBits(keys, "k", log2_bits=18).may_hold(F.col("k")))
    assert kept.join(keys, "k", "left_semi").count() == 10_000
    assert 10_000 <= kept.count() <= 10_000 + 50_000 * 0.06
    assert rows.filter(KeyBits(keys.filter("false"), "k", log2_bits=8).may_hold(F.col("k"))).count() == 0


def test_only_wanted_packages_reach_the_first_exchange(spark, t):
    routes, scans = t("trip_route"), t("hub_scan_dirty").filter(F.col("order_code").endswith("7"))
    wanted = KeyBits(arrivals.received(scans), "package_code")
    every, few = arrivals.route_stops(routes), arrivals.route_stops(routes, wanted=wanted)
    packages = arrivals.received(scans).select("package_code").distinct()
    assert few.join(packages, "package_code", "left_semi").count() == every.join(packages, "package_code", "left_semi").count() > 0
    assert few.count() <= 1.05 * every.join(packages, "package_code", "left_semi").count() < every.count() / 5
    text = plan(arrivals.earliest_check_in(few, ["package_code", "stop_point"])).split("Subquery")[0]
    assert text.index("Exchange") < text.index("Filter")
