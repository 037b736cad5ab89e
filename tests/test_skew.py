"""One order holds a third of all log rows: results stay whole and Spark splits the order."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SMALL

from hubflow.catalog import CHECKS
from hubflow.plans import transit
from hubflow.sources.samples import BASE_TABLES
from hubflow.sources.staging import staged
from verify import differences

FILES = 16
REPORTS = [name for name in CHECKS if name.startswith("r")]
# Small inputs stand for large ones: nothing may be broadcast, and a partition counts as hot early.
LARGE = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1KB",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.files.openCostInBytes": "64KB",
    "spark.sql.files.maxPartitionBytes": "64KB",
}


@pytest.fixture(scope="module")
def skewed(tmp_path_factory):
    """Sample tables whose logs are dominated by single orders."""
    folder, con = tmp_path_factory.mktemp("skewed"), duckdb.connect()
    # an order of the bulky client that is open, picked and due within the reports' ranges
    hot = con.execute(
        f"SELECT o_orderkey FROM '{SMALL}/orders.parquet' WHERE o_custkey % 6 = 1 AND o_orderkey % 10 <> 0 AND o_orderkey % 50 <> 49 "
        "AND o_orderstatus <> 'F' AND o_orderdate >= TIMESTAMP '2000-11-01' AND o_orderdate < TIMESTAMP '2001-03-01' ORDER BY o_orderkey LIMIT 1"
    ).fetchone()[0]
    for table in BASE_TABLES:
        source = f"SELECT * FROM '{SMALL}/{table}.parquet'"
        if table == "lineitem":
            source = (
                f"SELECT * REPLACE (CASE WHEN row_number() OVER () % 3 = 0 THEN {hot} ELSE l_orderkey END AS l_orderkey) FROM ({source})"
            )
        if table == "events":
            source = f"SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 8 ELSE event_id END AS event_id) FROM ({source})"
        # Several files give several map tasks: Spark splits a hot partition between their outputs.
        parts = FILES if table in ("lineitem", "events") else 1
        (folder / f"{table}.parquet").mkdir()
        for part in range(parts):
            rows = f"SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER () AS place FROM ({source})) WHERE place % {parts} = {part}"
            con.execute(f"COPY ({rows}) TO '{folder}/{table}.parquet/{part}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.fixture(scope="module")
def con(skewed):
    con = duckdb.connect()
    for table in BASE_TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{skewed}/{table}.parquet/*.parquet'")
    return con


@pytest.fixture(scope="module")
def hot_hub(tmp_path_factory):
    """Sample tables in which a third of all orders go to one hub, for one customer of the bulky client."""
    folder, con = tmp_path_factory.mktemp("hot_hub"), duckdb.connect()
    for table in BASE_TABLES:
        source = f"SELECT * FROM '{SMALL}/{table}.parquet'"
        if table == "orders":
            source = f"SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 13 ELSE o_custkey END AS o_custkey) FROM ({source})"
        parts = FILES if table == "orders" else 1
        (folder / f"{table}.parquet").mkdir()
        for part in range(parts):
            rows = f"SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER () AS place FROM ({source})) WHERE place % {parts} = {part}"
            con.execute(f"COPY ({rows}) TO '{folder}/{table}.parquet/{part}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.fixture
def large(spark):
    before = {key: spark.conf.get(key, None) for key in LARGE}
    for key, value in LARGE.items():
        spark.conf.set(key, value)
    yield spark
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


@pytest.fixture
def staged_frames(monkeypatch):
    """The frames that a report stages on its way, run once for their final plans."""
    frames = []

    def record(df, label):
        df.collect()
        frames.append(df)
        return staged(df, label)

    monkeypatch.setattr(transit, "staged", record)
    return frames


def plans(frames):
    return "\n".join(f._jdf.queryExecution().executedPlan().toString() for f in frames)


@pytest.mark.parametrize("name", REPORTS)
def test_reports_are_right_with_a_hot_order(large, skewed, con, name):
    problems = differences(CHECKS[name].query(large, skewed), con, CHECKS[name].statement())
    assert not [p for p in problems if p != "no rows"]


# The log joins of these reports have the order alone as key.
@pytest.mark.parametrize("name", ["r01_hub_pass_weekly", "r09_weight_gap_summary", "r10_weight_gap_detail"])
def test_hot_orders_are_split(large, skewed, staged_frames, name):
    df = CHECKS[name].query(large, skewed)
    df.collect()
    assert "SortMergeJoin(skew=true) [order_code" in plans([*staged_frames, df])


@pytest.mark.parametrize("name", REPORTS)
def test_no_plan_needs_a_cross_product(large, name):
    plan = CHECKS[name].query(large, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


# Locally no log is large enough for a runtime filter, so every log counts as large here.
@pytest.mark.parametrize("name", ["r01_hub_pass_weekly", "r02_transit_sla_weekly", "r07_delivery_backlog", "r10_weight_gap_detail"])
def test_large_logs_are_filtered_before_the_shuffle(large, skewed, con, staged_frames, name):
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    large.conf.set(key, "0")
    try:
        df = CHECKS[name].query(large, skewed)
        assert not [p for p in differences(df, con, CHECKS[name].statement()) if p != "no rows"]
        assert any("might_contain" in f._jdf.queryExecution().optimizedPlan().toString() for f in [*staged_frames, df])
    finally:
        large.conf.unset(key)


@pytest.mark.parametrize("name", ["r01_hub_pass_weekly", "r02_transit_sla_weekly", "r05_failed_delivery_by_hub", "r07_delivery_backlog"])
def test_reports_are_right_with_a_hot_hub(large, hot_hub, name):
    hub_con = duckdb.connect()
    for table in BASE_TABLES:
        hub_con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{hot_hub}/{table}.parquet/*.parquet'")
    assert not differences(CHECKS[name].query(large, hot_hub), hub_con, CHECKS[name].statement())
