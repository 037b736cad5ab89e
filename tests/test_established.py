"""The established parameter sets build, and their name lists reach the filters."""

from __future__ import annotations

from datetime import datetime, timezone

import pytest
from conftest import SMALL

from hubflow import params as P
from hubflow.catalog.reports import REPORTS
from hubflow.plans.established import established_reports
from hubflow.sources.samples import Samples

NOW = datetime(2026, 6, 18, 8, 0)
NAMES = [name.split("_", 1)[1] for name in REPORTS]


@pytest.mark.parametrize("name", NAMES)
def test_reports_build_with_established_parameters(spark, name):
    built = established_reports(Samples(spark, SMALL), NOW, sampled_hub_ids=[1, 2])[name]()
    registered = next(check for key, check in REPORTS.items() if key.endswith(name)).query(spark, SMALL)
    assert built.dtypes == registered.dtypes


def test_backlog_keeps_listed_hubs_and_both_spellings(spark, table):
    hub = P.BACKLOG_HUBS[0]
    tables = {
        "shipping_order": spark.sql(
            """SELECT code AS order_code, CAST(client AS BIGINT) AS client_id, 'storing' AS status,
                      TIMESTAMP_NTZ '2026-06-15 10:00:00' AS created_date, TIMESTAMP_NTZ '2026-06-16 07:00:00' AS end_pick_time,
                      CAST(1 AS BIGINT) AS pick_warehouse_id, CAST(hub AS BIGINT) AS deliver_warehouse_id,
                      CAST(hub AS BIGINT) AS current_warehouse_id, 1D AS weight, 1D AS converted_weight,
                      CAST(NULL AS STRING) AS to_ward_code, CAST(ward AS BIGINT) AS to_ward_id_v2, day AS dt
               FROM VALUES ('a', 18692, 7, 1, '2026-06-15'), ('b', 5, 7, 2, '2026-06-11'), ('c', 5, 8, 1, '2026-06-15'),
                           ('d', 5, 7, 3, '2026-06-15'), ('e', 5, 7, 1, '2026-06-10') AS v(code, client, hub, ward, day)"""
        ),
        "hub_scan": spark.sql(
            """SELECT 'a' AS order_code, '7' AS warehouse_id, TIMESTAMP_NTZ '2026-06-17 09:30:00' AS action_time, 'k' AS package_code,
                      't' AS trip_code, 'receive' AS action_category, 'RECEIVE_PACKAGE' AS action_name, '2026-06-17' AS dt"""
        ),
        "dim_warehouse": spark.createDataFrame([(7, hub), (8, "elsewhere")], "warehouse_id bigint, warehouse_name string"),
        "dim_ward": spark.createDataFrame(
            [(1, "Đồng Nai", "x", "y"), (2, "Dong Nai", "x", "z"), (3, "Huế", "x", "y")],
            "ward_id bigint, province_name string, district_name string, ward_name string",
        ),
    }
    rows = established_reports(tables.__getitem__, NOW, sampled_hub_ids=[])["delivery_backlog"]().collect()
    found = [(r.ordercode, r.client_group, r.currentwh, r.toprovince, r.ibh_source, r.pending_hours, r.pending_days) for r in rows]
    assert found == [
        ("b", "SME", hub, "Dong Nai", "end_pick_time", 49, 2),
        ("a", "SPE", hub, "Đồng Nai", "receive_package", 22, 0),
    ]


@pytest.mark.parametrize("hour, minute, day", [(16, 59, "2026-06-16"), (17, 0, "2026-06-17")])
def test_report_day_follows_the_local_zone(monkeypatch, hour, minute, day):
    """Ho Chi Minh City is seven hours ahead: its next day begins at 17:00 UTC."""
    from hubflow import plans

    seen = []
    monkeypatch.setattr(plans, "weight_gap_detail", lambda *tables, as_of: seen.append(str(as_of)))
    instant = datetime(2026, 6, 16, hour, minute, tzinfo=timezone.utc)
    established_reports(lambda name: None, instant, sampled_hub_ids=[])["weight_gap_detail"]()
    assert seen == [day]
