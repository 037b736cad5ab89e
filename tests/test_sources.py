from __future__ import annotations

from datetime import datetime

import pytest

from hubflow import plans
from hubflow.plans.established import established_reports
from hubflow.sources.schemas import SOURCES, conform, read_parquet, read_table, schema_of


def test_missing_and_mistyped_columns_are_reported(table):
    with pytest.raises(ValueError, match="ward_name is missing") as error:
        conform(table("ward_id string, province_name string, district_name string", ("1",)), "dim_ward")
    assert "ward_id is string, not bigint" in str(error.value)


def test_names_ignore_case_and_integers_widen(table):
    given = table("CODE string, Hub_Code string, extra int", ("S1", "4", 1))
    assert conform(given, "stop_map").columns == ["code", "hub_code"]
    narrow = table("WARD_ID int, province_name string, district_name string, ward_name string", (7, "a", "b", "c"))
    assert dict(conform(narrow, "dim_ward").dtypes)["ward_id"] == "bigint"


def test_claims_keep_all_columns(spark):
    given = spark.sql("SELECT 1 AS anything, DATE '2025-07-01' AS ngay_duyet_eform, 'x' AS note")
    assert conform(given, "claim").columns == given.columns


def test_text_dates_are_refused_for_zoned_timestamps(spark):
    zoned = spark.sql("SELECT 'r' AS partner_router, TIMESTAMP '2024-01-01 00:00:00' AS updated_at_date")
    with pytest.raises(ValueError, match="updated_at_date is timestamp, not timestamp_ntz"):
        conform(zoned, "trip_route")


def test_loaders(spark, table, tmp_path):
    rows = table("code string, hub_code string", ("S1", "4"))
    rows.write.parquet(str(tmp_path / "stops"))
    rows.createOrReplaceTempView("Partner_Stops")
    assert read_parquet(spark, "stop_map", str(tmp_path / "stops")).collect() == rows.collect()
    assert read_table(spark, "stop_map", "partner_stops").collect() == rows.collect()
    spark.catalog.dropTempView("Partner_Stops")


def test_every_source_has_a_schema(spark):
    assert all(schema_of(source).fields for source in SOURCES)


def test_hub_names_need_two_columns_and_orders_no_weight(spark, table):
    assert conform(table("warehouse_id int, warehouse_name string", (7, "a")), "hub_name").collect() == [(7, "a")]
    orders = spark.sql(
        """SELECT 'a' AS order_code, 1 AS client_id, 'storing' AS status, '2026-06-15 10:00:00' AS created_date,
                  TIMESTAMP_NTZ '2026-06-16 07:00:00' AS end_pick_time, 1 AS pick_warehouse_id, 2 AS deliver_warehouse_id,
                  2 AS current_warehouse_id, 1442 AS to_ward_code, 5 AS to_ward_id_v2, DATE '2026-06-15' AS dt"""
    )
    loaded = conform(orders, "shipping_order")
    assert "weight" not in loaded.columns
    types = dict(loaded.dtypes)
    assert (types["created_date"], types["to_ward_code"], types["dt"]) == ("timestamp_ntz", "string", "date")
    assert loaded.first().to_ward_code == "1442"


def test_instants_become_wall_clock_times_of_the_zone(spark):
    zoned = spark.sql("SELECT 'r' AS partner_router, TIMESTAMP '2024-01-01 17:30:00Z' AS updated_at_date")
    assert str(conform(zoned, "trip_route", zone="Asia/Ho_Chi_Minh").first().updated_at_date) == "2024-01-02 00:30:00"


def test_malformed_text_times_raise(spark):
    given = spark.sql("SELECT 't' AS transportation_code, '1' AS location_id, 'soon' AS created_time, 'x' AS action_type, '2024-01-01' AS dt")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        conform(given, "truck_event").collect()


@pytest.mark.parametrize(
    "report, table_name",
    [("hub_pass_weekly", "delivered_order"), ("transit_sla_weekly", "shipping_order"), ("failed_delivery_by_hub", "shipping_order"), ("delivery_backlog", "shipping_order")],
)
def test_each_report_opens_its_own_order_table(monkeypatch, report, table_name):
    seen = []
    monkeypatch.setattr(plans, report, lambda *tables, **options: seen.extend(tables))
    established_reports(lambda name: name, datetime(2026, 6, 18), sampled_hub_ids=[])[report]()
    assert [name for name in seen if name.endswith("_order")] == [table_name]
