"""Hand-made rows for the cases that the sample tables do not show."""

from __future__ import annotations

from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from hubflow import params as P
from hubflow.catalog import CHECKS
from hubflow.functions import labels, times, values
from hubflow.operators import arrivals as A
from hubflow.operators import backlog, failed, hubs, measures, metrics, pickup, transit, windows
from verify import differences


def at(day: int, hour: int = 0, minute: int = 0, second: int = 0) -> datetime:
    return datetime(2024, 1, day, hour, minute, second)


def as_set(df) -> set[tuple]:
    return {tuple(r) for r in df.collect()}


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


# --- values and labels --------------------------------------------------------
def test_unknown_weight_makes_an_order_light(table):
    df = table("weight double, converted double", (30000.0, None), (None, 30000.0), (19999.0, 20000.0), (1.0, 2.0))
    weight, converted = F.col("weight"), F.col("converted")
    result = df.select(labels.chargeable_weight(weight, converted), labels.service_class(weight, converted)).collect()
    assert [tuple(r) for r in result] == [(0.0, P.LIGHT), (0.0, P.LIGHT), (20000.0, P.HEAVY), (2.0, P.LIGHT)]


def test_client_labels_of_null_and_excluded_ids(table):
    df = table("id bigint", (None,), (2781603,), (5,), (18692,))
    groups = [r[0] for r in df.select(labels.client_group(F.col("id"))).collect()]
    assert groups == ["OTHER_EXCLUDED", "OTHER_EXCLUDED", "SME", "SPE"]
    assert as_set(df.filter(labels.is_reported_client(F.col("id")))) == {(5,), (18692,)}


def test_pass_buckets(table):
    df = table("n bigint", (None,), (0,), (1,), (4,), (5,), (12,))
    buckets = [r[0] for r in df.select(labels.pass_bucket(F.col("n"))).collect()]
    assert buckets == ["0_lan", "0_lan", "1_lan", "4_lan", ">=5_lan", ">=5_lan"]


def test_hub_names_without_value_are_kept(table):
    df = table("name string", (None,), ("Kho Ahamove 1",), ("BC",))
    assert as_set(hubs.exclude_hubs(df, "name", P.EXCLUDED_HUB_MARKER)) == {(None,), ("BC",)}
    assert [r[0] for r in df.select(labels.pick_hub_bucket(F.col("name"))).collect()] == ["OTHER", "AHAMOVE", "OTHER"]


def test_nulls_sort_last_in_both_directions(table):
    df = table("a int, b int", (None, 1), (1, None), (1, 2), (1, 3))
    rows = [tuple(r) for r in df.orderBy(*values.nulls_last(a="asc", b="desc")).collect()]
    assert rows == [(1, 3), (1, 2), (1, None), (None, 1)]


# --- times ------------------------------------------------------------------------
def test_elapsed_units_are_completed_ones(table):
    df = table("a timestamp_ntz, b timestamp_ntz", (at(1), at(1, 23, 59, 59)), (at(1, 23), at(2, 1)), (None, at(1)))
    units = df.select(times.whole_units("HOUR", F.col("a"), F.col("b")), times.whole_units("DAY", F.col("a"), F.col("b")))
    assert [tuple(r) for r in units.collect()] == [(23, 0), (2, 0), (None, None)]


def test_order_day_turns_at_nineteen(table):
    df = table(
        "o timestamp_ntz, c timestamp_ntz", (at(1), at(1, 19)), (at(1), at(1, 18, 59, 59)), (at(1), at(2, 20)), (at(1), None)
    )
    days = [r[0] for r in df.select(times.order_date(F.col("o"), F.col("c"))).collect()]
    assert days == [date(2024, 1, 2), date(2024, 1, 1), date(2024, 1, 1), date(2024, 1, 1)]


def test_weeks_start_on_monday(table):
    df = table("t timestamp_ntz", (at(1, 0),), (at(7, 23, 59),), (at(8),))
    rows = df.select(times.monday_of(F.to_date("t")), times.week_start(F.col("t"))).collect()
    assert [r[0] for r in rows] == [date(2024, 1, 1), date(2024, 1, 1), date(2024, 1, 8)]
    assert [r[1] for r in rows] == [at(1), at(1), at(8)]


def test_instants_become_local_wall_time(table, spark):
    df = table("t string", ("2024-01-01T20:30:00Z",), ("2024-01-01T20:30:00.250+02:00",), (None,))
    wanted = [at(2, 3, 30), datetime(2024, 1, 2, 1, 30, 0, 250000), None]
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            assert [r[0] for r in df.select(times.local_time(F.col("t"), P.TRUCK_ZONE)).collect()] == wanted
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_report_windows_at_year_and_month_edges():
    assert windows.month_to_date_window(date(2024, 1, 31)) == windows.ReportWindow(
        date(2023, 10, 1), date(2024, 1, 31), date(2023, 10, 1)
    )
    assert windows.month_to_date_window(date(2024, 3, 1)).start == date(2023, 12, 1)
    assert windows.yesterday_window(date(2024, 3, 1)) == windows.ReportWindow(
        date(2024, 2, 29), date(2024, 2, 29), date(2024, 1, 31)
    )
    assert windows.local_day(datetime(2024, 1, 1, 17, 0), P.LOCAL_ZONE) == date(2024, 1, 2)
    assert windows.local_day(datetime(2024, 1, 1, 16, 59), P.LOCAL_ZONE) == date(2024, 1, 1)


def test_partition_bounds(table):
    df = table("dt string", ("2024-01-01",), ("2024-01-02",), ("2024-01-03",))
    first, last = date(2024, 1, 1), date(2024, 1, 3)

    def days(**how):
        return sorted(r[0][-1] for r in windows.partition_window(df, "dt", first, **how).collect())

    assert days(end=last) == ["1", "2"]
    assert days(end=last, closed=True) == ["1", "2", "3"]
    assert days(after_start=True) == ["2", "3"]
    assert days() == ["1", "2", "3"]


# --- hub scans and arrivals ----------------------------------------------------------
SCANS = (
    "order_code string, warehouse_id string, action_time timestamp_ntz, package_code string, trip_code string, "
    "action_category string"
)


def test_bad_hub_ids_raise_or_become_null(table):
    df = table(SCANS, ("o", "x9", at(1), "k", "t", "receive"), ("o", "12.5", at(1), "k", "t", "unpack"))
    assert {r.hub_id for r in hubs.hub_scans(df, ["receive", "unpack"], lenient_ids=True).collect()} == {None}
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        hubs.hub_scans(df, ["receive"]).collect()


CHECK_INS = "hub_id bigint, trip_code string, check_in_at timestamp_ntz, has_blank boolean"
PARSED = "order_code string, hub_id bigint, action_time timestamp_ntz, trip_code string, action_category string"


def test_first_arrival_rules(table):
    scans = table(
        PARSED,
        ("checked", 1, at(5), "t1", "receive"),  # earlier check-in counts
        ("late truck", 1, at(1), "t1", "receive"),  # a later check-in still replaces the scan
        ("blank", 1, at(5), "t2", "receive"),  # one check-in without time: the scan counts as well
        ("alone", 1, at(5), "t9", "receive"),  # no check-in of that trip
        ("no trip", 1, at(5), None, "receive"),
        ("opened", 1, at(5), "t1", "receive"),
        ("opened", 1, at(2), "t1", "unpack"),  # an unpack never takes the check-in
        ("sent", 1, at(1), "t1", "export"),  # exports are no arrivals
        ("elsewhere", 2, at(5), "t1", "receive"),  # same trip, other hub
        ("no hub", None, at(5), "t1", "receive"),
    )
    check_ins = table(
        CHECK_INS, (1, "t1", at(3), False), (1, "t2", at(6), True), (1, None, at(1), False), (None, "t1", at(1), False)
    )
    found = {r.order_code: r.arrived_at for r in A.first_arrival(scans, check_ins, "trip_code").collect()}
    assert found == {
        "checked": at(3),
        "late truck": at(3),
        "blank": at(5),
        "alone": at(5),
        "no trip": at(5),
        "opened": at(2),
        "elsewhere": at(5),
        "no hub": at(5),
    }


def test_several_truck_arrivals_collapse_to_the_first(table):
    events = table(
        "transportation_code string, location_id string, created_time timestamp_ntz, action_type string",
        ("t", "1", at(3), "VEHICLE_ARRIVE"),
        ("t", "1", at(2), "VEHICLE_ARRIVE"),
        ("t", "1", None, "VEHICLE_ARRIVE"),
        ("t", "1", at(1), "VEHICLE_LEAVE"),
    )
    assert as_set(A.truck_check_ins(events)) == {("t", 1, at(2), True)}
    assert A.vehicle_arrivals(events).count() == 3


def test_route_texts(table):
    routes = table(
        "partner_router string",
        ('[{"check_in_at":{"$date":"2024-01-01T20:00:00Z"},"stop_point":7,"items_dropped":["a","b"]}]',),
        ('[{"check_in_at":null,"stop_point":"S1","items_dropped":["c"]},{"stop_point":"S1","items_dropped":[]}]',),
        ('[{"stop_point":"S1","items_dropped":null},{"stop_point":"S9","items_dropped":["d"]}]',),
        ("{broken",),
        (None,),
    )
    stops = table("code string, hub_code string", ("7", "70"), ("S1", "n/a"))
    mapped = A.map_stops(A.route_stops(routes), stops).select("package_code", "hub_id", "check_in_at")
    assert as_set(mapped) == {("a", 70, at(2, 3)), ("b", 70, at(2, 3)), ("c", None, None), ("d", None, None)}


def test_check_ins_are_taken_from_routes_of_every_day(table):
    days = [None, datetime(1970, 1, 1), datetime(1995, 3, 31, 23), datetime(1995, 4, 1), datetime(2001, 6, 1), datetime(2030, 1, 1)]
    text = '[{{"check_in_at":{{"$date":"2024-01-01T20:00:00Z"}},"stop_point":"S1","items_dropped":["p{}"]}}]'
    routes = [(text.format(i), day) for i, day in enumerate(days)]
    sources = {
        "trip_route": table("partner_router string, updated_at_date timestamp_ntz", *routes),
        "stop_map": table("code string, hub_code string", ("S1", "70")),
    }
    check = CHECKS["d11_truck_checkin_route"]
    found = check.build(sources.__getitem__)
    assert as_set(found) == {(f"p{i}", 70, at(2, 3)) for i in range(len(days))}
    con = duckdb.connect()
    con.execute("CREATE TABLE trip_route (partner_router VARCHAR, updated_at_date TIMESTAMP)")
    con.executemany("INSERT INTO trip_route VALUES (?, ?)", routes)
    con.execute("CREATE TABLE stop_map AS SELECT 'S1' AS code, '70' AS hub_code")
    assert not differences(found, con, check.sql)


def _deliveries(table, rows, goals, transit_ids):
    reached = table("order_code string, hub_id bigint, arrived_at timestamp_ntz", *rows)
    wanted = table("order_code string, deliver_warehouse_id bigint", *goals)
    return A.delivery_arrivals(reached, wanted, table("hub_id bigint", *[(i,) for i in transit_ids]))


def test_only_strictly_earlier_transit_hubs_count(table):
    rows = [("o", 1, at(1)), ("o", 2, at(2)), ("o", 3, at(3)), ("o", 9, at(3)), ("o", 4, at(4)), ("never", 1, at(1))]
    found = _deliveries(table, rows, [("o", 9), ("o", 9), ("never", 9)], [1, 2, 3, 4])
    assert as_set(found.distinct()) == {("o", 9, at(3), 2)}
    assert as_set(A.hubs_passed(found)) == {("o", 2)}


def test_orders_with_two_delivery_hubs_use_the_later_arrival(table):
    rows = [("o", 1, at(1)), ("o", 8, at(2)), ("o", 2, at(3)), ("o", 9, at(4))]
    found = _deliveries(table, rows, [("o", 8), ("o", 9)], [1, 2])
    assert as_set(A.hubs_passed(found)) == {("o", 2)}


def test_five_and_more_passes(table):
    rows = [("o", i, at(i)) for i in range(1, 8)] + [("o", 99, at(20))]
    found = _deliveries(table, rows, [("o", 99)], range(1, 8))
    assert one(found.select(labels.pass_bucket(F.col("hubs_passed"))))[0] == ">=5_lan"


def test_an_order_with_two_lanes_counts_twice(table):
    cohort = table("order_code string, deliver_warehouse_id bigint, lane string", ("o", 9, "a"), ("o", 9, "b"), ("o", 8, "b"))
    reached = table("order_code string, hub_id bigint, arrived_at timestamp_ntz", ("o", 9, at(3, 22)), ("o", 8, at(4)))
    deliveries = A.delivery_arrivals(reached, cohort, table("hub_id bigint", (9,), (8,)))
    lanes = A.delivery_cohort(deliveries, ["lane"])
    # hub 9 is passed on the way to hub 8 and counts once although two lanes share it
    assert as_set(lanes) == {("o", "a", date(2024, 1, 3), 1), ("o", "b", date(2024, 1, 3), 1)}


# --- deadlines ------------------------------------------------------------------------
def test_deadline_buckets_at_their_edges(table):
    sla = at(10, 20)
    rows = [
        ("early city", 201, at(10, 8)),  # exactly 8:00: first class
        ("city", 201, at(10, 8, 0, 1)),
        ("exact", 305, at(10, 9)),
        ("land", 305, at(10, 9, 0, 1)),
        ("day before", 305, at(9, 14, 59, 59)),  # before 15:00 of the day before: on time
        ("not before", 305, at(9, 15)),  # exactly 15:00 is not
        ("two", 305, at(8, 23)),
        ("three", 305, at(7, 23)),
        ("late", 305, at(11)),
        ("unknown", None, at(10, 7)),
    ]
    df = table("order_code string, province_id int, received_time timestamp_ntz", *rows).select(
        "*", F.lit(sla).cast("timestamp_ntz").alias("sla_time"), F.lit(1).cast("bigint").alias("variants")
    )
    row = one(transit.sla_buckets(df.withColumn("g", F.lit(1)), ["g"])).asDict()
    assert row == {
        "g": 1, "ontime_tc": 3, "da_tre": 1, "D0C1": 2, "D0C2": 2, "D1C1": 0, "D1C2": 2, "D2": 1, "D3": 1, "tong_don": 10
    }


def test_cohort_counts_order_variants(table):
    orders = table(
        "order_code string, client_id bigint, status string, end_pick_time timestamp_ntz, pick_warehouse_id bigint, "
        "deliver_warehouse_id bigint",
        ("o", 1, "a", at(1, 1), 5, 9),
        ("o", 1, "a", at(1, 2), 5, 9),  # same pick day: no variant
        ("o", 1, "b", at(1, 2), 5, 9),
        ("o", 1, "b", at(2, 2), None, 9),
        ("o", 1, "b", None, 5, 9),  # never picked
    )
    promise = ("o", at(3), "p", "l", date(2024, 1, 1))
    sla = table(
        "ordercode string, deadlinedeliverysla timestamp_ntz, deliveryprovince string, externallane string, loaddate date",
        promise,
        promise,
        ("o", at(3), "p", "l", date(2024, 1, 5)),  # loaded on the report day
    )
    dim = table("warehouse_id bigint, province_id int, warehouse_name string", (9, 201, "BC"), (9, 201, "BC"))
    row = one(transit.transit_cohort(orders, sla, dim, start=date(2024, 1, 1), as_of=date(2024, 1, 5)))
    assert (row.order_code, row.variants, row.province_id) == ("o", 3, 201)


# --- pick-up ---------------------------------------------------------------------------
MART = (
    "ordercode string, currentstatus string, isexpecteddropoff boolean, canceltime timestamp_ntz, "
    "firstupdatedpickeduptime timestamp_ntz, orderdate timestamp_ntz, createddate timestamp_ntz, createddate_partition date, "
    "pickwh string"
)


def test_pickup_counts_rows_but_distinct_totals(table):
    day = date(2024, 1, 1)
    place = ("o", "18692", "p", "d", day)
    sla = table("ordercode string, clientid string, pickprovince string, pickdistrict string, loaddate date", place, place)
    fact = ("o", "delivered", None, None, at(1, 10), at(1), at(1, 8), day, None)
    mart = table(MART, fact, fact, ("o", None, None, None, at(2), at(1), at(1, 8), day, None))
    items = table("order_code string, type string, fail_note string, dt string", ("o", "PICK", P.STAFF_INCIDENT, "2024-01-01"))
    base = pickup.pickup_base(sla, mart, items, since=day, clients=P.PICKUP_CLIENTS)
    row = one(pickup.pickup_metrics(base, ["order_date"]))
    # two equal places times three mart rows; the one without status is no valid order
    assert tuple(row) == (day, 1, 4, 6, 2)


def test_cancelled_orders_count_only_when_cancelled_later(table):
    day = date(2024, 1, 1)
    rows = [
        ("same day", "cancel", False, at(1, 23), at(1), at(1), at(1, 8), day, "BC"),
        ("next day", "cancel", False, at(2), at(1), at(1), at(1, 8), day, "BC"),
        ("drop-off", "delivered", True, None, at(1), at(1), at(1, 8), day, "BC"),
        ("never", "cancel", False, None, None, at(1), at(1, 8), day, "BC"),
        ("key account", "delivered", False, None, at(1), at(1), at(1, 8), day, "Kho Key Account"),
    ]
    facts = {r.order_code: (r.is_valid, r.is_ontime) for r in pickup.pickup_facts(table(MART, *rows), day).collect()}
    assert facts == {"same day": (False, False), "next day": (True, True), "drop-off": (True, False), "never": (False, False)}


# --- failed deliveries ---------------------------------------------------------------------
def test_hub_ids_and_names_need_not_be_one_to_one(table):
    orders = table(
        "deliver_warehouse_id bigint, client_id bigint, status string",
        (1, 18692, "returned"), (1, 18692, "delivered"), (2, 5, "return"), (None, 5, "return"), (3, 5, "return"),
    )
    dim = table("warehouse_id bigint, warehouse_name string", (1, "A"), (1, "B"), (2, "A"), (3, "C"))
    found = failed.failed_delivery_by_hub(orders, dim, ["A", "B"])
    assert as_set(found) == {("A", "Shopee", 2, 1), ("B", "Shopee", 2, 1), ("A", "Khác", 1, 1)}


def test_pods_of_orders_with_and_without_entries(spark, table):
    pods = spark.createDataFrame(
        [
            ("full", [("s1", "r", at(1), 1.0, 2.0, True, ["u", None, "v"]), ("s2", None, None, None, None, None, None)]),
            ("full", []),
            ("empty", []),
            ("null", None),
            ("hole", [None]),
            ("other", [("s3", "r", at(1), 1.0, 2.0, True, ["w"])]),
        ],
        "order_code string, pods array<struct<order_status:string,reason:string,time:timestamp_ntz,lat:double,lng:double,"
        "is_correct:boolean,urls:array<string>>>",
    )
    sample = table("order_code string, n int", ("full", 1), ("empty", 2), ("null", 3), ("hole", 4), ("absent", 5), ("full", 6))
    found = failed.pod_attach(sample, pods).select("order_code", "n", "pod_status", "pod_url_list")
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [
            ("full", 1, "s1", "u | v"), ("full", 1, "s2", None), ("full", 6, "s1", "u | v"), ("full", 6, "s2", None),
            ("empty", 2, None, None), ("null", 3, None, None), ("hole", 4, None, None), ("absent", 5, None, None),
        ],
        key=str,
    )
    assert failed.pods_of(pods, sample).count() == 3


# --- backlog ----------------------------------------------------------------------------------
def test_latest_row_is_determined_even_on_ties(table):
    df = table("k string, t timestamp_ntz, a string", ("x", at(1), "z"), ("x", at(2), "a"), ("x", at(2), "b"), ("y", None, "q"))
    for order in ("a", F.desc("a")):
        assert as_set(backlog.latest_rows(df.orderBy(order), "k", "t")) == {("x", at(2), "b"), ("y", None, "q")}


def test_last_scans_cover_every_pending_hub_of_an_order(table):
    scans = table(
        "order_code string, warehouse_id string, action_time timestamp_ntz, action_name string, action_category string",
        ("o", "1", at(1), "RECEIVE_PACKAGE", "receive"),
        ("o", "2", at(3), "RECEIVE_PACKAGE", "receive"),
        ("o", "3", at(9), "RECEIVE_PACKAGE", "receive"),
        ("o", "1", at(2), "UNPACK", "unpack"),
        ("p", "1", at(2), "EXPORT", "export"),
    )
    pending = table("order_code string, deliver_warehouse_id bigint", ("o", 1), ("o", 2), ("o", 2), ("p", 1))
    assert as_set(backlog.last_scans(scans, pending)) == {("o", at(3), at(2))}


def test_inbound_tiers_and_age(table):
    df = table(
        "k string, ibh_from_receive timestamp_ntz, ibh_from_unpack timestamp_ntz, end_pick_time timestamp_ntz",
        ("r", at(1), at(2), at(3)), ("u", None, at(2), at(3)), ("e", None, None, at(3)), ("n", None, None, None),
    )
    aged = backlog.pending_age(backlog.inbound_time(df), at(4, 0, 0, 0)).select("k", "ibh_source", "pending_hours", "pending_days")
    assert as_set(aged) == {("r", "receive_package", 72, 3), ("u", "unpack", 48, 2), ("e", "end_pick_time", 24, 1), ("n",) + (None,) * 3}


def test_ward_labels_may_come_from_different_rows(table):
    wards = table("ward_id bigint, province_name string, district_name string, ward_name string", (1, "a", "z", "m"), (1, "b", "y", None))
    orders = table("order_code string, to_ward_code string, to_ward_id_v2 bigint", ("o", None, 1), ("p", "1", 5), ("q", None, None))
    found = hubs.ward_lookup(orders, wards).select("order_code", "province_name", "district_name", "ward_name")
    assert as_set(found) == {("o", "b", "z", "m"), ("p", "b", "z", "m"), ("q", None, None, None)}


# --- daily metrics --------------------------------------------------------------------------------
def test_ratio_without_deliveries_is_null(table):
    df = table(
        "createddate date, enddeliveredtime timestamp_ntz, toprovince string, ontimeenddelivery int, delivered int",
        (date(2024, 1, 1), at(4, 3), "p", 0, 0), (date(2024, 1, 1), at(4, 23), "q", 1, 1), (date(2024, 1, 1), at(4), "q", 0, 1),
        (date(2024, 1, 1), at(5), "q", 1, 1), (date(2023, 12, 5), at(4), "q", 1, 1),
    )
    found = metrics.delivered_ratio(df, date(2024, 1, 5))
    assert as_set(found) == {(date(2024, 1, 4), "p", None), (date(2024, 1, 4), "q", 0.5)}


# --- weights ------------------------------------------------------------------------------------------
LOG = "order_code string, location_id string, action string, last_updated_time timestamp_ntz, data string"
DIMS = '{"dwsLength":10,"dwsWidth":"20","dwsHeight":30.5}'


def weights(table, *rows, same_hub):
    minutes = measures.minute_maxima(measures.measurements(table(LOG, *rows)))
    return {r.order_code: r.asDict() for r in measures.order_weights(minutes, same_hub=same_hub).collect()}


def test_measurement_branches(table):
    rows = [
        ("o", P.HUB_HY, P.SORTING, at(1), '{"feederWeight":"1500","weight":9}'),
        ("o", P.HUB_XA, P.SORTING, at(1), '{"feederWeight":1600}'),
        ("o", P.HUB_HY, P.WEIGHING, at(1), '{"weight":1700}'),
        ("o", P.HUB_XA, P.WEIGHING, at(1), '{"weight":1800}'),  # weighing counts at HY only
        ("o", P.HUB_XA, P.DWS, at(1), '{"dwsWeight":5,"dwsLength":1,"dwsWidth":2,"dwsHeight":3}'),  # sizes only
        ("o", P.HUB_XA, P.MATRIX, at(1), '{"dwsWeight":"1900","dwsLength":"x"}'),
        ("o", "77", P.MATRIX, at(1), '{"dwsWeight":1}'),
        (None, P.HUB_HY, P.SORTING, at(1), '{"feederWeight":1}'),
        ("o", P.HUB_HY, P.SORTING, at(1), "{bad"),
        ("o", P.HUB_HY, P.SORTING, at(1), '{"feederWeight":{"a":1}}'),
    ]
    found = measures.measurements(table(LOG, *rows)).select("location_id", "weight_g", "length_mm", "height_mm").collect()
    assert sorted(map(tuple, found), key=str) == sorted(
        [
            (P.HUB_HY, 1500.0, None, None), (P.HUB_XA, 1600.0, None, None), (P.HUB_HY, 1700.0, None, None),
            (P.HUB_XA, None, 1.0, 3.0), (P.HUB_XA, 1900.0, None, None), (P.HUB_HY, None, None, None), (P.HUB_HY, None, None, None),
        ],
        key=str,
    )


def test_full_measurement_rule_differs_between_summary_and_detail(table):
    rows = [
        ("o", P.HUB_HY, P.SORTING, at(1, 1), '{"feederWeight":1000}'),
        ("o", P.HUB_HY, P.DWS, at(1, 2), DIMS),  # sizes an hour later still complete HY
        ("o", P.HUB_XA, P.SORTING, at(2), '{"feederWeight":3500}'),  # XA has no sizes
        ("p", P.HUB_XA, P.SORTING, at(2), '{"feederWeight":3500}'),  # measured nowhere
    ]
    strict, loose = weights(table, *rows, same_hub=True), weights(table, *rows, same_hub=False)
    assert set(strict) == set(loose) == {"o"}
    assert (strict["o"]["last_HY"], strict["o"]["last_XA"], strict["o"]["passes_XA"]) == (1.0, None, 0)
    assert (loose["o"]["last_HY"], loose["o"]["last_XA"], loose["o"]["passes_XA"]) == (1.0, 3.5, 1)


def test_passes_are_minutes_and_take_the_largest_weight(table):
    rows = [
        ("o", P.HUB_HY, P.SORTING, at(1, 1, 0, 5), '{"feederWeight":1000}'),
        ("o", P.HUB_HY, P.SORTING, at(1, 1, 0, 50), '{"feederWeight":1200.4}'),
        ("o", P.HUB_HY, P.SORTING, at(1, 1, 1, 0), '{"feederWeight":0}'),  # no weight, no pass
        ("o", P.HUB_HY, P.SORTING, at(1, 5), '{"feederWeight":2200.4}'),
        ("o", P.HUB_HY, P.DWS, at(1, 2), DIMS),
    ]
    row = weights(table, *rows, same_hub=True)["o"]
    assert (row["first_HY"], row["last_HY"], row["passes_HY"]) == (1.2, 2.2, 2)


PROFILE = (
    "order_code string, first_HY double, last_HY double, passes_HY bigint, first_XA double, last_XA double, passes_XA bigint"
)


def test_gap_rules(table):
    profile = table(
        PROFILE,
        ("both", 1.0, 2.0, 2, 5.0, 2.0, 3), ("hy", 1.0, 3.0, 2, None, None, 0), ("cross", 1.0, 1.0, 1, 4.0, 4.0, 1),
        ("single", 1.0, 1.0, 1, None, None, 0),
    )
    summary = {r.order_code: (r.gap_HY, r.gap_XY, r.gap_2_kho) for r in measures.weight_gaps(profile).collect()}
    assert summary == {"both": (1.0, 3.0, 0.0), "hy": (2.0, None, None), "cross": (None, None, 3.0), "single": (None,) * 3}
    audit = {r.order_code: (r.gap1, r.gap2) for r in measures.audit_gaps(profile).collect()}
    assert audit == {"both": (3.0, 0.0), "hy": (2.0, None), "cross": (None, 3.0)}


COHORT = "ordercode string, success_date date, client_type string, journey_type string"


def test_gap_bands_include_both_edges_in_the_middle(table):
    day = date(2024, 1, 1)
    cohort = table(COHORT, *[(k, day, "c", "deli") for k in ("a", "b", "c", "d", "e", "a")])
    gaps = table(
        "order_code string, last_HY double, last_XA double, gap_HY double, gap_XY double, gap_2_kho double",
        ("a", 1.0, None, 1.0, None, None), ("b", 1.0, None, 2.0, None, None), ("c", 1.0, 2.0, 0.999, None, 2.001), ("z", 1.0),
    )
    row = one(measures.gap_bands(cohort, gaps))
    assert (row.mau_total_toan_quoc, row.tu_do_dac_HY, row.tu_do_dac_XA) == (5, 3, 1)
    assert (row.gap_HY_duoi_1kg, row.gap_HY_1_den_2kg, row.gap_HY_tren_2kg, row.gap_2_kho_tren_2kg) == (1, 2, 0, 1)


def test_detail_keeps_repeated_orders(table):
    day = date(2024, 1, 1)
    cohort = table(COHORT, ("a", day, "c", "deli"), ("a", day, "c", "deli"), ("a", day, "c", "return"), ("b", day, "c", "deli"))
    gaps = table("order_code string, last_HY double, last_XA double, gap1 double, gap2 double", ("a", 1.0, None, 0.5, None))
    rows = measures.gap_detail(cohort, gaps).collect()
    assert sorted((r.ordercode, r.journey_type, r.id_ktc) for r in rows) == [("a", "deli", P.HUB_HY)] * 2 + [("a", "return", P.HUB_HY)]


def test_rows_repeat_across_blocks(table):
    df = table("k string, n bigint", ("a", 1), ("b", 4), ("c", 9), ("d", 8))
    counts = measures.repeat_rows(df, "n", block=4).groupBy("k").count()
    assert as_set(counts) == {("a", 1), ("b", 4), ("c", 9), ("d", 8)}


def test_cohort_needs_its_own_completion_time(table):
    mart = table(
        "ordercode string, clientid bigint, currentstatus string, enddeliverytime timestamp_ntz, endreturntime timestamp_ntz, "
        "createddate_partition date",
        ("in", P.CLIENT_TTSE, "delivered", at(2, 23, 59), None, date(2024, 1, 1)),
        ("returned", P.CLIENT_TTSB, "returned", at(9), at(2), date(2024, 1, 1)),
        ("wrong time", P.CLIENT_TTSB, "returned", at(2), None, date(2024, 1, 1)),
        ("after", P.CLIENT_TTSE, "delivered", at(3), None, date(2024, 1, 1)),
        ("old", P.CLIENT_TTSE, "delivered", at(2), None, date(2023, 12, 31)),
        ("other client", 1, "delivered", at(2), None, date(2024, 1, 1)),
        ("open", P.CLIENT_TTSE, "storing", at(2), at(2), date(2024, 1, 1)),
    )
    window = windows.ReportWindow(date(2024, 1, 2), date(2024, 1, 2), date(2024, 1, 1))
    assert as_set(measures.completed_cohort(mart, window)) == {
        ("in", date(2024, 1, 2), "TTS_Exp", "deli"),
        ("returned", date(2024, 1, 2), "TTS_Bulky", "return"),
    }
