"""First arrival of an order at a hub, from scans and truck check-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hubflow import params as P
from hubflow.functions.times import local_time
from hubflow.functions.values import count_if, lenient
from hubflow.operators.keyset import KeyBits

_ROUTE = "array<struct<check_in_at:struct<`$date`:string>,stop_point:string,items_dropped:array<string>>>"


def vehicle_arrivals(events: DataFrame) -> DataFrame:
    """Truck arrivals as (trip, hub, time); a trip may arrive at a hub more than once."""
    return events.filter(F.col("action_type") == P.VEHICLE_ARRIVE).select(
        F.col("transportation_code").alias("trip_code"),
        "location_id",
        F.col("location_id").cast("int").cast("bigint").alias("hub_id"),
        F.col("created_time").cast("timestamp_ntz").alias("check_in_at"),
    )


def route_stops(routes: DataFrame, zone: str = P.TRUCK_ZONE, wanted: KeyBits | None = None) -> DataFrame:
    """Packages dropped at each stop of a route with the local check-in time.

    Stops without dropped packages disappear, stops without a check-in stay. With ``wanted``, packages that are surely not
    among its keys go where they are unfolded, before anything is shuffled.
    """
    stops = routes.select(F.explode(F.from_json("partner_router", _ROUTE)).alias("stop"))
    dropped = stops.filter(F.size("stop.items_dropped") > 0).select(
        F.col("stop.stop_point").alias("stop_point"),
        local_time(F.col("stop.check_in_at").getField("$date"), zone).alias("check_in_at"),
        F.explode("stop.items_dropped").alias("package_code"),
    )
    return dropped if wanted is None else dropped.filter(wanted.may_hold(F.col("package_code")))


def map_stops(rows: DataFrame, stop_map: DataFrame) -> DataFrame:
    """Hub id of each stop code; unknown stops and malformed hub codes give null."""
    codes = stop_map.select(
        F.col("code").alias("stop_point"), lenient(F.col("hub_code"), "int").cast("bigint").alias("hub_id")
    )
    return rows.join(codes, "stop_point", "left")


def earliest_check_in(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Earliest check-in per key, and whether one of its rows had no time."""
    return rows.groupBy(*keys).agg(
        F.min("check_in_at").alias("check_in_at"), F.max(F.col("check_in_at").isNull()).alias("has_blank")
    )


def truck_check_ins(events: DataFrame, wanted: KeyBits | None = None) -> DataFrame:
    """Check-ins by trip and hub from truck events, of all trips or of the ``wanted`` ones (and a few by chance).

    Rows are collapsed by the hub id's text and parsed afterwards, so the later
    join on the parsed id starts from an exchange that Spark can split.
    """
    arrivals = vehicle_arrivals(events if wanted is None else events.filter(wanted.may_hold(F.col("transportation_code"))))
    early = earliest_check_in(arrivals, ["trip_code", "location_id"])
    return early.select(
        "trip_code", F.col("location_id").cast("int").cast("bigint").alias("hub_id"), "check_in_at", "has_blank"
    )


def route_check_ins(routes: DataFrame, stop_map: DataFrame, zone: str = P.TRUCK_ZONE, wanted: KeyBits | None = None) -> DataFrame:
    """Check-ins by package and hub from route JSON, of all packages or of the ``wanted`` ones (and a few by chance)."""
    return map_stops(earliest_check_in(route_stops(routes, zone, wanted), ["package_code", "stop_point"]), stop_map).drop("stop_point")


def received(scans: DataFrame) -> DataFrame:
    """Scans whose arrival time depends on a check-in of their carrier."""
    return scans.filter(F.col("action_category") == P.RECEIVE)


def first_arrival(scans: DataFrame, check_ins: DataFrame, carrier: str) -> DataFrame:
    """Earliest arrival per order and hub.

    A receive scan counts at the check-in time of its carrier (the trip or the
    package) at that hub, or at the scan time where no check-in is known; an
    unpack scan counts at the scan time. The earliest of all is kept, so scans
    are first collapsed per order, hub and carrier, and check-ins come collapsed.
    """
    seen = (
        scans.filter(F.col("action_category").isin(P.RECEIVE, P.UNPACK))
        .withColumn("carrier", F.when(F.col("action_category") == P.RECEIVE, F.col(carrier)))
        .groupBy("order_code", "hub_id", "carrier")
        .agg(F.min("action_time").alias("scanned_at"))
        # Scans without a carrier match nothing: spread them by order instead of
        # sending them all to one task.
        .withColumn("has_carrier", F.col("carrier").isNotNull())
        .withColumn("carrier", F.coalesce("carrier", "order_code"))
    )
    known = check_ins.select("hub_id", F.col(carrier).alias("carrier"), "check_in_at", "has_blank")
    known = known.withColumn("has_carrier", F.col("carrier").isNotNull())
    arrived = F.least("check_in_at", F.when(F.coalesce("has_blank", F.lit(True)), F.col("scanned_at")))
    return (
        seen.join(known, ["hub_id", "carrier", "has_carrier"], "left")
        .groupBy("order_code", "hub_id")
        .agg(F.min(arrived).alias("arrived_at"))
    )


def delivery_arrivals(arrivals: DataFrame, cohort: DataFrame, transit_hubs: DataFrame) -> DataFrame:
    """Cohort rows that reached their delivery hub, with the arrival and the transit hubs passed before.

    ``cohort`` holds order_code, deliver_warehouse_id and any attributes. A
    transit hub counts if the order's first arrival there is strictly earlier
    than its first arrival at a delivery hub. The windows span the hubs of one
    order, so their size is bounded; cohort and log are each read once.
    """
    goals = cohort.withColumnRenamed("deliver_warehouse_id", "hub_id").withColumn("is_goal", F.lit(True))
    order = Window.partitionBy("order_code")
    # Several cohort rows may share a hub, which still counts once.
    single = F.row_number().over(Window.partitionBy("order_code", "hub_id").orderBy("arrived_at")) == 1
    passed = F.col("is_transit") & F.col("is_single") & (F.col("arrived_at") < F.col("reached_at"))
    return (
        arrivals.join(goals, ["order_code", "hub_id"], "left")
        .withColumn("is_single", single)
        .join(transit_hubs.withColumn("is_transit", F.lit(True)), "hub_id", "left")
        .withColumn("reached_at", F.max(F.when(F.col("is_goal"), F.col("arrived_at"))).over(order))
        .withColumn("hubs_passed", count_if(passed).over(order))
        .filter("is_goal")
        .withColumnRenamed("hub_id", "deliver_warehouse_id")
        .select(*cohort.columns, "arrived_at", "hubs_passed")
    )


def hubs_passed(deliveries: DataFrame) -> DataFrame:
    """Orders that passed at least one transit hub, with the count."""
    return (
        deliveries.groupBy("order_code").agg(F.max("hubs_passed").alias("hubs_passed")).filter(F.col("hubs_passed") > 0)
    )


def delivery_cohort(deliveries: DataFrame, attributes: list[str]) -> DataFrame:
    """Orders that reached their delivery hub, by attributes, with the day of the first arrival."""
    return deliveries.groupBy("order_code", *attributes).agg(
        F.to_date(F.min("arrived_at")).alias("created_date"), F.max("hubs_passed").alias("hubs_passed")
    )
