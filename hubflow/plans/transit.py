"""Weekly transit reports of one client."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow import params as P
from hubflow.functions.labels import pass_bucket
from hubflow.functions.times import monday_of, week_start
from hubflow.functions.values import nulls_last
from hubflow.operators import arrivals as A
from hubflow.operators import transit as T
from hubflow.operators.hubs import hub_scans, hubs_of_type, passing_scans, relevant_scans
from hubflow.operators.keyset import KeyBits
from hubflow.operators.windows import partition_window
from hubflow.sources.staging import staged

_ARRIVAL_SCANS = (P.RECEIVE, P.UNPACK)


def hub_pass_weekly(
    scans: DataFrame,
    truck_events: DataFrame,
    orders: DataFrame,
    sla: DataFrame,
    hubs: DataFrame,
    *,
    since: date,
    as_of: date,
    client_id: int = P.CLIENT_SPB,
    channel: str = P.BULKY_CHANNEL,
    partials: bool = False,
) -> DataFrame:
    """Orders per week, client, service class, province, lane and number of transit hubs passed.

    With ``partials``, ``scans`` are the daily partials of ``arrival_partials`` instead of the log.

    The log is cut to the client's orders, and to the hubs that can matter for them, before anything else; that key
    set ignores deadlines and hub names, which the cohort applies afterwards. What is left is staged, since it tells
    which trips are needed: truck events of other trips go before the first shuffle.
    """
    client_orders = partition_window(orders, "dt", since, as_of).filter(F.col("client_id") == client_id)
    cohort = T.bulky_cohort(client_orders, sla, hubs, since=since, as_of=as_of, channel=channel)
    transit_hubs = hubs_of_type(hubs, P.TRANSIT_HUB)
    read = partition_window(scans, "dt", since, as_of)
    read = read.drop("dt") if partials else hub_scans(read, _ARRIVAL_SCANS)
    seen = staged(passing_scans(read, client_orders, transit_hubs), "passing-scans")
    trips = KeyBits(A.received(seen), "trip_code")
    arrivals = A.first_arrival(seen, A.truck_check_ins(partition_window(truck_events, "dt", since, as_of), trips), "trip_code")
    deliveries = A.delivery_arrivals(arrivals, cohort, transit_hubs)
    groups = ["client_id", "client_channel", "service_type", "deli_province", "externallane"]
    reached = partition_window(A.delivery_cohort(deliveries, groups), "created_date", since, as_of)
    return (
        reached.groupBy(
            monday_of(F.col("created_date")).alias("week_start"), *groups, pass_bucket(F.col("hubs_passed")).alias("ktc_pass")
        )
        .agg(F.count("order_code").alias("total_orders"))
        .orderBy(*nulls_last(week_start="asc", total_orders="desc"))
    )


def transit_sla_weekly(
    orders: DataFrame,
    sla: DataFrame,
    hubs: DataFrame,
    scans: DataFrame,
    routes: DataFrame,
    stop_map: DataFrame,
    *,
    as_of: date,
    since: date,
    lookback_days: int = 60,
    client_id: int = P.CLIENT_SPB,
) -> DataFrame:
    """Orders per week, province and lane by how early or late they reached the delivery hub.

    Only scans at an order's delivery hub can matter, so the log is cut to those
    (order, hub) pairs. They are staged, since they tell which packages are needed: of the routes of all clients, other
    packages go where they are unfolded, before the first shuffle.
    """
    start = as_of - timedelta(days=lookback_days)
    client_orders = partition_window(orders, "dt", start, as_of).filter(F.col("client_id") == client_id)
    cohort = T.transit_cohort(client_orders, sla, hubs, start=start, as_of=as_of)
    goals = client_orders.filter(F.col("end_pick_time").isNotNull()).withColumnRenamed("deliver_warehouse_id", "hub_id")
    seen = relevant_scans(
        hub_scans(partition_window(scans, "dt", start, as_of), _ARRIVAL_SCANS, lenient_ids=True), goals, ["order_code", "hub_id"]
    )
    seen = staged(seen, "delivery-scans")
    packages = KeyBits(A.received(seen), "package_code")
    check_ins = A.route_check_ins(partition_window(routes, "updated_at_date", start, as_of), stop_map, wanted=packages)
    arrivals = A.first_arrival(seen, check_ins, "package_code")
    reached = partition_window(T.arrival_rollup(cohort, arrivals), "received_time", since, as_of)
    return T.sla_buckets(
        reached.withColumn("week_start", week_start(F.col("received_time"))), ["week_start", "deli_province", "externallane"]
    )
