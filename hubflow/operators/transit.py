"""Delivery-deadline cohorts and lateness buckets."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow import params as P
from hubflow.functions.labels import service_class
from hubflow.functions.times import day_at, local_cutoff, network_deadline
from hubflow.functions.values import sum_if
from hubflow.operators.hubs import exclude_hubs
from hubflow.operators.windows import partition_window


def sla_deadlines(df: DataFrame) -> DataFrame:
    """Add the network deadline and the two local cut-offs (equal by definition)."""
    return df.select(
        "*",
        network_deadline(F.col("sla_time")).alias("deadline_network"),
        local_cutoff(F.col("end_pick_time")).alias("deadline_lc"),
        local_cutoff(F.col("end_pick_time")).alias("deadline_dong_kien"),
    )


def sla_rows(sla: DataFrame, start: date, as_of: date) -> DataFrame:
    """Promises per order loaded from ``start`` up to yesterday."""
    loaded = partition_window(sla, "loaddate", start, as_of - timedelta(days=1), closed=True)
    return loaded.select(
        F.col("ordercode").alias("order_code"),
        F.col("deadlinedeliverysla").alias("sla_time"),
        F.col("deliveryprovince").alias("deli_province"),
        "externallane",
    )


def sla_join(orders: DataFrame, promises: DataFrame, hubs: DataFrame, marker: str = P.EXCLUDED_HUB_MARKER) -> DataFrame:
    """Orders with their promises and delivery-hub attributes.

    The load-date range on the promises makes that join inner; orders of an
    unknown hub stay, those of an excluded hub go. Orders come collapsed, the
    promises of all clients do not: equal rows are removed after the join, where
    few are left and the partitioning by order already serves.
    """
    dim = hubs.select(F.col("warehouse_id").alias("deliver_warehouse_id"), "province_id", "warehouse_name").distinct()
    kept = exclude_hubs(orders.join(dim, "deliver_warehouse_id", "left"), "warehouse_name", marker)
    return kept.join(promises, "order_code")


def bulky_cohort(client_orders: DataFrame, sla: DataFrame, hubs: DataFrame, *, since: date, as_of: date, channel: str) -> DataFrame:
    """Distinct (order, client, service class, delivery hub, province, lane) of a client."""
    orders = client_orders.select(
        "order_code",
        "client_id",
        service_class(F.col("weight"), F.col("converted_weight")).alias("service_type"),
        "deliver_warehouse_id",
    ).distinct()
    return (
        sla_join(orders, sla_rows(sla, since, as_of), hubs)
        .withColumn("client_channel", F.lit(channel))
        .select("order_code", "deliver_warehouse_id", "client_id", "client_channel", "service_type", "deli_province", "externallane")
        .distinct()
    )


def transit_cohort(client_orders: DataFrame, sla: DataFrame, hubs: DataFrame, *, start: date, as_of: date) -> DataFrame:
    """Picked orders with promise and hub province.

    The weekly report counts distinct (status, pick hub, pick day) variants of
    an order; they are counted here as ``variants`` instead of being carried.
    """
    orders = (
        client_orders.filter(F.col("end_pick_time").isNotNull())
        .select("order_code", "deliver_warehouse_id", "status", "pick_warehouse_id", F.to_date("end_pick_time").alias("picked"))
        .distinct()
        .groupBy("order_code", "deliver_warehouse_id")
        .agg(F.count(F.lit(1)).alias("variants"))
    )
    return sla_join(orders, sla_rows(sla, start, as_of), hubs).distinct()


def arrival_rollup(cohort: DataFrame, arrivals: DataFrame, exports: DataFrame | None = None) -> DataFrame:
    """Per cohort row the first arrival at its delivery hub and, on request, the first export from its pick hub.

    ``arrivals`` holds one row per order and hub; exports are collapsed likewise
    first, so neither join multiplies rows.
    """
    received = arrivals.select(
        "order_code", F.col("hub_id").alias("deliver_warehouse_id"), F.col("arrived_at").alias("received_time")
    )
    result = cohort.join(received, ["order_code", "deliver_warehouse_id"], "left")
    if exports is None:
        return result
    sent = (
        exports.filter(F.col("action_category") == P.EXPORT)
        .groupBy("order_code", F.col("hub_id").alias("pick_warehouse_id"))
        .agg(F.min("action_time").alias("pick_delivered_time"))
    )
    return result.join(sent, ["order_code", "pick_warehouse_id"], "left")


def sla_buckets(df: DataFrame, groups: list[str]) -> DataFrame:
    """Weighted order counts by how early or late they reached the delivery hub.

    The on-time count is measured against the network deadline and overlaps the
    day buckets. Orders without a province fall in neither cut-off class.
    """
    received, weight = F.col("received_time"), F.col("variants")
    arrived, promised = F.to_date("received_time"), F.to_date("sla_time")
    early_province = F.col("province_id").isin(*P.EARLY_CUTOFF_PROVINCES)
    cutoff = F.when(early_province, day_at(received, P.EARLY_CUTOFF_HOUR)).when(~early_province, day_at(received, P.CUTOFF_HOUR))
    first_class, second_class = received <= cutoff, received > cutoff
    days_early = F.datediff(promised, arrived)
    buckets = {
        "ontime_tc": received < network_deadline(F.col("sla_time")),
        "da_tre": days_early < 0,
        "D0C2": (days_early == 0) & second_class,
        "D0C1": (days_early == 0) & first_class,
        "D1C2": (days_early == 1) & second_class,
        "D1C1": (days_early == 1) & first_class,
        "D2": days_early == 2,
        "D3": days_early > 2,
    }
    counts = [sum_if(condition, weight).alias(name) for name, condition in buckets.items()]
    return df.groupBy(*groups).agg(*counts, F.sum(weight).alias("tong_don"))
