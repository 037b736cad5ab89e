"""Pickup punctuality and staff incidents."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow import params as P
from hubflow.functions.labels import pick_hub_bucket
from hubflow.functions.times import order_date
from hubflow.functions.values import sum_if
from hubflow.operators.windows import partition_window


def incident_orders(trip_items: DataFrame, since: date) -> DataFrame:
    """Distinct orders with a pick-up attempt that failed by a staff incident."""
    picks = partition_window(trip_items, "dt", since).filter(
        (F.col("type") == P.PICK_ITEM) & (F.col("fail_note") == P.STAFF_INCIDENT)
    )
    return picks.select("order_code").distinct()


def flag_incidents(df: DataFrame, incidents: DataFrame) -> DataFrame:
    """1 for orders in the incident set, 0 for the others."""
    marked = df.join(incidents.withColumn("hit", F.lit(1)), "order_code", "left")
    return marked.withColumn("has_nvgsc", F.coalesce("hit", F.lit(0))).drop("hit")


def pickup_facts(mart: DataFrame, since: date) -> DataFrame:
    """Order day and punctuality flags of orders picked at ordinary hubs."""
    kept = partition_window(mart, "createddate_partition", since).filter(pick_hub_bucket(F.col("pickwh")) == "OTHER")
    day = order_date(F.col("orderdate"), F.col("createddate"))
    dated = kept.select("*", day.alias("order_date"))
    cancelled, picked = F.to_date("canceltime"), F.to_date("firstupdatedpickeduptime")
    status = F.col("currentstatus")
    valid = ((status == P.CANCELLED) & (cancelled > F.col("order_date"))) | (status != P.CANCELLED)
    ontime = valid & ~F.coalesce("isexpecteddropoff", F.lit(False)) & (picked <= F.col("order_date"))
    flags = {"is_valid": valid, "is_ontime": ontime, "is_late": picked > F.col("order_date")}
    return dated.select(
        F.col("ordercode").alias("order_code"),
        "order_date",
        *[F.coalesce(flag, F.lit(False)).alias(name) for name, flag in flags.items()],
    )


def pickup_places(sla: DataFrame, since: date, clients: tuple[str, ...]) -> DataFrame:
    """Pick-up province and district per order, with the number of equal rows."""
    kept = partition_window(sla, "loaddate", since).filter(F.col("clientid").isin(*clients))
    return kept.groupBy(F.col("ordercode").alias("order_code"), "pickprovince", "pickdistrict").agg(
        F.count(F.lit(1)).alias("weight")
    )


def pickup_base(sla: DataFrame, mart: DataFrame, trip_items: DataFrame, *, since: date, clients: tuple[str, ...]) -> DataFrame:
    """Places joined to facts; ``weight`` is the number of equal places each line stands for.

    Only one side needs collapsing to keep many rows of one order from pairing
    up; the smaller one is, the mart of all clients is shuffled once.
    """
    joined = pickup_places(sla, since, clients).join(pickup_facts(mart, since), "order_code")
    return flag_incidents(joined, incident_orders(trip_items, since))


def pickup_metrics(base: DataFrame, groups: list[str]) -> DataFrame:
    """Distinct valid orders, and row counts of on-time, incident and late-with-incident pick-ups."""
    weight, incident = F.col("weight"), F.col("has_nvgsc") == 1
    return base.groupBy(*groups).agg(
        F.countDistinct(F.when(F.col("is_valid"), F.col("order_code"))).alias("pu_total_orders"),
        sum_if(F.col("is_ontime"), weight).alias("ontime_pu_orders"),
        sum_if(incident, weight).alias("don_co_attempt_nvgsc"),
        sum_if(F.col("is_late") & incident, weight).alias("don_late_va_nvgsc"),
    )
