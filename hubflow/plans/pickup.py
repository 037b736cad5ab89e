"""Pickup punctuality by day and district."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from hubflow import params as P
from hubflow.functions.values import nulls_last
from hubflow.operators.pickup import pickup_base, pickup_metrics


def pickup_ontime_daily(
    sla: DataFrame, mart: DataFrame, trip_items: DataFrame, *, since: date, clients: tuple[str, ...] = P.PICKUP_CLIENTS
) -> DataFrame:
    """One row per order day, pick-up province and district."""
    base = pickup_base(sla, mart, trip_items, since=since, clients=clients)
    metrics = pickup_metrics(base, ["order_date", "pickprovince", "pickdistrict"])
    return metrics.orderBy(*nulls_last(order_date="desc", pu_total_orders="desc"))
