"""Daily delivery, creation and backlog metrics of express orders."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from hubflow.functions.values import nulls_last
from hubflow.operators.metrics import backlog_by_age, created_volume, delivered_ratio, metric_union


def express_daily_metrics(orders: DataFrame, backlog: DataFrame, *, as_of: date) -> DataFrame:
    """One row per day, province, metric and (for backlog) age label."""
    metrics = metric_union(
        {
            "DELIVERED": delivered_ratio(orders, as_of),
            "CREATED": created_volume(orders, as_of),
            "BACKLOG": backlog_by_age(backlog, as_of),
        }
    )
    return metrics.orderBy(*nulls_last(report_date="desc", toprovince="asc", metric_type="asc", tuoibacklog="asc"))
