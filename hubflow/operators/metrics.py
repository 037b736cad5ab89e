"""Daily metrics in one long table."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow import params as P
from hubflow.operators.windows import partition_window


def delivered_ratio(orders: DataFrame, as_of: date, lookback_days: int = 30) -> DataFrame:
    """Share of yesterday's deliveries that were on time, per province; null where none counts as delivered."""
    recent = partition_window(orders, "createddate", as_of - timedelta(days=lookback_days))
    day = F.to_date("enddeliveredtime")
    return (
        recent.filter(day == F.lit(as_of - timedelta(days=1)))
        .groupBy(day.alias("report_date"), "toprovince")
        .agg((F.sum("ontimeenddelivery").cast("double") / F.nullif(F.sum("delivered"), F.lit(0))).alias("metrics"))
    )


def created_volume(orders: DataFrame, as_of: date, lookback_days: int = 30) -> DataFrame:
    """Distinct orders that were not cancelled, per creation day and province, up to yesterday."""
    recent = partition_window(orders, "createddate", as_of - timedelta(days=lookback_days), as_of)
    return (
        recent.filter(F.col("currentstatus") != P.CANCELLED)
        .groupBy(F.col("createddate").alias("report_date"), "toprovince")
        .agg(F.countDistinct("ordercode").alias("metrics"))
    )


def backlog_by_age(backlog: DataFrame, as_of: date, order_type: str = "Express") -> DataFrame:
    """Distinct backlog orders per current province and age label, stamped yesterday."""
    return (
        backlog.filter((F.col("ordertype") == order_type) & F.col("tuoibacklog").isNotNull())
        .groupBy(F.col("tinhhientai").alias("toprovince"), "tuoibacklog")
        .agg(F.countDistinct("madh").alias("metrics"))
        .withColumn("report_date", F.lit(as_of - timedelta(days=1)))
    )


def metric_union(parts: dict[str, DataFrame]) -> DataFrame:
    """Stack metric tables under their type; counts become doubles, a missing age label is null."""
    result = None
    for name, part in parts.items():
        age = F.col("tuoibacklog") if "tuoibacklog" in part.columns else F.lit(None).cast("string")
        rows = part.select(
            "report_date",
            "toprovince",
            age.alias("tuoibacklog"),
            F.col("metrics").cast("double").alias("metrics"),
            F.lit(name).alias("metric_type"),
        )
        result = rows if result is None else result.unionByName(rows)
    return result
