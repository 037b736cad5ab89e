"""Daily partials of the scan log: a day is collapsed once, and later runs merge days instead of reading the log again.

Partials hold minima and maxima, so merging them in any order, or a day twice, gives what the whole log gives. A day whose late rows came
in is collapsed again and replaces its partial.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow import params as P
from hubflow.operators.backlog import scan_times
from hubflow.operators.hubs import hub_scans, relevant_scans


def arrival_partials(scans: DataFrame, *, lenient_ids: bool = False) -> DataFrame:
    """Earliest receive scan per day, order, hub and carrier, and earliest unpack scan per day, order and hub.

    The columns are those of ``hub_scans``, so whatever takes scans to find first arrivals takes these.
    """
    rows = hub_scans(scans, (P.RECEIVE, P.UNPACK), lenient_ids=lenient_ids, days=True)
    received = F.col("action_category") == P.RECEIVE
    carriers = [F.when(received, F.col(c)).alias(c) for c in ("package_code", "trip_code")]
    return rows.groupBy("dt", "order_code", "hub_id", *carriers, "action_category").agg(F.min("action_time").alias("action_time"))


def last_scan_partials(scans: DataFrame) -> DataFrame:
    """Latest receive and unpack time per day, order and hub."""
    return scan_times(scans, "dt").groupBy("dt", "order_code", "hub_id").agg(
        F.max("ibh_from_receive").alias("ibh_from_receive"), F.max("ibh_from_unpack").alias("ibh_from_unpack")
    )


def merged_last_scans(partials: DataFrame, pending: DataFrame) -> DataFrame:
    """Latest receive and unpack time per order at its delivery hubs, from the partials of several days."""
    keys = pending.withColumnRenamed("deliver_warehouse_id", "hub_id")
    return (
        relevant_scans(partials, keys, ["order_code", "hub_id"])
        .groupBy("order_code")
        .agg(F.max("ibh_from_receive").alias("ibh_from_receive"), F.max("ibh_from_unpack").alias("ibh_from_unpack"))
    )


def store_days(partials: DataFrame, path: str, days: Iterable[date] | None = None) -> None:
    """Write partials by day, replacing the given days and leaving all others; without days, those that the partials hold.

    A given day without rows would keep its old partial, so the caller passes days that the log has.
    """
    if days is not None:
        wanted = [d.isoformat() for d in days]
        partials = partials.filter(F.col("dt").cast("string").isin(*wanted))
    # One task per day writes its file: a day is one partition of the table.
    partials.repartition("dt").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt").parquet(path)
