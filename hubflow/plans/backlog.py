"""Orders waiting at delivery hubs and for how long."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.functions.values import nulls_last
from hubflow.operators import backlog as B
from hubflow.operators.partials import merged_last_scans
from hubflow.operators.windows import partition_window


def delivery_backlog(
    orders: DataFrame,
    scans: DataFrame,
    hubs: DataFrame,
    wards: DataFrame,
    *,
    now: datetime,
    hub_names: Iterable[str],
    provinces: Iterable[str],
    lookback_days: int = 7,
    partials: bool = False,
) -> DataFrame:
    """One row per pending order with its inbound time, the source of it and its age.

    With ``partials``, ``scans`` are the daily partials of ``last_scan_partials`` instead of the log.
    """
    start = now.date() - timedelta(days=lookback_days)
    pending = B.pending_orders(partition_window(orders, "dt", start))
    listed = B.pending_at(pending, hubs, wards, hub_names, provinces).select(
        F.col("order_code").alias("ordercode"),
        "created_date",
        F.col("client_id").alias("clientid"),
        "client_group",
        F.col("status").alias("currentstatus"),
        F.col("warehouse_name").alias("currentwh"),
        F.col("warehouse_name").alias("deliverywh"),
        F.col("province_name").alias("toprovince"),
        F.col("district_name").alias("todistrict"),
        "towardcode",
        "ward_name",
        "end_pick_time",
    )
    latest = B.latest_rows(listed, "ordercode", "created_date")
    # Only listed orders are reported, but each of them with the scans at all hubs where it is pending.
    wanted = pending.join(latest.select(F.col("ordercode").alias("order_code")), "order_code", "left_semi")
    find = merged_last_scans if partials else B.last_scans
    last = find(partition_window(scans, "dt", start), wanted).withColumnRenamed("order_code", "ordercode")
    aged = B.pending_age(B.inbound_time(latest.join(last, "ordercode", "left")), now)
    return (
        aged.withColumn("created_date", F.to_date("created_date"))
        .drop("end_pick_time", "ibh_from_receive", "ibh_from_unpack")
        .orderBy(
            *nulls_last(
                toprovince="asc", todistrict="asc", currentwh="asc", currentstatus="asc", pending_days="desc", pending_hours="desc"
            )
        )
    )
