"""Orders waiting at their delivery hub."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow import params as P
from hubflow.functions.labels import client_group, is_reported_client
from hubflow.functions.times import whole_units
from hubflow.operators.hubs import dedupe_dim, relevant_scans, ward_lookup


def pending_orders(orders: DataFrame) -> DataFrame:
    """Open orders at their delivery hub, of reported clients, with the client group."""
    return orders.filter(
        (F.col("current_warehouse_id") == F.col("deliver_warehouse_id"))
        & ~F.col("status").isin(*P.TERMINAL_STATUSES)
        & is_reported_client(F.col("client_id"))
    ).withColumn("client_group", client_group(F.col("client_id")))


def pending_at(pending: DataFrame, hubs: DataFrame, wards: DataFrame, hub_names: Iterable[str], provinces: Iterable[str]) -> DataFrame:
    """Pending orders at the listed hubs bound for the listed provinces, with their names."""
    names = dedupe_dim(hubs, "warehouse_id", ["warehouse_name"]).filter(F.col("warehouse_name").isin(*hub_names))
    listed = pending.join(names.withColumnRenamed("warehouse_id", "current_warehouse_id"), "current_warehouse_id")
    return ward_lookup(listed, wards, how="inner").filter(F.col("province_name").isin(*provinces))


def scan_times(scans: DataFrame, *columns: str) -> DataFrame:
    """Receive and unpack scans with their hub, the time in the column of its kind, and further columns."""
    received, unpacked = F.col("action_name") == P.RECEIVE_ACTION, F.col("action_category") == P.UNPACK
    return scans.filter(received | unpacked).select(
        *columns,
        "order_code",
        F.col("warehouse_id").cast("bigint").alias("hub_id"),
        F.when(received, F.col("action_time")).alias("ibh_from_receive"),
        F.when(unpacked, F.col("action_time")).alias("ibh_from_unpack"),
    )


def last_scans(scans: DataFrame, pending: DataFrame) -> DataFrame:
    """Latest receive and unpack time per order among scans at its delivery hub.

    One pass over the log serves both; it is cut to the pending (order, hub)
    pairs first, which are few beside it.
    """
    keys = pending.withColumnRenamed("deliver_warehouse_id", "hub_id")
    return (
        relevant_scans(scan_times(scans), keys, ["order_code", "hub_id"])
        .groupBy("order_code")
        .agg(F.max("ibh_from_receive").alias("ibh_from_receive"), F.max("ibh_from_unpack").alias("ibh_from_unpack"))
    )


def latest_rows(df: DataFrame, key: str, by: str) -> DataFrame:
    """The row of each key with the largest ``by``.

    Ties go to the larger remaining columns in their order, so the result does
    not depend on the run. The maximum of a struct combines before the shuffle.
    """
    rest = [c for c in df.columns if c not in (key, by)]
    best = df.groupBy(key).agg(F.max(F.struct(by, *rest)).alias("best"))
    return best.select(*[F.col(c) if c == key else F.col(f"best.{c}").alias(c) for c in df.columns])


def inbound_time(df: DataFrame) -> DataFrame:
    """Arrival at the delivery hub: last receive, else last unpack, else pick-up end, with its source."""
    tiers = {"receive_package": "ibh_from_receive", "unpack": "ibh_from_unpack", "end_pick_time": "end_pick_time"}
    source = F.coalesce(*[F.when(F.col(column).isNotNull(), F.lit(name)) for name, column in tiers.items()])
    return df.select("*", F.coalesce(*tiers.values()).alias("inbounddeliveryhubtime"), source.alias("ibh_source"))


def wall_clock(now: datetime) -> Column:
    """A naive local time as a literal that no session zone can shift."""
    return F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")


def pending_age(df: DataFrame, now: datetime) -> DataFrame:
    """Completed hours and days since the inbound time; null without one."""
    since = F.col("inbounddeliveryhubtime")
    return df.select(
        "*",
        whole_units("HOUR", since, wall_clock(now)).alias("pending_hours"),
        whole_units("DAY", since, wall_clock(now)).alias("pending_days"),
    )
