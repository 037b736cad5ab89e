"""Hub and ward dimensions, and the hub scan log."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.functions.values import lenient
from hubflow.operators.keyset import KeyBits


def exclude_hubs(df: DataFrame, name_column: str, marker: str) -> DataFrame:
    """Drop rows whose hub name holds the marker; rows without a hub name stay."""
    return df.filter(~F.coalesce(F.col(name_column), F.lit("")).contains(marker))


def dedupe_dim(dim: DataFrame, key: str, labels: Iterable[str]) -> DataFrame:
    """One row per key with the largest label of each column (columns may come from different rows)."""
    return dim.groupBy(key).agg(*[F.max(c).alias(c) for c in labels])


def hubs_of_type(dim: DataFrame, hub_type: str) -> DataFrame:
    return dim.filter(F.col("warehouse_type") == hub_type).select(F.col("warehouse_id").alias("hub_id")).distinct()


def hub_scans(scans: DataFrame, categories: Iterable[str], *, lenient_ids: bool = False, days: bool = False) -> DataFrame:
    """Scan rows of the given categories with numeric hub ids, and with their partition day on request.

    One filtered pass over the log serves all categories. Malformed ids raise,
    or become null with ``lenient_ids``.
    """
    hub = lenient(F.col("warehouse_id"), "int") if lenient_ids else F.col("warehouse_id").cast("int")
    return scans.filter(F.col("action_category").isin(*categories)).select(
        "order_code",
        hub.cast("bigint").alias("hub_id"),
        "action_time",
        "package_code",
        "trip_code",
        "action_category",
        *(["dt"] if days else []),
    )


def relevant_scans(scans: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Shrink a log to the keys a report asks for, keeping every matching row."""
    return scans.join(keys.select(*on), on, "left_semi")


def passing_scans(scans: DataFrame, orders: DataFrame, transit_hubs: DataFrame) -> DataFrame:
    """Scans of the given orders at their delivery hubs or at a transit hub (and, by chance, at a few others).

    No others can tell which hubs an order passed. Transit hubs are looked up as bits, so the log is shuffled once, by
    order; both sides of that join start from a plain exchange, which lets Spark split a hot order.
    """
    goals = orders.select(F.col("order_code").alias("goal_order"), F.col("deliver_warehouse_id").alias("goal_hub")).distinct()
    marked = scans.withColumn("may_be_transit", KeyBits(transit_hubs, "hub_id", log2_bits=16).may_hold(F.col("hub_id")))
    useful = F.col("may_be_transit") | (F.col("hub_id") == F.col("goal_hub"))
    return marked.join(goals, (F.col("order_code") == F.col("goal_order")) & useful, "left_semi").select(*scans.columns)


def ward_key(orders: DataFrame) -> DataFrame:
    """Ward code as text, else the newer ward id."""
    return orders.withColumn(
        "towardcode", F.coalesce(F.col("to_ward_code").cast("string"), F.col("to_ward_id_v2").cast("string"))
    )


def ward_lookup(orders: DataFrame, wards: DataFrame, how: str = "left") -> DataFrame:
    """Province, district and ward names by the order's ward key."""
    names = dedupe_dim(
        wards.withColumn("towardcode", F.col("ward_id").cast("string")),
        "towardcode",
        ["province_name", "district_name", "ward_name"],
    )
    return ward_key(orders).join(names, "towardcode", how)
