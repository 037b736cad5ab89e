"""Failed deliveries and their proof-of-delivery entries."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.functions.labels import failed_delivery_flag, market_label
from hubflow.functions.times import whole_units
from hubflow.operators.windows import partition_window

_POD_FIELDS = ("order_status", "reason", "time", "lat", "lng", "is_correct", "urls")
_POD_COLUMNS = {f: "pod_status" if f == "order_status" else f"pod_{f}" for f in _POD_FIELDS}
_SAMPLE_COLUMNS = (
    "deliverywarehouseid",
    "deliverywh",
    "toprovince",
    "numdeliver",
    "firstfaildeliverynote",
    "secondfaildeliverynote",
    "thirdfaildeliverynote",
    "lastfaildeliverynote",
    "allfailnote",
    "startreturntime",
)


def picked_between(df: DataFrame, column: str, start: date, end: date) -> DataFrame:
    """Rows picked on the days ``start`` to ``end``, both included."""
    return df.filter(F.col(column).isNotNull() & F.to_date(column).between(F.lit(start), F.lit(end)))


def failed_by_hub_id(orders: DataFrame) -> DataFrame:
    """Order and failed-delivery counts per delivery hub id and market."""
    return (
        orders.filter(F.col("deliver_warehouse_id").isNotNull())
        .groupBy("deliver_warehouse_id", market_label(F.col("client_id")).alias("client_label"))
        .agg(
            F.count(F.lit(1)).alias("total_orders"),
            F.sum(failed_delivery_flag(F.col("status"))).alias("fd_orders"),
        )
    )


def failed_delivery_by_hub(orders: DataFrame, hubs: DataFrame, hub_names: Iterable[str]) -> DataFrame:
    """Counts for the listed hub names.

    Orders are counted per hub id before names are looked up, so the join sees
    a few rows per hub; an id with several names counts under each of them.
    """
    names = hubs.filter(F.col("warehouse_name").isin(*hub_names)).select(
        F.col("warehouse_id").alias("deliver_warehouse_id"), F.col("warehouse_name").alias("deliverywh")
    )
    return (
        failed_by_hub_id(orders)
        .join(names, "deliver_warehouse_id")
        .groupBy("deliverywh", "client_label")
        .agg(F.sum("total_orders").alias("total_orders"), F.sum("fd_orders").alias("fd_orders"))
    )


def failed_sample(
    mart: DataFrame,
    *,
    partitions: tuple[date, date],
    picked: tuple[date, date],
    client_types: Iterable[str],
    hub_ids: Iterable[int],
) -> DataFrame:
    """Orders whose return started, at the given hubs, with whole hours from pick to return."""
    kept = partition_window(mart, "createddate_partition", *partitions, closed=True).filter(
        F.col("startreturntime").isNotNull()
        & F.col("clienttype").isin(*client_types)
        & F.col("deliverywarehouseid").isin(*hub_ids)
    )
    return picked_between(kept, "endpicktime", *picked).select(
        F.col("ordercode").alias("order_code"),
        *_SAMPLE_COLUMNS[:3],
        F.to_date("endpicktime").alias("pick_date"),
        *_SAMPLE_COLUMNS[3:],
        whole_units("HOUR", F.col("endpicktime"), F.col("startreturntime")).alias("hours_pick_to_return"),
    )


def pod_explode(rows: DataFrame, keep: list[str]) -> DataFrame:
    """One row per proof-of-delivery entry; rows without entries disappear."""
    entries = rows.select(*keep, F.explode("pods").alias("pod"))
    return entries.select(*keep, *[F.col(f"pod.{f}").alias(name) for f, name in _POD_COLUMNS.items()])


def pods_of(order_pods: DataFrame, sample: DataFrame) -> DataFrame:
    """Entries of the sampled orders."""
    return pod_explode(order_pods.join(sample.select("order_code"), "order_code", "left_semi"), ["order_code"])


def pod_attach(sample: DataFrame, order_pods: DataFrame) -> DataFrame:
    """Sampled orders with their entries; orders without any keep one row with nulls.

    The entry table is read once: its rows with entries are cut to the sample by a semi-join, which may broadcast a
    small sample, and entries stay folded until they have met their order.
    """
    held = order_pods.select("order_code", "pods").filter(F.size("pods") > 0).join(sample.select("order_code"), "order_code", "left_semi")
    entries = sample.join(held, "order_code", "left").select(*sample.columns, F.explode_outer("pods").alias("pod"))
    both = entries.select(*sample.columns, *[F.col(f"pod.{f}").alias(name) for f, name in _POD_COLUMNS.items()])
    return both.withColumn("pod_url_list", F.array_join("pod_urls", " | ")).drop("pod_urls")
