"""Failed-delivery checks."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame

from hubflow.functions.values import nulls_last
from hubflow.operators import failed
from hubflow.operators.windows import partition_window


def failed_delivery_by_hub(
    orders: DataFrame, hubs: DataFrame, *, created_after: date, picked: tuple[date, date], hub_names: Iterable[str]
) -> DataFrame:
    """Orders and failed deliveries per flagged hub and market."""
    recent = partition_window(orders, "dt", created_after, after_start=True)
    counts = failed.failed_delivery_by_hub(failed.picked_between(recent, "end_pick_time", *picked), hubs, hub_names)
    return counts.orderBy(*nulls_last(deliverywh="asc", client_label="asc"))


def failed_delivery_pod_sample(
    mart: DataFrame,
    order_pods: DataFrame,
    *,
    partitions: tuple[date, date],
    picked: tuple[date, date],
    client_types: Iterable[str],
    hub_ids: Iterable[int],
) -> DataFrame:
    """Returned orders of the flagged hubs with every proof-of-delivery entry.

    A sort samples its input first. The result is rebalanced before, so that the
    sampling reads that small exchange and not the entry table a second time.
    """
    sample = failed.failed_sample(mart, partitions=partitions, picked=picked, client_types=client_types, hub_ids=hub_ids)
    result = failed.pod_attach(sample, partition_window(order_pods, "createddate_partition", *partitions, closed=True))
    return result.hint("rebalance").orderBy(*nulls_last(deliverywarehouseid="asc", pick_date="asc", order_code="asc"))
