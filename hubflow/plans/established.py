"""The ten reports with their established clients, dates and hub lists."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame

from hubflow import params as P
from hubflow import plans


def established_reports(
    source: Callable[[str], DataFrame], now: datetime, *, sampled_hub_ids: Iterable[int]
) -> dict[str, Callable[[], DataFrame]]:
    """Report builders over ``source(name)``, which opens the sources of ``hubflow.sources.schemas``.

    ``now`` is the instant of the run; its day in the local zone is the report day. A naive time is taken as local wall clock.
    The hubs of the proof-of-delivery sample have no established list.
    """
    if now.tzinfo:
        now = now.astimezone(ZoneInfo(P.LOCAL_ZONE)).replace(tzinfo=None)
    today = now.date()
    return {
        "hub_pass_weekly": lambda: plans.hub_pass_weekly(
            source("hub_scan"),
            source("truck_event"),
            source("delivered_order"),
            source("sla_mart"),
            source("dim_warehouse"),
            since=P.WEEKLY_SINCE,
            as_of=today,
        ),
        "transit_sla_weekly": lambda: plans.transit_sla_weekly(
            source("shipping_order"),
            source("sla_mart"),
            source("dim_warehouse"),
            source("hub_scan"),
            source("trip_route"),
            source("stop_map"),
            as_of=today,
            since=P.WEEKLY_SINCE,
        ),
        "pickup_ontime_daily": lambda: plans.pickup_ontime_daily(
            source("sla_mart"), source("order_mart"), source("trip_item"), since=P.PICKUP_SINCE
        ),
        "compensation_extract": lambda: plans.compensation_extract(source("claim"), approved_since=P.CLAIMS_SINCE),
        "failed_delivery_by_hub": lambda: plans.failed_delivery_by_hub(
            source("shipping_order"),
            source("hub_name"),
            created_after=P.FAILED_CREATED_AFTER,
            picked=P.FAILED_PICK_RANGE,
            hub_names=P.FLAGGED_HUBS,
        ),
        "failed_delivery_pod_sample": lambda: plans.failed_delivery_pod_sample(
            source("order_mart"),
            source("order_pods"),
            partitions=P.FAILED_PARTITION_RANGE,
            picked=P.FAILED_PICK_RANGE,
            client_types=P.SAMPLED_CLIENT_TYPES,
            hub_ids=sampled_hub_ids,
        ),
        "delivery_backlog": lambda: plans.delivery_backlog(
            source("shipping_order"),
            source("hub_scan"),
            source("dim_warehouse"),
            source("dim_ward"),
            now=now,
            hub_names=P.BACKLOG_HUBS,
            provinces=P.BACKLOG_PROVINCES,
        ),
        "express_daily_metrics": lambda: plans.express_daily_metrics(
            source("express_order"), source("backlog_mart"), as_of=today
        ),
        "weight_gap_summary": lambda: plans.weight_gap_summary(source("completed_mart"), source("sorter_log"), as_of=today),
        "weight_gap_detail": lambda: plans.weight_gap_detail(source("completed_mart"), source("sorter_log"), as_of=today),
    }
