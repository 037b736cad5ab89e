"""The ten reports, each a composition of operators."""

from hubflow.plans.backlog import delivery_backlog
from hubflow.plans.claims import compensation_extract
from hubflow.plans.express import express_daily_metrics
from hubflow.plans.failed import failed_delivery_by_hub, failed_delivery_pod_sample
from hubflow.plans.pickup import pickup_ontime_daily
from hubflow.plans.transit import hub_pass_weekly, transit_sla_weekly
from hubflow.plans.weights import weight_gap_detail, weight_gap_summary

__all__ = [
    "compensation_extract",
    "delivery_backlog",
    "express_daily_metrics",
    "failed_delivery_by_hub",
    "failed_delivery_pod_sample",
    "hub_pass_weekly",
    "pickup_ontime_daily",
    "transit_sla_weekly",
    "weight_gap_detail",
    "weight_gap_summary",
]
