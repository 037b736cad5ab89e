"""Labels derived from ids, names, weights and counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hubflow import params as P
from hubflow.functions.values import strict_greatest


def _case(pairs: list[tuple[Column, str]]) -> Column:
    label = F.when(*pairs[0])
    for condition, value in pairs[1:]:
        label = label.when(condition, value)
    return label


def client_group(client_id: Column) -> Column:
    """Four named client groups, SME for the rest, one label for excluded ids and nulls."""
    named = [(client_id == known, name) for known, name in P.CLIENT_GROUPS.items()]
    small = (~client_id.isin(*P.CLIENT_GROUPS, *P.EXCLUDED_CLIENTS), P.SMALL_CLIENT)
    return _case([*named, small]).otherwise(P.EXCLUDED_GROUP)


def is_reported_client(client_id: Column) -> Column:
    """Named groups and small clients; null ids fail the test."""
    return ~client_id.isin(*P.EXCLUDED_CLIENTS)


def market_label(client_id: Column) -> Column:
    return _case([(client_id.isin(*ids), name) for name, ids in P.MARKET_LABELS.items()]).otherwise(P.OTHER_MARKET)


def measured_client(client_id: Column) -> Column:
    return _case([(client_id == known, name) for known, name in P.MEASURED_CLIENTS.items()])


def journey_type(status: Column) -> Column:
    return _case([(status == known, name) for known, name in P.JOURNEYS.items()])


def pick_hub_bucket(hub_name: Column) -> Column:
    return (
        F.when(hub_name.contains(P.EXCLUDED_HUB_MARKER), "AHAMOVE")
        .when(hub_name.contains(P.KEY_ACCOUNT_MARKER), "KA")
        .otherwise("OTHER")
    )


def chargeable_weight(weight: Column, converted: Column) -> Column:
    """Larger of both weights; 0 when either is unknown."""
    return F.coalesce(strict_greatest(weight, converted), F.lit(0))


def service_class(weight: Column, converted: Column) -> Column:
    return F.when(chargeable_weight(weight, converted) >= P.HEAVY_GRAMS, P.HEAVY).otherwise(P.LIGHT)


def pass_bucket(passes: Column) -> Column:
    known = F.coalesce(passes, F.lit(0))
    return F.when(known >= 5, ">=5_lan").otherwise(F.concat(known.cast("string"), F.lit("_lan")))


def failed_delivery_flag(status: Column) -> Column:
    return F.when(status.contains(P.RETURN_MARKER), 1).otherwise(0)
