"""Wall-clock time expressions (timestamp_ntz in, timestamp_ntz or date out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hubflow import params as P


def day_at(day: Column, hour: int) -> Column:
    """The given hour of the day that a date or timestamp falls on."""
    midnight = F.to_date(day).cast("timestamp_ntz")
    return midnight + F.make_dt_interval(hours=F.lit(hour))


def network_deadline(sla_time: Column) -> Column:
    """15:00 on the day before the promised delivery date."""
    return day_at(F.date_sub(F.to_date(sla_time), 1), P.NETWORK_HOUR)


def local_cutoff(pick_time: Column) -> Column:
    """21:00 on the pick-up day."""
    return day_at(pick_time, P.LOCAL_HOUR)


def monday_of(day: Column) -> Column:
    """First day of the week, as a date."""
    return F.trunc(day, "week")


def week_start(time: Column) -> Column:
    """First moment of the week, as a wall-clock timestamp."""
    return F.trunc(F.to_date(time), "week").cast("timestamp_ntz")


def minute_of(time: Column) -> Column:
    return F.date_trunc("minute", time).cast("timestamp_ntz")


def whole_units(unit: str, start: Column, end: Column) -> Column:
    """Completed hours or days between two times (not calendar boundaries crossed)."""
    return F.timestamp_diff(unit, start, end)


def order_date(ordered: Column, created: Column) -> Column:
    """Order day; orders created from 19:00 on that day count for the next one."""
    day = F.to_date(ordered)
    late = (day == F.to_date(created)) & (F.hour(created) >= P.LATE_ORDER_HOUR)
    return F.when(late, F.date_add(day, 1)).otherwise(day)


def local_time(iso_text: Column, zone: str) -> Column:
    """Wall-clock time in a zone for an ISO-8601 instant."""
    instant = F.to_timestamp(iso_text)
    return F.convert_timezone(None, F.lit(zone), instant.cast("timestamp_ntz"))
