"""Partition ranges and report periods."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, TimestampNTZType


def _bound(df: DataFrame, column: str, day: date) -> Column:
    dtype = df.schema[column].dataType
    if isinstance(dtype, StringType):
        return F.lit(day.isoformat())
    if isinstance(dtype, TimestampNTZType):
        return F.lit(day.isoformat()).cast("timestamp_ntz")
    return F.lit(day)


def partition_window(
    df: DataFrame,
    column: str,
    start: date,
    end: date | None = None,
    *,
    after_start: bool = False,
    closed: bool = False,
) -> DataFrame:
    """Keep ``[start, end)`` of a date-text, date or timestamp column.

    ``after_start`` makes the lower bound strict, ``closed`` keeps the end day,
    and without an end the range is open. Bounds are literals of the column's
    own type, so they prune partitions and reach the file scan.
    """
    low = _bound(df, column, start)
    kept = F.col(column) > low if after_start else F.col(column) >= low
    if end is not None:
        high = _bound(df, column, end)
        kept = kept & (F.col(column) <= high if closed else F.col(column) < high)
    return df.filter(kept)


@dataclass(frozen=True)
class ReportWindow:
    """Days covered by a report, both ends included, and the first partition to read."""

    start: date
    end: date
    partition_start: date


def month_to_date_window(as_of: date, months: int = 3) -> ReportWindow:
    """Full months before the current one plus the month up to and including today."""
    year, month = divmod(as_of.year * 12 + as_of.month - 1 - months, 12)
    start = date(year, month + 1, 1)
    return ReportWindow(start, as_of, start)


def yesterday_window(as_of: date, lookback_days: int = 30) -> ReportWindow:
    """Yesterday, reading partitions far enough back for slow orders."""
    yesterday = as_of - timedelta(days=1)
    return ReportWindow(yesterday, yesterday, as_of - timedelta(days=lookback_days))


def local_day(instant: datetime, zone: str) -> date:
    """Calendar day of an instant in a zone (naive instants are UTC)."""
    aware = instant if instant.tzinfo else instant.replace(tzinfo=timezone.utc)
    return aware.astimezone(ZoneInfo(zone)).date()
