"""Compensation claims by approval day."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from hubflow.operators.windows import partition_window


def compensation_extract(claims: DataFrame, *, approved_since: date) -> DataFrame:
    """All columns of the claims approved on or after a day."""
    return partition_window(claims, "ngay_duyet_eform", approved_since)
