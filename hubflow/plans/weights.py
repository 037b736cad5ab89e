"""Weight-measurement coverage and gaps."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame

from hubflow.functions.values import nulls_last
from hubflow.operators import measures as M
from hubflow.operators.windows import month_to_date_window, partition_window, yesterday_window


def _weights(log: DataFrame, cohort: DataFrame, first_partition: date, *, same_hub: bool, minutes: bool) -> DataFrame:
    if minutes:
        found = M.stored_minutes(log, cohort, first_partition)
    else:
        rows = M.measurements(partition_window(log, "date_partition", first_partition))
        found = M.minute_maxima(M.measured_cohort(rows, cohort))
    return M.order_weights(found, same_hub=same_hub)


def weight_gap_summary(mart: DataFrame, log: DataFrame, *, as_of: date, minutes: bool = False) -> DataFrame:
    """Three full months and the month to date, per day, client type and journey.

    With ``minutes``, ``log`` is the table of ``day_minutes``, which both reports on weights can share.
    """
    window = month_to_date_window(as_of)
    cohort = M.completed_cohort(mart, window)
    gaps = M.weight_gaps(_weights(log, cohort, window.start, same_hub=True, minutes=minutes))
    bands = M.gap_bands(cohort, gaps)
    return bands.orderBy(*nulls_last(success_date="asc", client_type="asc", journey_type="asc"))


def weight_gap_detail(mart: DataFrame, log: DataFrame, *, as_of: date, minutes: bool = False) -> DataFrame:
    """Yesterday's completed orders that have a weight gap.

    With ``minutes``, ``log`` is the table of ``day_minutes``.

    ``as_of`` is the local day. Log rows are read from the first partition, not
    from the completion day, so that early measurements count.
    """
    window = yesterday_window(as_of)
    cohort = M.completed_cohort(mart, window)
    gaps = M.audit_gaps(_weights(log, cohort, window.partition_start, same_hub=False, minutes=minutes))
    return M.gap_detail(cohort, gaps).orderBy(*nulls_last(success_date="asc", ordercode="asc"))
