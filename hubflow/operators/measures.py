"""Weight and size measurements from the sorter log, and weight gaps.

HY and XA are the two measuring hubs. The log is read once; it is collapsed to
minutes, then to one row per order, and no step joins the log to itself.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hubflow import params as P
from hubflow.functions.labels import journey_type, measured_client
from hubflow.functions.times import minute_of
from hubflow.functions.values import count_if, kilograms, lenient
from hubflow.operators.windows import ReportWindow, partition_window

_VALUES = ("weight_g", *P.SIZE_FIELDS)
_FIELDS = ", ".join(f"{f} string" for f in [*P.WEIGHT_FIELDS.values(), *P.SIZE_FIELDS.values()])
_HUBS = {"HY": P.HUB_HY, "XA": P.HUB_XA}
_COHORT = ("ordercode", "success_date", "client_type", "journey_type")


def completed_cohort(mart: DataFrame, window: ReportWindow) -> DataFrame:
    """Delivered or returned orders of the measured clients, completed in the window."""
    status = F.col("currentstatus")
    done = F.to_date(F.when(status == "delivered", F.col("enddeliverytime")).when(status == "returned", F.col("endreturntime")))
    return (
        partition_window(mart, "createddate_partition", window.partition_start)
        .filter(F.col("clientid").isin(*P.MEASURED_CLIENTS) & status.isin(*P.JOURNEYS))
        .filter(done.between(F.lit(window.start), F.lit(window.end)))
        .select(
            "ordercode",
            done.alias("success_date"),
            measured_client(F.col("clientid")).alias("client_type"),
            journey_type(status).alias("journey_type"),
        )
    )


def measurements(log: DataFrame, *, days: bool = False) -> DataFrame:
    """Weight and sizes per log row, with its partition day on request; which JSON field holds them depends on the action.

    Feeder, size and matrix rows count at both hubs, weighing rows at HY only.
    Text that is no number, or no JSON, gives null.
    """
    action, hub = F.col("action"), F.col("location_id")
    sized = action.isin(P.DWS, P.MATRIX)
    kept = log.filter(
        F.col("order_code").isNotNull()
        & ((hub.isin(P.HUB_XA, P.HUB_HY) & action.isin(P.SORTING, P.DWS, P.MATRIX)) | ((hub == P.HUB_HY) & (action == P.WEIGHING)))
    )
    read = kept.withColumn("fields", F.from_json("data", _FIELDS))
    weight = F.coalesce(*[F.when(action == a, F.col(f"fields.{f}")) for a, f in P.WEIGHT_FIELDS.items()])
    return read.select(
        "order_code",
        "location_id",
        "last_updated_time",
        lenient(weight, "double").alias("weight_g"),
        *[F.when(sized, lenient(F.col(f"fields.{f}"), "double")).alias(c) for c, f in P.SIZE_FIELDS.items()],
        *(["date_partition"] if days else []),
    )


def measured_cohort(rows: DataFrame, cohort: DataFrame) -> DataFrame:
    """Measurements of the cohort's orders.

    Rows may repeat for an order that is in the cohort more than once, which no
    later step notices, as they only take maxima per minute. An inner join, not
    a semi join, because Spark moves the latter below the JSON parsing and would
    shuffle the texts. The cohort is collapsed on all its columns and shuffled
    by order afterwards, so copies are gone and Spark can still split a hot order.
    """
    keys = cohort.select(*_COHORT).distinct().select(F.col("ordercode").alias("order_code"))
    return rows.join(keys, "order_code")


def minute_maxima(rows: DataFrame) -> DataFrame:
    """Largest weight and sizes per order, hub and minute."""
    return rows.groupBy("order_code", "location_id", minute_of(F.col("last_updated_time")).alias("measured_time")).agg(
        *[F.max(v).alias(v) for v in _VALUES]
    )


def day_minutes(log: DataFrame) -> DataFrame:
    """Largest weight and sizes per partition day, order, hub and minute: the log with its JSON parsed once, for all reports on weights."""
    keys = ["date_partition", "order_code", "location_id", minute_of(F.col("last_updated_time")).alias("measured_time")]
    return measurements(log, days=True).groupBy(*keys).agg(*[F.max(v).alias(v) for v in _VALUES])


def stored_minutes(days: DataFrame, cohort: DataFrame, first_partition: date) -> DataFrame:
    """Minutes of the cohort's orders from ``day_minutes`` on; what a minute has on two partition days is united.

    Where the table is bucketed by order, neither the join nor this aggregation nor the next shuffles it.
    """
    rows = measured_cohort(partition_window(days, "date_partition", first_partition).drop("date_partition"), cohort)
    return rows.groupBy("order_code", "location_id", "measured_time").agg(*[F.max(v).alias(v) for v in _VALUES])


def _all_positive(condition: Column | None = None) -> Column:
    maxima = [F.max(F.col(v) if condition is None else F.when(condition, F.col(v))) for v in _VALUES]
    result = maxima[0] > 0
    for maximum in maxima[1:]:
        result = result & (maximum > 0)
    return result


def fully_measured(minutes: DataFrame) -> DataFrame:
    """(order, hub) pairs with weight, length, width and height, not necessarily in one minute."""
    return minutes.groupBy("order_code", "location_id").agg(_all_positive().alias("is_full")).filter("is_full").drop("is_full")


def weigh_passes(minutes: DataFrame, *, same_hub: bool) -> DataFrame:
    """Weighing minutes in kilograms.

    With ``same_hub`` only at hubs where the order is fully measured, otherwise
    at every hub of an order that is fully measured somewhere.
    """
    keys = ["order_code", "location_id"] if same_hub else ["order_code"]
    weighed = minutes.filter(F.col("weight_g") > 0).join(fully_measured(minutes).select(*keys), keys, "left_semi")
    return weighed.select("order_code", "location_id", "measured_time", kilograms(F.col("weight_g")).alias("weight_kg"))


def order_weights(minutes: DataFrame, *, same_hub: bool) -> DataFrame:
    """First and last weight and number of passes per order and hub, in one aggregation.

    Equal to collapsing ``weigh_passes``: the measured test is evaluated beside
    the weights and applied afterwards, which saves joining the minutes to
    themselves. Orders without any pass give no row.
    """
    weight, time = kilograms(F.col("weight_g")), F.col("measured_time")
    aggregates, results = [], []
    for name, hub in _HUBS.items():
        at_hub = F.col("location_id") == hub
        weighed = at_hub & (F.col("weight_g") > 0)
        stamp = F.when(weighed, time)
        aggregates += [
            F.min_by(F.when(weighed, weight), stamp).alias(f"first_{name}"),
            F.max_by(F.when(weighed, weight), stamp).alias(f"last_{name}"),
            F.count(stamp).alias(f"passes_{name}"),
            F.coalesce(_all_positive(at_hub), F.lit(False)).alias(f"full_{name}"),
        ]
        allowed = F.col(f"full_{name}") if same_hub else F.col("full_HY") | F.col("full_XA")
        results += [
            F.when(allowed, F.col(f"first_{name}")).alias(f"first_{name}"),
            F.when(allowed, F.col(f"last_{name}")).alias(f"last_{name}"),
            F.when(allowed, F.col(f"passes_{name}")).otherwise(F.lit(0).cast("bigint")).alias(f"passes_{name}"),
        ]
    profile = minutes.groupBy("order_code").agg(*aggregates).select("order_code", *results)
    return profile.filter(F.col("passes_HY") + F.col("passes_XA") > 0)


def _intra_gap(hub: str) -> Column:
    return F.when(F.col(f"passes_{hub}") >= 2, F.abs(F.col(f"last_{hub}") - F.col(f"first_{hub}")))


def _cross_gap() -> Column:
    return F.abs(F.col("last_HY") - F.col("last_XA"))


def weight_gaps(weights: DataFrame) -> DataFrame:
    """Gap within HY, gap within XA, and gap between the last weights of both."""
    return weights.select(
        "order_code",
        "last_HY",
        "last_XA",
        _intra_gap("HY").alias("gap_HY"),
        _intra_gap("XA").alias("gap_XY"),
        _cross_gap().alias("gap_2_kho"),
    )


def audit_gaps(weights: DataFrame) -> DataFrame:
    """Larger gap within one hub, and gap between the hubs; orders with neither are dropped."""
    gaps = weights.select(
        "order_code",
        "last_HY",
        "last_XA",
        F.greatest(_intra_gap("HY"), _intra_gap("XA")).alias("gap1"),
        _cross_gap().alias("gap2"),
    )
    return gaps.filter(F.col("gap1").isNotNull() | F.col("gap2").isNotNull())


def gap_bands(cohort: DataFrame, gaps: DataFrame) -> DataFrame:
    """Distinct orders per day, client type and journey: all, measured per hub, and by gap band.

    Gaps depend on the order alone, so the cohort is made distinct once and
    every count is a plain conditional count.
    """
    joined = cohort.select(*_COHORT).distinct().join(gaps.withColumnRenamed("order_code", "ordercode"), "ordercode", "left")
    bands = []
    for name in ("gap_HY", "gap_XY", "gap_2_kho"):
        gap = F.col(name)
        bands += [
            count_if(gap < 1).alias(f"{name}_duoi_1kg"),
            count_if(gap.between(1, 2)).alias(f"{name}_1_den_2kg"),
            count_if(gap > 2).alias(f"{name}_tren_2kg"),
        ]
    return joined.groupBy(*_COHORT[1:]).agg(
        F.count("ordercode").alias("mau_total_toan_quoc"),
        F.count("last_HY").alias("tu_do_dac_HY"),
        F.count("last_XA").alias("tu_do_dac_XA"),
        *bands,
    )


def repeat_rows(df: DataFrame, times: str, block: int = 4096) -> DataFrame:
    """Emit each row as often as its count says, building no array longer than needed for one block."""
    columns = [c for c in df.columns if c != times]
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(times) - 1) / block)))
    split = df.select("*", blocks.alias("block"))
    size = F.least(F.lit(block).cast("bigint"), F.col(times) - F.col("block") * block)
    return split.select(*columns, F.explode(F.array_repeat(F.lit(True), size.cast("int"))).alias("copy")).select(*columns)


def gap_detail(cohort: DataFrame, gaps: DataFrame) -> DataFrame:
    """Cohort rows with a gap, the hubs that weighed them, and rounded weights.

    Equal cohort rows are counted before the join and emitted again after it.
    """
    counted = cohort.select(*_COHORT).groupBy(*_COHORT).agg(F.count(F.lit(1)).alias("copies"))
    joined = counted.join(gaps.withColumnRenamed("order_code", "ordercode"), "ordercode")
    hub = (
        F.when(F.col("last_HY").isNotNull() & F.col("last_XA").isNotNull(), "HY + XA")
        .when(F.col("last_HY").isNotNull(), P.HUB_HY)
        .when(F.col("last_XA").isNotNull(), P.HUB_XA)
    )
    detail = joined.select(
        *_COHORT,
        hub.alias("id_ktc"),
        F.round("last_HY", 3).alias("rdc_last_measured_HY_kg"),
        F.round("last_XA", 3).alias("rdc_last_measured_XA_kg"),
        F.round("gap1", 3).alias("intra_warehouse_gap1_kg"),
        F.round("gap2", 3).alias("cross_warehouse_gap2_kg"),
        "copies",
    )
    return repeat_rows(detail, "copies")
