"""Three reports in their plain step-by-step form, to compare results and times with.

They join before aggregating, read the logs once per branch and count distinct
values one by one, as an analyst's SQL would, and call nothing of the package.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

ROUTE = "array<struct<check_in_at:struct<`$date`:string>,stop_point:string,items_dropped:array<string>>>"
BUCKETS = {
    "ontime_tc": "received_time < CAST(to_date(sla_time) AS timestamp_ntz) - INTERVAL '9' HOUR",
    "da_tre": "early < 0",
    "D0C2": "early = 0 AND received_time > cutoff",
    "D0C1": "early = 0 AND received_time <= cutoff",
    "D1C2": "early = 1 AND received_time > cutoff",
    "D1C1": "early = 1 AND received_time <= cutoff",
    "D2": "early = 2",
    "D3": "early > 2",
}


def transit_sla(orders, sla, dim, scans, routes, stops, *, as_of, since, lookback_days):
    start = as_of - timedelta(days=lookback_days)
    picked = orders.filter(f"dt >= '{start}' AND dt < '{as_of}' AND client_id = 3892833 AND end_pick_time IS NOT NULL")
    loaded = sla.filter(f"loaddate >= DATE '{start}' AND loaddate < DATE '{as_of}'").withColumnRenamed("ordercode", "order_code")
    cohort = (
        picked.join(loaded, "order_code")
        .join(dim, F.col("warehouse_id") == F.col("deliver_warehouse_id"), "left")
        .filter("warehouse_name IS NULL OR NOT contains(warehouse_name, 'Ahamove')")
        .selectExpr(
            "order_code", "deadlinedeliverysla AS sla_time", "status", "pick_warehouse_id", "deliver_warehouse_id", "province_id",
            "warehouse_name", "to_date(end_pick_time) AS picked", "deliveryprovince AS deli_province", "externallane",
        )
    )
    log = (
        scans.filter(f"dt >= '{start}' AND dt < '{as_of}' AND action_category IN ('receive', 'unpack', 'export')")
        .selectExpr("order_code", "CAST(try_cast(warehouse_id AS int) AS bigint) AS hub_id", "action_time", "package_code", "action_category")
        .join(cohort.select("order_code").distinct(), "order_code")
    )
    codes = stops.selectExpr("code AS stop_point", "CAST(try_cast(hub_code AS int) AS bigint) AS hub_id")
    check_ins = (
        routes.filter(f"updated_at_date >= TIMESTAMP_NTZ '{start} 00:00:00' AND updated_at_date < TIMESTAMP_NTZ '{as_of} 00:00:00'")
        .select(F.explode(F.from_json("partner_router", ROUTE)).alias("stop"))
        .selectExpr("stop.stop_point", "stop.check_in_at.`$date` AS told", "explode(stop.items_dropped) AS package_code")
        .selectExpr("stop_point", "package_code", "convert_timezone('UTC', 'Asia/Bangkok', CAST(CAST(told AS timestamp) AS timestamp_ntz)) AS check_in_at")
        .join(codes, "stop_point", "left")
    )
    received = log.filter("action_category = 'receive'").join(check_ins, ["hub_id", "package_code"], "left")
    arrived = received.selectExpr("order_code", "hub_id", "coalesce(check_in_at, action_time) AS moment").union(
        log.filter("action_category = 'unpack'").selectExpr("order_code", "hub_id", "action_time AS moment")
    )
    exported = log.filter("action_category = 'export'").selectExpr("order_code", "hub_id AS pick_warehouse_id", "action_time AS sent")
    wide = cohort.join(
        arrived.distinct().withColumnRenamed("hub_id", "deliver_warehouse_id"), ["order_code", "deliver_warehouse_id"], "left"
    ).join(exported, ["order_code", "pick_warehouse_id"], "left")
    timed = wide.groupBy(*cohort.columns).agg(F.min("moment").alias("received_time"), F.min("sent").alias("sent"))
    kept = timed.filter(f"received_time >= TIMESTAMP_NTZ '{since} 00:00:00' AND received_time < TIMESTAMP_NTZ '{as_of} 00:00:00'")
    hour = "CASE WHEN province_id IN (201, 202) THEN INTERVAL '8' HOUR WHEN province_id IS NOT NULL THEN INTERVAL '9' HOUR END"
    weeks = kept.selectExpr(
        "*",
        "CAST(date_trunc('week', received_time) AS timestamp_ntz) AS week_start",
        "datediff(to_date(sla_time), to_date(received_time)) AS early",
        f"CAST(to_date(received_time) AS timestamp_ntz) + {hour} AS cutoff",
    )
    counts = [F.expr(f"count_if({condition})").alias(name) for name, condition in BUCKETS.items()]
    return weeks.groupBy("week_start", "deli_province", "externallane").agg(*counts, F.count("*").alias("tong_don"))


def delivery_backlog(orders, scans, dim, wards, *, now, hub_names, provinces, lookback_days):
    start = now.date() - timedelta(days=lookback_days)
    pending = orders.filter(
        f"dt >= '{start}' AND current_warehouse_id = deliver_warehouse_id AND status NOT IN ('delivered', 'returned', 'return', 'lost', 'scrap') "
        "AND client_id NOT IN (2781603, 2590595, 224845, 9794, 1367)"
    ).withColumn(
        "client_group",
        F.expr("CASE client_id WHEN 18692 THEN 'SPE' WHEN 3892833 THEN 'SPB' WHEN 3819710 THEN 'TTSE' WHEN 4447237 THEN 'TTSB' ELSE 'SME' END"),
    )
    log = scans.filter(f"dt >= '{start}'").withColumn("deliver_warehouse_id", F.col("warehouse_id").cast("bigint"))

    def last(condition, name):
        newest = Window.partitionBy("order_code").orderBy(F.col("action_time").desc_nulls_last())
        at_hub = log.filter(condition).join(pending.select("order_code", "deliver_warehouse_id"), ["order_code", "deliver_warehouse_id"])
        return at_hub.withColumn("place", F.row_number().over(newest)).filter("place = 1").select(
            "order_code", F.col("action_time").alias(name)
        )

    names = dim.groupBy(F.col("warehouse_id").alias("current_warehouse_id")).agg(F.max("warehouse_name").alias("currentwh"))
    places = wards.groupBy(F.col("ward_id").cast("string").alias("towardcode")).agg(
        *[F.max(c).alias(c) for c in ("province_name", "district_name", "ward_name")]
    )
    wide = (
        pending.join(names, "current_warehouse_id", "left")
        .withColumn("towardcode", F.expr("coalesce(to_ward_code, CAST(to_ward_id_v2 AS string))"))
        .join(places, "towardcode", "left")
        .join(last(F.col("action_name") == "RECEIVE_PACKAGE", "ibh_from_receive"), "order_code", "left")
        .join(last(F.col("action_category") == "unpack", "ibh_from_unpack"), "order_code", "left")
        .filter(F.col("province_name").isin(*provinces) & F.col("currentwh").isin(*hub_names))
    )
    newest = Window.partitionBy("order_code").orderBy(F.col("created_date").desc_nulls_last())
    first = wide.withColumn("place", F.row_number().over(newest)).filter("place = 1")
    aged = first.withColumn("inbounddeliveryhubtime", F.expr("coalesce(ibh_from_receive, ibh_from_unpack, end_pick_time)")).selectExpr(
        "*",
        "CASE WHEN ibh_from_receive IS NOT NULL THEN 'receive_package' WHEN ibh_from_unpack IS NOT NULL THEN 'unpack' "
        "WHEN end_pick_time IS NOT NULL THEN 'end_pick_time' END AS ibh_source",
        f"timestampdiff(HOUR, inbounddeliveryhubtime, TIMESTAMP_NTZ '{now}') AS pending_hours",
        f"timestampdiff(DAY, inbounddeliveryhubtime, TIMESTAMP_NTZ '{now}') AS pending_days",
    )
    return aged.select(
        F.col("order_code").alias("ordercode"), F.to_date("created_date").alias("created_date"), F.col("client_id").alias("clientid"),
        "client_group", F.col("status").alias("currentstatus"), "currentwh", F.col("currentwh").alias("deliverywh"),
        F.col("province_name").alias("toprovince"), F.col("district_name").alias("todistrict"), "towardcode", "ward_name",
        "inbounddeliveryhubtime", "ibh_source", "pending_hours", "pending_days",
    )


def weight_summary(mart, log, *, as_of):
    first = as_of.replace(day=1)
    for _ in range(3):
        first = (first - timedelta(days=1)).replace(day=1)
    done = "to_date(CASE currentstatus WHEN 'delivered' THEN enddeliverytime WHEN 'returned' THEN endreturntime END)"
    cohort = mart.filter(
        f"clientid IN (3819710, 4447237) AND {done} BETWEEN DATE '{first}' AND DATE '{as_of}' AND createddate_partition >= DATE '{first}'"
    ).selectExpr(
        "ordercode",
        f"{done} AS success_date",
        "CASE clientid WHEN 3819710 THEN 'TTS_Exp' ELSE 'TTS_Bulky' END AS client_type",
        "CASE currentstatus WHEN 'delivered' THEN 'deli' ELSE 'return' END AS journey_type",
    )

    def branch(action, hub_ids, weight=None, sizes=False):
        def field(name):
            return F.get_json_object("data", f"$.{name}").try_cast("double") if name else F.lit(None).cast("double")

        rows = log.filter((F.col("action") == action) & F.col("location_id").isin(*hub_ids))
        return rows.filter(f"date_partition >= '{first}'").join(cohort.select(F.col("ordercode").alias("order_code")), "order_code").select(
            "order_code",
            "location_id",
            "last_updated_time",
            field(weight).alias("w"),
            *[field(f if sizes else None).alias(c) for c, f in zip("lbh", ("dwsLength", "dwsWidth", "dwsHeight"), strict=True)],
        )

    xa, hy = "1626", "21365000"
    raw = (
        branch("SORTING_PARCEL", [xa], "feederWeight")
        .unionByName(branch("SORTING_PARCEL", [hy], "feederWeight"))
        .unionByName(branch("WEIGHING_PARCEL", [hy], "weight"))
        .unionByName(branch("DWS_PARCEL", [xa, hy], None, True))
        .unionByName(branch("MATRIX_SCANNED_PARCEL", [xa, hy], "dwsWeight", True))
    )
    maxima = raw.groupBy("order_code", "location_id").agg(*[F.max(c).alias(c) for c in "wlbh"])
    full = maxima.filter("w > 0 AND l > 0 AND b > 0 AND h > 0").select("order_code", "location_id")
    passes = (
        raw.join(full, ["order_code", "location_id"])
        .groupBy("order_code", "location_id", F.expr("date_trunc('minute', last_updated_time)").alias("minute"))
        .agg(F.max("w").alias("w"))
        .filter("w > 0")
        .withColumn("kg", F.round(F.col("w") / 1000.0, 3))
    )

    def per_hub(name, hub):
        here = F.col("location_id") == hub
        kg, minute = F.when(here, F.col("kg")), F.when(here, F.col("minute"))
        return [
            F.min_by(kg, minute).alias(f"first_{name}"),
            F.max_by(kg, minute).alias(f"last_{name}"),
            F.countDistinct(minute).alias(f"passes_{name}"),
        ]

    weights = passes.groupBy("order_code").agg(*per_hub("HY", hy), *per_hub("XA", xa))
    gaps = weights.select(
        F.col("order_code").alias("ordercode"),
        "last_HY",
        "last_XA",
        F.when(F.col("passes_HY") >= 2, F.abs(F.col("last_HY") - F.col("first_HY"))).alias("gap_HY"),
        F.when(F.col("passes_XA") >= 2, F.abs(F.col("last_XA") - F.col("first_XA"))).alias("gap_XY"),
        F.abs(F.col("last_HY") - F.col("last_XA")).alias("gap_2_kho"),
    )

    def distinct_if(condition, name):
        return F.countDistinct(F.when(condition, F.col("ordercode"))).alias(name)

    bands = []
    for name in ("gap_HY", "gap_XY", "gap_2_kho"):
        gap = F.col(name)
        bands += [
            distinct_if(gap < 1.0, f"{name}_duoi_1kg"),
            distinct_if((gap >= 1.0) & (gap <= 2.0), f"{name}_1_den_2kg"),
            distinct_if(gap > 2.0, f"{name}_tren_2kg"),
        ]
    return (
        cohort.join(gaps, "ordercode", "left")
        .groupBy("success_date", "client_type", "journey_type")
        .agg(
            F.countDistinct("ordercode").alias("mau_total_toan_quoc"),
            distinct_if(F.col("last_HY").isNotNull(), "tu_do_dac_HY"),
            distinct_if(F.col("last_XA").isNotNull(), "tu_do_dac_XA"),
            *bands,
        )
    )
