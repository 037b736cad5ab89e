"""One query per primitive that the reports use, over whole source tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from hubflow import params as P
from hubflow.catalog.registry import Catalog
from hubflow.functions import times, values

PRIMITIVES = Catalog()
_ADD = PRIMITIVES.add


# --- scans ------------------------------------------------------------------
@_ADD("c_table_scan", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders")
def _(t):
    return t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")


@_ADD(
    "c_named_stages",
    """
    WITH open_orders AS (SELECT * FROM shipping_order WHERE status = 'storing'),
         per_hub AS (SELECT deliver_warehouse_id, count(*) AS n FROM open_orders GROUP BY 1)
    SELECT * FROM per_hub
    """,
)
def _(t):
    open_orders = t("shipping_order").filter(F.col("status") == "storing")
    return open_orders.groupBy("deliver_warehouse_id").agg(F.count(F.lit(1)).alias("n"))


@_ADD(
    "c_derived_table",
    """
    SELECT scans, count(*) AS n FROM (SELECT order_code, count(*) AS scans FROM hub_scan GROUP BY order_code) AS per_order GROUP BY 1
    """,
)
def _(t):
    per_order = t("hub_scan").groupBy("order_code").agg(F.count(F.lit(1)).alias("scans"))
    return per_order.groupBy("scans").agg(F.count(F.lit(1)).alias("n"))


# --- projections and predicates ---------------------------------------------
@_ADD("c_select_all", "SELECT * FROM backlog_mart")
def _(t):
    return t("backlog_mart").select("*")


@_ADD("c_alias_constant", "SELECT order_code AS ordercode, 'Shopee Bulky' AS client_channel FROM shipping_order")
def _(t):
    return t("shipping_order").select(F.col("order_code").alias("ordercode"), F.lit(P.BULKY_CHANNEL).alias("client_channel"))


@_ADD(
    "c_boolean_logic",
    """
    SELECT order_code, status FROM shipping_order
    WHERE 1 = 1 AND current_warehouse_id = deliver_warehouse_id AND (client_id = 18692 OR status <> 'delivered')
    """,
)
def _(t):
    here = F.col("current_warehouse_id") == F.col("deliver_warehouse_id")
    wanted = (F.col("client_id") == P.CLIENT_SPE) | (F.col("status") != "delivered")
    return t("shipping_order").filter(here & wanted).select("order_code", "status")


@_ADD("c_between", "SELECT ordercode, loaddate FROM sla_mart WHERE loaddate BETWEEN DATE '1997-03-01' AND DATE '1998-02-28'")
def _(t):
    kept = F.col("loaddate").between(F.lit(date(1997, 3, 1)), F.lit(date(1998, 2, 28)))
    return t("sla_mart").filter(kept).select("ordercode", "loaddate")


@_ADD(
    "c_in_list",
    "SELECT order_code, client_id, status FROM shipping_order WHERE client_id IN (18692, 3892833) AND status IN ('storing', 'cancel')",
)
def _(t):
    kept = F.col("client_id").isin(P.CLIENT_SPE, P.CLIENT_SPB) & F.col("status").isin("storing", "cancel")
    return t("shipping_order").filter(kept).select("order_code", "client_id", "status")


@_ADD(
    "c_not_in_list",
    """
    SELECT order_code, to_ward_code FROM shipping_order
    WHERE status NOT IN ('delivered', 'returned', 'return', 'lost', 'scrap') AND to_ward_code NOT IN ('1', '2')
    """,
)
def _(t):
    kept = ~F.col("status").isin(*P.TERMINAL_STATUSES) & ~F.col("to_ward_code").isin("1", "2")
    return t("shipping_order").filter(kept).select("order_code", "to_ward_code")


@_ADD(
    "c_like",
    """
    SELECT order_code, status FROM shipping_order WHERE status LIKE '%return%'
    UNION ALL SELECT ordercode, pickwh FROM order_mart WHERE pickwh NOT LIKE '%Ahamove%'
    """,
)
def _(t):
    returned = t("shipping_order").filter(F.col("status").like("%return%")).select("order_code", "status")
    other = t("order_mart").filter(~F.col("pickwh").contains(P.EXCLUDED_HUB_MARKER)).select("ordercode", "pickwh")
    return returned.union(other)


@_ADD(
    "c_null_tests",
    "SELECT order_code FROM shipping_order WHERE end_pick_time IS NOT NULL AND converted_weight IS NULL",
)
def _(t):
    return t("shipping_order").filter(F.col("end_pick_time").isNotNull() & F.col("converted_weight").isNull()).select("order_code")


@_ADD(
    "c_case",
    """
    SELECT ordercode, CASE WHEN currentstatus = 'delivered' THEN 'deli' WHEN currentstatus = 'returned' THEN 'return' END AS journey,
           CASE WHEN numdeliver > 1 THEN 'again' ELSE 'once' END AS attempts
    FROM order_mart
    """,
)
def _(t):
    status = F.col("currentstatus")
    return t("order_mart").select(
        "ordercode",
        F.when(status == "delivered", "deli").when(status == "returned", "return").alias("journey"),
        F.when(F.col("numdeliver") > 1, "again").otherwise("once").alias("attempts"),
    )


@_ADD(
    "c_predicate_on_case",
    """
    SELECT ordercode, numdeliver FROM order_mart
    WHERE CASE WHEN numdeliver IS NULL THEN 'none' WHEN numdeliver > 1 THEN 'many' ELSE 'one' END <> 'many'
    """,
)
def _(t):
    tries = F.col("numdeliver")
    label = F.when(tries.isNull(), "none").when(tries > 1, "many").otherwise("one")
    return t("order_mart").filter(label != "many").select("ordercode", "numdeliver")


# --- joins --------------------------------------------------------------------
@_ADD(
    "c_inner_join",
    "SELECT a.ordercode, a.pickdistrict, v.currentstatus FROM sla_mart a JOIN order_mart v ON v.ordercode = a.ordercode",
)
def _(t):
    return t("sla_mart").select("ordercode", "pickdistrict").join(t("order_mart").select("ordercode", "currentstatus"), "ordercode")


@_ADD(
    "c_two_key_join",
    """
    SELECT s.order_code, s.action_time FROM hub_scan s JOIN shipping_order o
    ON o.order_code = s.order_code AND o.deliver_warehouse_id = CAST(s.warehouse_id AS BIGINT)
    """,
)
def _(t):
    scans = t("hub_scan").select("order_code", F.col("warehouse_id").cast("bigint").alias("hub_id"), "action_time")
    goals = t("shipping_order").select("order_code", F.col("deliver_warehouse_id").alias("hub_id"))
    return scans.join(goals, ["order_code", "hub_id"]).select("order_code", "action_time")


@_ADD(
    "c_left_join",
    "SELECT o.order_code, s.sla FROM shipping_order o LEFT JOIN (SELECT ordercode, deadlinedeliverysla AS sla FROM sla_mart) s "
    "ON s.ordercode = o.order_code",
)
def _(t):
    promises = t("sla_mart").select(F.col("ordercode").alias("order_code"), F.col("deadlinedeliverysla").alias("sla"))
    return t("shipping_order").select("order_code").join(promises, "order_code", "left")


@_ADD(
    "c_left_join_filtered",
    """
    SELECT o.order_code, s.loaddate FROM shipping_order o LEFT JOIN sla_mart s ON s.ordercode = o.order_code
    WHERE s.loaddate >= DATE '1999-01-01'
    """,
)
def _(t):
    loaded = t("sla_mart").filter(F.col("loaddate") >= F.lit(date(1999, 1, 1)))
    return t("shipping_order").select("order_code").join(
        loaded.select(F.col("ordercode").alias("order_code"), "loaddate"), "order_code"
    )


@_ADD(
    "c_mark_join",
    """
    SELECT s.ordercode, CASE WHEN n.order_code IS NULL THEN 0 ELSE 1 END AS found
    FROM sla_mart s LEFT JOIN (SELECT DISTINCT order_code FROM trip_item WHERE type = 'PICK') n ON n.order_code = s.ordercode
    """,
)
def _(t):
    keys = t("trip_item").filter(F.col("type") == P.PICK_ITEM).select(F.col("order_code").alias("ordercode")).distinct()
    marked = t("sla_mart").select("ordercode").join(keys.withColumn("found", F.lit(1)), "ordercode", "left")
    return marked.withColumn("found", F.coalesce("found", F.lit(0)))


@_ADD(
    "c_semi_join",
    "SELECT order_code, action_time FROM hub_scan WHERE order_code IN (SELECT order_code FROM shipping_order WHERE status = 'cancel')",
)
def _(t):
    cancelled = t("shipping_order").filter(F.col("status") == P.CANCELLED).select("order_code")
    return t("hub_scan").select("order_code", "action_time").join(cancelled, "order_code", "left_semi")


@_ADD(
    "c_semi_join_distinct",
    """
    SELECT h.order_code, h.package_code FROM hub_scan h
    JOIN (SELECT DISTINCT order_code FROM trip_item WHERE type = 'DELIVER') k ON k.order_code = h.order_code
    """,
)
def _(t):
    keys = t("trip_item").filter(F.col("type") == "DELIVER").select("order_code")
    return t("hub_scan").select("order_code", "package_code").join(keys, "order_code", "left_semi")


@_ADD(
    "c_one_row_join",
    """
    SELECT m.ordercode, m.createddate_partition FROM order_mart m
    CROSS JOIN (SELECT DATE '1998-01-01' AS first_day, DATE '1998-12-31' AS last_day) d
    WHERE m.createddate_partition BETWEEN d.first_day AND d.last_day
    """,
)
def _(t):
    # A one-row parameter relation becomes literals, which prune partitions.
    kept = F.col("createddate_partition").between(F.lit(date(1998, 1, 1)), F.lit(date(1998, 12, 31)))
    return t("order_mart").filter(kept).select("ordercode", "createddate_partition")


@_ADD("c_unnest", "SELECT order_code, order_status FROM pod_flat")
def _(t):
    return t("order_pods").select("order_code", F.explode("pods").alias("pod")).select("order_code", "pod.order_status")


@_ADD(
    "c_correlated_scalar",
    """
    SELECT s.order_code, s.action_time FROM hub_scan s
    WHERE s.action_time < (SELECT min(x.action_time) FROM hub_scan x
                           WHERE x.order_code = s.order_code AND x.action_category = 'export')
    """,
)
def _(t):
    exports = t("hub_scan").filter(F.col("action_category") == P.EXPORT).groupBy("order_code").agg(F.min("action_time").alias("first"))
    joined = t("hub_scan").select("order_code", "action_time").join(exports, "order_code")
    return joined.filter(F.col("action_time") < F.col("first")).drop("first")


# --- aggregation ----------------------------------------------------------------
@_ADD(
    "c_group_by",
    """
    SELECT client_id, CAST(created_date AS DATE) AS day, count(*) AS n FROM shipping_order GROUP BY client_id, 2
    """,
)
def _(t):
    return t("shipping_order").groupBy("client_id", F.to_date("created_date").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@_ADD(
    "c_group_dependent_key",
    "SELECT loaddate, count(*) AS n FROM sla_mart GROUP BY strftime(loaddate, '%Y-%m'), loaddate",
)
def _(t):
    # The month depends on the day, so grouping by it as well changes nothing.
    return t("sla_mart").groupBy("loaddate").agg(F.count(F.lit(1)).alias("n"))


@_ADD(
    "c_having",
    "SELECT order_code, max(action_time) AS last FROM hub_scan GROUP BY order_code HAVING count(*) > 3 AND max(package_code) > 'K2'",
)
def _(t):
    totals = t("hub_scan").groupBy("order_code").agg(
        F.max("action_time").alias("last"), F.count(F.lit(1)).alias("n"), F.max("package_code").alias("package")
    )
    return totals.filter((F.col("n") > 3) & (F.col("package") > "K2")).select("order_code", "last")


@_ADD(
    "c_count_forms",
    """
    SELECT client_id, count(*) AS every_row, count(end_pick_time) AS picked, count(CASE WHEN status = 'cancel' THEN 1 END) AS cancelled
    FROM shipping_order GROUP BY client_id
    """,
)
def _(t):
    return t("shipping_order").groupBy("client_id").agg(
        F.count(F.lit(1)).alias("every_row"),
        F.count("end_pick_time").alias("picked"),
        values.count_if(F.col("status") == P.CANCELLED).alias("cancelled"),
    )


@_ADD(
    "c_count_distinct",
    """
    SELECT warehouse_id, count(DISTINCT order_code) AS orders,
           count(DISTINCT CASE WHEN action_category = 'receive' THEN order_code END) AS received
    FROM hub_scan GROUP BY warehouse_id
    """,
)
def _(t):
    # Distinct pairs first: every count is then an ordinary one.
    per_order = t("hub_scan").groupBy("warehouse_id", "order_code").agg(
        F.max(F.col("action_category") == P.RECEIVE).alias("was_received")
    )
    return per_order.groupBy("warehouse_id").agg(
        F.count(F.lit(1)).alias("orders"), values.count_if(F.col("was_received")).alias("received")
    )


@_ADD(
    "c_sum_forms",
    """
    SELECT toprovince, CAST(sum(delivered) AS BIGINT) AS delivered,
           CAST(sum(CASE WHEN currentstatus = 'cancel' THEN 1 ELSE 0 END) AS BIGINT) AS cancelled
    FROM express_order GROUP BY toprovince
    """,
)
def _(t):
    return t("express_order").groupBy("toprovince").agg(
        F.sum("delivered").alias("delivered"), values.sum_if(F.col("currentstatus") == P.CANCELLED).alias("cancelled")
    )


@_ADD("c_min_max", "SELECT order_code, min(action_time) AS first, max(action_time) AS last FROM hub_scan GROUP BY order_code")
def _(t):
    return t("hub_scan").groupBy("order_code").agg(F.min("action_time").alias("first"), F.max("action_time").alias("last"))


@_ADD(
    "c_min_by_max_by",
    """
    SELECT order_code, arg_min(location_id, CASE WHEN action <> 'SORTING_PARCEL' THEN last_updated_time END) AS first_hub,
           arg_max(location_id, CASE WHEN action <> 'SORTING_PARCEL' THEN last_updated_time END) AS last_hub
    FROM sorter_log GROUP BY order_code
    """,
)
def _(t):
    stamp = F.when(F.col("action") != P.SORTING, F.col("last_updated_time"))
    return t("sorter_log").groupBy("order_code").agg(
        F.min_by("location_id", stamp).alias("first_hub"), F.max_by("location_id", stamp).alias("last_hub")
    )


@_ADD("c_distinct", "SELECT DISTINCT order_code, fail_note FROM trip_item")
def _(t):
    return t("trip_item").select("order_code", "fail_note").distinct()


@_ADD(
    "c_ratio",
    """
    SELECT toprovince, CASE WHEN sum(delivered) = 0 THEN NULL ELSE CAST(sum(ontimeenddelivery) AS DOUBLE) / sum(delivered) END AS ratio
    FROM express_order GROUP BY toprovince
    """,
)
def _(t):
    ratio = F.sum("ontimeenddelivery").cast("double") / F.nullif(F.sum("delivered"), F.lit(0))
    return t("express_order").groupBy("toprovince").agg(ratio.alias("ratio"))


# --- windows, order, sets ---------------------------------------------------------
@_ADD(
    "c_row_number_first",
    """
    SELECT order_code, package_code, action_time FROM (
        SELECT *, row_number() OVER (PARTITION BY order_code, package_code ORDER BY action_time DESC, warehouse_id) AS place
        FROM hub_scan) AS numbered
    WHERE place = 1
    """,
)
def _(t):
    window = Window.partitionBy("order_code", "package_code").orderBy(F.col("action_time").desc_nulls_last(), "warehouse_id")
    numbered = t("hub_scan").withColumn("place", F.row_number().over(window))
    return numbered.filter(F.col("place") == 1).select("order_code", "package_code", "action_time")


@_ADD(
    "c_order_by",
    "SELECT ordercode, pickwh, createddate FROM order_mart ORDER BY pickwh ASC NULLS LAST, createddate DESC NULLS LAST, ordercode",
)
def _(t):
    rows = t("order_mart").select("ordercode", "pickwh", "createddate")
    return rows.orderBy(*values.nulls_last(pickwh="asc", createddate="desc", ordercode="asc"))


@_ADD(
    "c_union_distinct",
    "SELECT order_code, dt FROM hub_scan WHERE action_category = 'receive' UNION SELECT order_code, dt FROM hub_scan "
    "WHERE action_category = 'unpack'",
)
def _(t):
    def rows(category):
        return t("hub_scan").filter(F.col("action_category") == category).select("order_code", "dt")

    return rows(P.RECEIVE).unionByName(rows(P.UNPACK)).distinct()


@_ADD(
    "c_union_all",
    """
    SELECT toprovince AS place, CAST(NULL AS VARCHAR) AS age, CAST(delivered AS DOUBLE) AS metrics FROM express_order
    UNION ALL SELECT tinhhientai, tuoibacklog, CAST(length(madh) AS DOUBLE) FROM backlog_mart
    """,
)
def _(t):
    left = t("express_order").select(
        F.col("toprovince").alias("place"), F.lit(None).cast("string").alias("age"), F.col("delivered").cast("double").alias("metrics")
    )
    right = t("backlog_mart").select(
        F.col("tinhhientai").alias("place"), F.col("tuoibacklog").alias("age"), F.length("madh").cast("double").alias("metrics")
    )
    return left.unionByName(right)


# --- scalar functions -----------------------------------------------------------
@_ADD("c_coalesce", "SELECT order_code, coalesce(to_ward_code, CAST(to_ward_id_v2 AS VARCHAR), '') AS ward FROM shipping_order")
def _(t):
    return t("shipping_order").select(
        "order_code", F.coalesce("to_ward_code", F.col("to_ward_id_v2").cast("string"), F.lit("")).alias("ward")
    )


@_ADD(
    "c_greatest",
    """
    SELECT order_code, CASE WHEN weight IS NULL OR converted_weight IS NULL THEN NULL ELSE greatest(weight, converted_weight) END AS larger
    FROM shipping_order
    """,
)
def _(t):
    larger = values.strict_greatest(F.col("weight"), F.col("converted_weight"))
    return t("shipping_order").select("order_code", larger.alias("larger"))


@_ADD("c_nullif", "SELECT ordercode, nullif(delivered, 0) AS delivered FROM express_order")
def _(t):
    return t("express_order").select("ordercode", F.nullif(F.col("delivered"), F.lit(0)).alias("delivered"))


@_ADD("c_abs", "SELECT l_orderkey, l_linenumber, abs(l_quantity - l_suppkey) AS gap FROM lineitem")
def _(t):
    return t("lineitem").select("l_orderkey", "l_linenumber", F.abs(F.col("l_quantity") - F.col("l_suppkey")).alias("gap"))


@_ADD("c_round", "SELECT order_code, round(CAST(weight AS DECIMAL(20, 6)) / 1000, 3)::DOUBLE AS kg FROM shipping_order")
def _(t):
    return t("shipping_order").select("order_code", values.kilograms(F.col("weight")).alias("kg"))


@_ADD(
    "c_arithmetic",
    "SELECT order_code, weight / 1000.0 AS kg, converted_weight - weight AS extra FROM shipping_order",
)
def _(t):
    return t("shipping_order").select(
        "order_code",
        (F.col("weight") / F.lit(1000.0)).alias("kg"),
        (F.col("converted_weight") - F.col("weight")).alias("extra"),
    )


@_ADD(
    "c_strict_cast",
    """
    SELECT order_code, CAST(warehouse_id AS INT) AS hub, CAST(warehouse_id AS BIGINT) AS wide, CAST(warehouse_id AS DOUBLE) AS number,
           CAST(dt AS DATE) AS day, CAST(dt AS TIMESTAMP) AS moment, CAST(CAST(warehouse_id AS INT) AS VARCHAR) AS text
    FROM hub_scan
    """,
)
def _(t):
    hub = F.col("warehouse_id")
    return t("hub_scan").select(
        "order_code",
        hub.cast("int").alias("hub"),
        hub.cast("bigint").alias("wide"),
        hub.cast("double").alias("number"),
        F.col("dt").cast("date").alias("day"),
        F.col("dt").cast("timestamp_ntz").alias("moment"),
        hub.cast("int").cast("string").alias("text"),
    )


@_ADD(
    "c_try_cast",
    """
    SELECT order_code, warehouse_id, CASE WHEN regexp_full_match(warehouse_id, '[0-9]+') THEN CAST(warehouse_id AS INT) END AS hub
    FROM hub_scan_dirty
    """,
)
def _(t):
    return t("hub_scan_dirty").select("order_code", "warehouse_id", values.lenient(F.col("warehouse_id"), "int").alias("hub"))


@_ADD("c_to_date", "SELECT order_code, CAST(action_time AS DATE) AS day FROM hub_scan")
def _(t):
    return t("hub_scan").select("order_code", F.to_date("action_time").alias("day"))


@_ADD("c_date_literal", "SELECT ordercode, loaddate > DATE '1998-05-18' AS later FROM sla_mart")
def _(t):
    return t("sla_mart").select("ordercode", (F.col("loaddate") > F.lit(date(1998, 5, 18))).alias("later"))


@_ADD(
    "c_date_trunc",
    """
    SELECT order_code, CAST(date_trunc('week', CAST(action_time AS DATE)) AS DATE) AS week_day,
           CAST(date_trunc('week', action_time) AS TIMESTAMP) AS week_start,
           CAST(date_trunc('month', CAST(action_time AS DATE)) AS DATE) AS month_day,
           CAST(date_trunc('minute', action_time) AS TIMESTAMP) AS minute_start
    FROM hub_scan
    """,
)
def _(t):
    moment = F.col("action_time")
    return t("hub_scan").select(
        "order_code",
        times.monday_of(F.to_date(moment)).alias("week_day"),
        times.week_start(moment).alias("week_start"),
        F.trunc(F.to_date(moment), "month").alias("month_day"),
        times.minute_of(moment).alias("minute_start"),
    )


@_ADD(
    "c_date_add",
    """
    SELECT ordercode, loaddate + 2 AS later, CAST(deadlinedeliverysla - INTERVAL 1 DAY AS TIMESTAMP) AS day_before FROM sla_mart
    """,
)
def _(t):
    return t("sla_mart").select(
        "ordercode",
        F.date_add("loaddate", 2).alias("later"),
        F.timestamp_add("DAY", F.lit(-1), F.col("deadlinedeliverysla")).cast("timestamp_ntz").alias("day_before"),
    )


@_ADD(
    "c_date_diff",
    """
    SELECT ordercode, date_sub('hour', endpicktime, startreturntime) AS hours, date_sub('day', endpicktime, startreturntime) AS days
    FROM order_mart
    """,
)
def _(t):
    picked, returned = F.col("endpicktime"), F.col("startreturntime")
    return t("order_mart").select(
        "ordercode",
        times.whole_units("HOUR", picked, returned).alias("hours"),
        times.whole_units("DAY", picked, returned).alias("days"),
    )


@_ADD(
    "c_date_format",
    "SELECT order_code, strftime(created_date, '%Y-%m-%d') AS day, strftime(created_date, '%Y-%m') AS month FROM shipping_order",
)
def _(t):
    created = F.col("created_date")
    return t("shipping_order").select(
        "order_code", F.date_format(created, "yyyy-MM-dd").alias("day"), F.date_format(created, "yyyy-MM").alias("month")
    )


@_ADD("c_hour", "SELECT ordercode, CAST(date_part('hour', createddate) AS INTEGER) AS hour FROM order_mart")
def _(t):
    return t("order_mart").select("ordercode", F.hour("createddate").alias("hour"))


@_ADD(
    "c_interval",
    """
    SELECT ordercode, loaddate + 1 AS next_day, CAST(loaddate + INTERVAL 15 HOUR AS TIMESTAMP) AS afternoon,
           CAST(loaddate - INTERVAL 3 MONTH AS DATE) AS quarter_ago
    FROM sla_mart
    """,
)
def _(t):
    day = F.col("loaddate")
    return t("sla_mart").select(
        "ordercode",
        (day + F.expr("INTERVAL '1' DAY")).alias("next_day"),
        times.day_at(day, 15).alias("afternoon"),
        (day - F.expr("INTERVAL '3' MONTH")).alias("quarter_ago"),
    )


@_ADD(
    "c_as_of",
    """
    SELECT order_code, DATE '2001-08-02' - CAST(created_date AS DATE) AS age_days FROM shipping_order WHERE dt >= '2001-07-03'
    """,
)
def _(t):
    # The report day is an argument, never the clock of the run.
    recent = t("shipping_order").filter(F.col("dt") >= "2001-07-03")
    age = F.datediff(F.lit(date(2001, 8, 2)), F.to_date("created_date"))
    return recent.select("order_code", age.cast("bigint").alias("age_days"))


@_ADD(
    "c_time_zone",
    """
    SELECT event_id, CAST(((ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Ho_Chi_Minh') AS DATE) AS local_day,
           (ts AT TIME ZONE 'UTC') AT TIME ZONE 'Asia/Bangkok' AS local_time
    FROM events
    """,
)
def _(t):
    def local(zone):
        return F.convert_timezone(F.lit("UTC"), F.lit(zone), F.col("ts"))

    return t("events").select(
        "event_id", F.to_date(local(P.LOCAL_ZONE)).alias("local_day"), local(P.TRUCK_ZONE).alias("local_time")
    )


@_ADD(
    "c_iso_timestamp",
    "SELECT event_id, CAST(strftime(ts, '%Y-%m-%dT%H:%M:%S') AS TIMESTAMP) + INTERVAL 7 HOUR AS local_time FROM events",
)
def _(t):
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    return t("events").select("event_id", times.local_time(text, P.TRUCK_ZONE).alias("local_time"))


@_ADD(
    "c_json_scalar",
    """
    SELECT order_code, last_updated_time, json_extract_string(j, '$.feederWeight') AS feeder, json_extract_string(j, '$.missing') AS missing
    FROM (SELECT *, CASE WHEN json_valid(data) THEN CAST(data AS JSON) END AS j FROM sorter_log)
    WHERE action = 'SORTING_PARCEL'
    """,
)
def _(t):
    rows = t("sorter_log").filter(F.col("action") == P.SORTING)
    return rows.select(
        "order_code",
        "last_updated_time",
        F.get_json_object("data", "$.feederWeight").alias("feeder"),
        F.get_json_object("data", "$.missing").alias("missing"),
    )


@_ADD(
    "c_json_nested_scalar",
    """
    SELECT updated_at_date, json_extract_string(partner_router, '$[1].check_in_at."$date"') AS check_in,
           json_extract_string(partner_router, '$[1].stop_point') AS stop_point
    FROM trip_route
    """,
)
def _(t):
    return t("trip_route").select(
        "updated_at_date",
        F.get_json_object("partner_router", "$[1].check_in_at['$date']").alias("check_in"),
        F.get_json_object("partner_router", "$[1].stop_point").alias("stop_point"),
    )


_STOPS = """
    SELECT updated_at_date, unnest(CAST(partner_router AS JSON[])) AS stop FROM trip_route
"""


@_ADD(
    "c_json_array",
    f"SELECT updated_at_date, json_extract_string(stop, '$.stop_point') AS stop_point FROM ({_STOPS})",
)
def _(t):
    stops = t("trip_route").select("updated_at_date", F.explode(F.from_json("partner_router", "array<struct<stop_point:string>>")).alias("stop"))
    return stops.select("updated_at_date", "stop.stop_point")


@_ADD(
    "c_cardinality",
    f"""
    SELECT updated_at_date, CAST(json_array_length(stop, '$.items_dropped') AS INTEGER) AS items FROM ({_STOPS})
    """,
)
def _(t):
    stops = t("trip_route").select(
        "updated_at_date", F.explode(F.from_json("partner_router", "array<struct<items_dropped:array<string>>>")).alias("stop")
    )
    return stops.select("updated_at_date", F.size("stop.items_dropped").alias("items"))


@_ADD("c_struct_field", "SELECT order_code, reason, lat, lng, is_correct FROM pod_flat")
def _(t):
    entries = t("order_pods").select("order_code", F.explode("pods").alias("pod"))
    return entries.select("order_code", "pod.reason", "pod.lat", "pod.lng", "pod.is_correct")


@_ADD("c_array_join", "SELECT order_code, url_list FROM pod_flat")
def _(t):
    entries = t("order_pods").select("order_code", F.explode("pods").alias("pod"))
    return entries.select("order_code", F.array_join("pod.urls", " | ").alias("url_list"))
