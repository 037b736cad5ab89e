"""The ten reports over the sample sources."""

from __future__ import annotations

from datetime import date, datetime

from hubflow import plans
from hubflow.catalog.registry import Catalog
from hubflow.sources.samples import AS_OF, MEASURED_AS_OF, SINCE, WEEKLY_AS_OF

REPORTS = Catalog()

HUB_NAMES = ("Supplier#000000001", "Supplier#000000002", "Supplier#000000003")
BACKLOG_HUBS = tuple(f"Supplier#00000000{i}" for i in range(7))
PROVINCES = ("AFRICA", "AMERICA", "ASIA")
NOW = datetime(2001, 8, 2, 9, 30)

# First arrivals per order and hub, as a plain statement.
ARRIVALS = """
    scans AS (
        SELECT order_code, CAST(warehouse_id AS INT) AS hub, action_time AS moment, trip_code, action_category AS kind
        FROM hub_scan WHERE dt >= '1995-04-01' AND dt < '2001-06-01'),
    arrive AS (
        SELECT order_code, hub, min(moment) AS moment FROM (
            SELECT s.order_code, s.hub, coalesce(e.created_time, s.moment) AS moment
            FROM scans s LEFT JOIN truck_event e
              ON e.action_type = 'VEHICLE_ARRIVE' AND e.dt >= '1995-04-01' AND e.dt < '2001-06-01'
             AND e.transportation_code = s.trip_code AND CAST(e.location_id AS INT) = s.hub
            WHERE s.kind = 'receive'
            UNION ALL
            SELECT order_code, hub, moment FROM scans WHERE kind = 'unpack') AS every_arrival
        GROUP BY order_code, hub)
"""
BULKY = """
    bulky AS (
        SELECT DISTINCT o.order_code, o.client_id, 'Shopee Bulky' AS client_channel, o.deliver_warehouse_id AS goal,
               CASE WHEN o.weight IS NOT NULL AND o.converted_weight IS NOT NULL
                     AND (o.weight >= 20000 OR o.converted_weight >= 20000) THEN 'hang_nang' ELSE 'hang_nhe' END AS service_type,
               p.deliveryprovince AS deli_province, p.externallane
        FROM delivered_order o
        JOIN sla_mart p ON p.ordercode = o.order_code
        LEFT JOIN dim_warehouse w ON w.warehouse_id = o.deliver_warehouse_id
        WHERE o.client_id = 3892833 AND o.dt >= '1995-04-01' AND o.dt < '2001-06-01'
          AND p.loaddate >= DATE '1995-04-01' AND p.loaddate < DATE '2001-06-01'
          AND (w.warehouse_name IS NULL OR w.warehouse_name NOT LIKE '%Ahamove%'))
"""
PASSES = """
    passes AS (
        SELECT b.order_code, count(DISTINCT a.hub) AS n
        FROM bulky b
        JOIN arrive g ON g.order_code = b.order_code AND g.hub = b.goal
        JOIN arrive a ON a.order_code = b.order_code AND a.moment < g.moment
        JOIN dim_warehouse k ON k.warehouse_id = a.hub AND k.warehouse_type = 'KTC'
        GROUP BY b.order_code),
    reached AS (
        SELECT b.order_code, b.client_id, b.client_channel, b.service_type, b.deli_province, b.externallane,
               CAST(min(g.moment) AS DATE) AS created_date
        FROM bulky b JOIN arrive g ON g.order_code = b.order_code AND g.hub = b.goal
        GROUP BY ALL)
"""


@REPORTS.add(
    "r01_hub_pass_weekly",
    f"""
    WITH {ARRIVALS}, {BULKY}, {PASSES}
    SELECT CAST(date_trunc('week', r.created_date) AS DATE) AS week_start, r.client_id, r.client_channel, r.service_type,
           r.deli_province, r.externallane,
           CASE WHEN coalesce(p.n, 0) < 5 THEN concat(coalesce(p.n, 0), '_lan') ELSE '>=5_lan' END AS ktc_pass,
           count(*) AS total_orders
    FROM reached r LEFT JOIN passes p ON p.order_code = r.order_code
    WHERE r.created_date >= DATE '1995-04-01' AND r.created_date < DATE '2001-06-01'
    GROUP BY ALL
    """,
)
def _(t):
    return plans.hub_pass_weekly(
        t("hub_scan"), t("truck_event"), t("delivered_order"), t("sla_mart"), t("dim_warehouse"), since=SINCE, as_of=WEEKLY_AS_OF
    )


# Check-ins per package and hub from the route text, of all routes or of the report's, and arrivals with them.
def route_check_ins_sql(condition: str = "") -> str:
    return f"""
    stops AS (
        SELECT unnest(CAST(partner_router AS JSON[])) AS stop
        FROM trip_route{condition}),
    drops AS (
        SELECT CAST(json_extract_string(stop, '$.check_in_at."$date"') AS TIMESTAMPTZ) AT TIME ZONE 'Asia/Bangkok' AS moment,
               json_extract_string(stop, '$.stop_point') AS stop_point,
               unnest(CAST(json_extract(stop, '$.items_dropped') AS VARCHAR[])) AS package_code
        FROM stops),
    check_ins AS (
        SELECT d.package_code, d.moment,
               CASE WHEN regexp_full_match(m.hub_code, '[0-9]+') THEN CAST(m.hub_code AS INT) END AS hub
        FROM drops d LEFT JOIN stop_map m ON m.code = d.stop_point)
"""


ROUTE_CHECK_INS = route_check_ins_sql(
    " WHERE updated_at_date >= TIMESTAMP '1995-04-01' AND updated_at_date < TIMESTAMP '2001-06-01'"
)
ROUTE_ARRIVALS = """
    log AS (
        SELECT order_code, action_time AS moment, package_code, action_category AS kind,
               CASE WHEN regexp_full_match(warehouse_id, '[0-9]+') THEN CAST(warehouse_id AS INT) END AS hub
        FROM hub_scan_dirty WHERE dt >= '1995-04-01' AND dt < '2001-06-01'),
    arrive AS (
        SELECT order_code, hub, min(moment) AS moment FROM (
            SELECT l.order_code, l.hub, coalesce(c.moment, l.moment) AS moment
            FROM log l LEFT JOIN check_ins c ON c.hub = l.hub AND c.package_code = l.package_code
            WHERE l.kind = 'receive'
            UNION
            SELECT order_code, hub, moment FROM log WHERE kind = 'unpack') AS every_arrival
        GROUP BY order_code, hub)
"""
TRANSIT = """
    cohort AS (
        SELECT DISTINCT o.order_code, o.status, o.pick_warehouse_id, o.deliver_warehouse_id,
               CAST(o.end_pick_time AS DATE) AS picked, w.province_id, w.warehouse_name,
               p.deadlinedeliverysla AS sla_time, p.deliveryprovince AS deli_province, p.externallane
        FROM shipping_order o
        JOIN sla_mart p ON p.ordercode = o.order_code
        LEFT JOIN dim_warehouse w ON w.warehouse_id = o.deliver_warehouse_id
        WHERE o.client_id = 3892833 AND o.end_pick_time IS NOT NULL
          AND o.dt >= '1995-04-01' AND o.dt < '2001-06-01'
          AND p.loaddate BETWEEN DATE '1995-04-01' AND DATE '2001-05-31'
          AND coalesce(w.warehouse_name, '') NOT LIKE '%Ahamove%')
"""
TRANSIT_ARRIVED = """
    timed AS (
        SELECT c.*, a.moment, CAST(c.sla_time AS DATE) - CAST(a.moment AS DATE) AS early,
               CASE WHEN c.province_id IN (201, 202) THEN 8 WHEN c.province_id IS NOT NULL THEN 9 END AS cutoff,
               epoch(a.moment) - epoch(date_trunc('day', a.moment)) AS second_of_day
        FROM cohort c JOIN arrive a ON a.order_code = c.order_code AND a.hub = c.deliver_warehouse_id
        WHERE a.moment >= TIMESTAMP '1995-04-01' AND a.moment < TIMESTAMP '2001-06-01')
"""
BUCKETS = """
           count(*) FILTER (WHERE epoch(moment) < epoch(date_trunc('day', sla_time)) - 9 * 3600) AS ontime_tc,
           count(*) FILTER (WHERE early < 0) AS da_tre,
           count(*) FILTER (WHERE early = 0 AND second_of_day > cutoff * 3600) AS "D0C2",
           count(*) FILTER (WHERE early = 0 AND second_of_day <= cutoff * 3600) AS "D0C1",
           count(*) FILTER (WHERE early = 1 AND second_of_day > cutoff * 3600) AS "D1C2",
           count(*) FILTER (WHERE early = 1 AND second_of_day <= cutoff * 3600) AS "D1C1",
           count(*) FILTER (WHERE early = 2) AS "D2",
           count(*) FILTER (WHERE early > 2) AS "D3",
           count(*) AS tong_don
"""


@REPORTS.add(
    "r02_transit_sla_weekly",
    f"""
    WITH {ROUTE_CHECK_INS}, {ROUTE_ARRIVALS}, {TRANSIT}, {TRANSIT_ARRIVED}
    SELECT CAST(date_trunc('week', moment) AS TIMESTAMP) AS week_start, deli_province, externallane, {BUCKETS}
    FROM timed GROUP BY 1, 2, 3
    """,
)
def _(t):
    return plans.transit_sla_weekly(
        t("shipping_order"),
        t("sla_mart"),
        t("dim_warehouse"),
        t("hub_scan_dirty"),
        t("trip_route"),
        t("stop_map"),
        as_of=WEEKLY_AS_OF,
        since=SINCE,
        lookback_days=(WEEKLY_AS_OF - SINCE).days,
    )


# Pick-up lines before grouping: one row per SLA row and mart row of an order.
PICKUP_LINES = """
    lines AS (
        SELECT a.ordercode, a.pickprovince, a.pickdistrict, v.isexpecteddropoff, v.currentstatus,
               CAST(v.canceltime AS DATE) AS cancelled, CAST(v.firstupdatedpickeduptime AS DATE) AS picked,
               CAST(v.orderdate AS DATE)
                 + CASE WHEN CAST(v.createddate AS DATE) = CAST(v.orderdate AS DATE) AND hour(v.createddate) >= 19
                        THEN 1 ELSE 0 END AS order_date,
               EXISTS (SELECT 1 FROM trip_item i WHERE i.order_code = a.ordercode AND i.type = 'PICK'
                       AND i.fail_note = 'Nhân viên gặp sự cố' AND i.dt >= '1995-04-01') AS incident
        FROM sla_mart a JOIN order_mart v ON v.ordercode = a.ordercode
        WHERE a.loaddate >= DATE '1995-04-01' AND v.createddate_partition >= DATE '1995-04-01'
          AND a.clientid IN ('18692', '3892833')
          AND NOT (coalesce(v.pickwh, '') LIKE '%Ahamove%' OR coalesce(v.pickwh, '') LIKE '%Key Account%')),
    judged AS (
        SELECT *, coalesce(CASE WHEN currentstatus = 'cancel' THEN cancelled > order_date ELSE currentstatus IS NOT NULL END,
                           false) AS valid
        FROM lines)
"""


@REPORTS.add(
    "r03_pickup_ontime_daily",
    f"""
    WITH {PICKUP_LINES}
    SELECT order_date, pickprovince, pickdistrict,
           count(DISTINCT ordercode) FILTER (WHERE valid) AS pu_total_orders,
           count(*) FILTER (WHERE valid AND isexpecteddropoff IS NOT TRUE AND picked <= order_date) AS ontime_pu_orders,
           count(*) FILTER (WHERE incident) AS don_co_attempt_nvgsc,
           count(*) FILTER (WHERE incident AND picked > order_date) AS don_late_va_nvgsc
    FROM judged GROUP BY ALL
    """,
)
def _(t):
    return plans.pickup_ontime_daily(t("sla_mart"), t("order_mart"), t("trip_item"), since=SINCE)


@REPORTS.add("r04_compensation_extract", "SELECT * FROM claim WHERE ngay_duyet_eform >= DATE '2001-01-01'")
def _(t):
    return plans.compensation_extract(t("claim"), approved_since=date(2001, 1, 1))


@REPORTS.add(
    "r05_failed_delivery_by_hub",
    """
    SELECT w.warehouse_name AS deliverywh,
           CASE WHEN o.client_id IN (18692, 3892833) THEN 'Shopee'
                WHEN o.client_id IN (3819710, 4447237) THEN 'TikTokShop' ELSE 'Khác' END AS client_label,
           count(*) AS total_orders,
           count(*) FILTER (WHERE o.status LIKE '%return%') AS fd_orders
    FROM shipping_order o JOIN hub_name w ON w.warehouse_id = o.deliver_warehouse_id
    WHERE o.dt > '1999-02-01' AND CAST(o.end_pick_time AS DATE) BETWEEN DATE '1999-01-01' AND DATE '1999-12-31'
      AND w.warehouse_name IN ('Supplier#000000001', 'Supplier#000000002', 'Supplier#000000003')
    GROUP BY 1, 2
    """,
)
def _(t):
    return plans.failed_delivery_by_hub(
        t("shipping_order"),
        t("hub_name"),
        created_after=date(1999, 2, 1),
        picked=(date(1999, 1, 1), date(1999, 12, 31)),
        hub_names=HUB_NAMES,
    )


SAMPLE = """
    sample AS (
        SELECT ordercode AS order_code, deliverywarehouseid, deliverywh, toprovince, CAST(endpicktime AS DATE) AS pick_date,
               numdeliver, firstfaildeliverynote, secondfaildeliverynote, thirdfaildeliverynote, lastfaildeliverynote,
               allfailnote, startreturntime, date_sub('hour', endpicktime, startreturntime) AS hours_pick_to_return
        FROM order_mart
        WHERE createddate_partition BETWEEN DATE '2000-01-20' AND DATE '2000-12-10' AND startreturntime IS NOT NULL
          AND CAST(endpicktime AS DATE) BETWEEN DATE '2000-01-01' AND DATE '2000-12-31'
          AND clienttype IN ('SPE', 'SPB', 'TTSE', 'TTSB') AND deliverywarehouseid IN (1, 2, 3))
"""
SAMPLE_ARGS = {
    "partitions": (date(2000, 1, 20), date(2000, 12, 10)),
    "picked": (date(2000, 1, 1), date(2000, 12, 31)),
    "client_types": ("SPE", "SPB", "TTSE", "TTSB"),
    "hub_ids": (1, 2, 3),
}


@REPORTS.add(
    "r06_failed_delivery_pod_sample",
    f"""
    WITH {SAMPLE}
    SELECT s.*, p.order_status AS pod_status, p.reason AS pod_reason, p.time AS pod_time, p.lat AS pod_lat, p.lng AS pod_lng,
           p.is_correct AS pod_is_correct, p.url_list AS pod_url_list
    FROM sample s LEFT JOIN pod_flat p
      ON p.order_code = s.order_code AND p.createddate_partition BETWEEN DATE '2000-01-20' AND DATE '2000-12-10'
    """,
)
def _(t):
    return plans.failed_delivery_pod_sample(t("order_mart"), t("order_pods"), **SAMPLE_ARGS)


PENDING = """
    pending AS (
        SELECT *, CASE client_id WHEN 18692 THEN 'SPE' WHEN 3892833 THEN 'SPB' WHEN 3819710 THEN 'TTSE'
                                 WHEN 4447237 THEN 'TTSB' ELSE 'SME' END AS client_group
        FROM shipping_order
        WHERE dt >= '2000-08-02' AND current_warehouse_id = deliver_warehouse_id
          AND status NOT IN ('delivered', 'returned', 'return', 'lost', 'scrap')
          AND client_id NOT IN (2781603, 2590595, 224845, 9794, 1367))
"""
LAST_SCANS = """
    last_receive AS (
        SELECT s.order_code, max(s.action_time) AS moment
        FROM hub_scan s JOIN pending b ON b.order_code = s.order_code AND b.deliver_warehouse_id = CAST(s.warehouse_id AS BIGINT)
        WHERE s.dt >= '2000-08-02' AND s.action_name = 'RECEIVE_PACKAGE' GROUP BY s.order_code),
    last_unpack AS (
        SELECT s.order_code, max(s.action_time) AS moment
        FROM hub_scan s JOIN pending b ON b.order_code = s.order_code AND b.deliver_warehouse_id = CAST(s.warehouse_id AS BIGINT)
        WHERE s.dt >= '2000-08-02' AND s.action_category = 'unpack' GROUP BY s.order_code)
"""
WARDS = """
    wards AS (
        SELECT CAST(ward_id AS VARCHAR) AS towardcode, max(province_name) AS toprovince, max(district_name) AS todistrict,
               max(ward_name) AS ward_name
        FROM dim_ward GROUP BY 1)
"""


@REPORTS.add(
    "r07_delivery_backlog",
    f"""
    WITH {PENDING}, {LAST_SCANS}, {WARDS},
    hubs AS (SELECT warehouse_id, max(warehouse_name) AS name FROM dim_warehouse GROUP BY 1),
    wide AS (
        SELECT b.order_code AS ordercode, CAST(b.created_date AS DATE) AS created_date, b.client_id AS clientid, b.client_group,
               b.status AS currentstatus, h.name AS currentwh, h.name AS deliverywh, d.toprovince, d.todistrict, d.towardcode,
               d.ward_name, coalesce(r.moment, u.moment, b.end_pick_time) AS inbounddeliveryhubtime,
               CASE WHEN r.moment IS NOT NULL THEN 'receive_package' WHEN u.moment IS NOT NULL THEN 'unpack'
                    WHEN b.end_pick_time IS NOT NULL THEN 'end_pick_time' END AS ibh_source,
               row_number() OVER (PARTITION BY b.order_code ORDER BY b.created_date DESC NULLS LAST) AS place
        FROM pending b
        JOIN hubs h ON h.warehouse_id = b.current_warehouse_id
        JOIN wards d ON d.towardcode = coalesce(b.to_ward_code, CAST(b.to_ward_id_v2 AS VARCHAR))
        LEFT JOIN last_receive r ON r.order_code = b.order_code
        LEFT JOIN last_unpack u ON u.order_code = b.order_code
        WHERE h.name IN ({", ".join(f"'{n}'" for n in BACKLOG_HUBS)}) AND d.toprovince IN ('AFRICA', 'AMERICA', 'ASIA'))
    SELECT * EXCLUDE (place),
           date_sub('hour', inbounddeliveryhubtime, TIMESTAMP '2001-08-02 09:30:00') AS pending_hours,
           date_sub('day', inbounddeliveryhubtime, TIMESTAMP '2001-08-02 09:30:00') AS pending_days
    FROM wide WHERE place = 1
    """,
)
def _(t):
    return plans.delivery_backlog(
        t("shipping_order"),
        t("hub_scan"),
        t("dim_warehouse"),
        t("dim_ward"),
        now=NOW,
        hub_names=BACKLOG_HUBS,
        provinces=PROVINCES,
        lookback_days=365,
    )


DELIVERED = """
    SELECT CAST(enddeliveredtime AS DATE) AS report_date, toprovince,
           CASE WHEN sum(delivered) <> 0 THEN CAST(sum(ontimeenddelivery) AS DOUBLE) / sum(delivered) END AS metrics
    FROM express_order
    WHERE createddate >= DATE '2001-06-20' AND CAST(enddeliveredtime AS DATE) = DATE '2001-07-19' GROUP BY 1, 2
"""
CREATED = """
    SELECT createddate AS report_date, toprovince, count(DISTINCT ordercode) AS metrics
    FROM express_order
    WHERE createddate BETWEEN DATE '2001-06-20' AND DATE '2001-07-19' AND currentstatus <> 'cancel' GROUP BY 1, 2
"""
BACKLOG = """
    SELECT DATE '2001-07-19' AS report_date, tinhhientai AS toprovince, tuoibacklog, count(DISTINCT madh) AS metrics
    FROM backlog_mart WHERE ordertype = 'Express' AND tuoibacklog IS NOT NULL GROUP BY 2, 3
"""


@REPORTS.add(
    "r08_express_daily_metrics",
    f"""
    SELECT report_date, toprovince, CAST(NULL AS VARCHAR) AS tuoibacklog, metrics, 'DELIVERED' AS metric_type FROM ({DELIVERED})
    UNION ALL
    SELECT report_date, toprovince, NULL, CAST(metrics AS DOUBLE), 'CREATED' FROM ({CREATED})
    UNION ALL
    SELECT report_date, toprovince, tuoibacklog, CAST(metrics AS DOUBLE), 'BACKLOG' FROM ({BACKLOG})
    """,
)
def _(t):
    return plans.express_daily_metrics(t("express_order"), t("backlog_mart"), as_of=AS_OF)


def cohort_sql(first: str, last: str, partition: str) -> str:
    return f"""
    cohort AS (
        SELECT ordercode, CASE clientid WHEN 3819710 THEN 'TTS_Exp' ELSE 'TTS_Bulky' END AS client_type,
               CASE currentstatus WHEN 'delivered' THEN 'deli' ELSE 'return' END AS journey_type,
               CAST(CASE currentstatus WHEN 'delivered' THEN enddeliverytime ELSE endreturntime END AS DATE) AS success_date
        FROM completed_mart
        WHERE clientid IN (3819710, 4447237) AND currentstatus IN ('delivered', 'returned')
          AND createddate_partition >= DATE '{partition}'
          AND CAST(CASE currentstatus WHEN 'delivered' THEN enddeliverytime ELSE endreturntime END AS DATE)
              BETWEEN DATE '{first}' AND DATE '{last}')
    """


def readings_sql(first: str) -> str:
    return f"""
    parsed AS (
        SELECT order_code, location_id, last_updated_time, action, CASE WHEN json_valid(data) THEN CAST(data AS JSON) END AS j
        FROM sorter_log WHERE order_code IS NOT NULL AND date_partition >= '{first}'),
    raw_readings AS (
        SELECT order_code, location_id, last_updated_time, j ->> '$.feederWeight' AS w, NULL AS l, NULL AS b, NULL AS h
        FROM parsed WHERE action = 'SORTING_PARCEL' AND location_id IN ('1626', '21365000')
        UNION ALL
        SELECT order_code, location_id, last_updated_time, j ->> '$.weight', NULL, NULL, NULL
        FROM parsed WHERE action = 'WEIGHING_PARCEL' AND location_id = '21365000'
        UNION ALL
        SELECT order_code, location_id, last_updated_time, NULL, j ->> '$.dwsLength', j ->> '$.dwsWidth', j ->> '$.dwsHeight'
        FROM parsed WHERE action = 'DWS_PARCEL' AND location_id IN ('1626', '21365000')
        UNION ALL
        SELECT order_code, location_id, last_updated_time, j ->> '$.dwsWeight', j ->> '$.dwsLength', j ->> '$.dwsWidth',
               j ->> '$.dwsHeight'
        FROM parsed WHERE action = 'MATRIX_SCANNED_PARCEL' AND location_id IN ('1626', '21365000')),
    readings AS (
        SELECT order_code, location_id, last_updated_time, TRY_CAST(w AS DOUBLE) AS weight_g, TRY_CAST(l AS DOUBLE) AS length_mm,
               TRY_CAST(b AS DOUBLE) AS width_mm, TRY_CAST(h AS DOUBLE) AS height_mm
        FROM raw_readings),
    complete AS (
        SELECT order_code, location_id FROM readings GROUP BY ALL
        HAVING max(weight_g) > 0 AND max(length_mm) > 0 AND max(width_mm) > 0 AND max(height_mm) > 0)
    """


def weights_sql(same_hub: bool) -> str:
    keys = "order_code, location_id" if same_hub else "order_code"
    return f"""
    passes AS (
        SELECT order_code, location_id, date_trunc('minute', last_updated_time) AS measured_time,
               round(max(weight_g) / 1000, 3) AS weight_kg
        FROM readings WHERE ({keys}) IN (SELECT {'(' + keys + ')' if same_hub else keys} FROM complete)
        GROUP BY ALL HAVING max(weight_g) > 0),
    weights AS (
        SELECT order_code,
               arg_min(weight_kg, measured_time) FILTER (WHERE location_id = '21365000') AS "first_HY",
               arg_max(weight_kg, measured_time) FILTER (WHERE location_id = '21365000') AS "last_HY",
               count(*) FILTER (WHERE location_id = '21365000') AS "passes_HY",
               arg_min(weight_kg, measured_time) FILTER (WHERE location_id = '1626') AS "first_XA",
               arg_max(weight_kg, measured_time) FILTER (WHERE location_id = '1626') AS "last_XA",
               count(*) FILTER (WHERE location_id = '1626') AS "passes_XA"
        FROM passes GROUP BY order_code)
    """


GAPS = """
    gaps AS (
        SELECT order_code, "last_HY", "last_XA",
               CASE WHEN "passes_HY" > 1 THEN abs("last_HY" - "first_HY") END AS "gap_HY",
               CASE WHEN "passes_XA" > 1 THEN abs("last_XA" - "first_XA") END AS "gap_XY",
               abs("last_HY" - "last_XA") AS gap_2_kho
        FROM weights)
"""


def band_columns() -> str:
    parts = []
    for gap in ("gap_HY", "gap_XY", "gap_2_kho"):
        for suffix, rule in (("duoi_1kg", "< 1"), ("1_den_2kg", "BETWEEN 1 AND 2"), ("tren_2kg", "> 2")):
            parts.append(f'count(DISTINCT c.ordercode) FILTER (WHERE g."{gap}" {rule}) AS "{gap}_{suffix}"')
    return ", ".join(parts)


SUMMARY_COHORT = cohort_sql("2023-10-01", "2024-01-31", "2023-10-01")
DETAIL_COHORT = cohort_sql("2024-01-30", "2024-01-30", "2024-01-01")


@REPORTS.add(
    "r09_weight_gap_summary",
    f"""
    WITH {SUMMARY_COHORT}, {readings_sql("2023-10-01")}, {weights_sql(True)}, {GAPS}
    SELECT c.success_date, c.client_type, c.journey_type, count(DISTINCT c.ordercode) AS mau_total_toan_quoc,
           count(DISTINCT c.ordercode) FILTER (WHERE g."last_HY" IS NOT NULL) AS "tu_do_dac_HY",
           count(DISTINCT c.ordercode) FILTER (WHERE g."last_XA" IS NOT NULL) AS "tu_do_dac_XA",
           {band_columns()}
    FROM cohort c LEFT JOIN gaps g ON g.order_code = c.ordercode GROUP BY 1, 2, 3
    """,
)
def _(t):
    return plans.weight_gap_summary(t("completed_mart"), t("sorter_log"), as_of=MEASURED_AS_OF)


DETAIL = """
    SELECT c.ordercode, c.success_date, c.client_type, c.journey_type,
           CASE WHEN g."last_HY" IS NULL THEN '1626' WHEN g."last_XA" IS NULL THEN '21365000' ELSE 'HY + XA' END AS id_ktc,
           round(g."last_HY", 3) AS "rdc_last_measured_HY_kg", round(g."last_XA", 3) AS "rdc_last_measured_XA_kg",
           round(greatest(g."gap_HY", g."gap_XY"), 3) AS intra_warehouse_gap1_kg,
           round(g.gap_2_kho, 3) AS cross_warehouse_gap2_kg
    FROM cohort c JOIN gaps g ON g.order_code = c.ordercode
    WHERE g."gap_HY" IS NOT NULL OR g."gap_XY" IS NOT NULL OR g.gap_2_kho IS NOT NULL
"""


@REPORTS.add(
    "r10_weight_gap_detail",
    f"""
    WITH {DETAIL_COHORT}, {readings_sql("2024-01-01")}, {weights_sql(False)}, {GAPS} {DETAIL}
    """,
)
def _(t):
    return plans.weight_gap_detail(t("completed_mart"), t("sorter_log"), as_of=MEASURED_AS_OF)
