"""Report sources derived from the sample tables.

Each view is one SELECT in the SQL that Spark and DuckDB share, so a query and
its check read the same rows. Views neither drop rows to stay small nor gather a
group into one value: all of them are projections, filters and one key join.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.sources.schemas import conform

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Report dates inside the range of the sample tables, so that every bound cuts rows. Days of partitions, loading and events
# differ by row for the same reason.
SINCE = date(1995, 4, 1)
WEEKLY_AS_OF = date(2001, 6, 1)
AS_OF = date(2001, 7, 20)
MEASURED_AS_OF = date(2024, 1, 31)

VIEWS = {
    "dim_warehouse": """
        SELECT s_suppkey AS warehouse_id,
               CASE WHEN s_suppkey = 9 THEN 'Ahamove ' || s_name ELSE s_name END AS warehouse_name,
               CASE WHEN s_suppkey % 5 = 1 THEN 'BC' ELSE 'KTC' END AS warehouse_type,
               CAST(CASE WHEN s_suppkey < 3 THEN 201 WHEN s_suppkey = 5 THEN NULL ELSE 300 + s_suppkey END AS INT) AS province_id,
               CAST(s_nationkey AS STRING) AS region_shortname
        FROM supplier
    """,
    # One row per order and, for every sixteenth, another with a later creation, status and pick-up.
    "order_version": """
        SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, 0 AS version,
               o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 + 24 * (o_orderkey % 121) - 1440 AS INT) AS created_date,
               o_orderdate + INTERVAL '1' HOUR * CAST(12 + o_orderkey % 30 AS INT) AS picked
        FROM orders
        UNION ALL
        SELECT o_orderkey, o_custkey, 'P' AS o_orderstatus, o_totalprice, 1 AS version,
               o_orderdate + INTERVAL '1' HOUR * CAST(2 + o_orderkey % 24 + 24 * (o_orderkey % 121) - 1440 AS INT) AS created_date,
               o_orderdate + INTERVAL '1' HOUR * CAST(36 + o_orderkey % 30 AS INT) AS picked
        FROM orders WHERE o_orderkey % 16 = 3
    """,
    "shipping_order": """
        SELECT 'O' || CAST(o_orderkey AS STRING) AS order_code,
               CASE o_custkey % 6 WHEN 0 THEN 18692 WHEN 1 THEN 3892833 WHEN 2 THEN 3819710
                    WHEN 3 THEN 4447237 WHEN 4 THEN 2781603 ELSE 100000 + o_custkey END AS client_id,
               CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 4 = 0 THEN 'returned' ELSE 'delivered' END
                    WHEN o_orderkey % 5 = 0 THEN 'cancel'
                    WHEN o_orderkey % 5 = 1 THEN 'return_transporting' ELSE 'storing' END AS status,
               created_date,
               CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE picked END AS end_pick_time,
               (CAST(floor(o_orderkey / 3) AS BIGINT) + version) % 10 AS pick_warehouse_id,
               o_custkey % 10 AS deliver_warehouse_id,
               CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 10
                    ELSE CAST(floor(o_orderkey / 3) AS BIGINT) % 10 END AS current_warehouse_id,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_totalprice / 10 END AS weight,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice / 8 END AS converted_weight,
               CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_custkey % 25 AS STRING) END AS to_ward_code,
               o_custkey % 25 AS to_ward_id_v2,
               CAST(CAST(created_date AS DATE) AS STRING) AS dt
        FROM order_version
    """,
    # The same orders by another day: the end of their delivery, one to five days later.
    "delivered_order": """
        SELECT order_code, client_id, deliver_warehouse_id, weight, converted_weight,
               CAST(CAST(created_date + INTERVAL '1' DAY * CAST(1 + deliver_warehouse_id % 5 AS INT) AS DATE) AS STRING) AS dt
        FROM shipping_order
    """,
    "hub_name": """
        SELECT warehouse_id, warehouse_name FROM dim_warehouse
    """,
    # One promise per order and, for every twentieth, another lane loaded a day later.
    "sla_mart": """
        SELECT CASE WHEN o_orderkey % 50 = 49 THEN 'X' ELSE 'O' END || CAST(o_orderkey AS STRING) AS ordercode,
               CASE o_custkey % 6 WHEN 0 THEN '18692' WHEN 1 THEN '3892833' ELSE 'other' END AS clientid,
               o_orderdate + INTERVAL '1' HOUR * CAST(44 + 24 * (o_custkey % 4) AS INT) AS deadlinedeliverysla,
               'P' || CAST(o_custkey % 10 AS STRING) AS deliveryprovince,
               CASE WHEN again = 1 THEN 'L9' ELSE 'L' || CAST(o_custkey % 3 AS STRING) END AS externallane,
               'P' || CAST(CAST(floor(o_orderkey / 3) AS BIGINT) % 10 AS STRING) AS pickprovince,
               'D' || CAST(o_orderkey % 4 AS STRING) AS pickdistrict,
               CAST(o_orderdate + INTERVAL '1' DAY * CAST(o_custkey % 121 - 60 + again AS INT) AS DATE) AS loaddate
        FROM (SELECT *, 0 AS again FROM orders UNION ALL SELECT *, 1 AS again FROM orders WHERE o_orderkey % 20 = 7) AS promises
    """,
    "order_mart": """
        SELECT 'O' || CAST(o_orderkey AS STRING) AS ordercode,
               CASE o_custkey % 6 WHEN 0 THEN 18692 WHEN 1 THEN 3892833 WHEN 2 THEN 3819710
                    WHEN 3 THEN 4447237 WHEN 4 THEN 2781603 ELSE 100000 + o_custkey END AS clientid,
               CASE o_custkey % 6 WHEN 0 THEN 'SPE' WHEN 1 THEN 'SPB' WHEN 2 THEN 'TTSE' WHEN 3 THEN 'TTSB' ELSE 'SME' END AS clienttype,
               CASE WHEN o_orderkey % 37 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'returned'
                    WHEN o_orderkey % 2 = 0 THEN 'cancel' ELSE 'storing' END AS currentstatus,
               CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderkey % 9 = 1 END AS isexpecteddropoff,
               CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0
                    THEN o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 60 AS INT) ELSE NULL END AS canceltime,
               CASE WHEN o_orderkey % 11 = 0 THEN NULL
                    ELSE o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 53 AS INT) END AS firstupdatedpickeduptime,
               o_orderdate AS orderdate,
               o_orderdate + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT) AS createddate,
               CAST(o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 121 - 60 AS INT) AS DATE) AS createddate_partition,
               o_orderdate + INTERVAL '1' HOUR * CAST(12 + o_orderkey % 30 AS INT) AS endpicktime,
               CASE WHEN o_orderstatus = 'O'
                    THEN o_orderdate + INTERVAL '1' HOUR * CAST(40 + o_orderkey % 90 AS INT) ELSE NULL END AS startreturntime,
               CASE WHEN o_orderkey % 13 = 0 THEN 'Kho Ahamove' WHEN o_orderkey % 13 = 1 THEN 'Key Account'
                    WHEN o_orderkey % 13 = 2 THEN NULL ELSE 'BC' END AS pickwh,
               o_custkey % 10 AS deliverywarehouseid,
               'H' || CAST(o_custkey % 10 AS STRING) AS deliverywh,
               'P' || CAST(o_custkey % 10 AS STRING) AS toprovince,
               CAST(o_orderkey % 4 AS INT) AS numdeliver,
               CASE WHEN o_orderkey % 4 >= 1 THEN 'note1' ELSE NULL END AS firstfaildeliverynote,
               CASE WHEN o_orderkey % 4 >= 2 THEN 'note2' ELSE NULL END AS secondfaildeliverynote,
               CASE WHEN o_orderkey % 4 >= 3 THEN 'note3' ELSE NULL END AS thirdfaildeliverynote,
               CASE WHEN o_orderkey % 4 >= 1 THEN 'note' || CAST(o_orderkey % 4 AS STRING) ELSE NULL END AS lastfaildeliverynote,
               CASE WHEN o_orderkey % 4 >= 1 THEN 'notes:' || CAST(o_orderkey % 4 AS STRING) ELSE NULL END AS allfailnote
        FROM orders
    """,
    "hub_scan": """
        SELECT 'O' || CAST(l_orderkey AS STRING) AS order_code,
               CAST(CASE WHEN l_linenumber >= 6 THEN o_custkey % 10
                         WHEN o_orderkey % 4 = 0 THEN (CAST(floor(o_orderkey / 4) AS BIGINT) + 3 * l_linenumber) % 10
                         ELSE l_suppkey % 10 END AS STRING) AS warehouse_id,
               o_orderdate + INTERVAL '1' HOUR * CAST(l_linenumber * 11 + l_partkey % 24 AS INT) AS action_time,
               'K' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS package_code,
               'T' || CAST(l_orderkey AS STRING) AS trip_code,
               CASE WHEN l_returnflag = 'R' THEN 'receive' WHEN l_returnflag = 'A' OR l_partkey % 2 = 0 THEN 'unpack' ELSE 'export' END AS action_category,
               CASE WHEN l_returnflag = 'R' THEN 'RECEIVE_PACKAGE' WHEN l_returnflag = 'A' OR l_partkey % 2 = 0 THEN 'UNPACK' ELSE 'EXPORT' END AS action_name,
               CAST(CAST(o_orderdate + INTERVAL '1' HOUR * CAST(l_linenumber * 11 + l_partkey % 24 + CASE l_partkey % 4 WHEN 0 THEN 1440 WHEN 1 THEN -1440 ELSE 0 END AS INT) AS DATE) AS STRING) AS dt
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
    "hub_scan_dirty": """
        SELECT order_code,
               CASE WHEN order_code LIKE '%7' AND action_name = 'UNPACK' THEN 'x' || warehouse_id ELSE warehouse_id END AS warehouse_id,
               action_time, package_code, trip_code, action_category, action_name, dt
        FROM hub_scan
    """,
    "truck_event": """
        SELECT 'T' || CAST(l_orderkey AS STRING) AS transportation_code,
               CAST(CASE WHEN l_linenumber >= 6 THEN o_custkey % 10
                         WHEN o_orderkey % 4 = 0 THEN (CAST(floor(o_orderkey / 4) AS BIGINT) + 3 * l_linenumber) % 10
                         ELSE l_suppkey % 10 END AS STRING) AS location_id,
               o_orderdate + INTERVAL '1' HOUR * CAST(l_linenumber * 9 + l_suppkey % 4 * 30 AS INT) AS created_time,
               CASE WHEN l_linestatus = 'O' THEN 'VEHICLE_ARRIVE' ELSE 'VEHICLE_LEAVE' END AS action_type,
               CAST(CAST(o_orderdate + INTERVAL '1' HOUR * CAST(l_linenumber * 9 + l_suppkey % 4 * 30 + CASE CAST(floor(l_partkey / 4) AS BIGINT) % 2 WHEN 0 THEN 1440 WHEN 1 THEN -1440 ELSE 0 END AS INT) AS DATE) AS STRING) AS dt
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
    "trip_route": """
        SELECT 'T' || CAST(l_orderkey AS STRING) AS trip_code,
               o_orderdate + INTERVAL '1' HOUR * CAST(l_linenumber * 13 + CASE CAST(floor(l_partkey / 4) AS BIGINT) % 4 WHEN 0 THEN 1440 WHEN 1 THEN -1440 ELSE 0 END AS INT) AS updated_at_date,
               '[{"check_in_at":null,"stop_point":"S0","items_dropped":[]},{"check_in_at":'
               || CASE WHEN l_partkey % 5 = 0 THEN 'null' ELSE '{"$date":"' || CAST(CAST(o_orderdate AS DATE) AS STRING) || 'T'
                    || CASE WHEN l_linenumber * 3 < 10 THEN '0' ELSE '' END || CAST(l_linenumber * 3 AS STRING) || ':15:00Z"}' END
               || ',"stop_point":"S' || CAST(CASE WHEN l_linenumber >= 6 THEN o_custkey % 10
                         WHEN o_orderkey % 4 = 0 THEN (CAST(floor(o_orderkey / 4) AS BIGINT) + 3 * l_linenumber) % 10
                         ELSE l_suppkey % 10 END AS STRING) || '","items_dropped":'
               || CASE WHEN l_partkey % 11 = 0 THEN '[]'
                       ELSE '["K' || CAST(l_orderkey AS STRING) || '-' || CAST(l_linenumber AS STRING) || '"]' END
               || '}]' AS partner_router
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
    "stop_map": """
        SELECT CASE WHEN s_suppkey = 7 THEN 'R' ELSE 'S' END || CAST(s_suppkey AS STRING) AS code,
               CASE WHEN s_suppkey = 8 THEN 'n/a' ELSE CAST(s_suppkey AS STRING) END AS hub_code
        FROM supplier
    """,
    "trip_item": """
        SELECT 'O' || CAST(l_orderkey AS STRING) AS order_code,
               CASE WHEN l_linestatus = 'O' THEN 'PICK' ELSE 'DELIVER' END AS type,
               CASE WHEN l_partkey % 8 = 0 THEN 'Nhân viên gặp sự cố' ELSE 'khác' END AS fail_note,
               CAST(CAST(l_shipdate - INTERVAL '60' DAY AS DATE) AS STRING) AS dt
        FROM lineitem
    """,
    "dim_ward": """
        SELECT n_nationkey AS ward_id, r_name AS province_name, n_name AS district_name, n_name || '-a' AS ward_name
        FROM nation JOIN region ON n_regionkey = r_regionkey
        UNION ALL
        SELECT n_nationkey AS ward_id, r_name AS province_name, n_name AS district_name, n_name || '-b' AS ward_name
        FROM nation JOIN region ON n_regionkey = r_regionkey
    """,
    "express_order": """
        SELECT 'O' || CAST(o_orderkey AS STRING) AS ordercode,
               CAST(o_orderdate AS DATE) AS createddate,
               CASE WHEN o_orderstatus = 'F' THEN o_orderdate + INTERVAL '1' HOUR * CAST(24 + o_orderkey % 60 + 24 * (o_orderkey % 40) AS INT) ELSE NULL END AS enddeliveredtime,
               'P' || CAST(o_custkey % 10 AS STRING) AS toprovince,
               CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 <> 0 THEN 1 ELSE 0 END AS ontimeenddelivery,
               CASE WHEN o_orderstatus = 'F' AND o_custkey % 10 <> 9 THEN 1 ELSE 0 END AS delivered,
               CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN 'cancel' ELSE 'storing' END AS currentstatus
        FROM orders
    """,
    "backlog_mart": """
        SELECT 'O' || CAST(o_orderkey AS STRING) AS madh,
               'P' || CAST(o_custkey % 10 AS STRING) AS tinhhientai,
               CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE 'N' || CAST(o_orderkey % 4 AS STRING) END AS tuoibacklog,
               CASE WHEN o_custkey % 2 = 0 THEN 'Express' ELSE 'Bulky' END AS ordertype
        FROM orders WHERE o_orderstatus = 'P'
    """,
    "sorter_log": """
        SELECT 'O' || CAST(CAST(floor(event_id / 8) AS BIGINT) AS STRING) AS order_code,
               CASE WHEN event_id % 3 = 0 THEN '1626' WHEN event_id % 7 = 0 THEN '999' ELSE '21365000' END AS location_id,
               CASE event_type WHEN 'click' THEN 'WEIGHING_PARCEL' WHEN 'view' THEN 'DWS_PARCEL'
                    WHEN 'purchase' THEN 'MATRIX_SCANNED_PARCEL' ELSE 'SORTING_PARCEL' END AS action,
               ts - INTERVAL '1' DAY * CAST(CASE WHEN event_id % 8 < 3 THEN event_id % 130 ELSE 0 END AS INT) AS last_updated_time,
               CASE event_type
                    WHEN 'signup' THEN '{"feederWeight":"' || CAST(value * 40 AS STRING) || '","weight":70000,"dwsWeight":80000,"dwsLength":10,"dwsWidth":10,"dwsHeight":10}'
                    WHEN 'click' THEN '{"weight":' || CAST(value * 40 AS STRING) || ',"feederWeight":90000,"dwsWeight":95000}'
                    WHEN 'error' THEN '{bad'
                    ELSE '{"dwsWeight":' || CAST(value * 40 AS STRING) || ',"dwsLength":' || CAST(length(props) * 30 AS STRING)
                         || ',"dwsWidth":"' || CAST(event_id % 5 * 50 AS STRING) || '","dwsHeight":120,"weight":60000,"feederWeight":85000}' END AS data,
               CAST(CAST(ts - INTERVAL '1' DAY * CAST(CASE WHEN event_id % 8 < 3 THEN event_id % 130 ELSE 0 END AS INT) AS DATE) AS STRING) AS date_partition
        FROM events
    """,
    # Every fourth order ends on one day; every thirty-second row comes twice.
    "completed_mart": """
        SELECT 'O' || CAST(o_orderkey AS STRING) AS ordercode,
               CASE WHEN o_custkey % 3 = 0 THEN 3819710 WHEN o_custkey % 3 = 1 THEN 4447237 ELSE 18692 END AS clientid,
               CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'O' THEN 'returned' ELSE 'storing' END AS currentstatus,
               CASE WHEN o_orderstatus = 'F' THEN done ELSE NULL END AS enddeliverytime,
               CASE WHEN o_orderstatus = 'O' THEN done ELSE NULL END AS endreturntime,
               CAST(done - INTERVAL '1' DAY * CAST(o_orderkey % 45 AS INT) AS DATE) AS createddate_partition
        FROM (SELECT o_orderkey, o_custkey, o_orderstatus,
                     CASE WHEN o_orderkey % 4 = 0 THEN TIMESTAMP_NTZ '2024-01-30 00:00:00' + INTERVAL '1' HOUR * CAST(o_orderkey % 24 AS INT)
                          ELSE TIMESTAMP_NTZ '2023-09-20 00:00:00' + INTERVAL '1' HOUR * CAST(o_orderkey % 3400 AS INT) END AS done
              FROM (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 32 = 5) AS twice) AS timed
    """,
    "claim": """
        SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_extendedprice AS amount, CAST(l_shipdate AS DATE) AS ngay_duyet_eform
        FROM lineitem WHERE l_returnflag = 'R'
    """,
    # One order row with up to two proof-of-delivery entries; pod_flat is the same unnested.
    "pod_row": """
        SELECT 'O' || CAST(l_orderkey AS STRING) AS order_code,
               CAST(o_orderdate + INTERVAL '1' DAY * CAST(l_partkey % 40 - 20 AS INT) AS DATE) AS createddate_partition,
               CAST(l_partkey % 3 AS INT) AS pod_count,
               CASE WHEN l_returnflag = 'R' THEN 'returned' ELSE 'delivery_fail' END AS order_status,
               CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE 'r' || CAST(l_partkey % 5 AS STRING) END AS reason,
               l_shipdate AS time, l_discount * 100 AS lat, l_tax * 100 AS lng, l_linestatus = 'O' AS is_correct,
               'u' || CAST(l_partkey AS STRING) AS first_url, 'v' || CAST(l_suppkey AS STRING) AS second_url
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
    "pod_flat": """
        SELECT order_code, createddate_partition, order_status, reason, time, lat, lng, is_correct,
               first_url || ' | ' || second_url AS url_list
        FROM pod_row WHERE pod_count >= 1
        UNION ALL
        SELECT order_code, createddate_partition, order_status, 'again' AS reason, time, lat, lng, is_correct, second_url AS url_list
        FROM pod_row WHERE pod_count >= 2
    """,
}

_REFERENCE = re.compile(r"\b(?:FROM|JOIN)\s+(\w+)", re.IGNORECASE)


def _needed(sql: str, found: list[str], known: tuple[str, ...]) -> list[str]:
    """Views and base tables that a text reads, each after those it depends on."""
    for name in _REFERENCE.findall(sql):
        if name in VIEWS and name not in found:
            _needed(VIEWS[name], found, known)
            found.append(name)
        elif name in known and name not in found:
            found.append(name)
    return found


def with_views(sql: str) -> str:
    """A DuckDB statement over the views; the base tables are registered there. Only the name of the wall-clock type differs."""
    ctes = [f"{name} AS ({VIEWS[name].strip().replace('TIMESTAMP_NTZ', 'TIMESTAMP')})" for name in _needed(sql, [], ())]
    return f"WITH {', '.join(ctes)} SELECT * FROM ({sql.strip()}) AS result" if ctes else sql.strip()


class Samples:
    """Report sources over one directory of sample tables; every table is opened once."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._opened: dict[str, DataFrame] = {}

    def __call__(self, name: str) -> DataFrame:
        """A base table, or a report source checked against its schema."""
        if name not in self._opened:
            self._opened[name] = self._open(name)
        return self._opened[name]

    def _open(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name == "order_pods":
            return conform(self._order_pods(), name)
        schema = {"hub_scan_dirty": "hub_scan"}.get(name, name)
        return conform(self.view(name), schema)

    def view(self, name: str) -> DataFrame:
        needed = _needed(f"FROM {name}", [], BASE_TABLES)
        tables = {n: self(n) for n in needed if n in BASE_TABLES}
        # Braces of JSON texts are doubled, those around a base table name take the DataFrame.
        text = {n: VIEWS[n].strip().replace("{", "{{").replace("}", "}}") for n in needed if n in VIEWS}
        ctes = [f"{n} AS ({text.get(n, f'SELECT * FROM {{{n}}}')})" for n in needed]
        return self.spark.sql(f"WITH {', '.join(ctes)} SELECT * FROM {name}", **tables)

    def _order_pods(self) -> DataFrame:
        rows = self.view("pod_row")
        shared = ["time", "lat", "lng", "is_correct"]
        first = F.struct("order_status", "reason", *shared, F.array("first_url", "second_url").alias("urls"))
        second = F.struct("order_status", F.lit("again").alias("reason"), *shared, F.array("second_url").alias("urls"))
        count = F.col("pod_count")
        pods = F.when(count == 2, F.array(first, second)).when(count == 1, F.array(first)).otherwise(F.slice(F.array(first), 1, 0))
        return rows.select("order_code", "createddate_partition", pods.alias("pods"))
