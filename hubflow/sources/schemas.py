"""Columns each report reads from each source, and the check made at load."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import (
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegralType,
    NumericType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
    TimestampType,
)

_DDL = {
    # hub and ward dimensions
    "dim_warehouse": "warehouse_id bigint, warehouse_name string, warehouse_type string, province_id int, region_shortname string",
    "hub_name": "warehouse_id bigint, warehouse_name string",
    "dim_ward": "ward_id bigint, province_name string, district_name string, ward_name string",
    # logs
    "hub_scan": "order_code string, warehouse_id string, action_time timestamp_ntz, package_code string, "
    "trip_code string, action_category string, action_name string, dt string",
    "truck_event": "transportation_code string, location_id string, created_time timestamp_ntz, action_type string, dt string",
    "trip_route": "partner_router string, updated_at_date timestamp_ntz",
    "stop_map": "code string, hub_code string",
    "trip_item": "order_code string, type string, fail_note string, dt string",
    "sorter_log": "order_code string, location_id string, action string, last_updated_time timestamp_ntz, data string, date_partition string",
    # orders, partitioned by day of creation, and the same orders by day of the end of delivery
    "shipping_order": "order_code string, client_id bigint, status string, created_date timestamp_ntz, end_pick_time timestamp_ntz, "
    "pick_warehouse_id bigint, deliver_warehouse_id bigint, current_warehouse_id bigint, weight double, converted_weight double, "
    "to_ward_code string, to_ward_id_v2 bigint, dt string",
    "delivered_order": "order_code string, client_id bigint, deliver_warehouse_id bigint, weight double, converted_weight double, dt string",
    "order_pods": "order_code string, createddate_partition date, pods array<struct<order_status:string,reason:string,"
    "time:timestamp_ntz,lat:double,lng:double,is_correct:boolean,urls:array<string>>>",
    # marts
    "sla_mart": "ordercode string, clientid string, deadlinedeliverysla timestamp_ntz, deliveryprovince string, "
    "externallane string, pickprovince string, pickdistrict string, loaddate date",
    "order_mart": "ordercode string, clientid bigint, clienttype string, currentstatus string, isexpecteddropoff boolean, "
    "canceltime timestamp_ntz, firstupdatedpickeduptime timestamp_ntz, orderdate timestamp_ntz, createddate timestamp_ntz, "
    "createddate_partition date, endpicktime timestamp_ntz, startreturntime timestamp_ntz, pickwh string, "
    "deliverywarehouseid bigint, deliverywh string, toprovince string, numdeliver int, firstfaildeliverynote string, "
    "secondfaildeliverynote string, thirdfaildeliverynote string, lastfaildeliverynote string, allfailnote string",
    "completed_mart": "ordercode string, clientid bigint, currentstatus string, enddeliverytime timestamp_ntz, "
    "endreturntime timestamp_ntz, createddate_partition date",
    "express_order": "ordercode string, createddate date, enddeliveredtime timestamp_ntz, toprovince string, "
    "ontimeenddelivery int, delivered int, currentstatus string",
    "backlog_mart": "madh string, tinhhientai string, tuoibacklog string, ordertype string",
    "claim": "ngay_duyet_eform date",
}
# Sources whose further columns pass through to the result.
_OPEN = frozenset({"claim"})
# Columns that no report needs from a source; they are kept where a table has them.
_OPTIONAL = {"dim_warehouse": {"region_shortname"}, "shipping_order": {"weight", "converted_weight"}}
# Days of partitions, as text of the form yyyy-MM-dd or as dates. Either stays as it is, so that ranges prune.
_DAYS = frozenset({"dt", "date_partition"})

SOURCES = tuple(_DDL)


@lru_cache(maxsize=None)
def schema_of(source: str) -> StructType:
    """Declared schema of a source (needs a running session to read the type text)."""
    return StructType.fromDDL(_DDL[source])


def _converted(name: str, found: DataType, field: StructField, zone: str | None) -> str | None:
    """SQL for a column as its declared type; None where the type does not allow it."""
    wanted, column = field.dataType, f"`{name}`"
    if found.simpleString() == wanted.simpleString() or (field.name in _DAYS and isinstance(found, DateType)):
        return column
    if isinstance(wanted, TimestampNTZType) and isinstance(found, TimestampType):
        # An instant becomes the wall-clock time of the given zone, whatever the session's zone.
        return f"convert_timezone(current_timezone(), '{zone}', CAST({column} AS timestamp_ntz))" if zone else None
    allowed = (
        (isinstance(wanted, IntegralType) and isinstance(found, IntegralType))
        or (isinstance(wanted, (FloatType, DoubleType, DecimalType)) and isinstance(found, NumericType))
        or (isinstance(wanted, StringType) and isinstance(found, IntegralType))
        or (isinstance(wanted, (TimestampNTZType, DateType)) and isinstance(found, StringType))
    )
    return f"CAST({column} AS {wanted.simpleString()})" if allowed else None


def conform(df: DataFrame, source: str, *, zone: str | None = None) -> DataFrame:
    """Check a table against its source schema and keep the declared columns.

    Names match without regard to case. Integers of any width take the declared
    width, integers become text where a code is text, and text becomes a date or
    time (malformed text raises while ANSI mode is on, as the session settings
    have it). A timestamp with a time zone needs ``zone``, whose wall-clock
    time it becomes. A missing column or another type raises ``ValueError``.
    """
    present = {f.name.lower(): f for f in df.schema.fields}
    kept, problems = [], []
    for field in schema_of(source).fields:
        found = present.get(field.name)
        if found is None:
            if field.name not in _OPTIONAL.get(source, ()):
                problems.append(f"{field.name} is missing")
            continue
        value = _converted(found.name, found.dataType, field, zone)
        if value is None:
            problems.append(f"{field.name} is {found.dataType.simpleString()}, not {field.dataType.simpleString()}")
        else:
            kept.append(f"{value} AS `{field.name}`")
    if problems:
        raise ValueError(f"source {source}: " + "; ".join(problems))
    if source in _OPEN:
        return df
    return df.selectExpr(*kept)


def read_table(spark: SparkSession, source: str, table: str, *, zone: str | None = None) -> DataFrame:
    """A catalog table (any part count, any case) as the named source."""
    return conform(spark.table(table), source, zone=zone)


def read_parquet(spark: SparkSession, source: str, path: str, *, zone: str | None = None) -> DataFrame:
    return conform(spark.read.parquet(path), source, zone=zone)
