"""Declared schemas of the schedule tables. Nothing is ever inferred.

Each column is ``name:type``; the type is one of string, int, double, date.
Columns listed in ``PREFIXED`` are ids and get the feed id in front.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "double": T.DoubleType(),
    "date": T.DateType(),
}

# The columns of each table in file order.
COLUMNS: dict[str, tuple[str, ...]] = {
    "agency": (
        "agency_id", "agency_name", "agency_url", "agency_timezone", "agency_lang", "agency_phone",
        "agency_fare_url", "agency_email",
    ),
    "attributions": (
        "attribution_id", "agency_id", "route_id", "trip_id", "organization_name", "is_producer",
        "is_operator", "is_authority", "attribution_url", "attribution_email", "attribution_phone",
    ),
    "calendar": (
        "service_id", "monday:int", "tuesday:int", "wednesday:int", "thursday:int", "friday:int",
        "saturday:int", "sunday:int", "start_date:date", "end_date:date",
    ),
    "calendar_dates": (
        "service_id", "date:date", "exception_type:int",
    ),
    "fare_attributes": (
        "fare_id", "price:double", "currency_type", "payment_method:int", "transfers:int", "agency_id",
        "transfer_duration:int",
    ),
    "fare_rules": (
        "fare_id", "route_id", "origin_id", "destination_id", "contains_id",
    ),
    "feed_info": (
        "feed_publisher_name", "feed_publisher_url", "feed_lang", "feed_start_date:date",
        "feed_end_date:date", "feed_version", "feed_contact_email", "feed_contact_url",
    ),
    "frequencies": (
        "trip_id", "start_time", "end_time", "headway_secs:int", "exact_times:int",
    ),
    "routes": (
        "route_id", "agency_id", "route_short_name", "route_long_name", "route_desc", "route_type:int",
        "route_url", "route_color", "route_text_color", "route_sort_order:int", "continuous_pickup:int",
        "continuous_drop_off:int", "network_id",
    ),
    "shapes": (
        "shape_id", "shape_pt_lat:double", "shape_pt_lon:double", "shape_pt_sequence:int",
        "shape_dist_traveled:double",
    ),
    "stop_times": (
        "trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence:int", "stop_headsign",
        "pickup_type:int", "drop_off_type:int", "continuous_pickup:int", "continuous_drop_off:int",
        "shape_dist_traveled:double", "timepoint:int",
    ),
    "stops": (
        "stop_id", "stop_code", "stop_name", "stop_desc", "stop_lat:double", "stop_lon:double", "zone_id",
        "stop_url", "location_type:int", "parent_station", "stop_timezone", "wheelchair_boarding:int",
        "level_id", "platform_code",
    ),
    "transfers": (
        "from_stop_id", "to_stop_id", "transfer_type:int", "min_transfer_time:int",
    ),
    "translations": (
        "table_name", "field_name", "language", "translation", "record_id", "record_sub_id", "field_value",
    ),
    "trips": (
        "route_id", "service_id", "trip_id", "trip_headsign", "trip_short_name", "direction_id:int",
        "block_id", "shape_id", "wheelchair_accessible:int", "bikes_allowed:int",
    ),
    # Fare products: used by the fare analyses, loaded like the rest when present.
    "fare_products": (
        "fare_product_id", "fare_product_name", "fare_media_id", "amount:double", "currency",
    ),
    "fare_leg_rules": (
        "network_id", "fare_product_id",
    ),
    "fare_media": (
        "fare_media_id", "fare_media_name", "fare_media_type:int",
    ),
}

# The fifteen tables every feed is checked for.
CORE_TABLES = tuple(t for t in COLUMNS if t not in ("fare_products", "fare_leg_rules", "fare_media"))

# Foreign and own keys that share one namespace per feed.
PREFIXED: dict[str, tuple[str, ...]] = {
    "agency": ("agency_id",),
    "attributions": ("attribution_id", "agency_id", "route_id", "trip_id"),
    "calendar": ("service_id",),
    "calendar_dates": ("service_id",),
    "fare_attributes": ("fare_id", "agency_id"),
    "fare_rules": ("fare_id", "route_id", "origin_id", "destination_id", "contains_id"),
    "feed_info": (),
    "frequencies": ("trip_id",),
    "routes": ("route_id", "agency_id", "network_id"),
    "shapes": ("shape_id",),
    "stop_times": ("trip_id", "stop_id"),
    "stops": ("stop_id", "zone_id", "parent_station", "level_id"),
    "transfers": ("from_stop_id", "to_stop_id"),
    "translations": ("record_id", "record_sub_id"),
    "trips": ("route_id", "service_id", "trip_id", "block_id", "shape_id"),
    "fare_products": ("fare_product_id", "fare_media_id"),
    "fare_leg_rules": ("network_id", "fare_product_id"),
    "fare_media": ("fare_media_id",),
}

# Tables whose absent feeds appear as one placeholder row by default.
PLACEHOLDER_TABLES = frozenset(CORE_TABLES) - {
    "agency", "routes", "shapes", "frequencies", "attributions",
}

# Service times kept as text and also parsed to seconds.
TIME_COLUMNS = {
    "stop_times": {"arrival_time": "arrival_secs", "departure_time": "departure_secs"},
    "frequencies": {"start_time": "start_secs", "end_time": "end_secs"},
}

PROVENANCE = (("gtfs_id", T.StringType()), ("_path", T.StringType()), ("_missing", T.BooleanType()))


def fields(table: str) -> list[tuple[str, str]]:
    """``(column, type name)`` pairs of a table, without provenance."""
    pairs = []
    for item in COLUMNS[table]:
        name, _, kind = item.partition(":")
        pairs.append((name, kind or "string"))
    return pairs


def names(table: str) -> list[str]:
    return [name for name, _ in fields(table)]


def raw_schema(table: str) -> T.StructType:
    """All-string schema of the CSV file."""
    return T.StructType([T.StructField(n, T.StringType()) for n in names(table)])


def typed_schema(table: str) -> T.StructType:
    """Schema after typing: provenance, columns, parsed service times."""
    out = [T.StructField(n, t) for n, t in PROVENANCE]
    out += [T.StructField(n, _TYPES[k]) for n, k in fields(table)]
    out += [T.StructField(n, T.IntegerType()) for n in TIME_COLUMNS.get(table, {}).values()]
    return T.StructType(out)
