"""Feed checks and lookups: nulls, duplicates, orphans, availability, agencies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayrunner.feed import Feed
from dayrunner.plans.views import FEED, ROUTE, SERVICE, STOP, TRIP
from dayrunner.schemas import CORE_TABLES

# Own key of each table, and references into other tables: (table, column, target, target column).
OWN_KEYS = {
    "routes": ROUTE, "trips": TRIP, "stops": STOP, "calendar": SERVICE,
    "stop_times": [*TRIP, "stop_sequence"], "calendar_dates": [*SERVICE, "date"],
}
REFERENCES = (
    ("stop_times", "stop_id", "stops", "stop_id"),
    ("stop_times", "trip_id", "trips", "trip_id"),
    ("trips", "route_id", "routes", "route_id"),
    ("trips", "service_id", "calendar", "service_id"),
    ("trips", "shape_id", "shapes", "shape_id"),
    ("routes", "agency_id", "agency", "agency_id"),
    ("fare_rules", "fare_id", "fare_attributes", "fare_id"),
)


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def not_null_report(feed: Feed, columns: Sequence[str] = (FEED, "_missing"), tables: Sequence[str] = CORE_TABLES) -> DataFrame:
    """Failing rows of each not-null rule; one pass per table covers all its rules."""
    reports = []
    for table in tables:
        if table not in feed:
            continue
        sums = feed.complete(table).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
        reports.append(
            sums.unpivot([], list(columns), "column", "failures").withColumn("table", F.lit(table))
        )
    return _union(reports).select("table", "column", "failures")


def requirement_report(feed: Feed, required: dict[str, Sequence[str]]) -> DataFrame:
    """Per required table and column: present, rows, NULLs."""
    spark = next(iter(feed.values())).sparkSession
    reports = []
    for table, columns in required.items():
        have = feed[table].columns if table in feed else []
        absent = [c for c in columns if c not in have]
        present = [c for c in columns if c in have]
        if present:
            sums = feed[table].agg(
                F.count("*").alias("_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in present]
            )
            reports.append(
                sums.unpivot(["_rows"], present, "column", "nulls").select(
                    F.lit(table).alias("table"), "column", F.lit(True).alias("present"),
                    F.col("_rows").alias("rows"), "nulls",
                )
            )
        if absent:
            reports.append(
                spark.createDataFrame(
                    [(table, c, False, 0, 0) for c in absent],
                    "table string, column string, present boolean, rows bigint, nulls bigint",
                )
            )
    return _union(reports)


def duplicates(feed: Feed, tables: Sequence[str] = tuple(OWN_KEYS)) -> DataFrame:
    """Keys that occur more than once, counted per table and feed."""
    reports = []
    for table in tables:
        repeated = feed[table].groupBy(*OWN_KEYS[table]).agg(F.count("*").alias("n")).filter("n > 1")
        reports.append(
            repeated.groupBy(FEED).agg(F.count("*").alias("keys"), F.sum("n").alias("rows"))
            .select(F.lit(table).alias("table"), FEED, "keys", "rows")
        )
    return _union(reports)


def orphans(feed: Feed, references=REFERENCES) -> DataFrame:
    """References to ids that do not exist, counted per reference and feed.

    References are reduced to distinct ids with their row count first.
    """
    reports = []
    for table, column, target, target_column in references:
        used = feed[table].filter(F.col(column).isNotNull()).groupBy(FEED, F.col(column).alias("_id")).agg(
            F.count("*").alias("n")
        )
        known = feed[target].select(FEED, F.col(target_column).alias("_id")).distinct()
        lost = used.join(known, [FEED, "_id"], "left_anti")
        reports.append(
            lost.groupBy(FEED).agg(F.count("*").alias("ids"), F.sum("n").alias("rows")).select(
                F.lit(f"{table}.{column}").alias("reference"), FEED, "ids", "rows"
            )
        )
    return _union(reports)


def missing_values(feed: Feed, table: str, columns: Sequence[str]) -> DataFrame:
    """NULLs or blanks per column and feed."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    return feed[table].groupBy(FEED).agg(
        F.count("*").alias("rows"), *[F.count_if(blank(c)).alias(c) for c in columns]
    )


def availability(files: DataFrame, tables: Sequence[str] = CORE_TABLES) -> DataFrame:
    """Which feed has which table; ``files``: (gtfs_id, table, found)."""
    return files.groupBy(FEED).pivot("table", list(tables)).agg(F.max("found")).na.fill(False)


def agency_lookup(feed: Feed) -> DataFrame:
    """Agency name, site, zone and fare page with the feed's validity span."""
    spans = feed.feed_info.groupBy(FEED).agg(
        F.min("feed_start_date").alias("feed_start_date"), F.max("feed_end_date").alias("feed_end_date")
    )
    return feed.agency.select(
        FEED, "agency_id", "agency_name", "agency_url", "agency_timezone", "agency_fare_url"
    ).join(spans, FEED, "left")


def local_now(feed: Feed, instant: Column | None = None) -> DataFrame:
    """Wall-clock time, service second and weekday in each agency's zone, now or at an instant."""
    instant = F.current_timestamp() if instant is None else instant
    now = F.from_utc_timestamp(F.to_utc_timestamp(instant, F.current_timezone()), F.col("agency_timezone"))
    return feed.agency.select(FEED, "agency_id", "agency_timezone", now.alias("now")).select(
        "*",
        (F.hour("now") * 3600 + F.minute("now") * 60 + F.second("now")).alias("now_secs"),
        F.date_format("now", "EEEE").alias("weekday"),
    )
