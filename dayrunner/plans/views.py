"""Canonical views: service days, normalized stop times, departures, patterns.

Keys are always ``(gtfs_id, id)``. Dates are expanded last: services are
attached to trips as date lists, trips to stop events by one shuffle on the
trip, and only then does ``explode`` multiply rows, inside the same stage.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayrunner.feed import Feed
from dayrunner.functions import columns as C

FEED = "gtfs_id"
TRIP = [FEED, "trip_id"]
STOP = [FEED, "stop_id"]
ROUTE = [FEED, "route_id"]
SERVICE = [FEED, "service_id"]


def service_days(feed: Feed) -> DataFrame:
    """One row per service and date it runs, exceptions applied."""
    span = F.when(
        F.col("start_date") <= F.col("end_date"),
        F.sequence("start_date", "end_date", F.expr("interval 1 day")),
    )
    regular = (
        feed.calendar.withColumn("service_date", F.explode(span))
        .filter(C.weekday_flag("service_date") == 1)
        .select(*SERVICE, "service_date")
    )
    exceptions = feed.calendar_dates.withColumnRenamed("date", "service_date")
    day = [*SERVICE, "service_date"]
    removed = exceptions.filter("exception_type = 2").select(*day)
    added = exceptions.filter("exception_type = 1").select(*day)
    return regular.join(removed, day, "left_anti").unionByName(added).distinct()


def service_date_lists(feed: Feed) -> DataFrame:
    """Sorted date list per service; its length is bounded by the calendar span."""
    return (
        service_days(feed)
        .groupBy(*SERVICE)
        .agg(F.sort_array(F.collect_list("service_date")).alias("service_dates"))
    )


def _dated_trips(feed: Feed, extra: Sequence[str] = ()) -> DataFrame:
    return (
        feed.trips.select(*TRIP, "service_id", *extra)
        .join(service_date_lists(feed), SERVICE)
    )


def stop_times_norm(feed: Feed, extra: Sequence[str] = (), trips: DataFrame | None = None) -> DataFrame:
    """One row per stop event and service date, with wall-clock timestamps."""
    dated = _dated_trips(feed, extra) if trips is None else trips
    return (
        feed.stop_times.select(*TRIP, "stop_id", "stop_sequence", "arrival_secs", "departure_secs")
        .join(dated, TRIP)
        .withColumn("service_date", F.explode("service_dates"))
        .select(
            *TRIP, "stop_id", "stop_sequence", "arrival_secs", "departure_secs",
            C.service_timestamp("service_date", "arrival_secs").alias("arrival_ts"),
            C.service_timestamp("service_date", "departure_secs").alias("departure_ts"),
            "service_date",
            C.day_offset("departure_secs").alias("departure_day_offset"),
            *extra,
        )
    )


def departures(feed: Feed) -> DataFrame:
    """Departure facts: stop event, service date, trip and route attributes."""
    trip_cols = ["route_id", "direction_id", "shape_id"]
    route_cols = ["agency_id", "route_short_name", "route_long_name", "route_type"]
    trips = _dated_trips(feed, trip_cols).join(feed.routes.select(*ROUTE, *route_cols), ROUTE)
    events = stop_times_norm(feed, [*trip_cols, *route_cols], trips)
    return events.select(
        *STOP, "departure_ts", "departure_secs", "service_date", "trip_id", *trip_cols, *route_cols
    )


def trip_starts(stop_times: DataFrame) -> DataFrame:
    """First stop and its departure second, per trip."""
    return stop_times.groupBy(*TRIP).agg(
        F.min_by("stop_id", "stop_sequence").alias("start_stop_id"),
        F.min_by("departure_secs", "stop_sequence").alias("start_secs"),
    )


def trip_start_times(feed: Feed) -> DataFrame:
    """First departure per trip and service date; dates expand after the aggregate."""
    return (
        trip_starts(feed.stop_times)
        .join(_dated_trips(feed), TRIP)
        .withColumn("service_date", F.explode("service_dates"))
        .select(
            *TRIP, "service_date", "start_stop_id",
            C.service_timestamp("service_date", "start_secs").alias("start_departure_ts"),
        )
    )


def route_patterns(feed: Feed) -> DataFrame:
    """Trips per route, direction and shape; NULL keys stay."""
    return feed.trips.groupBy(*ROUTE, "direction_id", "shape_id").agg(
        F.count("*").alias("trip_count")
    )


def stop_areas(feed: Feed) -> DataFrame:
    """Parent station where there is one, else the stop itself."""
    return feed.stops.select(
        *STOP,
        F.coalesce("parent_station", "stop_id").alias("stop_area_id"),
        "stop_name", "stop_lat", "stop_lon", "location_type", "parent_station",
    )


def active_services(feed: Feed, date: str, *, exceptions: bool = True) -> DataFrame:
    """Services that run on a date, with or without calendar exceptions."""
    if exceptions:
        days = service_days(feed).filter(F.col("service_date") == F.lit(date).cast("date"))
        return days.select(*SERVICE)
    flag = C.weekday_flag(F.lit(date).cast("date"))
    return feed.calendar.filter(C.valid_on(date) & (flag == 1)).select(*SERVICE)


def trips_of_services(feed: Feed, services: DataFrame) -> DataFrame:
    return feed.trips.join(services.select(*SERVICE), SERVICE, "left_semi")


def typical_trips(feed: Feed, days: Sequence[str] | str, mode: str = "any") -> DataFrame:
    """Trips of services flagged for the days, exceptions ignored."""
    return trips_of_services(feed, feed.calendar.filter(C.runs_on(days, mode)))


def typical_feed(feed: Feed, days: Sequence[str] | str, mode: str = "any") -> Feed:
    """The feed with its trips reduced to a typical day's."""
    return feed.replace(trips=typical_trips(feed, days, mode))


def register_views(spark: SparkSession, feed: Feed, prefix: str = "gtfs_") -> list[str]:
    """Register the six canonical views next to the feed tables."""
    views = {
        "service_days": service_days, "stop_times_norm": stop_times_norm,
        "departures": departures, "trip_start_times": trip_start_times,
        "route_patterns": route_patterns, "stop_areas": stop_areas,
    }
    for name, build in views.items():
        build(feed).createOrReplaceTempView(prefix + name)
    return feed.register(spark, prefix) + [prefix + name for name in views]


def feed_slice(
    df: DataFrame,
    columns: Sequence[str],
    *,
    where: Column | str | None = None,
    order: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Columns, filter, order and limit of one table or view, for output."""
    out = df if where is None else df.filter(where)
    out = out.select(*columns)
    if order:
        out = out.orderBy(*order)
    return out if limit is None else out.limit(limit)
