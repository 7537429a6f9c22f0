"""Trip counts, service days, durations, distances and speeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayrunner.feed import Feed
from dayrunner.functions import columns as C
from dayrunner.functions.ordered import exact_median
from dayrunner.plans import views as V
from dayrunner.plans.views import FEED, ROUTE, SERVICE, TRIP



# --- counts by service, date and weekday -----------------------------------


def trip_counts(feed: Feed, keys: Sequence[str], name: str = "trips") -> DataFrame:
    """Trips per any trip attributes, e.g. route, service, block."""
    return feed.trips.groupBy(FEED, *keys).agg(F.count("*").alias(name))


def trips_per_date(feed: Feed, keys: Sequence[str] = ()) -> DataFrame:
    """Trips per service date; counted per service before dates expand."""
    per_service = trip_counts(feed, ["service_id", *keys])
    return (
        per_service.join(V.service_days(feed), SERVICE)
        .groupBy(FEED, *keys, "service_date")
        .agg(F.sum("trips").alias("trips"))
    )


def trips_per_weekday(feed: Feed, keys: Sequence[str] = ()) -> DataFrame:
    """Trips per day of week by calendar flags, long form."""
    per_service = trip_counts(feed, ["service_id", *keys]).join(feed.calendar.select(*SERVICE, *C.DAYS), SERVICE)
    sums = per_service.groupBy(FEED, *keys).agg(
        *[F.sum(F.col(d) * F.col("trips")).alias(d) for d in C.DAYS]
    )
    return sums.unpivot([FEED, *keys], list(C.DAYS), "day", "trips")


def weekday_variation(feed: Feed) -> DataFrame:
    """Spread of a route's trips over the seven days, days without trips as 0."""
    return trips_per_weekday(feed, ["route_id"]).groupBy(*ROUTE).agg(
        F.stddev_samp("trips").alias("stddev"), F.min("trips").alias("least"), F.max("trips").alias("most")
    )


def service_day_totals(feed: Feed, *, shared_removals: bool = False) -> DataFrame:
    """Distinct service dates per feed and their range.

    With ``shared_removals`` a date removed from any service counts as removed
    for the whole feed.
    """
    days = V.service_days(feed)
    if shared_removals:
        removed = feed.calendar_dates.filter("exception_type = 2").select(
            FEED, F.col("date").alias("service_date")
        )
        days = days.join(removed, [FEED, "service_date"], "left_anti")
    return days.groupBy(FEED).agg(
        F.count_distinct("service_date").alias("days"),
        F.min("service_date").alias("first_date"),
        F.max("service_date").alias("last_date"),
    )


def feed_validity(feed: Feed) -> DataFrame:
    """Validity span per feed: from feed info, else from the calendar."""
    info = feed.feed_info.groupBy(FEED).agg(
        F.min("feed_start_date").alias("info_start"), F.max("feed_end_date").alias("info_end")
    )
    spans = feed.calendar.groupBy(FEED).agg(
        F.min("start_date").alias("calendar_start"), F.max("end_date").alias("calendar_end")
    )
    return info.join(spans, FEED, "full").select(
        FEED,
        F.coalesce("info_start", "calendar_start").alias("valid_from"),
        F.coalesce("info_end", "calendar_end").alias("valid_to"),
    )


def busiest_week(feed: Feed) -> DataFrame:
    """Trips, services and routes per ISO week."""
    week = F.date_trunc("week", "service_date").cast("date").alias("week")
    per_service = trips_per_date(feed, ["service_id"]).groupBy(FEED, week).agg(
        F.sum("trips").alias("trips"), F.count_distinct("service_id").alias("services")
    )
    routes = (
        feed.trips.select(*SERVICE, "route_id").distinct()
        .join(V.service_days(feed).select(*SERVICE, week).distinct(), SERVICE)
        .groupBy(FEED, "week").agg(F.count_distinct("route_id").alias("routes"))
    )
    return per_service.join(routes, [FEED, "week"])


def service_classes(feed: Feed) -> DataFrame:
    """Services by weekday/weekend class with days covered and routes served."""
    kind = (
        F.when(C.runs_on(C.WEEKEND, "only"), F.lit("weekend"))
        .when(C.runs_on(C.WEEKDAYS, "only"), F.lit("weekday"))
        .when(C.runs_on(C.DAYS, "any"), F.lit("mixed"))
        .otherwise(F.lit("none"))
    )
    routes = feed.trips.select(*SERVICE, "route_id").distinct().groupBy(*SERVICE).agg(F.count("*").alias("routes"))
    days = V.service_days(feed).groupBy(*SERVICE).agg(F.count("*").alias("days"))
    return (
        feed.calendar.select(*SERVICE, kind.alias("class"))
        .join(days, SERVICE, "left").join(routes, SERVICE, "left")
        .select(
            *SERVICE, "class",
            F.coalesce("days", F.lit(0)).alias("days"), F.coalesce("routes", F.lit(0)).alias("routes"),
        )
    )


def trip_rates(feed: Feed) -> DataFrame:
    """Mean trips per service date, per service and per route, by feed."""
    per_day = trips_per_date(feed).groupBy(FEED).agg(F.avg("trips").alias("per_day"))
    per_service = trip_counts(feed, ["service_id"]).groupBy(FEED).agg(F.avg("trips").alias("per_service"))
    per_route = trip_counts(feed, ["route_id"]).groupBy(FEED).agg(F.avg("trips").alias("per_route"))
    return per_service.join(per_route, FEED).join(per_day, FEED, "left")


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Count, total, mean, median, least and greatest value per group."""
    stats = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"),
        F.min(value).alias("least"), F.max(value).alias("most"), F.stddev_samp(value).alias("stddev"),
    )
    return stats.join(exact_median(df, keys, value), list(keys), "left")


def histogram(
    df: DataFrame, keys: Sequence[str], value: str, bins: int, weight: str | None = None
) -> DataFrame:
    """Equal-width histogram between a group's least and greatest value."""
    amount = F.count("*") if weight is None else F.sum(weight)
    bounds = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    step = F.try_divide((F.col(value) - F.col("_lo")) * F.lit(float(bins)), F.col("_hi") - F.col("_lo"))
    number = F.least(F.floor(F.coalesce(step, F.lit(0.0))), F.lit(bins - 1).cast("bigint"))
    return df.join(bounds, list(keys)).groupBy(*keys, number.alias("bin")).agg(amount.alias("n"))


# --- per-trip measures -----------------------------------------------------


def trip_spans(stop_times: DataFrame) -> DataFrame:
    """One row per trip: times, ends, stop count and distance.

    One partially aggregated shuffle on the trip; unused columns are pruned.
    """
    known = F.col("shape_dist_traveled").isNotNull()
    seq_known = F.when(known, F.col("stop_sequence"))
    return stop_times.groupBy(*TRIP).agg(
        F.min("arrival_secs").alias("first_arrival"),
        F.max("arrival_secs").alias("last_arrival"),
        F.min("departure_secs").alias("first_departure"),
        F.max("departure_secs").alias("last_departure"),
        F.min_by("departure_secs", "stop_sequence").alias("start_secs"),
        F.max_by("arrival_secs", "stop_sequence").alias("end_secs"),
        F.count("*").alias("n_stops"),
        F.max("stop_sequence").alias("last_sequence"),
        (F.max("shape_dist_traveled") - F.min("shape_dist_traveled")).alias("distance"),
        # Ends of the part of the trip whose distance is known.
        F.min_by("arrival_secs", seq_known).alias("known_start"),
        F.max_by("arrival_secs", seq_known).alias("known_end"),
        F.min_by("shape_dist_traveled", seq_known).alias("known_from"),
        F.max_by("shape_dist_traveled", seq_known).alias("known_to"),
    )


def trip_ends(stop_times: DataFrame) -> DataFrame:
    """First and last stop per trip."""
    return stop_times.groupBy(*TRIP).agg(
        F.min_by("stop_id", "stop_sequence").alias("first_stop"),
        F.max_by("stop_id", "stop_sequence").alias("last_stop"),
    )


DURATIONS = {
    "arrivals": ("last_arrival", "first_arrival"),
    "departures": ("last_departure", "first_departure"),
    "ends": ("end_secs", "start_secs"),
}


def trip_durations(feed: Feed, kind: str = "arrivals") -> DataFrame:
    """Seconds per trip: 'arrivals' max-min, 'departures' max-min, or 'ends'
    (last arrival minus first departure)."""
    end, start = DURATIONS[kind]
    return (
        trip_spans(feed.stop_times)
        .select(*TRIP, (F.col(end) - F.col(start)).alias("duration_secs"), F.col("start_secs"))
        .join(feed.trips.select(*TRIP, "route_id", "direction_id", "service_id"), TRIP)
    )


def duration_by_route(feed: Feed, kind: str = "arrivals") -> DataFrame:
    return trip_durations(feed, kind).groupBy(*ROUTE).agg(
        F.avg("duration_secs").alias("mean_secs"), F.count("*").alias("trips")
    )


def duration_variability(feed: Feed, least_trips: int = 5) -> DataFrame:
    """Mean, spread and coefficient of variation of departure-based travel time."""
    mins = F.col("duration_secs") / 60
    return (
        trip_durations(feed, "departures").groupBy(*ROUTE)
        .agg(
            F.stddev_samp(mins).alias("std_min"), F.avg(mins).alias("mean_min"),
            F.min(mins).alias("least_min"), F.max(mins).alias("most_min"), F.count("*").alias("trips"),
        )
        .filter(F.col("trips") >= least_trips)
        .withColumn("cv", F.try_divide("std_min", "mean_min"))
    )


def service_hours(feed: Feed, by: str = "date") -> DataFrame:
    """Sum of trip durations in hours by route, weekday or date."""
    hours = (F.col("secs") / 3600).alias("hours")
    per_service = trip_durations(feed).groupBy(*SERVICE, "route_id").agg(F.sum("duration_secs").alias("secs"))
    if by == "route":
        return per_service.groupBy(*ROUTE).agg(F.sum("secs").alias("secs")).select(*ROUTE, hours)
    per_service = per_service.groupBy(*SERVICE).agg(F.sum("secs").alias("secs"))
    if by == "weekday":
        flagged = per_service.join(feed.calendar.select(*SERVICE, *C.DAYS), SERVICE)
        sums = flagged.groupBy(FEED).agg(*[F.sum(F.col(d) * F.col("secs")).alias(d) for d in C.DAYS])
        return sums.unpivot([FEED], list(C.DAYS), "day", "secs").select(FEED, "day", hours)
    return (
        per_service.join(V.service_days(feed), SERVICE)
        .groupBy(FEED, "service_date").agg(F.sum("secs").alias("secs")).select(FEED, "service_date", hours)
    )


def duration_by_start_hour(feed: Feed) -> DataFrame:
    """Mean duration by start hour on each feed's busiest date."""
    from dayrunner.operators.choose import top_per

    busiest = top_per(trips_per_date(feed), [FEED], [F.desc("trips"), "service_date"])
    running = V.service_days(feed).join(busiest.select(FEED, "service_date"), [FEED, "service_date"], "left_semi")
    return (
        trip_durations(feed).join(running.select(*SERVICE), SERVICE, "left_semi")
        .groupBy(FEED, C.hour_of("start_secs").alias("hour"))
        .agg(F.avg("duration_secs").alias("mean_secs"), F.count("*").alias("trips"))
    )


# --- distances -------------------------------------------------------------


def trip_distances(feed: Feed) -> DataFrame:
    """Metres per trip, max minus min of the travelled distance."""
    return (
        trip_spans(feed.stop_times).select(*TRIP, "distance", "last_sequence")
        .join(feed.trips.select(*TRIP, "route_id", "service_id", "shape_id"), TRIP)
    )


def shape_lengths(feed: Feed) -> DataFrame:
    return feed.shapes.groupBy(FEED, "shape_id").agg(F.max("shape_dist_traveled").alias("length"))


def distance_totals(feed: Feed, days: Sequence[str] | str, mode: str = "any") -> DataFrame:
    """Metres run per route on a typical day; the shape's length where a trip
    has no distances of its own."""
    return (
        trip_distances(V.typical_feed(feed, days, mode))
        .join(shape_lengths(feed), [FEED, "shape_id"], "left")
        .groupBy(*ROUTE)
        .agg(F.sum(F.coalesce("distance", "length")).alias("total_m"), F.count("*").alias("trips"))
    )


def route_lengths(feed: Feed) -> DataFrame:
    """Longest shape of each route."""
    used = feed.trips.select(*ROUTE, "shape_id").distinct()
    return used.join(shape_lengths(feed), [FEED, "shape_id"]).groupBy(*ROUTE).agg(F.max("length").alias("length"))


def spacing_and_length(feed: Feed) -> DataFrame:
    """Mean trip length and mean stop spacing per route."""
    return (
        trip_distances(feed).groupBy(*ROUTE)
        .agg(F.avg("distance").alias("mean_length"), F.avg("last_sequence").alias("mean_stops"))
        .withColumn("mean_spacing", F.try_divide("mean_length", F.col("mean_stops") - 1))
    )


# --- speeds ----------------------------------------------------------------


def trip_speeds(feed: Feed, kind: str = "ends") -> DataFrame:
    """km/h per trip.

    'ends': first to last stop with known distance; 'minmax': distance range
    over arrival range; 'span': distance range over first departure to last
    arrival.
    """
    spans = trip_spans(feed.stop_times)
    measures = {
        "ends": (F.col("known_to") - F.col("known_from"), F.col("known_end") - F.col("known_start")),
        "minmax": (F.col("distance"), F.col("last_arrival") - F.col("first_arrival")),
        "span": (F.col("distance"), F.col("end_secs") - F.col("start_secs")),
    }
    dist, secs = measures[kind]
    return spans.select(*TRIP, C.speed_kmh(dist, secs).alias("kmh")).join(
        feed.trips.select(*TRIP, "route_id"), TRIP
    )


def route_speeds(feed: Feed, kind: str = "ends") -> DataFrame:
    """Mean trip speed per route; only positive speeds count."""
    return trip_speeds(feed, kind).filter("kmh > 0").groupBy(*ROUTE).agg(
        F.avg("kmh").alias("mean_kmh"), F.count("*").alias("trips")
    )


def route_speeds_by_shape(feed: Feed) -> DataFrame:
    """Shape length over mean trip duration, averaged over a route's shapes."""
    per_shape = (
        trip_durations(feed, "ends")
        .join(feed.trips.select(*TRIP, "shape_id"), TRIP)
        .groupBy(*ROUTE, "shape_id").agg(F.avg("duration_secs").alias("secs"))
        .filter("secs > 0")
    )
    return (
        per_shape.join(shape_lengths(feed), [FEED, "shape_id"])
        .groupBy(*ROUTE)
        .agg(F.avg(C.speed_kmh("length", "secs")).alias("mean_kmh"))
    )


def slow_share(speeds: DataFrame, feed: Feed, below_kmh: float) -> DataFrame:
    """Routes slower than a limit, and their share of all routes."""
    return (
        feed.routes.select(*ROUTE).join(speeds, ROUTE, "left").groupBy(FEED)
        .agg(
            F.count_if(F.col("mean_kmh") < below_kmh).alias("slow_routes"),
            F.count("*").alias("routes"),
        )
        .withColumn("share", F.col("slow_routes") * 100 / F.col("routes"))
    )


# --- dwell and gaps --------------------------------------------------------


def dwell_by_stop(feed: Feed) -> DataFrame:
    return feed.stop_times.groupBy(FEED, "stop_id").agg(
        F.avg(F.col("departure_secs") - F.col("arrival_secs")).alias("dwell_secs"), F.count("*").alias("events")
    )


def dwell_by_route(feed: Feed) -> DataFrame:
    """Mean dwell per route; summed per trip before trips are joined."""
    per_trip = feed.stop_times.groupBy(*TRIP).agg(
        F.sum(F.col("departure_secs") - F.col("arrival_secs")).alias("secs"), F.count("*").alias("events")
    )
    return (
        per_trip.join(feed.trips.select(*TRIP, "route_id"), TRIP).groupBy(*ROUTE)
        .agg((F.sum("secs") / F.sum("events")).alias("dwell_secs"), F.sum("events").alias("events"))
    )


def time_between_stops(feed: Feed) -> DataFrame:
    """Total running time over the number of intervals, per route."""
    return (
        trip_durations(feed)
        .join(feed.stop_times.groupBy(*TRIP).agg(F.count("*").alias("n_stops")), TRIP)
        .groupBy(*ROUTE)
        .agg(F.try_divide(F.sum("duration_secs"), F.sum(F.col("n_stops") - 1)).alias("mean_gap_secs"))
    )


# --- stops per trip --------------------------------------------------------


def stops_per_trip(feed: Feed) -> DataFrame:
    return feed.stop_times.groupBy(*TRIP).agg(F.count("*").alias("n_stops")).join(
        feed.trips.select(*TRIP, "route_id"), TRIP
    )


def stop_count_stats(feed: Feed, more_than: int = 10) -> DataFrame:
    """Most, mean and long-trip count of stops per trip, by route type."""
    return (
        stops_per_trip(feed).join(feed.routes.select(*ROUTE, "route_type"), ROUTE)
        .groupBy(FEED, "route_type")
        .agg(
            F.max("n_stops").alias("most"), F.avg("n_stops").alias("mean"),
            F.count_if(F.col("n_stops") > more_than).alias("long_trips"), F.count("*").alias("trips"),
        )
    )


def fewer_stops_than_usual(feed: Feed) -> DataFrame:
    """Trips that skip stops: fewer than the route's longest trip, by route."""
    per_route = stops_per_trip(feed).groupBy(*ROUTE, "n_stops").agg(F.count("*").alias("trips"))
    longest = per_route.groupBy(*ROUTE).agg(F.max("n_stops").alias("usual"))
    return (
        per_route.join(longest, ROUTE).groupBy(*ROUTE)
        .agg(
            F.sum(F.when(F.col("n_stops") < F.col("usual"), F.col("trips")).otherwise(0)).alias("short_trips"),
            F.sum("trips").alias("trips"),
            F.max("usual").alias("usual"),
        )
    )


def stops_per_trip_vs_feed(feed: Feed) -> DataFrame:
    """Routes whose mean stop count is below the feed's mean."""
    per_route = stops_per_trip(feed).groupBy(*ROUTE).agg(F.sum("n_stops").alias("s"), F.count("*").alias("n"))
    per_feed = per_route.groupBy(FEED).agg((F.sum("s") / F.sum("n")).alias("feed_mean"))
    return (
        per_route.withColumn("route_mean", F.col("s") / F.col("n"))
        .join(per_feed, FEED).filter("route_mean < feed_mean")
        .select(*ROUTE, "route_mean", "feed_mean")
    )


def common_span_times(feed: Feed, which: Column | str, name: str) -> DataFrame:
    """How often a trip start or end second occurs."""
    return trip_spans(feed.stop_times).groupBy(FEED, F.col(which).alias(name) if isinstance(which, str) else which.alias(name)).agg(
        F.count("*").alias("trips")
    )
