"""Headways, hours of operation, spans, stop and route rankings, fares, access."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayrunner.feed import Feed
from dayrunner.functions import columns as C
from dayrunner.functions.geometry import geodesic
from dayrunner.functions.ordered import positions
from dayrunner.operators import joins as J
from dayrunner.operators import trips as T
from dayrunner.plans import views as V
from dayrunner.plans.views import FEED, ROUTE, SERVICE, STOP, TRIP



def percent(condition: Column) -> Column:
    """Share of rows that meet a condition, in percent; NULL counts as no."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int")) * 100


# --- stops and routes ------------------------------------------------------


def stop_visits(feed: Feed) -> DataFrame:
    """Stop events per stop and their share of the feed."""
    visits = feed.stop_times.groupBy(*STOP).agg(F.count("*").alias("visits"))
    totals = visits.groupBy(FEED).agg(F.sum("visits").alias("total"))
    return visits.join(totals, FEED).select(*STOP, "visits", (F.col("visits") * 100 / F.col("total")).alias("share"))


def routes_per_stop(served: DataFrame) -> DataFrame:
    """``served`` is distinct (route, stop)."""
    return served.groupBy(*STOP).agg(F.count("*").alias("routes"))


def stops_per_route(served: DataFrame) -> DataFrame:
    return served.groupBy(*ROUTE).agg(F.count("*").alias("stops"))


def shapes_per_route(feed: Feed) -> DataFrame:
    return feed.trips.groupBy(*ROUTE).agg(F.count_distinct("shape_id").alias("shapes"))


def route_types_per_stop(feed: Feed) -> DataFrame:
    """Route types per stop as text; the set holds at most a dozen codes."""
    typed = J.with_route(J.route_stops(feed), feed, ["route_type"], "inner")
    return typed.groupBy(*STOP).agg(
        F.count_distinct("route_type").alias("n_types"),
        F.array_join(F.transform(F.sort_array(F.collect_set("route_type")), lambda x: x.cast("string")), ", ").alias("types"),
    )


def route_type_distribution(feed: Feed) -> DataFrame:
    """Routes per type with label and share of the feed."""
    counts = feed.routes.groupBy(FEED, "route_type").agg(F.count("*").alias("routes"))
    totals = counts.groupBy(FEED).agg(F.sum("routes").alias("total"))
    return counts.join(totals, FEED).select(
        FEED, "route_type", C.route_type_label("route_type").alias("label"), "routes",
        (F.col("routes") * 100 / F.col("total")).alias("share"),
    )


def vehicles(trips: DataFrame) -> DataFrame:
    """Distinct blocks per feed; distinct trips where a feed has no blocks."""
    counts = trips.groupBy(FEED).agg(F.count_distinct("block_id").alias("b"), F.count_distinct("trip_id").alias("t"))
    return counts.select(FEED, F.when(F.col("b") == 0, F.col("t")).otherwise(F.col("b")).alias("vehicles"))


def stops_by_reach(feed: Feed) -> DataFrame:
    """Per stop: number of routes, and whether it has all, one, or shared routes,
    only weekend service, only peak-hour service."""
    served = J.route_stops(feed)
    totals = feed.routes.groupBy(FEED).agg(F.count("*").alias("all_routes"))
    weekend = feed.calendar.select(*SERVICE, C.runs_on(C.WEEKEND, "only").alias("weekend_only"))
    trips = feed.trips.select(*TRIP, "service_id").join(weekend, SERVICE, "left")
    peaks = C.in_windows("departure_secs", [C.MORNING_PEAK, C.EVENING_PEAK])
    use = (
        feed.stop_times.select(*TRIP, "stop_id", peaks.alias("peak")).join(trips, TRIP)
        .groupBy(*STOP).agg(
            F.bool_and(F.coalesce("weekend_only", F.lit(False))).alias("weekend_only"),
            F.bool_and("peak").alias("peak_only"),
        )
    )
    return (
        routes_per_stop(served).join(totals, FEED).join(use, STOP)
        .select(
            *STOP, "routes", (F.col("routes") == F.col("all_routes")).alias("by_all_routes"),
            (F.col("routes") == 1).alias("by_one_route"), "weekend_only", "peak_only",
        )
    )


def terminal_stops(feed: Feed) -> DataFrame:
    """Stops that are first or last on any trip."""
    ends = T.trip_ends(feed.stop_times)
    return (
        ends.select(FEED, F.explode(F.array("first_stop", "last_stop")).alias("stop_id")).distinct()
    )


def circular_routes(feed: Feed) -> DataFrame:
    """Per route: trips that end where they began, and whether there is any."""
    loops = T.trip_ends(feed.stop_times).select(*TRIP, (F.col("first_stop") == F.col("last_stop")).alias("loop"))
    return (
        loops.join(feed.trips.select(*TRIP, "route_id"), TRIP).groupBy(*ROUTE)
        .agg(F.count_if("loop").alias("loop_trips"), F.bool_or("loop").alias("circular"))
    )


def circular_by_sample(feed: Feed) -> DataFrame:
    """Circularity of one sample trip per route (the smallest trip id with stops)."""
    ends = T.trip_ends(feed.stop_times).join(feed.trips.select(*TRIP, "route_id"), TRIP)
    return ends.groupBy(*ROUTE).agg(
        (F.min_by("first_stop", "trip_id") == F.min_by("last_stop", "trip_id")).alias("circular")
    )


def closure_gaps(feed: Feed) -> DataFrame:
    """Metres from first to last stop, least per route."""
    places = feed.stops.select(*STOP, "stop_lat", "stop_lon")
    side = lambda n: places.select(FEED, F.col("stop_id").alias(f"{n}_stop"),
                                   F.col("stop_lat").alias(f"{n}_lat"), F.col("stop_lon").alias(f"{n}_lon"))
    ends = (
        T.trip_ends(feed.stop_times).join(feed.trips.select(*TRIP, "route_id"), TRIP)
        .select(*ROUTE, "first_stop", "last_stop").distinct()
    )
    gap = geodesic(F.col("first_lat"), F.col("first_lon"), F.col("last_lat"), F.col("last_lon"))
    return (
        ends.join(side("first"), [FEED, "first_stop"]).join(side("last"), [FEED, "last_stop"])
        .groupBy(*ROUTE).agg(F.min(gap).alias("gap_m"))
    )


def pattern_signatures(feed: Feed, ranked: DataFrame | None = None) -> DataFrame:
    """Per trip a signature of its ordered stop sequence.

    Two 64-bit sums over (position, stop) and the length stand in for the list,
    so no trip is gathered into one value and sums combine before the shuffle.
    ``ranked`` are the stop events with their ``position``, if there are any yet.
    """
    if ranked is None:
        ranked = positions(feed.stop_times.select(*TRIP, "stop_id", "stop_sequence"), TRIP, "stop_sequence")
    h, g = F.xxhash64("position", "stop_id"), F.xxhash64("stop_id", "position", F.lit(1))
    low, high = (lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))), (lambda x: F.shiftrightunsigned(x, 32))
    return ranked.groupBy(*TRIP).agg(
        F.sum(low(h)).alias("s1"), F.sum(high(h)).alias("s2"),
        F.sum(low(g)).alias("s3"), F.sum(high(g)).alias("s4"), F.count("*").alias("length"),
    )


def patterns_per_route(feed: Feed) -> DataFrame:
    """Distinct ordered stop sequences per route."""
    return (
        pattern_signatures(feed).join(feed.trips.select(*TRIP, "route_id"), TRIP)
        .groupBy(*ROUTE)
        .agg(F.count_distinct("s1", "s2", "s3", "s4", "length").alias("patterns"), F.count("*").alias("trips"))
    )


def two_way_routes(feed: Feed) -> DataFrame:
    return feed.trips.groupBy(*ROUTE).agg(
        (F.count_distinct("direction_id") > 1).alias("two_way")
    )


def shape_use(feed: Feed) -> DataFrame:
    """Routes and points per shape."""
    routes = feed.trips.groupBy(FEED, "shape_id").agg(F.count_distinct("route_id").alias("routes"))
    points = feed.shapes.groupBy(FEED, "shape_id").agg(F.count("*").alias("points"))
    return routes.join(points, [FEED, "shape_id"], "full")


def agency_transfers(feed: Feed) -> DataFrame:
    """Stops where routes of several agencies meet."""
    served = J.with_route(J.route_stops(feed), feed, ["agency_id"], "inner")
    return served.groupBy(*STOP).agg(F.count_distinct("agency_id").alias("agencies")).filter("agencies > 1")


def stop_extent(feed: Feed) -> DataFrame:
    """Centroid and bounds of a feed's stops."""
    return feed.stops.groupBy(FEED).agg(
        F.avg("stop_lat").alias("lat"), F.avg("stop_lon").alias("lon"),
        F.min("stop_lat").alias("south"), F.max("stop_lat").alias("north"),
        F.min("stop_lon").alias("west"), F.max("stop_lon").alias("east"),
    )


# --- hours and spans -------------------------------------------------------


def departures_by_hour(feed: Feed, *, fold: bool = False) -> DataFrame:
    return feed.stop_times.groupBy(FEED, C.hour_of("departure_secs", fold=fold).alias("hour")).agg(
        F.count("*").alias("departures")
    )


def trips_by_hour(feed: Feed) -> DataFrame:
    """Distinct trips with an arrival in each hour 0-23, zero-filled."""
    counted = feed.stop_times.groupBy(FEED, C.hour_of("arrival_secs").alias("hour")).agg(
        F.count_distinct("trip_id").alias("trips")
    )
    grid = feed.stop_times.select(FEED).distinct().withColumn(
        "hour", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(23).cast("bigint")))
    )
    return grid.join(counted, [FEED, "hour"], "left").select(
        FEED, "hour", F.coalesce("trips", F.lit(0)).alias("trips")
    )


def trips_per_hour_by_zone(feed: Feed) -> DataFrame:
    """Mean trips per hour for the five zones of the day."""
    return trips_by_hour(feed).groupBy(FEED, C.day_zone("hour").alias("zone")).agg(F.avg("trips").alias("trips_per_hour"))


def trips_per_hour_in(feed: Feed, window: tuple[int, int]) -> DataFrame:
    """Trip starts per hour of a window, by route."""
    starts = V.trip_starts(feed.stop_times).filter(C.in_windows("start_secs", [window], "left"))
    hours = (window[1] - window[0]) / 3600
    return (
        starts.join(feed.trips.select(*TRIP, "route_id"), TRIP)
        .groupBy(*ROUTE).agg((F.count("*") / F.lit(hours)).alias("trips_per_hour"))
    )


def service_span(feed: Feed, *, wrap: bool = False) -> DataFrame:
    """Earliest departure to latest arrival per route; ``wrap`` takes earliest
    arrival to latest departure and adds 24 h to negative spans."""
    joined = T.trip_spans(feed.stop_times).join(feed.trips.select(*TRIP, "route_id"), TRIP)
    if wrap:
        hours = (F.max("last_departure") - F.min("first_arrival")) / 3600
        return joined.groupBy(*ROUTE).agg(F.when(hours < 0, hours + 24).otherwise(hours).alias("hours"))
    return joined.groupBy(*ROUTE).agg(
        F.min("first_departure").alias("first_departure"), F.max("last_arrival").alias("last_arrival"),
        ((F.max("last_arrival") - F.min("first_departure")) / 3600).alias("hours"),
    )


def last_departures(feed: Feed, day: str) -> DataFrame:
    """Last departure per stop on a typical day, also as clock text."""
    trips = V.typical_trips(feed, day).select(*TRIP)
    return (
        feed.stop_times.select(*TRIP, "stop_id", "departure_secs").join(trips, TRIP, "left_semi")
        .groupBy(*STOP).agg(F.max("departure_secs").alias("last_secs"))
        .withColumn("clock", C.clock_text("last_secs"))
    )


def peak_headways(feed: Feed, window: tuple[int, int] = C.MORNING_PEAK) -> DataFrame:
    """Mean headway, trips and trips per hour by route and direction in a window.

    Gaps of sorted departures telescope, so extremes and a count are enough.
    """
    first = feed.stop_times.groupBy(*TRIP).agg(F.min_by("departure_secs", "stop_sequence").alias("secs"))
    stats = (
        first.filter(C.in_windows("secs", [window]))
        .join(feed.trips.select(*TRIP, "route_id", "direction_id"), TRIP)
        .groupBy(*ROUTE, "direction_id")
        .agg(F.count("*").alias("trips"), F.min("secs").alias("a"), F.max("secs").alias("b"))
    )
    return (
        stats.withColumn("headway_secs", F.try_divide(F.col("b") - F.col("a"), F.col("trips") - 1))
        .withColumn("trips_per_hour", F.try_divide(F.lit(3600.0), "headway_secs"))
        .drop("a", "b")
    )


def around_the_clock(feed: Feed) -> DataFrame:
    """Routes with a trip that touches all 24 folded hours and whose services
    all run all seven days."""
    all_hours = (
        feed.stop_times.groupBy(*TRIP)
        .agg(F.count_distinct(C.hour_of("departure_secs", fold=True)).alias("hours"))
        .filter("hours = 24").select(*TRIP)
    )
    every_day = feed.calendar.select(*SERVICE, C.runs_on(C.DAYS, "all").alias("daily"))
    routes = (
        feed.trips.select(*SERVICE, "route_id").distinct().join(every_day, SERVICE)
        .groupBy(*ROUTE).agg(F.bool_and("daily").alias("daily"))
    )
    hourly = feed.trips.join(all_hours, TRIP, "left_semi").select(*ROUTE).distinct()
    return routes.join(hourly.withColumn("all_hours", F.lit(True)), ROUTE, "left").select(
        *ROUTE, "daily", F.coalesce("all_hours", F.lit(False)).alias("all_hours")
    )


# --- accessibility and shares ----------------------------------------------


def feed_shares(feed: Feed) -> DataFrame:
    """Percentages per feed: express routes, trips with bikes, accessible stops."""
    express = feed.routes.groupBy(FEED).agg(
        percent(C.name_has_any(C.full_name(), C.EXPRESS_KEYWORDS)).alias("express_routes"),
        percent(C.name_has_any("route_long_name", ["express"])).alias("named_express"),
        percent(F.col("route_type") == 3).alias("bus_routes"),
    )
    bikes = feed.trips.groupBy(FEED).agg(percent(F.col("bikes_allowed") == 1).alias("bike_trips"))
    stops = feed.stops.groupBy(FEED).agg(percent(F.col("wheelchair_boarding") == 1).alias("accessible_stops"))
    return express.join(bikes, FEED).join(stops, FEED)


def accessible_trip_share(feed: Feed) -> DataFrame:
    """Trips with any accessible stop, of all trips."""
    accessible = feed.stops.filter("wheelchair_boarding = 1").select(*STOP)
    served = feed.stop_times.select(*TRIP, "stop_id").join(accessible, STOP, "left_semi").select(*TRIP)
    return (
        feed.trips.select(*TRIP)
        .join(served.distinct().withColumn("hit", F.lit(True)), TRIP, "left")
        .groupBy(FEED).agg(percent(F.col("hit")).alias("accessible_trips"), F.count("*").alias("trips"))
    )


def fully_accessible_routes(feed: Feed) -> DataFrame:
    """Routes all of whose stops allow wheelchair boarding."""
    flagged = J.with_stop(J.route_stops(feed), feed, ["wheelchair_boarding"])
    return flagged.groupBy(*ROUTE).agg(
        F.bool_and(F.coalesce(F.col("wheelchair_boarding") == 1, F.lit(False))).alias("accessible")
    )


# --- fares -----------------------------------------------------------------


def fare_by_route_type(feed: Feed) -> DataFrame:
    return J.network_fares(feed).groupBy(FEED, "route_type").agg(
        F.avg("amount").alias("mean_fare"), F.max("amount").alias("max_fare"), F.count("*").alias("rules")
    )


def fare_by_route(feed: Feed) -> DataFrame:
    return J.network_fares(feed).groupBy(*ROUTE).agg(
        F.max("amount").alias("max_fare"), F.avg("amount").alias("mean_fare")
    )


def fare_frequencies(feed: Feed) -> DataFrame:
    """How often each amount occurs over routes, and on how many routes."""
    return J.network_fares(feed).filter("amount is not null").groupBy(FEED, "amount").agg(
        F.count("*").alias("times"), F.count_distinct("route_id").alias("routes")
    )


def fare_products_by_medium(feed: Feed) -> DataFrame:
    return J.product_media(feed).groupBy(FEED, "fare_media_type", "fare_media_name").agg(
        F.count("fare_product_id").alias("products"), F.count_distinct("fare_product_id").alias("distinct_products"),
        F.min("amount").alias("least"), F.max("amount").alias("most"), F.avg("amount").alias("mean"),
    )


def trip_weighted_fare(feed: Feed) -> DataFrame:
    """Mean fare weighted by trips; routes without a price stay in the weight."""
    prices = J.route_fares(feed).groupBy(*ROUTE).agg(F.avg("price").alias("price"))
    return (
        feed.trips.groupBy(*ROUTE).agg(F.count("*").alias("trips")).join(prices, ROUTE, "left")
        .groupBy(FEED)
        .agg(F.try_divide(F.sum(F.col("price") * F.col("trips")), F.sum("trips")).alias("weighted_fare"))
    )


# --- transfers, frequencies, translations ----------------------------------


def transfer_use(feed: Feed) -> DataFrame:
    """Declared transfers with the traffic and routes at both ends."""
    visits = feed.stop_times.groupBy(*STOP).agg(F.count("*").alias("visits"))
    routes = routes_per_stop(J.route_stops(feed))
    use = visits.join(routes, STOP, "left")
    side = lambda n: use.select(FEED, F.col("stop_id").alias(f"{n}_stop_id"),
                                F.col("visits").alias(f"{n}_visits"), F.col("routes").alias(f"{n}_routes"))
    return (
        feed.transfers.join(side("from"), [FEED, "from_stop_id"], "left")
        .join(side("to"), [FEED, "to_stop_id"], "left")
        .select(
            FEED, "from_stop_id", "to_stop_id", "min_transfer_time",
            (F.coalesce("from_visits", F.lit(0)) + F.coalesce("to_visits", F.lit(0))).alias("visits"),
            F.greatest(F.coalesce("from_routes", F.lit(0)), F.coalesce("to_routes", F.lit(0))).alias("routes"),
        )
    )


def frequency_departures(feed: Feed) -> DataFrame:
    """Departures of frequency-based trips; windows without headway give none."""
    ticks = F.when(
        (F.col("headway_secs") > 0) & (F.col("end_secs") > F.col("start_secs")),
        F.sequence(F.col("start_secs"), F.col("end_secs") - 1, F.col("headway_secs")),
    )
    return feed.frequencies.select(*TRIP, "exact_times", F.explode(ticks).alias("departure_secs"))


def translated(feed: Feed, table: str, key: str, column: str, language: str) -> DataFrame:
    """A name column in a language: by record id, else by field value, else as is."""
    wanted = feed.translations.filter(
        (F.col("table_name") == table) & (F.col("field_name") == column) & (F.col("language") == language)
    )
    by_record = wanted.filter("record_id is not null").groupBy(FEED, F.col("record_id").alias(key)).agg(
        F.min("translation").alias("by_record")
    )
    by_value = wanted.filter("record_id is null and field_value is not null").groupBy(
        FEED, F.col("field_value").alias(column)
    ).agg(F.min("translation").alias("by_value"))
    return (
        feed[table].select(FEED, key, column)
        .join(by_record, [FEED, key], "left").join(by_value, [FEED, column], "left")
        .select(FEED, key, F.coalesce("by_record", "by_value", column).alias(column))
    )
