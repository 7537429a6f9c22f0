"""Worked answers: one function per question, each a job over all feeds.

Every function takes the feed and the question's parameters and returns a
DataFrame. Route and stop texts are resolved by fuzzy matching, per feed.
Answers are numbered; ``chart`` numbers give the table behind a chart or map.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayrunner.feed import Feed
from dayrunner.functions import columns as C
from dayrunner.operators import choose as G
from dayrunner.operators import joins as J
from dayrunner.operators import matching as N
from dayrunner.operators import quality as K
from dayrunner.operators import sequences as Q
from dayrunner.operators import service as S
from dayrunner.operators import spatial as P
from dayrunner.operators import trips as T
from dayrunner.plans import views as V
from dayrunner.plans.views import FEED, ROUTE, STOP, TRIP

ANSWERS: dict[str, Callable[..., DataFrame]] = {}


def answer(*names: str):
    def register(build):
        for name in names:
            ANSWERS[name] = build
        return build

    return register


# --- lookups by text -------------------------------------------------------


def _asked(feed: Feed, *texts: str) -> DataFrame:
    spark = next(iter(feed.values())).sparkSession
    return spark.createDataFrame([(t,) for t in texts], "query string")


def find_route(feed: Feed, text: str, threshold: float = 0.6) -> DataFrame:
    """Best matching route of each feed."""
    return N.best_match(N.match_routes(feed.routes, _asked(feed, text), threshold), "route_id").select(*ROUTE)


def find_stop(feed: Feed, text: str, threshold: float = 0.6) -> DataFrame:
    """Best matching stop of each feed."""
    return N.best_match(N.match_stops(feed.stops, _asked(feed, text), threshold), "stop_id").select(*STOP)


def find_stops(feed: Feed, text: str, threshold: float = 0.7) -> DataFrame:
    """All stops whose id or name resembles a text."""
    return N.match_stops(feed.stops, _asked(feed, text), threshold).select(*STOP)


def find_street(feed: Feed, street: str, threshold: float = 0.8) -> DataFrame:
    return N.stops_on_street(feed.stops, _asked(feed, street), threshold).select(*STOP)


def find_intersection(feed: Feed, street_a: str, street_b: str, threshold: float = 0.7) -> DataFrame:
    spark = feed.stops.sparkSession
    crossing = spark.createDataFrame([("x", street_a, street_b)], "crossing_id string, street_a string, street_b string")
    return N.stops_at_intersection(feed.stops, crossing, threshold).select(*STOP)


def near_point(feed: Feed, lat: float, lon: float, radius_m: float, k: int | None = None) -> DataFrame:
    """Stops near one point, in every feed."""
    points = feed.stops.select(FEED).distinct().select(
        FEED, F.lit("point").alias("point_id"), F.lit(lat).alias("lat"), F.lit(lon).alias("lon")
    )
    return J.with_stop(P.stops_near(feed, points, radius_m, k=k), feed, ["stop_name"])


def _of(feed: Feed, routes: DataFrame, where: Column | str | None = None) -> Feed:
    """The feed reduced to the trips of some routes."""
    trips = feed.trips.join(routes.select(*ROUTE), ROUTE, "left_semi")
    return feed.replace(trips=trips if where is None else trips.filter(where))


def _best(df: DataFrame, metric: str, key: str = "route_id", *, least: bool = False) -> DataFrame:
    order = F.asc_nulls_last(metric) if least else F.desc_nulls_last(metric)
    return G.top_per(df, [FEED], [order, key])


def _named(df: DataFrame, feed: Feed) -> DataFrame:
    return J.with_route(df, feed, ["route_short_name", "route_long_name"])


def _feed_mean(df: DataFrame, value: str, name: str) -> DataFrame:
    return df.groupBy(FEED).agg(F.avg(value).alias(name))


# --- trips and days --------------------------------------------------------


@answer("1")
def trips_of_route_on(feed: Feed, route: str, day: str = "friday") -> DataFrame:
    """Trips of a route on a typical day of the week."""
    return T.trip_counts(_of(V.typical_feed(feed, day), find_route(feed, route)), ["route_id"])


@answer("2")
def mean_duration_of_route(feed: Feed, route: str) -> DataFrame:
    """Mean trip duration of a route."""
    return T.duration_by_route(_of(feed, find_route(feed, route)))


@answer("3")
def headway_of_route(feed: Feed, route: str) -> DataFrame:
    """Headways of a route by direction and service."""
    return Q.headways(_of(feed, find_route(feed, route)))


@answer("4")
def longest_route(feed: Feed) -> DataFrame:
    """Longest route by shape length."""
    return _named(_best(T.route_lengths(feed), "length"), feed)


@answer("5", "17")
def busiest_date(feed: Feed) -> DataFrame:
    """Service date with the most trips."""
    return G.top_per(T.trips_per_date(feed), [FEED], [F.desc("trips"), "service_date"])


@answer("6", "33")
def directions(feed: Feed, start: str, end: str, service_date: str, now_secs: int, within_secs: int = 3600) -> DataFrame:
    """Next direct rides from one place to another."""
    a = find_stops(feed, start).withColumnRenamed("stop_id", "from_stop")
    b = find_stops(feed, end).withColumnRenamed("stop_id", "to_stop")
    requests = a.join(b, FEED).filter("from_stop <> to_stop").select(
        F.lit("ride").alias("request_id"), FEED, "from_stop", "to_stop",
        F.lit(service_date).cast("date").alias("service_date"), F.lit(now_secs).alias("now_secs"),
    )
    rides = G.top_per(J.direct_trips(feed, requests, within_secs), [FEED], ["start_secs", "trip_id"])
    return _named(rides, feed).withColumns({"leaves": C.clock_text("start_secs"), "arrives": C.clock_text("end_secs")})


@answer("7", "36")
def stops_at_intersection(feed: Feed, street_a: str, street_b: str) -> DataFrame:
    """Stops at an intersection."""
    return J.with_stop(find_intersection(feed, street_a, street_b).distinct(), feed, ["stop_name"])


@answer("8")
def mid_block_stops(feed: Feed, street: str, mark: str = "MB") -> DataFrame:
    """Mid-block stops on a street."""
    return feed.stops.filter(F.col("stop_name").contains(mark)).join(find_street(feed, street), STOP, "left_semi")


@answer("9")
def trips_after_midnight(feed: Feed) -> DataFrame:
    """Trips with a departure after midnight, per route."""
    late = feed.stop_times.filter(C.after_midnight("departure_secs")).select(*TRIP).distinct()
    return T.trip_counts(feed.replace(trips=feed.trips.join(late, TRIP, "left_semi")), ["route_id"])


@answer("10", "31", "42")
def distance_between(feed: Feed, route: str, start: DataFrame, end: DataFrame) -> DataFrame:
    """Distance along a route between two sets of stops, on one trip per direction."""
    mine = _of(feed, find_route(feed, route))
    both = J.trips_serving_both(feed, start, end).filter("first_a < last_b")
    rides = both.join(mine.trips.select(*TRIP, "direction_id"), TRIP)
    one = G.top_per(rides, [FEED, "direction_id"], ["trip_id"]).select(
        *TRIP, F.col("first_a").alias("from_seq"), F.col("last_b").alias("to_seq")
    )
    return P.along_distance(feed, one)


@answer("11")
def circular_routes(feed: Feed) -> DataFrame:
    """Routes with a trip that ends where it began."""
    return S.circular_routes(feed).filter("circular")


@answer("12")
def speed_of_route(feed: Feed, route: str) -> DataFrame:
    """Mean speed of a route."""
    return T.route_speeds(_of(feed, find_route(feed, route)), "minmax")


@answer("13", "29")
def nearest_stops(feed: Feed, lat: float, lon: float, k: int = 10, radius_m: float = 3000) -> DataFrame:
    """Nearest stops to a point."""
    return near_point(feed, lat, lon, radius_m, k)


@answer("14")
def routes_serving(feed: Feed, stop: str) -> DataFrame:
    """Routes that serve a stop."""
    return _named(J.routes_at(feed, find_stops(feed, stop)), feed)


@answer("15")
def last_departure(feed: Feed, street_a: str, street_b: str, day: str = "monday") -> DataFrame:
    """Last departure at an intersection's stops."""
    return S.last_departures(feed, day).join(find_intersection(feed, street_a, street_b), STOP, "left_semi")


@answer("16")
def most_shapes(feed: Feed, k: int = 5) -> DataFrame:
    """Routes with the most shapes."""
    return G.top_per(S.shapes_per_route(feed), [FEED], [F.desc("shapes"), "route_id"], k)


@answer("18")
def express_routes(feed: Feed) -> DataFrame:
    """Express routes by name."""
    return feed.routes.filter(C.name_has_any(C.full_name(), C.EXPRESS_KEYWORDS)).select(*ROUTE, C.display_name().alias("name"))


@answer("19", "21", "88")
def agency_facts(feed: Feed) -> DataFrame:
    """Agency name, site, fare page, zone and feed dates."""
    return K.agency_lookup(feed)


@answer("20")
def local_time(feed: Feed) -> DataFrame:
    """Current time in each agency's zone."""
    return K.local_now(feed)


@answer("22")
def busiest_weekday(feed: Feed) -> DataFrame:
    """Day of week with the most trips."""
    return G.top_per(T.trips_per_weekday(feed), [FEED], [F.desc("trips"), "day"])


@answer("23")
def service_day_count(feed: Feed) -> DataFrame:
    """Number of service days and their range."""
    return T.service_day_totals(feed, shared_removals=True)


@answer("24")
def routes_at_intersection(feed: Feed, street_a: str, street_b: str) -> DataFrame:
    """Routes through an intersection."""
    return _named(J.routes_at(feed, find_intersection(feed, street_a, street_b)), feed)


@answer("25")
def stops_on_street(feed: Feed, street: str) -> DataFrame:
    """Stops on a street."""
    return feed.stops.join(find_street(feed, street), STOP, "left_semi")


@answer("26")
def longest_mean_duration(feed: Feed) -> DataFrame:
    """Route with the longest mean trip duration."""
    return _named(_best(T.duration_by_route(feed), "mean_secs"), feed)


@answer("27")
def longest_step(feed: Feed) -> DataFrame:
    """Longest distance between consecutive stops."""
    return Q.longest_step(feed)


@answer("28")
def route_count_at(feed: Feed, stop_id: str) -> DataFrame:
    """Number of routes at a stop id, given with or without the feed's prefix."""
    asked = F.col("stop_id").isin(stop_id) | (F.col("stop_id") == F.concat(FEED, F.lit(stop_id)))
    return S.routes_per_stop(J.routes_at(feed, feed.stops.filter(asked)))


@answer("30")
def trip_extremes(feed: Feed, day: str = "sunday") -> DataFrame:
    """Earliest start and latest end of a typical day."""
    spans = T.trip_spans(V.typical_feed(feed, day).stop_times).join(V.typical_trips(feed, day).select(*TRIP, "route_id"), TRIP)
    first = G.top_per(spans, [FEED], ["start_secs", "trip_id"]).withColumn("what", F.lit("first start"))
    last = G.top_per(spans, [FEED], [F.desc("end_secs"), "trip_id"]).withColumn("what", F.lit("last end"))
    return first.unionByName(last).select(
        FEED, "what", "trip_id", "route_id", C.clock_text("start_secs").alias("starts"), C.clock_text("end_secs").alias("ends")
    )


@answer("32")
def span_of_route(feed: Feed, route: str, day: str = "saturday") -> DataFrame:
    """First departure and last arrival of a route on a typical day."""
    return S.service_span(_of(V.typical_feed(feed, day), find_route(feed, route)))


@answer("34")
def stops_by_name(feed: Feed, stop: str, threshold: float = 0.8) -> DataFrame:
    """Stops whose name resembles a text."""
    return J.with_stop(find_stops(feed, stop, threshold).distinct(), feed, ["stop_name"])


@answer("35")
def buses_in_use(feed: Feed, day: str = "friday") -> DataFrame:
    """Vehicles used on a typical day."""
    return S.vehicles(V.typical_trips(feed, day))


@answer("37")
def routes_at_on(feed: Feed, stop: str, days=C.WEEKEND) -> DataFrame:
    """Routes at a stop on given days."""
    return _named(J.routes_at(feed, find_stop(feed, stop), days), feed)


@answer("38")
def circular_by_sample(feed: Feed) -> DataFrame:
    """Circular routes judged by one trip each."""
    return S.circular_by_sample(feed).filter("circular")


@answer("39")
def stop_with_most_routes(feed: Feed) -> DataFrame:
    """Stop served by the most routes."""
    return J.with_stop(_best(S.routes_per_stop(J.route_stops(feed)), "routes", "stop_id"), feed, ["stop_name"])


@answer("40")
def transfer_points(feed: Feed, route_a: str, route_b: str) -> DataFrame:
    """Stops where one can change between two routes."""
    a = find_route(feed, route_a).withColumnRenamed("route_id", "route_a")
    b = find_route(feed, route_b).withColumnRenamed("route_id", "route_b")
    return J.with_stop(J.transfer_points(feed, a.join(b, FEED)), feed, ["stop_name"])


@answer("41")
def spikes_of_route(feed: Feed, route: str, below_degrees: float = 75) -> DataFrame:
    """Sharp angles of a route's longest shape."""
    longest = P.longest_shapes(_of(feed, find_route(feed, route)))
    return longest.join(Q.spike_counts(feed, below_degrees), [FEED, "shape_id"])


@answer("43")
def express_share(feed: Feed) -> DataFrame:
    """Share of express routes."""
    return S.feed_shares(feed).select(FEED, "named_express")


@answer("44")
def weekend_only_trips(feed: Feed) -> DataFrame:
    """Trips that run on weekends only."""
    return T.trip_counts(V.typical_feed(feed, C.WEEKEND, "only"), [])


@answer("46")
def accessible_routes(feed: Feed) -> DataFrame:
    """Routes all of whose stops are accessible."""
    return _named(S.fully_accessible_routes(feed).filter("accessible"), feed)


@answer("47", "58")
def most_visited_stop(feed: Feed) -> DataFrame:
    """Stop with the most visits and how it can be boarded."""
    best = J.with_stop(_best(S.stop_visits(feed), "visits", "stop_id"), feed, ["stop_name", "wheelchair_boarding"])
    return best.withColumn("wheelchair", C.wheelchair_label("wheelchair_boarding"))


@answer("48")
def longest_trip(feed: Feed) -> DataFrame:
    """Trip with the longest duration."""
    return _best(T.trip_durations(feed), "duration_secs", "trip_id")


@answer("49")
def validity(feed: Feed) -> DataFrame:
    """Validity span of each feed."""
    return T.feed_validity(feed)


@answer("50")
def route_profile(feed: Feed, route: str) -> DataFrame:
    """Distance, duration and speed of a route's trips."""
    mine = _of(feed, find_route(feed, route))
    return T.spacing_and_length(mine).join(T.duration_by_route(mine), ROUTE).join(
        T.route_speeds(mine).select(*ROUTE, "mean_kmh"), ROUTE, "left"
    )


@answer("51")
def mean_trips_per_route(feed: Feed) -> DataFrame:
    """Mean, least and most trips per route."""
    return T.summary(T.trip_counts(feed, ["route_id"]), [FEED], "trips")


@answer("52")
def longest_gap_between_stops(feed: Feed) -> DataFrame:
    """Route with the longest mean time between stops."""
    return _named(_best(T.time_between_stops(feed), "mean_gap_secs"), feed)


@answer("53")
def always_running(feed: Feed) -> DataFrame:
    """Routes that run around the clock, every day."""
    return S.around_the_clock(feed).filter("daily and all_hours")


@answer("54")
def weekend_distance(feed: Feed) -> DataFrame:
    """Known distance run on weekends: total, mean per route and the longest route."""
    known = T.trip_distances(V.typical_feed(feed, C.WEEKEND)).filter("distance is not null")
    totals = known.groupBy(*ROUTE).agg(F.sum("distance").alias("total_m"), F.count("*").alias("trips"))
    return totals.groupBy(FEED).agg(
        (F.sum("total_m") / 1000).alias("total_km"), F.count("*").alias("routes"), F.sum("trips").alias("trips"),
        (F.avg("total_m") / 1000).alias("mean_km"),
        F.min_by("route_id", F.struct(-F.col("total_m"), "route_id")).alias("longest_route"),
    )


@answer("55", "chart 23")
def route_types(feed: Feed) -> DataFrame:
    """Routes by type."""
    return S.route_type_distribution(feed)


@answer("56")
def slowest_bus_route(feed: Feed) -> DataFrame:
    """Bus route with the least mean speed."""
    buses = feed.routes.filter("route_type = 3")
    return _named(_best(T.route_speeds(_of(feed, buses), "span"), "mean_kmh", least=True), feed)


@answer("57")
def most_frequent_line(feed: Feed, date: str) -> DataFrame:
    """Line with the least morning headway on a date's services."""
    running = feed.replace(trips=V.trips_of_services(feed, V.active_services(feed, date, exceptions=False)))
    lines = S.peak_headways(running).filter("headway_secs is not null")
    best = G.top_per(lines, [FEED], ["headway_secs", "route_id", "direction_id"])
    return best.withColumn("direction", C.direction_label("direction_id"))


@answer("59")
def longest_dwell(feed: Feed) -> DataFrame:
    """Route with the longest mean dwell."""
    return _named(_best(T.dwell_by_route(feed), "dwell_secs"), feed)


@answer("60")
def routes_without_transfers(feed: Feed) -> DataFrame:
    """Routes that share no stop."""
    return J.routes_without(feed, "transfers").select(*ROUTE, C.display_name().alias("name"))


@answer("61")
def multi_mode_stops(feed: Feed) -> DataFrame:
    """Stops served by several route types."""
    return J.with_stop(S.route_types_per_stop(feed).filter("n_types > 1"), feed, ["stop_name", "stop_lat", "stop_lon"])


@answer("62")
def airport_routes(feed: Feed) -> DataFrame:
    """Routes that serve an airport stop."""
    airport = feed.stops.filter(C.name_has_any("stop_name", C.AIRPORT_KEYWORDS))
    return _named(J.routes_at(feed, airport).select(*ROUTE).distinct(), feed)


@answer("63")
def transfers_from(feed: Feed, route: str) -> DataFrame:
    """Routes one can change to from a route."""
    served = J.route_stops(feed)
    return J.connections_from(served, served.join(find_route(feed, route), ROUTE, "left_semi"))


@answer("64", "chart 22")
def bus_stops_near_rail(feed: Feed, radius_m: float = 200) -> DataFrame:
    """Bus stops near a light-rail stop."""
    return P.stops_near_mode(feed, 3, 0, radius_m)


@answer("65")
def best_connected_route(feed: Feed) -> DataFrame:
    """Route with the most connections."""
    return _named(_best(J.connection_counts(J.route_stops(feed)), "connections"), feed)


@answer("66")
def accessible_trips(feed: Feed) -> DataFrame:
    """Share of trips with an accessible stop."""
    return S.accessible_trip_share(feed)


@answer("68")
def longest_dwell_on_route(feed: Feed, route: str) -> DataFrame:
    """Stop of a route with the longest mean dwell."""
    mine = _of(feed, find_route(feed, route)).trips.select(*TRIP)
    events = feed.stop_times.join(mine, TRIP, "left_semi")
    return _best(T.dwell_by_stop(feed.replace(stop_times=events)), "dwell_secs", "stop_id")


@answer("69")
def dearest_mode(feed: Feed) -> DataFrame:
    """Route type with the highest mean fare."""
    best = G.top_per(S.fare_by_route_type(feed), [FEED], [F.desc_nulls_last("mean_fare"), "route_type"])
    return best.withColumn("label", C.route_type_label("route_type"))


@answer("70")
def dearest_route(feed: Feed) -> DataFrame:
    """Route with the highest fare."""
    return _named(_best(S.fare_by_route(feed), "max_fare"), feed)


@answer("71")
def bike_share(feed: Feed) -> DataFrame:
    """Share of trips that take bikes."""
    return S.feed_shares(feed).select(FEED, "bike_trips")


@answer("72")
def accessible_stop_share(feed: Feed) -> DataFrame:
    """Share of accessible stops."""
    return S.feed_shares(feed).select(FEED, "accessible_stops")


@answer("73")
def fare_product_count(feed: Feed) -> DataFrame:
    """Distinct fare products."""
    return feed.fare_products.groupBy(FEED).agg(F.count_distinct("fare_product_id").alias("products"))


@answer("74")
def mean_fare(feed: Feed) -> DataFrame:
    """Mean fare over routes."""
    return _feed_mean(J.network_fares(feed), "amount", "mean_fare")


@answer("75")
def total_distance_on(feed: Feed, day: str = "sunday") -> DataFrame:
    """Kilometres run on a typical day."""
    return T.distance_totals(feed, day).groupBy(FEED).agg((F.sum("total_m") / 1000).alias("km"))


@answer("76")
def mean_hours_of_operation(feed: Feed, day: str = "tuesday") -> DataFrame:
    """Mean hours of operation over routes."""
    return _feed_mean(S.service_span(V.typical_feed(feed, day), wrap=True), "hours", "hours")


@answer("77")
def most_common_fare(feed: Feed) -> DataFrame:
    """Most common fare over routes."""
    return G.top_per(S.fare_frequencies(feed), [FEED], [F.desc("times"), "amount"])


@answer("78")
def stops_with_parent(feed: Feed) -> DataFrame:
    """Plain stops with and without a parent station."""
    return feed.stops.filter("location_type = 0").groupBy(FEED, F.col("parent_station").isNotNull().alias("has_parent")).agg(
        F.count("*").alias("stops")
    )


@answer("79")
def stop_pair_count(feed: Feed) -> DataFrame:
    """Distinct consecutive stop pairs."""
    return Q.stop_pairs(feed).groupBy(FEED).agg(F.count("*").alias("pairs"))


@answer("80")
def fare_types(feed: Feed) -> DataFrame:
    """Fare products by medium."""
    return S.fare_products_by_medium(feed)


@answer("81")
def weekday_trips_per_route(feed: Feed) -> DataFrame:
    """Trips per route on weekdays, summarized."""
    return T.summary(T.trip_counts(V.typical_feed(feed, C.WEEKDAYS), ["route_id"]), [FEED], "trips")


@answer("82")
def weighted_fare(feed: Feed) -> DataFrame:
    """Mean fare weighted by trips."""
    return S.trip_weighted_fare(feed)


@answer("83")
def route_with_most_stops(feed: Feed) -> DataFrame:
    """Route with the most stops."""
    return _named(_best(S.stops_per_route(J.route_stops(feed)), "stops"), feed)


@answer("84")
def bus_stop_spacing(feed: Feed) -> DataFrame:
    """Mean spacing of bus stops."""
    spacing = Q.stop_spacing(feed, 3)
    return spacing.groupBy(FEED).agg((F.sum(F.col("spacing_m") * F.col("steps")) / F.sum("steps")).alias("spacing_m"))


@answer("85")
def most_variable_route(feed: Feed) -> DataFrame:
    """Route whose travel time varies most."""
    return _named(_best(T.duration_variability(feed), "cv"), feed)


@answer("86")
def no_weekend_service(feed: Feed) -> DataFrame:
    """Routes without weekend service."""
    return J.routes_without(feed, "weekend").select(*ROUTE, C.display_name().alias("name"))


@answer("87")
def stops_near_places(feed: Feed, places: DataFrame, radius_m: float = 200, k: int = 5) -> DataFrame:
    """Nearest stops to each place of a table (gtfs_id, point_id, lat, lon)."""
    return P.stops_near(feed, places, radius_m, k=k)


@answer("89")
def mean_peak_headway(feed: Feed) -> DataFrame:
    """Mean headway in minutes over lines at peak hours of weekdays."""
    lines = Q.headways(
        V.typical_feed(feed, C.WEEKDAYS, "all"), [*ROUTE, "direction_id"], [C.MORNING_PEAK, C.EVENING_PEAK]
    )
    return lines.groupBy(FEED).agg((F.avg("mean_gap") / 60).alias("minutes"))


@answer("90")
def slow_routes(feed: Feed, below_kmh: float = 20) -> DataFrame:
    """Routes below a mean speed."""
    return T.slow_share(T.route_speeds_by_shape(feed), feed, below_kmh)


@answer("91")
def busiest_hour(feed: Feed, day: str = "wednesday") -> DataFrame:
    """Hour with the most departures on a typical day."""
    trips = V.typical_trips(feed, day).select(*TRIP)
    hours = S.departures_by_hour(feed.replace(stop_times=feed.stop_times.join(trips, TRIP, "left_semi")))
    return G.top_per(hours, [FEED], [F.desc("departures"), "hour"])


@answer("92")
def fastest_route(feed: Feed) -> DataFrame:
    """Route with the highest mean speed."""
    return _named(_best(T.route_speeds(feed), "mean_kmh"), feed)


# --- tables behind charts and maps -----------------------------------------


@answer("chart 3")
def headways_by_hour(feed: Feed, route: str) -> DataFrame:
    """Headways of a route by hour of the day."""
    starts = Q.first_departures(_of(feed, find_route(feed, route))).withColumn("hour", C.hour_of("start_secs"))
    return Q.gap_stats(starts, [*Q.LINE, "hour"], "start_secs")


@answer("chart 4", "chart 27")
def route_lines(feed: Feed, routes: DataFrame | None = None) -> DataFrame:
    """Polylines of routes as GeoJSON."""
    shapes = feed.shapes if routes is None else P.shapes_of_routes(feed, routes)
    return P.geojson(P.shape_parts(shapes))


@answer("chart 9")
def lines_after_midnight(feed: Feed) -> DataFrame:
    """Polylines of routes with departures after midnight."""
    return route_lines(feed, trips_after_midnight(feed))


@answer("chart 12")
def trip_speeds_of_route(feed: Feed, route: str) -> DataFrame:
    """Speed of each trip of a route."""
    return T.trip_speeds(_of(feed, find_route(feed, route)), "minmax")


@answer("chart 13")
def spacing_histogram(feed: Feed, limit_m: float = 3000) -> DataFrame:
    """Histogram of stop spacings up to a limit."""
    return Q.spacing_histogram(feed, limit_m)


@answer("chart 14")
def busiest_stops(feed: Feed, k: int = 5) -> DataFrame:
    """Stops with the most visits and where they are."""
    best = G.top_per(S.stop_visits(feed), [FEED], [F.desc("visits"), "stop_id"], k)
    return J.with_stop(best, feed, ["stop_name", "stop_lat", "stop_lon"])


@answer("chart 15")
def shapes_per_route(feed: Feed) -> DataFrame:
    """Distinct shapes per route."""
    return _named(S.shapes_per_route(feed), feed).withColumn("title", C.route_title())


@answer("chart 16")
def time_distance(feed: Feed, route: str, window=C.MORNING_PEAK, direction: int = 0) -> DataFrame:
    """Distance over time for a route's trips in a window."""
    mine = _of(feed, find_route(feed, route), F.col("direction_id") == direction)
    return Q.time_distance(feed, mine.trips, window)


@answer("chart 17")
def spacing_and_length(feed: Feed) -> DataFrame:
    """Mean stop spacing against mean trip length per route."""
    return T.spacing_and_length(feed)


@answer("chart 18")
def segment_speeds(feed: Feed) -> DataFrame:
    """Segment speeds by period of the day."""
    return Q.segment_speed_summary(feed)


@answer("chart 19")
def services_on(feed: Feed, date: str) -> DataFrame:
    """Services on a date and their routes."""
    return J.service_routes_on(feed, date)


@answer("chart 20")
def travel_times(feed: Feed, route: str, bins: int = 50) -> DataFrame:
    """Histogram of travel times between any two stops of a route."""
    counts = J.travel_time_counts(_of(feed, find_route(feed, route)))
    return T.histogram(counts, ROUTE, "travel_secs", bins, weight="pairs")


@answer("chart 21")
def terminal_stops(feed: Feed) -> DataFrame:
    """First and last stops of trips and where they are."""
    return J.with_stop(S.terminal_stops(feed), feed, ["stop_name", "stop_lat", "stop_lon"])


@answer("chart 24")
def trips_per_zone(feed: Feed) -> DataFrame:
    """Mean trips per hour for zones of the day."""
    return S.trips_per_hour_by_zone(feed)


@answer("chart 25")
def trips_per_weekday(feed: Feed) -> DataFrame:
    """Trips per day of week."""
    return T.trips_per_weekday(feed)


@answer("chart 5", "chart 26")
def trips_per_date(feed: Feed) -> DataFrame:
    """Trips per service date."""
    return T.trips_per_date(feed)


@answer("chart 28")
def crossing_routes(feed: Feed, route: str) -> DataFrame:
    """Routes whose line crosses a route's line."""
    return P.crossing_routes(feed, find_route(feed, route))


@answer("chart 29")
def bearings(feed: Feed) -> DataFrame:
    """Segments by compass bearing."""
    return Q.bearings(feed)


@answer("chart 30")
def durations_of_routes(feed: Feed, *routes: str) -> DataFrame:
    """Trip durations of some routes."""
    chosen = G.union_distinct(*[find_route(feed, r) for r in routes])
    return T.trip_durations(_of(feed, chosen)).withColumn("minutes", C.minutes("duration_secs"))


@answer("chart 31")
def trips_per_weekday_and_route(feed: Feed) -> DataFrame:
    """Trips per day of week and route."""
    return T.trips_per_weekday(feed, ["route_id"]).filter("trips > 0")


@answer("chart 32")
def timetable(feed: Feed, route: str, date: str, window=C.MORNING_PEAK, direction: int = 1) -> DataFrame:
    """Start and finish of a route's trips in a window of a date."""
    spans = Q.timetable_spans(feed, date, window).filter(F.col("direction_id") == direction)
    return spans.join(find_route(feed, route), ROUTE, "left_semi").orderBy("start_ts", "trip_id")


@answer("chart 33")
def spacing_along_shapes(feed: Feed) -> DataFrame:
    """Consecutive stops on their shape with their spacing class."""
    return P.spacing_along_shapes(feed)


# Charts that show the table of a plain answer.
for _chart, _plain in {
    "chart 1": "1", "chart 2": "2", "chart 6": "6", "chart 7": "7", "chart 8": "8", "chart 10": "10", "chart 11": "11",
}.items():
    ANSWERS[_chart] = ANSWERS[_plain]
