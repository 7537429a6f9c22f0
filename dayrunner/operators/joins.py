"""Joins between schedule tables.

No side is ever forced to be broadcast: Spark broadcasts what its own size
check allows and AQE splits hot keys of the joins that shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayrunner.feed import Feed
from dayrunner.functions import columns as C
from dayrunner.plans import views as V
from dayrunner.plans.views import FEED, ROUTE, SERVICE, STOP, TRIP
from dayrunner.session import written


def trip_events(feed: Feed, event_cols: Sequence[str], trip_cols: Sequence[str]) -> DataFrame:
    """Stop events with columns of their trip."""
    return feed.stop_times.select(*TRIP, *event_cols).join(feed.trips.select(*TRIP, *trip_cols), TRIP)


def with_route(df: DataFrame, feed: Feed, cols: Sequence[str], how: str = "left") -> DataFrame:
    return df.join(feed.routes.select(*ROUTE, *cols), ROUTE, how)


def with_stop(df: DataFrame, feed: Feed, cols: Sequence[str], how: str = "left") -> DataFrame:
    return df.join(feed.stops.select(*STOP, *cols), STOP, how)


def route_stops(feed: Feed, trips: DataFrame | None = None) -> DataFrame:
    """Distinct stops per route.

    Stop events are reduced to distinct (trip, stop) by the partial side of the
    final distinct; only two key columns travel.
    """
    trips = feed.trips if trips is None else trips
    return (
        feed.stop_times.select(*TRIP, "stop_id")
        .join(trips.select(*TRIP, "route_id"), TRIP)
        .select(*ROUTE, "stop_id")
        .distinct()
    )


def routes_at(feed: Feed, stops: DataFrame, days: Sequence[str] | str | None = None, mode: str = "any") -> DataFrame:
    """Distinct (stop, route) for the given stops, optionally on given days."""
    trips = feed.trips if days is None else V.typical_trips(feed, days, mode)
    return (
        feed.stop_times.select(*TRIP, "stop_id")
        .join(stops.select(*STOP), STOP, "left_semi")
        .join(trips.select(*TRIP, "route_id"), TRIP)
        .select(*STOP, "route_id")
        .distinct()
    )


def transfer_points(feed: Feed, pairs: DataFrame) -> DataFrame:
    """Stops both routes of each pair serve; ``pairs`` is (gtfs_id, route_a, route_b)."""
    served = route_stops(feed)
    side = lambda name: (
        pairs.join(served.withColumnRenamed("route_id", name), [FEED, name]).select(*pairs.columns, "stop_id")
    )
    return side("route_a").intersect(side("route_b"))


def routes_without(feed: Feed, what: str) -> DataFrame:
    """Routes that lack ``trips``, ``stop_times``, ``fares``, ``weekend`` service
    or ``transfers`` (stops shared with another route)."""
    if what == "trips":
        having = feed.trips
    elif what == "stop_times":
        having = feed.trips.join(feed.stop_times.select(*TRIP).distinct(), TRIP, "left_semi")
    elif what == "fares":
        having = feed.fare_rules
    elif what == "weekend":
        having = V.typical_trips(feed, C.WEEKEND)
    elif what == "transfers":
        served = route_stops(feed)
        shared = served.groupBy(*STOP).agg(F.count("*").alias("n")).filter("n > 1")
        having = served.join(shared, STOP, "left_semi")
    else:
        raise ValueError(f"unknown criterion {what!r}")
    return feed.routes.join(having.select(*ROUTE).distinct(), ROUTE, "left_anti")


# --- route connectivity ----------------------------------------------------

# Routes that one number tells by its bits.
WORD = 32

def _telling_stops(served: DataFrame) -> DataFrame:
    """(route, stop) of one stop for every set of routes that share a stop.

    Stops that the same routes serve connect the same routes, so one of them
    tells all. Two 64-bit sums and the size identify a set.
    """
    h = F.xxhash64("route_id")
    sets = served.groupBy(*STOP).agg(
        F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("h1"), F.sum(F.shiftrightunsigned(h, 32)).alias("h2"), F.count("*").alias("n"))
    chosen = sets.groupBy(FEED, "h1", "h2", "n").agg(F.min("stop_id").alias("stop_id"))
    return served.join(chosen.select(*STOP), STOP, "left_semi")


def connections(served: DataFrame) -> DataFrame:
    """All (route, connected route) pairs, each exactly once per direction.

    Routes are numbered; a stop holds its routes as the bits of numbers of WORD bits. The
    bits of a route's stops are put together, so pairs are first formed when each is
    found: a stop of many routes costs a row for each route and word, not for each pair.
    """
    known = served.filter(" and ".join(f"{c} is not null" for c in (*ROUTE, "stop_id")))
    telling = written(_telling_stops(known))
    numbers = written(
        telling.select(*ROUTE).distinct().orderBy(*ROUTE).select(*ROUTE, F.monotonically_increasing_id().alias("no")))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("no") % WORD).cast("int"))
    word = F.floor(F.col("no") / WORD).alias("word")
    bits = telling.join(numbers, ROUTE).groupBy(*STOP, word).agg(F.bit_or(bit).alias("bits"))
    met = telling.join(bits, STOP).groupBy(*ROUTE, "word").agg(F.bit_or("bits").alias("bits"))
    places = F.explode(F.sequence(F.lit(0), F.lit(WORD - 1)))
    pairs = (
        met.withColumn("_bit", places).filter(F.expr("shiftright(bits, _bit) & 1 = 1"))
        .select(*ROUTE, (F.col("word") * WORD + F.col("_bit")).alias("no"))
    )
    others = numbers.select("no", F.col("route_id").alias("connected_route_id"))
    return pairs.join(others, "no").filter("route_id <> connected_route_id").select(*ROUTE, "connected_route_id")


def connection_counts(served: DataFrame) -> DataFrame:
    """Number of other routes that share a stop with each route."""
    found = connections(served).groupBy(*ROUTE).agg(F.count("*").alias("connections"))
    return served.select(*ROUTE).distinct().join(found, ROUTE, "left").select(
        *ROUTE, F.coalesce("connections", F.lit(0).cast("bigint")).alias("connections"))


def connections_from(served: DataFrame, chosen: DataFrame) -> DataFrame:
    """Other routes at the stops of some routes; ``chosen`` is their part of ``served``."""
    origin = chosen.select(FEED, "stop_id", F.col("route_id").alias("from_route_id"))
    return (
        served.join(origin, STOP)
        .filter("route_id <> from_route_id")
        .select(FEED, "from_route_id", "route_id")
        .distinct()
    )


# --- trips between places --------------------------------------------------


def trips_serving_both(feed: Feed, stops_a: DataFrame, stops_b: DataFrame) -> DataFrame:
    """Trips with a stop in both sets, with the sequence bounds of each side."""
    flagged = (
        stops_a.select(*STOP, F.lit(True).alias("in_a"), F.lit(False).alias("in_b"))
        .unionByName(stops_b.select(*STOP, F.lit(False).alias("in_a"), F.lit(True).alias("in_b")))
        .groupBy(*STOP).agg(F.bool_or("in_a").alias("in_a"), F.bool_or("in_b").alias("in_b"))
    )
    return (
        feed.stop_times.select(*TRIP, "stop_id", "stop_sequence")
        .join(flagged, STOP)
        .groupBy(*TRIP)
        .agg(
            F.min(F.when(F.col("in_a"), F.col("stop_sequence"))).alias("first_a"),
            F.max(F.when(F.col("in_b"), F.col("stop_sequence"))).alias("last_b"),
        )
        .filter("first_a is not null and last_b is not null")
    )


def direct_trips(feed: Feed, requests: DataFrame, within_secs: int = 3600) -> DataFrame:
    """Rides without transfer for a table of requests.

    ``requests``: (request_id, gtfs_id, from_stop, to_stop, service_date, now_secs).
    Both ends depart within ``within_secs`` after ``now_secs``, on a service
    that runs on the date.
    """
    events = feed.stop_times.select(*TRIP, "stop_id", "stop_sequence", "departure_secs")
    in_window = F.col("departure_secs").between(F.col("now_secs") + 1, F.col("now_secs") + within_secs)
    leave = (
        events.join(requests.withColumnRenamed("from_stop", "stop_id"), STOP)
        .filter(in_window)
        .select(
            *TRIP, "request_id", "service_date", "now_secs", "to_stop",
            F.col("stop_id").alias("from_stop"),
            F.col("stop_sequence").alias("from_seq"),
            F.col("departure_secs").alias("start_secs"),
        )
    )
    rides = (
        leave.withColumnRenamed("to_stop", "stop_id")
        .join(events, [*TRIP, "stop_id"])
        .filter(in_window & (F.col("stop_sequence") > F.col("from_seq")))
        .join(feed.trips.select(*TRIP, "route_id", "service_id"), TRIP)
    )
    return rides.join(V.service_days(feed), [*SERVICE, "service_date"], "left_semi").select(
        "request_id", *TRIP, "route_id", "from_stop", F.col("stop_id").alias("to_stop"),
        "start_secs", F.col("departure_secs").alias("end_secs"),
        (F.col("departure_secs") - F.col("start_secs")).alias("travel_secs"),
    )


def travel_time_counts(feed: Feed) -> DataFrame:
    """How often each travel time occurs between two stops of one trip, by route.

    A pair is an earlier and a later stop in stop order with a later arrival;
    times that run backwards on the way only drop their own pairs. Trips with
    the same order and running times are collapsed to one profile first (two
    64-bit sums identify a profile), so pairs are formed once per profile.
    """
    timed = feed.stop_times.filter("arrival_secs is not null").select(*TRIP, "stop_sequence", "arrival_secs")
    start = timed.groupBy(*TRIP).agg(F.min("arrival_secs").alias("start"), F.min("stop_sequence").alias("first"))
    ticks = timed.join(start, TRIP).select(
        *TRIP, (F.col("stop_sequence") - F.col("first")).alias("place"), (F.col("arrival_secs") - F.col("start")).alias("sec"))
    h = F.xxhash64("place", "sec")
    profiles = (
        ticks.groupBy(*TRIP)
        .agg(
            F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("h1"),
            F.sum(F.shiftrightunsigned(h, 32)).alias("h2"),
            F.count("*").alias("h3"),
        )
        .join(feed.trips.select(*TRIP, "route_id"), TRIP)
        .groupBy(*ROUTE, "h1", "h2", "h3")
        .agg(F.count("*").alias("trips"), F.min("trip_id").alias("trip_id"))
        .select(*TRIP, "route_id", "trips")
    )
    chosen = ticks.join(profiles, TRIP)
    later = ticks.select(*TRIP, F.col("place").alias("place_b"), F.col("sec").alias("sec_b"))
    return (
        chosen.join(later, TRIP)
        .filter("place_b > place and sec_b > sec")
        .groupBy(*ROUTE, (F.col("sec_b") - F.col("sec")).cast("bigint").alias("travel_secs"))
        .agg(F.sum("trips").alias("pairs"))
    )


def travel_time_stats(counts: DataFrame) -> DataFrame:
    """Count, total, extremes and exact median of counted travel times per route.

    The median keeps one count per distinct second of travel, which a service
    day bounds.
    """
    return counts.groupBy(*ROUTE).agg(
        F.sum("pairs").alias("pairs"), F.sum(F.col("pairs") * F.col("travel_secs")).alias("total_secs"),
        F.min("travel_secs").alias("least"), F.max("travel_secs").alias("most"),
        F.percentile("travel_secs", 0.5, F.col("pairs")).alias("median_secs"),
    )


# --- fares -----------------------------------------------------------------


def route_fares(feed: Feed) -> DataFrame:
    """Fare rules with their price (fare attributes)."""
    return feed.fare_rules.select(FEED, "fare_id", "route_id").join(
        feed.fare_attributes.select(FEED, "fare_id", "price", "currency_type"), [FEED, "fare_id"], "left"
    )


def network_fares(feed: Feed) -> DataFrame:
    """Routes, leg rules of their network, products and media."""
    return (
        feed.routes.filter("network_id is not null")
        .select(*ROUTE, "route_type", "route_short_name", "route_long_name", "network_id")
        .join(feed.fare_leg_rules.select(FEED, "network_id", "fare_product_id"), [FEED, "network_id"])
        .join(
            feed.fare_products.select(FEED, "fare_product_id", "fare_product_name", "fare_media_id", "amount"),
            [FEED, "fare_product_id"], "left",
        )
        .join(feed.fare_media.select(FEED, "fare_media_id", "fare_media_name", "fare_media_type"),
              [FEED, "fare_media_id"], "left")
    )


def product_media(feed: Feed) -> DataFrame:
    """Fare products with their medium."""
    return feed.fare_products.join(
        feed.fare_media.select(FEED, "fare_media_id", "fare_media_name", "fare_media_type"),
        [FEED, "fare_media_id"], "left",
    )


def service_routes_on(feed: Feed, date: str) -> DataFrame:
    """Services that run on a date and the routes each of them serves.

    The route list holds distinct route ids, reduced before they are gathered.
    """
    served = V.trips_of_services(feed, V.active_services(feed, date)).select(*SERVICE, "route_id").distinct()
    return served.groupBy(*SERVICE).agg(
        F.count("*").alias("routes"),
        F.array_join(F.sort_array(F.collect_list("route_id")), ", ").alias("route_ids"),
    )
