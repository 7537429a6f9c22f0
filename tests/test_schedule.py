from __future__ import annotations

import datetime
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayrunner.operators import joins as J
from dayrunner.operators import sequences as Q
from dayrunner.operators import service as S
from dayrunner.operators import spatial as P
from dayrunner.operators import trips as T
from dayrunner.plans import views as V
from tests.conftest import rows
from tests.feeds import small_feed
from tests.test_geodesic import independent_metres

D = datetime.date


@pytest.fixture(scope="module")
def feed(spark):
    return small_feed(spark)


def test_service_days(feed):
    got = rows(V.service_days(feed))
    daily = [("x", "daily", D(2024, 1, d)) for d in (1, 2, 4, 5, 6, 7, 9)]
    weekend = [("x", "weekend", D(2024, 1, d)) for d in (6, 7, 13, 14)]
    rest = [("x", "extra", D(2024, 1, 5)), ("y", "daily", D(2024, 1, 1)), ("y", "daily", D(2024, 1, 2))]
    assert got == sorted(daily + weekend + rest, key=lambda r: tuple((False, str(x)) for x in r))


def test_normalized_rows_count_and_midnight(feed):
    norm = V.stop_times_norm(feed)
    assert norm.count() == 3 * 7 + 2 * 4 + 2 * 7 + 1 * 2
    late = norm.filter("trip_id = 't1' and gtfs_id = 'x' and stop_id = 'c' and service_date = '2024-01-01'").first()
    assert (str(late.departure_ts), late.departure_day_offset) == ("2024-01-02 01:00:10", 1)


def test_trip_starts_use_least_sequence(feed):
    got = {(r.gtfs_id, r.trip_id): (r.start_stop_id, r.start_secs) for r in V.trip_starts(feed.stop_times).collect()}
    assert got["x", "t1"] == ("a", 110)
    assert got["x", "t2"] == ("c", 200)


def test_trips_per_date_equal_the_join(feed):
    joined = feed.trips.join(V.service_days(feed), V.SERVICE).groupBy("gtfs_id", "service_date").agg(F.count("*").alias("trips"))
    assert rows(T.trips_per_date(feed), "gtfs_id", "service_date", "trips") == rows(joined, "gtfs_id", "service_date", "trips")


def test_shared_removals(feed):
    days = {r.gtfs_id: r.days for r in T.service_day_totals(feed).collect()}
    strict = {r.gtfs_id: r.days for r in T.service_day_totals(feed, shared_removals=True).collect()}
    assert days["x"] == 9 and strict["x"] == 9 and days["y"] == 2


def test_null_pattern_keys_stay(feed):
    got = rows(V.route_patterns(feed), "gtfs_id", "route_id", "shape_id", "trip_count")
    assert ("x", "r2", None, 2) in got


def test_anti_joins(feed):
    names = lambda what: {(r.gtfs_id, r.route_id) for r in J.routes_without(feed, what).collect()}
    assert names("trips") == {("x", "r3")}
    assert names("weekend") == {("x", "r3")}
    # No stop of this feed is served by two routes.
    assert names("transfers") == {("x", "r1"), ("x", "r2"), ("x", "r3"), ("y", "r1")}


def test_speed_ignores_zero_seconds(feed):
    kmh = {(r.gtfs_id, r.trip_id): r.kmh for r in T.trip_speeds(feed).collect()}
    assert kmh["x", "t1"] == pytest.approx(5000 / 89900 * 3.6)
    assert kmh["y", "t1"] is None and kmh["x", "t2"] is None


def test_connections_equal_brute_force(spark):
    served = [("f", f"r{i}", f"s{j}") for i in range(12) for j in range(9) if (i * j + i) % 5 == 0]
    served += [("g", "r1", "s1"), ("g", "r2", "s2")]
    df = spark.createDataFrame(served, "gtfs_id string, route_id string, stop_id string")
    want = {
        (a[0], a[1], b[1]) for a, b in itertools.product(served, served)
        if a[0] == b[0] and a[2] == b[2] and a[1] != b[1]
    }
    assert set(rows(J.connections(df))) == want
    counts = {(r.gtfs_id, r.route_id): r.connections for r in J.connection_counts(df).collect()}
    for feed_id, route, _ in served:
        assert counts[feed_id, route] == len({w for w in want if w[:2] == (feed_id, route)})


def test_travel_times_equal_brute_force(spark, feed):
    trips = [("f", f"t{i}", f"r{i % 2}") for i in range(6)]
    times = [("f", f"t{i}", n, 1000 * i + n * 60 + (n * i) % 3) for i in range(6) for n in range(8)]
    made = feed.replace(
        trips=spark.createDataFrame(trips, "gtfs_id string, trip_id string, route_id string"),
        stop_times=spark.createDataFrame(times, "gtfs_id string, trip_id string, stop_sequence int, arrival_secs int"),
    )
    want = {}
    for t, route in ((t[1], t[2]) for t in trips):
        mine = [x[3] for x in times if x[1] == t]
        for a, b in itertools.combinations(mine, 2):
            want[route, b - a] = want.get((route, b - a), 0) + 1
    got = {(r.route_id, r.travel_secs): r.pairs for r in J.travel_time_counts(made).collect()}
    assert got == want


def test_gaps_with_equal_departures(spark):
    events = spark.createDataFrame([("a", 10), ("a", 10), ("a", 40), ("b", 5)], "k string, s int")
    got = {r.k: (r.events, r.mean_gap, r.least_gap, r.most_gap) for r in Q.gap_stats(events, ["k"], "s").collect()}
    assert got == {"a": (3, 15.0, 0, 30), "b": (1, None, None, None)}


def test_stop_spacing_falls_back_to_straight_line(feed):
    only = feed.replace(routes=feed.routes.withColumn("route_type", F.lit(3)))
    got = {(r.gtfs_id, r.route_id): r.spacing_m for r in Q.stop_spacing(only).collect()}
    straight = 91.1  # c to a: a thousandth of a degree of longitude at 35 degrees north
    assert got["x", "r1"] == pytest.approx((1000 + 4000 + straight) / 3, abs=1)


def test_spikes(feed):
    got = Q.spike_counts(feed).first()
    assert (got.spikes, got.points) == (1, 3)


def test_sequences_of_any_length(spark, feed):
    trips = [("f", "t1", "r1"), ("f", "t2", "r2"), ("f", "t3", "r2")]
    paths = {"t1": "abcde", "t2": "xbcdy", "t3": "bcd"}
    times = [("f", t, s, n) for t, path in paths.items() for n, s in enumerate(path)]
    made = feed.replace(
        trips=spark.createDataFrame(trips, "gtfs_id string, trip_id string, route_id string"),
        stop_times=spark.createDataFrame(times, "gtfs_id string, trip_id string, stop_id string, stop_sequence int"),
    )
    assert rows(Q.shared_sequences(made, 2), "gram", "routes") == [("b > c", 2), ("c > d", 2)]
    assert [(r.gram, r.n) for r in Q.longest_shared_sequences(made).collect()] == [("b > c > d", 3)]
    long = [f"s{k}" for k in range(77)]
    times = [("f", t, s, n) for t, path in {"t1": ["a", *long, "b"], "t2": ["c", "c", *long]}.items() for n, s in enumerate(path)]
    made = made.replace(stop_times=spark.createDataFrame(times, "gtfs_id string, trip_id string, stop_id string, stop_sequence int"))
    assert [(r.gram, r.routes, r.n) for r in Q.longest_shared_sequences(made).collect()] == [(" > ".join(long), 2, 77)]
    alone = made.replace(trips=made.trips.filter("trip_id = 't1'"))
    assert Q.longest_shared_sequences(alone).count() == 0


def test_travel_times_follow_the_stop_order(spark, feed):
    times = [("f", "t1", n, s) for n, s in enumerate([100, 160, 130, 250])] + [("f", "t2", 10 * n, s) for n, s in enumerate([0, 60, 30, 150])]
    made = feed.replace(
        trips=spark.createDataFrame([("f", "t1", "r"), ("f", "t2", "r")], "gtfs_id string, trip_id string, route_id string"),
        stop_times=spark.createDataFrame(times, "gtfs_id string, trip_id string, stop_sequence int, arrival_secs int"),
    )
    counts = {r.travel_secs: r.pairs for r in J.travel_time_counts(made).collect()}
    assert counts == {60: 2, 30: 2, 150: 2, 90: 2, 120: 2}


def test_patterns_ignore_sequence_numbers(spark, feed):
    trips = [("f", "t1", "r1"), ("f", "t2", "r1"), ("f", "t3", "r1")]
    times = [("f", "t1", "a", 1), ("f", "t1", "b", 2), ("f", "t2", "a", 10), ("f", "t2", "b", 30), ("f", "t3", "b", 1), ("f", "t3", "a", 2)]
    made = feed.replace(
        trips=spark.createDataFrame(trips, "gtfs_id string, trip_id string, route_id string"),
        stop_times=spark.createDataFrame(times, "gtfs_id string, trip_id string, stop_id string, stop_sequence int"),
    )
    assert S.patterns_per_route(made).first().patterns == 2


def test_vehicles_fall_back_to_trips(feed):
    got = {r.gtfs_id: r.vehicles for r in S.vehicles(feed.trips).collect()}
    assert got == {"x": 1, "y": 1}


def test_nearness_equals_brute_force(spark):
    points = [(lat + i * 0.0007 % 0.01, 10 + (i * 0.0013) % 0.012) for lat in (-60.0, -0.002, 45.0, 80.0) for i in range(25)]
    df = spark.createDataFrame([("f", *p) for p in points], "gtfs_id string, lat double, lon double")
    got = {(r.lat, r.lon, r.other_lat, r.other_lon) for r in P.near_places(df, df, 400).collect()}
    pairs = np.array([(*a, *b) for a in points for b in points])
    metres = np.where((pairs[:, :2] == pairs[:, 2:]).all(1), 0, independent_metres(*pairs.T))
    want = {tuple(p) for p in pairs[metres <= 400].tolist()}
    assert got == want


def test_direct_trips(spark, feed):
    ask = [("q1", "x", "a", "b", D(2024, 1, 1), 100), ("q2", "x", "b", "a", D(2024, 1, 1), 100), ("q3", "x", "a", "b", D(2024, 1, 3), 100),
           ("q4", "y", "a", "b", D(2024, 1, 1), 0)]
    requests = spark.createDataFrame(ask, "request_id string, gtfs_id string, from_stop string, to_stop string, service_date date, now_secs int")
    got = rows(J.direct_trips(feed, requests), "request_id", "trip_id", "start_secs", "travel_secs")
    assert got == [("q1", "t1", 110, 310)]


def test_projection_on_a_line(spark, feed):
    shapes = spark.createDataFrame(
        [("x", "s1", 1, 0.0, 0.0, None), ("x", "s1", 2, 0.0, 1.0, None), ("x", "s1", 3, 1.0, 1.0, None)],
        "gtfs_id string, shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double, shape_dist_traveled double",
    )
    stops = spark.createDataFrame(
        [("x", "a", 0.001, 0.25), ("x", "b", 0.5, 1.2), ("x", "c", 1.5, 1.0)], "gtfs_id string, stop_id string, stop_lat double, stop_lon double"
    )
    made = feed.replace(shapes=shapes, stops=stops, trips=feed.trips.filter("trip_id = 't1' and gtfs_id = 'x'"))
    got = {r.stop_id: (round(r.along, 6), round(r.off, 6)) for r in P.project_stops(made, P.sample_trips(made)).collect()}
    assert got == {"a": (0.25, 0.001), "b": (1.5, 0.2), "c": (2.0, 0.5)}


def test_shape_parts_cover_every_point(feed):
    parts = P.shape_parts(feed.shapes, part_points=2)
    assert [(r.part, [p.seq for p in r.points]) for r in parts.orderBy("part").collect()] == [(0, [1]), (1, [2, 3])]
