from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from dayrunner.operators import spatial as P
from tests.feeds import small_feed

SHAPES = ("gtfs_id string, shape_id string, shape_pt_sequence int, shape_pt_lat double, shape_pt_lon double, "
          "shape_dist_traveled double")


@pytest.fixture(scope="module")
def feed(spark):
    return small_feed(spark)


def one_line(spark, feed, line, points):
    """A feed of one trip over ``points`` on the shape ``line``, both (lon, lat)."""
    make = spark.createDataFrame
    return feed.replace(
        shapes=make([("x", "s1", i, y, x, None) for i, (x, y) in enumerate(line)], SHAPES),
        stops=make([("x", f"p{i}", y, x) for i, (x, y) in enumerate(points)], "gtfs_id string, stop_id string, stop_lat double, stop_lon double"),
        stop_times=make([("x", "t1", f"p{i}", i + 1, 0, 0, None) for i in range(len(points))], feed.stop_times.schema),
        trips=feed.trips.filter("trip_id = 't1' and gtfs_id = 'x'"),
    )


def in_order(made, reach=0.01):
    got = P.project_stops_in_order(made, P.sample_trips(made), reach).orderBy("stop_sequence").collect()
    return [r.along for r in got], {r.in_order for r in got}, [r.off for r in got]


def nearest(made, reach=0.01):
    return [round(r.along, 9) for r in P.project_stops(made, P.sample_trips(made), reach).orderBy("stop_sequence").collect()]


def test_out_and_back(spark, feed):
    line = [(0.0, 0.0), (0.01, 0.0), (0.02, 0.0), (0.01, 0.0001), (0.0, 0.0001)]
    stops = [(0.002, 0.0), (0.012, 0.0001), (0.02, 0.0), (0.012, 0.0), (0.002, 0.0)]
    made = one_line(spark, feed, line, stops)
    assert nearest(made) != sorted(nearest(made))
    along, kept, _ = in_order(made)
    assert kept == {True} and along == sorted(along)
    # The third stop turns; the last two lie on the way back.
    assert along[0] == 0.002 and along[2] == 0.02 and along[3] > 0.027 and along[4] > 0.037


def test_loop_ends_where_it_starts(spark, feed):
    line = [(0.0, 0.0), (0.004, 0.0), (0.004, 0.004), (0.0, 0.004), (0.0, 0.0)]
    stops = [(0.0, 0.0), (0.004, 0.002), (0.002, 0.004), (0.0, 0.0)]
    along, kept, off = in_order(one_line(spark, feed, line, stops))
    assert (along, kept, off) == ([0.0, 0.006, 0.01, 0.016], {True}, [0.0] * 4)
    assert nearest(one_line(spark, feed, line, stops))[3] == 0.0


def test_backward_trip_stays_at_the_nearest_places(spark, feed):
    made = one_line(spark, feed, [(0.0, 0.0), (1.0, 0.0)], [(0.9, 0.0), (0.1, 0.0)])
    along, kept, _ = in_order(made)
    assert (along, kept) == ([0.9, 0.1], {False})


def test_stops_beyond_reach_and_shapes_without_segments(spark, feed):
    made = one_line(spark, feed, [(0.0, 0.0), (1.0, 0.0)], [(0.2, 0.5), (0.4, 0.0)])
    assert in_order(made) == ([0.2, 0.4], {True}, [0.5, 0.0])
    assert in_order(one_line(spark, feed, [(0.0, 0.0)], [(0.2, 0.5)]))[0] == []


def cheapest(line, stops, reach):
    """All choices of places tried: least cost, then the smaller places from the end."""
    places, before = [[] for _ in stops], 0.0
    for (x0, y0), (x1, y1) in itertools.pairwise(line):
        size = math.hypot(x1 - x0, y1 - y0)
        for found, (x, y) in zip(places, stops, strict=True):
            t = max(0.0, min(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / size**2))
            found.append((round(before + t * size, 9), round(math.hypot(x - x0 - t * (x1 - x0), y - y0 - t * (y1 - y0)), 9)))
        before += size
    near = [sorted({p for p in found if p[1] <= reach} or {min(found, key=lambda p: (p[1], p[0]))}) for found in places]
    best = None
    for choice in itertools.product(*near):
        if all(a[0] <= b[0] for a, b in itertools.pairwise(choice)):
            rank = (round(sum(p[1] ** 2 for p in choice), 15), [p[0] for p in reversed(choice)])
            best = min(best or rank, rank)
    return best


def test_order_equals_all_choices_tried(spark, feed):
    rng = random.Random(5)
    for _ in range(4):
        line = [(rng.uniform(0, 0.02), rng.uniform(0, 0.02)) for _ in range(7)]
        stops = [(rng.uniform(0, 0.02), rng.uniform(0, 0.02)) for _ in range(5)]
        along, kept, off = in_order(one_line(spark, feed, line, stops), 0.012)
        want = cheapest(line, stops, 0.012)
        if want is None:
            assert kept == {False}
        else:
            assert kept == {True} and along == sorted(along)
            assert round(sum(o * o for o in off), 12) == round(want[0], 12)


# --- crossings ---------------------------------------------------------------


def touching(a, b):
    def turn(o, p, q):
        return (p[0] - o[0]) * (q[1] - o[1]) - (p[1] - o[1]) * (q[0] - o[0])

    (p, q), (r, s) = a, b
    boxes = all(min(p[i], q[i]) <= max(r[i], s[i]) and min(r[i], s[i]) <= max(p[i], q[i]) for i in (0, 1))
    return boxes and turn(p, q, r) * turn(p, q, s) <= 0 and turn(r, s, p) * turn(r, s, q) <= 0


def segment_feed(spark, feed, segments):
    """Every segment is a shape and a route of its own."""
    make = spark.createDataFrame
    points = [("x", f"s{i}", n, y, x, None) for i, ends in enumerate(segments) for n, (x, y) in enumerate(ends)]
    trips = [("x", f"t{i}", f"r{i}", "daily", 0, f"s{i}", None) for i in range(len(segments))]
    return feed.replace(shapes=make(points, SHAPES), trips=make(trips, feed.trips.schema))


@pytest.fixture(scope="module")
def segments():
    """Lengths from metres to tens of degrees, some touching, some without extent."""
    rng = random.Random(11)
    out = []
    for i in range(240):
        x, y, size = rng.uniform(-0.5, 0.5), rng.uniform(-0.5, 0.5), 10 ** rng.uniform(-4.5, 1.5)
        out.append(((x, y), (x + rng.uniform(-size, size), y + rng.uniform(-size, size))))
    out += [((x, y), (x, y)) for x, y in (out[0][0], out[1][1])]
    out += [(a, (a[0] + 1e-4, a[1])) for a, _ in out[:40]]
    return out


def test_crossings_of_all_lengths_equal_brute_force(spark, feed, segments):
    made = segment_feed(spark, feed, segments)
    targets = spark.createDataFrame([("x", f"r{i}") for i in range(0, len(segments), 3)], "gtfs_id string, route_id string")
    got = {(r.route_id, r.crossing_route_id) for r in P.crossing_routes(made, targets).collect()}
    want = {(f"r{i}", f"r{j}") for i in range(0, len(segments), 3) for j in range(len(segments))
            if i != j and segments[i] != segments[j] and touching(segments[i], segments[j])}
    same = {(f"r{i}", f"r{j}") for i in range(0, len(segments), 3) for j in range(len(segments)) if i != j and segments[i] == segments[j]}
    assert got == want | same and len(want) > 400


def test_a_segment_has_four_cells_at_most(spark, feed, segments):
    lines = P._levelled(P.shape_segments(segment_feed(spark, feed, segments).shapes))
    cells = P._segment_cells(lines).groupBy("shape_id").agg(F.count("*").alias("n"))
    assert cells.agg(F.max("n")).first()[0] <= 4
    every = P._segment_cells(lines, lines).groupBy("shape_id", "grid").agg(F.count("*").alias("n"))
    assert every.agg(F.max("n")).first()[0] <= 4
