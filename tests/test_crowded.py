"""Radius searches where most points lie in one grid cell."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from dayrunner.functions import geometry as M
from dayrunner.operators import spatial as P
from tests.conftest import rows

RADIUS = 200


def metres(a, b):
    """Great-circle distance on the sphere, within 0.6 % of the ellipsoid's."""
    (y1, x1), (y2, x2) = (tuple(map(math.radians, p)) for p in (a, b))
    h = math.sin((y2 - y1) / 2) ** 2 + math.cos(y1) * math.cos(y2) * math.sin((x2 - x1) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(h))


def points(seed, total=500):
    """Half in one cell, a part of those within a millimetre; the rest over a few kilometres."""
    r = random.Random(seed)
    out = {(60.0005 + r.uniform(0, 0.0004), 20.0005 + r.uniform(0, 0.0008)) for _ in range(total // 2 - 100)}
    out |= {(60.0007 + r.uniform(0, 1e-8), 20.0009 + r.uniform(0, 1e-8)) for _ in range(100)}
    out |= {(60 + r.uniform(-0.02, 0.02), 20 + r.uniform(-0.04, 0.04)) for _ in range(total // 2)}
    return sorted(out) + [(None, 20.0)]


@pytest.fixture(scope="module")
def sides(spark):
    schema = "gtfs_id string, lat double, lon double"
    return [spark.createDataFrame([("x", *p) for p in points(seed)] + [("y", 60.0007, 20.0009)], schema) for seed in (1, 2)]


@pytest.fixture
def small_leaves(monkeypatch):
    monkeypatch.setattr(P, "LEAF_POINTS", 32)


def test_pairs_of_a_crowded_cell_equal_those_of_plain_cells(sides, monkeypatch):
    columns = ["gtfs_id", "lat", "lon", "other_lat", "other_lon"]
    monkeypatch.setattr(P, "LEAF_POINTS", 10 ** 9)
    plain = rows(P.near_places(*sides, RADIUS), *columns)
    monkeypatch.setattr(P, "LEAF_POINTS", 32)
    split = rows(P.near_places(*sides, RADIUS), *columns)
    assert split == plain and len(set(split)) == len(split)
    # Sphere and ellipsoid may differ on pairs near the radius alone.
    found = {s[1:] for s in split if s[0] == "x"}
    lefts, rights = ([p for p in points(seed) if p[0] is not None] for seed in (1, 2))
    for a in lefts[::7]:
        for b in rights:
            far = metres(a, b)
            if abs(far - RADIUS) > 0.01 * RADIUS:
                assert ((*a, *b) in found) == (far < RADIUS), (a, b)


def test_no_key_holds_a_tenth_of_the_points(sides, small_leaves):
    left, right, keys = P._meeting(sides[0], sides[1].toDF("gtfs_id", "other_lat", "other_lon"), RADIUS * M.SPHERE_EXCESS)
    for side, most in ((left, 50), (right, 33)):
        assert side.groupBy(*keys).count().agg(F.max("count")).first()[0] <= most
    assert right.select("other_lat", "other_lon").distinct().count() == sides[1].count()
    assert left.filter("_level > 0").agg(F.max("_salt")).first()[0] > 0
