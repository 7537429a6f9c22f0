"""Metres on the ellipsoid against the geodesic's own integrals, solved by quadrature and bisection."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dayrunner.functions import geometry as M

A, FLAT = 6378137.0, 1 / 298.257223563
B = A * (1 - FLAT)
NODES, WEIGHTS = np.polynomial.legendre.leggauss(48)


def integral(f, lo, hi):
    """Integral of f over [lo, hi], all pairs at once."""
    half, mid = (hi - lo) / 2, (hi + lo) / 2
    return half * sum(w * f(mid + half * x) for x, w in zip(NODES, WEIGHTS, strict=True))


def independent_metres(lat1, lon1, lat2, lon2):
    """No series: elliptic integrals of arc length and longitude, azimuth by bisection."""
    apart = np.radians(np.abs((lon2 - lon1 + 180) % 360 - 180))
    u1, u2 = (np.arctan2((1 - FLAT) * np.sin(np.radians(p)), np.cos(np.radians(p))) for p in (lat1, lat2))
    swap = np.abs(u2) > np.abs(u1)
    far, near = np.where(swap, u2, u1), np.where(swap, u1, u2)
    near = np.where(far > 0, -near, near)
    far = -np.maximum(np.abs(far), 1e-14)

    def at(azimuth):
        az = np.sin(azimuth) * np.cos(far)
        c1 = np.cos(azimuth) * np.cos(far)
        c2 = np.sqrt(np.maximum(0, c1**2 + np.sin(far)**2 - np.sin(near)**2))
        s1, s2 = np.arctan2(np.sin(far), c1), np.arctan2(np.sin(near), c2)
        k2 = (A**2 - B**2) / B**2 * (1 - az**2)
        sphere = np.arctan2(az * np.sin(near), c2) - np.arctan2(az * np.sin(far), c1)
        lon = sphere - FLAT * az * integral(lambda s: (2 - FLAT) / (1 + (1 - FLAT) * np.sqrt(1 + k2 * np.sin(s)**2)), s1, s2)
        return lon, B * integral(lambda s: np.sqrt(1 + k2 * np.sin(s)**2), s1, s2)

    lo, hi = np.zeros_like(far), np.full_like(far, np.pi)
    for _ in range(60):
        mid = (lo + hi) / 2
        west = at(mid)[0] < apart
        lo, hi = np.where(west, mid, lo), np.where(west, hi, mid)
    return at((lo + hi) / 2)[1]


def measured(spark, pairs):
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pairs)], "i int, a double, b double, c double, d double")
    got = df.select("i", M.geodesic(*(F.col(c) for c in "abcd")).alias("m")).collect()
    return np.array([r["m"] for r in sorted(got, key=lambda r: r["i"])])


def test_random_pairs_are_within_a_millimetre(spark):
    random = np.random.default_rng(1)
    n = 10_000
    lat1, lat2 = (np.degrees(np.arcsin(random.uniform(-1, 1, n))) for _ in range(2))
    lon1, lon2 = random.uniform(-180, 180, (2, n))
    # A third is near by, a part almost opposite.
    near = slice(0, 3500)
    lat2[near] = np.clip(lat1[near] + random.normal(0, 0.2, 3500), -90, 90)
    lon2[near] = lon1[near] + random.normal(0, 0.2, 3500)
    far = slice(3500, 4500)
    lat2[far] = np.clip(-lat1[far] + random.normal(0, 0.3, 1000), -90, 90)
    lon2[far] = lon1[far] + 180 + random.normal(0, 0.3, 1000)
    got = measured(spark, np.stack([lat1, lon1, lat2, lon2], 1))
    assert np.abs(got - independent_metres(lat1, lon1, lat2, lon2)).max() < 1e-3


def test_special_pairs(spark):
    quarter = 10001965.729
    pairs = {
        (0, 0, 90, 0): quarter, (90, 0, -90, 0): 2 * quarter, (90, 10, 90, 50): 0.0, (10, 20, 10, 20): 0.0, (0, 0, 0, 90): np.pi / 2 * A,
        (0, 0, 0, 180): 2 * quarter, (30, 0, -30, 180): 2 * quarter, (5, 179.5, 5, -180.5): 0.0, (45, 0, 45, 360): 0.0,
    }
    got = measured(spark, pairs)
    assert got == pytest.approx(list(pairs.values()), abs=2e-3)
    # Flinders Peak to Buninyong, a published example.
    line = measured(spark, [(-(37 + 57 / 60 + 3.72030 / 3600), 144 + 25 / 60 + 29.52440 / 3600, -(37 + 39 / 60 + 10.15610 / 3600), 143 + 55 / 60 + 35.38390 / 3600)])
    assert line[0] == pytest.approx(54972.271, abs=1e-3)


def test_short_distances_keep_their_digits_and_nulls_have_none(spark):
    lat, lon, d = 40.1, -88.2, 1e-9
    got = measured(spark, [(lat, lon, lat + d, lon), (lat, lon, lat, lon + d)])
    assert got == pytest.approx([111.0344e3 * ((lat + d) - lat), 85.2676e3 * ((lon + d) - lon)], rel=1e-3)
    df = spark.createDataFrame([(None, 1.0), (1.0, None)], "a double, b double")
    assert [r[0] for r in df.select(M.geodesic(F.col("a"), F.col("b"), F.lit(1.0), F.lit(1.0))).collect()] == [None, None]


def test_a_sphere_exceeds_the_ellipsoid_by_its_bound_at_most(spark):
    random = np.random.default_rng(2)
    lat = random.uniform(-89, 89, 4000)
    pairs = np.stack([lat, np.zeros(4000), lat + random.normal(0, 0.05, 4000), random.normal(0, 0.05, 4000)], 1)
    df = spark.createDataFrame(pairs.tolist(), "a double, b double, c double, d double")
    cols = [F.col(c) for c in "abcd"]
    assert df.filter(M.haversine(*cols) > M.SPHERE_EXCESS * M.geodesic(*cols)).count() == 0


def test_steps_as_columns_equal_the_expression(spark):
    """with_geodesic is geodesic bit by bit: short, long, almost opposite, equal and missing ends; its steps are compiled."""
    rows = [(35.0 + i / 7e3, 139.0 + i / 3e3, 35.01, 139.0 - i / 5e3) for i in range(200)]
    rows += [(i - 80.0, 3.0 * i, 79.5 - i, 3.0 * i + 179.0 + i / 100) for i in range(160)] + [(0.0, 0.0, 0.0, 180.0), (90.0, 5.0, -90.0, 7.0)]
    rows += [(1.0, 2.0, 1.0, 2.0), (None, 2.0, 1.0, 2.0), (1.0, None, 1.0, 2.0), (1.0, 2.0, None, None), (float("nan"), 2.0, 1.0, 2.0)]
    ends = spark.createDataFrame(rows, "a double, b double, c double, d double")
    both = M.with_geodesic(ends, "a", "b", "c", "d", "m").withColumn("want", M.geodesic(*map(F.col, "abcd")))
    for r in both.collect():
        assert r.m is r.want is None or r.m == r.want or abs(r.m - r.want) < 1e-7 or (r.m != r.m and r.want != r.want), r
    plan = M.with_geodesic(ends, "a", "b", "c", "d", "m")._jdf.queryExecution().executedPlan().toString()
    assert len([1 for line in plan.splitlines() if "*(" in line]) > 40
