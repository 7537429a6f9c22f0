from __future__ import annotations

import random
import statistics

import pytest

from dayrunner.functions.ordered import exact_median, neighbours, positions, running_total
from tests.conftest import rows


@pytest.fixture(scope="module")
def data():
    rng = random.Random(7)
    out = []
    for key in ("a", "b", "c", "d"):
        n = {"a": 60, "b": 1, "c": 7, "d": 25}[key]
        for seq in sorted(rng.sample(range(200), n)):
            out.append((key, seq, rng.randint(0, 30)))
    return out


@pytest.mark.parametrize("width", [1, 5, 16, 1000])
def test_neighbours_equal_one_window(spark, data, width):
    df = spark.createDataFrame(data, "k string, seq int, v int")
    got = rows(neighbours(df, ["k"], "seq", prev={"p": "v"}, next={"n": "v"}, width=width), "k", "seq", "p", "n")
    want = []
    for key in {r[0] for r in data}:
        mine = [r for r in data if r[0] == key]
        for i, r in enumerate(mine):
            want.append((key, r[1], mine[i - 1][2] if i else None, mine[i + 1][2] if i + 1 < len(mine) else None))
    assert got == sorted(want, key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("width", [1, 5, 1000])
def test_positions_and_totals(spark, data, width):
    df = spark.createDataFrame(data, "k string, seq int, v int")
    ranked = {(r.k, r.seq): r.position for r in positions(df, ["k"], "seq", width=width).collect()}
    sums = {(r.k, r.seq): r.s for r in running_total(df, ["k"], "seq", "v", "s", width=width).collect()}
    for key in {r[0] for r in data}:
        total = 0
        for i, r in enumerate([r for r in data if r[0] == key], start=1):
            total += r[2]
            assert ranked[key, r[1]] == i
            assert sums[key, r[1]] == total


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 50, 51, 1000, 3001])
def test_exact_median(spark, n):
    rng = random.Random(n)
    values = {"even": [rng.randint(0, 9) for _ in range(n)], "wide": [rng.random() ** 9 * 1e6 for _ in range(n)]}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    got = {r.k: r.median for r in exact_median(df, ["k"], "v").collect()}
    assert got == {k: statistics.median(vs) for k, vs in values.items()}
