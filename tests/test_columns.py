from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from dayrunner.functions import columns as C


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column("x").alias("y")).first().y


@pytest.mark.parametrize("text, want", [
    ("25:35:00", 92100), ("8:05:00", 29100), (" 08:05:09 ", 29109), ("", None), ("ab:cd:ef", None),
    ("08:61:00", None), ("08:05", None), (None, None), ("00:00:00", 0),
])
def test_hms_to_seconds(spark, text, want):
    assert one(spark, text, C.hms_to_seconds) == want


@pytest.mark.parametrize("text, want", [("", None), (" 7 ", 7), ("1.5", 2), ("-2.5", -3), ("x", None), ("-3", -3)])
def test_try_int(spark, text, want):
    assert one(spark, text, C.try_int) == want


def test_try_int_rounding(spark):
    assert one(spark, "1.5", lambda c: C.try_int(c, round_fractions=True)) == 2
    assert one(spark, "", lambda c: C.try_int(c, round_fractions=True)) is None


@pytest.mark.parametrize("text, want", [
    ("20240131", datetime.date(2024, 1, 31)), ("2024-13", None), ("", None), ("20240231", None),
])
def test_dates(spark, text, want):
    assert one(spark, text, C.try_yyyymmdd) == want


@pytest.mark.parametrize("secs, want", [
    (29109, "08:05:09"), (86400, "00:00:00 (next day)"), (92100, "01:35:00 (next day)"), (180000, "02:00:00 (2 days later)"),
])
def test_clock_text(spark, secs, want):
    assert spark.range(1).select(C.clock_text(F.lit(secs)).alias("y")).first().y == want


def test_round_trip_of_times(spark):
    df = spark.range(0, 200000, 777).select(F.col("id").cast("int").alias("s"))
    back = df.select("s", C.hms_to_seconds(C.seconds_to_hms("s")).alias("t"))
    assert back.filter("s <> t or t is null").count() == 0


@pytest.mark.parametrize("path, want", [
    ("gtfs/abc/latest/_extracted/stops.txt", "abc"), ("s3://bucket/stable/gtfs/x_y/stops.txt", "x_y"),
    ("s3://bucket/sandbox/rail/stops.csv", "rail"), ("elsewhere/abc/stops.txt", ""),
])
def test_feed_id(spark, path, want):
    assert one(spark, path, C.feed_id_from_path) == want


def test_null_ids_stay_null(spark):
    df = spark.createDataFrame([("f", "1"), ("f", None)], "gtfs_id string, id string")
    assert [r.k for r in df.select(C.namespaced("gtfs_id", "id").alias("k")).collect()] == ["f1", None]


def test_windows(spark):
    df = spark.createDataFrame([(x,) for x in (10, 15, 20, 25)], "s int")
    pick = lambda closed: [r.s for r in df.filter(C.in_windows("s", [(10, 20)], closed)).collect()]
    assert pick("both") == [10, 15, 20]
    assert pick("left") == [10, 15]
    assert pick("right") == [15, 20]


def test_day_sets(spark):
    flags = {"weekend": (0, 0, 0, 0, 0, 1, 1), "daily": (1,) * 7, "sunday": (0,) * 6 + (1,), "none": (0,) * 7}
    df = spark.createDataFrame([(k, *v) for k, v in flags.items()], "name string, " + ", ".join(f"{d} int" for d in C.DAYS))
    names = lambda c: {r.name for r in df.filter(c).collect()}
    assert names(C.runs_on(C.WEEKEND)) == {"weekend", "daily", "sunday"}
    assert names(C.runs_on(C.WEEKEND, "only")) == {"weekend", "sunday"}
    assert names(C.runs_on(C.DAYS, "all")) == {"daily"}
    with pytest.raises(ValueError):
        C.runs_on("monday", "some")


def test_labels_and_bins(spark):
    df = spark.createDataFrame([(3, 50.0), (99, 50.5), (None, 5000.0), (0, 0.0)], "t int, m double")
    got = df.select(C.route_type_label("t").alias("a"), C.bin_label("m", C.SPACING_EDGES, C.SPACING_LABELS).alias("b")).collect()
    assert [r.a for r in got] == ["Bus", "Route Type 99", None, "Light Rail"]
    assert [r.b for r in got] == ["0-50m", "50-100m", ">2km", None]


def test_hours_and_periods(spark):
    df = spark.createDataFrame([(90000,), (6 * 3600,), (9 * 3600,), (18 * 3600 + 59,), (19 * 3600,)], "s int")
    got = df.select(C.hour_of("s").alias("h"), C.hour_of("s", fold=True).alias("f"), C.day_period("s").alias("p")).collect()
    assert [(r.h, r.f) for r in got][:1] == [(25, 1)]
    assert [r.p for r in got] == ["Night", "Morning Peak", "Midday", "Evening Peak", "Night"]


def test_timestamp_after_midnight(spark):
    df = spark.createDataFrame([(datetime.date(2024, 3, 30), 92100)], "d date, s int")
    got = df.select(C.service_timestamp("d", "s").cast("string").alias("t"), C.day_offset("s").alias("o")).first()
    assert (got.t, got.o) == ("2024-03-31 01:35:00", 1)
