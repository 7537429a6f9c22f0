from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from dayrunner.plans import views as V
from dayrunner.sources import sinks, snapshots
from tests.conftest import rows
from tests.feeds import small_feed

TABLES = ("calendar", "calendar_dates")


@pytest.fixture(scope="module")
def feed(spark):
    return small_feed(spark)


@pytest.fixture
def root(spark, feed, tmp_path):
    snapshots.commit(spark, str(tmp_path), {t: feed[t] for t in TABLES})
    return str(tmp_path)


def test_one_feed_rewritten_leaves_the_others(spark, feed, root):
    mine = feed.calendar.filter("gtfs_id = 'y'").withColumn("monday", F.lit(0))
    assert snapshots.commit(spark, root, {"calendar": mine}) == 2
    want = feed.calendar.filter("gtfs_id = 'x'").unionByName(mine)
    assert rows(snapshots.load(spark, root, "calendar")) == rows(want)
    assert rows(snapshots.load(spark, root, "calendar", version=1)) == rows(feed.calendar)
    assert rows(snapshots.load(spark, root, "calendar", feeds=["y"])) == rows(mine)


def test_a_run_that_ends_early_is_not_seen(spark, feed, root, monkeypatch):
    """The second table fails after the first one's files are in place."""
    real = sinks.write_table

    def failing(df, path, *more):
        if "/calendar_dates/" in path:
            raise RuntimeError("lost")
        return real(df, path, *more)

    monkeypatch.setattr(sinks, "write_table", failing)
    with pytest.raises(RuntimeError):
        snapshots.commit(spark, root, {"calendar": feed.calendar.limit(1), "calendar_dates": feed.calendar_dates.limit(1)})
    for t in TABLES:
        assert rows(snapshots.load(spark, root, t)) == rows(feed[t])


def test_feeds_without_rows_and_empty_tables(spark, feed, root):
    gone = spark.createDataFrame([("x",)], "gtfs_id string")
    snapshots.commit(spark, root, {"calendar": feed.calendar.limit(0)}, gone)
    assert rows(snapshots.load(spark, root, "calendar")) == rows(feed.calendar.filter("gtfs_id = 'y'"))
    snapshots.commit(spark, root, {"bare": feed.calendar.limit(0)}, gone)
    assert snapshots.load(spark, root, "bare").columns == feed.calendar.columns
    assert snapshots.load(spark, root, "bare").count() == 0
    with pytest.raises(ValueError, match="no snapshot"):
        snapshots.load(spark, root, "unknown")


def test_views_are_refreshed_by_changed_feed(spark, feed, root):
    asked = []

    def build(part):
        asked.append(sorted(r.gtfs_id for r in part.calendar.select("gtfs_id").distinct().collect()))
        return V.service_days(part)

    refresh = lambda: snapshots.refresh(spark, root, "days", TABLES, build)
    assert refresh() == ["x", "y"] and refresh() == []
    # The same rows in another order are the same content.
    snapshots.commit(spark, root, {"calendar": feed.calendar.filter("gtfs_id = 'x'").orderBy(F.desc("service_id"))})
    assert refresh() == []
    changed = feed.calendar.filter("gtfs_id = 'y'").withColumn("end_date", F.date_add("end_date", 3))
    snapshots.commit(spark, root, {"calendar": changed})
    assert refresh() == ["y"] and asked == [["x", "y"], ["y"]]
    full = V.service_days(feed.replace(calendar=feed.calendar.filter("gtfs_id = 'x'").unionByName(changed)))
    assert rows(snapshots.load(spark, root, "days"), *full.columns) == rows(full)
