"""The row sums of the canonical views tell rows apart by every sign of every column."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import dayrunner.catalog.entries  # noqa: F401  (fills the registry)
from dayrunner.catalog.registry import CHECKS
from tests.feeds import small_feed


def renamed(df):
    """Trip ids of the same length and last sign."""
    return df.withColumn("trip_id", F.concat(F.lit("q"), F.substring("trip_id", 2, 9)))


@pytest.mark.parametrize("key", ["c2_stop_times_norm", "c3_departures"])
def test_row_sums_tell_other_ids(spark, key):
    feed = small_feed(spark)
    other = feed.replace(trips=renamed(feed.trips), stop_times=renamed(feed.stop_times))
    before, after = ({r["row_sum"] for r in CHECKS[key].build(f).collect()} for f in (feed, other))
    assert before and not before & after
