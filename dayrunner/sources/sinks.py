"""Writing tables for later jobs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from dayrunner.feed import Feed


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("gtfs_id",)) -> str:
    """Parquet partitioned by feed.

    The rebalance hint gathers small feeds into few files and splits a huge
    feed over many tasks.
    """
    df.hint("rebalance", *partition_by).write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def write_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int) -> str:
    """Catalog table bucketed and sorted by ``keys``, so that later joins and
    windows on them need no shuffle (e.g. stop_times and trips by trip)."""
    df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return name


def write_feed(feed: Feed, root: str, tables: Iterable[str] | None = None) -> str:
    for table in tables or feed:
        write_table(feed.complete(table), f"{root}/{table}")
    return root


def load_feed(spark: SparkSession, root: str, tables: Iterable[str]) -> Feed:
    """A feed written by ``write_feed``; filters on gtfs_id prune partitions."""
    tables = list(tables)
    held = {t: (lambda t=t: spark.read.parquet(f"{root}/{t}")) for t in tables}
    placed = {t: held[t] for t in tables if "_missing" in held[t]().columns}
    return Feed({t: f for t, f in held.items() if t not in placed}, placed)
