"""Tables kept by feed, in snapshots that change in one step.

Below a root folder, ``data/<table>/run=<run>/gtfs_id=<feed>`` holds what a run
wrote and ``log`` one row per run, table and feed: the run whose files are valid
for this feed from that version on. A run's log rows are one file written last, so
a run that ended early is never seen and the snapshot before it stays readable.
Files are not changed or deleted; superseded runs are left to the folder's own
clean-up. There is one writer at a time.

A feed's ``digest`` tells its content, whatever the order of the rows, so a view
made of several tables is worked out again only for feeds whose content changed.
Log rows number tables times feeds a run; of them, the driver gathers one schema a
table and the live runs and feeds of a table, bounded by the feeds of the manifest.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dayrunner.feed import Feed
from dayrunner.sources import sinks

FEED = "gtfs_id"
LOG_SCHEMA = "version long, table string, gtfs_id string, run string, digest string, made_from string, schema string"


def read_log(spark: SparkSession, root: str) -> DataFrame:
    """Every log row; a root without a run gives none."""
    # Written once without rows, so that the folder is always there to read.
    spark.createDataFrame([], LOG_SCHEMA).write.mode("ignore").parquet(f"{root}/log")
    return spark.read.schema(LOG_SCHEMA).parquet(f"{root}/log")


def current(log: DataFrame, version: int | None = None) -> DataFrame:
    """The valid log row of every table and feed, now or at an earlier version."""
    upto = log if version is None else log.filter(F.col("version") <= version)
    rest = F.struct("run", "digest", "made_from", "schema", "version")
    return upto.groupBy("table", FEED).agg(F.max_by(rest, F.struct("version", "run")).alias("_row")).select("table", FEED, "_row.*")


def commit(
    spark: SparkSession, root: str, tables: Mapping[str, DataFrame], feeds: DataFrame | None = None, made_from: DataFrame | None = None
) -> int:
    """Replace some feeds in some tables at once; the other feeds stay. Returns the version.

    ``feeds`` (gtfs_id) are the feeds replaced, by default those with rows in any of
    the tables; a feed named there without rows in a table has none afterwards. Rows
    of feeds not named there are not written. ``made_from`` (gtfs_id, made_from) is
    kept with the log rows.
    """
    run = uuid.uuid4().hex
    log = read_log(spark, root)
    version = (log.agg(F.max("version")).first()[0] or 0) + 1
    digests = []
    for name, df in tables.items():
        mine = df if feeds is None else df.join(feeds.select(FEED), FEED, "left_semi")
        sinks.write_table(mine, f"{root}/data/{name}/run={run}")
        held = spark.read.schema(df.schema).parquet(f"{root}/data/{name}/run={run}")
        row = F.xxhash64(*[F.col(c) for c in df.columns]).cast("decimal(20,0)")
        digests.append(held.groupBy(FEED).agg(F.concat_ws(":", F.count("*"), F.sum(row)).alias("digest")).withColumn("table", F.lit(name)))
    told = digests[0]
    for more in digests[1:]:
        told = told.unionByName(more)
    named = told.select(FEED).distinct() if feeds is None else feeds.select(FEED).distinct()
    schemas = spark.createDataFrame([(n, df.schema.json()) for n, df in tables.items()], "table string, schema string")
    rows = named.withColumn("table", F.explode(F.array(*[F.lit(n) for n in tables]))).join(told, [FEED, "table"], "left").join(schemas, "table")
    rows = rows.join(made_from, FEED, "left") if made_from is not None else rows.withColumn("made_from", F.lit(None).cast("string"))
    # One file: either all of the run's rows are there or none.
    (
        rows.select(F.lit(version).cast("long").alias("version"), "table", FEED, F.lit(run).alias("run"), "digest", "made_from", "schema")
        .coalesce(1).write.mode("append").parquet(f"{root}/log")
    )
    return version


def load(spark: SparkSession, root: str, table: str, version: int | None = None, feeds: Iterable[str] | None = None) -> DataFrame:
    """A table as of now or of an earlier version; with ``feeds`` only these are read."""
    valid = current(read_log(spark, root), version).filter(F.col("table") == table)
    newest = valid.agg(F.max_by("schema", "version")).first()[0]
    if newest is None:
        raise ValueError(f"no snapshot of {table!r} in {root}")
    schema = StructType.fromJson(json.loads(newest))
    valid = valid if feeds is None else valid.filter(F.col(FEED).isin(list(feeds)))
    live = [(r.run, r.gtfs_id) for r in valid.select("run", FEED).collect()]
    held = spark.read.schema(StructType([*schema.fields]).add("run", "string")).parquet(f"{root}/data/{table}")
    # Constants, so that files of other runs and feeds are pruned before they are read.
    held = held.filter(F.col("run").isin([r for r, _ in live]) & F.col(FEED).isin([f for _, f in live]))
    return held.join(valid.select("run", FEED), ["run", FEED], "left_semi").select(*schema.names)


def load_feed(spark: SparkSession, root: str, tables: Iterable[str], version: int | None = None, feeds: Iterable[str] | None = None) -> Feed:
    """A feed set of one snapshot."""
    return Feed({t: load(spark, root, t, version, feeds) for t in tables})


def refresh(spark: SparkSession, root: str, view: str, tables: Iterable[str], build: Callable[[Feed], DataFrame]) -> list[str]:
    """Bring a stored view up to date; returns the feeds that were worked out again.

    ``build`` makes the view of a feed set of ``tables``, each feed from its own rows.
    Feeds whose tables have the content the view was made from are not read.
    """
    tables = list(tables)
    valid = current(read_log(spark, root))
    sources = valid.filter(F.col("table").isin(tables)).groupBy(FEED).agg(
        F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "table", F.coalesce("digest", F.lit("none"))))), ";").alias("now")
    )
    made = valid.filter(F.col("table") == view).select(FEED, "made_from")
    changed = sources.join(made, FEED, "left").filter(~F.col("now").eqNullSafe(F.col("made_from"))).select(
        FEED, F.col("now").alias("made_from")
    )
    stale = [tuple(r) for r in changed.collect()]
    if stale:
        ids = [f for f, _ in stale]
        told = spark.createDataFrame(stale, "gtfs_id string, made_from string")
        commit(spark, root, {view: build(load_feed(spark, root, tables, feeds=ids))}, told, told)
    return sorted(f for f, _ in stale)
