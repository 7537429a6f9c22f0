"""Feed manifest and selection of each feed's files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayrunner.functions.columns import feed_id_from_path

# Manifest columns and the words that mean yes.
MANIFEST_COLUMNS = (
    "id", "source", "url", "headers_json", "params_json", "license", "active", "write_stable", "encoding",
    "epsg", "origin", "stat_year", "created_year", "info_url",
)
TRUE_WORDS = ("true", "1", "yes", "y")

# Folders below the root that hold table files. They are named one by one, as
# Spark's own listing skips folders whose name starts with an underscore.
FOLDERS = (
    "gtfs/*/latest/_extracted", "gtfs/*/latest/*/_extracted",
    "stable/gtfs/*/latest/_extracted", "stable/gtfs/*/latest/*/_extracted", "sandbox/*",
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType()) for c in MANIFEST_COLUMNS])
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def active_feeds(manifest: DataFrame, source: str = "gtfs") -> DataFrame:
    """(gtfs_id, url) of the active feeds of a source."""
    active = F.lower(F.trim("active")).isin(*TRUE_WORDS)
    feed_id = F.trim("id")
    return manifest.filter((F.trim("source") == source) & active & (feed_id != "")).select(
        feed_id.alias("gtfs_id"), F.trim("url").alias("url")
    )


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Every text table file below ``root``: full path, path relative to the
    root, feed id and table. File contents are not read."""
    folders = root.rstrip("/") + "/{" + ",".join(FOLDERS) + "}"
    listing = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,csv}")
        .load(folders).select("path")
    )
    tail = re.escape(re.sub(r"^file:/+", "/", root.rstrip("/")))
    relative = F.regexp_replace("path", f"^.*?{tail}/", "")
    return listing.select(
        "path", relative.alias("relative"), feed_id_from_path(relative).alias("gtfs_id"),
        F.regexp_extract(relative, r"([a-z_]+)\.(?:txt|csv)$", 1).alias("table"),
    )


def table_files(files: DataFrame, feeds: DataFrame, sandbox_ids: Sequence[str] = ()) -> DataFrame:
    """The file of each feed and table: the first path under ``_extracted/`` of
    an active feed, or a sandbox file, 'txt' before 'csv', where there is one."""
    stable = (
        files.filter(F.col("relative").contains("_extracted/"))
        .join(feeds.select("gtfs_id"), "gtfs_id", "left_semi")
        .groupBy("gtfs_id", "table")
        .agg(F.min("path").alias("path"), F.min("relative").alias("relative"))
    )
    if not sandbox_ids:
        return stable
    is_csv = F.col("relative").endswith(".csv").cast("int")
    sandbox = (
        files.filter(F.col("relative").rlike(r"^(?:[^/]+/)?sandbox/[^/]+/[a-z_]+\.(?:txt|csv)$") & F.col("gtfs_id").isin(*sandbox_ids))
        .groupBy("gtfs_id", "table")
        .agg(F.min_by("path", is_csv).alias("path"), F.min_by("relative", is_csv).alias("relative"))
    )
    return stable.unionByName(sandbox.join(stable, ["gtfs_id", "table"], "left_anti"))


def file_report(found: DataFrame, feeds: DataFrame, tables: Sequence[str]) -> DataFrame:
    """(gtfs_id, table, found) for every active feed and table."""
    grid = feeds.select("gtfs_id").withColumn("table", F.explode(F.array(*[F.lit(t) for t in tables])))
    hits = found.select("gtfs_id", "table", F.lit(True).alias("hit"))
    return grid.join(hits, ["gtfs_id", "table"], "left").select(
        "gtfs_id", "table", F.coalesce("hit", F.lit(False)).alias("found")
    )


def missing_feeds(found: DataFrame, feeds: DataFrame, table: str) -> DataFrame:
    """Active feeds without a file of a table."""
    have = found.filter(F.col("table") == table).select("gtfs_id")
    return feeds.select("gtfs_id").join(have, "gtfs_id", "left_anti")
