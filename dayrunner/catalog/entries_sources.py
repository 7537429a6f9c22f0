"""Side-by-side queries: files written from the tables and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from dayrunner import schemas
from dayrunner.catalog.registry import check
from dayrunner.catalog.tools import texts
from dayrunner.functions import columns as C
from dayrunner.operators import quality as V
from dayrunner.plans import views
from dayrunner.session import shared_dir
from dayrunner.sources import corpus, gtfs, manifest, sinks, snapshots


def _new_folder(spark) -> str:
    return f"{shared_dir(spark).rstrip('/')}/run-{uuid.uuid4().hex}"


def _write_csv(df, table: str, root: str, columns: list[str]) -> None:
    """One feed's rows as CSV below its folder, the id prefix taken off again."""
    for feed_id in sorted(r.gtfs_id for r in df.select("gtfs_id").distinct().collect()):
        mine = df.filter(F.col("gtfs_id") == feed_id)
        bare = {c: F.substring(c, F.lit(len(feed_id) + 1), F.length(c)) for c in schemas.PREFIXED[table] if c in columns}
        order = columns if feed_id != "r3" else list(reversed(columns))
        (
            mine.withColumns(bare).select(*order).write.mode("overwrite")
            .option("header", True).option("escape", '"')
            .csv(f"{root}/gtfs/{feed_id}/latest/_extracted/{table}_parts")
        )


def _manifest(spark):
    rows = [(f"r{i}", "gtfs", "u", "TRUE" if i != 9 else "no") for i in (0, 1, 2, 3, 4, 7, 9)] + [("r5", "other", "u", "1")]
    listed = spark.createDataFrame(rows, "id string, source string, url string, active string")
    return manifest.active_feeds(listed)


def _found(spark, root: str, table: str):
    """Part files of a table, listed like a feed's table files."""
    listing = manifest.list_files(spark, root)
    return listing.filter(F.col("relative").contains(f"/{table}_parts/")).withColumn("table", F.lit(table))


@check("a1_stops_from_csv", "A1 A2 A3 A4 B1 B3 B6", """
    select gtfs_id, false as _missing, stop_id, stop_code, stop_name, stop_lat, stop_lon, zone_id, location_type,
      parent_station, wheelchair_boarding, cast(null as varchar) as stop_url from stops
    union all select 'r7', true, null, null, null, null, null, null, null, null, null, null""")
def _(feed):
    spark = feed.stops.sparkSession
    root = _new_folder(spark)
    columns = ["stop_id", "stop_code", "stop_name", "stop_lat", "stop_lon", "zone_id", "location_type",
               "parent_station", "wheelchair_boarding"]
    _write_csv(feed.stops, "stops", root, columns)
    read = gtfs.read_table(spark, "stops", _found(spark, root, "stops"), _manifest(spark), emit_missing=True)
    return read.select("gtfs_id", "_missing", *columns, "stop_url")


@check("a2_stop_times_from_csv", "A1 A2 A3 B1 B4 B6", """
    select gtfs_id, stop_id, count(*) as events, cast(sum(arrival_secs) as bigint) as arrivals, cast(sum(departure_secs) as bigint) as departures,
      round(sum(shape_dist_traveled), 3) as metres, cast(sum(stop_sequence) as bigint) as sequences, max(trip_id) as last_trip
    from stop_times group by 1, 2""")
def _(feed):
    spark = feed.stop_times.sparkSession
    root = _new_folder(spark)
    events = feed.stop_times.withColumns({
        "arrival_time": C.seconds_to_hms("arrival_secs"), "departure_time": C.seconds_to_hms("departure_secs"),
    })
    columns = ["trip_id", "arrival_time", "departure_time", "stop_id", "stop_sequence", "shape_dist_traveled", "timepoint"]
    _write_csv(events, "stop_times", root, columns)
    read = gtfs.read_table(spark, "stop_times", _found(spark, root, "stop_times"))
    return read.groupBy("gtfs_id", "stop_id").agg(
        F.count("*").alias("events"), F.sum("arrival_secs").alias("arrivals"), F.sum("departure_secs").alias("departures"),
        F.round(F.sum("shape_dist_traveled"), 3).alias("metres"), F.sum("stop_sequence").alias("sequences"),
        F.max("trip_id").alias("last_trip"),
    )


@check("a4_placeholders", "A4 A5 A6 V1", """
    select t.t as "table", f.f as gtfs_id, true as _missing from
      (values ('transfers'), ('stops'), ('calendar')) t(t), (values ('r7')) f(f)
    union all select 'agency', 'r7', true
    union all select 'trips of feeds', gtfs_id, false from (select distinct gtfs_id from trips)""")
def _(feed):
    spark = feed.trips.sparkSession
    here = feed.trips.select("gtfs_id").distinct()
    found = here.withColumn("table", F.lit("x"))
    lacking = _manifest(spark).join(found, "gtfs_id", "left_anti")
    out = here.select(F.lit("trips of feeds").alias("table"), "gtfs_id", F.lit(False).alias("_missing"))
    for table in ("transfers", "stops", "calendar", "agency"):
        rows = gtfs.empty_table(spark, table).unionByName(gtfs.missing_rows(table, lacking))
        out = out.unionByName(rows.select(F.lit(table).alias("table"), "gtfs_id", "_missing"))
    return out


@check("a7_file_selection", "A6 A7 V4", """
    select gtfs_id, true as stops, true as trips, false as shapes from (select distinct gtfs_id from stops)
    union all select 'r7', false, false, false""")
def _(feed):
    spark = feed.stops.sparkSession
    # A listing as the file scan gives it, derived from the feeds in the tables.
    paths = feed.stops.select("gtfs_id").distinct().select(
        "gtfs_id", F.explode(F.array(F.lit("stops.txt"), F.lit("trips.csv"), F.lit("trips.txt"))).alias("name")
    ).select(F.concat(F.lit("gtfs/"), "gtfs_id", F.lit("/latest/_extracted/"), "name").alias("relative"))
    files = paths.select(
        F.col("relative").alias("path"), "relative", C.feed_id_from_path("relative").alias("gtfs_id"),
        F.regexp_extract("relative", r"([a-z_]+)\.(?:txt|csv)$", 1).alias("table"),
    )
    feeds = _manifest(spark)
    found = manifest.table_files(files, feeds)
    return V.availability(manifest.file_report(found, feeds, ["stops", "trips", "shapes"]), ["stops", "trips", "shapes"])


@check("a8_table_sink", "A8", """
    select gtfs_id, service_id, cast(start_date as varchar) as start_date, monday from calendar""")
def _(feed):
    spark = feed.calendar.sparkSession
    root = _new_folder(spark)
    sinks.write_feed(feed, root, ["calendar"])
    back = sinks.load_feed(spark, root, ["calendar"])
    return texts(back.calendar.select("gtfs_id", "service_id", "start_date", "monday"), "start_date")


@check("a8_rewritten_feed", "A8", """
    select gtfs_id, service_id, cast(start_date as varchar) as start_date, case when gtfs_id = 'r3' then 9 else monday end as monday
    from calendar""")
def _(feed):
    """One feed is rewritten in a second run; the others stay as the first run left them."""
    spark = feed.calendar.sparkSession
    root = _new_folder(spark)
    snapshots.commit(spark, root, {"calendar": feed.calendar})
    snapshots.commit(spark, root, {"calendar": feed.calendar.filter("gtfs_id = 'r3'").withColumn("monday", F.lit(9))})
    return texts(snapshots.load(spark, root, "calendar").select("gtfs_id", "service_id", "start_date", "monday"), "start_date")


@check("c1_refreshed_service_days", "C1 A8", """
    select gtfs_id, service_id, cast(service_date as varchar) as service_date
    from service_days where gtfs_id <> 'r3' or service_id like 'r31%'""")
def _(feed):
    """A stored view after one feed lost some services and only that feed was worked out again."""
    spark = feed.calendar.sparkSession
    root, tables = _new_folder(spark), ["calendar", "calendar_dates"]
    snapshots.commit(spark, root, {t: feed[t] for t in tables})
    snapshots.refresh(spark, root, "service_days", tables, views.service_days)
    fewer = "gtfs_id = 'r3' and service_id like 'r31%'"
    snapshots.commit(spark, root, {t: feed[t].filter(fewer) for t in tables})
    snapshots.refresh(spark, root, "service_days", tables, views.service_days)
    return texts(snapshots.load(spark, root, "service_days").select("gtfs_id", "service_id", "service_date"), "service_date")


@check("a10_worked_examples", "A10", """
    select 'documents/' || doc_id || '#example_' || n as source, 'few_shot' as kind, md5(case n when 7 then 'question: Why?'
        else 'feed: ' || lang || chr(10) || 'question: ' || source || chr(10) || 'answer:' || chr(10) ||
          regexp_replace(regexp_replace(text, '^\\n+', ''), '\\s+$', '') end) as text_md5
    from documents, (values (1), (7)) x(n) where regexp_matches(text, '\\S')""")
def _(feed):
    indented = F.regexp_replace(F.regexp_replace("text", r"^\n+", ""), "(?m)^", " " * 8)
    raw = F.concat(
        F.lit("# head\nexample_1:\n    feed: \""), "lang", F.lit("\"\n    question: "), "source",
        F.lit("\n    answer: |\n"), indented, F.lit("\n\nexample_7:\n    question: \"Why?\"\n"),
    )
    files = feed.documents.filter(F.col("text").rlike(r"\S")).select(
        F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), raw.alias("raw")
    )
    return corpus.parse_examples(files, "few_shot").select("source", "kind", F.md5("text").alias("text_md5"))


@check("a11_question_lists", "A11", """
    select 'benchmark/' || item_id || '[' || n || ']' as source, 'sample_en' as kind, md5(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) as text_md5
    from benchmark, (values (0), (2)) x(n)""")
def _(feed):
    raw = F.to_json(F.array("text", F.lit("  "), F.concat(F.lit(" "), "text", F.lit(" \n"))))
    files = feed.benchmark.select(
        F.concat(F.lit("benchmark/"), F.col("item_id").cast("string")).alias("path"), raw.alias("raw")
    )
    return corpus.parse_questions(files, "sample_en").select("source", "kind", F.md5("text").alias("text_md5"))
