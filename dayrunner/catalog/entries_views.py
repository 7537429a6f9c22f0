"""Side-by-side queries: canonical views."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayrunner.catalog.registry import check
from dayrunner.catalog.tools import checksum, checksum_sql
from dayrunner.functions import columns as C
from dayrunner.plans import views as V


@check("c1_service_days", "C1 D5 D6 H1 H5 B9", """
    select gtfs_id, service_id, cast(service_date as varchar) as service_date from service_days""")
def _(feed):
    return V.service_days(feed).withColumn("service_date", F.col("service_date").cast("string"))


@check("c2_stop_times_norm", "C2 B7 B8", f"""
    select s.gtfs_id, s.stop_id, cast(departure_secs // 86400 as bigint) as departure_day_offset,
      count(*) as events, cast(min(service_date + to_seconds(arrival_secs)) as varchar) as first_arrival_ts,
      cast(max(service_date + to_seconds(departure_secs)) as varchar) as last_departure_ts,
      {checksum_sql("s.trip_id", "s.stop_id", "stop_sequence", "arrival_secs", "departure_secs", "service_date",
                    "service_date + to_seconds(arrival_secs)", "service_date + to_seconds(departure_secs)")} as row_sum
    from stop_times s join trips t on s.gtfs_id = t.gtfs_id and s.trip_id = t.trip_id
      join service_days d on t.gtfs_id = d.gtfs_id and t.service_id = d.service_id
    group by 1, 2, 3""")
def _(feed):
    return V.stop_times_norm(feed).groupBy("gtfs_id", "stop_id", "departure_day_offset").agg(
        F.count("*").alias("events"),
        F.min("arrival_ts").cast("string").alias("first_arrival_ts"),
        F.max("departure_ts").cast("string").alias("last_departure_ts"),
        checksum("trip_id", "stop_id", "stop_sequence", "arrival_secs", "departure_secs", "service_date",
                 "arrival_ts", "departure_ts").alias("row_sum"),
    )


@check("c3_departures", "C3", f"""
    select s.gtfs_id, cast(service_date as varchar) as service_date, t.direction_id, r.route_type, r.agency_id,
      count(*) as departures, cast(max(service_date + to_seconds(departure_secs)) as varchar) as last_ts,
      count(r.route_long_name) as named, count(t.shape_id) as shaped, count(s.stop_id) as stopped,
      {checksum_sql("s.stop_id", "service_date + to_seconds(departure_secs)", "departure_secs", "service_date", "s.trip_id", "t.route_id",
                    "t.direction_id", "t.shape_id", "r.agency_id", "r.route_short_name", "r.route_long_name", "r.route_type")} as row_sum
    from stop_times s join trips t on s.gtfs_id = t.gtfs_id and s.trip_id = t.trip_id
      join service_days d on t.gtfs_id = d.gtfs_id and t.service_id = d.service_id
      join routes r on t.gtfs_id = r.gtfs_id and t.route_id = r.route_id
    group by 1, 2, 3, 4, 5""")
def _(feed):
    return (
        V.departures(feed)
        .groupBy("gtfs_id", F.col("service_date").cast("string").alias("service_date"),
                 "direction_id", "route_type", "agency_id")
        .agg(
            F.count("*").alias("departures"),
            F.max("departure_ts").cast("string").alias("last_ts"),
            F.count("route_long_name").alias("named"),
            F.count("shape_id").alias("shaped"),
            F.count("stop_id").alias("stopped"),
            checksum("stop_id", "departure_ts", "departure_secs", "service_date", "trip_id", "route_id", "direction_id", "shape_id",
                     "agency_id", "route_short_name", "route_long_name", "route_type").alias("row_sum"),
        )
    )


@check("c4_trip_start_times", "C4 F6", f"""
    select s.gtfs_id, cast(service_date as varchar) as service_date, count(*) as trips,
      count(distinct s.first_stop) as start_stops,
      cast(min(service_date + to_seconds(start_secs)) as varchar) as first_start,
      {checksum_sql("s.trip_id", "service_date", "s.first_stop", "service_date + to_seconds(start_secs)")} as row_sum
    from trip_spans s join trips t on s.gtfs_id = t.gtfs_id and s.trip_id = t.trip_id
      join service_days d on t.gtfs_id = d.gtfs_id and t.service_id = d.service_id
    group by 1, 2""")
def _(feed):
    return (
        V.trip_start_times(feed)
        .groupBy("gtfs_id", F.col("service_date").cast("string").alias("service_date"))
        .agg(
            F.count("*").alias("trips"),
            F.count_distinct("start_stop_id").alias("start_stops"),
            F.min("start_departure_ts").cast("string").alias("first_start"),
            checksum("trip_id", "service_date", "start_stop_id", "start_departure_ts").alias("row_sum"),
        )
    )


@check("c5_route_patterns", "C5 E1", """
    select gtfs_id, route_id, direction_id, shape_id, count(*) as trip_count from trips group by 1, 2, 3, 4""")
def _(feed):
    return V.route_patterns(feed)


@check("c6_stop_areas", "C6 B16", """
    select gtfs_id, stop_id, coalesce(parent_station, stop_id) as stop_area_id, stop_name, stop_lat, stop_lon,
      location_type, parent_station from stops""")
def _(feed):
    return V.stop_areas(feed)


@check("c7_active_services", "C7", """
    select gtfs_id, service_id, true as exceptions_applied from service_days where service_date = date '1995-02-08'
    union all
    select gtfs_id, service_id, false from calendar
    where date '1995-02-08' between start_date and end_date and wednesday = 1""")
def _(feed):
    date = "1995-02-08"
    with_exceptions = V.active_services(feed, date).withColumn("exceptions_applied", F.lit(True))
    flags_only = V.active_services(feed, date, exceptions=False).withColumn("exceptions_applied", F.lit(False))
    return with_exceptions.unionByName(flags_only)


@check("c8_typical_trips", "C8 D3 B10 E1", """
    select gtfs_id, route_id, count(*) as trips from trips t
    where exists (select 1 from calendar c where c.gtfs_id = t.gtfs_id and c.service_id = t.service_id and c.friday = 1)
    group by 1, 2""")
def _(feed):
    return V.typical_trips(feed, "friday").groupBy("gtfs_id", "route_id").agg(F.count("*").alias("trips"))


@check("a9_registered_views", "A9", """
    select r.gtfs_id, r.route_id, r.route_type, count(*) as trip_count
    from trips t join routes r on t.gtfs_id = r.gtfs_id and t.route_id = r.route_id group by 1, 2, 3""")
def _(feed):
    spark = feed.trips.sparkSession
    V.register_views(spark, feed)
    return spark.sql("""
        select r.gtfs_id, r.route_id, r.route_type, sum(p.trip_count) as trip_count
        from gtfs_route_patterns p join gtfs_routes r on p.gtfs_id = r.gtfs_id and p.route_id = r.route_id
        group by 1, 2, 3""")


@check("a12_feed_slice", "A12 G1 G3 B17 D3", """
    select gtfs_id, shape_id, shape_pt_sequence, shape_pt_lat, shape_pt_lon from shapes
    where shape_pt_sequence % 3 = 0
    order by gtfs_id, shape_id, shape_pt_sequence limit 500""")
def _(feed):
    return V.feed_slice(
        feed.shapes,
        ["gtfs_id", "shape_id", "shape_pt_sequence", "shape_pt_lat", "shape_pt_lon"],
        where=C.every_nth("shape_pt_sequence", 3),
        order=["gtfs_id", "shape_id", "shape_pt_sequence"],
        limit=500,
    )
