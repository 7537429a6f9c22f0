"""Side-by-side queries: joins, fares joins, selection and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayrunner.catalog.registry import check
from dayrunner.catalog.tools import rounded
from dayrunner.functions import columns as C
from dayrunner.operators import choose as G
from dayrunner.operators import joins as J
from dayrunner.operators import service as S
from dayrunner.operators import trips as T
from dayrunner.plans import views as V

COMMON_NAME = "('NATION_0 Express', 'NATION_12 Express')"


@check("d1_events_by_route_type", "D1", """
    select s.gtfs_id, r.route_type, p.location_type, count(*) as events
    from stop_times s join trips t on s.gtfs_id = t.gtfs_id and s.trip_id = t.trip_id
      join routes r on t.gtfs_id = r.gtfs_id and t.route_id = r.route_id
      join stops p on s.gtfs_id = p.gtfs_id and s.stop_id = p.stop_id
    group by 1, 2, 3""")
def _(feed):
    events = J.trip_events(feed, ["stop_id"], ["route_id"])
    typed = J.with_stop(J.with_route(events, feed, ["route_type"], "inner"), feed, ["location_type"], "inner")
    return typed.groupBy("gtfs_id", "route_type", "location_type").agg(F.count("*").alias("events"))


@check("d2_trips_with_route_names", "D2 B23 G3", """
    select t.gtfs_id, t.route_id, count(*) as trips, coalesce(min(r.route_long_name), min(r.route_short_name)) as name,
      concat_ws(' - ', min(r.route_short_name), min(r.route_long_name)) as title
    from trips t left join routes r on t.gtfs_id = r.gtfs_id and t.route_id = r.route_id group by 1, 2""")
def _(feed):
    counts = T.trip_counts(feed, ["route_id"])
    named = J.with_route(counts, feed, ["route_short_name", "route_long_name"])
    return named.select("gtfs_id", "route_id", "trips", C.display_name().alias("name"), C.route_title().alias("title"))


@check("d3_weekend_only_trips", "D3 B10", """
    select t.gtfs_id, t.service_id, count(*) as trips from trips t
    where exists (select 1 from calendar c where c.gtfs_id = t.gtfs_id and c.service_id = t.service_id
      and (saturday = 1 or sunday = 1) and monday = 0 and tuesday = 0 and wednesday = 0 and thursday = 0 and friday = 0)
    group by 1, 2""")
def _(feed):
    return V.typical_trips(feed, C.WEEKEND, "only").groupBy("gtfs_id", "service_id").agg(F.count("*").alias("trips"))


@check("d4_routes_without", "D4", """
    with lacking as (
      select 'trips' as what, * from routes r where not exists
        (select 1 from trips t where t.gtfs_id = r.gtfs_id and t.route_id = r.route_id)
      union all select 'stop_times', * from routes r where not exists
        (select 1 from trips t join stop_times s on s.gtfs_id = t.gtfs_id and s.trip_id = t.trip_id
         where t.gtfs_id = r.gtfs_id and t.route_id = r.route_id)
      union all select 'fares', * from routes r where not exists
        (select 1 from fare_rules t where t.gtfs_id = r.gtfs_id and t.route_id = r.route_id)
      union all select 'weekend', * from routes r where not exists
        (select 1 from trips t join calendar c on c.gtfs_id = t.gtfs_id and c.service_id = t.service_id
         where t.gtfs_id = r.gtfs_id and t.route_id = r.route_id and (saturday = 1 or sunday = 1))
      union all select 'transfers', * from routes r where not exists
        (select 1 from route_stops a join route_stops b on a.gtfs_id = b.gtfs_id and a.stop_id = b.stop_id
           and a.route_id <> b.route_id
         where a.gtfs_id = r.gtfs_id and a.route_id = r.route_id))
    select r.gtfs_id, r.route_id, what from lacking r
    union all select gtfs_id, 'routes with trips', cast(count(distinct route_id) as varchar) from trips group by 1""")
def _(feed):
    lacking = [
        J.routes_without(feed, what).select("gtfs_id", "route_id", F.lit(what).alias("what"))
        for what in ("trips", "stop_times", "fares", "weekend", "transfers")
    ]
    used = feed.trips.groupBy("gtfs_id").agg(F.count_distinct("route_id").alias("n")).select(
        "gtfs_id", F.lit("routes with trips").alias("route_id"), F.col("n").cast("string").alias("what")
    )
    out = used
    for frame in lacking:
        out = out.unionByName(frame)
    return out


@check("d7_routes_at_airport", "D7 B15", """
    select distinct s.gtfs_id, s.stop_id, t.route_id
    from stop_times s join trips t on s.gtfs_id = t.gtfs_id and s.trip_id = t.trip_id
      join calendar c on c.gtfs_id = t.gtfs_id and c.service_id = t.service_id
      join stops p on s.gtfs_id = p.gtfs_id and s.stop_id = p.stop_id
    where (saturday = 1 or sunday = 1) and regexp_matches(lower(stop_name), 'airport|terminal|airfield|aviation')""")
def _(feed):
    airport = feed.stops.filter(C.name_has_any("stop_name", C.AIRPORT_KEYWORDS))
    return J.routes_at(feed, airport, C.WEEKEND)


@check("d8_transfer_points", "D8 H3", """
    select a.gtfs_id, a.route_id as route_a, b.route_id as route_b, a.stop_id
    from route_stops a join route_stops b on a.gtfs_id = b.gtfs_id and a.stop_id = b.stop_id
      join routes ra on ra.gtfs_id = a.gtfs_id and ra.route_id = a.route_id
      join routes rb on rb.gtfs_id = b.gtfs_id and rb.route_id = b.route_id
    where ra.route_short_name = rb.route_short_name and ra.nation_no + 12 = rb.nation_no""")
def _(feed):
    cols = ["gtfs_id", "route_short_name", "nation_no"]
    a = feed.routes.select(*cols, F.col("route_id").alias("route_a"))
    b = feed.routes.select(
        "gtfs_id", "route_short_name", (F.col("nation_no") - 12).alias("nation_no"), F.col("route_id").alias("route_b")
    )
    return J.transfer_points(feed, a.join(b, cols).select("gtfs_id", "route_a", "route_b"))


@check("d9_connections", "D9", """
    select distinct a.gtfs_id, a.route_id, b.route_id as connected_route_id
    from route_stops a join route_stops b on a.gtfs_id = b.gtfs_id and a.stop_id = b.stop_id and a.route_id <> b.route_id""")
def _(feed):
    return J.connections(J.route_stops(feed))


@check("d9_connections_of_route", "D9", f"""
    select distinct a.gtfs_id, a.route_id as from_route_id, b.route_id
    from route_stops a join route_stops b on a.gtfs_id = b.gtfs_id and a.stop_id = b.stop_id and a.route_id <> b.route_id
      join routes r on r.gtfs_id = a.gtfs_id and r.route_id = a.route_id
    where r.route_long_name in {COMMON_NAME} and r.route_short_name = 'BUILDING'""")
def _(feed):
    wanted = feed.routes.filter(f"route_long_name in {COMMON_NAME} and route_short_name = 'BUILDING'")
    served = J.route_stops(feed)
    chosen = served.join(wanted.select("gtfs_id", "route_id"), ["gtfs_id", "route_id"], "left_semi")
    return J.connections_from(served, chosen)


@check("d10_travel_times", "D10 B22 E35", """
    with pairs as (
      select a.gtfs_id, t.route_id, cast(b.arrival_secs - a.arrival_secs as bigint) as travel_secs
      from stop_times a join stop_times b on a.gtfs_id = b.gtfs_id and a.trip_id = b.trip_id
        and a.stop_sequence < b.stop_sequence and b.arrival_secs > a.arrival_secs
        join trips t on t.gtfs_id = a.gtfs_id and t.trip_id = a.trip_id)
    select gtfs_id, route_id, count(*) as pairs, cast(sum(travel_secs) as bigint) as total_secs,
      min(travel_secs) as least, max(travel_secs) as most, median(travel_secs) as median_secs
    from pairs group by 1, 2""")
def _(feed):
    return J.travel_time_stats(J.travel_time_counts(feed))


@check("d10_travel_time_histogram", "D10 B22", """
    with pairs as (
      select a.gtfs_id, b.arrival_secs - a.arrival_secs as secs
      from stop_times a join stop_times b on a.gtfs_id = b.gtfs_id and a.trip_id = b.trip_id
        and a.stop_sequence < b.stop_sequence and b.arrival_secs > a.arrival_secs),
    bounds as (select gtfs_id, min(secs) as lo, max(secs) as hi from pairs group by 1)
    select p.gtfs_id, cast(least(floor((secs - lo) * 50.0::double / (hi - lo)), 49) as bigint) as bin, count(*) as n
    from pairs p join bounds b on p.gtfs_id = b.gtfs_id group by 1, 2""")
def _(feed):
    counts = J.travel_time_counts(feed).groupBy("gtfs_id", "travel_secs").agg(F.sum("pairs").alias("n"))
    return T.histogram(counts, ["gtfs_id"], "travel_secs", 50, weight="n")


@check("d13_direct_trips", "D13 C7 B12", """
    with requests as (
      select gtfs_id || '-' || stop_code as request_id, gtfs_id, stop_id as from_stop,
        gtfs_id || (cast(substr(stop_id, 3) as bigint) + 3) as to_stop,
        date '1995-02-08' as service_date, 30000 as now_secs from stops)
    select request_id, a.gtfs_id, a.trip_id, t.route_id, a.stop_id as from_stop, b.stop_id as to_stop,
      a.departure_secs as start_secs, b.departure_secs as end_secs, b.departure_secs - a.departure_secs as travel_secs
    from requests q join stop_times a on a.gtfs_id = q.gtfs_id and a.stop_id = q.from_stop
      join stop_times b on b.gtfs_id = a.gtfs_id and b.trip_id = a.trip_id and b.stop_id = q.to_stop
        and b.stop_sequence > a.stop_sequence
      join trips t on t.gtfs_id = a.gtfs_id and t.trip_id = a.trip_id
      join service_days d on d.gtfs_id = t.gtfs_id and d.service_id = t.service_id and d.service_date = q.service_date
    where a.departure_secs > now_secs and a.departure_secs <= now_secs + 18000
      and b.departure_secs > now_secs and b.departure_secs <= now_secs + 18000""")
def _(feed):
    number = F.substring("stop_id", 3, 20).cast("bigint")
    requests = feed.stops.select(
        F.concat_ws("-", "gtfs_id", "stop_code").alias("request_id"), "gtfs_id",
        F.col("stop_id").alias("from_stop"), F.concat("gtfs_id", (number + 3).cast("string")).alias("to_stop"),
        F.lit("1995-02-08").cast("date").alias("service_date"), F.lit(30000).alias("now_secs"),
    )
    return J.direct_trips(feed, requests, within_secs=18000)


@check("d14_route_fares", "D14", """
    select r.gtfs_id, r.fare_id, r.route_id, a.price, a.currency_type
    from fare_rules r left join fare_attributes a on r.gtfs_id = a.gtfs_id and r.fare_id = a.fare_id""")
def _(feed):
    return J.route_fares(feed)


@check("d15_network_fares", "D15", """
    select r.gtfs_id, r.route_id, l.fare_product_id, p.fare_product_name, p.amount, m.fare_media_name, m.fare_media_type
    from routes r join fare_leg_rules l on l.gtfs_id = r.gtfs_id and l.network_id = r.network_id
      left join fare_products p on p.gtfs_id = l.gtfs_id and p.fare_product_id = l.fare_product_id
      left join fare_media m on m.gtfs_id = p.gtfs_id and m.fare_media_id = p.fare_media_id""")
def _(feed):
    return J.network_fares(feed).select(
        "gtfs_id", "route_id", "fare_product_id", "fare_product_name", "amount", "fare_media_name", "fare_media_type"
    )


@check("d16_trips_serving_both", "D16", """
    select s.gtfs_id, s.trip_id,
      min(case when p.stop_name like 'Green & %' then s.stop_sequence end) as first_a,
      max(case when p.stop_name like '%& Oak%' then s.stop_sequence end) as last_b
    from stop_times s join stops p on s.gtfs_id = p.gtfs_id and s.stop_id = p.stop_id
    group by 1, 2 having first_a is not null and last_b is not null""")
def _(feed):
    return J.trips_serving_both(
        feed,
        feed.stops.filter(F.col("stop_name").startswith("Green & ")),
        feed.stops.filter(F.col("stop_name").contains("& Oak")),
    )


@check("d17_service_routes_on_date", "D17 C7", """
    select gtfs_id, service_id, count(*) as routes, string_agg(route_id, ', ' order by route_id) as route_ids
    from (select distinct t.gtfs_id, t.service_id, t.route_id from trips t
          join service_days d on d.gtfs_id = t.gtfs_id and d.service_id = t.service_id
          where d.service_date = date '1995-02-08') group by 1, 2""")
def _(feed):
    return J.service_routes_on(feed, "1995-02-08")


@check("g1_sorted_stop_pairs_limit", "G1 G3", """
    select gtfs_id, stop_id, visits, round(share, 6) as share from (
      select gtfs_id, stop_id, count(*) as visits, count(*) * 100.0::double / sum(count(*)) over (partition by gtfs_id) as share
      from stop_times group by 1, 2) order by visits desc, gtfs_id, stop_id limit 5""")
def _(feed):
    return rounded(G.top_k(S.stop_visits(feed), [F.desc("visits"), "gtfs_id", "stop_id"], 5), "share")


@check("g2_busiest_date", "G2 E2 E41 C1", """
    select gtfs_id, cast(service_date as varchar) as service_date, trips from (
      select d.gtfs_id, d.service_date, count(*) as trips,
        row_number() over (partition by d.gtfs_id order by count(*) desc, d.service_date) as k
      from trips t join service_days d on d.gtfs_id = t.gtfs_id and d.service_id = t.service_id group by 1, 2)
    where k = 1""")
def _(feed):
    best = G.top_per(T.trips_per_date(feed), ["gtfs_id"], [F.desc("trips"), "service_date"])
    return best.withColumn("service_date", F.col("service_date").cast("string"))


@check("g3_top_routes", "G3 E1", """
    select gtfs_id, route_id, count(*) as trips from trips group by 1, 2 order by trips desc, gtfs_id, route_id limit 10""")
def _(feed):
    return G.top_k(T.trip_counts(feed, ["route_id"]), [F.desc("trips"), "gtfs_id", "route_id"], 10)


@check("g4_top_stops_per_route", "G4", """
    select gtfs_id, route_id, stop_id, visits, place from (
      select t.gtfs_id, t.route_id, s.stop_id, count(*) as visits,
        cast(row_number() over (partition by t.gtfs_id, t.route_id order by count(*) desc, s.stop_id) as integer) as place
      from stop_times s join trips t on s.gtfs_id = t.gtfs_id and s.trip_id = t.trip_id group by 1, 2, 3)
    where place <= 5""")
def _(feed):
    visits = J.trip_events(feed, ["stop_id"], ["route_id"]).groupBy("gtfs_id", "route_id", "stop_id").agg(F.count("*").alias("visits"))
    return G.top_per(visits, ["gtfs_id", "route_id"], [F.desc("visits"), "stop_id"], 5, rank="place")


@check("h1_union_all", "H1", """
    select gtfs_id, what, count(*) as n from (
      select gtfs_id, 'from' as what from transfers union all select gtfs_id, 'to' from transfers
      union all select gtfs_id, 'trip' from frequencies) group by 1, 2""")
def _(feed):
    tag = lambda df, what: df.select("gtfs_id", F.lit(what).alias("what"))
    every = tag(feed.transfers, "from").unionByName(tag(feed.transfers, "to")).unionByName(tag(feed.frequencies, "trip"))
    return every.groupBy("gtfs_id", "what").agg(F.count("*").alias("n"))


@check("h2_union_distinct", "H2", """
    select gtfs_id, from_stop_id as stop_id from transfers union
    select gtfs_id, to_stop_id from transfers union
    select gtfs_id, stop_id from stops where location_type = 1""")
def _(feed):
    return G.union_distinct(
        feed.transfers.select("gtfs_id", F.col("from_stop_id").alias("stop_id")),
        feed.transfers.select("gtfs_id", F.col("to_stop_id").alias("stop_id")),
        feed.stops.filter("location_type = 1").select("gtfs_id", "stop_id"),
    )


@check("h3_intersect", "H3", """
    select gtfs_id, first_stop as stop_id from trip_spans intersect select gtfs_id, last_stop from trip_spans""")
def _(feed):
    ends = T.trip_ends(feed.stop_times)
    return G.common(
        ends.select("gtfs_id", F.col("first_stop").alias("stop_id")),
        ends.select("gtfs_id", F.col("last_stop").alias("stop_id")),
    )


@check("h4_except", "H4", """
    select gtfs_id, route_id from routes except
    select gtfs_id, route_id from fare_rules where fare_id in (select fare_id from fare_attributes where price is not null)""")
def _(feed):
    priced = feed.fare_rules.join(feed.fare_attributes.filter("price is not null"), ["gtfs_id", "fare_id"], "left_semi")
    return G.only_in_first(feed.routes.select("gtfs_id", "route_id"), priced.select("gtfs_id", "route_id"))


@check("h5_distinct", "H5", """
    select distinct gtfs_id, route_id, service_id from trips""")
def _(feed):
    return feed.trips.select("gtfs_id", "route_id", "service_id").distinct()


@check("b_service_time_texts", "B4 B5 B8 B21", """
    select gtfs_id, cast(departure_secs // 86400 as bigint) as day_offset,
      cast((departure_secs % 86400) // 3600 as bigint) as folded_hour, count(*) as events,
      max(printf('%02d:%02d:%02d', departure_secs // 3600, departure_secs % 3600 // 60, departure_secs % 60)) as last_text,
      max(printf('%02d:%02d:%02d', departure_secs % 86400 // 3600, departure_secs % 3600 // 60, departure_secs % 60) ||
        case when departure_secs >= 86400 then ' (next day)' else '' end) as last_clock,
      cast(sum(departure_secs) as bigint) as total_secs
    from stop_times group by 1, 2, 3""")
def _(feed):
    text = C.seconds_to_hms("departure_secs")
    events = feed.stop_times.select(
        "gtfs_id", C.hms_to_seconds(text).alias("secs"), text.alias("text"), C.clock_text("departure_secs").alias("clock")
    )
    return events.groupBy(
        "gtfs_id", C.day_offset("secs").alias("day_offset"), C.hour_of("secs", fold=True).alias("folded_hour")
    ).agg(
        F.count("*").alias("events"), F.max("text").alias("last_text"), F.max("clock").alias("last_clock"), F.sum("secs").alias("total_secs")
    )


@check("b_casts_and_keys", "B1 B2 B3 B6", """
    select gtfs_id, count(*) as n, count(try_cast(raw as integer)) as ints, count(try_cast(raw as double)) as doubles,
      count(try_strptime(day, '%Y%m%d')) as dates, cast(max(cast(try_strptime(day, '%Y%m%d') as date)) as varchar) as last_date,
      max(gtfs_id || raw) as last_key, count(gtfs_id || raw) as keys,
      min(regexp_extract('stable/gtfs/' || gtfs_id || '/latest/_extracted/trips.txt',
        '^(?:s3://[^/]+/)?(?:stable/)?(?:gtfs|sandbox)/([^/]+)/', 1)) as path_feed
    from (select 'r' || ((o_orderkey // 7) % 5) as gtfs_id,
        case o_orderkey % 4 when 0 then null when 1 then 'x' || o_orderkey else cast(o_orderkey as varchar) end as raw,
        case when o_orderkey % 5 = 0 then 'n/a' else strftime(o_orderdate, '%Y%m%d') end as day
      from orders) group by 1""")
def _(feed):
    raw = feed.orders.selectExpr(
        "concat('r', cast(pmod(o_orderkey div 7, 5) as string)) as gtfs_id",
        "case o_orderkey % 4 when 0 then null when 1 then concat('x', o_orderkey) else cast(o_orderkey as string) end as raw",
        "if(o_orderkey % 5 = 0, 'n/a', date_format(o_orderdate, 'yyyyMMdd')) as day",
    )
    path = F.concat(F.lit("stable/gtfs/"), "gtfs_id", F.lit("/latest/_extracted/trips.txt"))
    day, key = C.try_yyyymmdd("day"), C.namespaced("gtfs_id", "raw")
    return raw.groupBy("gtfs_id").agg(
        F.count("*").alias("n"), F.count(C.try_int("raw")).alias("ints"), F.count(C.try_double("raw")).alias("doubles"),
        F.count(day).alias("dates"), F.max(day).cast("string").alias("last_date"),
        F.max(key).alias("last_key"), F.count(key).alias("keys"), F.min(C.feed_id_from_path(path)).alias("path_feed"),
    )


@check("b_day_predicates", "B9 B10 B11", """
    select gtfs_id, service_id, (friday = 1) as fridays, (saturday = 1 or sunday = 1) as any_weekend,
      ((saturday = 1 or sunday = 1) and monday + tuesday + wednesday + thursday + friday = 0) as weekend_only,
      (monday + tuesday + wednesday + thursday + friday = 5) as all_weekdays,
      (monday + tuesday + wednesday + thursday + friday + saturday + sunday = 7) as daily,
      (monday = 1 and sunday <> 1) as monday_not_sunday,
      (date '1995-02-15' between start_date and end_date) as valid
    from calendar""")
def _(feed):
    return feed.calendar.select(
        "gtfs_id", "service_id", C.runs_on("friday").alias("fridays"), C.runs_on(C.WEEKEND).alias("any_weekend"),
        C.runs_on(C.WEEKEND, "only").alias("weekend_only"), C.runs_on(C.WEEKDAYS, "all").alias("all_weekdays"),
        C.runs_on(C.DAYS, "all").alias("daily"),
        (C.runs_on("monday") & ~C.runs_on("sunday")).alias("monday_not_sunday"),
        C.valid_on("1995-02-15").alias("valid"),
    )


@check("b_event_filters", "B12 B13 B14 B16 B17 B18", """
    select s.gtfs_id,
      count(*) filter (where departure_secs between 21600 and 32400 or departure_secs between 54000 and 68400) as peak,
      count(*) filter (where departure_secs >= 21600 and departure_secs < 32400) as morning_left,
      count(*) filter (where departure_secs > 86400) as after_midnight,
      count(*) filter (where shape_dist_traveled is null) as no_distance,
      count(*) filter (where stop_sequence % 3 = 0) as every_third,
      count(*) filter (where stop_lat between 35.02 and 35.06 and stop_lon between 139.01 and 139.07) as in_box,
      count(*) filter (where location_type = 0 and parent_station is not null) as at_platforms,
      count(*) filter (where wheelchair_boarding = 1) as accessible,
      count(*) filter (where contains(stop_name, 'MB')) as mid_block,
      count(*) filter (where ends_with(stop_name, 'Corner)')) as corners
    from stop_times s join stops p on s.gtfs_id = p.gtfs_id and s.stop_id = p.stop_id group by 1""")
def _(feed):
    events = J.with_stop(
        feed.stop_times, feed,
        ["stop_lat", "stop_lon", "location_type", "parent_station", "wheelchair_boarding", "stop_name"], "inner",
    )
    dep = "departure_secs"
    return events.groupBy("gtfs_id").agg(
        F.count_if(C.in_windows(dep, [C.MORNING_PEAK, C.EVENING_PEAK])).alias("peak"),
        F.count_if(C.in_windows(dep, [C.MORNING_PEAK], "left")).alias("morning_left"),
        F.count_if(C.after_midnight(dep)).alias("after_midnight"),
        F.count_if(F.col("shape_dist_traveled").isNull()).alias("no_distance"),
        F.count_if(C.every_nth("stop_sequence", 3)).alias("every_third"),
        F.count_if(C.in_box("stop_lat", "stop_lon", (35.02, 35.06, 139.01, 139.07))).alias("in_box"),
        F.count_if((F.col("location_type") == 0) & F.col("parent_station").isNotNull()).alias("at_platforms"),
        F.count_if(F.col("wheelchair_boarding") == 1).alias("accessible"),
        F.count_if(F.col("stop_name").contains("MB")).alias("mid_block"),
        F.count_if(F.col("stop_name").endswith("Corner)")).alias("corners"),
    )


@check("b_labels_and_bins", "B19 B20 B22 B23 B24", """
    select s.gtfs_id,
      case p.wheelchair_boarding when 1 then 'available' when 2 then 'not available' else 'no information' end as wheelchair,
      case when arrival_secs // 3600 between 6 and 8 then 'Morning Peak' when arrival_secs // 3600 between 9 and 14 then 'Midday'
        when arrival_secs // 3600 between 15 and 18 then 'Evening Peak' else 'Night' end as period,
      case when shape_dist_traveled > 2000 then '>2km' when shape_dist_traveled > 1000 then '1-2km'
        when shape_dist_traveled > 500 then '500-1000m' when shape_dist_traveled > 200 then '200-500m'
        when shape_dist_traveled > 100 then '100-200m' when shape_dist_traveled > 50 then '50-100m'
        when shape_dist_traveled > 0 then '0-50m' end as spacing,
      count(*) as n, round(sum(shape_dist_traveled / 1000), 6) as km, round(sum(arrival_secs / 3600), 4) as hours
    from stop_times s join stops p on s.gtfs_id = p.gtfs_id and s.stop_id = p.stop_id group by 1, 2, 3, 4""")
def _(feed):
    events = J.with_stop(feed.stop_times, feed, ["wheelchair_boarding"], "inner")
    return events.groupBy(
        "gtfs_id", C.wheelchair_label("wheelchair_boarding").alias("wheelchair"),
        C.day_period("arrival_secs").alias("period"),
        C.bin_label("shape_dist_traveled", C.SPACING_EDGES, C.SPACING_LABELS).alias("spacing"),
    ).agg(
        F.count("*").alias("n"), F.round(F.sum(C.km("shape_dist_traveled")), 6).alias("km"),
        F.round(F.sum(C.hours("arrival_secs")), 4).alias("hours"),
    )


@check("b_name_keywords", "B15 B23", """
    select gtfs_id, route_id, coalesce(regexp_matches(lower(concat_ws(' ', route_short_name, route_long_name)),
      'express|limited|rapid|fast'), false) as express, coalesce(route_long_name, route_short_name) as name from routes""")
def _(feed):
    return feed.routes.select(
        "gtfs_id", "route_id", C.name_has_any(C.full_name(), C.EXPRESS_KEYWORDS).alias("express"),
        C.display_name().alias("name"),
    )
