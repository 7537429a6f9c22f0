"""Side-by-side queries: aggregations over trips, stops, routes and fares."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayrunner.catalog.registry import check
from dayrunner.catalog.tools import geodesic_sql, rounded, texts
from dayrunner.functions import columns as C
from dayrunner.operators import choose as G
from dayrunner.operators import joins as J
from dayrunner.operators import service as S
from dayrunner.operators import trips as T
from dayrunner.plans import views as V

BY_TRIP = "t.gtfs_id = s.gtfs_id and t.trip_id = s.trip_id"
BY_ROUTE = "r.gtfs_id = t.gtfs_id and r.route_id = t.route_id"
BY_SERVICE = "c.gtfs_id = t.gtfs_id and c.service_id = t.service_id"
DAY_ROWS = """(select gtfs_id, service_id, unnest(['monday','tuesday','wednesday','thursday','friday','saturday','sunday']) as day,
      unnest([monday, tuesday, wednesday, thursday, friday, saturday, sunday]) as flag from calendar)"""


@check("e1_trips_per_service", "E1", "select gtfs_id, service_id, count(*) as trips from trips group by 1, 2")
def _(feed):
    return T.trip_counts(feed, ["service_id"])


@check("e2_trips_per_date", "E2", """
    select d.gtfs_id, cast(d.service_date as varchar) as service_date, count(*) as trips
    from trips t join service_days d on d.gtfs_id = t.gtfs_id and d.service_id = t.service_id group by 1, 2""")
def _(feed):
    return texts(T.trips_per_date(feed), "service_date")


@check("e3_trips_per_weekday", "E3", f"""
    select t.gtfs_id, c.day, cast(sum(flag) as bigint) as trips from trips t join {DAY_ROWS} c on {BY_SERVICE} group by 1, 2""")
def _(feed):
    return T.trips_per_weekday(feed)


@check("e4_trips_per_weekday_route", "E4", f"""
    select t.gtfs_id, t.route_id, c.day, count(*) as trips from trips t join {DAY_ROWS} c on {BY_SERVICE}
    where flag = 1 group by 1, 2, 3""")
def _(feed):
    return T.trips_per_weekday(feed, ["route_id"]).filter("trips > 0")


@check("e5_service_day_totals", "E5", """
    select gtfs_id, false as shared_removals, count(distinct service_date) as days,
      cast(min(service_date) as varchar) as first_date, cast(max(service_date) as varchar) as last_date
    from service_days group by 1
    union all
    select d.gtfs_id, true, count(distinct service_date), cast(min(service_date) as varchar), cast(max(service_date) as varchar)
    from service_days d where not exists (select 1 from calendar_dates e
      where e.exception_type = 2 and e.gtfs_id = d.gtfs_id and e.date = d.service_date) group by 1""")
def _(feed):
    each = [
        T.service_day_totals(feed, shared_removals=flag).withColumn("shared_removals", F.lit(flag))
        for flag in (False, True)
    ]
    return texts(each[0].unionByName(each[1]), "first_date", "last_date")


@check("e6_feed_validity", "E6 V5", """
    select c.gtfs_id, cast(coalesce(min(feed_start_date), min(start_date)) as varchar) as valid_from,
      cast(coalesce(max(feed_end_date), max(end_date)) as varchar) as valid_to
    from calendar c left join feed_info f on c.gtfs_id = f.gtfs_id group by 1""")
def _(feed):
    return texts(T.feed_validity(feed), "valid_from", "valid_to")


@check("e7_trip_durations", "E7", f"""
    select t.gtfs_id, t.route_id, t.direction_id, cast(sum(last_arrival - first_arrival) as bigint) as arrivals,
      cast(sum(end_secs - start_secs) as bigint) as ends, cast(sum(last_departure - first_departure) as bigint) as departures
    from trip_spans s join trips t on {BY_TRIP} group by 1, 2, 3""")
def _(feed):
    keys = ["gtfs_id", "route_id", "direction_id"]
    spans = T.trip_spans(feed.stop_times).join(feed.trips, V.TRIP)
    return spans.groupBy(*keys).agg(
        *[F.sum(F.col(b) - F.col(a)).alias(kind) for kind, (b, a) in T.DURATIONS.items()]
    )


@check("e8_mean_duration_by_route", "E8", f"""
    select t.gtfs_id, t.route_id, round(avg(last_arrival - first_arrival), 6) as mean_secs, count(*) as trips
    from trip_spans s join trips t on {BY_TRIP} group by 1, 2""")
def _(feed):
    return rounded(T.duration_by_route(feed), "mean_secs")


@check("e9_duration_variability", "E9", f"""
    select t.gtfs_id, t.route_id, round(stddev_samp(d), 9) as std_min, round(avg(d), 9) as mean_min,
      round(min(d), 9) as least_min, round(max(d), 9) as most_min, count(*) as trips,
      round(stddev_samp(d) / nullif(avg(d), 0), 9) as cv
    from (select gtfs_id, trip_id, (last_departure - first_departure) / 60 as d from trip_spans) s
      join trips t on {BY_TRIP} group by 1, 2 having count(*) >= 5""")
def _(feed):
    return rounded(T.duration_variability(feed), "std_min", "mean_min", "least_min", "most_min", "cv", places=9)


@check("e10_trip_distances", "E10", f"""
    select t.gtfs_id, t.route_id, count(s.dist) as trips, round(sum(s.dist), 6) as metres, round(max(s.dist), 6) as longest
    from trip_spans s join trips t on {BY_TRIP} group by 1, 2""")
def _(feed):
    return rounded(
        T.trip_distances(feed).groupBy("gtfs_id", "route_id").agg(
            F.count("distance").alias("trips"), F.sum("distance").alias("metres"), F.max("distance").alias("longest")
        ),
        "metres", "longest",
    )


@check("e11_distance_totals", "E11", f"""
    select t.gtfs_id, t.route_id, count(*) as trips, round(sum(coalesce(s.dist, l.length)), 6) as total_m
    from trip_spans s join trips t on {BY_TRIP} join calendar c on {BY_SERVICE}
      left join (select gtfs_id, shape_id, max(shape_dist_traveled) as length from shapes group by 1, 2) l
        on l.gtfs_id = t.gtfs_id and l.shape_id = t.shape_id
    where c.sunday = 1 group by 1, 2""")
def _(feed):
    return rounded(T.distance_totals(feed, "sunday"), "total_m")


@check("e12_longest_route", "E12 G2", """
    select gtfs_id, route_id, round(length, 6) as length from (
      select *, row_number() over (partition by gtfs_id order by length desc, route_id) as k from (
        select t.gtfs_id, t.route_id, max(shape_dist_traveled) as length
        from trips t join shapes h on h.gtfs_id = t.gtfs_id and h.shape_id = t.shape_id group by 1, 2)) where k = 1""")
def _(feed):
    best = G.top_per(T.route_lengths(feed), ["gtfs_id"], [F.desc_nulls_last("length"), "route_id"])
    return rounded(best, "length")


@check("e13_route_speeds", "E13", f"""
    with known as (
      select gtfs_id, trip_id, arg_max(shape_dist_traveled, stop_sequence) - arg_min(shape_dist_traveled, stop_sequence) as m,
        arg_max(arrival_secs, stop_sequence) - arg_min(arrival_secs, stop_sequence) as secs
      from stop_times where shape_dist_traveled is not null group by 1, 2)
    select t.gtfs_id, t.route_id, 'ends' as kind, round(avg(m / nullif(secs, 0) * 3.6::double), 6) as mean_kmh, count(*) as trips
    from known s join trips t on {BY_TRIP} where m / nullif(secs, 0) > 0 group by 1, 2
    union all
    select t.gtfs_id, t.route_id, 'minmax', round(avg(dist / nullif(last_arrival - first_arrival, 0) * 3.6::double), 6), count(*)
    from trip_spans s join trips t on {BY_TRIP} where dist / nullif(last_arrival - first_arrival, 0) > 0 group by 1, 2
    union all
    select t.gtfs_id, t.route_id, 'span', round(avg(dist / nullif(end_secs - start_secs, 0) * 3.6::double), 6), count(*)
    from trip_spans s join trips t on {BY_TRIP} where dist / nullif(end_secs - start_secs, 0) > 0 group by 1, 2""")
def _(feed):
    kinds = [T.route_speeds(feed, k).withColumn("kind", F.lit(k)) for k in ("ends", "minmax", "span")]
    return rounded(kinds[0].unionByName(kinds[1]).unionByName(kinds[2]), "mean_kmh")


SHAPE_SPEEDS = f"""shape_speeds as (
      select gtfs_id, route_id, avg(kmh) as mean_kmh from (
        select p.gtfs_id, p.route_id, length / secs * 3.6::double as kmh
        from (select t.gtfs_id, t.route_id, t.shape_id, avg(end_secs - start_secs) as secs
              from trip_spans s join trips t on {BY_TRIP} group by 1, 2, 3) p
          join (select gtfs_id, shape_id, max(shape_dist_traveled) as length from shapes group by 1, 2) l
            on l.gtfs_id = p.gtfs_id and l.shape_id = p.shape_id
        where secs > 0) group by 1, 2)"""


@check("e13_route_speeds_by_shape", "E13 G2", f"""
    with {SHAPE_SPEEDS} select gtfs_id, route_id, round(mean_kmh, 6) as mean_kmh from shape_speeds""")
def _(feed):
    return rounded(T.route_speeds_by_shape(feed), "mean_kmh")


@check("e14_slow_routes", "E14 E30", f"""
    with {SHAPE_SPEEDS}
    select r.gtfs_id, count(*) filter (where mean_kmh < 5) as slow_routes, count(*) as routes,
      round(count(*) filter (where mean_kmh < 5) * 100.0::double / count(*), 6) as share
    from routes r left join shape_speeds s on s.gtfs_id = r.gtfs_id and s.route_id = r.route_id group by 1""")
def _(feed):
    return rounded(T.slow_share(T.route_speeds_by_shape(feed), feed, 5.0), "share")


@check("e15_dwell_by_route", "E15", f"""
    select t.gtfs_id, t.route_id, round(avg(departure_secs - arrival_secs), 6) as dwell_secs, count(*) as events
    from stop_times s join trips t on {BY_TRIP} group by 1, 2""")
def _(feed):
    return rounded(T.dwell_by_route(feed), "dwell_secs")


@check("e15_dwell_by_stop", "E15", """
    select gtfs_id, stop_id, round(avg(departure_secs - arrival_secs), 6) as dwell_secs, count(*) as events
    from stop_times group by 1, 2""")
def _(feed):
    return rounded(T.dwell_by_stop(feed), "dwell_secs")


@check("e16_time_between_stops", "E16", f"""
    select t.gtfs_id, t.route_id,
      round(cast(sum(last_arrival - first_arrival) as double) / nullif(cast(sum(n_stops - 1) as double), 0), 6) as mean_gap_secs
    from trip_spans s join trips t on {BY_TRIP} group by 1, 2""")
def _(feed):
    return rounded(T.time_between_stops(feed), "mean_gap_secs")


@check("e17_stop_visits", "E17 B19", """
    select v.gtfs_id, v.stop_id, visits, round(visits * 100.0::double / total, 6) as share, p.stop_name
    from (select *, sum(visits) over (partition by gtfs_id) as total from
      (select gtfs_id, stop_id, count(*) as visits from stop_times group by 1, 2)) v
      left join stops p on v.gtfs_id = p.gtfs_id and v.stop_id = p.stop_id""")
def _(feed):
    return rounded(J.with_stop(S.stop_visits(feed), feed, ["stop_name"]), "share")


@check("e18_routes_per_stop", "E18", "select gtfs_id, stop_id, count(*) as routes from route_stops group by 1, 2")
def _(feed):
    return S.routes_per_stop(J.route_stops(feed))


@check("e19_stops_per_route", "E19", "select gtfs_id, route_id, count(*) as stops from route_stops group by 1, 2")
def _(feed):
    return S.stops_per_route(J.route_stops(feed))


@check("e20_shapes_per_route", "E20", """
    select gtfs_id, route_id, count(distinct shape_id) as shapes from trips group by 1, 2""")
def _(feed):
    return S.shapes_per_route(feed)


@check("e21_route_types_per_stop", "E21", """
    select gtfs_id, stop_id, count(*) as n_types, string_agg(cast(route_type as varchar), ', ' order by route_type) as types
    from (select distinct s.gtfs_id, s.stop_id, r.route_type from route_stops s
          join routes r on r.gtfs_id = s.gtfs_id and r.route_id = s.route_id)
    group by 1, 2 having count(*) > 1""")
def _(feed):
    return S.route_types_per_stop(feed).filter("n_types > 1")


@check("e22_route_type_distribution", "E22 B19", """
    select gtfs_id, route_type, case route_type when 0 then 'Light Rail' when 1 then 'Subway' when 2 then 'Rail' else 'Bus' end as label,
      count(*) as routes, round(count(*) * 100.0::double / sum(count(*)) over (partition by gtfs_id), 6) as share
    from routes group by 1, 2""")
def _(feed):
    return rounded(S.route_type_distribution(feed), "share")


@check("e23_connections_per_route", "E23", """
    select a.gtfs_id, a.route_id, count(distinct b.route_id) - 1 as connections
    from route_stops a join route_stops b on a.gtfs_id = b.gtfs_id and a.stop_id = b.stop_id group by 1, 2""")
def _(feed):
    return J.connection_counts(J.route_stops(feed))


@check("e24_vehicles", "E24", f"""
    select t.gtfs_id, case when count(distinct block_id) = 0 then count(distinct trip_id) else count(distinct block_id) end as vehicles
    from trips t join calendar c on {BY_SERVICE} where friday = 1 group by 1""")
def _(feed):
    return S.vehicles(V.typical_trips(feed, "friday"))


@check("e25_peak_headways", "E25 B11 B12", f"""
    select t.gtfs_id, t.route_id, t.direction_id, count(*) as trips,
      round(cast(max(start_secs) - min(start_secs) as double) / nullif(count(*) - 1, 0), 6) as headway_secs,
      round(3600.0::double / nullif(cast(max(start_secs) - min(start_secs) as double) / nullif(count(*) - 1, 0), 0), 6) as trips_per_hour
    from trip_spans s join trips t on {BY_TRIP} join calendar c on {BY_SERVICE}
    where wednesday = 1 and start_secs between 21600 and 32400 group by 1, 2, 3""")
def _(feed):
    return rounded(S.peak_headways(V.typical_feed(feed, "wednesday")), "headway_secs", "trips_per_hour")


@check("e26_departures_by_hour", "E26 B21", f"""
    select s.gtfs_id, cast(departure_secs // 3600 as bigint) as hour, count(*) as departures
    from stop_times s join trips t on {BY_TRIP} join calendar c on {BY_SERVICE} where wednesday = 1 group by 1, 2""")
def _(feed):
    trips = V.typical_trips(feed, "wednesday").select(*V.TRIP)
    return S.departures_by_hour(feed.replace(stop_times=feed.stop_times.join(trips, V.TRIP, "left_semi")))


@check("e26_trips_by_hour", "E26", """
    select g.gtfs_id, g.hour, coalesce(trips, 0) as trips
    from (select gtfs_id, unnest(range(24)) as hour from (select distinct gtfs_id from stop_times)) g
      left join (select gtfs_id, cast(arrival_secs // 3600 as bigint) as hour, count(distinct trip_id) as trips
                 from stop_times group by 1, 2) c on c.gtfs_id = g.gtfs_id and c.hour = g.hour""")
def _(feed):
    return S.trips_by_hour(feed)


@check("e27_trips_per_hour_by_zone", "E27", """
    with hourly as (
      select gtfs_id, cast(arrival_secs // 3600 as bigint) as hour, count(distinct trip_id) as trips from stop_times group by 1, 2)
    select gtfs_id, case when hour < 6 then 'Early Morning' when hour < 10 then 'Morning Peak' when hour < 15 then 'Midday'
        when hour < 19 then 'Afternoon Peak' else 'Evening' end as zone,
      round(sum(trips) / max(case when hour < 6 then 6 when hour < 10 then 4 when hour < 15 then 5 when hour < 19 then 4 else 5 end), 6) as trips_per_hour
    from hourly where hour < 24 group by 1, 2""")
def _(feed):
    return rounded(S.trips_per_hour_by_zone(feed), "trips_per_hour")


@check("e28_service_span", "E28", f"""
    select t.gtfs_id, t.route_id, min(first_departure) as first_departure, max(last_arrival) as last_arrival,
      round((max(last_arrival) - min(first_departure)) / 3600, 6) as hours
    from trip_spans s join trips t on {BY_TRIP} group by 1, 2""")
def _(feed):
    return rounded(S.service_span(feed), "hours")


@check("e28_operational_hours", "E28 E35", f"""
    select gtfs_id, round(avg(case when h < 0 then h + 24 else h end), 6) as mean_hours from (
      select t.gtfs_id, t.route_id, (max(last_departure) - min(first_arrival)) / 3600 as h
      from trip_spans s join trips t on {BY_TRIP} join calendar c on {BY_SERVICE} where tuesday = 1 group by 1, 2) group by 1""")
def _(feed):
    span = S.service_span(V.typical_feed(feed, "tuesday"), wrap=True)
    return rounded(span.groupBy("gtfs_id").agg(F.avg("hours").alias("mean_hours")), "mean_hours")


@check("e29_last_departures", "E29 B5", f"""
    select gtfs_id, stop_id, last_secs,
      printf('%02d:%02d:%02d', last_secs % 86400 // 3600, last_secs % 3600 // 60, last_secs % 60) ||
        case when last_secs >= 86400 then ' (next day)' else '' end as clock
    from (select s.gtfs_id, s.stop_id, max(departure_secs) as last_secs
      from stop_times s join trips t on {BY_TRIP} join calendar c on {BY_SERVICE} where monday = 1 group by 1, 2)""")
def _(feed):
    return S.last_departures(feed, "monday")


@check("e30_feed_shares", "E30", """
    select r.gtfs_id,
      round(avg(case when regexp_matches(lower(concat_ws(' ', route_short_name, route_long_name)), 'express|limited|rapid|fast') then 1 else 0 end) * 100, 6) as express_routes,
      round(avg(case when contains(lower(route_long_name), 'express') then 1 else 0 end) * 100, 6) as named_express,
      round(avg(case when route_type = 3 then 1 else 0 end) * 100, 6) as bus_routes,
      min(b.bike_trips) as bike_trips, min(p.accessible_stops) as accessible_stops
    from routes r
      join (select gtfs_id, round(avg(case when bikes_allowed = 1 then 1 else 0 end) * 100, 6) as bike_trips from trips group by 1) b on b.gtfs_id = r.gtfs_id
      join (select gtfs_id, round(avg(case when wheelchair_boarding = 1 then 1 else 0 end) * 100, 6) as accessible_stops from stops group by 1) p on p.gtfs_id = r.gtfs_id
    group by 1""")
def _(feed):
    return rounded(S.feed_shares(feed), "express_routes", "named_express", "bus_routes", "bike_trips", "accessible_stops")


@check("e30_accessible_trip_share", "E30", """
    select t.gtfs_id, round(avg(case when x.trip_id is not null then 1 else 0 end) * 100, 6) as accessible_trips, count(*) as trips
    from trips t left join (select distinct s.gtfs_id, s.trip_id from stop_times s
      join stops p on s.gtfs_id = p.gtfs_id and s.stop_id = p.stop_id where wheelchair_boarding = 1) x
      on x.gtfs_id = t.gtfs_id and x.trip_id = t.trip_id group by 1""")
def _(feed):
    return rounded(S.accessible_trip_share(feed), "accessible_trips")


@check("e31_fully_accessible_routes", "E31", """
    select s.gtfs_id, s.route_id, bool_and(coalesce(p.wheelchair_boarding = 1, false)) as accessible
    from route_stops s left join stops p on s.gtfs_id = p.gtfs_id and s.stop_id = p.stop_id group by 1, 2""")
def _(feed):
    return S.fully_accessible_routes(feed)


NETWORK_FARES = """network_fares as (
      select r.gtfs_id, r.route_id, r.route_type, p.amount
      from routes r join fare_leg_rules l on l.gtfs_id = r.gtfs_id and l.network_id = r.network_id
        left join fare_products p on p.gtfs_id = l.gtfs_id and p.fare_product_id = l.fare_product_id)"""


@check("e32_fare_by_route_type", "E32 B19", f"""
    with {NETWORK_FARES}
    select gtfs_id, route_type, round(avg(amount), 6) as mean_fare, round(max(amount), 6) as max_fare, count(*) as rules
    from network_fares group by 1, 2""")
def _(feed):
    return rounded(S.fare_by_route_type(feed), "mean_fare", "max_fare")


@check("e32_fare_by_route", "E32", f"""
    with {NETWORK_FARES}
    select gtfs_id, route_id, round(avg(amount), 6) as mean_fare, round(max(amount), 6) as max_fare
    from network_fares group by 1, 2""")
def _(feed):
    return rounded(S.fare_by_route(feed), "mean_fare", "max_fare")


@check("e32_most_common_fare", "E32 G2", f"""
    with {NETWORK_FARES}
    select gtfs_id, round(amount, 6) as amount, times, routes from (
      select gtfs_id, amount, count(*) as times, count(distinct route_id) as routes,
        row_number() over (partition by gtfs_id order by count(*) desc, amount) as k
      from network_fares where amount is not null group by 1, 2) where k = 1""")
def _(feed):
    return rounded(G.top_per(S.fare_frequencies(feed), ["gtfs_id"], [F.desc("times"), "amount"]), "amount")


@check("e33_fare_products_by_medium", "E33", """
    select p.gtfs_id, m.fare_media_type, m.fare_media_name, count(*) as products, count(distinct fare_product_id) as distinct_products,
      round(min(amount), 6) as least, round(max(amount), 6) as most, round(avg(amount), 6) as mean
    from fare_products p left join fare_media m on m.gtfs_id = p.gtfs_id and m.fare_media_id = p.fare_media_id group by 1, 2, 3""")
def _(feed):
    return rounded(S.fare_products_by_medium(feed), "least", "most", "mean")


@check("e34_trip_weighted_fare", "E34 D14", """
    select n.gtfs_id, round(sum(price * trips) / cast(sum(trips) as double), 6) as weighted_fare
    from (select gtfs_id, route_id, count(*) as trips from trips group by 1, 2) n
      left join (select r.gtfs_id, r.route_id, avg(price) as price from fare_rules r
        left join fare_attributes a on r.gtfs_id = a.gtfs_id and r.fare_id = a.fare_id group by 1, 2) f
      on f.gtfs_id = n.gtfs_id and f.route_id = n.route_id group by 1""")
def _(feed):
    return rounded(S.trip_weighted_fare(feed), "weighted_fare")


@check("e35_trips_per_route_summary", "E35 E48", f"""
    select gtfs_id, count(n) as n, cast(sum(n) as bigint) as total, round(avg(n), 6) as mean, min(n) as least, max(n) as most,
      round(stddev_samp(n), 6) as stddev, median(n) as median
    from (select t.gtfs_id, t.route_id, count(*) as n from trips t join calendar c on {BY_SERVICE}
          where monday = 1 or tuesday = 1 or wednesday = 1 or thursday = 1 or friday = 1 group by 1, 2)
    group by 1""")
def _(feed):
    counts = T.trip_counts(V.typical_feed(feed, C.WEEKDAYS), ["route_id"])
    return rounded(T.summary(counts, ["gtfs_id"], "trips"), "mean", "stddev", "median")


@check("e36_stop_extent", "E36", """
    select gtfs_id, round(avg(stop_lat), 6) as lat, round(avg(stop_lon), 6) as lon, min(stop_lat) as south, max(stop_lat) as north,
      min(stop_lon) as west, max(stop_lon) as east from stops group by 1""")
def _(feed):
    return rounded(S.stop_extent(feed), "lat", "lon")


@check("e37_around_the_clock", "E37", f"""
    select t.gtfs_id, t.route_id,
      bool_and(monday = 1 and tuesday = 1 and wednesday = 1 and thursday = 1 and friday = 1 and saturday = 1 and sunday = 1) as daily,
      coalesce(bool_or(h.hours = 24), false) as all_hours
    from trips t join calendar c on {BY_SERVICE}
      left join (select gtfs_id, trip_id, count(distinct departure_secs % 86400 // 3600) as hours from stop_times group by 1, 2) h
        on h.gtfs_id = t.gtfs_id and h.trip_id = t.trip_id
    group by 1, 2""")
def _(feed):
    return S.around_the_clock(feed)


@check("e38_circular_routes", "E38", f"""
    select t.gtfs_id, t.route_id, count(*) filter (where first_stop = last_stop) as loop_trips, bool_or(first_stop = last_stop) as circular
    from trip_spans s join trips t on {BY_TRIP} group by 1, 2""")
def _(feed):
    return S.circular_routes(feed)


@check("e38_circular_by_sample_trip", "E38", f"""
    select t.gtfs_id, t.route_id, arg_min(first_stop = last_stop, t.trip_id) as circular
    from trip_spans s join trips t on {BY_TRIP} group by 1, 2""")
def _(feed):
    return S.circular_by_sample(feed)


@check("e39_terminal_stops", "E39 H2", """
    select gtfs_id, first_stop as stop_id from trip_spans union select gtfs_id, last_stop from trip_spans""")
def _(feed):
    return S.terminal_stops(feed)


@check("e40_patterns_per_route", "E40", f"""
    select t.gtfs_id, t.route_id, count(distinct p) as patterns, count(*) as trips
    from (select gtfs_id, trip_id, string_agg(stop_id, '|' order by stop_sequence) as p from stop_times group by 1, 2) s
      join trips t on {BY_TRIP} group by 1, 2""")
def _(feed):
    return S.patterns_per_route(feed)


@check("e41_busiest_week", "E41", """
    select d.gtfs_id, cast(cast(date_trunc('week', d.service_date) as date) as varchar) as week, count(*) as trips,
      count(distinct t.service_id) as services, count(distinct t.route_id) as routes
    from trips t join service_days d on d.gtfs_id = t.gtfs_id and d.service_id = t.service_id group by 1, 2""")
def _(feed):
    return texts(T.busiest_week(feed), "week")


@check("e42_stops_by_reach", "E42", f"""
    select n.gtfs_id, n.stop_id, n.routes, n.routes = a.all_routes as by_all_routes, n.routes = 1 as by_one_route, weekend_only, peak_only
    from (select gtfs_id, stop_id, count(*) as routes from route_stops group by 1, 2) n
      join (select gtfs_id, count(*) as all_routes from routes group by 1) a on a.gtfs_id = n.gtfs_id
      join (select s.gtfs_id, s.stop_id,
          bool_and((saturday = 1 or sunday = 1) and monday + tuesday + wednesday + thursday + friday = 0) as weekend_only,
          bool_and(departure_secs between 21600 and 32400 or departure_secs between 54000 and 68400) as peak_only
        from stop_times s join trips t on {BY_TRIP} join calendar c on {BY_SERVICE} group by 1, 2) u
      on u.gtfs_id = n.gtfs_id and u.stop_id = n.stop_id""")
def _(feed):
    return S.stops_by_reach(feed)


@check("e43_service_classes", "E43", """
    select c.gtfs_id, c.service_id,
      case when saturday + sunday > 0 and monday + tuesday + wednesday + thursday + friday = 0 then 'weekend'
        when saturday + sunday = 0 and monday + tuesday + wednesday + thursday + friday > 0 then 'weekday'
        when saturday + sunday + monday + tuesday + wednesday + thursday + friday > 0 then 'mixed' else 'none' end as class,
      coalesce(d.days, 0) as days, coalesce(r.routes, 0) as routes
    from calendar c
      left join (select gtfs_id, service_id, count(*) as days from service_days group by 1, 2) d on d.gtfs_id = c.gtfs_id and d.service_id = c.service_id
      left join (select gtfs_id, service_id, count(distinct route_id) as routes from trips group by 1, 2) r on r.gtfs_id = c.gtfs_id and r.service_id = c.service_id""")
def _(feed):
    return T.service_classes(feed)


@check("e44_stops_per_trip", "E44", f"""
    select r.gtfs_id, r.route_type, max(n_stops) as most, round(avg(n_stops), 6) as mean,
      count(*) filter (where n_stops > 5) as long_trips, count(*) as trips
    from trip_spans s join trips t on {BY_TRIP} join routes r on {BY_ROUTE} group by 1, 2""")
def _(feed):
    return rounded(T.stop_count_stats(feed, 5), "mean")


@check("e45_two_way_routes", "E45", """
    select gtfs_id, route_id, count(distinct direction_id) > 1 as two_way from trips group by 1, 2""")
def _(feed):
    return S.two_way_routes(feed)


@check("e46_service_hours", "E46", f"""
    with secs as (select t.gtfs_id, t.service_id, t.route_id, last_arrival - first_arrival as d from trip_spans s join trips t on {BY_TRIP})
    select gtfs_id, 'route' as kind, route_id as what, round(sum(d) / 3600, 6) as hours from secs group by 1, 2, 3
    union all
    select t.gtfs_id, 'date', cast(service_date as varchar), round(sum(d) / 3600, 6)
    from secs t join service_days c on {BY_SERVICE} group by 1, 2, 3
    union all
    select t.gtfs_id, 'weekday', c.day, round(sum(d * flag) / 3600, 6) from secs t join {DAY_ROWS} c on {BY_SERVICE} group by 1, 2, 3""")
def _(feed):
    pick = lambda by, col: T.service_hours(feed, by).select(
        "gtfs_id", F.lit(by).alias("kind"), F.col(col).cast("string").alias("what"), "hours"
    )
    every = pick("route", "route_id").unionByName(pick("date", "service_date")).unionByName(pick("weekday", "day"))
    return rounded(every, "hours")


@check("e47_duration_by_start_hour", "E47", f"""
    with daily as (
      select d.gtfs_id, d.service_date, count(*) as n from trips t
      join service_days d on d.gtfs_id = t.gtfs_id and d.service_id = t.service_id group by 1, 2),
    best as (select gtfs_id, service_date from (
      select *, row_number() over (partition by gtfs_id order by n desc, service_date) as k from daily) where k = 1)
    select t.gtfs_id, cast(start_secs // 3600 as bigint) as hour, round(avg(last_arrival - first_arrival), 6) as mean_secs, count(*) as trips
    from trip_spans s join trips t on {BY_TRIP} join service_days c on {BY_SERVICE}
      join best b on b.gtfs_id = c.gtfs_id and b.service_date = c.service_date group by 1, 2""")
def _(feed):
    return rounded(T.duration_by_start_hour(feed), "mean_secs")


@check("e48_trip_rates", "E48", """
    select a.gtfs_id, round(per_day, 6) as per_day, round(per_service, 6) as per_service, round(per_route, 6) as per_route
    from (select gtfs_id, avg(n) as per_service from (select gtfs_id, service_id, count(*) as n from trips group by 1, 2) group by 1) a
      join (select gtfs_id, avg(n) as per_route from (select gtfs_id, route_id, count(*) as n from trips group by 1, 2) group by 1) b on a.gtfs_id = b.gtfs_id
      left join (select gtfs_id, avg(n) as per_day from (select d.gtfs_id, d.service_date, count(*) as n from trips t
        join service_days d on d.gtfs_id = t.gtfs_id and d.service_id = t.service_id group by 1, 2) group by 1) e on a.gtfs_id = e.gtfs_id""")
def _(feed):
    return rounded(T.trip_rates(feed), "per_day", "per_service", "per_route")


@check("e49_trips_per_hour_in_window", "E49", f"""
    select t.gtfs_id, t.route_id, round(count(*) / 3.0::double, 6) as trips_per_hour
    from trip_spans s join trips t on {BY_TRIP} where start_secs >= 21600 and start_secs < 32400 group by 1, 2""")
def _(feed):
    return rounded(S.trips_per_hour_in(feed, C.MORNING_PEAK), "trips_per_hour")


@check("e50_weekday_variation", "E50", f"""
    select gtfs_id, route_id, round(stddev_samp(n), 6) as stddev, min(n) as least, max(n) as most from (
      select t.gtfs_id, t.route_id, c.day, cast(sum(flag) as bigint) as n from trips t join {DAY_ROWS} c on {BY_SERVICE} group by 1, 2, 3)
    group by 1, 2""")
def _(feed):
    return rounded(T.weekday_variation(feed), "stddev")


@check("e51_shape_use", "E51", """
    select coalesce(a.gtfs_id, b.gtfs_id) as gtfs_id, coalesce(a.shape_id, b.shape_id) as shape_id, routes, points
    from (select gtfs_id, shape_id, count(distinct route_id) as routes from trips group by 1, 2) a
      full join (select gtfs_id, shape_id, count(*) as points from shapes group by 1, 2) b
      on a.gtfs_id = b.gtfs_id and a.shape_id = b.shape_id""")
def _(feed):
    return S.shape_use(feed)


@check("e52_agency_transfers", "E52", """
    select s.gtfs_id, s.stop_id, count(distinct r.agency_id) as agencies
    from route_stops s join routes r on r.gtfs_id = s.gtfs_id and r.route_id = s.route_id
    group by 1, 2 having count(distinct r.agency_id) > 1""")
def _(feed):
    return S.agency_transfers(feed)


@check("e53_fewer_stops_than_usual", "E53", f"""
    select gtfs_id, route_id, count(*) filter (where n_stops < usual) as short_trips, count(*) as trips, max(usual) as usual
    from (select t.gtfs_id, t.route_id, n_stops, max(n_stops) over (partition by t.gtfs_id, t.route_id) as usual
      from trip_spans s join trips t on {BY_TRIP}) group by 1, 2""")
def _(feed):
    return T.fewer_stops_than_usual(feed)


@check("e53_routes_below_feed_mean", "E53", f"""
    select * from (
      select gtfs_id, route_id, round(sum(n) * 1.0::double / sum(k), 6) as route_mean,
        round(sum(sum(n)) over (partition by gtfs_id) * 1.0::double / sum(sum(k)) over (partition by gtfs_id), 6) as feed_mean
      from (select t.gtfs_id, t.route_id, n_stops as n, 1 as k from trip_spans s join trips t on {BY_TRIP}) group by 1, 2)
    where route_mean < feed_mean""")
def _(feed):
    return rounded(T.stops_per_trip_vs_feed(feed), "route_mean", "feed_mean")


@check("e54_common_start_times", "E54 G4", """
    select gtfs_id, start_secs, trips from (
      select gtfs_id, start_secs, count(*) as trips, row_number() over (partition by gtfs_id order by count(*) desc, start_secs) as k
      from trip_spans group by 1, 2) where k <= 10""")
def _(feed):
    starts = T.common_span_times(feed, "start_secs", "start_secs")
    return G.top_per(starts, ["gtfs_id"], [F.desc("trips"), "start_secs"], 10)


@check("e54_common_end_times", "E54 G4", """
    select gtfs_id, end_secs, trips from (
      select gtfs_id, end_secs, count(*) as trips, row_number() over (partition by gtfs_id order by count(*) desc, end_secs) as k
      from trip_spans group by 1, 2) where k <= 10""")
def _(feed):
    ends = T.common_span_times(feed, "end_secs", "end_secs")
    return G.top_per(ends, ["gtfs_id"], [F.desc("trips"), "end_secs"], 10)


@check("e56_closure_gaps", "E56 S1", f"""
    with ends as materialized (
      select distinct t.gtfs_id, t.route_id, s.first_stop, s.last_stop from trip_spans s join trips t on {BY_TRIP}),
    places as materialized (
      select e.*, a.stop_lat as y0, a.stop_lon as x0, b.stop_lat as y1, b.stop_lon as x1 from ends e
        join stops a on a.gtfs_id = e.gtfs_id and a.stop_id = e.first_stop
        join stops b on b.gtfs_id = e.gtfs_id and b.stop_id = e.last_stop)
    select gtfs_id, route_id, round(min({geodesic_sql("y0", "x0", "y1", "x1")}), 4) as gap_m from places group by 1, 2""")
def _(feed):
    return rounded(S.closure_gaps(feed), "gap_m", places=4)


@check("viz_spacing_and_length", "E10", f"""
    select t.gtfs_id, t.route_id, round(avg(dist), 6) as mean_length, round(avg(n_stops), 6) as mean_stops,
      round(avg(dist) / nullif(avg(n_stops) - 1, 0), 6) as mean_spacing
    from trip_spans s join trips t on {BY_TRIP} group by 1, 2""")
def _(feed):
    return rounded(T.spacing_and_length(feed), "mean_length", "mean_stops", "mean_spacing")


@check("v8_frequency_departures", "V8", """
    select gtfs_id, count(*) as departures, count(distinct trip_id) as trips, min(secs) as first_secs, max(secs) as last_secs
    from (select gtfs_id, trip_id, unnest(generate_series(start_secs, end_secs - 1, 600)) as secs from frequencies where headway_secs > 0)
    group by 1""")
def _(feed):
    return S.frequency_departures(feed).groupBy("gtfs_id").agg(
        F.count("*").alias("departures"), F.count_distinct("trip_id").alias("trips"),
        F.min("departure_secs").cast("bigint").alias("first_secs"), F.max("departure_secs").cast("bigint").alias("last_secs"),
    )


@check("v9_transfer_use", "V9", """
    with visits as (select gtfs_id, stop_id, count(*) as v from stop_times group by 1, 2),
      reach as (select gtfs_id, stop_id, count(*) as n from route_stops group by 1, 2)
    select x.gtfs_id, from_stop_id, to_stop_id, min_transfer_time, coalesce(a.v, 0) + coalesce(b.v, 0) as visits,
      greatest(coalesce(c.n, 0), coalesce(d.n, 0)) as routes
    from transfers x
      left join visits a on a.gtfs_id = x.gtfs_id and a.stop_id = from_stop_id left join visits b on b.gtfs_id = x.gtfs_id and b.stop_id = to_stop_id
      left join reach c on c.gtfs_id = x.gtfs_id and c.stop_id = from_stop_id left join reach d on d.gtfs_id = x.gtfs_id and d.stop_id = to_stop_id""")
def _(feed):
    return S.transfer_use(feed)


@check("v7_translated_stop_names", "V7", """
    select s.gtfs_id, s.stop_id, coalesce(a.translation, s.stop_name) as stop_name, coalesce(b.translation, s.stop_code) as stop_code
    from stops s
      left join translations a on a.gtfs_id = s.gtfs_id and a.record_id = s.stop_id and a.field_name = 'stop_name' and a.language = 'ja'
      left join translations b on b.gtfs_id = s.gtfs_id and b.field_value = s.stop_code and b.field_name = 'stop_code' and b.language = 'ja'""")
def _(feed):
    names = S.translated(feed, "stops", "stop_id", "stop_name", "ja")
    codes = S.translated(feed, "stops", "stop_id", "stop_code", "ja")
    return names.join(codes, ["gtfs_id", "stop_id"])
