"""Side-by-side queries: order-dependent analyses."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayrunner.catalog.registry import check
from dayrunner.catalog.tools import geodesic_sql, rounded, texts
from dayrunner.functions import columns as C
from dayrunner.operators import sequences as Q
from dayrunner.plans import views as V

BY_TRIP = "t.gtfs_id = s.gtfs_id and t.trip_id = s.trip_id"
BY_SERVICE = "c.gtfs_id = t.gtfs_id and c.service_id = t.service_id"


def gaps_sql(source: str, keys: str, secs: str) -> str:
    n = len(keys.split(","))
    by = ", ".join(str(i) for i in range(1, n + 1))
    return f"""
    select {keys}, count(*) as events, round(avg(gap), 6) as mean_gap, cast(min(gap) as bigint) as least_gap,
      cast(max(gap) as bigint) as most_gap
    from (select {keys}, {secs} - lag({secs}) over (partition by {keys} order by {secs}) as gap from {source})
    group by {by}"""


@check("f1_headways", "F1 C4", f"""
    with lines as (select t.gtfs_id, t.route_id, t.direction_id, t.service_id, start_secs from trip_spans s join trips t on {BY_TRIP})
    {gaps_sql('lines', 'gtfs_id, route_id, direction_id, service_id', 'start_secs')}""")
def _(feed):
    return rounded(Q.headways(feed), "mean_gap")


@check("f1_peak_headways", "F1 B12", f"""
    with lines as (select t.gtfs_id, t.route_id, t.direction_id, start_secs from trip_spans s join trips t on {BY_TRIP}
      join calendar c on {BY_SERVICE}
      where monday = 1 and tuesday = 1 and wednesday = 1 and thursday = 1 and friday = 1
        and (start_secs between 21600 and 32400 or start_secs between 54000 and 68400))
    select gtfs_id, round(avg(mean_gap) / 60, 6) as mean_minutes from (
      {gaps_sql('lines', 'gtfs_id, route_id, direction_id', 'start_secs').replace('round(avg(gap), 6)', 'avg(gap)')}) group by 1""")
def _(feed):
    weekdays = V.typical_feed(feed, C.WEEKDAYS, "all")
    lines = Q.headways(weekdays, ["gtfs_id", "route_id", "direction_id"], [C.MORNING_PEAK, C.EVENING_PEAK])
    return rounded(lines.groupBy("gtfs_id").agg((F.avg("mean_gap") / 60).alias("mean_minutes")), "mean_minutes")


@check("f2_longest_step", "F2 G2", """
    select gtfs_id, trip_id, stop_sequence, stop_id, round(metres, 6) as metres from (
      select *, row_number() over (partition by gtfs_id order by metres desc, trip_id, stop_sequence) as k
      from (select *, abs(shape_dist_traveled - prev_dist) as metres from steps) where metres is not null) where k = 1""")
def _(feed):
    return rounded(Q.longest_step(feed).drop("prev_stop"), "metres")


@check("f2_spacing_histogram", "F2 B22", """
    with d as (select gtfs_id, abs(shape_dist_traveled - prev_dist) as m from steps),
    ok as (select * from d where m > 0 and m <= 3000), b as (select gtfs_id, min(m) as lo, max(m) as hi from ok group by 1)
    select ok.gtfs_id, cast(least(floor((m - lo) * 50.0::double / (hi - lo)), 49) as bigint) as bin, count(*) as n
    from ok join b on ok.gtfs_id = b.gtfs_id group by 1, 2""")
def _(feed):
    return Q.spacing_histogram(feed)


@check("f3_stop_spacing", "F3 S1 B14", f"""
    with made as materialized (
      select t.gtfs_id, t.route_id, s.prev_stop, s.stop_id, s.shape_dist_traveled - s.prev_dist as known
      from (select *, lag(stop_id) over (partition by gtfs_id, trip_id order by stop_sequence) as prev_stop from steps) s
        join trips t on {BY_TRIP} join routes r on r.gtfs_id = t.gtfs_id and r.route_id = t.route_id
      where r.route_type = 3 and prev_stop is not null),
    pairs as materialized (
      select p.*, a.stop_lat as y0, a.stop_lon as x0, b.stop_lat as y1, b.stop_lon as x1
      from (select distinct gtfs_id, prev_stop, stop_id from made) p
        join stops a on a.gtfs_id = p.gtfs_id and a.stop_id = p.prev_stop
        join stops b on b.gtfs_id = p.gtfs_id and b.stop_id = p.stop_id),
    lines as materialized (select gtfs_id, prev_stop, stop_id, {geodesic_sql("y0", "x0", "y1", "x1")} as metres from pairs)
    select gtfs_id, route_id, round(avg(coalesce(known, metres)), 4) as spacing_m, count(*) as steps
    from made join lines using (gtfs_id, prev_stop, stop_id) group by 1, 2""")
def _(feed):
    return rounded(Q.stop_spacing(feed), "spacing_m", places=4)


@check("f4_segment_speeds", "F4 B20 E35", """
    select gtfs_id, case when arrival_secs // 3600 between 6 and 8 then 'Morning Peak' when arrival_secs // 3600 between 9 and 14 then 'Midday'
        when arrival_secs // 3600 between 15 and 18 then 'Evening Peak' else 'Night' end as period,
      round(avg(v), 6) as mean, round(stddev_samp(v), 6) as std, count(*) as n, round(median(v), 6) as median
    from (select *, (shape_dist_traveled - prev_dist) / nullif(arrival_secs - prev_arrival, 0) * 3.6::double as v from steps)
    where v > 0 and v < 150 group by 1, 2""")
def _(feed):
    return rounded(Q.segment_speed_summary(feed), "mean", "std", "median")


@check("f5_stop_pairs", "F5", """
    select gtfs_id, stop_id as from_stop, next_stop as to_stop, count(*) as times, round(avg(next_arrival - departure_secs), 6) as mean_secs
    from steps where next_stop is not null group by 1, 2, 3""")
def _(feed):
    return rounded(Q.stop_pairs(feed), "mean_secs")


@check("f6_trip_ends", "F6 E39", """
    select gtfs_id, first_stop, last_stop, count(*) as trips from trip_spans group by 1, 2, 3""")
def _(feed):
    from dayrunner.operators.trips import trip_ends

    return trip_ends(feed.stop_times).groupBy("gtfs_id", "first_stop", "last_stop").agg(F.count("*").alias("trips"))


@check("f7_bearings", "F7", """
    select s.gtfs_id, cast(round_even(((degrees(atan2(
        sin(radians(b.stop_lon - a.stop_lon)) * cos(radians(b.stop_lat)),
        cos(radians(a.stop_lat)) * sin(radians(b.stop_lat)) - sin(radians(a.stop_lat)) * cos(radians(b.stop_lat)) * cos(radians(b.stop_lon - a.stop_lon))
      )) + 360.0::double) % 360.0::double) / 10, 0) * 10 as bigint) as bearing, count(*) as segments
    from steps s join stops a on a.gtfs_id = s.gtfs_id and a.stop_id = s.stop_id
      join stops b on b.gtfs_id = s.gtfs_id and b.stop_id = s.next_stop
    where a.stop_lat <> b.stop_lat or a.stop_lon <> b.stop_lon group by 1, 2""")
def _(feed):
    return Q.bearings(feed)


@check("f8_service_runs", "F8", """
    select gtfs_id, service_id, cast(a as varchar) as first_date, cast(b as varchar) as last_date, days,
      cast(date_diff('day', lag(b) over (partition by gtfs_id, service_id order by a), a) - 1 as integer) as gap_days
    from (select gtfs_id, service_id, min(service_date) as a, max(service_date) as b, count(*) as days
      from (select *, service_date - cast(row_number() over (partition by gtfs_id, service_id order by service_date) as integer) as island
        from service_days) group by gtfs_id, service_id, island)""")
def _(feed):
    return texts(Q.service_runs(feed), "first_date", "last_date")


@check("f9_trips_at_once", "F9", f"""
    with changes as (
      select gtfs_id, service_date, sec, sum(d) as d from (
        select t.gtfs_id, service_date, first_departure as sec, 1 as d from trip_spans s join trips t on {BY_TRIP} join service_days c on {BY_SERVICE}
        union all
        select t.gtfs_id, service_date, last_arrival, -1 from trip_spans s join trips t on {BY_TRIP} join service_days c on {BY_SERVICE})
      group by 1, 2, 3),
    running as (select *, sum(d) over (partition by gtfs_id, service_date order by sec) as n from changes)
    select gtfs_id, cast(service_date as varchar) as service_date, cast(n as bigint) as most, sec as at_secs from (
      select *, row_number() over (partition by gtfs_id, service_date order by n desc, sec) as k from running) where k = 1""")
def _(feed):
    return texts(Q.concurrency(feed), "service_date")


@check("f10_waiting_times", "F10", f"""
    with events as (
      select s.gtfs_id, s.stop_id, c.service_date, departure_secs
      from stop_times s join trips t on {BY_TRIP} join service_days c on {BY_SERVICE}
      where departure_secs between 21600 and 32400 or departure_secs between 54000 and 68400)
    select gtfs_id, stop_id, cast(max(most_gap) as bigint) as most_gap, round(max(mean_gap), 6) as most_mean,
      cast(max(events) as bigint) as most_events
    from ({gaps_sql('events', 'gtfs_id, stop_id, service_date', 'departure_secs')}) group by 1, 2""")
def _(feed):
    waits = Q.waiting_times(feed, [C.MORNING_PEAK, C.EVENING_PEAK])
    return rounded(
        waits.groupBy("gtfs_id", "stop_id").agg(
            F.max("most_gap").alias("most_gap"), F.max("mean_gap").alias("most_mean"), F.max("events").alias("most_events")
        ),
        "most_mean",
    )


@check("f11_spikes", "F11", """
    with p as (select *, lag(shape_pt_lat) over w as lat0, lag(shape_pt_lon) over w as lon0,
        lead(shape_pt_lat) over w as lat2, lead(shape_pt_lon) over w as lon2
      from shapes window w as (partition by gtfs_id, shape_id order by shape_pt_sequence)),
    v as (select *, lon0 - shape_pt_lon as ux, lat0 - shape_pt_lat as uy, lon2 - shape_pt_lon as vx, lat2 - shape_pt_lat as vy from p)
    select gtfs_id, shape_id, count(*) filter (where degrees(acos(greatest(-1.0::double, least(1.0::double,
        (ux * vx + uy * vy) / nullif(sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy), 0))))) < 75
        and lat0 is not null and lat2 is not null and sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy) > 0) as spikes,
      count(*) as points from v group by 1, 2""")
def _(feed):
    return Q.spike_counts(feed)


@check("f12_time_distance", "F12 B12", """
    select s.gtfs_id, s.trip_id, stop_sequence, departure_secs, round(departure_secs / 3600, 6) as hours, shape_dist_traveled
    from stop_times s join trips t on t.gtfs_id = s.gtfs_id and t.trip_id = s.trip_id
    where direction_id = 0 and departure_secs between 21600 and 32400""")
def _(feed):
    return rounded(Q.time_distance(feed, feed.trips.filter("direction_id = 0"), C.MORNING_PEAK), "hours")


@check("f13_timetable_spans", "F13 B7", f"""
    select s.gtfs_id, s.trip_id, t.route_id, t.direction_id,
      cast(date '1995-02-08' + to_seconds(first_departure) as varchar) as start_ts,
      cast(date '1995-02-08' + to_seconds(last_arrival) as varchar) as finish_ts
    from trip_spans s join trips t on {BY_TRIP} join service_days c on {BY_SERVICE} and c.service_date = date '1995-02-08'
    where first_departure >= 21600 and first_departure < 32400""")
def _(feed):
    return texts(Q.timetable_spans(feed, "1995-02-08", C.MORNING_PEAK), "start_ts", "finish_ts")


@check("f14_first_trips", "F14 G2", f"""
    select gtfs_id, route_id, trip_id, start_stop_id, start_secs from (
      select t.gtfs_id, t.route_id, t.trip_id, first_stop as start_stop_id, start_secs,
        row_number() over (partition by t.gtfs_id, t.route_id order by start_secs, t.trip_id) as k
      from trip_spans s join trips t on {BY_TRIP} join service_days c on {BY_SERVICE} and c.service_date = date '1995-02-08') where k = 1""")
def _(feed):
    return Q.first_trips(feed, "1995-02-08")


@check("f14_longest_trip_stops", "F14", f"""
    with best as (select gtfs_id, trip_id from (
      select t.gtfs_id, t.trip_id, row_number() over (partition by t.gtfs_id order by last_arrival - first_arrival desc, t.trip_id) as k
      from trip_spans s join trips t on {BY_TRIP}) where k = 1)
    select s.gtfs_id, s.trip_id, stop_sequence, stop_id, departure_secs
    from stop_times s join best b on b.gtfs_id = s.gtfs_id and b.trip_id = s.trip_id""")
def _(feed):
    return Q.longest_trip_stops(feed)


def shared_sql(n: int) -> str:
    parts = " || ' > ' || ".join(["stop_id"] + [f"lead(stop_id, {i}) over w" for i in range(1, n)])
    return f"""select gtfs_id, gram, count(distinct route_id) as routes from (
        select t.gtfs_id, t.route_id, {parts} as gram from stop_times s join trips t on {BY_TRIP}
        window w as (partition by s.gtfs_id, s.trip_id order by s.stop_sequence)) where gram is not null
      group by 1, 2 having count(distinct route_id) > 1"""


for _n in (2, 3):
    sql = shared_sql(_n).replace("stop_id", "s.stop_id")

    @check(f"f15_shared_sequences_of_{_n}", "F15", sql)
    def _(feed, n=_n):
        return Q.shared_sequences(feed, n)


@check("f15_longest_shared_sequences", "F15", f"""
    with walks as (
      select t.gtfs_id, t.route_id, s.trip_id, s.stop_id, row_number() over (partition by s.gtfs_id, s.trip_id order by s.stop_sequence) as place
      from stop_times s join trips t on {BY_TRIP}
    ), paths as (
      select gtfs_id, route_id, path, min(trip_id) as trip_id from (
        select gtfs_id, route_id, trip_id, string_agg(stop_id, ' > ' order by place) as path from walks group by all) group by all
    ), w as (select walks.* from walks join paths using (gtfs_id, route_id, trip_id)
    ), runs as (
      select gtfs_id, ta, tb, min(pa) as start, count(*) as n from (
        select a.gtfs_id, a.trip_id as ta, b.trip_id as tb, a.place as pa, a.place - b.place as shift,
          a.place - row_number() over (partition by a.gtfs_id, a.trip_id, b.trip_id, a.place - b.place order by a.place) as island
        from w a join w b on a.gtfs_id = b.gtfs_id and a.stop_id = b.stop_id and a.route_id <> b.route_id)
      group by gtfs_id, ta, tb, shift, island
    ), best as (select * from runs where n = (select max(n) from runs)
    ), grams as (
      select b.gtfs_id, w.route_id, b.ta, b.tb, b.start, b.n, string_agg(w.stop_id, ' > ' order by w.place) as gram
      from best b join w on w.gtfs_id = b.gtfs_id and w.trip_id = b.ta and w.place between b.start and b.start + b.n - 1 group by all)
    select gtfs_id, gram, count(distinct route_id) as routes, max(n) as n from grams group by 1, 2""")
def _(feed):
    return Q.longest_shared_sequences(feed)


@check("e55_long_segments", "E55", f"""
    select t.gtfs_id, t.route_id, count(*) as segments, max(departure_secs - prev_departure) as longest_secs
    from steps s join trips t on {BY_TRIP} where departure_secs - prev_departure > 280 group by 1, 2""")
def _(feed):
    return Q.long_segments(feed, 280)
