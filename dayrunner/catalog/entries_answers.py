"""Side-by-side queries: worked answers, with SQL written for the question."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayrunner.catalog.entries_text import STREETS_SQL, norm_sql, score_sql
from dayrunner.catalog.registry import check
from dayrunner.catalog.tools import rounded
from dayrunner.plans.answers import ANSWERS

BY_TRIP = "s.gtfs_id = t.gtfs_id and s.trip_id = t.trip_id"
BY_ROUTE = "r.gtfs_id = t.gtfs_id and r.route_id = t.route_id"


@check("answer_7_stops_at_intersection", "N2", f"""
    with {STREETS_SQL}, found as (
      select distinct p.gtfs_id, p.stop_id from streets p join streets q
        on q.gtfs_id = p.gtfs_id and q.stop_id = p.stop_id and q.name <> p.name
      where {score_sql(norm_sql("'Mains'"), 'p.x')} >= 0.7 - 1e-9 and {score_sql(norm_sql("'Green'"), 'q.x')} >= 0.7 - 1e-9)
    select f.gtfs_id, f.stop_id, s.stop_name from found f join stops s on s.gtfs_id = f.gtfs_id and s.stop_id = f.stop_id""")
def _(feed):
    return ANSWERS["7"](feed, "Mains", "Green")


@check("answer_28_routes_at_stop_id", "D7 E18", f"""
    select s.gtfs_id, s.stop_id, count(distinct t.route_id) as routes from stop_times s join trips t on {BY_TRIP}
    where s.stop_id = s.gtfs_id || '1' group by 1, 2""")
def _(feed):
    return ANSWERS["28"](feed, "1")


@check("answer_34_stops_by_name", "N1", f"""
    select distinct gtfs_id, stop_id, stop_name from stops,
      (select unnest([stop_id, substr(stop_id, length(gtfs_id) + 1), stop_name]) as name, gtfs_id as g, stop_id as i from stops)
    where gtfs_id = g and stop_id = i and {score_sql(norm_sql("'Mian & Green'"), norm_sql('name'))} >= 0.8 - 1e-9""")
def _(feed):
    return ANSWERS["34"](feed, "Mian & Green")


@check("answer_54_weekend_distance", "E11", f"""
    with known as (
      select t.gtfs_id, t.route_id, count(*) as trips, sum(s.dist) as total_m from trip_spans s join trips t on {BY_TRIP}
        join calendar c on c.gtfs_id = t.gtfs_id and c.service_id = t.service_id
      where (c.saturday = 1 or c.sunday = 1) and s.dist is not null group by 1, 2)
    select gtfs_id, round(sum(total_m) / 1000, 6) as total_km, count(*) as routes, cast(sum(trips) as bigint) as trips,
      round(avg(total_m) / 1000, 6) as mean_km, first(route_id order by total_m desc, route_id) as longest_route
    from known group by 1""")
def _(feed):
    return rounded(ANSWERS["54"](feed), "total_km", "mean_km")


@check("answer_5_busiest_date", "E2 E41 G2", """
    select gtfs_id, cast(service_date as varchar) as service_date, trips from (
      select *, row_number() over (partition by gtfs_id order by trips desc, service_date) as k from (
        select t.gtfs_id, d.service_date, count(*) as trips from trips t
          join service_days d on t.gtfs_id = d.gtfs_id and t.service_id = d.service_id group by 1, 2)) where k = 1""")
def _(feed):
    return ANSWERS["5"](feed).withColumn("service_date", F.col("service_date").cast("string"))


@check("answer_9_trips_after_midnight", "B13 E1", f"""
    select t.gtfs_id, t.route_id, count(*) as trips from trips t
    where exists (select 1 from stop_times s where {BY_TRIP} and s.departure_secs >= 86400) group by 1, 2""")
def _(feed):
    return ANSWERS["9"](feed)
