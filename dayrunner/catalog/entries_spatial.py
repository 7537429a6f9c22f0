"""Side-by-side queries: nearness, shapes and along-route distance."""

from __future__ import annotations

from pyspark.sql import functions as F

from dayrunner.catalog.registry import check
from dayrunner.catalog.tools import geodesic_sql, rounded, sphere_sql
from dayrunner.operators import joins as J
from dayrunner.operators import sequences as Q
from dayrunner.operators import spatial as P

BY_TRIP = "t.gtfs_id = s.gtfs_id and t.trip_id = s.trip_id"
ENDS = ("a.stop_lat", "a.stop_lon", "b.stop_lat", "b.stop_lon")
METRES, SPHERE = geodesic_sql(*ENDS), sphere_sql(*ENDS)
MODE_STOPS = f"""mode_stops as (
      select distinct p.gtfs_id, p.stop_id, p.stop_lat, p.stop_lon, r.route_type
      from stop_times s join trips t on {BY_TRIP} join routes r on r.gtfs_id = t.gtfs_id and r.route_id = t.route_id
        join stops p on p.gtfs_id = s.gtfs_id and p.stop_id = s.stop_id)"""


@check("s1_pair_distances", "S1", f"""
    select s.gtfs_id, s.stop_id as from_stop, s.next_stop as to_stop, round(max({METRES}), 4) as metres
    from steps s join stops a on a.gtfs_id = s.gtfs_id and a.stop_id = s.stop_id
      join stops b on b.gtfs_id = s.gtfs_id and b.stop_id = s.next_stop group by 1, 2, 3""")
def _(feed):
    pairs = Q.with_pair_metres(Q.pair_coordinates(Q.stop_pairs(feed), feed))
    return rounded(pairs.select("gtfs_id", "from_stop", "to_stop", "metres"), "metres", places=4)


@check("d11_stops_within_radius", "D11", f"""
    select a.gtfs_id, a.stop_id as point_id, b.stop_id, round({METRES}, 4) as metres
    from stops a join stops b on a.gtfs_id = b.gtfs_id
    where a.location_type = 1 and {SPHERE} <= 1006 and {METRES} <= 1000""")
def _(feed):
    stations = P.stop_points(feed.stops.filter("location_type = 1"))
    return rounded(P.stops_near(feed, stations, 1000), "metres", places=4)


@check("s2_nearest_stops", "S2 G4", f"""
    select gtfs_id, point_id, stop_id, round(metres, 4) as metres, place from (
      select a.gtfs_id, a.stop_id as point_id, b.stop_id, {METRES} as metres,
        cast(row_number() over (partition by a.gtfs_id, a.stop_id order by {METRES}, b.stop_id) as integer) as place
      from stops a join stops b on a.gtfs_id = b.gtfs_id where {SPHERE} <= 3018 and {METRES} <= 3000) where place <= 5""")
def _(feed):
    return rounded(P.stops_near(feed, P.stop_points(feed.stops), 3000, k=5), "metres", places=4)


@check("s3_bus_stops_near_light_rail", "S3 D11", f"""
    with {MODE_STOPS}
    select distinct a.gtfs_id, a.stop_id from mode_stops a join mode_stops b on a.gtfs_id = b.gtfs_id
    where a.route_type = 3 and b.route_type = 0 and {SPHERE} <= 202 and {METRES} <= 200""")
def _(feed):
    return P.stops_near_mode(feed)


@check("s3_other_places_near_light_rail", "S3 D11", f"""
    with {MODE_STOPS}
    select distinct a.gtfs_id, a.stop_id from mode_stops a join mode_stops b on a.gtfs_id = b.gtfs_id
    where a.route_type = 3 and b.route_type = 0 and {SPHERE} <= 906 and {METRES} <= 900 and {METRES} > 0""")
def _(feed):
    return P.stops_near_mode(feed, radius_m=900, drop_same_place=True)


@check("s4_along_route_distance", "S4 D16", f"""
    with rides as (
      select s.gtfs_id, s.trip_id, min(stop_sequence) filter (where location_type = 1) as from_seq,
        max(stop_sequence) filter (where wheelchair_boarding = 1) as to_seq
      from stop_times s join stops p on s.gtfs_id = p.gtfs_id and s.stop_id = p.stop_id group by 1, 2),
    ok as (select * from rides where from_seq < to_seq),
    legs as (
      select s.gtfs_id, s.trip_id, s.stop_sequence, s.shape_dist_traveled as d, {METRES} as m
      from steps s join stops a on a.gtfs_id = s.gtfs_id and a.stop_id = s.stop_id
        left join stops b on b.gtfs_id = s.gtfs_id and b.stop_id = s.next_stop)
    select ok.gtfs_id, ok.trip_id, from_seq, to_seq, round(coalesce(
        max(d) filter (where stop_sequence = to_seq) - max(d) filter (where stop_sequence = from_seq),
        sum(m) filter (where stop_sequence >= from_seq and stop_sequence < to_seq)), 4) as metres
    from ok join legs l on l.gtfs_id = ok.gtfs_id and l.trip_id = ok.trip_id group by 1, 2, 3, 4""")
def _(feed):
    both = J.trips_serving_both(feed, feed.stops.filter("location_type = 1"), feed.stops.filter("wheelchair_boarding = 1"))
    rides = both.filter("first_a < last_b").selectExpr("gtfs_id", "trip_id", "first_a as from_seq", "last_b as to_seq")
    return rounded(P.along_distance(feed, rides), "metres", places=4)


@check("s5_polylines", "S5", """
    select gtfs_id, shape_id, cast(0 as bigint) as part, cast(count(*) as integer) as n_points,
      '{"type":"LineString","coordinates":[' || string_agg('[' || shape_pt_lon || ',' || shape_pt_lat || ']', ',' order by shape_pt_sequence) || ']}' as geojson
    from shapes group by 1, 2""")
def _(feed):
    return P.geojson(P.shape_parts(feed.shapes))


@check("s5_stop_lines_without_shapes", "S5", """
    with bare as (select * from trips t where not exists (select 1 from shapes h
      where h.gtfs_id = t.gtfs_id and h.shape_id = t.shape_id)),
    sample as (select gtfs_id, route_id, direction_id, min(trip_id) as trip_id from bare group by 1, 2, 3)
    select s.gtfs_id, x.route_id || '-' || x.direction_id as shape_id, stop_sequence as shape_pt_sequence,
      stop_lat as shape_pt_lat, stop_lon as shape_pt_lon
    from stop_times s join sample x on x.gtfs_id = s.gtfs_id and x.trip_id = s.trip_id
      join stops p on p.gtfs_id = s.gtfs_id and p.stop_id = s.stop_id""")
def _(feed):
    return P.stop_lines(feed)


@check("s6_route_shapes", "S6 D3", """
    select gtfs_id, shape_id, arg_min(shape_pt_lat, shape_pt_sequence) as lat, arg_min(shape_pt_lon, shape_pt_sequence) as lon
    from shapes h where exists (select 1 from trips t join routes r on r.gtfs_id = t.gtfs_id and r.route_id = t.route_id
      where t.gtfs_id = h.gtfs_id and t.shape_id = h.shape_id and r.route_type = 1) group by 1, 2""")
def _(feed):
    return P.first_points(P.shapes_of_routes(feed, feed.routes.filter("route_type = 1")))


@check("s8_longest_shapes", "S8 E12", f"""
    with seg as (
      select gtfs_id, shape_id, shape_dist_traveled, shape_pt_lat as y0, shape_pt_lon as x0,
        lead(shape_pt_lat) over w as y1, lead(shape_pt_lon) over w as x1
      from shapes window w as (partition by gtfs_id, shape_id order by shape_pt_sequence)),
    len as (select gtfs_id, shape_id, coalesce(max(shape_dist_traveled), sum({geodesic_sql("y0", "x0", "y1", "x1")})) as length
      from seg group by 1, 2)
    select gtfs_id, route_id, shape_id, round(length, 4) as length from (
      select t.gtfs_id, t.route_id, t.shape_id, length,
        row_number() over (partition by t.gtfs_id, t.route_id order by length desc nulls last, t.shape_id) as k
      from (select distinct gtfs_id, route_id, shape_id from trips) t
        join len on len.gtfs_id = t.gtfs_id and len.shape_id = t.shape_id) where k = 1""")
def _(feed):
    return rounded(P.longest_shapes(feed), "length", places=4)


@check("d12_crossing_routes", "D12", """
    with seg as (
      select t.gtfs_id, t.route_id, x0, y0, x1, y1 from (
        select gtfs_id, shape_id, shape_pt_lat as y0, shape_pt_lon as x0,
          lead(shape_pt_lat) over w as y1, lead(shape_pt_lon) over w as x1
        from shapes window w as (partition by gtfs_id, shape_id order by shape_pt_sequence)) s
      join (select distinct gtfs_id, route_id, shape_id from trips) t on t.gtfs_id = s.gtfs_id and t.shape_id = s.shape_id
      where x1 is not null)
    select distinct a.gtfs_id, a.route_id, b.route_id as crossing_route_id
    from seg a join routes r on r.gtfs_id = a.gtfs_id and r.route_id = a.route_id and r.route_long_name like '%Express'
        and r.route_short_name = 'BUILDING'
      join seg b on a.gtfs_id = b.gtfs_id and a.route_id <> b.route_id
    where ((a.x1 - a.x0) * (b.y0 - a.y0) - (a.y1 - a.y0) * (b.x0 - a.x0)) * ((a.x1 - a.x0) * (b.y1 - a.y0) - (a.y1 - a.y0) * (b.x1 - a.x0)) <= 0
      and ((b.x1 - b.x0) * (a.y0 - b.y0) - (b.y1 - b.y0) * (a.x0 - b.x0)) * ((b.x1 - b.x0) * (a.y1 - b.y0) - (b.y1 - b.y0) * (a.x1 - b.x0)) <= 0
      and least(a.x0, a.x1) <= greatest(b.x0, b.x1) and least(b.x0, b.x1) <= greatest(a.x0, a.x1)
      and least(a.y0, a.y1) <= greatest(b.y0, b.y1) and least(b.y0, b.y1) <= greatest(a.y0, a.y1)""")
def _(feed):
    targets = feed.routes.filter("route_long_name like '%Express' and route_short_name = 'BUILDING'")
    return P.crossing_routes(feed, targets)


SPACING_CLASS = """case when {M} > 2000 then '>2km' when {M} > 1000 then '1-2km' when {M} > 500 then '500-1000m' when {M} > 200 then '200-500m'
        when {M} > 100 then '100-200m' when {M} > 50 then '50-100m' when {M} > 0 then '0-50m' end""".replace("{M}", METRES)
PLACES = """sample as (select gtfs_id, route_id, min(trip_id) as trip_id, arg_min(shape_id, trip_id) as shape_id from trips group by 1, 2),
    seg as (
      select *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) as size from (
        select gtfs_id, shape_id, shape_pt_sequence as n, shape_pt_lat as y0, shape_pt_lon as x0,
          lead(shape_pt_lat) over w as y1, lead(shape_pt_lon) over w as x1
        from shapes window w as (partition by gtfs_id, shape_id order by shape_pt_sequence)) where x1 is not null),
    line as (select *, sum(size) over (partition by gtfs_id, shape_id order by n) - size as done from seg),
    near as (
      select s.gtfs_id, x.route_id, s.trip_id, x.shape_id, s.stop_sequence, s.stop_id, n, done, size, x0, y0, x1, y1,
        p.stop_lon as px, p.stop_lat as py,
        coalesce(greatest(0.0::double, least(1.0::double, ((p.stop_lon - x0) * (x1 - x0) + (p.stop_lat - y0) * (y1 - y0))
          / nullif((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0), 0))), 0.0::double) as u
      from stop_times s join sample x on x.gtfs_id = s.gtfs_id and x.trip_id = s.trip_id
        join stops p on p.gtfs_id = s.gtfs_id and p.stop_id = s.stop_id
        join line l on l.gtfs_id = x.gtfs_id and l.shape_id = x.shape_id),
    cand as (select *, done + u * size as spot,
        sqrt((px - x0 - u * (x1 - x0)) * (px - x0 - u * (x1 - x0)) + (py - y0 - u * (y1 - y0)) * (py - y0 - u * (y1 - y0))) as off
      from near)"""
NEAREST_LEGS = """best as (select * from (select *, row_number() over (
        partition by gtfs_id, trip_id, stop_sequence order by round(off, 12), n) as k from cand) where k = 1),
    legs as (select *, spot as along, lead(stop_id) over w as to_stop, lead(spot) over w as to_along
      from best window w as (partition by gtfs_id, trip_id order by stop_sequence))"""
ORDERED_LEGS = """ranked as (select *, min(off) over (partition by gtfs_id, trip_id, stop_sequence) as low,
        row_number() over (partition by gtfs_id, trip_id, stop_sequence order by round(off, 12), n) as k from cand),
    place as (
      select *, dense_rank() over (partition by gtfs_id, trip_id order by stop_sequence) as i from (
        select distinct gtfs_id, trip_id, route_id, shape_id, stop_sequence, stop_id, round(spot, 9) as along, round(off, 9) as away
        from ranked where off <= 0.01 or (low > 0.01 and k = 1))),
    walked as (
      with recursive dp as (
        select gtfs_id, trip_id, i, along, away * away as cost, [along] as path from place where i = 1
        union all
        select p.gtfs_id, p.trip_id, p.i, p.along, min(d.cost) + p.away * p.away as cost,
          list_append(arg_min(d.path, struct_pack(c := d.cost, a := d.along)), p.along) as path
        from dp d join place p on p.gtfs_id = d.gtfs_id and p.trip_id = d.trip_id and p.i = d.i + 1 and d.along <= p.along
        group by p.gtfs_id, p.trip_id, p.i, p.along, p.away)
      select * from dp),
    kept as (
      select w.gtfs_id, w.trip_id, arg_min(path, struct_pack(c := cost, a := along)) as path
      from walked w join (select gtfs_id, trip_id, max(i) as last from place group by 1, 2) e
        on e.gtfs_id = w.gtfs_id and e.trip_id = w.trip_id and e.last = w.i group by 1, 2),
    best as (
      select p.gtfs_id, p.trip_id, p.route_id, p.shape_id, p.stop_sequence, p.stop_id,
        coalesce(any_value(k.path[p.i]), arg_min(p.along, struct_pack(o := away, a := p.along))) as along
      from place p left join kept k on k.gtfs_id = p.gtfs_id and k.trip_id = p.trip_id group by 1, 2, 3, 4, 5, 6),
    legs as (select *, lead(stop_id) over w as to_stop, lead(along) over w as to_along
      from best window w as (partition by gtfs_id, trip_id order by stop_sequence))"""
SPACING = f"""select l.gtfs_id, l.route_id, l.stop_sequence, l.stop_id as from_stop, to_stop,
      round(along, 6) as from_along, round(to_along, 6) as to_along, {SPACING_CLASS} as class
    from legs l join stops a on a.gtfs_id = l.gtfs_id and a.stop_id = l.stop_id
      join stops b on b.gtfs_id = l.gtfs_id and b.stop_id = l.to_stop"""
PATH = """select l.gtfs_id, l.shape_id, l.route_id, l.stop_sequence, round(l.along, 6) as from_along, round(l.to_along, 6) as to_along,
      round(v.done, 6) as along, v.x0 as lon, v.y0 as lat
    from legs l join line v on v.gtfs_id = l.gtfs_id and v.shape_id = l.shape_id
    where to_stop is not null and round(v.done - l.along, 9) > 0 and round(l.to_along - v.done, 9) > 0"""


def _spacing(feed, *, in_order=False):
    legs = P.spacing_along_shapes(feed, in_order=in_order)
    return rounded(
        legs.select("gtfs_id", "route_id", "stop_sequence", "from_stop", "to_stop", "from_along", "to_along", "class"),
        "from_along", "to_along",
    )


def _path(feed, *, in_order=False):
    legs = P.spacing_along_shapes(feed, in_order=in_order)
    return rounded(P.path_points(feed, legs), "from_along", "to_along", "along")


@check("s7_spacing_along_shapes", "S7 B22", f"with {PLACES}, {NEAREST_LEGS} {SPACING}")
def _(feed):
    return _spacing(feed)


@check("s7_spacing_in_order", "S7 B22", f"with {PLACES}, {ORDERED_LEGS} {SPACING}")
def _(feed):
    return _spacing(feed, in_order=True)


@check("s7_path_points", "S7", f"with {PLACES}, {NEAREST_LEGS} {PATH}")
def _(feed):
    return _path(feed)


@check("s7_path_points_in_order", "S7", f"with {PLACES}, {ORDERED_LEGS} {PATH}")
def _(feed):
    return _path(feed, in_order=True)
