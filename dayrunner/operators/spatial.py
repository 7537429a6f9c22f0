"""Nearness, route geometry and linear referencing.

Searches go through an equi-join on grid cells no smaller than the radius, so
nothing is compared with everything. A cell with many points is split into a tree
of smaller ones until each holds few. Points at equal coordinates are searched
once. Longitudes are not wrapped at the antimeridian.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayrunner.feed import Feed
from dayrunner.functions import columns as C
from dayrunner.functions import geometry as M
from dayrunner.functions.ordered import neighbours, running_total
from dayrunner.operators import choose as G
from dayrunner.operators import joins as J
from dayrunner.operators import sequences as Q
from dayrunner.operators import trips as T
from dayrunner.plans.views import FEED, ROUTE, STOP, TRIP
from dayrunner.session import written

SHAPE = [FEED, "shape_id"]
CELL = [FEED, "_band", "_cell"]
NODE = [*CELL, "_level", "_row", "_col"]
# A cell or node with more points is split; each level halves both sides twice.
LEAF_POINTS = 512
LEVELS = 5
# Lots that the points of a split cell are dealt to, so that no key holds them all.
LOTS = 32
# Pairs of a point and a stop that one task puts out.
TASK_HITS = 1_000_000


def _cosine(lat: Column) -> Column:
    return F.greatest(F.cos(F.radians(F.least(F.abs(lat), F.lit(89.9)))), F.lit(0.001))


def _cells(df: DataFrame, lat: str, lon: str, radius_m: float, *, spread: bool) -> DataFrame:
    """Latitude band and longitude cell of each point.

    Bands are one radius high; cells of a band are at least one radius wide at
    its latitude. With ``spread`` a point is put in every cell its circle may
    reach, otherwise in its own.
    """
    high = radius_m / M.METRES_PER_DEGREE * 1.0001
    band = F.floor(F.col(lat) / high)
    out = df.withColumn(
        "_band", F.explode(F.array(band - 1, band, band + 1)) if spread else band
    )
    wide = high / _cosine((F.col("_band") + 0.5) * high)
    if not spread:
        return out.withColumn("_cell", F.floor(F.col(lon) / wide))
    reach = F.lit(1.01 * high) / _cosine(F.abs(F.col(lat)) + 2 * high)
    return out.withColumn(
        "_cell", F.explode(F.sequence(F.floor((F.col(lon) - reach) / wide), F.floor((F.col(lon) + reach) / wide)))
    )


def _node_of(level: Column) -> tuple[Column, Column]:
    """Row and column of a point's node at a level, from those at the last level."""
    down = (2 * (LEVELS - level)).cast("int")
    return (F.call_function("shiftright", F.col("_y"), down).alias("_row"),
            F.call_function("shiftright", F.col("_x"), down).alias("_col"))


def _lot(lat: str, lon: str) -> Column:
    return F.pmod(F.xxhash64(lat, lon), F.lit(LOTS)).cast("int")


def _all_lots(df: DataFrame) -> DataFrame:
    return df.withColumn("_lot", F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1))))


def _leaves(points: DataFrame, crowded: DataFrame) -> DataFrame:
    """The leaves of crowded cells: cells of few points, and nodes of few points, or of the
    last level, whose parent has many.

    ``points`` has the cells and the place ``_y``, ``_x`` inside them. ``_salts`` parts a
    leaf of the last level that still has many points.
    """
    row, col = _node_of(F.col("_level"))
    nodes = written(
        points.join(crowded, CELL, "left_semi").groupBy(*CELL, "_y", "_x").agg(F.count("*").alias("n"))
        .withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
        .select(*CELL, "_level", row, col, "n").groupBy(*NODE).agg(F.sum("n").alias("n"))
    )
    many = F.col("n") > LEAF_POINTS
    up = [(F.col("_level") + 1).alias("_level"), F.col("_row").alias("_up_row"), F.col("_col").alias("_up_col")]
    parents = nodes.filter(many).select(*CELL, *up)
    below = nodes.withColumns({"_up_row": F.shiftright("_row", 2), "_up_col": F.shiftright("_col", 2)})
    ends = below.filter(~many | (F.col("_level") == LEVELS)).join(parents, [*CELL, "_level", "_up_row", "_up_col"], "left_semi")
    whole = nodes.filter((F.col("_level") == 0) & ~many)
    return ends.select(*NODE, "n").unionByName(whole.select(*NODE, "n")).select(
        *NODE, F.ceil(F.col("n") / LEAF_POINTS).cast("int").alias("_salts"))


def _meeting(left: DataFrame, right: DataFrame, radius_m: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the columns on which points within a radius meet, and those columns.

    ``left`` is (gtfs_id, lat, lon), ``right`` (gtfs_id, other_lat, other_lon), both distinct.
    Where no cell is crowded with points of either side, points meet on cells. In a
    crowded one a left point goes to every leaf its circle may reach, a right point to its
    own leaf; the left points of a leaf are dealt in lots, which its right points are copied to.
    """
    left = _cells(left, "lat", "lon", radius_m, spread=True)
    right = _cells(right, "other_lat", "other_lon", radius_m, spread=False)
    crowded = written(
        left.groupBy(*CELL).agg(F.count("*").alias("n")).unionByName(right.groupBy(*CELL).agg(F.count("*").alias("n")))
        .filter(F.col("n") > LEAF_POINTS).select(*CELL).distinct()
    )
    if crowded.isEmpty():
        return left, right, CELL
    high = radius_m / M.METRES_PER_DEGREE * 1.0001
    wide = high / _cosine((F.col("_band") + 0.5) * high)
    side = 4 ** LEVELS

    def place(share: Column) -> Column:
        return F.least(F.greatest(F.floor(share * side), F.lit(0)), F.lit(side - 1)).cast("int")

    right = right.withColumns({
        "_y": place(F.col("other_lat") / high - F.col("_band")), "_x": place(F.col("other_lon") / wide - F.col("_cell")),
        "_lot": _lot("other_lat", "other_lon")})
    leaves = written(_leaves(right, crowded))
    dealt = _all_lots(leaves)
    none = {"_level": F.lit(0), "_row": F.lit(0), "_col": F.lit(0), "_salt": F.lit(0), "_lot": F.lit(0)}
    keys = [*NODE, "_salt", "_lot"]
    ends = ["other_lat", "other_lon"]

    split_cells = _all_lots(crowded.withColumn("_split", F.lit(True)))
    flagged = right.join(split_cells, [*CELL, "_lot"], "left")
    row, col = _node_of(F.col("_level"))
    split = (
        flagged.filter("_split").withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
        .select(*CELL, "_level", row, col, "_lot", *ends).join(dealt, [*NODE, "_lot"])
        .withColumn("_salt", F.pmod(F.xxhash64(*ends), F.col("_salts")).cast("int")).drop("_lot")
    )
    here = flagged.filter("_split is null").select(*CELL, *ends).withColumns(none)
    right = here.select(*keys, *ends).unionByName(_all_lots(split).select(*keys, *ends))

    part = F.lit(1.0) / F.pow(F.lit(4.0), F.col("_level"))
    reach = F.lit(1.01 * high) / _cosine(F.abs(F.col("lat")) + 2 * high)
    # A node's box, a little wider than it is, as places are rounded.
    low_lat, low_lon = (F.col("_band") + F.col("_row") * part) * high, (F.col("_cell") + F.col("_col") * part) * wide
    may_reach = (
        F.col("lat").between(low_lat - 1.01 * high, low_lat + (part + 1.01) * high)
        & F.col("lon").between(low_lon - reach, low_lon + part * wide + reach)
    )
    copies = left.withColumn("_lot", _lot("lat", "lon")).join(split_cells, [*CELL, "_lot"], "left")
    spread = (
        copies.filter("_split").join(dealt, [*CELL, "_lot"]).filter(may_reach)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    )
    alone = copies.filter("_split is null").select(*CELL, "lat", "lon").withColumns(none)
    left = alone.select(*keys, "lat", "lon").unionByName(spread.select(*keys, "lat", "lon"))
    return left, right, keys


def near_places(places: DataFrame, others: DataFrame, radius_m: float) -> DataFrame:
    """Pairs of distinct coordinates within a radius.

    Both sides are (gtfs_id, lat, lon); the result adds ``other_lat``,
    ``other_lon`` and ``metres``.
    """
    wide = radius_m * M.SPHERE_EXCESS
    left, right, keys = _meeting(
        places.select(FEED, "lat", "lon").distinct(),
        others.select(FEED, F.col("lat").alias("other_lat"), F.col("lon").alias("other_lon")).distinct(), wide)
    ends = [F.col(c) for c in ("lat", "lon", "other_lat", "other_lon")]
    near = left.join(right, keys).filter(M.haversine(*ends) <= wide)
    return (
        # Exploded, so that the distance is worked out once and not again by a pushed filter.
        M.with_geodesic(near, "lat", "lon", "other_lat", "other_lon", "metres")
        .withColumn("metres", F.explode(F.filter(F.array("metres"), lambda m: m <= radius_m)))
        .select(FEED, "lat", "lon", "other_lat", "other_lon", "metres")
    )


def stops_near(feed: Feed, points: DataFrame, radius_m: float = 200, *, k: int | None = None) -> DataFrame:
    """Stops within a radius of each point; with ``k`` the nearest k.

    ``points``: (gtfs_id, point_id, lat, lon). Distances are found between
    distinct coordinates; ids are attached to the hits. With ``k`` a place first
    keeps its own nearest k, as all points at it have the same.
    """
    stops = feed.stops.select(*STOP, F.col("stop_lat").alias("other_lat"), F.col("stop_lon").alias("other_lon"))
    hits = near_places(points, stops.toDF(FEED, "stop_id", "lat", "lon"), radius_m)
    asked = points.select(FEED, "point_id", "lat", "lon")
    if k is None:
        hits = written(hits)
        there = [FEED, "other_lat", "other_lon"]
        ends = (
            hits.join(asked.groupBy(FEED, "lat", "lon").agg(F.count("*").alias("n")), [FEED, "lat", "lon"])
            .join(stops.groupBy(*there).agg(F.count("*").alias("m")), there)
        )
        # Sized by the rows that come out: those that go in are few, and would be put in few tasks.
        found = ends.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
        tasks = max(1, ceil(found / TASK_HITS))
        return (
            asked.join(hits, [FEED, "lat", "lon"]).repartition(tasks, *there).join(stops.repartition(tasks, *there), there)
            .select(FEED, "point_id", "stop_id", "metres")
        )
    # Any k places hold at least k stops; equal distances at the edge are kept until the ids decide.
    edge = Window.partitionBy(FEED, "lat", "lon").orderBy("metres")
    nearest = hits.withColumn("_place", F.rank().over(edge)).filter(F.col("_place") <= k).drop("_place")
    first = G.top_per(stops, [FEED, "other_lat", "other_lon"], ["stop_id"], k)
    offered = G.top_per(nearest.join(first, [FEED, "other_lat", "other_lon"]), [FEED, "lat", "lon"], ["metres", "stop_id"], k)
    found = asked.join(offered, [FEED, "lat", "lon"]).select(FEED, "point_id", "stop_id", "metres")
    return G.top_per(found, [FEED, "point_id"], ["metres", "stop_id"], k, rank="place")


def stop_points(stops: DataFrame) -> DataFrame:
    return stops.select(
        FEED, F.col("stop_id").alias("point_id"), F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon")
    )


def stops_of_mode(feed: Feed, route_type: int) -> DataFrame:
    """Stops served by routes of a type."""
    routes = feed.routes.filter(F.col("route_type") == route_type)
    trips = feed.trips.select(*TRIP, "route_id").join(routes.select(*ROUTE), ROUTE, "left_semi")
    used = feed.stop_times.select(*TRIP, "stop_id").join(trips.select(*TRIP), TRIP, "left_semi").select(*STOP).distinct()
    return feed.stops.join(used, STOP, "left_semi")


def stops_near_mode(
    feed: Feed, route_type: int = 3, near_type: int = 0, radius_m: float = 200, *, drop_same_place: bool = False
) -> DataFrame:
    """Stops of one mode with a stop of another within a radius.

    A semi-join on grid cells: no pair of stops is ever produced.
    """
    mine = stops_of_mode(feed, route_type).select(*STOP, F.col("stop_lat").alias("lat"), F.col("stop_lon").alias("lon"))
    theirs = stops_of_mode(feed, near_type).select(
        FEED, F.col("stop_lat").alias("other_lat"), F.col("stop_lon").alias("other_lon")
    ).distinct()
    wide = radius_m * M.SPHERE_EXCESS
    left, right, keys = _meeting(mine.select(FEED, "lat", "lon").distinct(), theirs, wide)
    left, right = left.alias("l"), right.alias("r")
    ends = [F.col(c) for c in ("l.lat", "l.lon", "r.other_lat", "r.other_lon")]
    # Most pairs are decided on the sphere; the ellipsoid is asked about the rest.
    sphere = M.haversine(*ends)
    near = (sphere <= wide) & ((sphere <= radius_m / M.SPHERE_EXCESS) | (M.geodesic(*ends) <= radius_m))
    if drop_same_place:
        near = near & (sphere > 0)
    same_cell = reduce(Column.__and__, [F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys])
    places = left.join(right, same_cell & near, "left_semi").select(FEED, "lat", "lon")
    return mine.join(places, [FEED, "lat", "lon"], "left_semi").select(*STOP)


# --- shapes ----------------------------------------------------------------


def shape_parts(shapes: DataFrame, part_points: int = 10_000) -> DataFrame:
    """Polylines as ordered point lists, in parts of bounded sequence range.

    A usual shape is one part; a huge one becomes several rows, so no row
    outgrows a task. Adding the next part's first point joins them up.
    """
    return (
        shapes.withColumn("part", F.floor(F.col("shape_pt_sequence") / part_points))
        .groupBy(*SHAPE, "part")
        .agg(F.array_sort(F.collect_list(F.struct(
            F.col("shape_pt_sequence").alias("seq"), F.col("shape_pt_lat").alias("lat"), F.col("shape_pt_lon").alias("lon")
        ))).alias("points"))
    )


def geojson(parts: DataFrame) -> DataFrame:
    """GeoJSON LineString text of each shape part."""
    coordinates = F.transform("points", lambda p: F.array(p["lon"], p["lat"]))
    return parts.select(
        *SHAPE, "part", F.size("points").alias("n_points"),
        F.to_json(F.struct(F.lit("LineString").alias("type"), coordinates.alias("coordinates"))).alias("geojson"),
    )


def stop_lines(feed: Feed) -> DataFrame:
    """Shape points out of stop coordinates for trips without a shape: the stops
    of the smallest trip id of each route and direction."""
    bare = feed.trips.join(feed.shapes.select(*SHAPE).distinct(), SHAPE, "left_anti")
    samples = bare.groupBy(*ROUTE, "direction_id").agg(F.min("trip_id").alias("trip_id"))
    return (
        feed.stop_times.select(*TRIP, "stop_id", "stop_sequence")
        .join(samples, TRIP)
        .join(feed.stops.select(*STOP, "stop_lat", "stop_lon"), STOP)
        .select(
            FEED, F.concat_ws("-", "route_id", "direction_id").alias("shape_id"),
            F.col("stop_lat").alias("shape_pt_lat"), F.col("stop_lon").alias("shape_pt_lon"),
            F.col("stop_sequence").alias("shape_pt_sequence"),
        )
    )


def shapes_of_routes(feed: Feed, routes: DataFrame) -> DataFrame:
    """Shape points used by some routes."""
    used = feed.trips.select(*ROUTE, "shape_id").join(routes.select(*ROUTE), ROUTE, "left_semi")
    return feed.shapes.join(used.select(*SHAPE).distinct(), SHAPE, "left_semi")


def first_points(shapes: DataFrame) -> DataFrame:
    """One representative point per shape."""
    return shapes.groupBy(*SHAPE).agg(
        F.min_by("shape_pt_lat", "shape_pt_sequence").alias("lat"), F.min_by("shape_pt_lon", "shape_pt_sequence").alias("lon")
    )


def shape_segments(shapes: DataFrame) -> DataFrame:
    """Segments between successive points: x0, y0 (lon, lat) to x1, y1."""
    points = shapes.select(
        *SHAPE, "shape_pt_sequence", F.col("shape_pt_lon").alias("x0"), F.col("shape_pt_lat").alias("y0")
    )
    return neighbours(points, SHAPE, "shape_pt_sequence", next={"x1": "x0", "y1": "y0"}).filter("x1 is not null")


def shape_lengths(feed: Feed) -> DataFrame:
    """Metres per shape: travelled distance, else the sum over its segments."""
    metres = M.geodesic(F.col("y0"), F.col("x0"), F.col("y1"), F.col("x1"))
    drawn = shape_segments(feed.shapes).groupBy(*SHAPE).agg(F.sum(metres).alias("drawn"))
    return T.shape_lengths(feed).join(drawn, SHAPE, "left").select(
        *SHAPE, F.coalesce("length", "drawn").alias("length")
    )


def longest_shapes(feed: Feed) -> DataFrame:
    """Longest shape of every route, with its length."""
    used = feed.trips.select(*ROUTE, "shape_id").distinct()
    return G.top_per(
        used.join(shape_lengths(feed), SHAPE), ROUTE, [F.desc_nulls_last("length"), "shape_id"]
    )


# The finest grid of segments, in degrees; every further level doubles it.
FINEST_CELL = 2.0**-13


def _levelled(lines: DataFrame) -> DataFrame:
    """Segments with the first grid level whose cells are no smaller than their box."""
    extent = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    level = F.when(extent > FINEST_CELL, F.ceil(F.log2(extent / FINEST_CELL)).cast("int")).otherwise(0)
    return lines.withColumn("level", level)


def _segment_cells(lines: DataFrame, others: DataFrame | None = None, *, own: bool = True) -> DataFrame:
    """Segments in the cells of their own level, or of those levels from it upwards
    (without ``own`` above it) that segments of ``others`` have.

    On each level a segment is in four cells at most.
    """
    if others is None:
        gridded = lines.withColumn("grid", F.col("level"))
    else:
        # A feed has no more levels than doublings from the finest cell to the globe.
        present = others.groupBy(FEED).agg(F.collect_set("level").alias("_levels"))
        upwards = F.filter("_levels", lambda v: (v >= F.col("level")) if own else (v > F.col("level")))
        gridded = lines.join(present, FEED).withColumn("grid", F.explode(upwards)).drop("_levels")
    wide = F.lit(FINEST_CELL) * F.pow(F.lit(2.0), F.col("grid"))
    return (
        gridded.withColumn("cx", F.explode(M.cell_range(F.col("x0"), F.col("x1"), wide)))
        .withColumn("cy", F.explode(M.cell_range(F.col("y0"), F.col("y1"), wide)))
    )


def crossing_routes(feed: Feed, targets: DataFrame) -> DataFrame:
    """Other routes whose line touches or crosses a target route's line.

    Equal segments of a route are taken once. Each lies on the grid level of its
    own length, so long segments don't fill many cells and short ones, as in dense
    centres, meet in small cells. Of a candidate pair the shorter segment climbs to
    the level of the longer one, where both share a cell.
    """
    # Read by both directions, so computed once.
    lines = written(_levelled(
        shape_segments(feed.shapes).join(feed.trips.select(*ROUTE, "shape_id").distinct(), SHAPE)
        .select(*ROUTE, "x0", "y0", "x1", "y1").distinct()
    ))
    chosen = lines.join(targets.select(*ROUTE), ROUTE, "left_semi")
    side = lambda df, p: df.select(FEED, "grid", "cx", "cy", *[F.col(c).alias(p + c) for c in ("route_id", "x0", "y0", "x1", "y1")])
    cell = [FEED, "grid", "cx", "cy"]
    others_climb = side(_segment_cells(chosen), "a_").join(side(_segment_cells(lines, chosen), "b_"), cell)
    chosen_climb = side(_segment_cells(chosen, lines, own=False), "a_").join(side(_segment_cells(lines), "b_"), cell)
    return (
        others_climb.unionByName(chosen_climb)
        .filter((F.col("a_route_id") != F.col("b_route_id")) & M.segments_touch("a_", "b_"))
        .select(FEED, F.col("a_route_id").alias("route_id"), F.col("b_route_id").alias("crossing_route_id"))
        .distinct()
    )


# --- along a trip ----------------------------------------------------------


def along_distance(feed: Feed, rides: DataFrame) -> DataFrame:
    """Metres between two stops of a trip: travelled distance, else the sum of
    straight steps. ``rides``: (gtfs_id, trip_id, from_seq, to_seq)."""
    wanted = rides.select(*TRIP, "from_seq", "to_seq")
    events = feed.stop_times.select(*TRIP, "stop_id", "stop_sequence", "shape_dist_traveled").join(
        wanted.select(*TRIP), TRIP, "left_semi"
    )
    legs = neighbours(events, TRIP, "stop_sequence", next={"to_stop": "stop_id"}).withColumnRenamed("stop_id", "from_stop")
    placed = Q.pair_coordinates(legs, feed, "left")
    within = (F.col("stop_sequence") >= F.col("from_seq")) & (F.col("stop_sequence") < F.col("to_seq"))
    at = lambda c: F.max(F.when(F.col("stop_sequence") == F.col(c), F.col("shape_dist_traveled")))
    return (
        placed.join(wanted, TRIP).groupBy(*TRIP, "from_seq", "to_seq")
        .agg(
            (at("to_seq") - at("from_seq")).alias("travelled"),
            F.sum(F.when(within, Q.pair_metres())).alias("straight"),
        )
        .select(*TRIP, "from_seq", "to_seq", F.coalesce("travelled", "straight").alias("metres"))
    )


def sample_trips(feed: Feed) -> DataFrame:
    """One sample trip per route: the smallest trip id that has a shape."""
    return feed.trips.filter("shape_id is not null").groupBy(*ROUTE).agg(
        F.min("trip_id").alias("trip_id"), F.min_by("shape_id", "trip_id").alias("shape_id")
    )


def _measured_segments(shapes: DataFrame) -> DataFrame:
    """Segments with their planar length and the distance up to their start."""
    size = F.sqrt(F.pow(F.col("x1") - F.col("x0"), F.lit(2)) + F.pow(F.col("y1") - F.col("y0"), F.lit(2)))
    sized = shape_segments(shapes).withColumn("size", size)
    return running_total(sized, SHAPE, "shape_pt_sequence", "size", "upto").withColumn(
        "before", F.col("upto") - F.col("size")
    )


def _placements(feed: Feed, samples: DataFrame, reach_degrees: float) -> tuple[DataFrame, DataFrame, list[str]]:
    """Stop events of the sample trips with every segment found near them, the
    lines themselves, and the columns of an event.

    ``off`` is the distance from the segment and ``at`` the place on the line, in
    degrees; an event without a segment in the cells around it has neither.
    """
    events = (
        feed.stop_times.select(*TRIP, "stop_id", "stop_sequence").join(samples, TRIP)
        .join(feed.stops.select(*STOP, F.col("stop_lon").alias("px"), F.col("stop_lat").alias("py")), STOP)
    )
    # Read by both searches, so computed once.
    lines = written(_measured_segments(feed.shapes.join(samples.select(*SHAPE), SHAPE, "left_semi")))
    gridded = (
        lines.withColumn("cx", F.explode(M.cell_range(F.col("x0"), F.col("x1"), reach_degrees)))
        .withColumn("cy", F.explode(M.cell_range(F.col("y0"), F.col("y1"), reach_degrees)))
    )
    around = lambda c: F.explode(F.sequence(M.cell(F.col(c), reach_degrees) - 1, M.cell(F.col(c), reach_degrees) + 1))
    key = [*TRIP, "route_id", "shape_id", "stop_id", "stop_sequence", "px", "py"]
    cells = events.withColumn("cx", around("px")).withColumn("cy", around("py"))
    return _on_segments(cells.join(gridded, [*SHAPE, "cx", "cy"], "left")), lines, key


def _on_segments(pairs: DataFrame) -> DataFrame:
    """Distance ``off`` and place ``at`` of the point of a segment nearest to a stop."""
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    dot = (F.col("px") - F.col("x0")) * dx + (F.col("py") - F.col("y0")) * dy
    share = F.coalesce(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(dot, dx * dx + dy * dy))), F.lit(0.0)
    )
    off = F.sqrt(
        F.pow(F.col("px") - (F.col("x0") + F.col("t") * dx), F.lit(2))
        + F.pow(F.col("py") - (F.col("y0") + F.col("t") * dy), F.lit(2))
    )
    return pairs.withColumn("t", share).withColumns({
        "off": F.when(F.col("x0").isNotNull(), off), "at": F.col("before") + F.col("t") * F.col("size"),
    })


def _nearest(pairs: DataFrame, key: list[str]) -> DataFrame:
    return pairs.groupBy(*key).agg(
        F.min("off").alias("off"),
        # Distances equal to twelve places are ties; the earlier segment wins.
        F.min_by("at", F.when(F.col("off").isNotNull(), F.struct(F.round("off", 12), "shape_pt_sequence"))).alias("along"),
    )


def project_stops(feed: Feed, samples: DataFrame, reach_degrees: float = 0.01) -> DataFrame:
    """Each stop event of the sample trips put on the nearest point of its shape.

    Adds ``along`` (distance along the line) and ``off`` (distance from it), in
    degrees. Segments within reach of a stop are found by grid cells; only
    stops with none in reach are compared with their whole shape.
    """
    pairs, lines, key = _placements(feed, samples, reach_degrees)
    close = _nearest(pairs, key)
    in_reach = F.coalesce(F.col("off") <= reach_degrees, F.lit(False))
    far = _nearest(_on_segments(close.filter(~in_reach).select(*key).join(lines, SHAPE)), key)
    return close.filter(in_reach).unionByName(far).drop("px", "py")


def _kept_order(stops: Column) -> Column:
    """Places along the line for a trip's stops, never going back, with the least
    sum of squared distances; NULL where every choice goes back somewhere.

    ``stops`` is an ordered array of structs whose ``places`` are (along, off).
    A first pass over the stops keeps, for each place, the least cost of reaching
    it in order; a second one goes back from the cheapest end. Of equal costs the
    smaller place wins.
    """
    def reached(fronts: Column, stop: Column) -> Column:
        def cost(place: Column) -> Column:
            upto = F.array_min(F.filter(F.try_element_at(fronts, F.lit(-1)), lambda q: q["along"] <= place["along"]))
            return F.when(F.size(fronts) == 0, F.lit(0.0)).otherwise(upto["cost"]) + place["off"] * place["off"]

        front = F.transform(stop["places"], lambda p: F.struct(cost(p).alias("cost"), p["along"].alias("along")))
        return F.concat(fronts, F.array(F.filter(front, lambda q: q["cost"].isNotNull())))

    def chosen(places: Column, front: Column) -> Column:
        limit = F.coalesce(F.try_element_at(places, F.lit(-1)), F.lit(float("inf")))
        pick = F.array_min(F.filter(front, lambda q: q["along"] <= limit))
        return F.concat(places, F.array(pick["along"]))

    none = F.array().cast("array<array<struct<cost:double,along:double>>>")
    fronts = F.aggregate(stops, none, reached)
    back = F.aggregate(F.reverse(fronts), F.array().cast("array<double>"), chosen)
    return F.when(~F.exists(back, lambda a: a.isNull()), F.reverse(back))


def project_stops_in_order(feed: Feed, samples: DataFrame, reach_degrees: float = 0.01) -> DataFrame:
    """``project_stops`` with places that never go back along a trip.

    On loops and on lines that return the way they came, the nearest point may lie
    on the wrong pass. Here each stop may take the nearest point of any segment
    within reach (beyond reach: of the whole line), and the choice for all stops of
    a trip together keeps their order at the least sum of squared distances.
    ``in_order`` is false for trips for which no choice does; their stops stay at
    the nearest places. Places and distances are rounded to nine decimals (0.1 mm).
    One row holds the places in reach of one trip's stops.
    """
    pairs, lines, key = _placements(feed, samples, reach_degrees)
    trip = [*TRIP, "route_id", "shape_id"]
    place = F.struct(F.round("at", 9).alias("along"), F.round("off", 9).alias("off"))
    close = pairs.groupBy(*key).agg(F.collect_set(F.when(F.col("off") <= reach_degrees, place)).alias("places"))
    far = _nearest(_on_segments(close.filter(F.size("places") == 0).select(*key).join(lines, SHAPE)), key).withColumn(
        "places", F.array(F.struct(F.round("along", 9).alias("along"), F.round("off", 9).alias("off")))
    )
    found = close.filter(F.size("places") > 0).select(*trip, "stop_sequence", "stop_id", "places").unionByName(
        far.select(*trip, "stop_sequence", "stop_id", "places")
    )
    trips = found.groupBy(*trip).agg(
        F.sort_array(F.collect_list(F.struct("stop_sequence", "stop_id", "places"))).alias("stops")
    ).withColumn("kept", _kept_order(F.col("stops")))
    # The nearest place: least distance, then the smaller place.
    nearest = lambda s: F.array_min(F.transform(s["places"], lambda p: F.struct(p["off"], p["along"])))["along"]
    placed = trips.select(
        *trip, F.col("kept").isNotNull().alias("in_order"),
        F.explode(F.arrays_zip("stops", F.coalesce("kept", F.transform("stops", nearest)).alias("along"))).alias("s"),
    )
    taken = F.filter("s.stops.places", lambda p: p["along"] == F.col("s.along"))
    return placed.select(
        *trip, "s.stops.stop_id", "s.stops.stop_sequence", F.array_min(F.transform(taken, lambda p: p["off"])).alias("off"),
        F.col("s.along").alias("along"), "in_order",
    )


def spacing_along_shapes(feed: Feed, samples: DataFrame | None = None, *, in_order: bool = False) -> DataFrame:
    """Consecutive stops of a sample trip per route: where both lie on the shape,
    their straight distance and its class. With ``in_order`` the places on the
    shape keep the order of the stops."""
    samples = sample_trips(feed) if samples is None else samples
    placed = written(project_stops_in_order(feed, samples) if in_order else project_stops(feed, samples))
    legs = neighbours(
        placed, TRIP, "stop_sequence", next={"to_stop": "stop_id", "to_along": "along"}
    ).filter("to_stop is not null").withColumnRenamed("stop_id", "from_stop")
    return Q.pair_coordinates(legs, feed).withColumn("metres", Q.pair_metres()).select(
        *ROUTE, "trip_id", "shape_id", "stop_sequence", "from_stop", "to_stop",
        F.col("along").alias("from_along"), "to_along", "metres",
        C.bin_label("metres", C.SPACING_EDGES, C.SPACING_LABELS).alias("class"),
    )


def path_points(feed: Feed, legs: DataFrame) -> DataFrame:
    """Shape vertices between the two projected stops of each leg, in order. A
    vertex within a billionth of a degree of a stop's place isn't between."""
    vertices = _measured_segments(
        feed.shapes.join(legs.select(*SHAPE), SHAPE, "left_semi")
    ).select(*SHAPE, F.col("before").alias("along"), F.col("x0").alias("lon"), F.col("y0").alias("lat"))
    return legs.select(*SHAPE, *ROUTE[1:], "stop_sequence", "from_along", "to_along").join(vertices, SHAPE).filter(
        (F.round(F.col("along") - F.col("from_along"), 9) > 0) & (F.round(F.col("to_along") - F.col("along"), 9) > 0)
    )


def routes_at_place(feed: Feed, points: DataFrame, radius_m: float = 200) -> DataFrame:
    """Routes with a stop within a radius of each point."""
    near = stops_near(feed, points, radius_m)
    return near.join(J.route_stops(feed), STOP).select(FEED, "point_id", "route_id").distinct()
