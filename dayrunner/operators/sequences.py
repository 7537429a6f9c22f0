"""Analyses that depend on the order of stops, departures or days.

Order within a trip or shape goes through sliced windows. Order by clock time
is taken over distinct seconds, so a window never holds more rows than a
service day has seconds, however busy its stop or route is.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayrunner.feed import Feed
from dayrunner.functions import columns as C
from dayrunner.functions.geometry import angle_at, bearing, geodesic, with_geodesic
from dayrunner.functions.ordered import SLICE, exact_median, neighbours, positions
from dayrunner.operators import choose as G
from dayrunner.operators import service as S
from dayrunner.operators import trips as T
from dayrunner.plans import views as V
from dayrunner.plans.views import FEED, ROUTE, SERVICE, STOP, TRIP
from dayrunner.session import written

LINE = [*ROUTE, "direction_id", "service_id"]


# --- gaps between departures -----------------------------------------------


def gap_stats(events: DataFrame, keys: Sequence[str], secs: str, weight: str | None = None) -> DataFrame:
    """Number, mean, least and greatest gap between successive events per group."""
    amount = F.count("*") if weight is None else F.sum(weight)
    ticks = events.groupBy(*keys, F.col(secs).alias("_sec")).agg(amount.alias("_n"))
    step = F.col("_sec") - F.lag("_sec").over(Window.partitionBy(*keys).orderBy("_sec"))
    return (
        ticks.withColumn("_gap", step)
        .groupBy(*keys)
        .agg(
            F.sum("_n").alias("events"),
            F.try_divide(F.max("_sec") - F.min("_sec"), F.sum("_n") - 1).alias("mean_gap"),
            F.when(F.max("_n") > 1, F.lit(0)).otherwise(F.min("_gap")).cast("bigint").alias("least_gap"),
            F.when(F.sum("_n") > 1, F.coalesce(F.max("_gap"), F.lit(0))).cast("bigint").alias("most_gap"),
        )
    )


def first_departures(feed: Feed) -> DataFrame:
    """Departure at the first stop of each trip, with its line."""
    starts = feed.stop_times.groupBy(*TRIP).agg(F.min_by("departure_secs", "stop_sequence").alias("start_secs"))
    return starts.join(feed.trips.select(*TRIP, "route_id", "direction_id", "service_id"), TRIP)


def headways(feed: Feed, keys: Sequence[str] = tuple(LINE), windows=None, closed: str = "both") -> DataFrame:
    """Gaps between successive first departures of a line, optionally in windows."""
    starts = first_departures(feed)
    if windows:
        starts = starts.filter(C.in_windows("start_secs", windows, closed))
    return gap_stats(starts, keys, "start_secs")


# --- day classes -----------------------------------------------------------


def day_classes(feed: Feed) -> tuple[DataFrame, DataFrame]:
    """Dates grouped by the set of services that run.

    Returns (services of each class, dates of each class). A class is named by
    its first date; work per date is done once per class. Two 64-bit sums and
    a count identify the set, so no set is gathered.
    """
    days = V.service_days(feed)
    h = F.xxhash64("service_id")
    sets = days.groupBy(FEED, "service_date").agg(
        F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias("s1"), F.sum(F.shiftrightunsigned(h, 32)).alias("s2"),
        F.count("*").alias("n"),
    )
    classes = sets.groupBy(FEED, "s1", "s2", "n").agg(F.min("service_date").alias("class_date"))
    dates = sets.join(classes, [FEED, "s1", "s2", "n"]).select(FEED, "service_date", "class_date")
    services = days.join(
        classes.select(FEED, F.col("class_date").alias("service_date")), [FEED, "service_date"], "left_semi"
    ).withColumnRenamed("service_date", "class_date")
    return services, dates


def waiting_times(feed: Feed, windows=None) -> DataFrame:
    """Gaps between departures at a stop on each class of day."""
    services, _ = day_classes(feed)
    events = feed.stop_times.select(*TRIP, "stop_id", "departure_secs")
    if windows:
        events = events.filter(C.in_windows("departure_secs", windows))
    ticks = (
        events.join(feed.trips.select(*TRIP, "service_id"), TRIP)
        .groupBy(*STOP, "service_id", "departure_secs").agg(F.count("*").alias("n"))
        .join(services, SERVICE)
    )
    return gap_stats(ticks, [*STOP, "class_date"], "departure_secs", weight="n")


def concurrency(feed: Feed) -> DataFrame:
    """Most trips under way at once and when, per service date."""
    services, dates = day_classes(feed)
    spans = feed.stop_times.groupBy(*TRIP).agg(
        F.min("departure_secs").alias("a"), F.max("arrival_secs").alias("b")
    )
    change = F.explode(F.array(
        F.struct(F.col("a").alias("sec"), F.lit(1).alias("d")), F.struct(F.col("b").alias("sec"), F.lit(-1).alias("d"))
    ))
    changes = (
        spans.join(feed.trips.select(*TRIP, "service_id"), TRIP)
        .select(*SERVICE, change.alias("x"))
        .groupBy(*SERVICE, F.col("x.sec").alias("sec")).agg(F.sum("x.d").alias("d"))
        .join(services, SERVICE)
        .groupBy(FEED, "class_date", "sec").agg(F.sum("d").alias("d"))
    )
    running = Window.partitionBy(FEED, "class_date").orderBy("sec").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    peak = (
        changes.withColumn("under_way", F.sum("d").over(running))
        .groupBy(FEED, "class_date")
        .agg(F.max("under_way").alias("most"), F.max_by("sec", F.struct("under_way", -F.col("sec"))).alias("at_secs"))
    )
    return dates.join(peak, [FEED, "class_date"]).select(FEED, "service_date", "most", "at_secs")


def service_runs(feed: Feed) -> DataFrame:
    """Runs of consecutive service days per service and the gap before each."""
    by_day = Window.partitionBy(*SERVICE).orderBy("service_date")
    runs = (
        V.service_days(feed)
        .withColumn("island", F.date_sub("service_date", F.row_number().over(by_day)))
        .groupBy(*SERVICE, "island")
        .agg(F.min("service_date").alias("first_date"), F.max("service_date").alias("last_date"), F.count("*").alias("days"))
    )
    by_run = Window.partitionBy(*SERVICE).orderBy("first_date")
    gap = F.datediff("first_date", F.lag("last_date").over(by_run)) - 1
    return runs.withColumn("gap_days", gap).drop("island")


# --- steps between consecutive stops ---------------------------------------


def steps(feed: Feed) -> DataFrame:
    """Each stop event with the previous one's times and distance."""
    return neighbours(
        feed.stop_times.select(*TRIP, "stop_id", "stop_sequence", "arrival_secs", "departure_secs", "shape_dist_traveled"),
        TRIP, "stop_sequence",
        prev={
            "prev_stop": "stop_id", "prev_arrival": "arrival_secs",
            "prev_departure": "departure_secs", "prev_dist": "shape_dist_traveled",
        },
    )


def consecutive_distances(feed: Feed) -> DataFrame:
    """Metres between consecutive stops of a trip."""
    metres = F.abs(F.col("shape_dist_traveled") - F.col("prev_dist"))
    return steps(feed).select(*TRIP, "prev_stop", "stop_id", "stop_sequence", metres.alias("metres")).filter("metres is not null")


def longest_step(feed: Feed) -> DataFrame:
    """The longest distance between consecutive stops, per feed."""
    order = [F.desc("metres"), "trip_id", "stop_sequence"]
    return G.top_per(consecutive_distances(feed), [FEED], order)


def spacing_histogram(feed: Feed, limit_m: float = 3000, bins: int = 50) -> DataFrame:
    """Spacings in (0, limit], as an equal-width histogram per feed."""
    return T.histogram(consecutive_distances(feed).filter(F.col("metres").between(0, limit_m) & (F.col("metres") > 0)), [FEED], "metres", bins)


def stop_pairs(feed: Feed, trips: DataFrame | None = None) -> DataFrame:
    """Consecutive stop pairs with how often they occur and their mean gap."""
    return (
        steps(feed).filter("prev_stop is not null")
        .groupBy(FEED, F.col("prev_stop").alias("from_stop"), F.col("stop_id").alias("to_stop"))
        .agg(F.count("*").alias("times"), F.avg(F.col("arrival_secs") - F.col("prev_departure")).alias("mean_secs"))
    )


def pair_coordinates(pairs: DataFrame, feed: Feed, how: str = "inner") -> DataFrame:
    """Coordinates of both stops; joined to distinct pairs, not to stop events."""
    side = lambda n: feed.stops.select(
        FEED, F.col("stop_id").alias(f"{n}_stop"), F.col("stop_lat").alias(f"{n}_lat"), F.col("stop_lon").alias(f"{n}_lon")
    )
    return pairs.join(side("from"), [FEED, "from_stop"], how).join(side("to"), [FEED, "to_stop"], how)


def pair_metres() -> Column:
    return geodesic(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))


def with_pair_metres(pairs: DataFrame) -> DataFrame:
    """Pairs with their coordinates, and ``metres``."""
    return with_geodesic(pairs, "from_lat", "from_lon", "to_lat", "to_lon", "metres")


def stop_spacing(feed: Feed, route_type: int | None = 3) -> DataFrame:
    """Mean spacing per route: travelled distance, else straight line."""
    routes = feed.routes if route_type is None else feed.routes.filter(F.col("route_type") == route_type)
    wanted = feed.trips.select(*TRIP, "route_id").join(routes.select(*ROUTE), ROUTE, "left_semi")
    known = F.col("shape_dist_traveled") - F.col("prev_dist")
    pairs = (
        steps(feed).filter("prev_stop is not null").join(wanted, TRIP)
        .groupBy(*ROUTE, F.col("prev_stop").alias("from_stop"), F.col("stop_id").alias("to_stop"))
        .agg(F.sum(known).alias("known_m"), F.count(known).alias("known"), F.count("*").alias("n"))
    )
    line = (F.col("n") - F.col("known")) * pair_metres()
    return pair_coordinates(pairs, feed).groupBy(*ROUTE).agg(
        (F.sum(F.coalesce("known_m", F.lit(0.0)) + line) / F.sum("n")).alias("spacing_m"), F.sum("n").alias("steps")
    )


def segment_speeds(feed: Feed, limit_kmh: float = 150) -> DataFrame:
    """km/h between consecutive stops, kept within (0, limit)."""
    metres = F.col("shape_dist_traveled") - F.col("prev_dist")
    secs = F.col("arrival_secs") - F.col("prev_arrival")
    kmh = C.speed_kmh(metres, secs)
    return (
        steps(feed).select(*TRIP, "stop_sequence", C.day_period("arrival_secs").alias("period"), kmh.alias("kmh"))
        .filter((F.col("kmh") > 0) & (F.col("kmh") < limit_kmh))
    )


def segment_speed_summary(feed: Feed) -> DataFrame:
    """Mean, exact median and spread of segment speeds by period of the day."""
    speeds = segment_speeds(feed)
    stats = speeds.groupBy(FEED, "period").agg(
        F.avg("kmh").alias("mean"), F.stddev_samp("kmh").alias("std"), F.count("*").alias("n")
    )
    return stats.join(exact_median(speeds, [FEED, "period"], "kmh"), [FEED, "period"])


def bearings(feed: Feed) -> DataFrame:
    """Segments per compass bearing, rounded half-even to 10 degrees."""
    course = bearing(F.col("from_lat"), F.col("from_lon"), F.col("to_lat"), F.col("to_lon"))
    moved = (F.col("from_lat") != F.col("to_lat")) | (F.col("from_lon") != F.col("to_lon"))
    return (
        pair_coordinates(stop_pairs(feed), feed).filter(moved)
        .groupBy(FEED, (F.bround(course / 10) * 10).cast("bigint").alias("bearing"))
        .agg(F.sum("times").alias("segments"))
    )


def long_segments(feed: Feed, limit_secs: int) -> DataFrame:
    """Steps that take longer than a limit, counted per route."""
    secs = F.col("departure_secs") - F.col("prev_departure")
    return (
        steps(feed).select(*TRIP, secs.alias("secs")).filter(F.col("secs") > limit_secs)
        .groupBy(*TRIP).agg(F.count("*").alias("n"), F.max("secs").alias("longest"))
        .join(feed.trips.select(*TRIP, "route_id"), TRIP)
        .groupBy(*ROUTE).agg(F.sum("n").alias("segments"), F.max("longest").alias("longest_secs"))
    )


# --- shapes ----------------------------------------------------------------


def spike_counts(feed: Feed, below_degrees: float = 75) -> DataFrame:
    """Shape points whose angle to both neighbours is sharper than a limit."""
    points = neighbours(
        feed.shapes.select(FEED, "shape_id", "shape_pt_sequence", "shape_pt_lat", "shape_pt_lon"),
        [FEED, "shape_id"], "shape_pt_sequence",
        prev={"lat0": "shape_pt_lat", "lon0": "shape_pt_lon"}, next={"lat2": "shape_pt_lat", "lon2": "shape_pt_lon"},
    )
    angle = angle_at(*[F.col(c) for c in ("lon0", "lat0", "shape_pt_lon", "shape_pt_lat", "lon2", "lat2")])
    return points.groupBy(FEED, "shape_id").agg(
        F.count_if(angle < below_degrees).alias("spikes"), F.count("*").alias("points")
    )


# --- traces and timetables -------------------------------------------------


def time_distance(feed: Feed, trips: DataFrame, window: tuple[int, int]) -> DataFrame:
    """Clock time against distance for some trips within a window, in order."""
    return (
        feed.stop_times.filter(C.in_windows("departure_secs", [window]))
        .join(trips.select(*TRIP), TRIP, "left_semi")
        .select(*TRIP, "stop_sequence", "departure_secs", C.hours("departure_secs").alias("hours"), "shape_dist_traveled")
        .orderBy(*TRIP, "stop_sequence")
    )


def timetable_spans(feed: Feed, date: str, window: tuple[int, int]) -> DataFrame:
    """Start and finish timestamps of the trips that start in a window of a date."""
    running = V.trips_of_services(feed, V.active_services(feed, date)).select(*TRIP, "route_id", "direction_id")
    spans = feed.stop_times.groupBy(*TRIP).agg(
        F.min("departure_secs").alias("a"), F.max("arrival_secs").alias("b")
    )
    day = F.lit(date).cast("date")
    return (
        spans.filter(C.in_windows("a", [window], "left")).join(running, TRIP)
        .select(
            *TRIP, "route_id", "direction_id",
            C.service_timestamp(day, "a").alias("start_ts"), C.service_timestamp(day, "b").alias("finish_ts"),
        )
    )


def first_trips(feed: Feed, date: str) -> DataFrame:
    """First trip of the day per route on a date."""
    running = V.trips_of_services(feed, V.active_services(feed, date)).select(*TRIP, "route_id")
    starts = V.trip_starts(feed.stop_times).join(running, TRIP)
    return G.top_per(starts, ROUTE, ["start_secs", "trip_id"])


def longest_trip_stops(feed: Feed) -> DataFrame:
    """Stops, in order, of each feed's trip with the longest duration."""
    durations = T.trip_durations(feed).select(*TRIP, "duration_secs")
    longest = G.top_per(durations, [FEED], [F.desc("duration_secs"), "trip_id"])
    return feed.stop_times.select(*TRIP, "stop_sequence", "stop_id", "departure_secs").join(
        longest.select(*TRIP), TRIP, "left_semi"
    )


# --- shared stop sequences -------------------------------------------------

# Stop events that one task puts in order.
TASK_STOPS = 250_000


# The key of a trip behind its hash, which spares sorts the comparing of texts.
HASHED = ["trip", *TRIP]


def _hashed(df: DataFrame) -> DataFrame:
    return df.withColumn("trip", F.xxhash64(*TRIP))


def _walks(feed: Feed) -> DataFrame:
    """Stop events with their ``position`` in the trip and the ``next_stop``, put in order and written once.

    Slices are ordered on their own. Their ends meet in further steps, and only
    where a trip has numbers beyond the first slice, which few feeds have.
    """
    stops = feed.stop_times.select(*TRIP, "stop_sequence", "stop_id")
    within = Window.partitionBy(F.xxhash64(*TRIP), *TRIP, "_slice").orderBy("stop_sequence")
    sliced = written(stops.withColumn("_slice", F.floor(F.col("stop_sequence") / SLICE)).select(
        "*", F.row_number().over(within).cast("bigint").alias("position"), F.lead("stop_id").over(within).alias("next_stop")))
    if sliced.filter("_slice <> 0 or _slice is null").isEmpty():
        return sliced.drop("_slice")
    ranked = written(positions(sliced.drop("_slice", "position", "next_stop"), TRIP, "stop_sequence"))
    return written(neighbours(ranked, TRIP, "position", next={"next_stop": "stop_id"}))


def _samples(feed: Feed, walks: DataFrame) -> DataFrame:
    """One sample trip per route and stop pattern."""
    return (
        S.pattern_signatures(feed, walks).join(feed.trips.select(*TRIP, "route_id"), TRIP)
        .groupBy("s1", "s2", "s3", "s4", "length", *ROUTE).agg(F.min("trip_id").alias("trip_id"))
        .select(*TRIP, "route_id")
    )


def _pattern_stops(feed: Feed) -> DataFrame:
    """Stop events of one sample trip per route and stop pattern."""
    walks = _walks(feed)
    return _hashed(walks.drop("position", "next_stop")).join(_hashed(_samples(feed, walks)), HASHED).drop("trip")


def _extend(grams: DataFrame, parts: int) -> DataFrame:
    """Sequences of n+1 stops out of those of n: a stop and the next row's sequence."""
    longer = neighbours(grams, TRIP, "stop_sequence", next={"_next": "gram"}, parts=parts)
    return longer.filter("_next is not null").withColumn(
        "gram", F.concat_ws(" > ", "stop_id", "_next")
    ).drop("_next")


def _shared(grams: DataFrame, parts: int) -> DataFrame:
    """Routes are made distinct first, so that the rows of a common sequence are at most its routes."""
    once = grams.select(FEED, "gram", "route_id").repartition(parts, FEED, "gram", "route_id").distinct()
    return once.repartition(parts, FEED, "gram").groupBy(FEED, "gram").agg(F.count("route_id").alias("routes")).filter("routes > 1")


def shared_sequences(feed: Feed, n: int) -> DataFrame:
    """Sequences of ``n`` consecutive stops that several routes share.

    Each length is written before the next, in tasks of bounded size.
    """
    grams = written(_pattern_stops(feed).withColumn("gram", F.col("stop_id")))
    parts = max(grams.sparkSession.sparkContext.defaultParallelism, ceil(grams.count() / TASK_STOPS))
    for _ in range(n - 1):
        grams = written(_extend(grams, parts))
    return _shared(grams, parts)


# A sequence of stops by two 64-bit hashes.
GRAM = ["h1", "h2", FEED]


def _gram(left: str, right: str) -> list[Column]:
    return [F.xxhash64(left, right).alias("h1"), F.xxhash64(right, F.lit(1), left).alias("h2")]


def _within(grams: DataFrame) -> DataFrame:
    """Only sequences that several routes share; longer ones start with one of them."""
    route = F.when(F.col("route_id").isNotNull(), F.xxhash64("route_id"))
    shared = grams.groupBy(*GRAM).agg(F.min(route).alias("least"), F.max(route).alias("most")).filter("least <> most")
    return written(grams.join(shared.select(*GRAM), GRAM, "left_semi"))


def _joined(left: DataFrame, right: DataFrame, shift: int) -> DataFrame:
    """Sequences of a left one and the right one that starts ``shift`` stops later."""
    after = right.select(*TRIP, (F.col("place") - shift).alias("place"), F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    return written(_hashed(left).join(_hashed(after), [*HASHED, "place"]).select(
        *TRIP, "place", "route_id", F.xxhash64("h1", "n1").alias("h1"), F.xxhash64("n2", F.lit(1), "h2").alias("h2")))


def longest_shared_sequences(feed: Feed) -> DataFrame:
    """Shared sequences of the greatest length there is, and that length.

    Sequences are hashes of steps from a stop to the next; the number of steps is doubled
    while any is shared, then extended by falling powers of two. So the number of jobs
    is logarithmic, and stops are spelled out at the end, for the longest sequences
    alone. Single stops are looked at only where no step is shared.
    """
    walks = _walks(feed)
    # A trip of several routes has its events once for each, one after the other.
    routes = Window.partitionBy(*HASHED)
    samples = _hashed(_samples(feed, walks)).select(
        "*", F.count("*").over(routes).alias("_of"), F.row_number().over(routes.orderBy("route_id")).alias("_nth"))
    last = F.col("_nth") == F.col("_of")
    events = written(_hashed(walks.drop("stop_sequence")).join(samples, HASHED).select(
        *TRIP, ((F.col("position") - 1) * F.col("_of") + F.col("_nth")).alias("place"), "stop_id",
        F.when(last, F.col("next_stop")).otherwise(F.col("stop_id")).alias("next_stop"), "route_id"))
    keys = [*TRIP, "place", "route_id"]
    powers = [_within(events.filter("stop_id is not null and next_stop is not null").select(*keys, *_gram("stop_id", "next_stop")))]
    if powers[0].isEmpty():
        steps, best = 0, _within(events.filter("stop_id is not null").select(*keys, *_gram("stop_id", "stop_id")))
    else:
        while True:
            longer = _within(_joined(powers[-1], powers[-1], 1 << (len(powers) - 1)))
            if longer.isEmpty():
                break
            powers.append(longer)
        steps, best = 1 << (len(powers) - 1), powers[-1]
        for k in range(len(powers) - 2, -1, -1):
            longer = _within(_joined(best, powers[k], steps))
            if not longer.isEmpty():
                steps, best = steps + (1 << k), longer
    one = best.groupBy(*GRAM).agg(F.min(F.struct("trip_id", "place")).alias("at"), F.count_distinct("route_id").alias("routes"))
    span = one.select(*GRAM, "routes", F.col("at.trip_id").alias("trip_id"), F.explode(
        F.sequence(F.col("at.place"), F.col("at.place") + steps)).alias("place"))
    stops = F.transform(F.array_sort(F.collect_list(F.struct("place", "stop_id"))), lambda s: s["stop_id"])
    return span.join(events.select(*TRIP, "place", "stop_id"), [*TRIP, "place"]).groupBy(*GRAM, "routes").agg(
        F.concat_ws(" > ", stops).alias("gram")).select(FEED, "gram", "routes", F.lit(steps + 1).alias("n"))
