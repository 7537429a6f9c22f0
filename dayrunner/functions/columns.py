"""Column expressions: casts, service time, day predicates, labels, buckets.

All of them are built from JVM-side functions, so they stay in code generation.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
WEEKDAYS = DAYS[:5]
WEEKEND = DAYS[5:]

SECONDS_PER_DAY = 86400

# Where a feed's id stands in its file path.
FEED_PATH_PATTERN = r"^(?:s3://[^/]+/)?(?:stable/)?(?:gtfs|sandbox)/([^/]+)/"

# Route type, wheelchair, direction labels.
ROUTE_TYPE_LABELS = {
    0: "Light Rail",
    1: "Subway",
    2: "Rail",
    3: "Bus",
    4: "Ferry",
    5: "Cable Car",
    6: "Gondola",
    7: "Funicular",
    11: "Trolleybus",
    12: "Monorail",
}
WHEELCHAIR_LABELS = {1: "available", 2: "not available"}
DIRECTION_LABELS = {0: "Outbound", 1: "Inbound"}

# Keyword lists of the name filters.
EXPRESS_KEYWORDS = ("express", "limited", "rapid", "fast")
AIRPORT_KEYWORDS = ("airport", "terminal", "airfield", "aviation")

# Hours at which each period of the day begins.
PERIODS = ((6, 9, "Morning Peak"), (9, 15, "Midday"), (15, 19, "Evening Peak"))
PERIOD_ELSE = "Night"
ZONES = (
    (0, 6, "Early Morning"),
    (6, 10, "Morning Peak"),
    (10, 15, "Midday"),
    (15, 19, "Afternoon Peak"),
    (19, 24, "Evening"),
)

# Classes of stop spacing in metres.
SPACING_EDGES = (0, 50, 100, 200, 500, 1000, 2000)
SPACING_LABELS = ("0-50m", "50-100m", "100-200m", "200-500m", "500-1000m", "1-2km", ">2km")

MORNING_PEAK = (6 * 3600, 9 * 3600)
EVENING_PEAK = (15 * 3600, 19 * 3600)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- casts -----------------------------------------------------------------


def try_int(c: Column | str, *, round_fractions: bool = True) -> Column:
    """Tolerant integer; '1.5' becomes 2, halves going away from zero, or NULL without ``round_fractions``."""
    c = _col(c)
    if round_fractions:
        return F.round(c.try_cast("double")).try_cast("int")
    return c.try_cast("int")


def try_double(c: Column | str) -> Column:
    return _col(c).try_cast("double")


def try_yyyymmdd(c: Column | str) -> Column:
    """Tolerant ``yyyyMMdd`` date."""
    return F.try_to_date(F.trim(_col(c)), "yyyyMMdd")


def feed_id_from_path(path: Column | str) -> Column:
    """Feed id out of a file path, '' where the path has another shape."""
    return F.regexp_extract(_col(path), FEED_PATH_PATTERN, 1)


def namespaced(feed_id: Column | str, raw_id: Column | str) -> Column:
    """``gtfs_id || id``; NULL ids stay NULL."""
    return F.concat(_col(feed_id), _col(raw_id))


# --- service time ----------------------------------------------------------


def hms_to_seconds(c: Column | str) -> Column:
    """'25:35:00' -> 92100; anything malformed -> NULL."""
    text = F.trim(_col(c))
    part = lambda i: F.split(text, ":").getItem(i).try_cast("int")
    return F.when(
        text.rlike(r"^[0-9]{1,4}:[0-5]?[0-9]:[0-5]?[0-9]$"),
        part(0) * 3600 + part(1) * 60 + part(2),
    )


def seconds_to_hms(c: Column | str) -> Column:
    """92100 -> '25:35:00' (hours keep running past 24)."""
    s = _col(c).cast("int")
    return F.when(
        s.isNotNull(),
        F.format_string(
            "%02d:%02d:%02d",
            F.floor(s / 3600).cast("int"),
            F.floor(F.pmod(s, F.lit(3600)) / 60).cast("int"),
            F.pmod(s, F.lit(60)),
        ),
    )


def clock_text(c: Column | str) -> Column:
    """Wall-clock text; later days are marked '(next day)' or '(n days later)'."""
    s = _col(c).cast("int")
    days = F.floor(s / SECONDS_PER_DAY)
    clock = seconds_to_hms(F.pmod(s, F.lit(SECONDS_PER_DAY)))
    return (
        F.when(days == 1, F.concat(clock, F.lit(" (next day)")))
        .when(days > 1, F.concat(clock, F.lit(" ("), days.cast("string"), F.lit(" days later)")))
        .otherwise(clock)
    )


def service_timestamp(service_date: Column | str, secs: Column | str) -> Column:
    """Local wall-clock timestamp of a service second; never goes through a zone."""
    return _col(service_date).cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), _col(secs)
    )


def day_offset(secs: Column | str) -> Column:
    return F.floor(_col(secs) / SECONDS_PER_DAY)


def hour_of(secs: Column | str, *, fold: bool = False) -> Column:
    """Hour bucket; with ``fold`` 25:35 counts as hour 1."""
    s = _col(secs)
    if fold:
        s = F.pmod(s, F.lit(SECONDS_PER_DAY))
    return F.floor(s / 3600)


def after_midnight(secs: Column | str) -> Column:
    return _col(secs) > SECONDS_PER_DAY


def in_windows(
    c: Column | str, windows: Sequence[tuple[int, int]], closed: str = "both"
) -> Column:
    """Service second in any of the windows; ``closed`` is 'both', 'left' or 'right'."""
    c = _col(c)
    lower = (lambda a: c > a) if closed == "right" else (lambda a: c >= a)
    upper = (lambda b: c < b) if closed == "left" else (lambda b: c <= b)
    return reduce(or_, [lower(a) & upper(b) for a, b in windows])


# --- days ------------------------------------------------------------------


def weekday_flag(service_date: Column | str) -> Column:
    """The calendar flag that belongs to a date's day of week."""
    day = F.weekday(_col(service_date))
    out = F.when(day == 0, F.col(DAYS[0]))
    for i, name in enumerate(DAYS[1:], start=1):
        out = out.when(day == i, F.col(name))
    return out


def runs_on(days: Sequence[str] | str, mode: str = "any") -> Column:
    """Calendar rows that run on ``any`` or ``all`` of the days, or ``only`` on them."""
    days = [days] if isinstance(days, str) else list(days)
    on = [F.coalesce(F.col(d) == 1, F.lit(False)) for d in days]
    if mode == "any":
        return reduce(or_, on)
    if mode == "all":
        return reduce(and_, on)
    if mode == "only":
        off = [F.coalesce(F.col(d) != 1, F.lit(True)) for d in DAYS if d not in days]
        return reduce(and_, off, reduce(or_, on))
    raise ValueError(f"unknown mode {mode!r}")


def valid_on(date: Column | str) -> Column:
    """Calendar rows whose validity span holds a date (column or 'yyyy-mm-dd')."""
    day = F.lit(date).cast("date") if isinstance(date, str) else date
    return day.between(F.col("start_date"), F.col("end_date"))


# --- filters ---------------------------------------------------------------


def name_has_any(c: Column | str, keywords: Sequence[str]) -> Column:
    """Case-insensitive 'contains any of'; NULL names do not match."""
    hits = [F.lower(_col(c)).contains(k.lower()) for k in keywords]
    return F.coalesce(reduce(or_, hits), F.lit(False))


def every_nth(seq: Column | str, n: int) -> Column:
    return F.pmod(_col(seq), F.lit(n)) == 0


def in_box(lat: Column | str, lon: Column | str, box: tuple[float, float, float, float]) -> Column:
    """``box`` is (lat_min, lat_max, lon_min, lon_max)."""
    return _col(lat).between(box[0], box[1]) & _col(lon).between(box[2], box[3])


# --- labels and buckets ----------------------------------------------------


def label(c: Column | str, labels: Mapping[int, str], default: Column | str | None = None) -> Column:
    """Code to text by a literal map."""
    pairs = [F.lit(x) for item in labels.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), _col(c).cast("int"))
    if default is None:
        return found
    return F.coalesce(found, F.lit(default) if isinstance(default, str) else default)


def route_type_label(c: Column | str) -> Column:
    return label(c, ROUTE_TYPE_LABELS, F.concat(F.lit("Route Type "), _col(c).cast("string")))


def wheelchair_label(c: Column | str) -> Column:
    return label(c, WHEELCHAIR_LABELS, "no information")


def direction_label(c: Column | str) -> Column:
    return label(c, DIRECTION_LABELS)


def _span_label(hour: Column, spans, default=None) -> Column:
    out = F.lit(default).cast("string")
    for lo, hi, name in reversed(spans):
        out = F.when((hour >= lo) & (hour < hi), F.lit(name)).otherwise(out)
    return out


def day_period(secs: Column | str) -> Column:
    """Four periods by unfolded hour: two peaks, midday, night."""
    return _span_label(hour_of(secs), PERIODS, PERIOD_ELSE)


def day_zone(hour: Column | str) -> Column:
    """Five zones by hour 0-23."""
    return _span_label(_col(hour), ZONES)


def bin_label(value: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Half-open bins ``(edge_i, edge_i+1]``; the last one is open-ended."""
    v = _col(value)
    out = F.lit(None).cast("string")
    for i, name in enumerate(labels):
        inside = v > edges[i]
        if i + 1 < len(edges):
            inside = inside & (v <= edges[i + 1])
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def display_name(long_name: Column | str = "route_long_name", short_name: Column | str = "route_short_name") -> Column:
    """Long name, else short name."""
    return F.coalesce(_col(long_name), _col(short_name))


def route_title() -> Column:
    """'short - long' with absent parts left out."""
    return F.concat_ws(" - ", "route_short_name", "route_long_name")


def full_name() -> Column:
    return F.concat_ws(" ", "route_short_name", "route_long_name")


# --- units -----------------------------------------------------------------


def minutes(secs: Column | str) -> Column:
    return _col(secs) / 60


def hours(secs: Column | str) -> Column:
    return _col(secs) / 3600


def metres(dist: Column | str, unit: str = "m") -> Column:
    return _col(dist) * (1000.0 if unit == "km" else 1.0)


def km(dist: Column | str, unit: str = "m") -> Column:
    return _col(dist) / (1.0 if unit == "km" else 1000.0)


def speed_kmh(dist_m: Column | str, secs: Column | str) -> Column:
    """km/h out of metres and seconds; NULL for zero seconds."""
    return F.try_divide(_col(dist_m), _col(secs)) * 3.6
