"""Geometry on WGS84 latitude/longitude columns, as plain math expressions."""

from __future__ import annotations

from collections.abc import Callable
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6371008.8
METRES_PER_DEGREE = 111195.08  # one degree of latitude on that sphere
# Great-circle metres are at most so many times the metres on the ellipsoid.
SPHERE_EXCESS = 1.006

# Fixed values of the WGS84 ellipsoid: semi-axes in metres and flattening.
MAJOR_M = 6378137.0
FLATTENING = 1 / 298.257223563
MINOR_M = MAJOR_M * (1 - FLATTENING)
LONGITUDE_STEPS = 8
CONVERGED = 1e-12
AZIMUTH_STEPS = 50


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres; within 0.6 % of the ellipsoidal distance."""
    dlat = F.radians(lat2 - lat1) / 2
    dlon = F.radians(lon2 - lon1) / 2
    h = F.pow(F.sin(dlat), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlon), F.lit(2)
    )
    # Clamped by when(), because least() would turn a NULL distance into a number.
    return 2 * EARTH_RADIUS_M * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _square(c: Column) -> Column:
    return c * c


def _longitude_excess(sin_az: Column, arc: Column, sin_arc: Column, cos_arc: Column, cos_mid: Column) -> Column:
    """How much the longitude on the sphere exceeds that on the ellipsoid (Vincenty)."""
    cos2 = 1 - _square(sin_az)
    c = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
    return (1 - c) * FLATTENING * sin_az * (arc + c * sin_arc * (cos_mid + c * cos_arc * (2 * _square(cos_mid) - 1)))


def _arc_metres(sin_az: Column, arc: Column, sin_arc: Column, cos_arc: Column, cos_mid: Column) -> Column:
    """Length of an arc of the auxiliary sphere on the ellipsoid (Vincenty)."""
    u2 = (1 - _square(sin_az)) * ((MAJOR_M**2 - MINOR_M**2) / MINOR_M**2)

    def length(k: Column) -> Column:
        a, b = k["a"], k["b"]
        less = b * sin_arc * (cos_mid + b / 4 * (
            cos_arc * (2 * _square(cos_mid) - 1) - b / 6 * cos_mid * (4 * _square(sin_arc) - 3) * (4 * _square(cos_mid) - 3)))
        return MINOR_M * a * (arc - less)

    return _let(F.struct(
        (1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))).alias("a"),
        (u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))).alias("b")), length)


def _arc(b: Column, longitude: Column, body: Callable[..., Column]) -> Column:
    """``body(sin_az, arc, sin_arc, cos_arc, cos_mid)`` of the great circle between two
    reduced latitudes at this difference of longitude; exact for short arcs too."""

    def angles(h: Column) -> Column:
        sin_arc = 2 * F.sqrt(h * (1 - h))
        return _let(F.struct(
            (2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))).alias("arc"), sin_arc.alias("sin"), (1 - 2 * h).alias("cos"),
            F.coalesce(F.try_divide(b["c1"] * b["c2"] * F.sin(longitude), sin_arc), F.lit(0.0)).alias("az")), middle)

    def middle(v: Column) -> Column:
        cos2 = 1 - _square(v["az"])
        mid = F.when(cos2 > 1e-14, v["cos"] - 2 * b["s1"] * b["s2"] / cos2).otherwise(0.0)
        return _let(mid, lambda m: body(v["az"], v["arc"], v["sin"], v["cos"], m))

    h = b["h"] + b["c1"] * b["c2"] * _square(F.sin(longitude / 2))
    return _let(F.when(h > 1, F.lit(1.0)).otherwise(h), angles)


def _near_antipodal(b: Column) -> Column:
    """Metres between points almost opposite each other: the azimuth at the point farther
    from the equator, taken as south of it, is bisected until the longitude fits."""
    swap = F.abs(b["s1"]) >= F.abs(b["s2"])
    far, near = F.when(swap, b["s1"]).otherwise(b["s2"]), F.when(swap, b["s2"]).otherwise(b["s1"])
    # Kept off the equator, where the azimuth would not tell the arcs apart.
    south = -F.greatest(F.abs(far), F.lit(1e-15))
    ends = F.struct(
        south.alias("s1"), F.when(far > 0, -near).otherwise(near).alias("s2"),
        F.when(swap, b["c1"]).otherwise(b["c2"]).alias("c1"), F.when(swap, b["c2"]).otherwise(b["c1"]).alias("c2"), b["l"].alias("l"))

    def arc(e: Column, azimuth: Column, body: Callable[[Column], Column]) -> Column:
        sin_az = F.sin(azimuth) * e["c1"]
        cos1 = F.cos(azimuth) * e["c1"]
        cos2 = F.sqrt(F.greatest(F.lit(0.0), _square(cos1) + (_square(e["s1"]) - _square(e["s2"]))))
        return _let(F.struct(
            sin_az.alias("az"), F.atan2(e["s1"], cos1).alias("a1"), F.atan2(e["s2"], cos2).alias("a2"),
            (F.atan2(sin_az * e["s2"], cos2) - F.atan2(sin_az * e["s1"], cos1)).alias("lon")), body)

    def terms(v: Column) -> tuple[Column, ...]:
        arc_ = v["a2"] - v["a1"]
        return v["az"], arc_, F.sin(arc_), F.cos(arc_), F.cos(v["a1"] + v["a2"])

    def halved(e: Column, span: Column) -> Column:
        middle = (span["lo"] + span["hi"]) / 2
        west = arc(e, middle, lambda v: v["lon"] - _longitude_excess(*terms(v))) < e["l"]
        return F.struct(F.when(west, middle).otherwise(span["lo"]).alias("lo"), F.when(west, span["hi"]).otherwise(middle).alias("hi"))

    def solved(e: Column) -> Column:
        span = F.aggregate(
            F.sequence(F.lit(1), F.lit(AZIMUTH_STEPS)), F.struct(F.lit(0.0).alias("lo"), F.lit(pi).alias("hi")), lambda s, _: halved(e, s))
        return _let(span, lambda s: arc(e, (s["lo"] + s["hi"]) / 2, lambda v: _arc_metres(*terms(v))))

    return _let(ends, solved)


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Shortest metres on the WGS84 ellipsoid, to a millimetre.

    The longitude on the auxiliary sphere is iterated LONGITUDE_STEPS times, each
    of which gains more than two digits; only points almost opposite each other
    aren't settled by then, and take the azimuth instead. Equal points are at 0;
    a missing coordinate gives no distance.
    """
    p1, p2 = F.radians(lat1), F.radians(lat2)
    apart = F.abs(F.pmod(lon2 - lon1 + 180.0, F.lit(360.0)) - 180.0)
    polar = 1 - FLATTENING
    reduced = lambda p: F.atan2(polar * F.sin(p), F.cos(p))
    # Taken from the difference, so that close points keep all their digits.
    between = F.atan2(polar * F.sin(F.radians(lat2 - lat1)), F.cos(p1) * F.cos(p2) + polar**2 * F.sin(p1) * F.sin(p2))
    base = F.struct(
        F.sin(reduced(p1)).alias("s1"), F.cos(reduced(p1)).alias("c1"), F.sin(reduced(p2)).alias("s2"), F.cos(reduced(p2)).alias("c2"),
        _square(F.sin(between / 2)).alias("h"), F.radians(apart).alias("l"))

    def step(b: Column, s: Column) -> Column:
        return F.struct(s["now"].alias("last"), (b["l"] + _arc(b, s["now"], _longitude_excess)).alias("now"))

    def metres(b: Column) -> Column:
        settled = F.aggregate(
            F.sequence(F.lit(1), F.lit(LONGITUDE_STEPS)), F.struct(b["l"].alias("last"), b["l"].alias("now")), lambda s, _: step(b, s))
        return _let(settled, lambda s: F.when(
            (F.abs(s["now"] - s["last"]) <= CONVERGED) & (s["now"] <= pi), _arc(b, s["now"], _arc_metres)).otherwise(_near_antipodal(b)))

    known = lat1.isNotNull() & lon1.isNotNull() & lat2.isNotNull() & lon2.isNotNull()
    same = (lat1 == lat2) & (lon1 == lon2)
    return F.when(known, F.when(same, F.lit(0.0)).otherwise(_let(base, metres)))


def with_geodesic(df: DataFrame, lat1: str, lon1: str, lat2: str, lon2: str, name: str) -> DataFrame:
    """``df`` with a column of ``geodesic`` between its coordinates, for many rows.

    The same formulas, step by step as columns: Spark compiles those, whereas it interprets
    the nested functions that one expression needs. Points almost opposite take the expression.
    Missing coordinates are 0 on the way, which saves checks for nulls.
    """
    own = "_geodesic_"
    c = lambda n: F.col(own + n)
    out = df

    def put(**columns: Column) -> None:
        nonlocal out
        out = out.withColumns({own + n: v for n, v in columns.items()})

    def arc(longitude: Column) -> None:
        """sin_az, arc, sin_arc, cos_arc, cos_mid of the great circle at this difference of longitude, as in ``_arc``."""
        put(lon=longitude)
        put(half=c("h") + c("c12") * _square(F.sin(c("lon") / 2)))
        put(half=F.when(c("half") > 1, F.lit(1.0)).otherwise(c("half")))
        put(root=F.sqrt(c("half")), rest=F.sqrt(1 - c("half")))
        put(arc=2 * F.atan2(c("root"), c("rest")), sin=2 * F.sqrt(c("half") * (1 - c("half"))), cos=1 - 2 * c("half"))
        put(az=F.coalesce(F.try_divide(c("c12") * F.sin(c("lon")), c("sin")), F.lit(0.0)))
        put(cos2=1 - _square(c("az")))
        put(mid=F.when(c("cos2") > 1e-14, c("cos") - 2 * c("s1") * c("s2") / c("cos2")).otherwise(0.0))

    a, b = F.col(lat1), F.col(lat2)
    polar = 1 - FLATTENING
    filled = lambda n: F.coalesce(F.col(n).cast("double"), F.lit(0.0))
    put(p1=F.radians(filled(lat1)), p2=F.radians(filled(lat2)), d=F.radians(filled(lat2) - filled(lat1)),
        l=F.coalesce(F.radians(F.abs(F.pmod(filled(lon2) - filled(lon1) + 180.0, F.lit(360.0)) - 180.0)), F.lit(0.0)))
    put(sp1=F.sin(c("p1")), cp1=F.cos(c("p1")), sp2=F.sin(c("p2")), cp2=F.cos(c("p2")))
    put(r1=F.atan2(polar * c("sp1"), c("cp1")), r2=F.atan2(polar * c("sp2"), c("cp2")),
        between=F.atan2(polar * F.sin(c("d")), c("cp1") * c("cp2") + polar**2 * c("sp1") * c("sp2")))
    put(s1=F.sin(c("r1")), c1=F.cos(c("r1")), s2=F.sin(c("r2")), c2=F.cos(c("r2")), h=_square(F.sin(c("between") / 2)))
    put(c12=c("c1") * c("c2"), now=c("l"))
    for step in range(LONGITUDE_STEPS):
        if step % 3 == 2:
            # Parts the generated code: Java leaves methods of over 8,000 bytes uncompiled.
            put(now=_let(c("now"), lambda x: x))
        arc(c("now"))
        put(k=FLATTENING / 16 * c("cos2") * (4 + FLATTENING * (4 - 3 * c("cos2"))), last=c("now"))
        put(now=c("l") + (1 - c("k")) * FLATTENING * c("az") * (c("arc") + c("k") * c("sin") * (
            c("mid") + c("k") * c("cos") * (2 * _square(c("mid")) - 1))))
    arc(c("now"))
    put(u2=c("cos2") * ((MAJOR_M**2 - MINOR_M**2) / MINOR_M**2), mid2=_square(c("mid")))
    u2 = c("u2")
    put(a=1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2))), b=u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2))))
    less = c("b") * c("sin") * (c("mid") + c("b") / 4 * (
        c("cos") * (2 * c("mid2") - 1) - c("b") / 6 * c("mid") * (4 * _square(c("sin")) - 3) * (4 * c("mid2") - 3)))
    put(metres=MINOR_M * c("a") * (c("arc") - less), settled=(F.abs(c("now") - c("last")) <= CONVERGED) & (c("now") <= pi))
    known = a.isNotNull() & F.col(lon1).isNotNull() & b.isNotNull() & F.col(lon2).isNotNull()
    same = (a == b) & (F.col(lon1) == F.col(lon2))
    metres = F.when(~known, F.lit(None).cast("double")).when(same, F.lit(0.0)).when(c("settled"), c("metres")).otherwise(
        geodesic(a, F.col(lon1), b, F.col(lon2)))
    kept = [n for n in df.columns if n != name]
    return out.select(*kept, metres.alias(name))


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial compass bearing in degrees, 0 <= b < 360."""
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    east = F.sin(dl) * F.cos(p2)
    north = F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl)
    return F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))


def angle_at(x0: Column, y0: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Angle in degrees at (x1, y1) between the rays to its two neighbours."""
    ax, ay, bx, by = x0 - x1, y0 - y1, x2 - x1, y2 - y1
    norms = F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by)
    cosine = F.try_divide(ax * bx + ay * by, norms)
    clamped = F.when(cosine > 1, F.lit(1.0)).when(cosine < -1, F.lit(-1.0)).otherwise(cosine)
    return F.degrees(F.acos(clamped))


def cell(value: Column, size: Column | float) -> Column:
    return F.floor(value / size)


def cell_range(lo: Column, hi: Column, size: Column | float, margin: int = 0) -> Column:
    """Array of the grid cells a span touches, widened by ``margin`` cells."""
    return F.sequence(cell(F.least(lo, hi), size) - margin, cell(F.greatest(lo, hi), size) + margin)


def cross(ox: Column, oy: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Orientation of (o, a, b): positive when the turn is to the left."""
    return (ax - ox) * (by - oy) - (ay - oy) * (bx - ox)


def segments_touch(a: str, b: str) -> Column:
    """Do segments ``a`` and ``b`` share a point?

    Columns are ``<prefix>x0, y0, x1, y1``. Touching and collinear overlap count.
    """
    p = lambda s, n: F.col(f"{s}{n}")
    d1 = cross(p(a, "x0"), p(a, "y0"), p(a, "x1"), p(a, "y1"), p(b, "x0"), p(b, "y0"))
    d2 = cross(p(a, "x0"), p(a, "y0"), p(a, "x1"), p(a, "y1"), p(b, "x1"), p(b, "y1"))
    d3 = cross(p(b, "x0"), p(b, "y0"), p(b, "x1"), p(b, "y1"), p(a, "x0"), p(a, "y0"))
    d4 = cross(p(b, "x0"), p(b, "y0"), p(b, "x1"), p(b, "y1"), p(a, "x1"), p(a, "y1"))
    straddles = (d1 * d2 <= 0) & (d3 * d4 <= 0)
    overlap = (
        (F.least(p(a, "x0"), p(a, "x1")) <= F.greatest(p(b, "x0"), p(b, "x1")))
        & (F.least(p(b, "x0"), p(b, "x1")) <= F.greatest(p(a, "x0"), p(a, "x1")))
        & (F.least(p(a, "y0"), p(a, "y1")) <= F.greatest(p(b, "y0"), p(b, "y1")))
        & (F.least(p(b, "y0"), p(b, "y1")) <= F.greatest(p(a, "y0"), p(a, "y1")))
    )
    return straddles & overlap
