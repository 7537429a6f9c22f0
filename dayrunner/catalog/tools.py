"""Small helpers for registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, *cols: str, places: int = 6) -> DataFrame:
    """Round columns so that both engines agree on the last digits."""
    return df.withColumns({c: F.round(c, places) for c in cols})


def checksum(*cols: str) -> Column:
    """Order-free sum over the rows' own hashes; its SQL is ``checksum_sql``."""
    row = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])
    return F.sum(F.conv(F.substring(F.md5(row), 1, 8), 16, 10).cast("bigint"))


def checksum_sql(*exprs: str) -> str:
    row = ", ".join(f"coalesce(cast({e} as varchar), '~')" for e in exprs)
    return f"cast(sum(cast('0x' || substr(md5(concat_ws('|', {row})), 1, 8) as bigint)) as bigint)"


def sphere_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Great-circle metres."""
    return (
        f"2 * 6371008.8::double * asin(least(1.0::double, sqrt(pow(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))))"
    )


def geodesic_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    """Metres on the WGS84 ellipsoid between points that aren't almost opposite: Vincenty's inverse formulae."""
    flat, minor = "(1 / 298.257223563::double)", "(6378137.0::double * (1 - 1 / 298.257223563::double))"

    def let(value: str, name: str, body: str) -> str:
        return f"list_transform([{value}], lambda {name}: {body})[1]"

    def arc(longitude: str, body: str) -> str:
        h = f"least(1.0::double, e.h + e.c1 * e.c2 * pow(sin({longitude} / 2), 2))"
        middle = "case when 1 - g.az * g.az > 1e-14 then g.co - 2 * e.s1 * e.s2 / (1 - g.az * g.az) else 0.0::double end"
        angles = f"""{{'arc': 2 * atan2(sqrt(h), sqrt(1 - h)), 'si': 2 * sqrt(h * (1 - h)), 'co': 1 - 2 * h,
            'az': coalesce(e.c1 * e.c2 * sin({longitude}) / nullif(2 * sqrt(h * (1 - h)), 0), 0.0::double)}}"""
        return let(h, "h", let(angles, "g", let(middle, "m", body)))

    cos2 = "(1 - g.az * g.az)"
    c = f"({flat} / 16 * {cos2} * (4 + {flat} * (4 - 3 * {cos2})))"
    excess = let(c, "c", f"(1 - c) * {flat} * g.az * (g.arc + c * g.si * (m + c * g.co * (2 * m * m - 1)))")
    u = f"({cos2} * (pow(6378137.0::double, 2) - pow({minor}, 2)) / pow({minor}, 2))"
    less = "b * g.si * (m + b / 4 * (g.co * (2 * m * m - 1) - b / 6 * m * (4 * g.si * g.si - 3) * (4 * m * m - 3)))"
    length = let(u, "u", let("u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))", "b", f"{minor} * (1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))) * (g.arc - {less})"))
    steps = f"list_reduce(list_resize([e.l], 9, 0.0::double), lambda x, y: e.l + {arc('x', excess)})"
    reduced = lambda p: f"atan2((1 - {flat}) * sin(radians({p})), cos(radians({p})))"
    between = (
        f"atan2((1 - {flat}) * sin(radians({lat2} - {lat1})),"
        f" cos(radians({lat1})) * cos(radians({lat2})) + pow(1 - {flat}, 2) * sin(radians({lat1})) * sin(radians({lat2})))"
    )
    ends = f"""{{'s1': sin({reduced(lat1)}), 'c1': cos({reduced(lat1)}), 's2': sin({reduced(lat2)}), 'c2': cos({reduced(lat2)}),
        'h': pow(sin({between} / 2), 2), 'l': radians(abs({lon2} - {lon1}))}}"""
    metres = let(ends, "e", let(steps, "s", arc("s", length)))
    return f"(case when {lat1} = {lat2} and {lon1} = {lon2} then 0.0::double when {lat1} + {lon1} + {lat2} + {lon2} is not null then {metres} end)"


def texts(df: DataFrame, *cols: str) -> DataFrame:
    """Dates and timestamps as text."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols})
