"""Order-dependent steps over groups of any size.

A plain ``lag`` over a trip puts the whole trip into one task. Here a group is
first cut into slices of its order column, each slice is handled on its own,
and only the outermost rows of the slices meet in a second, small window. The
result is the same as one window over the whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE = 4096


def neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    *,
    prev: Mapping[str, str] | None = None,
    next: Mapping[str, str] | None = None,
    width: int = SLICE,
    parts: int | None = None,
) -> DataFrame:
    """Add columns of the previous and next row within ``keys``.

    ``prev`` and ``next`` map new column names to source columns. ``order`` is
    numeric, not null and unique within a group. ``parts`` deals the slices and
    their ends to so many tasks, whatever the number of shuffle partitions.
    """
    prev, next = dict(prev or {}), dict(next or {})
    within = Window.partitionBy(*keys, "_slice").orderBy(order)
    dealt = df.withColumn("_slice", F.floor(F.col(order) / width))
    if parts:
        dealt = dealt.repartition(parts, *keys, "_slice")
    sliced = dealt.select(
        "*",
        F.lag(order).over(within).isNull().alias("_opens"),
        F.lead(order).over(within).isNull().alias("_closes"),
        *[F.lag(c).over(within).alias(n) for n, c in prev.items()],
        *[F.lead(c).over(within).alias(n) for n, c in next.items()],
    )
    edge = F.col("_opens") | F.col("_closes")
    across = Window.partitionBy(*keys).orderBy(order)
    drop = ("_slice", "_opens", "_closes")
    ends = sliced.filter(edge).repartition(parts, *keys) if parts else sliced.filter(edge)
    edges = ends.select(
        *[c for c in df.columns if c not in prev and c not in next],
        *[
            F.when(F.col("_opens"), F.lag(c).over(across)).otherwise(F.col(n)).alias(n)
            for n, c in prev.items()
        ],
        *[
            F.when(F.col("_closes"), F.lead(c).over(across)).otherwise(F.col(n)).alias(n)
            for n, c in next.items()
        ],
    )
    return sliced.filter(~edge).drop(*drop).unionByName(edges)


def positions(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "position", width: int = SLICE
) -> DataFrame:
    """1-based rank of each row within ``keys`` by a unique numeric ``order``."""
    within = Window.partitionBy(*keys, "_slice").orderBy(order)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(
        Window.unboundedPreceding, -1
    )
    sliced = df.withColumn("_slice", F.floor(F.col(order) / width)).withColumn(
        "_rank", F.row_number().over(within)
    )
    offsets = (
        sliced.groupBy(*keys, "_slice")
        .agg(F.count("*").alias("_n"))
        .withColumn("_offset", F.sum("_n").over(before))
        .filter("_offset is not null")
        .drop("_n")
    )
    joined = sliced.join(offsets, [*keys, "_slice"], "left")
    return joined.withColumn(
        name, (F.col("_rank") + F.coalesce(F.col("_offset"), F.lit(0))).cast("bigint")
    ).drop("_slice", "_rank", "_offset")


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median", margin: float = 0.01
) -> DataFrame:
    """Exact median per group without holding a group's values in one place.

    A mergeable sketch brackets the middle ranks with room to spare; values
    below the bracket are only counted and those inside are ranked.
    """
    keys = list(keys)
    values = df.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    sketch = F.percentile_approx("_v", [0.5 - margin, 0.5 + margin], 10_000)
    bounds = values.groupBy(*keys).agg(sketch.alias("_q"), F.count("*").alias("_total"))
    inside = (
        values.join(bounds, keys).filter(F.col("_v") <= F.col("_q")[1])
        .groupBy(*keys, F.when(F.col("_v") >= F.col("_q")[0], F.col("_v")).alias("_v"))
        .agg(F.count("*").alias("_n"), F.max("_total").alias("_total"))
    )
    upto = Window.partitionBy(*keys).orderBy(F.asc_nulls_first("_v")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = inside.withColumn("_upto", F.sum("_n").over(upto))

    def at(rank: Column) -> Column:
        here = (rank <= F.col("_upto")) & (rank > F.col("_upto") - F.col("_n"))
        return F.max(F.when(here, F.col("_v")))

    total = F.col("_total")
    return ranked.groupBy(*keys).agg(
        ((at(F.floor((total + 1) / 2)) + at(F.floor((total + 2) / 2))) / 2).alias(name)
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, width: int = SLICE
) -> DataFrame:
    """Inclusive running sum of ``value`` within ``keys`` by a unique numeric ``order``."""
    within = Window.partitionBy(*keys, "_slice").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sliced = df.withColumn("_slice", F.floor(F.col(order) / width)).withColumn(
        "_part", F.sum(value).over(within)
    )
    offsets = (
        sliced.groupBy(*keys, "_slice").agg(F.sum(value).alias("_s"))
        .withColumn("_offset", F.sum("_s").over(before))
        .filter("_offset is not null").drop("_s")
    )
    joined = sliced.join(offsets, [*keys, "_slice"], "left")
    return joined.withColumn(
        name, F.col("_part") + F.coalesce(F.col("_offset"), F.lit(0))
    ).drop("_slice", "_part", "_offset")
