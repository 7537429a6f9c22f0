"""Sorting, top-k, arg-max and set operations with deterministic ties."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Order = Sequence[Column | str]


def top_k(df: DataFrame, order: Order, k: int) -> DataFrame:
    """First ``k`` rows overall; name a key last so that ties are decided."""
    return df.orderBy(*order).limit(k)


def top_per(df: DataFrame, keys: Sequence[str], order: Order, k: int = 1, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of each group.

    ``row_number() <= k`` keeps only k rows per group and task before the
    shuffle, so a hot group stays small.
    """
    name = rank or "_rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    out = out.filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def union_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.distinct()


def common(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows in both, NULLs equal."""
    return a.intersect(b.select(*a.columns))


def only_in_first(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of ``a`` that are not in ``b``, NULLs equal."""
    return a.subtract(b.select(*a.columns))
