"""Registry of the queries that are compared side by side."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from dayrunner.catalog.adapter import schedule_feed, with_ctes
from dayrunner.feed import Feed
from dayrunner.session import configure


@dataclass(frozen=True)
class Check:
    key: str
    covers: str
    build: Callable[[Feed], DataFrame]
    sql: str | None


CHECKS: dict[str, Check] = {}


def check(key: str, covers: str, sql: str | None = None):
    """Register ``build(feed)`` under ``key``; ``sql`` is the equivalent statement."""

    def register(build: Callable[[Feed], DataFrame]):
        if key in CHECKS:
            raise ValueError(f"duplicate query {key}")
        CHECKS[key] = Check(key, covers, build, sql)
        return build

    return register


def run(key: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return CHECKS[key].build(schedule_feed(configure(spark), sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {key: (lambda spark, sf_dir, key=key: run(key, spark, sf_dir)) for key in CHECKS}


def oracle_sql() -> dict[str, str]:
    return {key: with_ctes(c.sql) for key, c in CHECKS.items() if c.sql}
