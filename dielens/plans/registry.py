"""The table of registered queries and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from dielens.plans.oracle_views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` may use the view names of ``oracle_views``.

    Business time is UTC, whatever zone the caller's session has.
    """

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")

        @wraps(fn)
        def in_utc(spark: SparkSession, sf: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf)

        QUERIES[name] = in_utc
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return add


def r4(sql: str) -> str:
    """The SQL counterpart of ``steady``."""
    return f"round(({sql}) + 1e-7, 4)"
