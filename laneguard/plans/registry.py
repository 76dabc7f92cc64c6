"""Registration of queries with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from laneguard.plans.domain import Domain
from laneguard.plans.sql_views import compose

QUERIES: dict[str, Callable[[Domain], DataFrame]] = {}
CHECKS: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None, needs: tuple[str, ...] | list[str] = ()):
    """Register ``fn(domain) -> DataFrame``; ``sql`` is the final SELECT over the views in ``needs``."""

    def keep(fn: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            CHECKS[name] = (tuple(needs), sql)
        return fn

    return keep


def bind(fn: Callable[[Domain], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: fn(Domain(spark, sf_dir))


def check_sql() -> dict[str, str]:
    return {name: compose(needs, sql) for name, (needs, sql) in CHECKS.items()}
