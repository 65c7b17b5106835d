"""Registry of named queries: a DataFrame plan over ``Tables`` and its SQL, where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .tables import Tables, with_views

_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Registers plan(Tables) -> DataFrame under a name."""

    def register(plan: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        _queries[name] = lambda spark, sf_dir: plan(Tables(spark, sf_dir))
        if sql is not None:
            _sql[name] = with_views(sql)
        return plan

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from .. import operators, streaming  # noqa: F401  registers on import

    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_sql)
