"""Registry of the named queries checked by the driver.

Each query takes ``(spark, sf_dir)`` and returns a lazy DataFrame built from
the driver's tables; ``ORACLE`` holds the matching DuckDB SQL where the
result is SQL-expressible. Column names are identical on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, Callable[[], str]] = {}


def register(name: str, sql: Callable[[], str] | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from reviewlab.plans import queries_text  # noqa: F401
    from reviewlab.plans import queries_tables  # noqa: F401
    from reviewlab.plans import queries_sampling  # noqa: F401
    from reviewlab.plans import queries_eval  # noqa: F401
    from reviewlab.plans import queries_features  # noqa: F401
    from reviewlab.plans import queries_ml  # noqa: F401


def queries() -> dict[str, QueryFn]:
    load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load_all()
    return {k: f() for k, f in ORACLE.items()}
