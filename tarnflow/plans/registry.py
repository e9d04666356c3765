"""Every query on the driver's tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with the SQL that must give the same rows."""

    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    import tarnflow.plans.library
    import tarnflow.plans.queries
    import tarnflow.plans.scalars  # noqa: F401  register them

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    import tarnflow.plans.library
    import tarnflow.plans.queries
    import tarnflow.plans.scalars  # noqa: F401

    return dict(_SQL)
