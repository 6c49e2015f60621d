"""Where queries are registered: name -> function of views, with the SQL twin that DuckDB runs where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..fixtures import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register f(views) under a name; sql names views as tables."""

    def register(f: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Views(spark, sf_dir))

        run.__name__ = run.__qualname__ = name
        run.__doc__ = f.__doc__
        assert name not in QUERIES, name
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = with_views(sql)
        return f

    return register
