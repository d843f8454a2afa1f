"""Named queries with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lumirank.session import bound_tasks, configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is defined twice")
        QUERIES[name] = lambda spark, sf_dir: fn(bound_tasks(configure(spark)), sf_dir)
        if sql:
            SQL[name] = sql
        return fn
    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column, so two engines' sums compare equal."""
    return df.select([(F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)).alias(f.name)
                      if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                      for f in df.schema.fields])
