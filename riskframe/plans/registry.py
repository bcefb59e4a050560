"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name."""

    def registered(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return registered


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """Doubles to a few digits, so that the order of summation does not show; nudge: away from ties, as in the SQL."""
    return df.select(*((F.round(F.col(c) + nudge, digits) + F.lit(0.0)).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskframe.plans.features import entity_split_summary

    return entity_split_summary(spark, sf_dir)


def load() -> None:
    from riskframe.plans import audits, decisions, features, learning, monitoring, profiles, reports, streams, validation  # noqa: F401


def queries() -> dict[str, Query]:
    load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    load()
    return dict(SQL)
