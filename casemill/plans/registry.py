"""Registered queries and their SQL checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.plans.fixtures import with_tables
from casemill.session import limit_methods

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}
SURVEY_IDS: dict[str, str] = {}


def query(name: str, ids: str, sql: str | None = None, money: tuple[str, ...] = (), digits: int = 4):
    """Register a query. ``money`` columns are compared as doubles rounded to ``digits`` on both sides."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            limit_methods(spark)
            df = build(spark, sf_dir)
            rounded = {c: F.round(F.col(c).cast("double"), digits) for c in money}
            return df.withColumns(rounded) if rounded else df

        if name in QUERIES:
            raise ValueError(f"query {name} is already registered")
        QUERIES[name] = run
        SURVEY_IDS[name] = ids
        if sql is not None:
            CHECKS[name] = _rounded(with_tables(sql), money, digits)
        return build

    return register


def rounded_sql(value: str, digits: int) -> str:
    """Half-up rounding of a double by its decimal digits, as Spark rounds; DuckDB rounds the binary value."""
    return f"CAST(round(CAST({value} AS DECIMAL(38,12)), {digits}) AS DOUBLE)"


def percent_sql(part: str, whole: str, digits: int = 4) -> str:
    return rounded_sql(f"CAST({part} AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0) * 100", digits)


def _rounded(sql: str, money: tuple[str, ...], digits: int) -> str:
    if not money:
        return sql
    replaced = ", ".join(f"{rounded_sql(f'CAST({c} AS DOUBLE)', digits)} AS {c}" for c in money)
    return f"SELECT * REPLACE ({replaced}) FROM ({sql}) AS checked"
