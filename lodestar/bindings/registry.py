"""Where bindings put their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def bound(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under name, with the SQL it must agree with."""

    def put(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is bound twice")
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Times without zone become timestamps; the session's zone should be UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: df[c].cast("timestamp") for c, t in df.dtypes if t == "timestamp_ntz"})
