"""Metric reports: long rows, judged against criteria, and one column for each plate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.rates import judged


def unpivoted(df: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics in columns as rows (keys, metric, value)."""
    cols = [c for c in df.columns if c not in keys]
    return df.select(*keys, *(F.col(c).cast("double").alias(c) for c in cols)).unpivot(keys, cols, "metric", "value")


def long_report(metrics: DataFrame, registry: DataFrame, plate: str) -> DataFrame:
    """A row for each plate and registered metric, measured or not. registry: metric, grp, op, lo, hi; more metrics are more rows."""
    rows = metrics.select(plate).distinct().crossJoin(F.broadcast(registry.select(F.col("metric").alias("_m"))))  # the registry is a short list
    full = rows.join(metrics, (rows[plate] == metrics[plate]) & (rows["_m"] == metrics["metric"]), "left").select(rows[plate], F.col("_m").alias("metric"), "value")
    return judged(full, registry).select(plate, "grp", "metric", "value", "cumple")


def wide_report(long: DataFrame, plate: str, plates: list[str]) -> DataFrame:
    """A column for each plate; metrics without any value are left out."""
    return long.where("value is not null").groupBy("grp", "metric").pivot(plate, plates).agg(F.first("value"))


def borrowed(df: DataFrame, plate: str, condition: str, value: str) -> DataFrame:
    """A plate without a value takes that of the first other plate with the same condition, and says whose."""
    have = df.where(F.col(value).isNotNull() & F.col(condition).isNotNull())
    first = have.groupBy(condition).agg(F.min(F.struct(plate, value)).alias("_f"))
    j = df.join(first, condition, "left")
    lacks = F.col(value).isNull() & F.col("_f").isNotNull()
    return j.select(plate, condition, F.when(lacks, F.col("_f")[value]).otherwise(F.col(value)).alias(value), F.when(lacks, F.col("_f")[plate]).alias("de"))
