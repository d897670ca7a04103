"""Events over selections and samples: announcements, crossings, confirmation, inactivity, throughput. Batch forms are windows; stream forms say so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.operators.rates import exact_percentiles

SAMPLE = "session bigint, chart bigint, n bigint, t timestamp, x double, y double, x2 double, y2 double, palm double, inside boolean"


def sample_stream(spark: SparkSession, path: str, files: int | None = None) -> DataFrame:
    """Samples as a file stream; rows without a hand have null positions but keep t."""
    reader = spark.readStream.schema(SAMPLE)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(path)


def announcements(df: DataFrame, keys: list[str], active: Column, element: str, order: list[str]) -> DataFrame:
    """A row for each new element while active; after a release the same one is announced again."""
    o = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_on", active).withColumn("_rise", (F.col("_on") & ~F.coalesce(F.lag("_on").over(o), F.lit(False))).cast("int")).withColumn("activacion", F.sum("_rise").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    said = rows.where(F.col("_on") & F.col(element).isNotNull())
    within = Window.partitionBy(*keys, "activacion").orderBy(*order)
    return said.withColumn("_was", F.lag(element).over(within)).where(~F.col(element).eqNullSafe(F.col("_was"))).drop("_on", "_rise", "_was")


def first_in_activation(df: DataFrame, keys: list[str], activation: str, event: list[str], order: list[str]) -> DataFrame:
    """An event once for each activation."""
    w = Window.partitionBy(*keys, activation, *event).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def confirmed(df: DataFrame, keys: list[str], x: str, y: str, sure: Column, order: list[str], far: float = 3.0, near: float = 1.5) -> DataFrame:
    """A move of more than far counts only when the next sure detection agrees with it within near."""
    o = Window.partitionBy(*keys).orderBy(*order)
    rows = df.where(sure).withColumns({"_px": F.lag(x).over(o), "_py": F.lag(y).over(o), "_nx": F.lead(x).over(o), "_ny": F.lead(y).over(o)})
    moved = F.hypot(F.col(x) - F.col("_px"), F.col(y) - F.col("_py")) > far
    again = F.hypot(F.col(x) - F.col("_nx"), F.col(y) - F.col("_ny")) <= near
    return rows.withColumn("aceptado", ~F.coalesce(moved, F.lit(False)) | F.coalesce(again, F.lit(False))).drop("_px", "_py", "_nx", "_ny")


def inactivity(df: DataFrame, keys: list[str], ts: str, gap: str = "10 seconds") -> DataFrame:
    """Where nothing comes for a gap; on a stream (with a watermark) a row appears once the gap has passed."""
    return df.groupBy(*keys, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(*keys, F.col("w.start").alias("desde"), F.col("w.end").alias("aviso"), "n")


def latest(df: DataFrame, keys: list[str], ts: str, columns: list[str]) -> DataFrame:
    """The newest row of each key; on a stream in update mode."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(ts, *columns)).alias("x")).select(*keys, "x.*")


def throughput(df: DataFrame, ts: str, done: Column, ms: str, width: str = "10 seconds", streaming: bool = False) -> DataFrame:
    """By tumbling window the rate of rows, the rate of those done, and the median time (approximate on a stream, exact otherwise, however many rows a window holds)."""
    counts = (F.count(F.lit(1)).alias("n"), F.count_if(done).alias("hechos"))
    rows = df.withColumn("w", F.window(ts, width))
    if streaming:
        g = rows.groupBy("w").agg(*counts, F.percentile_approx(ms, 0.5).alias("ms_mediana"))
    else:
        g = rows.groupBy("w").agg(*counts).join(exact_percentiles(rows, ["w"], {"ms_mediana": (ms, 0.5)}), "w")
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return g.select(F.col("w.start").alias("desde"), (F.col("n") / seconds).alias("por_s"), (F.col("hechos") / seconds).alias("hechos_s"), "ms_mediana")


def in_order(df: DataFrame, keys: list[str], t: str, arrival: list[str]) -> DataFrame:
    """Rows that are newer than all that arrived before them."""
    o = Window.partitionBy(*keys).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_m", F.max(t).over(o)).where(F.col("_m").isNull() | (F.col(t) > F.col("_m"))).drop("_m")
