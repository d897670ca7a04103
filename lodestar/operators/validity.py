"""Row checks that send rejects away with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def split_rows(df: DataFrame, tests: list[tuple[str, Column]], group: list[str], most: int) -> DataFrame:
    """Adds reason: the first test that a row fails, or that its group has more than most rows."""
    reason = F.coalesce(*(F.when(c, F.lit(name)) for name, c in tests), F.when(F.count(F.lit(1)).over(Window.partitionBy(*group)) > most, F.lit("too many")))
    return df.withColumn("reason", reason)


def unique_ids(df: DataFrame, group: list[str], id_: str, order: list[str], kind: str) -> DataFrame:
    """Repeated ids get _2, _3 in order; an empty one becomes kind_n with n its number among the empty ones of its kind."""
    blank = F.coalesce(F.col(id_), F.lit("")) == ""
    w = Window.partitionBy(*group, F.coalesce(id_, F.lit("")), F.when(blank, F.col(kind))).orderBy(*order)
    n = F.row_number().over(w)
    return df.withColumn("unique_id", F.when(blank, F.concat_ws("_", F.col(kind), n.cast("string"))).when(n > 1, F.concat_ws("_", F.col(id_), n.cast("string"))).otherwise(F.col(id_)))


def bounded_edits(df: DataFrame, group: list[str], key: str, text: str, dx: str, dy: str, order: list[str], pattern: str, most: int = 12, length: int = 120, reach: float = 220.0) -> DataFrame:
    """Edits whose key fits the pattern, the first of each key, at most most of a group; texts cut, moves clamped, zero and not finite moves dropped."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    kept = df.where(F.col(key).rlike(pattern)).where(fine(dx) & fine(dy)).where((F.col(dx) != 0) | (F.col(dy) != 0))
    once = kept.withColumn("_k", F.row_number().over(Window.partitionBy(*group, key).orderBy(*order))).where("_k = 1")
    clamp = lambda c: F.greatest(F.lit(-reach), F.least(F.lit(reach), F.col(c)))
    return once.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_k") <= most).drop("_k").withColumns({text: F.substring(F.trim(text), 1, length), dx: clamp(dx), dy: clamp(dy)})
