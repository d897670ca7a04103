"""Axis calibration: robust lines through read numbers, log scales, repair, conversion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Labels of a group whose lines are tried one by one in a row; more are voted for by intervals.
FEW = 16


def robust_line(df: DataFrame, keys: list[str], n: str, px: str, value: str, tol: float = 0.04) -> DataFrame:
    """(keys, m, b, r2, used, total). Each pair of labels proposes a line; the one that most labels lie on (within tol of the value range, the first pair among equals) is fitted again by least squares.

    A group of few labels is a list beside each of its rows, so its lines take no row of their own, no join and no sort but the group's. The lines of larger groups are voted for by intervals.
    """
    per = Window.partitionBy(*keys)
    spanned = reduce(lambda d, k: d.where(F.col(k).isNotNull()), keys, df).withColumns({"_tol": tol * (F.max(value).over(per) - F.min(value).over(per)) + 1e-12, "_size": F.count(F.lit(1)).over(per)})
    found = [_first_of_lists(spanned.where(F.col("_size") <= FEW), keys, n, px, value), _first_by_intervals(spanned.where(F.col("_size") > FEW), keys, n, px, value)]
    v, p = F.when(F.col("_in"), F.col("_v")), F.when(F.col("_in"), F.col("_p"))
    fit = lambda kept: kept.groupBy(*keys).agg(F.regr_slope(v, p).alias("m"), F.regr_intercept(v, p).alias("b"), F.regr_r2(v, p).alias("r2"), F.count_if("_in").alias("used"), F.count(F.lit(1)).alias("total")).where("used >= 2 and m is not null")
    few, many = (fit(x.select(*keys, F.col(value).alias("_v"), F.col(px).alias("_p"), (F.abs(F.col("m0") * F.col(px) + F.col("b0") - F.col(value)) <= F.col("_tol")).alias("_in"))) for x in found)
    return few.unionByName(many)


def _first_of_lists(spanned: DataFrame, keys: list[str], n: str, px: str, value: str) -> DataFrame:
    """Each label with its group's line (m0, b0): a label tries the lines through it and each later one."""
    per = Window.partitionBy(*keys)
    listed = spanned.withColumn("_l", F.collect_list(F.struct(F.col(n).alias("n"), F.col(px).alias("p"), F.col(value).alias("v"))).over(per))
    slope = lambda b: F.when(b.p != F.col(px), (b.v - F.col(value)) / (b.p - F.col(px)))
    lines = F.transform(F.filter("_l", lambda b: b.n > F.col(n)), lambda b: F.struct(b.n.alias("n2"), slope(b).alias("m0"), (F.col(value) - slope(b) * F.col(px)).alias("b0")))
    on = lambda x: F.size(F.filter("_l", lambda e: F.abs(x.m0 * e.p + x.b0 - e.v) <= F.col("_tol")))
    voted = listed.withColumn("_lines", lines).withColumn("_mine", F.array_min(F.transform(F.filter("_lines", lambda x: x.m0.isNotNull()), lambda x: F.struct((-on(x)).alias("c"), F.col(n).alias("n1"), x.n2.alias("n2"), x.m0.alias("m0"), x.b0.alias("b0")))))
    best = voted.drop("_l", "_lines").withColumn("_x", F.min("_mine").over(per))
    return best.where("_x is not null").withColumns({"m0": F.col("_x.m0"), "b0": F.col("_x.b0")})


def _first_by_intervals(spanned: DataFrame, keys: list[str], n: str, px: str, value: str) -> DataFrame:
    """The same for groups of any size.

    Lines through one label differ by their slope alone, and each other label lies on those whose slope is in one interval. So for each label the slopes that pairs propose are put in order with the ends of the intervals, and how many intervals are open at a slope is how many labels lie on its line: the square of a group's labels in rows, and no more.
    """
    side = lambda k, *more: spanned.select(*keys, *(F.col(c).alias(f"{a}{k}") for a, c in (("n", n), ("p", px), ("v", value))), *more)
    far = F.col("p2") - F.col("p1")
    rise = lambda d: (F.col("v2") - F.col("v1") + d) / far
    both = side(1, "_tol").join(side(2), keys)
    level = F.when((far == 0) & (F.abs(F.col("v2") - F.col("v1")) <= F.col("_tol")), 1).otherwise(0)  # on every line through the first, or on none
    ends = F.array(F.struct(F.least(rise(-F.col("_tol")), rise(F.col("_tol"))).alias("s"), F.lit(0).alias("kind"), F.lit(1).alias("step")), F.struct(F.greatest(rise(-F.col("_tol")), rise(F.col("_tol"))).alias("s"), F.lit(2).alias("kind"), F.lit(-1).alias("step")))
    asked = F.when(F.col("n1") < F.col("n2"), F.array(F.struct(rise(F.lit(0.0)).alias("s"), F.lit(1).alias("kind"), F.lit(0).alias("step"))))
    events = both.withColumn("_always", F.sum(level).over(Window.partitionBy(*keys, "n1"))).where((far != 0) & rise(F.lit(0.0)).isNotNull()).withColumn("_e", F.explode(F.concat(ends, F.coalesce(asked, F.array().cast("array<struct<s:double,kind:int,step:int>>"))))).select(*keys, "n1", "n2", "p1", "v1", "_always", "_e.*")
    open_ = Window.partitionBy(*keys, "n1").orderBy("s", "kind", "n2").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    voted = events.withColumn("c", F.sum("step").over(open_) + F.col("_always")).where("kind = 1")
    best = voted.groupBy(*keys).agg(F.min(F.struct((-F.col("c")).alias("c"), "n1", "n2", "s", "p1", "v1")).alias("x")).select(*keys, F.col("x.s").alias("m0"), (F.col("x.v1") - F.col("x.s") * F.col("x.p1")).alias("b0"))
    return spanned.join(best, keys)


def scale_type(df: DataFrame, keys: list[str], px: str, value: str) -> DataFrame:
    """Log if all values are positive, at least three, over a ratio of 20, and only their logarithm fits a line."""
    v = F.col(value)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.regr_r2(F.when(v > 0, F.log10(v)), F.col(px)).alias("r2_log"), F.regr_r2(v, F.col(px)).alias("r2_lin"))
    log = (F.col("_n") >= 3) & (F.col("_lo") > 0) & (F.col("_hi") >= 20 * F.col("_lo")) & (F.col("r2_log") > 0.999) & (F.col("r2_lin") < 0.98)
    return g.select(*keys, F.when(log, "log").otherwise("lineal").alias("escala"))


def converted(points: DataFrame, fit: DataFrame, keys: list[str], px: str) -> DataFrame:
    """The value of each pixel by its axis (m, b, escala), with what is doubtful about the axis."""
    line = F.col("m") * F.col(px) + F.col("b")
    out = points.join(fit, keys).withColumn("valor", F.when(F.col("escala") == "log", F.pow(F.lit(10.0), line)).otherwise(line))
    return out.withColumn("avisos", warnings([(F.col("r2") < 0.995, "ajuste"), (F.col("used") < F.col("total"), "descartadas")]))


def warnings(tests: list[tuple[Column, str]]) -> Column:
    """The names of the tests that hold."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in tests)))


def digit_variants(text: Column) -> Column:
    """Other readings of a number: the point elsewhere, a zero lost or gained, the last digit lost."""
    d = F.regexp_replace(text, "[^0-9]", "")
    sign = F.when(F.trim(text).rlike("^[-−–]"), F.lit("-")).otherwise(F.lit(""))
    pointed = F.when(F.length(d) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.length(d) - 1, F.lit(1))), lambda k: F.concat(F.substring(d, F.lit(1), k), F.lit("."), F.substring(d, k + 1, F.length(d))))).otherwise(F.array().cast("array<string>"))
    shorter = F.when(F.length(d) > 1, F.array(F.substring(d, F.lit(1), F.length(d) - 1))).otherwise(F.array().cast("array<string>"))
    return F.when(d == "", F.array().cast("array<string>")).otherwise(F.transform(F.array_distinct(F.concat(pointed, F.array(F.concat(F.lit("0."), d), d, F.concat(d, F.lit("0"))), shorter)), lambda v: F.concat(sign, v)))


def repaired(df: DataFrame, fit: DataFrame, keys: list[str], n: str, px: str, text: str, value: str, tol: float = 0.04) -> DataFrame:
    """(keys, n, corregida, valor_nuevo): a label off the line gets the variant nearest to it, if that is within tol of the range of the good ones."""
    j = df.join(fit.where("used >= 3"), keys).withColumn("_p", F.col("m") * F.col(px) + F.col("b"))
    reach = Window.partitionBy(*keys)
    whole = F.max(value).over(reach) - F.min(value).over(reach)
    marked = j.withColumn("_in", F.abs(F.col("_p") - F.col(value)) <= tol * whole + 1e-12)
    good = marked.withColumn("_r", tol * (F.max(F.when(F.col("_in"), F.col(value))).over(reach) - F.min(F.when(F.col("_in"), F.col(value))).over(reach)))
    reading = lambda t: F.struct(F.abs(t.cast("double") - F.col("_p")).alias("_e"), t.alias("t"), t.cast("double").alias("v"), F.col("_r"))
    tried = good.where("not _in").withColumn("_x", F.array_min(F.transform(digit_variants(F.col(text)), reading)))
    best = tried.where("_x is not null").groupBy(*keys, n).agg(F.min("_x").alias("x"))
    return best.where(F.col("x._e") <= F.col("x._r")).select(*keys, n, F.col("x.t").alias("corregida"), F.col("x.v").alias("valor_nuevo"))


def quantised(df: DataFrame, keys: list[str], tick: str, value: str, exact: Column) -> DataFrame:
    """Values rounded to a tenth of the group's median tick step, exact ones kept."""
    w = Window.partitionBy(*keys).orderBy(tick)
    steps = df.select(*keys, tick).distinct().withColumn("_s", F.col(tick) - F.lag(tick).over(w)).groupBy(*keys).agg((F.median("_s") / 10).alias("_r"))
    j = df.join(steps, keys, "left")
    return j.withColumn("valor", F.when(exact | F.col("_r").isNull() | (F.col("_r") == 0), F.col(value)).otherwise(F.bround(F.col(value) / F.col("_r"), 0) * F.col("_r"))).drop("_r")
