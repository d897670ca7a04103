"""Rates, votes, summaries and criteria over trials, attempts, frames and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestar.functions.columns import finite, wilson


def med(c: Column | str) -> Column:
    """A2: exact median without nulls and NaN; null if nothing is left."""
    c = F.col(c) if isinstance(c, str) else c
    return F.median(F.when(~F.isnan(c), c))


def pct(c: Column | str, q: float) -> Column:
    """A3: exact percentile, linear between ranks."""
    c = F.col(c) if isinstance(c, str) else c
    return F.percentile(F.when(~F.isnan(c), c), F.lit(q))


#: Share of a group's rows that percentile_approx may be off by, groups whose bounds the driver holds, values of a group that are ranked in one task, and steps of a narrower search.
OFF, FEW_GROUPS, RANKED, STEPS = 1e-4, 10_000, 1_000_000, 200


def _brackets(df: DataFrame, keys: list[str], clean: dict[str, Column], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """(_k0, ..., _b_name: n, lo, hi): values between which each rank lies. One read of the rows; a further one for each time that some group has more than RANKED values in between."""
    names = [f"_k{i}" for i in range(len(keys))]
    edge = lambda n, q: F.percentile_approx(clean[n], min(max(q, 0.0), 1.0), round(1 / OFF)).cast("double")
    lo = lambda n, q: F.lit(float("-inf")) if q <= OFF * 2 else edge(n, q - 2 * OFF)
    hi = lambda n, q: F.lit(float("inf")) if q >= 1 - OFF * 2 else edge(n, q + 2 * OFF)
    bounds = df.groupBy(*(F.col(k).alias(a) for k, a in zip(keys, names, strict=True))).agg(*(F.struct(F.count(clean[n]).alias("n"), lo(n, q).alias("lo"), hi(n, q).alias("hi")).alias(f"_b_{n}") for n, (_, q) in wanted.items()))
    found = bounds.limit(FEW_GROUPS + 1).collect()
    if len(found) > FEW_GROUPS:
        return bounds  # so many groups that none of them needs a narrower search to fit a task
    spark, schema = df.sparkSession, bounds.schema
    inside = [max((r[f"_b_{n}"]["n"] for r in found), default=0) * 4 * OFF for n in wanted]
    while max(inside, default=0) > RANKED:
        near = F.broadcast(spark.createDataFrame(found, schema))  # FEW_GROUPS rows at most
        between = {n: F.when((clean[n] >= F.col(f"_b_{n}.lo")) & (clean[n] <= F.col(f"_b_{n}.hi")), clean[n]) for n in wanted}
        grid = [k / STEPS for k in range(STEPS + 1)]
        got = df.join(near, _same(keys)).groupBy(*names).agg(*(F.struct(F.count_if(clean[n] < F.col(f"_b_{n}.lo")).alias("u"), F.count(between[n]).alias("m"), F.percentile_approx(between[n], grid, round(1 / OFF)).cast("array<double>").alias("at")).alias(n) for n in wanted)).collect()
        seen = {tuple(r[a] for a in names): r for r in got}
        narrowed = []
        for r in found:
            row, own = r.asDict(), seen.get(tuple(r[a] for a in names))
            for n, (_, q) in wanted.items():
                b, s = r[f"_b_{n}"], own and own[n]
                if s and s["m"] > RANKED:
                    p = (q * (b["n"] - 1) - s["u"]) / s["m"]
                    k, j = int((p - 2 * OFF) * STEPS), int((p + 2 * OFF) * STEPS) + 2
                    row[f"_b_{n}"] = (b["n"], s["at"][k] if k > 0 else b["lo"], s["at"][j] if j < STEPS else b["hi"])
            narrowed.append(tuple(row[c] for c in schema.names))
        before, found = found, narrowed
        if [tuple(map(tuple, (r[f"_b_{n}"] for n in wanted))) for r in before] == [tuple(map(tuple, r[len(names) :])) for r in found]:
            break  # what is left are repetitions of one value, which are counted before they are ranked
        found = spark.createDataFrame(found, schema).collect()
        inside = [x * 2 / STEPS for x in inside]
    return F.broadcast(spark.createDataFrame(found, schema))  # FEW_GROUPS rows at most


def _same(keys: list[str]) -> Column:
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return same


def exact_percentiles(df: DataFrame, keys: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """A3 for groups of any size: (keys, a column for each of wanted: name -> (column, q)), exact and linear between ranks, null without values. Two reads of the rows.

    An exact percentile keeps a group's values in one buffer. Here the first read brackets each rank by an approximate percentile (its error is at most OFF of the rows); the second counts what is below the bracket, and the values inside, a few in ten thousand, each with its number. Only these are ranked.
    """
    clean = {n: F.when(~F.isnan(c), F.col(c)) for n, (c, _) in wanted.items()}
    bounds = _brackets(df, keys, clean, wanted)
    both = df.join(bounds, _same(keys))
    # each value is its own, or one of all below or above the bracket, of which the nearest is kept
    part = lambda n: F.when(clean[n] < F.col(f"_b_{n}.lo"), -1).when(clean[n] > F.col(f"_b_{n}.hi"), 1).otherwise(0)
    told = F.array(*(F.struct(F.lit(n).alias("_name"), part(n).alias("_part"), F.when(part(n) == 0, clean[n].cast("double")).alias("_v"), clean[n].cast("double").alias("_w"), F.lit(float(q)).alias("_q")) for n, (_, q) in wanted.items()))
    counted = both.select(*keys, F.explode(told).alias("_x")).select(*keys, "_x.*").where("_w is not null").groupBy(*keys, "_name", "_part", "_v").agg(F.count(F.lit(1)).alias("_c"), F.min("_w").alias("_low"), F.max("_w").alias("_high"), F.first("_q").alias("_q"))
    per = Window.partitionBy(*keys, "_name")
    rank = F.col("_q") * (F.sum("_c").over(per) - 1)
    upto = counted.withColumn("_r", rank).withColumn("_upto", F.sum("_c").over(per.orderBy("_part", "_v")))
    # a rank may fall one short of the bracket, or one beyond: the nearest value outside stands there
    held = F.when(F.col("_part") < 0, F.col("_high")).otherwise(F.col("_low"))
    at = lambda r: F.min(F.when(F.col("_upto") > r, F.struct("_part", held.alias("v"))))["v"]
    got = upto.groupBy(*keys, "_name").agg(at(F.floor("_r")).alias("_a"), at(F.ceil("_r")).alias("_b"), F.max(F.col("_r") - F.floor("_r")).alias("_f"))
    wide = got.groupBy(*keys).agg(*(F.max(F.when(F.col("_name") == n, F.col("_a") + F.col("_f") * (F.col("_b") - F.col("_a")))).alias(n) for n in wanted))
    every = bounds.select(*(f"_k{i}" for i in range(len(keys))))
    return every.join(wide, _same(keys), "left").select(*(F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)), *wanted)


def share(flag: Column) -> Column:
    """Percent of rows with the flag; null without rows."""
    return F.when(F.count(F.lit(1)) > 0, 100.0 * F.count_if(flag) / F.count(F.lit(1)))


def proportion(df: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """A1: k, n, p and the 95 % interval for each group."""
    g = df.groupBy(*keys).agg(F.count_if(flag).alias("k"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, "k", "n", *(c.alias(a) for a, c in wilson(F.col("k"), F.col("n")).items()))


def zone_rates(df: DataFrame, zone: str, kind: str, flag: Column) -> DataFrame:
    """A5: rates for each zone and for each zone_kind, in one pass: a row counts in both."""
    both = df.withColumn("zona", F.explode(F.array(F.col(zone), F.concat_ws("_", zone, kind))))
    return proportion(both, ["zona"], flag)


def target_summary(df: DataFrame, keys: list[str], frames: str, hit: str, series_hit: str, chosen: str, error: str, *medians: str) -> DataFrame:
    """A4: trials with frames only: counts, shares, error and medians of the other measures. Groups may be of any size."""
    seen = df.where(F.col(frames) > 0)
    shares = seen.groupBy(*keys).agg(F.count(F.lit(1)).alias("intentos"), share(F.col(hit)).alias("acierto_pct"), share(F.col(series_hit)).alias("acierto_serie_pct"), share(F.col(chosen).isNull()).alias("sin_seleccion_pct"))
    mids = exact_percentiles(seen, keys, {"error_mediana": (error, 0.5), "error_p90": (error, 0.9)} | {f"{m}_mediana": (m, 0.5) for m in medians})
    mids = mids.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    return shares.join(mids, same, "left").drop(*(f"_{k}" for k in keys))


def bias(df: DataFrame, keys: list[str], dx: str, dy: str) -> DataFrame:
    """Mean offset and its length."""
    return df.groupBy(*keys).agg(F.avg(dx).alias("dx"), F.avg(dy).alias("dy")).withColumn("modulo", F.hypot("dx", "dy"))


def jitter(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Root of the trace of the sample covariance; null below 3 rows."""
    return df.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= 3, F.sqrt(F.var_samp(x) + F.var_samp(y))).alias("jitter"))


def winner(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """The most frequent value of each group, null included; ties go to the one seen first. Partial counts before the shuffle."""
    votes = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("votos"), F.min(F.struct(*order)).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("votos"), "_first")
    return votes.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_first")


def confusions(df: DataFrame, keys: list[str], target: str, chosen: str, order: list[str], most: int = 15) -> DataFrame:
    """The most frequent pairs of target and choice of each group, first seen first among equals."""
    pairs = df.where(~F.col(target).eqNullSafe(F.col(chosen))).groupBy(*dict.fromkeys([*keys, target, chosen])).agg(F.count(F.lit(1)).alias("veces"), F.min(F.struct(*order)).alias("_first"))
    w = Window.partitionBy(*keys).orderBy(F.desc("veces"), "_first")
    return pairs.withColumn("puesto", F.row_number().over(w)).where(F.col("puesto") <= most).drop("_first")


def edges(df: DataFrame, keys: list[str], flag: Column, order: list[str], seconds: Column) -> DataFrame:
    """A10: rises and falls of a flag per minute. seconds: an aggregate that gives the group's duration."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = df.withColumn("_on", flag).withColumn("_was", F.coalesce(F.lag("_on").over(w), F.lit(False)))
    g = seen.groupBy(*keys).agg(F.count_if(F.col("_on") & ~F.col("_was")).alias("subidas"), F.count_if(~F.col("_on") & F.col("_was")).alias("bajadas"), seconds.alias("_s"))
    minutes = F.greatest(F.lit(1e-6), F.col("_s") / 60)
    return g.select(*keys, "subidas", "bajadas", (F.col("subidas") / minutes).alias("subidas_min"), (F.col("bajadas") / minutes).alias("bajadas_min"))


def changes(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """How often a value differs from the one before, nulls being values."""
    w = Window.partitionBy(*keys).orderBy(*order)
    seen = df.withColumn("_n", F.row_number().over(w)).withColumn("_was", F.lag(value).over(w))
    return seen.groupBy(*keys).agg(F.count_if((F.col("_n") > 1) & ~F.col(value).eqNullSafe(F.col("_was"))).alias("cambios"))


def first_hit(df: DataFrame, keys: list[str], flag: Column, t: str) -> DataFrame:
    """The least time with the flag."""
    return df.groupBy(*keys).agg(F.min(F.when(flag, F.col(t))).alias("t_primero"))


def attempt_summary(df: DataFrame, session: list[str], condition: str, read: Column, t: str, ms: str, variant: str, resolution: str) -> DataFrame:
    """One row for each condition, and one for all of a session (condition null) with the pooled rate but the median of the conditions' first times."""
    base = df.withColumn("_read", read)
    per = base.groupBy(*session, condition).agg(
        F.count(F.lit(1)).alias("intentos"), F.count_if("_read").alias("lecturas"), F.min(F.when(F.col("_read"), F.col(t))).alias("t_primera"), med(ms).alias("ms_mediana"), pct(ms, 0.95).alias("ms_p95"),
        F.count_distinct(variant).alias("variantes"), F.max_by(resolution, t).alias("resolucion"),
    )
    whole = base.groupBy(*session).agg(F.count(F.lit(1)).alias("intentos"), F.count_if("_read").alias("lecturas"), med(ms).alias("ms_mediana"), pct(ms, 0.95).alias("ms_p95"), F.count_distinct(variant).alias("variantes"), F.max_by(resolution, t).alias("resolucion"))
    first = per.groupBy(*session).agg(F.median("t_primera").alias("t_primera"))
    out = per.unionByName(whole.join(first, session).withColumn(condition, F.lit(None).cast("string")))
    return out.select(*session, condition, "intentos", "lecturas", *(c.alias(a) for a, c in wilson(F.col("lecturas"), F.col("intentos")).items()), "t_primera", "ms_mediana", "ms_p95", "variantes", "resolucion")


def tracking_summary(df: DataFrame, keys: list[str], seen: Column, ms: str, t: str, ratio: str, inside: Column) -> DataFrame:
    """Detection share, frames per second, latency (a frame's time plus p95), ratio percentiles, share inside."""
    fps = F.when(F.max(t) > F.min(t), (F.count(F.lit(1)) - 1) / (F.max(t) - F.min(t)))
    g = df.groupBy(*keys).agg(share(seen).alias("deteccion_pct"), fps.alias("fps"), med(ms).alias("ms_mediana"), pct(ms, 0.95).alias("ms_p95"), *(pct(ratio, q / 100).alias(f"ratio_p{q}") for q in (10, 50, 90)), share(inside).alias("dentro_pct"))
    return g.withColumn("latencia_ms", 1000 / F.col("fps") + F.col("ms_p95"))


def detection_summary(df: DataFrame, keys: list[str], ok: Column, sure: Column, turn: str) -> DataFrame:
    """Success and confidence shares, median of the absolute rotation."""
    return df.groupBy(*keys).agg(share(ok).alias("exito_pct"), share(sure).alias("alta_pct"), med(F.abs(F.col(turn))).alias("rotacion_mediana"))


def listed_counts(df: DataFrame, keys: list[str], values: str) -> DataFrame:
    """How often each member of an array occurs."""
    return df.select(*keys, F.explode(values).alias("valor")).groupBy(*keys, "valor").agg(F.count(F.lit(1)).alias("veces"))


def two_level_spread(df: DataFrame, outer: list[str], inner: str, x: str, y: str) -> DataFrame:
    """Spread within each repetition (its largest), and of the repetitions' medians around each other."""
    rep = df.groupBy(*outer, inner).agg(F.hypot(F.stddev_pop(x), F.stddev_pop(y)).alias("s"), F.median(x).alias("mx"), F.median(y).alias("my"))
    mid = rep.withColumn("ax", F.avg("mx").over(Window.partitionBy(*outer))).withColumn("ay", F.avg("my").over(Window.partitionBy(*outer)))
    return mid.groupBy(*outer).agg(F.max("s").alias("dentro"), F.hypot(F.stddev_pop("mx"), F.stddev_pop("my")).alias("entre"), F.max(F.hypot(F.col("mx") - F.col("ax"), F.col("my") - F.col("ay"))).alias("desvio_max"))


def residuals(df: DataFrame, keys: list[str], px: Column, py: Column, x: str, y: str) -> DataFrame:
    """Distances between predicted and marked points: median, largest, root mean square."""
    e = F.hypot(px - F.col(x), py - F.col(y))
    return df.groupBy(*keys).agg(F.median(e).alias("mediana"), F.max(e).alias("maximo"), F.sqrt(F.avg(e * e)).alias("rms"))


def counts_by_type(df: DataFrame, keys: list[str], kind: str, kinds: list[str]) -> DataFrame:
    """A column for each kind."""
    return df.groupBy(*keys).pivot(kind, kinds).agg(F.count(F.lit(1))).na.fill(0)


def box_or_fallback(df: DataFrame, keys: list[str], first: Column, x: str, y: str) -> DataFrame:
    """The box of the preferred rows, else of all."""
    any_first = F.max(first.cast("int")) == 1
    box = lambda f, c: F.when(any_first, f(F.when(first, F.col(c)))).otherwise(f(F.col(c)))
    return df.groupBy(*keys).agg(box(F.min, x).alias("x0"), box(F.min, y).alias("y0"), box(F.max, x).alias("x1"), box(F.max, y).alias("y1"))


def task_score(df: DataFrame, keys: list[str], grade: str, seconds: str, done: Column) -> DataFrame:
    """Finished tasks score 1, 0.5 or 0; median time."""
    points = F.when(F.col(grade) == "bien", 1.0).when(F.col(grade) == "parcial", 0.5).otherwise(0.0)
    return df.where(done).groupBy(*keys).agg((100 * F.avg(points)).alias("acierto_pct"), med(seconds).alias("tiempo_mediana"))


def sus_score(df: DataFrame, keys: list[str], item: str, answer: str) -> DataFrame:
    """Only groups with 10 answers."""
    part = F.when(F.col(item) % 2 == 1, F.col(answer) - 1).otherwise(5 - F.col(answer))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), (2.5 * F.sum(part)).alias("sus")).where("_n = 10").drop("_n")


def judged(metrics: DataFrame, criteria: DataFrame) -> DataFrame:
    """Metrics (metric, value) against criteria (metric, grp, op, lo, hi): si, no, or null where either is missing."""
    v, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    ok = F.when(F.col("op") == ">=", v >= lo).when(F.col("op") == "<=", v <= hi).when(F.col("op") == "=", v == lo).when(F.col("op") == "between", v.between(lo, hi))
    return metrics.join(criteria, "metric", "left").withColumn("cumple", F.when(ok, "si").when(~ok, "no"))


def met_by_group(df: DataFrame, group: str) -> DataFrame:
    """Criteria met and measured, and their percent."""
    g = df.groupBy(group).agg(F.count_if(F.col("cumple") == "si").alias("cumplidos"), F.count("cumple").alias("medidos"))
    return g.withColumn("pct", F.when(F.col("medidos") > 0, 100.0 * F.col("cumplidos") / F.col("medidos")))


def extremes(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Highest and lowest y with their x, the first in order of x among equals."""
    return df.groupBy(*keys).agg(F.max(y).alias("y_max"), F.min_by(x, F.struct(-F.col(y), F.col(x))).alias("x_max"), F.min(y).alias("y_min"), F.min_by(x, F.struct(y, x)).alias("x_min"))


def highlights(df: DataFrame, keys: list[str], label: str, value: str, order: list[str], few: int = 12) -> DataFrame:
    """Each value where there are few, and the highest and lowest label."""
    o = F.struct(*order)
    items = F.array_sort(F.collect_list(F.struct(o.alias("o"), F.col(label).alias("l"), F.col(value).alias("v"))))
    least = F.struct(F.col(value), o)
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min_by(label, F.struct(-F.col(value), o)).alias("mayor"), F.min_by(label, least).alias("menor"))
    small = df.join(g.where(F.col("n") <= few).select(*keys), keys, "left_semi").groupBy(*keys).agg(F.array_join(F.transform(items, lambda x: x["l"].cast("string")), ", ").alias("todos"))
    return g.join(small, keys, "left")


def weighted_mode(df: DataFrame, keys: list[str], value: str, weight: Column) -> DataFrame:
    """The value that carries most weight, the least among equals."""
    g = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    return g.groupBy(*keys).agg(F.min_by(value, F.struct(-F.col("_w"), F.col(value))).alias("moda"))


def first_of_hash(df: DataFrame, keys: list[str], content: str, order: list[str]) -> DataFrame:
    """The first row of each content hash in its group."""
    w = Window.partitionBy(*keys, F.md5(F.col(content))).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def next_number(df: DataFrame, label: str) -> DataFrame:
    """One more than the largest leading whole number."""
    return df.agg((1 + F.coalesce(F.max(F.split_part(F.col(label), F.lit("."), F.lit(1)).try_cast("int")), F.lit(0))).alias("siguiente"))


def circular_peaks(df: DataFrame, keys: list[str], bin_: str, bins: int, top: int = 3, apart: int = 12, floor: float = 0.06) -> DataFrame:
    """Peaks of a histogram that wraps around, smoothed by 1-2-3-2-1: a fold over a group's bins, highest first, that takes a bin if none taken is within apart of it. A group is one row of bins entries at most."""
    counts = df.groupBy(*keys, bin_).agg(F.count(F.lit(1)).alias("_n"))
    around = F.explode(F.array(*(F.struct(F.lit(s).alias("s"), F.lit(3 - abs(s)).alias("w")) for s in range(-2, 3)))).alias("_x")
    smooth = counts.select(*keys, bin_, "_n", around).groupBy(*keys, F.pmod(F.col(bin_) + F.col("_x.s"), F.lit(bins)).cast("int").alias("pico")).agg(F.sum(F.col("_n") * F.col("_x.w")).cast("double").alias("altura"))
    rows = smooth.groupBy(*keys).agg(F.sum("altura").alias("_all"), F.array_sort(F.collect_list(F.struct((-F.col("altura")).alias("less"), "pico"))).alias("_bins"))
    high = F.filter("_bins", lambda b: -b["less"] >= floor * F.col("_all"))
    far = lambda a, b: F.least(F.pmod(a - b, F.lit(bins)), F.pmod(b - a, F.lit(bins))) > apart
    nothing = F.array().cast("array<struct<less:double,pico:int>>")
    taken = F.aggregate(high, nothing, lambda acc, b: F.when((F.size(acc) < top) & F.forall(acc, lambda k: far(k["pico"], b["pico"])), F.array_append(acc, b)).otherwise(acc))
    return rows.select(*keys, F.posexplode(taken).alias("_i", "_b")).select(*keys, (F.col("_i") + 1).alias("puesto"), F.col("_b.pico").alias("pico"), (-F.col("_b.less")).alias("altura"))


def profile(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Mean y of each x."""
    return df.groupBy(*keys, x).agg(F.avg(y).alias("y_media"))


def neighbourhood_mode(df: DataFrame, keys: list[str], value: str, tol: float) -> DataFrame:
    """The value with most others within tol, the least among equals. Equal values are counted once before they meet their neighbours' buckets."""
    c = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    cell = F.floor(F.col(value) / tol)
    near = c.select(*keys, F.col(value).alias("_v"), F.col("n").alias("_n"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("_cell"))
    j = c.withColumn("_cell", cell).join(near, [*keys, "_cell"]).where(F.abs(F.col(value) - F.col("_v")) <= tol)
    g = j.groupBy(*keys, value).agg(F.sum("_n").alias("vecinos"))
    return g.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("vecinos"), value))).where("_k = 1").drop("_k")


def cheapest_good(df: DataFrame, keys: list[str], valid: Column, score: Column, cost: str, share_: float = 0.85) -> DataFrame:
    """Among valid options within share_ of the best score the one of least cost."""
    ok = df.where(valid).withColumn("_s", score).withColumn("_best", F.max("_s").over(Window.partitionBy(*keys)))
    near = ok.where(F.col("_s") >= share_ * F.col("_best"))
    return near.withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(cost, F.desc("_s")))).where("_k = 1").drop("_k", "_best", "_s")


def border_outside(df: DataFrame, keys: list[str], width: Column, height: Column, project, frame: tuple[float, float], points: int = 21) -> DataFrame:
    """Sides of which half or more lies outside the frame, else the worst; null if all is inside. project(x, y) gives frame coordinates."""
    f = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda k: k / (points - 1))).alias("_f")
    sides = {"arriba": (F.col("_f") * width, F.lit(0.0)), "abajo": (F.col("_f") * width, height), "izquierda": (F.lit(0.0), F.col("_f") * height), "derecha": (width, F.col("_f") * height)}
    rows = df.select("*", f)
    side = F.explode(F.array(*(F.struct(F.lit(n).alias("lado"), x.cast("double").alias("x"), y.cast("double").alias("y")) for n, (x, y) in sides.items()))).alias("_b")
    u, v = project(F.col("_b.x"), F.col("_b.y"))
    out = rows.select("*", side).withColumn("_out", ~(u.between(0, frame[0]) & v.between(0, frame[1])))
    g = out.groupBy(*keys, F.col("_b.lado").alias("lado")).agg(F.avg(F.col("_out").cast("double")).alias("fuera"))
    g = g.withColumn("_worst", F.max("fuera").over(Window.partitionBy(*keys)))
    return g.where((F.col("fuera") > 0) & ((F.col("fuera") >= 0.5) | ((F.col("_worst") < 0.5) & (F.col("fuera") == F.col("_worst"))))).drop("_worst")


def latest_session(df: DataFrame, keys: list[str], date: str, tie: str) -> DataFrame:
    """The last session of each test, with how many there were."""
    w = Window.partitionBy(*keys)
    return df.withColumn("sesiones", F.count(F.lit(1)).over(w)).withColumn("_k", F.row_number().over(w.orderBy(F.desc(date), F.desc(tie)))).where("_k = 1").drop("_k")


def baseline_comparison(df: DataFrame, keys: list[str], raw: str, stable: str, target: str, t: str, order: list[str]) -> DataFrame:
    """Under the raw and the stateful rule: share on target, share with any choice, changes per second."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.select("*", *(F.lag(c).over(w).alias(f"_{c}") for c in (raw, stable)), F.row_number().over(w).alias("_n"))
    seconds = F.max(t) - F.min(t)
    moved = lambda c: F.count_if((F.col("_n") > 1) & ~F.col(c).eqNullSafe(F.col(f"_{c}"))) / F.when(seconds > 0, seconds)
    return rows.groupBy(*keys).agg(*(x for c in (raw, stable) for x in (share(F.col(c) == F.col(target)).alias(f"{c}_objetivo_pct"), share(F.col(c).isNotNull()).alias(f"{c}_con_dato_pct"), moved(c).alias(f"{c}_cambios_s"))))


def finite_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: finite(F.col(c)) for c in columns})
