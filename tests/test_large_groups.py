"""Operators whose groups may be of any size, and rules with a past, against plain forms."""

import random

from pyspark.sql import functions as F

from lodestar.operators import rates
from lodestar.operators.calibration import robust_line
from lodestar.operators.matching import greedy_pairs, nearest_pairs, ordered_distinct, united_boxes
from lodestar.operators.rates import exact_percentiles
from lodestar.operators.spatial import in_levels, nearest_element, sticky_nearest, within_reach
from lodestar.streaming.consumer import consumed
from lodestar.streaming.selection import Chart, Config, Element, Selection


def test_exact_percentiles(spark):
    rng = random.Random(3)
    rows = [(g, rng.choice([None, float("nan"), 1.0, 2.5, rng.random()])) for g in "abcd" for _ in range({"a": 1, "b": 2, "c": 7, "d": 4000}[g])] + [(None, 3.0), (None, 4.0), ("e", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    qs = {f"p{k}": ("v", k / 100) for k in (0, 1, 10, 33, 50, 90, 99, 100)}
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], qs).collect()}
    clean = F.when(~F.isnan("v"), F.col("v"))
    for r in df.groupBy("g").agg(*(F.percentile(clean, F.lit(q)).alias(n) for n, (_, q) in qs.items())).collect():
        for n in qs:
            a, b = r[n], got[r["g"]][n]
            assert (a is None and b is None) or abs(a - b) < 1e-12, (r["g"], n)


def test_brackets_are_narrowed(spark, monkeypatch):
    monkeypatch.setattr(rates, "RANKED", 40)
    monkeypatch.setattr(rates, "OFF", 0.01)
    rng = random.Random(5)
    rows = [("a", rng.gauss(0, 1)) for _ in range(20_000)] + [("b", float(rng.randrange(3))) for _ in range(9_000)] + [("c", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    qs = {f"p{k}": ("v", k / 100) for k in (0, 10, 50, 99)}
    got = {r["g"]: r for r in exact_percentiles(df, ["g"], qs).collect()}
    for r in df.groupBy("g").agg(*(F.percentile("v", F.lit(q)).alias(n) for n, (_, q) in qs.items())).collect():
        assert all(abs(r[n] - got[r["g"]][n]) < 1e-9 for n in qs), (r, got[r["g"]])


def test_pairs_boxes_and_lines_by_rounds(spark):
    """Greedy pairs, united boxes and voted lines against loops over one large group."""
    rng = random.Random(6)
    lefts, rights = [(1, k, rng.randrange(300) / 2) for k in range(150)], [(1, k, rng.randrange(300) / 2) for k in range(170)]
    order = sorted((abs(x - y), a, b) for _, a, x in lefts for _, b, y in rights if abs(x - y) < 9)
    used, want = (set(), set()), []
    for d, a, b in order:
        if a not in used[0] and b not in used[1]:
            used[0].add(a)
            used[1].add(b)
            want.append((1, a, b, d))
    df = lambda rows, names: spark.createDataFrame(rows, names)
    assert sorted(map(tuple, nearest_pairs(df(lefts, "g int, a int, x double"), df(rights, "g int, b int, y double"), ["g"], "a", "b", "x", "y", 9.0).collect())) == sorted(want)
    candidates = df([(1, a, b, d) for d, a, b in order], "g int, a int, b int, d double")
    assert sorted(map(tuple, greedy_pairs(candidates, ["g"], "a", "b", ["d", "a", "b"]).collect())) == sorted(want)

    boxes = [(1, k, x, y, x + rng.uniform(1, 40), y + rng.uniform(1, 40)) for k in range(120) for x, y in [(rng.uniform(0, 1500), rng.uniform(0, 1500))]]
    left = [list(b[2:]) for b in boxes]
    near = lambda r, o: r[0] - 15 <= o[2] and o[0] - 15 <= r[2] and r[1] - 15 <= o[3] and o[1] - 15 <= r[3]
    while hit := next(((i, j) for i in range(len(left)) for j in range(i) if near(left[i], left[j])), None):
        a, b = left.pop(hit[0]), left.pop(hit[1])
        left.append([min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])])
    got = united_boxes(df(boxes, "g int, k int, x0 double, y0 double, x1 double, y1 double"), ["g"], "k").orderBy("n").collect()
    assert [tuple(r)[2:] for r in got] == [tuple(b) for b in sorted(left)] and [r["n"] for r in got] == list(range(len(got)))

    labels = [(g, k, float(k * 7 % 100), float(rng.choice([3 * (k * 7 % 100) + 5, rng.randrange(400)]))) for g in range(6) for k in range(g, 40)]
    line = {r["k"]: r for r in robust_line(df(labels, "k int, n int, px double, v double"), ["k"], "n", "px", "v").collect()}
    for g in range(6):
        own = [r[1:] for r in labels if r[0] == g]
        tol = 0.04 * (max(v for *_, v in own) - min(v for *_, v in own)) + 1e-12
        on = lambda m, b, own=own, tol=tol: sum(abs(m * p + b - v) <= tol for _, p, v in own)
        best = max((on(m, v1 - m * p1), -n1, -n2, m, v1 - m * p1) for n1, p1, v1 in own for n2, p2, v2 in own if n1 < n2 and p1 != p2 for m in [(v2 - v1) / (p2 - p1)])
        assert (line[g]["used"], line[g]["total"]) == (best[0], len(own))


def test_levels_lose_no_element(spark):
    """Elements from points to lines over the whole chart: equal results, four cells each at most."""
    rng = random.Random(11)
    rows = [(1, n, f"e{n}", "s", shape, 1, 2.0, x, y, *((None, None) if shape == "punto" else (x + rng.choice([1, 900]) * rng.uniform(-1, 1), y + rng.choice([1, 900]) * rng.uniform(-1, 1)))) for n in range(80) for shape, x, y in [(rng.choice(["punto", "rect", "segmento"]), rng.uniform(0, 1000), rng.uniform(0, 1000))]]
    e = spark.createDataFrame(rows, "chart int, n int, id string, series string, shape string, priority int, radius double, x1 double, y1 double, x2 double, y2 double")
    points = [(1, k, rng.uniform(0, 1000), rng.uniform(0, 1000)) for k in range(300)]
    got = within_reach(spark.createDataFrame(points, "chart int, pid int, px double, py double"), e, 8.0)
    own = [Element(r[2], r[3], r[4], r[5], *r[6:]) for r in rows]
    assert {(r["pid"], r["id"]) for r in got.collect()} == {(k, x.id) for _, k, px, py in points for x in own if x.distance(px, py) <= 2.0}
    low, high = lambda a, b: F.least(a, F.coalesce(b, a)), lambda a, b: F.greatest(a, F.coalesce(b, a))
    cells = in_levels(e, low("x1", "x2"), low("y1", "y2"), high("x1", "x2"), high("y1", "y2"), 8.0).groupBy("id").count()
    assert cells.count() == 80 and cells.agg(F.max("count")).first()[0] <= 4


def test_ordered_distinct_over_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(500), k) for k in range(3000)]
    got = sorted((r["primero"], r["v"], r["puesto"]) for r in ordered_distinct(spark.createDataFrame(rows, "v int, o bigint"), "v", "o", 16).collect())
    seen = list(dict.fromkeys(v for v, _ in rows))
    assert [(v, p) for _, v, p in got] == [(v, i + 1) for i, v in enumerate(seen)]


def elements(rng, n=60):
    out = []
    for k in range(n):
        x, y, shape = rng.uniform(0, 100), rng.uniform(0, 100), rng.choice(["punto", "rect", "segmento"])
        far = (None, None) if shape == "punto" else (x + rng.uniform(-20, 20), y + rng.uniform(-20, 20))
        out.append(Element(f"e{k}", f"s{k % 3}", shape, rng.choice([0, 1, 10]), rng.uniform(1, 6), x, y, *far))
    return out


def test_boxes_lose_no_element():
    rng = random.Random(7)
    chart = {e.id: e for e in elements(rng)}
    c, one, two = Config(), Selection(), Selection()
    for k in range(400):
        at = (rng.uniform(-5, 105), rng.uniform(-5, 105))
        hand = (at, (at[0] + rng.uniform(0, 60), at[1]))
        assert one.step(k / 15, *hand, 90.0, chart, c) == two.step(k / 15, *hand, 90.0, Chart(chart), c)


def test_without_a_past_sticky_is_nearest(spark):
    rng = random.Random(8)
    e = spark.createDataFrame([(1, n, x.id, x.series, x.shape, x.priority, x.radius, x.x1, x.y1, x.x2, x.y2) for n, x in enumerate(elements(rng))], "chart int, n int, id string, series string, shape string, priority int, radius double, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, k, rng.uniform(0, 100), rng.uniform(0, 100)) for k in range(300)], "chart int, pid int, px double, py double")
    nothing = p.withColumns({"current": F.lit(None).cast("string"), "follow": F.lit(None).cast("string")})
    assert sorted(map(str, sticky_nearest(nothing, e, 8.0).collect())) == sorted(map(str, nearest_element(p, e, 8.0).collect()))


def test_a_consumer_on_the_stream(spark, tmp_path):
    rng = random.Random(9)
    rows = [(s, k, k / 15, rng.choice(["a", "b", None])) for s in range(5) for k in range(60)]
    df = spark.createDataFrame(rows, "session bigint, n bigint, t double, value string")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = consumed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "held", {"change": 200})
    run = live.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, consumed(df, "held", {"change": 200}).collect()))
