"""Findings of round 3: each would have failed before its change."""

import datetime
import math
import random

import pytest
from pyspark.sql import functions as F

from lodestar.bindings import QUERIES, SQL
from lodestar.functions.columns import parse_number
from lodestar.operators.matching import nearest_label
from lodestar.operators.series import segments
from lodestar.operators.spatial import grid_coverage, nearest_element, text_density, within_reach

ELEMENT = "chart int, n int, id string, series string, shape string, priority int, radius double, x1 double, y1 double, x2 double, y2 double"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_exploded_sides_are_no_broadcast(spark):
    """Spark takes an exploded side for as small as what it is made of."""
    e = spark.createDataFrame([(1, 1, "a", "s", "punto", 0, 3.5, 1.0, 1.0, None, None)], ELEMENT)
    p = spark.createDataFrame([(1, 1, 1.0, 1.0)], "chart int, pid int, px double, py double")
    assert "Broadcast" not in plan(within_reach(p, e, 8.0))


def met_exactly():
    """Places whose distance is the radius by the root of the squares' sum, and more by hypot."""
    rng = random.Random(1)
    while True:
        x, y = rng.randrange(1, 700) / 7, rng.randrange(1, 310) / 3.1
        if math.sqrt(x * x + y * y) < math.hypot(x, y):
            yield x, y


def test_distances_are_those_of_the_sql(spark):
    """A radius that is met exactly."""
    x, y = next(met_exactly())
    e = spark.createDataFrame([(1, 1, "a", "s", "punto", 0, math.sqrt(x * x + y * y), 0.0, 0.0, None, None)], ELEMENT)
    p = spark.createDataFrame([(1, 1, x, y)], "chart int, pid int, px double, py double")
    assert [r["id"] for r in within_reach(p, e, 8.0).collect()] == ["a"]
    assert [r["id"] for r in nearest_element(p, e, 8.0).collect()] == ["a"]
    e = e.withColumns({"x1": F.lit(2.0), "y1": F.lit(2.0), "radius": F.lit(0.5)})
    area = spark.createDataFrame([(1, 4.0, 4.0), (2, 4.0, 4.0)], "chart int, width double, height double")
    assert sorted((r["chart"], round(r["cubierta_pct"], 6)) for r in grid_coverage(area, e, 2.0, 8.0).collect()) == [(1, round(100 / 9, 6)), (2, 0.0)]


def test_logarithm_of_nothing(spark):
    """with a zero the group's range is infinite, and no step is a trend."""
    df = spark.createDataFrame([("a", k, v) for k, v in enumerate([1.0, 10.0, 0.0, 10.0])] + [("b", k, v) for k, v in enumerate([1.0, 10.0, 100.0])], "g string, x int, y double")
    got = {(r["g"], r["x1"]): r["tendencia"] for r in segments(df, ["g"], "x", "y", 0.01, True).collect()}
    assert got == {("a", 0): "estable", ("a", 1): "estable", ("a", 2): "estable", ("b", 0): "aumento", ("b", 1): "aumento"}


def test_decimal_comma_before_an_exponent(spark):
    """Spark writes doubles from ten million on with an exponent."""
    df = spark.createDataFrame([("1,2E7",), ("1.2E7",), ("1,234",), ("12,3E7",), ("1,0000002E7",)], "t string")
    assert [r[0] for r in df.select(parse_number(F.col("t"))).collect()] == [1.2e7, 1.2e7, 1234.0, 12.3e7, 10000002.0]


@pytest.mark.parametrize("name", ["t6_announcements_stream", "t7_crossing_once_stream", "t8_limited_alerts_stream"])
def test_the_last_millisecond_of_a_stream(spark, tmp_path, name):
    """the watermark is whole milliseconds, so it did not pass what lay in the last one. Each user's last row is an announcement and an alert."""
    import duckdb

    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s, microseconds=261702)
    rows = [(u * 10 + k, u, at(k), ("click", "view")[k], 60.0) for u in range(3) for k in range(2)]
    spark.createDataFrame(rows, "event_id bigint, user_id bigint, ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"create view events as select * replace (ts::timestamp as ts) from '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"select user_id, event_id from ({SQL[name]}) order by all").fetchall()
    assert sorted(map(tuple, QUERIES[name](spark, str(tmp_path)).select("user_id", "event_id").collect())) == want and len(want) >= 3


def test_density_without_pairs(spark):
    """boxes against words by sums of ranges, many at one place, borders included, a box without words."""
    rng = random.Random(2)
    boxes = [(g, k, x, y, x + rng.randrange(1, 9), y + rng.randrange(1, 9)) for g in "ab" for k in range(60) for x, y in [(float(rng.randrange(20)), float(rng.randrange(20)))]] + [("c", 0, 0.0, 0.0, 1.0, 1.0)]
    words = [(g, x, y, x + 2, y + 1) for g in "ab" for _ in range(300) for x, y in [(float(rng.randrange(25)), rng.randrange(50) / 2)]]
    got = text_density(spark.createDataFrame(boxes, "g string, bid int, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(words, "g string, wx0 double, wy0 double, wx1 double, wy1 double"), ["g"])
    want = {(g, k): sum(2.0 for h, a, b, c, d in words if h == g and x0 <= (a + c) / 2 <= x1 and y0 <= (b + d) / 2 <= y1) / ((x1 - x0) * (y1 - y0)) for g, k, x0, y0, x1, y1 in boxes}
    found = {(r["g"], r["bid"]): r["densidad"] for r in got.collect()}
    assert found.keys() == want.keys() and all(abs(found[k] - v) < 1e-9 for k, v in want.items())


def test_nearest_label_without_pairs(spark):
    """an as-of from either side; equal distances go to the least label, one too far to none."""
    rng = random.Random(3)
    groups, labels = [(g, k, rng.randrange(200) / 2) for g in "ab" for k in range(80)] + [("c", 0, 1.0), ("a", 99, None)], [(g, k, rng.randrange(60) * 2.0) for g in "ab" for k in range(40)]
    got = nearest_label(spark.createDataFrame(groups, "g string, gid int, gx double"), spark.createDataFrame(labels, "g string, lid int, lx double"), ["g"], "gid", 2.0)
    assert "Join" not in plan(got)
    want = {(g, k): min(((abs(x - y), n) for h, n, y in labels if x is not None and h == g and abs(x - y) <= 1.2), default=(0, None))[1] for g, k, x in groups}
    assert {(r["g"], r["gid"]): r["lid"] for r in got.collect()} == want


def test_small_files_are_written_by_many_tasks(spark, tmp_path):
    """F16: adaptive execution joined the tasks of few small rows, and one of them wrote every file."""
    from lodestar.sources.files import in_folders

    rows = spark.createDataFrame([(k, j, f"{k}-{j}") for k in range(40) for j in (1, 0)], "k int, j int, value string")
    in_folders(rows, "k", "j").text(str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("k=*/part-*"))
    assert len(files) == 40 and len({f.name.split("-")[1] for f in files}) > 1
    assert (tmp_path / "out" / "k=7").glob("part-*").__next__().read_text() == "7-0\n7-1\n"


def test_a_session_has_its_chart_in_one_row(spark):
    """the stream's initial state was a row for each session and element, read and written one by one."""
    from lodestar.streaming.stateful import charted

    fields = "chart int, n int, id string, series string, shape string, priority int, radius double, x1 double, y1 double, x2 double, y2 double"
    elements = spark.createDataFrame([(1, n, f"e{n}", "s", "punto", 0, 3.0, float(n), 0.0, None, None) for n in (10, 9, 8)], fields)
    got = charted(spark.createDataFrame([(7, 1), (8, 1), (8, 1), (9, 2)], "session bigint, chart bigint"), elements).collect()
    assert sorted((r.session, r.chart, r.id, r.x1, r.x2) for r in got) == [(s, 1, ["e8", "e9", "e10"], [8.0, 9.0, 10.0], [None] * 3) for s in (7, 8)]


def test_lines_of_few_labels_are_those_of_many(spark, monkeypatch):
    """small groups took a row for each pair of labels and each end of an interval, all of them sorted; now a list beside each label."""
    from lodestar.operators import calibration as K

    labels = [(g, n, float(n * 7 % 10), float((3 * (n * 7 % 10) + 5) if n * g % 4 else n * n * g % 50)) for g in range(12) for n in range(g % 7)] + [(None, n, float(n), float(n)) for n in range(3)] + [(20, n, 1.0, float(n)) for n in range(3)] + [(21, 1, 1.0, 5.0), (21, 2, 1.0, 5.0), (21, 3, 4.0, None), (21, 4, 3.0, 9.0)]
    df = spark.createDataFrame(labels, "k int, n int, px double, v double")
    found = []
    for few in (0, 100):
        monkeypatch.setattr(K, "FEW", few)
        found.append(sorted((r.k, round(r.m, 6), round(r.b, 3), None if r.r2 is None else round(r.r2, 6), r.used, r.total) for r in K.robust_line(df, ["k"], "n", "px", "v").collect()))
    assert found[0] == found[1] and {k for k, *_ in found[0]} == {2, 3, 4, 5, 6, 9, 10, 11, 21}


def test_a_caption_is_read_once(spark):
    """a caption's steps stood in one expression, each as many copies as the next one names it."""
    from lodestar.functions.text import is_caption
    from lodestar.operators.matching import cited_numbers

    df = spark.createDataFrame([("  Fig. 3 x; ver figs. 2-4 y figura 10",), ("ver Figura 1.2",), (None,)], "t string")
    found = df.select(is_caption(F.col("t")).alias("c"), cited_numbers(F.col("t")).alias("n"))
    assert [tuple(r) for r in found.collect()] == [(True, ["10", "2", "3", "4"]), (False, ["1.2"]), (False, None)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") <= 8 and plan.count("lower(") <= 8


def test_full_normalising_goes_by_slices(spark):
    """a whole batch was held as Python strings, given and made."""
    import unicodedata

    from lodestar.functions import text as X

    texts = [None if k % 50 == 7 else f"ﬁn ｆｕｌｌ {k} ①" for k in range(2 * X.SLICE + 50)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, t string").coalesce(1)
    got = df.select("k", X.fully_normalised("t").alias("n")).orderBy("k").collect()
    assert [r.n for r in got] == [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    assert df.where("false").select(X.fully_normalised("t")).collect() == []
