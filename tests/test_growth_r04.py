"""F1 and F2 of round 4: the tests of methods and of files read once would have failed before."""

import hashlib
import math
import re

from lodestar.operators.spatial import nearest_element, perturbed
from lodestar.sources import files as S

ELEMENTS = "chart long, n long, id string, series string, shape string, x1 double, y1 double, x2 double, y2 double, radius double, priority int"
POINTS = "chart long, id string, series string, zona string, x double, y double"


def method_sizes(df):
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen")
    return [int(size) for size in re.findall(r"maxMethodCodeSize:(\d+)", df._jdf.queryExecution().explainString(mode))]


def test_methods_that_the_jvm_compiles(spark):
    """the join's method had 16,885 bytes; the JVM interprets methods of more than 8,000."""
    e = spark.createDataFrame([(1, 1, "e1", "s", "punto", 5.0, 5.0, None, None, 3.5, 0)], ELEMENTS)
    t = spark.createDataFrame([(1, "e1", "s", "punto", 5.0, 5.0)], POINTS)
    touch = spark.createDataFrame([(1, 1, 5.0, 5.0)], "chart long, pid long, px double, py double")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for df in (perturbed(t, e, [1.0, 2.0], 3, 8.0), nearest_element(touch, e, 8.0)):
            sizes = method_sizes(df)
            assert sizes and max(sizes) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def nearest(px, py, e):
    _, _, _, _, shape, x1, y1, x2, y2, _, _ = e
    x2, y2 = x1 if x2 is None else x2, y1 if y2 is None else y2
    if shape == "rect":
        return math.hypot(max(min(x1, x2) - px, 0, px - max(x1, x2)), max(min(y1, y2) - py, 0, py - max(y1, y2)))
    dx, dy = x2 - x1, y2 - y1
    at = 0 if shape == "punto" or dx == dy == 0 else max(0, min(1, ((px - x1) * dx + (py - y1) * dy) / (dx * dx + dy * dy)))
    return math.hypot(x1 + at * dx - px, y1 + at * dy - py)


def winner(px, py, elements):
    data, rest = [], []
    for e in elements:
        d = nearest(px, py, e)
        if d <= e[9]:
            k = d - (3 if e[4] == "punto" else 0)
            data.append((k, e[10], e[1], e)) if e[10] < 10 else rest.append((d, e[10], e[1], e))
    data, rest = min(data, default=None), min(rest, default=None)
    return ((rest if data is None or (rest and rest[0] + 3 < data[0]) else data) or [None])[-1]


def test_perturbed_among_elements_of_all_lengths(spark):
    """Elements whose lengths need several grids, points without any element, two charts."""
    elements, targets = [], []
    for n in range(90):
        chart, shape, long = n % 2, ("punto", "segmento", "rect")[n % 3], (1, 40, 900)[n // 3 % 3]
        x, y = n * 37 % 60 * 1.0, n * 53 % 60 * 1.0
        x2, y2 = (None, None) if shape == "punto" else (x + long, y + (n % 7) - 3.0)
        elements.append((chart, n, f"e{n}", f"s{n % 4}", shape, x, y, x2, y2, 2.5, 10 if shape == "rect" else n % 2))
        if shape != "rect":
            targets.append((chart, f"e{n}", f"s{n % 4}", shape, x if x2 is None else (x + x2) / 2, y if y2 is None else (y + y2) / 2))
    targets.append((5, "lost", "s0", "punto", 1.0, 1.0))
    want = {}
    for chart, tid, series, zona, x, y in targets:
        own = [e for e in elements if e[0] == chart]
        for sigma in (1.0, 4.0):
            for k in range(1, 6):
                u = [(int(hashlib.md5(f"{chart}:{tid}:{sigma}:{k}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52 for i in (1, 2)]
                r, a = math.sqrt(-2 * math.log(u[0])) * sigma, 2 * math.pi * u[1]
                won = winner(x + r * math.cos(a), y + r * math.sin(a), own)
                c = want.setdefault((zona, sigma), [0, 0, 0])
                c[0] += 1
                c[1] += won is not None and won[2] == tid
                c[2] += won is not None and won[3] == series
    got = perturbed(spark.createDataFrame(targets, POINTS), spark.createDataFrame(elements, ELEMENTS), [1.0, 4.0], 5, 8.0).collect()
    assert {(r["zona"], r["sigma"]): (r["n"], round(r["exacto_pct"] * r["n"] / 100), round(r["serie_pct"] * r["n"] / 100)) for r in got} == {k: tuple(c) for k, c in want.items()}
    assert len(got) == 4 and 0 < want["segmento", 4.0][1] < want["segmento", 4.0][2] < want["segmento", 4.0][0]


def test_point_files_are_opened_once(spark, tmp_path):
    """points and charts opened each file for each step, and parsed a number anew at each use."""
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text("# Título: T\n\nMes;x;y;Value\n# nota\n" + f"a;1,5;{i};7\nb;;1;2\n")
    (tmp_path / "none.csv").write_text("# Título: sin datos\n")
    pts, charts = S.read_points(spark, str(tmp_path))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = charts.join(pts.groupBy("file").count(), "file")
        assert "Scan text" not in df._jdf.queryExecution().toString() and max(method_sizes(df)) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted((r["file"][-5:], r["n"], r["etiqueta"], r["x"], r["y"], r["valor"]) for r in pts.collect()) == [(f"{i}.csv", 4, "a", 1.5, float(i), 7.0) for i in range(3)]
    assert sorted((r["file"][-5:], r["titulo"], r["x0"], r["y1"]) for r in charts.collect()) == [(f"{i}.csv", "T", -8.5, i + 10.0) for i in range(3)]


def test_a_file_for_each_text(spark, tmp_path):
    texts = {k: f"# {k}\nx,y\n{k},1" for k in range(50)}
    S.write_texts(spark.createDataFrame(list(texts.items()), "k long, t string"), str(tmp_path / "out"), "k", "t")
    found = sorted(p.read_text() for p in (tmp_path / "out").rglob("*.txt"))
    assert found == sorted(t + "\n" for t in texts.values())
    assert len([p for p in (tmp_path / "out").iterdir() if p.is_dir()]) <= 4
