"""Queries over the middle tables, where ids go beyond one chart: against their SQL, and plain versions."""

import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_oracles import TABLES, shown

from lodestar.bindings import QUERIES, SQL
from lodestar.bindings.spatial import elements
from lodestar.bindings import streams
from lodestar.bindings.streams import samples
from lodestar.functions import text as X
from lodestar.operators.matching import nearest_pairs
from lodestar.streaming.selection import Element, replay

MIDDLE = "/root/testdata/sf0.01"
LARGER = ["p1_header_key", "p25_order_label", "p26_hue_name", "j24_box_overlap", "j1_nearest_element", "j2_candidates", "j4_crossings", "j5_spaced_crossings", "a21_grid_coverage", "j6_point_radius", "j7_separation", "j8_near_flag", "j9_gaps", "a34_robust_line", "a35_scale_type", "a36_convert", "a38_circular_peaks", "w19_bar_groups", "t2_one_euro", "t3_pinch", "t4_debounce", "t8_limited_alerts"]


@pytest.fixture(scope="module")
def duck():
    if not Path(MIDDLE).exists():
        pytest.skip("no test data")
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{MIDDLE}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", LARGER)
def test_query_on_the_middle_tables(spark, duck, name):
    df = QUERIES[name](spark, MIDDLE)
    cols = sorted(df.columns)
    cur = duck.execute(SQL[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    assert shown(map(tuple, df.select(cols).collect())) == shown(tuple(r[names.index(c)] for c in cols) for r in cur.fetchall())


def plain_legible(t):
    import re

    t = (t or "").strip(" ")
    if not t:
        return False
    if len(t) <= 3 and " " not in t:
        return bool(re.fullmatch(r"[A-Za-z0-9]+|[Ͱ-Ͽἀ-῿]+", t))
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", t) if w]
    low, high = set("abcdefghijklmnopqrstuvwxyz" + X.MARKED), set("ABCDEFGHIJKLMNOPQRSTUVWXYZ" + X.MARKED.upper())
    bare = lambda w, ends: w[:-1] if w and w[-1] in ends else w

    def word(w):
        b, p = bare(w, X.STOPS), bare(w, X.ENDS)
        return len(b) > 1 and b[0] in low | high and set(b[1:]) <= low | set(X.INSIDE) or len(p) > 1 and set(p) <= high - {"Ü"}

    def number(w):
        p = bare(bare(w, X.ENDS), "%")
        p = p[1:] if p and p[0] in X.SIGNS else p
        digits = lambda x: x != "" and set(x) <= set("0123456789")
        tail = w.lstrip("0123456789")
        tail = tail[1:] if tail != w and tail[:1] == "%" else tail
        return all(map(digits, p.replace(",", ".").split("."))) or w[:1] in set("0123456789") and 1 <= len(tail) <= 4 and tail.isascii() and tail.isalpha()

    def unit(w):
        p = bare(w, X.ENDS)
        return p[:1] == "(" and p[-1:] == ")" and 1 <= len(p) - 2 <= 12 and not set(p[1:-1]) & set("() \t\n")

    def good(w):
        if len(w) == 1:
            return w.lower() in X.SINGLES and len(words) <= 6
        if w.isalpha() and not w.lower().replace(w.lower()[0], ""):
            return False
        return word(w) or number(w) or unit(w) or "-" in w and all(word(p) or number(p) for p in w.split("-") if p)

    n = len(words)
    return sum(map(good, words)) / n >= 0.75 and not (n >= 4 and Counter(words).most_common(1)[0][1] > int(n * 0.3 + 1e-9))


def test_legible_judges_the_whole_text(spark, tmp_path):
    start = " ".join(f"palabra{'abcdefghij'[k]}" for k in range(10)) + " "
    plain = " ".join(f"texto{a}{b}" for a in "abcdefghij" for b in "klmnopqrst") + " "
    texts = [None, "", "ab", "a b", start + plain, start * 2 + plain + "x9?! %% ## " * 200, plain + "eco " * 200, plain + "seis-siete (mm) 3,5% " * 20, plain * 40, "x " * 300 + plain * 9]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = dict(tuple(r) for r in QUERIES["x3_legible"](spark, str(tmp_path)).collect())
    assert got == {k: plain_legible(t) for k, t in enumerate(texts)}


def test_legible_on_the_given_texts(spark):
    if not Path(MIDDLE).exists():
        pytest.skip("no test data")
    texts = dict(tuple(r) for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "text").collect())
    got = dict(tuple(r) for r in QUERIES["x3_legible"](spark, MIDDLE).collect())
    assert got == {k: plain_legible(t) for k, t in texts.items()}


def middle():
    if not Path(MIDDLE).exists():
        pytest.skip("no test data")
    return MIDDLE


def test_spaced_crossings_of_all_parts(spark):
    found = sorted(QUERIES["j4_crossings"](spark, middle()).collect(), key=lambda r: (r["na"], r["nb"]))
    kept = defaultdict(list)
    for r in found:
        own = kept[r["chart"], *sorted((r["series_a"], r["series_b"]))]
        if all(math.hypot(r["x"] - k["x"], r["y"] - k["y"]) >= 3.0 for k in own):
            own.append(r)
    got = {(r["chart"], r["na"], r["nb"]) for r in QUERIES["j5_spaced_crossings"](spark, middle()).collect()}
    assert got == {(r["chart"], r["na"], r["nb"]) for own in kept.values() for r in own}
    assert max(na for _, na, _ in got) >= 1000


def test_perturbed_hits_all_parts(spark):
    part = spark.read.parquet(f"{middle()}/part.parquet")
    data = part.where("p_partkey % 4 <> 3").count()
    assert sum(r["n"] for r in QUERIES["a22_perturbed"](spark, middle()).collect()) == data * 3 * 20


def test_selection_among_all_parts(spark):
    by = defaultdict(dict)
    for r in elements(spark, middle()).orderBy("n").collect():
        by[r["chart"]][r["id"]] = Element(r["id"], r["series"], r["shape"], r["priority"], r["radius"], r["x1"], r["y1"], r["x2"], r["y2"])
    assert sum(map(len, by.values())) == spark.read.parquet(f"{middle()}/part.parquet").count()
    want = sorted(map(tuple, streams.shown(replay(samples(spark, middle()), dict(by))).collect()))
    for name in ("t5_selection", "t5_selection_stream"):
        assert sorted(map(tuple, QUERIES[name](spark, middle()).collect())) == want
    assert any(int(r[4][1:]) >= 1000 for r in want if r[4])


def test_repair_of_all_axes(spark):
    from lodestar.bindings.spatial import axis
    from lodestar.operators.calibration import repaired, robust_line

    a = axis(spark, middle()).withColumn("texto", F.col("v").cast("long").cast("string"))
    want = []
    for k in range(3):
        own = a.where(f"k % 3 = {k}")
        want += repaired(own, robust_line(own, ["k"], "n", "px", "v"), ["k"], "n", "px", "texto", "v").collect()
    got = sorted(map(tuple, QUERIES["a37_repair"](spark, middle()).collect()))
    assert got == sorted(map(tuple, want)) and any(r[0] % 3 for r in got)
    orders = spark.read.parquet(f"{middle()}/lineitem.parquet").select("l_orderkey").distinct().count()
    assert QUERIES["a35_scale_type"](spark, middle()).count() == orders


def plain_pairs(s, t, most):
    out, used_s, used_t = [], set(), set()
    for d, g, a, b in sorted((abs(x - y), g, a, b) for g, a, x in s for h, b, y in t if g == h and abs(x - y) < most):
        if (g, a) not in used_s and (g, b) not in used_t:
            used_s.add((g, a))
            used_t.add((g, b))
            out.append((g, a, b, d))
    return sorted(out)


def test_nearest_pairs_with_ties(spark):
    rng = random.Random(5)
    s = [(g, k, float(rng.randrange(40))) for g in range(6) for k in range(rng.randrange(1, 60))]
    t = [(g, k, float(rng.randrange(60))) for g in range(6) for k in range(rng.randrange(1, 60))]
    ss, tt = spark.createDataFrame(s, "g int, a long, x double"), spark.createDataFrame(t, "g int, b long, y double")
    assert sorted(map(tuple, nearest_pairs(ss, tt, ["g"], "a", "b", "x", "y", 9.0).collect())) == plain_pairs(s, t, 9.0)


def test_one_to_one_of_all_customers(spark):
    s = [(r[0] // 20, r[0], r[1]) for r in spark.read.parquet(f"{middle()}/supplier.parquet").select("s_suppkey", "s_acctbal").collect()]
    t = [(r[0] // 300, r[0], r[1]) for r in spark.read.parquet(f"{middle()}/customer.parquet").select("c_custkey", "c_acctbal").collect()]
    got = sorted(map(tuple, QUERIES["j19_one_to_one"](spark, middle()).collect()))
    assert got == sorted((a, b, round(d, 6)) for _, a, b, d in plain_pairs(s, t, 800.0)) and any(r[1] % 10 for r in got)


def test_united_boxes_of_all_parts(spark, tmp_path):
    # far apart in size, so that few are united; odd keys would be lost by a modulo
    rows = [(k, "b", 40 * k) for k in range(1, 12)]
    spark.createDataFrame(rows, "p_partkey bigint, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = sorted((r["x0"], r["y0"], r["x1"], r["y1"]) for r in QUERIES["j25_united_boxes"](spark, str(tmp_path)).collect())
    assert got == sorted((320.0 * k, 37.0 * k % 600, 320.0 * k + 120, 37.0 * k % 600 + 60) for k, _, _ in rows)


def test_labels_of_large_orders(spark, tmp_path):
    keys = [0, 7, 99_999, 100_000, 123_456_789]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    assert dict(tuple(r) for r in QUERIES["p25_order_label"](spark, str(tmp_path)).collect()) == {k: f"TV-{k:05d}" for k in keys}
