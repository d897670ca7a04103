"""Running streams over several files, in and out of order, against their batch forms."""

import datetime
import math
import random
import time

import pytest
from pyspark.sql import functions as F

from lodestar.streaming import events as E
from lodestar.streaming import stateful as S
from lodestar.streaming.selection import Config, Element, limited_alerts, replay

SCHEMA = "user bigint, n bigint, ts timestamp, activo boolean, el string, x double, y double"
BEGIN = datetime.datetime(2024, 5, 1)


def at(seconds):
    return BEGIN + datetime.timedelta(seconds=seconds)


@pytest.fixture(scope="module")
def touches():
    """Five users, a row a second each for a minute and a half; user 4 is silent from second 30 to 60."""
    rng = random.Random(3)
    return [(k % 5, k, at(k // 5), rng.random() < 0.7, rng.choice(["a", "b", None]), float(rng.randrange(4)), 0.0) for k in range(450) if not (k % 5 == 4 and 30 <= k // 5 < 60)]


def files(spark, path, parts, schema=SCHEMA):
    for rows in parts:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


@pytest.fixture(scope="module")
def shuffled(spark, touches, tmp_path_factory):
    """Rows up to some twelve seconds late over six files, then one row an hour later, which moves the watermark past all."""
    path, rng = tmp_path_factory.mktemp("touches") / "in", random.Random(5)
    late = [r for _, r in sorted((k + rng.random() * 60, r) for k, r in enumerate(touches))]
    files(spark, path, [*(late[k : k + 75] for k in range(0, len(late), 75)), [(99, 9999, at(3600), False, None, 0.0, 0.0)]])
    return path


def run(spark, tmp_path, path, query, schema=SCHEMA, mark="30 seconds"):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    with S.rocksdb(spark):
        name = f"q{random.randrange(1 << 40)}"
        q = query(source.withWatermark("ts", mark) if mark else source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.table(name)


def in_time(rows):
    return S.in_time(rows, "user", "ts", ["n"])


def test_shuffled_files_give_what_sorted_ones_give(spark, tmp_path, touches, shuffled):
    got = [tuple(r) for r in run(spark, tmp_path, shuffled, in_time).collect()]
    for user in range(5):
        assert [r[1] for r in got if r[0] == user] == [r[1] for r in touches if r[0] == user]


@pytest.mark.parametrize("first", [False, True])
def test_announcements(spark, tmp_path, touches, shuffled, first):
    got = run(spark, tmp_path, shuffled, lambda s: S.announced(in_time(s), "user", "activo", "el", "ts", ["n"], 3_000_000, first))
    want = E.announcements(spark.createDataFrame(touches, SCHEMA), ["user"], F.col("activo"), "el", ["ts", "n"])
    if first:
        want = E.first_in_activation(want, ["user"], "activacion", ["el"], ["ts", "n"])
    assert sorted((r.user, r.n, r.activacion) for r in got.collect()) == sorted((r.user, r.n, r.activacion) for r in want.collect())


def test_limited_alerts(spark, tmp_path, touches, shuffled):
    got = run(spark, tmp_path, shuffled, lambda s: S.alerted(in_time(s), "user", "activo", "ts", ["n"], 1500, 7))
    batch = spark.createDataFrame([(r[0], (r[2] - BEGIN).total_seconds(), r[1], r[3]) for r in touches], "user bigint, t double, n bigint, activo boolean")
    want = limited_alerts(batch, "user", "t", "n", "activo", 1500, 7)
    assert sorted((r.user, r.n) for r in got.collect()) == sorted((r.user, r.n) for r in want.collect()) != []


def test_confirmed(spark, tmp_path, touches, shuffled):
    got = run(spark, tmp_path, shuffled, lambda s: S.confirmed(in_time(s), "user", "x", "y", "ts", ["n"], 1.0, 0.5, 60_000)).where("user < 99")
    want = E.confirmed(spark.createDataFrame(touches, SCHEMA), ["user"], "x", "y", F.lit(True), ["ts", "n"], 1.0, 0.5)
    assert sorted((r.user, r.n, r.aceptado) for r in got.collect()) == sorted((r.user, r.n, r.aceptado) for r in want.collect())


def test_silence_is_told_without_another_row(spark, tmp_path, touches, shuffled):
    got = run(spark, tmp_path, shuffled, lambda s: S.silent(in_time(s), "user", "ts", 20_000))
    want = E.inactivity(spark.createDataFrame(touches, SCHEMA), ["user"], "ts", "20 seconds")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert sum(r.user == 4 for r in got.collect()) == 2


def test_late_rows_are_dropped_and_state_ends(spark, tmp_path):
    """A row behind the watermark is not let in; after a silence the activations are counted anew."""
    row = lambda n, s, el="a": (1, n, at(s), True, el, 0.0, 0.0)
    path = tmp_path / "in"
    files(spark, path, [[row(1, 0), row(2, 1, "b")], [row(3, 500, "b")], [row(4, 2, "late")], [row(5, 501, "b"), row(6, 502)], [row(7, 9000)]])
    got = run(spark, tmp_path, path, lambda s: S.announced(in_time(s), "user", "activo", "el", "ts", ["n"], 60_000), mark="1 second")
    # row 3 says again what row 2 said, but the state had ended; row 7 waits for the watermark still
    assert sorted((r.n, r.el, r.activacion) for r in got.collect()) == [(1, "a", 1), (2, "b", 1), (3, "b", 1), (6, "a", 1)]


POINT, LINE, AXIS = Element("p", "s1", "punto", 0, 7, 10, 10), Element("c", "s2", "segmento", 1, 8, 0, 12, 40, 12), Element("e", "", "segmento", 10, 7, 0, 0, 100, 0)
SAMPLES = "session bigint, chart bigint, n bigint, t double, x double, y double, x2 double, y2 double, palm double, ts timestamp"


def samples_of(session, times):
    for n, t in enumerate(times):
        hand, x = n % 17 != 3, 10 + 8 * math.sin(n / 9 + session)
        yield session, 1, n, t, *((x, 11.0, x + 15, 11.0) if hand else (None,) * 4), 90.0, at(t)


@pytest.fixture(scope="module")
def chart(spark):
    fields = "chart bigint, n bigint, id string, series string, shape string, priority int, radius double, x1 double, y1 double, x2 double, y2 double"
    return spark.createDataFrame([(1, k, e.id, e.series, e.shape, e.priority, float(e.radius), float(e.x1), float(e.y1), *(None if v is None else float(v) for v in (e.x2, e.y2))) for k, e in enumerate((POINT, LINE, AXIS))], fields)


@pytest.mark.parametrize("ends", [{}, {"idle_ms": 100_000}])
def test_selection_stream_gives_the_replay(spark, tmp_path, chart, ends):
    rows = [r for s in (1, 2) for r in samples_of(s, [k / 15 for k in range(60)])]
    files(spark, tmp_path / "in", [[r for r in rows if r[2] // 20 == k] for k in range(3)], SAMPLES)
    sessions = spark.createDataFrame([(1, 1), (2, 1), (3, 1)], "session bigint, chart bigint")
    got = run(spark, tmp_path, tmp_path / "in", lambda s: S.selected(s, sessions, chart, **ends), SAMPLES, "1 second" if "idle_ms" in ends else None)
    want = replay(spark.createDataFrame(rows, SAMPLES).drop("ts"), {1: {e.id: e for e in (POINT, LINE, AXIS)}})
    key = lambda r: (r["session"], r["n"])
    assert [tuple(r) for r in sorted(got.collect(), key=key)] == [tuple(r) for r in sorted(want.collect(), key=key)]


def test_state_with_a_time_to_live(spark, tmp_path, chart):
    """By processing time a stream never says that it is through: it is stopped when all rows are there."""
    rows = list(samples_of(1, [k / 15 for k in range(30)]))
    files(spark, tmp_path / "in", [rows], SAMPLES)
    source = spark.readStream.schema(SAMPLES).parquet(str(tmp_path / "in"))
    with S.rocksdb(spark):
        found = S.selected(source, spark.createDataFrame([(1, 1)], "session bigint, chart bigint"), chart, ttl_ms=3_600_000)
        q = found.writeStream.format("memory").queryName("ttl").option("checkpointLocation", str(tmp_path / "state")).start()
    try:
        until = time.time() + 60
        while time.time() < until and spark.table("ttl").count() < len(rows):
            time.sleep(0.5)
    finally:
        q.stop()
    want = replay(spark.createDataFrame(rows, SAMPLES).drop("ts"), {1: {e.id: e for e in (POINT, LINE, AXIS)}})
    assert sorted(map(str, spark.table("ttl").collect())) == sorted(map(str, want.collect()))


def test_a_session_ends_by_its_timer(spark, tmp_path, chart):
    """Session 1 is silent until the watermark has passed it: it has no elements and no pinch when it comes back with open fingers, which a pinch would outlast."""
    early, late = list(samples_of(1, [k / 15 for k in range(30)])), [(1, 1, 100, 900.0, 10.0, 11.0, 45.0, 11.0, 90.0, at(900))]
    files(spark, tmp_path / "in", [early, [(2, 1, 1, 600.0, None, None, None, None, None, at(600))], late], SAMPLES)
    sessions = spark.createDataFrame([(1, 1), (2, 1)], "session bigint, chart bigint")
    got = run(spark, tmp_path, tmp_path / "in", lambda s: S.selected(s, sessions, chart, Config(hand_grace=10_000_000), idle_ms=60_000), SAMPLES, "1 second")
    mine = {r["n"]: r for r in got.collect() if r["session"] == 1}
    assert mine[29]["active"] and mine[29]["element"] in ("p", "c")
    assert not mine[100]["active"] and mine[100]["element"] is None and mine[100]["candidates"] == []
