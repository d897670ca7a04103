"""F20 and F22 of round 3: each would have failed before its change."""

import datetime
from types import SimpleNamespace

from pyspark.sql import Row
from pyspark.sql import types as T

from lodestar.operators.matching import figures_or_panels
from lodestar.streaming.stateful import CHUNK, Reorder


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, x):
        self.held = x

    def clear(self):
        self.held = None


class Entries(list):
    get = list.copy
    appendList = list.extend

    def put(self, values):
        self[:] = values


def test_rows_wait_in_few_entries():
    """each row was an entry of its own, written and read by itself."""
    made, timers = {}, []
    handle = SimpleNamespace(getValueState=lambda n, s: made.setdefault(n, Value()), getListState=lambda n, s: made.setdefault(n, Entries()), registerTimer=timers.append, deleteTimer=timers.remove)
    schema = T.StructType().add("user", "long").add("n", "long").add("ts", "timestamp").add("seen", "timestamp").add("el", "string")
    at = lambda s: datetime.datetime(2024, 5, 1, 0, 0, s, 250)
    ms = lambda s: 1714521600000 + s * 1000 + 1
    rows = [Row(*schema.names)(1, k, at(k * 7 % 59), None if k % 3 else at(k % 59), None if k % 2 else "a") for k in range(2 * CHUNK + 5)]
    step = Reorder(schema, "ts", ["n"])
    step.init(handle)
    clock = lambda s: SimpleNamespace(getCurrentWatermarkInMs=lambda: ms(s))
    assert list(step.handleInputRows((1,), iter(rows), clock(1))) == []
    waiting = [r for r in rows if r.ts > at(1)]
    assert 0 < len(made["rows"]) <= 3 and timers == [ms(2)]

    plain = lambda found: [tuple(x.replace(tzinfo=None) if isinstance(x, datetime.datetime) else x for x in r) for r in found]
    want = sorted(map(tuple, waiting), key=lambda r: (r[2], r[1]))
    timers.clear()
    assert plain(step.handleExpiredTimer((1,), clock(30), None)) == [r for r in want if r[2] <= at(30)]
    assert timers == [ms(31)]
    assert plain(step.handleExpiredTimer((1,), clock(59), None)) == [r for r in want if r[2] > at(30)]
    assert made["rows"] == []


def test_panels_meet_figures_unsorted(spark):
    """a task sorted its share of both sides, put together from many shares."""
    figs = spark.createDataFrame([(k, 0, 0) for k in (1, 2, 3, None)], "fig bigint, panel int, parte int")
    panels = spark.createDataFrame([(1, 1, 5, True), (1, 2, 6, True), (1, 3, 7, False), (2, 1, 8, False), (9, 1, 9, True), (None, 1, 4, True), (3, 1, 2, None)], "fig bigint, panel int, parte int, util boolean")
    found = figures_or_panels(figs, panels, "fig", "util")
    assert {tuple(r) for r in found.collect()} == {(1, 1, 5), (1, 2, 6), (2, 0, 0), (3, 0, 0), (None, 0, 0)} and found.count() == 5
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") >= 2 and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
