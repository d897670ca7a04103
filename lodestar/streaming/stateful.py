"""Running streams with state of their own: reordering, selection, announcements, crossings, alerts, confirmation, inactivity.

Each is a StatefulProcessor for transformWithState: typed state in RocksDB, a session's (key's) rows in one task, timers of event time that fire when the watermark passes them, whether or not another row of the key comes. Operators are chained in append mode: `in_time` holds rows back until the watermark has passed them and lets them go in order, and what follows sees each key's rows in order of time whatever the files' order was. Released rows carry their event time on, so the next operator's watermark follows.

Rows are (key, n, t as a timestamp, ...). Rows that the watermark has passed before they come are dropped; a delay of the watermark as long as the disorder lets none go. State of a key that says nothing for `idle` ends by a timer; a row that comes after such a silence finds none, also where the timer has not fired yet because both came in one batch.
"""

from __future__ import annotations

import contextlib
import datetime
import math
import operator
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lodestar.streaming.selection import Chart, Config, Debounce, Element, OneEuro, Pinch, Selection

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = datetime.datetime(1970, 1, 1)
_AWARE = _EPOCH.replace(tzinfo=datetime.UTC)
#: Rows of a list state's entry at most.
CHUNK = 1000


@contextlib.contextmanager
def rocksdb(spark: SparkSession):
    """State of queries that start inside lies in RocksDB, which these operators need; the session's setting comes back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def _us(t: datetime.datetime) -> int:
    """Microseconds of a timestamp; without a zone it is UTC, as the session's zone should be."""
    d = (t.astimezone(datetime.UTC).replace(tzinfo=None) if t.tzinfo else t) - _EPOCH
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def _ms(t: datetime.datetime) -> int:
    """The first watermark, in milliseconds, that has passed a timestamp."""
    return -(-_us(t) // 1000)


class Timed(StatefulProcessor):
    """One timer for each key at most, moved as need be."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.due = handle.getValueState("due", "ms bigint")

    def wake(self, ms: int | None) -> None:
        old = self.due.get()[0] if self.due.exists() else None
        if old == ms:
            return
        if old is not None:
            self.handle.deleteTimer(old)
        if ms is None:
            self.due.clear()
        else:
            self.handle.registerTimer(ms)
            self.due.update((ms,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.due.clear()  # it has fired
        yield from self.timed(key, timerValues.getCurrentWatermarkInMs())

    def timed(self, key, watermark: int) -> Iterable[Row]:
        raise NotImplementedError

    def close(self) -> None:
        pass


# -- T13


class Reorder(Timed):
    """Rows wait in list state until the watermark has passed their time; then they go in order. An entry of the list holds what came of a key in one batch, up to CHUNK rows, as a list for each column: entries, not rows, are what passes between Python and the JVM one by one. Timestamps wait as microseconds."""

    def __init__(self, schema: T.StructType, time: str, order: list[str]):
        self.schema, self.time, self.order = schema, time, order

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.stamps = [k for k, f in enumerate(self.schema) if isinstance(f.dataType, T.TimestampType)]
        kinds = [T.LongType() if k in self.stamps else f.dataType for k, f in enumerate(self.schema)]
        self.rows = handle.getListState("rows", T.StructType([T.StructField(f"c{k}", T.ArrayType(t)) for k, t in enumerate(kinds)]))
        names = self.schema.fieldNames()
        self.at, self.row = names.index(self.time), Row(*names)
        self.by = operator.itemgetter(self.at, *(names.index(c) for c in self.order))

    def chunks(self, rows: list[tuple]) -> list[tuple]:
        return [tuple(map(list, zip(*rows[k : k + CHUNK], strict=True))) for k in range(0, len(rows), CHUNK)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        past, new = timerValues.getCurrentWatermarkInMs() * 1000, []
        for r in rows:
            r = list(r)
            for k in self.stamps:
                if r[k] is not None:
                    r[k] = _us(r[k])
            if r[self.at] > past:  # what the watermark has passed has gone
                new.append(r)
        if not new:
            return iter(())
        self.rows.appendList(self.chunks(new))
        first = -(-min(r[self.at] for r in new) // 1000)
        self.wake(min(first, self.due.get()[0]) if self.due.exists() else first)
        return iter(())

    def timed(self, key, watermark: int) -> Iterator[Row]:
        ready, waiting = [], []
        for chunk in self.rows.get():
            for r in zip(*chunk, strict=True):
                (ready if r[self.at] <= watermark * 1000 else waiting).append(r)
        if waiting:
            self.rows.put(self.chunks(waiting))
            self.wake(-(-min(r[self.at] for r in waiting) // 1000))
        else:
            self.rows.clear()
        for r in sorted(ready, key=self.by):
            r = list(r)
            for k in self.stamps:
                if r[k] is not None:
                    r[k] = _AWARE + datetime.timedelta(microseconds=r[k])
            yield self.row(*r)


def in_time(df: DataFrame, key: str, time: str, order: list[str]) -> DataFrame:
    """T13 on a stream: the rows of a watermarked stream, each key's in order of time and then of order. What it holds of a key is what the watermark's delay spans."""
    return df.groupBy(key).transformWithState(Reorder(T.StructType(df.schema.fields), time, order), df.schema, "append", "eventTime", eventTimeColumnName=time)


# -- T6, T7


class Announcer(Timed):
    """What is announced while active: an element that differs from the last one announced; a new activation begins afresh. first: only the first time in an activation that the element is announced."""

    def __init__(self, active: str, element: str, time: str, order: list[str], idle_ms: int, first: bool):
        self.active, self.element, self.time, self.order, self.idle, self.first = active, element, time, order, idle_ms, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.now = handle.getValueState("now", "active boolean, activation bigint, element string")
        self.said = handle.getMapState("said", "element string", "times bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        was, activation, last = self.now.get() if self.now.exists() else (False, 0, None)
        rows = sorted(rows, key=lambda r: (r[self.time], *(r[c] for c in self.order)))
        due = self.due.get()[0] if self.due.exists() else None
        for r in rows:
            if due is not None and _ms(r[self.time]) >= due:
                was, activation, last = False, 0, None
                self.said.clear()
            due = _ms(r[self.time]) + self.idle
            active, element = bool(r[self.active]), r[self.element]
            if active and not was:
                activation, last = activation + 1, None
                self.said.clear()
            was = active
            if not active or element is None or element == last:
                continue
            last = element
            times = self.said.getValue((element,))[0] + 1 if self.said.containsKey((element,)) else 1
            self.said.updateValue((element,), (times,))
            if times == 1 or not self.first:
                yield Row(**r.asDict(), activacion=activation)
        self.now.update((was, activation, last))
        self.wake(_ms(rows[-1][self.time]) + self.idle)

    def timed(self, key, watermark: int) -> Iterator[Row]:
        self.now.clear()
        self.said.clear()
        return iter(())


def announced(df: DataFrame, key: str, active: str, element: str, time: str, order: list[str], idle_ms: int, first: bool = False) -> DataFrame:
    """T6 on a stream; with first, T7: an element once in each activation. The activation is counted from the key's first row, or anew after a silence of idle_ms."""
    schema = T.StructType([*df.schema.fields, T.StructField("activacion", T.LongType())])
    return df.groupBy(key).transformWithState(Announcer(active, element, time, order, idle_ms, first), schema, "append", "eventTime", eventTimeColumnName=time)


# -- T8


class Alerter(Timed):
    """A flag that has held for hold_ms alerts, then at most once in every_s."""

    def __init__(self, key: str, flag: str, time: str, order: list[str], hold_ms: float, every_s: float):
        self.key, self.flag, self.time, self.order, self.hold, self.every = key, flag, time, order, hold_ms, every_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("state", "since double, sent double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        since, sent = self.state.get() if self.state.exists() else (None, None)
        for r in sorted(rows, key=lambda r: (r[self.time], *(r[c] for c in self.order))):
            t = _us(r[self.time]) / 1e6
            since = None if not r[self.flag] else t if since is None else since
            if since is not None and (t - since) * 1000 >= self.hold and (sent is None or t - sent >= self.every):
                sent = t
                yield r
        self.state.update((since, sent))
        # a raised flag waits; else nothing is told from a state whose last alert is too long ago
        self.wake(None if since is not None or sent is None else math.ceil((sent + self.every) * 1000))
        if since is None and sent is None:
            self.state.clear()

    def timed(self, key, watermark: int) -> Iterator[Row]:
        self.state.clear()
        return iter(())


def alerted(df: DataFrame, key: str, flag: str, time: str, order: list[str], hold_ms: float = 400, every_s: float = 5) -> DataFrame:
    """T8 on a stream: the rows at which an alert goes out."""
    return df.groupBy(key).transformWithState(Alerter(key, flag, time, order, hold_ms, every_s), df.schema, "append", "eventTime", eventTimeColumnName=time)


# -- T9


class Confirmer(Timed):
    """A move of more than far counts only when the next row agrees with it within near; so each row waits for the next of its key, or for idle_ms without one."""

    def __init__(self, schema: T.StructType, x: str, y: str, time: str, order: list[str], far: float, near: float, idle_ms: int):
        self.schema, self.x, self.y, self.time, self.order, self.far, self.near, self.idle = schema, x, y, time, order, far, near, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.last = handle.getValueState("last", T.StructType([*self.schema.fields, T.StructField("_moved", T.BooleanType())]))

    def judged(self, held: tuple, agrees: bool) -> Row:
        return Row(*self.schema.fieldNames(), "aceptado")(*held[:-1], not held[-1] or agrees)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        names = self.schema.fieldNames()
        ix, iy = names.index(self.x), names.index(self.y)
        held = tuple(self.last.get()) if self.last.exists() else None
        apart = lambda a, b: None if None in (a[ix], a[iy], b[ix], b[iy]) else math.hypot(a[ix] - b[ix], a[iy] - b[iy])
        at = names.index(self.time)
        for r in sorted(map(tuple, rows), key=lambda r: (r[at], *(r[names.index(c)] for c in self.order))):
            if held is not None and _ms(r[at]) >= _ms(held[at]) + self.idle:
                yield self.judged(held, False)
                held = None
            d = None if held is None else apart(held, r)
            if held is not None:
                yield self.judged(held, d is not None and d <= self.near)
            held = (*r, d is not None and d > self.far)
        self.last.update(held)
        self.wake(_ms(held[at]) + self.idle)

    def timed(self, key, watermark: int) -> Iterator[Row]:
        yield self.judged(tuple(self.last.get()), False)
        self.last.clear()


def confirmed(df: DataFrame, key: str, x: str, y: str, time: str, order: list[str], far: float = 3.0, near: float = 1.5, idle_ms: int = 1000) -> DataFrame:
    """T9 on a stream of sure detections. As a row waits for the next one, its own time is past when it goes out; nothing that needs a watermark can follow."""
    schema = T.StructType([*df.schema.fields, T.StructField("aceptado", T.BooleanType())])
    return df.groupBy(key).transformWithState(Confirmer(T.StructType(df.schema.fields), x, y, time, order, far, near, idle_ms), schema, "append", "eventTime")


# -- T10


class Silence(Timed):
    """A stretch of rows ends when nothing has come for gap_ms; its alert goes out when the watermark passes that, without another row of the key."""

    def __init__(self, key: str, time: str, gap_ms: int):
        self.key, self.time, self.gap = key, time, gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.stretch = handle.getValueState("stretch", "first_us bigint, last_us bigint, n bigint")

    def alert(self, key, stretch: tuple) -> Row:
        first, last, n = stretch
        at = lambda us: _EPOCH + datetime.timedelta(microseconds=us)
        return Row(self.key, "desde", "aviso", "n")(key[0], at(first), at(last + self.gap * 1000), n)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = tuple(self.stretch.get()) if self.stretch.exists() else None
        for us in sorted(_us(r[self.time]) for r in rows):
            if now is not None and us - now[1] >= self.gap * 1000:
                yield self.alert(key, now)
                now = None
            now = (us, us, 1) if now is None else (now[0], us, now[2] + 1)
        self.stretch.update(now)
        self.wake(-(-now[1] // 1000) + self.gap)

    def timed(self, key, watermark: int) -> Iterator[Row]:
        yield self.alert(key, tuple(self.stretch.get()))
        self.stretch.clear()


def silent(df: DataFrame, key: str, time: str, gap_ms: int) -> DataFrame:
    """T10 on a stream: (key, desde, aviso, n) of each stretch once it has ended. Rows of a key should be in order of time over batches: put in_time before where they are not."""
    schema = T.StructType([df.schema[key], T.StructField("desde", T.TimestampType()), T.StructField("aviso", T.TimestampType()), T.StructField("n", T.LongType())])
    return df.select(key, time).groupBy(key).transformWithState(Silence(key, time, gap_ms), schema, "append", "eventTime")


# -- T5

#: A chart's elements in order of n, column by column: one value of a few lists is read and written far faster than a row for each element.
_FIELDS = {"id": "string", "series": "string", "shape": "string", "priority": "int", "radius": "double", "x1": "double", "y1": "double", "x2": "double", "y2": "double"}
_ELEMENTS = ", ".join(f"{f} array<{t}>" for f, t in _FIELDS.items())
_STATE = "last double, series string, series_at double, pinch string, pinch_since double, pinch_seen double, stable string, run string, run_since double, filter_t double, x double, y double, vx double, vy double"
SELECTED = "session bigint, n bigint, t double, active boolean, element string, candidates array<string>"


def _packed(s: Selection) -> tuple:
    f, p, d = s.filter, s.pinch, s.choice
    return s.last, s.series, s.series_at, p.state, p.since, p.seen, d.stable, d.run, d.since, f.t, *f.at, *f.speed


def _unpacked(v: tuple, c: Config) -> Selection:
    last, series, series_at, state, since, seen, stable, run, run_since, t, x, y, vx, vy = v
    return Selection(OneEuro(c.min_hz, c.beta, t, (x, y), (vx, vy)), Pinch(state, since, seen), Debounce(stable, run, run_since), series, series_at, last)


class Selector(Timed):
    """T5: the state of a session is a row of typed columns, and its charts' elements, which it has from the initial state, a map by chart. Samples carry no elements. last, series_at and the like are seconds."""

    def __init__(self, config: Config, idle_ms: int | None, ttl_ms: int | None):
        self.config, self.idle, self.ttl = config, idle_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.state = handle.getValueState("selection", _STATE, self.ttl)
        self.elements = handle.getMapState("elements", "chart bigint", _ELEMENTS, self.ttl)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        e = initialState
        self.elements.updateValue((e.chart,), tuple(e[f] for f in _FIELDS))

    def charts(self, wanted: set[int]) -> dict[int, Chart]:
        held = {c: self.elements.getValue((c,)) if self.elements.containsKey((c,)) else () for c in wanted}
        return {c: Chart({e[0]: Element(*e) for e in zip(*own, strict=True)}) for c, own in held.items()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        rows = sorted(rows, key=lambda r: (r.t, r.n))
        new = lambda: Selection(OneEuro(self.config.min_hz, self.config.beta))
        s = _unpacked(tuple(self.state.get()), self.config) if self.state.exists() else new()
        charts = self.charts({r.chart for r in rows})
        both = lambda a, b: None if a is None or b is None else (a, b)
        due = self.due.get()[0] if self.due.exists() else None
        for r in rows:
            if due is not None and _ms(r.ts) >= due:
                self.elements.clear()
                s, charts = new(), self.charts({r.chart for r in rows})
            due = _ms(r.ts) + self.idle if self.idle and r.ts is not None else None
            got = s.step(r.t, both(r.x, r.y), both(r.x2, r.y2), r.palm, charts[r.chart], self.config)
            if got:
                yield Row("session", "n", "t", "active", "element", "candidates")(key[0], r.n, r.t, *got)
        self.state.update(_packed(s))
        if self.idle and rows[-1].ts is not None:
            self.wake(_ms(rows[-1].ts) + self.idle)

    def timed(self, key, watermark: int) -> Iterator[Row]:
        """The session is over: nothing of it stays."""
        self.state.clear()
        self.elements.clear()
        return iter(())


def charted(sessions: DataFrame, elements: DataFrame) -> DataFrame:
    """The initial state: one row for each session and chart, with the chart's elements as lists."""
    listed = elements.groupBy(F.col("chart").cast("bigint").alias("chart")).agg(F.array_sort(F.collect_list(F.struct(F.col("n").cast("bigint").alias("n"), *(F.col(f).cast(t).alias(f) for f, t in _FIELDS.items())))).alias("e"))
    return sessions.select("session", F.col("chart").cast("bigint").alias("chart")).distinct().join(listed, "chart").select("session", "chart", *(F.col(f"e.{f}").alias(f) for f in _FIELDS))


def selected(samples: DataFrame, sessions: DataFrame, elements: DataFrame, c: Config = Config(), idle_ms: int | None = None, ttl_ms: int | None = None) -> DataFrame:
    """T5 on a stream of samples (session, chart, n, t in seconds, x, y, x2, y2, palm). sessions: (session, chart) of those that may come; their charts' elements (chart, n, id, ...) are the initial state. idle_ms: a session ends when the watermark of `ts` has passed its last sample by that (event time); ttl_ms: or when its state has not been written for that long (processing time). The state store holds elements once for each session, until it ends."""
    if idle_ms and ttl_ms:
        raise ValueError("a session ends by event time or by processing time")
    rows = samples if "ts" in samples.columns else samples.withColumn("ts", F.lit(None).cast("timestamp"))
    mode = "eventTime" if idle_ms else "processingTime" if ttl_ms else "none"
    return rows.groupBy("session").transformWithState(Selector(c, idle_ms, ttl_ms), SELECTED, "append", mode, initialState=charted(sessions, elements).groupBy("session"))
