"""What a finger selects, frame by frame: one step function per session, used by the batch replay here and by the stream in stateful.py.

State lives in plain objects and depends on the samples' own times only, so a replay of a file gives what the stream gave. Samples that are not newer than the last one change nothing (T13).
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Config:
    """Lengths in millimetres, times in milliseconds unless the name says otherwise."""

    margin: float = 3.0
    bonus: float | None = 3.0
    hysteresis: float = 2.0
    follow_s: float = 1.5
    follow_margin: float = 3.0
    enter: float = 60
    change: float = 120
    leave: float = 150
    min_hz: float = 1.5
    beta: float = 0.05
    close_ratio: float = 0.28
    open_ratio: float = 0.36
    close_mm: float = 22.0
    open_mm: float = 28.0
    palm_low: float = 45.0
    palm_high: float = 160.0
    pinch_grace: float = 250
    hand_grace: float = 300
    rest_priority: int = 10


def length(dx: float, dy: float) -> float:
    """The root of the squares' sum, as SQL writes it; hypot rounds otherwise."""
    return math.sqrt(dx * dx + dy * dy)


@dataclass
class OneEuro:
    """Low-pass filter of a position whose cut-off grows with speed."""

    min_hz: float = 1.5
    beta: float = 0.05
    t: float | None = None
    at: tuple[float, float] = (0.0, 0.0)
    speed: tuple[float, float] = (0.0, 0.0)

    def step(self, t: float, x: float, y: float) -> tuple[float, float]:
        if self.t is None:
            self.t, self.at, self.speed = t, (x, y), (0.0, 0.0)
            return self.at
        dt = t - self.t
        if dt <= 0:
            return self.at
        weight = lambda hz: 1 / (1 + 1 / (2 * math.pi * hz * dt))
        w = weight(1.0)
        self.speed = tuple(w * (new - old) / dt + (1 - w) * v for new, old, v in zip((x, y), self.at, self.speed, strict=True))
        w = weight(self.min_hz + self.beta * length(*self.speed))
        self.at = tuple(w * new + (1 - w) * old for new, old in zip((x, y), self.at, strict=True))
        self.t = t
        return self.at


#: What each kind of sample makes of a pinch's state; what is not listed stays. A state that times out opens.
PINCH = {
    ("open", "tight"): "closed",
    ("closed", "slack"): "opening",
    ("closed", "lost"): "unseen",
    ("opening", "tight"): "closed",
    ("opening", "between"): "closed",
    ("opening", "lost"): "unseen",
    ("unseen", "tight"): "closed",
    ("unseen", "between"): "closed",
    ("unseen", "slack"): "opening",
}


@dataclass
class Pinch:
    """Closed below one threshold, open above a higher one that must hold for a while; a lost hand keeps it for a while."""

    state: str = "open"
    since: float = -math.inf
    seen: float = -math.inf

    def step(self, t: float, gap: float | None, palm: float | None, c: Config) -> bool:
        before, self.state = self.state, PINCH.get((self.state, self.kind(gap, palm, c)), self.state)
        if gap is not None:
            self.seen = t
        if self.state != before:
            self.since = t
        # an opening lasts from its first slack sample, a lost hand from the last sample that showed it
        begun, grace = (self.since, c.pinch_grace) if self.state == "opening" else (self.seen, c.hand_grace)
        if self.state in ("opening", "unseen") and (t - begun) * 1000 >= grace:
            self.state = "open"
        return self.state != "open"

    @staticmethod
    def kind(gap: float | None, palm: float | None, c: Config) -> str:
        """Where the gap lies, as a share of the palm, or in millimetres if the palm is unlikely."""
        if gap is None:
            return "lost"
        likely = palm is not None and c.palm_low <= palm <= c.palm_high
        tight, slack = (gap <= c.close_ratio * palm, gap >= c.open_ratio * palm) if likely else (gap <= c.close_mm, gap >= c.open_mm)
        return "tight" if tight else "slack" if slack else "between"


#: Which setting says how long a run of equal values must be before it counts, by whether there is something now and whether there will be.
PATIENCE = {(False, True): "enter", (True, True): "change", (True, False): "leave"}


@dataclass
class Debounce:
    """T4: what has been the same for long enough counts. run is the value of the last samples, since when its first one was."""

    stable: str | None = None
    run: str | None = None
    since: float = -math.inf

    def step(self, t: float, value: str | None, c: Config) -> str | None:
        if value != self.run:
            self.run, self.since = value, t
        kind = PATIENCE.get((self.stable is not None, value is not None))
        if kind and (t - self.since) * 1000 >= getattr(c, kind):
            self.stable = value
        return self.stable


@dataclass(frozen=True)
class Element:
    id: str
    series: str
    shape: str
    priority: int
    radius: float
    x1: float
    y1: float
    x2: float | None = None
    y2: float | None = None

    def distance(self, x: float, y: float) -> float:
        if self.shape == "punto" or self.x2 is None or self.y2 is None:
            return length(self.x1 - x, self.y1 - y)
        if self.shape == "rect":
            off = lambda p, a, b: max(min(a, b) - p, 0.0, p - max(a, b))
            return length(off(x, self.x1, self.x2), off(y, self.y1, self.y2))
        dx, dy = self.x2 - self.x1, self.y2 - self.y1
        size = dx * dx + dy * dy
        k = 0.0 if not size else max(0.0, min(1.0, ((x - self.x1) * dx + (y - self.y1) * dy) / size))
        return length(self.x1 + k * dx - x, self.y1 + k * dy - y)


class Chart(dict):
    """A chart's elements by id, in their order, and their boxes in arrays: what may be in reach of a point is found without measuring each."""

    @functools.cached_property
    def _boxes(self) -> tuple[list[Element], np.ndarray]:
        own = list(self.values())
        box = [(min(a, b) - e.radius, min(p, q) - e.radius, -max(a, b) - e.radius, -max(p, q) - e.radius) for e in own for a, b, p, q in ((e.x1, e.x1 if e.x2 is None else e.x2, e.y1, e.y1 if e.y2 is None else e.y2),)]
        return own, np.array(box).reshape(-1, 4).T

    def near(self, x: float, y: float, more: float) -> list[Element]:
        """Elements whose box, widened by their radius and more, holds the point."""
        own, box = self._boxes
        return [own[i] for i in np.flatnonzero((box <= np.array([[x], [y], [-x], [-y]]) + (more + 1e-6)).all(0))]


def under(x: float, y: float, elements: Iterable[Element], c: Config, current: str | None = None, series: str = "") -> tuple[str | None, list[str]]:
    """The element under a point, and all in reach. The current one reaches further and counts as nearer; the followed series is preferred unless another is nearer by more than its margin."""
    data, rest, own, reach = [], [], [], []
    for n, e in enumerate(elements):
        stick = c.hysteresis if e.id == current else 0.0
        d = e.distance(x, y)
        if d - stick > e.radius:
            continue
        reach.append(e.id)
        if e.priority < c.rest_priority:
            worth = d - (c.bonus or 0.0) * (e.shape == "punto") - stick
            key = ((worth, e.priority) if c.bonus is not None else (e.priority, worth), n, worth, e.id)
            data.append(key)
            if series and e.series == series:
                own.append(key)
        else:
            d -= stick
            rest.append(((d, e.priority), n, d, e.id))
    best = min(data, default=None)
    if own and best not in own and min(own)[2] - c.follow_margin <= best[2]:
        best = min(own)
    other = min(rest, default=None)
    if best is None:
        return (other[3] if other else None), reach
    return (other[3] if other and other[2] + c.margin < best[2] else best[3]), reach


@dataclass
class Selection:
    """T5: filter, search, pinch and debounce of a session; the series last followed is remembered for a while."""

    filter: OneEuro = field(default_factory=OneEuro)
    pinch: Pinch = field(default_factory=Pinch)
    choice: Debounce = field(default_factory=Debounce)
    series: str = ""
    series_at: float = -math.inf
    last: float = -math.inf

    def step(self, t: float, one: tuple | None, two: tuple | None, palm: float | None, elements: dict[str, Element], c: Config) -> tuple[bool, str | None, list[str]] | None:
        if t <= self.last:
            return None
        self.last = t
        hand = one is not None and two is not None
        closed = self.pinch.step(t, math.dist(one, two) if hand else None, palm, c)
        reach: list[str] = []
        if hand:
            if self.filter.t is not None and t - self.filter.t > c.hand_grace / 1000:
                self.filter = OneEuro(c.min_hz, c.beta)
            x, y = self.filter.step(t, *one)
            near = elements.near(x, y, c.hysteresis) if isinstance(elements, Chart) else elements.values()
            found, reach = under(x, y, near, c, self.choice.stable, self.series if t - self.series_at <= c.follow_s else "")
            e = elements.get(self.choice.step(t, found, c) or "")
            if e and e.priority < c.rest_priority and e.series:
                self.series, self.series_at = e.series, t
        elif not closed:
            self.choice, self.filter = Debounce(), OneEuro(c.min_hz, c.beta)
        return closed, self.choice.stable, reach


#: Columns of samples: session, chart, n, t (seconds), x, y, x2, y2, palm.
OUT = "session bigint, n bigint, t double, active boolean, element string, candidates array<string>"


def elements_of(rows: DataFrame) -> DataFrame:
    """(chart, elements): each chart's elements in order of n. A chart fits one row; their number is free, as nothing comes to the driver."""
    fields = ("id", "series", "shape", "priority", "radius", "x1", "y1", "x2", "y2")
    return rows.groupBy("chart").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", *fields))), lambda e: F.struct(*(e[f].alias(f) for f in fields))).alias("elements"))


def _listed(found: Iterable) -> dict[str, Element]:
    none = lambda v: None if v is None or v != v else v
    return Chart({e["id"]: Element(e["id"], e["series"], e["shape"], e["priority"], e["radius"], e["x1"], e["y1"], none(e["x2"]), none(e["y2"])) for e in found})


def _run(pdf: pd.DataFrame, state: Selection, elements: dict, c: Config) -> list[tuple]:
    none = lambda v: None if v is None or v != v else v
    out = []
    for r in pdf.sort_values(["t", "n"], kind="stable").itertuples(index=False):
        pair = lambda a, b: None if none(a) is None or none(b) is None else (float(a), float(b))
        got = state.step(float(r.t), pair(r.x, r.y), pair(r.x2, r.y2), none(r.palm), elements.get(r.chart, {}), c)
        if got:
            out.append((r.session, r.n, r.t, *got))
    return out


_COLUMNS = ["session", "n", "t", "active", "element", "candidates"]


def replay(samples: DataFrame, elements: dict | DataFrame, c: Config = Config()) -> DataFrame:
    """The batch twin: a session's samples in order of time. elements: by chart, or a table (chart, n, id, ...), of which a session's task gets the charts that it touches."""
    if isinstance(elements, dict):
        given = samples.sparkSession.sparkContext.broadcast(elements)
        return samples.groupBy("session").applyInPandas(lambda pdf: pd.DataFrame(_run(pdf, Selection(OneEuro(c.min_hz, c.beta)), given.value, c), columns=_COLUMNS), OUT)
    own = samples.select(F.col("session").alias("_session"), F.col("chart").alias("_chart")).distinct().join(elements_of(elements).withColumnRenamed("chart", "_chart"), "_chart")

    def run(pdf: pd.DataFrame, of: pd.DataFrame) -> pd.DataFrame:
        by = {k: _listed(e) for k, e in zip(of["_chart"], of["elements"], strict=True)}
        return pd.DataFrame(_run(pdf, Selection(OneEuro(c.min_hz, c.beta)), by, c), columns=_COLUMNS)

    return samples.groupBy("session").cogroup(own.groupBy("_session")).applyInPandas(run, OUT)


def filtered(samples: DataFrame, c: Config = Config()) -> DataFrame:
    """T2 alone: smoothed positions of each session."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = OneEuro(c.min_hz, c.beta)
        pdf = pdf.dropna(subset=["x", "y"]).sort_values(["t", "n"], kind="stable")
        return pd.DataFrame([(r.session, r.n, r.t, *f.step(r.t, r.x, r.y)) for r in pdf.itertuples(index=False)], columns=["session", "n", "t", "sx", "sy"])

    return samples.select("session", "n", "t", "x", "y").groupBy("session").applyInPandas(run, "session bigint, n bigint, t double, sx double, sy double")


def pinched(samples: DataFrame, c: Config = Config()) -> DataFrame:
    """T3 alone."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        p, out = Pinch(), []
        for r in pdf.sort_values(["t", "n"], kind="stable").itertuples(index=False):
            gap = math.hypot(r.x - r.x2, r.y - r.y2)
            out.append((r.session, r.n, p.step(r.t, None if gap != gap else gap, None if r.palm != r.palm else r.palm, c)))
        return pd.DataFrame(out, columns=["session", "n", "active"])

    return samples.groupBy("session").applyInPandas(run, "session bigint, n bigint, active boolean")


def debounced(df: DataFrame, key: str, t: str, n: str, value: str, c: Config = Config()) -> DataFrame:
    """T4 alone, on any string column."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d, out = Debounce(), []
        for k, tt, i, v in pdf.sort_values([t, n], kind="stable")[[key, t, n, value]].itertuples(index=False):
            out.append((k, i, d.step(tt, v if isinstance(v, str) else None, c)))
        return pd.DataFrame(out, columns=[key, n, "estable"])

    return df.select(key, t, n, value).groupBy(key).applyInPandas(run, f"`{key}` bigint, `{n}` bigint, estable string")


def limited_alerts(df: DataFrame, key: str, t: str, n: str, flag: str, hold_ms: float = 400, every_s: float = 5) -> DataFrame:
    """An alert when the flag has held for hold_ms, then at most one each every_s."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        since, sent, out = None, -math.inf, []
        for k, tt, i, f in pdf.sort_values([t, n], kind="stable")[[key, t, n, flag]].itertuples(index=False):
            since = None if not f else tt if since is None else since
            if since is not None and (tt - since) * 1000 >= hold_ms and tt - sent >= every_s:
                sent = tt
                out.append((k, i, tt))
        return pd.DataFrame(out, columns=[key, n, "t"])

    return df.select(key, t, n, flag).groupBy(key).applyInPandas(run, f"`{key}` bigint, `{n}` bigint, t double")
