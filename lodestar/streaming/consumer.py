"""Pluggable consumers of samples. A consumer has configure(settings) and update(t, sample) -> selection; a factory of that name makes one for each session, so any rule runs in the batch replay and on the stream alike."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import replace
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestar.streaming.selection import Config, Debounce, Pinch


class Consumer(Protocol):
    def configure(self, settings: dict[str, Any]) -> None: ...

    def update(self, t: float, sample: dict[str, Any]) -> str | None: ...


class Tuned:
    """A consumer whose settings are fields of Config."""

    def __init__(self):
        self.config = Config()

    def configure(self, settings: dict[str, Any]) -> None:
        self.config = replace(self.config, **settings)


class Held(Tuned):
    """T4 on a sample's value."""

    def __init__(self):
        super().__init__()
        self.rule = Debounce()

    def update(self, t: float, sample: dict[str, Any]) -> str | None:
        return self.rule.step(t, sample.get("value"), self.config)


class Grip(Tuned):
    """T3 on a sample's gap and palm: "closed" or nothing."""

    def __init__(self):
        super().__init__()
        self.rule = Pinch()

    def update(self, t: float, sample: dict[str, Any]) -> str | None:
        return "closed" if self.rule.step(t, sample.get("gap"), sample.get("palm"), self.config) else None


FACTORIES: dict[str, Callable[[], Consumer]] = {"held": Held, "grip": Grip}


def made(name: str, settings: dict[str, Any]) -> Consumer:
    out = FACTORIES[name]()
    out.configure(settings)
    return out


def _plain(v):
    return None if v is None or v != v else v


def _fed(consumer: Consumer, pdf: pd.DataFrame, key: str, t: str, n: str) -> pd.DataFrame:
    fields = [c for c in pdf.columns if c not in (key, t, n)]
    rows = [(r[0], r[1], consumer.update(float(r[2]), {f: _plain(v) for f, v in zip(fields, r[3:], strict=True)})) for r in pdf.sort_values([t, n], kind="stable")[[key, n, t, *fields]].itertuples(index=False)]
    return pd.DataFrame(rows, columns=[key, n, "selection"])


def consumed(samples: DataFrame, name: str, settings: dict[str, Any], key: str = "session", t: str = "t", n: str = "n", idle: str | None = None) -> DataFrame:
    """(key, n, selection) of each sample. Other columns are the sample. On a stream the consumer is a session's state, dropped when nothing has come for idle (milliseconds, as a number)."""
    ddl = f"`{key}` bigint, `{n}` bigint, selection string"
    if not samples.isStreaming:
        return samples.groupBy(key).applyInPandas(lambda pdf: _fed(made(name, settings), pdf, key, t, n), ddl)

    def update(_: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        consumer = pickle.loads(state.get[0]) if state.exists else made(name, settings)
        yield _fed(consumer, pd.concat(pdfs), key, t, n)
        state.update((pickle.dumps(consumer),))
        if idle:
            state.setTimeoutDuration(int(idle))

    return samples.groupBy(key).applyInPandasWithState(update, ddl, "state binary", "append", GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout)
