"""Streams with state of their own, by stateful processors: value and list state, time to live, timers.

State is kept in the state store (RocksDB), by key, under the stream's checkpoint, so it outlives executors and restarts.

Order: the rows that one micro-batch brings of a key are put in order before the state is used, however many Arrow
batches they come in; what is held for that is the columns named here, of one key and one micro-batch (its size is the
trigger's option). Rows of later micro-batches come after those of earlier ones.

Defined cases: null keys are one key; rows that tie in time are ordered by their id; null values of a series leave its
mean alone; repeated rows are rows of their own; a micro-batch without rows changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY_MS = 86_400_000


def _gathered(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(order, kind="stable")


class Carry(StatefulProcessor):
    """The last project and ticket named; forgotten a day after a key's last rows."""

    def __init__(self, ttl_ms: int = DAY_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "project string, ticket string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        project, ticket = self.last.get() if self.last.exists() else (None, None)
        t = _gathered(rows, ["turn"])
        for name, before in (("project", project), ("ticket", ticket)):
            t[name] = t[name].where(t[name].notna(), None).ffill()
            t[name] = t[name].where(t[name].notna(), before)
        newest = t.iloc[-1]
        self.last.update((newest["project"], newest["ticket"]))
        yield pd.DataFrame({"conversation_id": key[0], "turn": t["turn"], "project": t["project"], "ticket": t["ticket"]})

    def close(self) -> None:
        pass


class Rolling(StatefulProcessor):
    """The mean of the newest values at each row; a timer drops what a quiet key has kept."""

    def __init__(self, last: int, quiet_ms: int = DAY_MS):
        self.n, self.quiet_ms = last, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.values = handle.getListState("values", "value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = [v for (v,) in self.values.get()] if self.values.exists() else []
        t = _gathered(rows, ["time", "id"])
        series = pd.Series([*before, *t["value"]], dtype="float64")
        mean = series.rolling(self.n, min_periods=1).apply(lambda x: x[~pd.isna(x)].mean() if (~pd.isna(x)).any() else float("nan"), raw=True) if series.isna().any() else _means(series, self.n)
        if kept := [(float(v),) for v in series.iloc[-(self.n - 1) :]] if self.n > 1 else []:
            self.values.put(kept)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer[0] if isinstance(timer, tuple) else timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.quiet_ms)
        yield pd.DataFrame({"key": key[0], "id": t["id"].to_numpy(), "rolling": mean.iloc[len(before) :].to_numpy()})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.values.clear()
        yield pd.DataFrame({"key": [], "id": [], "rolling": []})

    def close(self) -> None:
        pass


def _means(series: pd.Series, n: int) -> pd.Series:
    """Means of windows, each added up on its own, so that no error runs on."""
    import numpy as np

    v = np.concatenate([np.zeros(n - 1), series.to_numpy()])
    sums = np.lib.stride_tricks.sliding_window_view(v, n).sum(axis=1)
    return pd.Series(sums / np.minimum(np.arange(1, len(series) + 1), n))


def carry_context(turns: DataFrame, ttl_ms: int = DAY_MS) -> DataFrame:
    """(conversation_id, turn, project, ticket): the last project and ticket named in the conversation so far."""
    named = turns.select("conversation_id", "turn", "project", "ticket")
    return named.groupBy("conversation_id").transformWithStateInPandas(Carry(ttl_ms), "conversation_id string, turn long, project string, ticket string", "append", "ProcessingTime")


def rolling_mean(rows: DataFrame, by: str, time: str, value: str, id: str, last: int = 50) -> DataFrame:
    """(``by``, ``id``, rolling): at each row the mean of its and the preceding values of its key, ``last`` at most."""
    named = rows.selectExpr(f"`{by}` AS key", f"`{time}` AS time", f"CAST(`{value}` AS DOUBLE) AS value", f"`{id}` AS id")
    types = [named.schema[c].dataType.simpleString() for c in ("key", "id")]
    out = named.groupBy("key").transformWithStateInPandas(Rolling(last), f"key {types[0]}, id {types[1]}, rolling double", "append", "ProcessingTime")
    return out.withColumnsRenamed({"key": by, "id": id})
