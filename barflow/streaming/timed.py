"""Streams that wait: batches that outlive a trigger, and bars held back until they are in order.

Both keep rows in state and act on timers (Spark's arbitrary stateful processing), which
needs the RocksDB state store: ``use_timers`` sets it for a session.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .streams import BAR_SCHEMA, NAMES, rolling


def use_timers(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Batches(StatefulProcessor):
    """Rows wait in a list; a full list is a batch at once, another one when its timer comes."""

    def __init__(self, schema: T.StructType, n: int, timeout_ms: int):
        self.schema, self.n, self.timeout = schema, n, timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getListState("rows", self.schema)
        self.count = handle.getValueState("count", "batch long, waiting long, timer long")

    def _batch(self, rows: pd.DataFrame, number: int) -> pd.DataFrame:
        return rows.assign(batch=np.full(len(rows), number, np.int64))

    def _frame(self, rows: list) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=self.schema.names)

    def _wait(self, number: int, waiting: int, timer: int, now: int) -> None:
        """A list that is empty needs no timer; one that began to fill needs one."""
        if timer and not waiting:
            self.handle.deleteTimer(timer)
            timer = 0
        elif waiting and not timer:
            timer = now + self.timeout
            self.handle.registerTimer(timer)
        self.count.update((number, waiting, timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        number, waiting, timer = self.count.get() if self.count.exists() else (0, 0, 0)
        for df in rows:
            new = list(df.itertuples(index=False, name=None))
            while waiting + len(new) >= self.n:
                take = self.n - waiting
                held = list(self.rows.get()) if waiting else []
                yield self._batch(self._frame([*map(tuple, held), *new[:take]]), number)
                if waiting:
                    self.rows.clear()
                number, waiting, new = number + 1, 0, new[take:]
                if timer:  # the batch that it was for is gone
                    self.handle.deleteTimer(timer)
                    timer = 0
            if new:
                self.rows.appendList(new)
                waiting += len(new)
        self._wait(number, waiting, timer, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        number, waiting, timer = self.count.get()
        if waiting and expiredTimerInfo.getExpiryTimeInMs() == timer:
            yield self._batch(self._frame([tuple(r) for r in self.rows.get()]), number)
            self.rows.clear()
            self.count.update((number + 1, 0, 0))

    def close(self) -> None:
        pass


def timed_batches(stream: DataFrame, keys: list[str], n: int, timeout_ms: int) -> DataFrame:
    """``stream`` with ``batch``: rows of a key in groups of ``n``, or fewer when ``timeout_ms`` have passed since the first.

    A group outlives the trigger that began it, and a restart. Batches of a key are numbered from 0.
    """
    if n <= 0 or timeout_ms <= 0:
        raise ValueError("a batch has one row at least and waits a while")
    out = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    return stream.groupBy(*keys).transformWithStateInPandas(_Batches(stream.schema, n, timeout_ms), out, "append", "processingTime")


class _InOrder(StatefulProcessor):
    """Bars wait until the watermark has passed their close, and then come in order with their features."""

    def __init__(self, specs: list[tuple[str, dict]]):
        self.specs = specs

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bars", "past string, waiting string")

    def _step(self, key, new: list, timerValues) -> Iterator[pd.DataFrame]:
        keep, ids, features = rolling(self.specs)
        past, waiting = map(json.loads, self.state.get()) if self.state.exists() else ([], [])
        waiting = sorted([*waiting, *new], key=lambda b: b[1])
        now = timerValues.getCurrentWatermarkInMs()
        last = past[-1][1] if past else -(2**63)
        ready = []
        for b in waiting:
            if b[1] <= now and b[1] > last:  # one of equals comes; one before the last is repeated
                ready.append(b)
                last = b[1]
        waiting = [b for b in waiting if b[1] > now]
        if ready:
            bars = pd.DataFrame([*past, *ready], columns=NAMES).astype({c: "int64" if c.endswith("_ts") else "float64" for c in NAMES})
            out = bars.assign(**features(bars)).iloc[len(past) :]
            past = bars.tail(keep).astype(object).values.tolist()
            yield out.assign(symbol=key[0], timeframe=key[1])[["symbol", "timeframe", *NAMES, *ids]]
        for at in [t for t in self.handle.listTimers()]:
            self.handle.deleteTimer(at)
        if waiting:
            self.handle.registerTimer(waiting[0][1])
        self.state.update((json.dumps(past), json.dumps(waiting)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = [b for df in rows for b in df[NAMES].astype(object).values.tolist()]
        yield from self._step(key, new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._step(key, [], timerValues)

    def close(self) -> None:
        pass


def ordered_features(stream: DataFrame, specs: list[tuple[str, dict]], delay: str = "1 hour") -> DataFrame:
    """Rolling features of bars that come in any order within ``delay``: those of ``feature_chain``.

    A bar is held back until the watermark (the newest close less ``delay``) has passed its close; bars
    later than that are dropped. State is the bars held back and the history of a symbol.
    """
    _, ids, _ = rolling(specs)
    timed = stream.withColumn("_at", F.timestamp_millis("close_ts")).withWatermark("_at", delay)
    schema = BAR_SCHEMA + "".join(f", `{i}` double" for i in ids)
    return timed.groupBy("symbol", "timeframe").transformWithStateInPandas(_InOrder(specs), schema, "append", "eventTime")
