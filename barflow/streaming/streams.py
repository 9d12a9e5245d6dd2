"""Streaming twins: bars as they come, bars out of ticks, features, signals, batches, lossless fan-out, paced replay."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.features import history, spec, stages
from ..functions.kernels import KERNELS
from ..functions.schema import step_ms
from ..sources.files import KLINE_OPTIONS, KLINE_SCHEMA, parse_klines
from ..sources.shared import hadoop_path

BAR_SCHEMA = "symbol string, timeframe string, open_ts long, close_ts long, open double, high double, low double, close double, volume double"


def stream_bars(spark: SparkSession, path: str, files_per_trigger: int = 1, schema: str = BAR_SCHEMA) -> DataFrame:
    """Parquet bars as a stream, so many files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def stream_klines(spark: SparkSession, path: str, files_per_trigger: int = 1, symbol=None, timeframe=None) -> tuple[DataFrame, DataFrame]:
    """Bars and bad rows of headerless kline files as they come, so many files a trigger; as ``read_klines_csv``."""
    df = spark.readStream.schema(KLINE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).csv(path, **KLINE_OPTIONS)
    return parse_klines(df, symbol, timeframe)


def stream_ticks_to_bars(ticks: DataFrame, ts: str, symbol: str, price: str, size: str, timeframe: str, delay: str = "10 minutes") -> DataFrame:
    """Tumbling bars, each emitted once when the watermark has passed its end.

    First and last price are by event time; ties at one instant go to the smaller price.
    """
    step = step_ms(timeframe)
    t = ticks.select(
        F.col(ts).cast("timestamp").alias("t"), F.col(symbol).cast("string").alias("symbol"), F.expr(price).cast("double").alias("p"), F.expr(size).cast("double").alias("v")
    ).withWatermark("t", delay)
    at = F.struct("t", "p")
    bars = t.groupBy(F.window("t", f"{step} milliseconds").alias("w"), "symbol").agg(
        F.min_by("p", at).alias("open"), F.max("p").alias("high"), F.min("p").alias("low"), F.max_by("p", at).alias("close"), F.sum("v").alias("volume")
    )
    opens = F.unix_millis(F.col("w.start"))
    return bars.select(
        "symbol", F.lit(timeframe).alias("timeframe"), opens.alias("open_ts"), (opens + (step - 1)).alias("close_ts"), "open", "high", "low", "close", "volume"
    )


Sink = Callable[[DataFrame, int], None]


def fan_out(stream: DataFrame, sinks: Iterable[Sink], checkpoint: str):
    """Each micro-batch to every sink in turn, nothing dropped; returns the stream writer.

    A ledger beside the checkpoint has one mark for each sink and batch that is done: where a later sink fails,
    the retry goes on with that one and does not write the others' rows again. A sink that can write a
    batch twice without harm (``to_epochs``) gets it exactly once, whatever stops the driver.
    """
    sinks, spark = list(sinks), stream.sparkSession

    def send(batch: DataFrame, epoch: int) -> None:
        marks = [hadoop_path(spark, f"{checkpoint}/sinks/{i}/{epoch}") for i in range(len(sinks))]
        left = [i for i, (at, store) in enumerate(marks) if not store.exists(at)]
        if not left:
            return
        batch.persist()
        try:
            for i in left:
                sinks[i](batch, epoch)
                at, store = marks[i]
                store.create(at, True).close()
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)


def to_epochs(path: str) -> Sink:
    """A sink of Parquet, one folder a batch: a batch that is written again takes the place of its first try."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def replay(writer, interval: str | None = None):
    """Start a writer paced by an interval ("100 milliseconds"), or as a backfill of what is there."""
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def in_batches(df: DataFrame, n: int) -> DataFrame:
    """``df`` (a stream or a table) with ``batch``: rows dealt to groups of at most ``n``, in the order they come.

    On a stream a group also ends with its trigger, so ``replay``'s interval is the timeout.
    """
    if n <= 0:
        raise ValueError("a batch has one row at least")

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = 0
        for b in batches:
            yield b.assign(batch=(seen + np.arange(len(b))) // n)
            seen += len(b)

    return df.mapInPandas(deal, T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())]))


NAMES = ["open_ts", "close_ts", "open", "high", "low", "close", "volume"]


def _typed(bars: pd.DataFrame) -> pd.DataFrame:
    return bars.astype({n: "int64" if n.endswith("_ts") else "float64" for n in NAMES})


def rolling(specs: list[tuple[str, dict]]) -> tuple[int, list[str], Callable]:
    """Bars that specs look back on, their ids, and a function from bars in order to their values."""
    unknown = sorted({kind for kind, _ in specs} - set(KERNELS))
    if unknown:
        raise ValueError(f"features that no stream can compute: {', '.join(unknown)}")
    built = [spec(kind, **options) for kind, options in specs]
    rounds, ids = stages(built), [s.id for s in built]
    order = [ids.index(s.id) for r in rounds for s in r]

    def features(bars) -> dict:
        have = {n: np.asarray(bars[n]) for n in NAMES}
        for i in order:
            kind, options = specs[i]
            have[ids[i]] = KERNELS[kind](have, **options)
        return {i: have[i] for i in ids}

    return history(rounds), ids, features


def stream_features(stream: DataFrame, specs: list[tuple[str, dict]], mode: str = "event_time", keep_late: bool = False) -> DataFrame:
    """Rolling features of a bar stream, with as many bars of history as they look back on.

    ``specs`` are (kind, options), as ``[("sma", {"period": 20})]``. State is the last bars of
    each symbol and timeframe.

    ``mode`` ``event_time``: bars at or before the last one seen are late or repeated and are
    dropped, or with ``keep_late`` come without features, marked ``late``; for bars in order the
    result equals ``feature_chain``. ``arrival``: every bar takes its place among the last ones
    (before its equals; one older than all of a full history is gone at once), and comes with
    the features of the newest bar as they then stand. Order of arrival is the order in the input.
    """
    if mode not in ("event_time", "arrival"):
        raise ValueError(f"unknown mode {mode!r}")
    keep, ids, features = rolling(specs)
    columns = ["symbol", "timeframe", *NAMES, *ids, *["late"] * keep_late]

    def in_order(past: list, new: pd.DataFrame) -> tuple[pd.DataFrame, list]:
        new = new.sort_values("close_ts", kind="stable")
        gone = new.duplicated("close_ts") | (new["close_ts"] <= (past[-1][1] if past else -(2**63)))
        late, new = new[gone], new[~gone]
        old = pd.DataFrame(past, columns=NAMES)
        bars = _typed(pd.concat([old, new], ignore_index=True) if past else new.reset_index(drop=True))
        out = bars.assign(**features(bars), late=False).iloc[len(old) :]
        if keep_late and len(late):
            out = pd.concat([out, late.assign(**{i: np.nan for i in ids}, late=True)])
        return out, bars.tail(keep).astype(object).values.tolist()

    def as_they_come(past: list, new: pd.DataFrame) -> tuple[pd.DataFrame, list]:
        last = np.array(past, float).reshape(-1, len(NAMES))
        rows = []
        for bar in new.to_numpy(float):
            last = np.insert(last, np.searchsorted(last[:, 1], bar[1]), bar, axis=0)[-keep:]
            rows.append([v[-1] for v in features(dict(zip(NAMES, last.T))).values()])
        return new.reset_index(drop=True).assign(**dict(zip(ids, np.array(rows, float).T)), late=False), last.tolist()

    def step(key, batches, state):
        past = json.loads(state.get[0]) if state.exists else []
        if mode == "event_time":  # put in order whole: a trigger's files bound it
            batches = [pd.concat(list(batches))]
        for batch in batches:
            out, past = (in_order if mode == "event_time" else as_they_come)(past, _typed(batch[NAMES]))
            yield out.assign(symbol=key[0], timeframe=key[1])[columns]
        state.update((json.dumps(past),))

    schema = BAR_SCHEMA + "".join(f", `{i}` double" for i in ids) + ", late boolean" * keep_late
    return stream.groupBy("symbol", "timeframe").applyInPandasWithState(step, schema, "bars string", "append", "NoTimeout")


class DipState:
    """What the pullback strategy remembers of a symbol, as plain numbers."""

    def __init__(self, lookback: int, saved: dict | None = None):
        self.lb = lookback
        s = saved or {}
        self.last, self.up, self.top, self.inside = s.get("last"), s.get("up", 0), s.get("top"), s.get("inside", False)
        self.bars = s.get("bars", [])  # (high, low) of the last 2 * lookback + 1
        self.swings = s.get("swings", {"high": [None, 0], "low": [None, 0]})  # last price, length of the rising run

    def saved(self) -> dict:
        return {k: v for k, v in vars(self).items() if k != "lb"}

    def take(self, high: float, low: float, close: float) -> None:
        """One bar further."""
        self.up = self.up + 1 if self.last is not None and close > self.last else 0
        self.last = close
        self.bars = [*self.bars, (high, low)][-(2 * self.lb + 1) :]
        if len(self.bars) == 2 * self.lb + 1:
            for i, (name, sign) in enumerate((("high", 1), ("low", -1))):
                mid = sign * self.bars[self.lb][i]
                if all(mid > sign * b[i] for k, b in enumerate(self.bars) if k != self.lb):
                    before, run = self.swings[name]
                    price = self.bars[self.lb][i]
                    self.swings[name] = [price, run + 1 if before is not None and price > before else 0]
        if self.top is None or high > self.top:
            self.top, self.inside = high, False


def stream_signals(
    stream: DataFrame, early: int = 3, confirmed: int = 2, mature: int = 3, pullback: float = 0.03, lookback: int = 2
) -> DataFrame:
    """The pullback strategy on a bar stream: symbol, timeframe, side, ts, source, maturity and counts.

    State is a dozen numbers a symbol and timeframe. Late and repeated bars are dropped; for
    bars in order the signals equal those of ``buy_the_dip``.
    """

    def step(key, batches, state):
        saved = json.loads(state.get[0]) if state.exists else {}
        s, seen, out = DipState(lookback, saved.get("dip")), saved.get("seen"), []
        bars = pd.concat(list(batches)).sort_values("close_ts", kind="stable").drop_duplicates("close_ts")
        for b in bars[["close_ts", "high", "low", "close"]].itertuples(index=False):
            if seen is not None and b.close_ts <= seen:
                continue
            seen = int(b.close_ts)
            s.take(float(b.high), float(b.low), float(b.close))
            depth = (s.top - b.close) / s.top if s.top else None
            s.inside = s.inside or (depth is not None and depth >= pullback)
            highs, lows = s.swings["high"][1], s.swings["low"][1]
            both = min(highs, lows)
            kind = "mature" if both >= mature else "confirmed" if both >= confirmed else "early" if s.up >= early else "none"
            if kind != "none" and s.inside:
                out.append((*key, "buy", seen, "buy_the_dip", kind, depth, s.top, highs, lows))
                s.inside = False
        state.update((json.dumps({"dip": s.saved(), "seen": seen}),))
        yield pd.DataFrame(out, columns=SIGNAL_COLUMNS)

    return stream.groupBy("symbol", "timeframe").applyInPandasWithState(step, SIGNAL_SCHEMA, "dip string", "append", "NoTimeout")


SIGNAL_SCHEMA = (
    "symbol string, timeframe string, side string, ts long, source string, trend_maturity string, pullback_depth double, recent_high double, "
    "swing_high_count int, swing_low_count int"
)
SIGNAL_COLUMNS = [c.split()[0] for c in SIGNAL_SCHEMA.split(", ")]
