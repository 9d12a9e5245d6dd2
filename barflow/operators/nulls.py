"""Null distributions from seeds: a repetition is a number, and only its scores become rows.

A task has one series of returns (of a symbol and timeframe) and a slice of repetitions. A repetition's order
of bars follows from a counter-based hash of (repetition, block), the same as in
``permute_returns``, so a task draws, scores and forgets a few of them at a time, and any of
them can be drawn again anywhere. What is shuffled is each series once for each slice: bars times
slices of 8 bytes, never bars times repetitions.

A series lies whole in its task. Time bounds it: a year of minute bars is 4 MB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import KEYS
from .backtest import MODULUS, bar_returns, null_test

#: Repetitions of a slice, and numbers that a task holds at a time of each kind.
SLICE, CELLS = 64, 2_000_000
Score = Callable[[np.ndarray], dict[str, np.ndarray]]


def mixed_numbers(x: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """``backtest.mixed`` over arrays of whole numbers."""
    a = (x % 1000003 * 48271 + salt * 69621 + 7) % MODULUS
    b = (a * a + x) % MODULUS
    return (b % 46337 * (b % 46327) + b * 16807 + x) % MODULUS


def orders(n: int, reps: np.ndarray, seed: int = 0, block: int = 1) -> np.ndarray:
    """[rep, i]: which bar stands at place i in each repetition; repetition -1 is the order of time."""
    blocks = np.arange(n, dtype=np.int64)[None, :] // block
    h = mixed_numbers(blocks, np.maximum(reps, 0).astype(np.int64)[:, None] + seed)
    drawn = np.argsort(h, axis=1, kind="stable")
    drawn[reps < 0] = np.arange(n)
    return drawn


def from_seeds(
    bars: DataFrame, n_reps: int, score: Score, columns: list[str], seed: int = 0, block: int = 1, observed: bool = False, per_task: int = SLICE
) -> DataFrame:
    """rep, symbol, timeframe and the scores of every repetition; with ``observed`` also of rep -1, the real series.

    ``score`` gets a matrix with one series of returns a row and gives an array for each of
    ``columns``, one number a row; what is not a number becomes null.
    """
    series = F.transform(F.array_sort(F.collect_list(F.struct("close_ts", "ret"))), lambda x: x["ret"])
    r = bar_returns(bars).filter("ret is not null").groupBy(*KEYS).agg(series.alias("ret"))
    first = F.lit(-1 if observed else 0).cast("long")
    r = r.withColumn("_from", F.explode(F.sequence(first, F.lit(n_reps - 1).cast("long"), F.lit(per_task).cast("long"))))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for symbol, timeframe, ret, start in df[[*KEYS, "ret", "_from"]].itertuples(index=False):
                ret = np.asarray(ret, float)
                step = max(1, CELLS // max(len(ret), 1))
                stop = min(int(start) + per_task, n_reps)
                for a in range(int(start), stop, step):
                    reps = np.arange(a, min(a + step, stop))
                    found = score(ret[orders(len(ret), reps, seed, block)])
                    out = pd.DataFrame({"rep": reps, **{c: np.asarray(found[c], float) for c in columns}})
                    out.insert(1, "symbol", [symbol] * len(reps))
                    out.insert(2, "timeframe", [timeframe] * len(reps))
                    yield out

    # the slices of a symbol are dealt like symbols: one with most of the bars has many tasks
    dealt = r.repartition(*KEYS, "_from")
    out = dealt.mapInPandas(draw, "rep long, symbol string, timeframe string, " + ", ".join(f"{c} double" for c in columns))
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in columns})


SCORES = ["total", "sharpe", "log_cagr", "max_drawdown"]


def scores(net: np.ndarray, bars_per_year: float) -> dict[str, np.ndarray]:
    """Of net returns, one series a row: total, mean over deviation, yearly log growth, deepest drawdown."""
    n = net.shape[1]
    with np.errstate(divide="ignore", invalid="ignore"):
        sd = net.std(axis=1, ddof=1) if n > 1 else np.full(len(net), np.nan)
        flat = (net == net[:, :1]).all(axis=1)
        sharpe = np.where(flat | ~(sd > 0), np.nan, net.mean(axis=1) / sd)
    grown = np.cumsum(np.log1p(np.maximum(net, -0.999999)), axis=1)
    top = np.maximum(np.maximum.accumulate(grown, axis=1), 0.0)
    return {"total": net.sum(axis=1), "sharpe": sharpe, "log_cagr": grown[:, -1] * bars_per_year / n, "max_drawdown": np.expm1((grown - top).min(axis=1))}


def null_scores(bars: DataFrame, n_reps: int, entry: float, cost_bps: float, bars_per_year: float, seed: int = 0, block: int = 1, observed: bool = False) -> DataFrame:
    """rep, symbol, timeframe, total, sharpe, log_cagr (log of 1 + CAGR), max_drawdown of the threshold strategy.

    The strategy is long for a bar after a fall of ``entry`` or more, on every null series; with
    ``observed`` rep -1 is the real one.
    """

    def score(ret: np.ndarray) -> dict[str, np.ndarray]:
        fell = np.zeros(ret.shape, bool)
        fell[:, 1:] = -ret[:, :-1] >= entry
        return scores(np.where(fell, ret - cost_bps / 1e4, 0.0), bars_per_year)

    return from_seeds(bars, n_reps, score, SCORES, seed, block, observed)


def significance(found: DataFrame, metrics: list[str] = SCORES[1:]) -> DataFrame:
    """symbol, timeframe, metric, observed, n_null, p_value, quantile, rejects, of ``null_scores`` with its rep -1.

    Every metric is better the larger it is (a drawdown is negative).
    """
    long = found.unpivot(["rep", *KEYS], metrics, "metric", "value")
    by = (*KEYS, "metric")
    return null_test(long.filter("rep = -1").select(*by, "value"), long.filter("rep >= 0").select(*by, "value"), by, "value")
