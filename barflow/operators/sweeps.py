"""Sweeps of strategies with periods: each feature once, sets as matrices, bars never multiplied as rows.

1. plan: the distinct periods of all sets name the columns that they need together; those
   are made once, by one feature chain.
2. cut: a symbol's bars go to chunks of ``chunk_rows`` as arrays, one row a chunk, and each row is dealt
   once to each slice of ``SLICE`` sets.
3. evaluate: a task runs a slice's sets over a chunk as matrices (sets x bars), some sets at a time.
   What a strategy carries from bar to bar is one of a few flags and one number, so a chunk
   is summed up by what each flag at its start leads to; composed in order these give every
   chunk its true start. Sums of a chunk (bars, trades, returns and their squares) add up.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import ema, feature_chain, numbered
from ..functions.schema import KEYS
from ..sources.shared import stored
from . import strategy
from .backtest import bar_returns
from .joins import SETS
from .scan import Scan, in_chunks, scan

#: Sets of a slice; numbers of a matrix.
SLICE, CELLS = 256, 2_000_000
NEVER = -1.0


class EmaCross:
    """Long while the fast average is above the slow one; sets have fast, slow, cost_bps."""

    flags = 1

    def columns(self, bars: DataFrame, sets: pd.DataFrame, chunk_rows: int) -> tuple[DataFrame, dict[str, Column]]:
        periods = sorted({int(p) for p in [*sets["fast"], *sets["slow"]]})
        b = feature_chain(bars, [ema(p) for p in periods], chunk_rows, kernels=True)
        return b, {f"ema_{p}": F.col(f"ema_{p}") for p in periods}

    def positions(self, c: dict[str, np.ndarray], sets: pd.DataFrame, flag: np.ndarray, number: np.ndarray):
        """[set, bar] whether long, and flag and number after the last bar; the number is the last position."""
        fast, slow = (np.stack([c[f"ema_{int(p)}"] for p in sets[k]]) for k in ("fast", "slow"))
        held = fast > slow  # unknown averages are not above
        return held, flag, held[:, -1].astype(float)

    def before(self, c: dict[str, np.ndarray], sets: pd.DataFrame, flag: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Whether long at the bar before the first."""
        return number > 0


class BuyTheDip:
    """Long for ``hold`` bars from a pullback signal; sets have early, confirmed, pullback, lookback, hold, cost_bps.

    The flag is whether a pullback waits for a trend; the number is that of the last signal's bar.
    """

    flags = 2

    def columns(self, bars: DataFrame, sets: pd.DataFrame, chunk_rows: int) -> tuple[DataFrame, dict[str, Column]]:
        tops = {"recent_high": Scan("max", F.col("high")), "_high_before": Scan("max", F.col("high"), before=True)}
        b = scan(in_chunks(bars, chunk_rows, 0, {}), tops).drop("bar_idx", "_chunk")
        lookbacks = sorted({int(x) for x in sets["lookback"]})
        for lb in lookbacks:
            b = strategy.trend_maturity(b, lookback=lb, chunk_rows=chunk_rows)
            b = b.withColumnsRenamed({"higher_highs": f"highs_{lb}", "higher_lows": f"lows_{lb}"}).withColumn("ups", F.col("consecutive_up")).drop("consecutive_up", "maturity")
        depth = F.try_divide(F.col("recent_high") - F.col("close"), "recent_high")
        new = F.coalesce(F.col("high") > F.col("_high_before"), F.lit(True))
        return b, {"depth": depth, "new": new, "ups": F.col("ups"), **{f"{k}_{lb}": F.col(f"{k}_{lb}") for k in ("highs", "lows") for lb in lookbacks}}

    def positions(self, c: dict[str, np.ndarray], sets: pd.DataFrame, flag: np.ndarray, number: np.ndarray):
        at, n = c["bar_idx"], len(c["bar_idx"])
        col = lambda k: sets[k].to_numpy(float)[:, None]
        both = np.stack([np.minimum(c[f"highs_{int(lb)}"], c[f"lows_{int(lb)}"]) for lb in sets["lookback"]])
        trend = (both >= col("confirmed")) | (c["ups"][None, :] >= col("early"))
        pulled = c["depth"][None, :] >= col("pullback")
        # places in the chunk, from 1; 0 stands for what was there before, if the flag was up
        place = np.arange(1, n + 1)
        last = np.maximum.accumulate(np.where(pulled, place, 0), axis=1)
        opened = np.maximum.accumulate(np.where(c["new"] > 0, place, 0))
        trended = np.zeros((len(sets), n), int)
        trended[:, 1:] = np.maximum.accumulate(np.where(trend, place, 0), axis=1)[:, :-1]
        waits = flag.astype(bool)[:, None] & (last == 0) & (opened == 0) & (trended == 0)
        up = ((last > 0) & (last >= opened) & (last > trended)) | waits
        signal = np.maximum.accumulate(np.where(trend & up, at[None, :], NEVER), axis=1)
        signal = np.maximum(signal, number[:, None])
        held = (signal > NEVER) & (at[None, :] - signal < col("hold"))
        return held, (up[:, -1] & ~trend[:, -1]).astype(int), signal[:, -1]

    def before(self, c: dict[str, np.ndarray], sets: pd.DataFrame, flag: np.ndarray, number: np.ndarray) -> np.ndarray:
        return (number > NEVER) & (c["bar_idx"][0] - 1 - number < sets["hold"].to_numpy(float))


def _blocks(sets: pd.DataFrame, n: int) -> Iterator[slice]:
    step = max(1, CELLS // max(n, 1))
    for a in range(0, len(sets), step):
        yield slice(a, a + step)


def _arrays(row: dict, names: list[str]) -> dict[str, np.ndarray]:
    return {k: np.asarray(row[k], float) for k in names}


def _sweep_part(bars: DataFrame, sets: pd.DataFrame, rule, chunk_rows: int) -> DataFrame:
    made, columns = rule.columns(bar_returns(bars), sets, chunk_rows)
    b = numbered(made, chunk_rows)
    names, fields = ["bar_idx", "ret", *columns], [F.col("bar_idx"), F.col("ret"), *columns.values()]
    rows = b.select(*KEYS, F.floor(F.col("bar_idx") / chunk_rows).alias("_chunk"), F.struct("bar_idx", *[f.cast("double").alias(f"f{i}") for i, f in enumerate(fields)]).alias("s"))
    s = F.array_sort(F.collect_list("s"))
    chunks = rows.groupBy(*KEYS, "_chunk").agg(s.alias("s"))
    lists = [F.col(f"s.f{i}").alias(n) for i, n in enumerate(names)]  # a field of an array of structs is an array
    slices = -(-len(sets) // SLICE)
    chunks = stored(chunks.select(*KEYS, "_chunk", *lists))
    dealt = chunks.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).repartition(*KEYS, "_chunk", "_slice")

    place = [*KEYS, "_chunk", "_slice"]

    def of(i: int) -> pd.DataFrame:
        return sets.iloc[int(i) * SLICE : (int(i) + 1) * SLICE]

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            out = []
            for row in df.to_dict("records"):
                own, c = of(row["_slice"]), _arrays(row, names)
                flags, numbers = np.zeros((rule.flags, len(own)), int), np.zeros((rule.flags, len(own)))
                for at in _blocks(own, len(c["ret"])):
                    part = own.iloc[at]
                    for f in range(rule.flags):
                        _, flags[f, at], numbers[f, at] = rule.positions(c, part, np.full(len(part), f), np.full(len(part), NEVER))
                out.append((*(row[k] for k in place), flags.ravel().tolist(), numbers.ravel().tolist()))
            yield pd.DataFrame(out, columns=[*place, "flags", "numbers"])

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        """What stands at the start of each chunk, for all sets of a slice at once."""
        pdf = pdf.sort_values("_chunk")
        n = len(pdf["flags"].iloc[0]) // rule.flags
        flag, number, all_sets, out = np.zeros(n, int), np.full(n, NEVER), np.arange(n), []
        for flags, numbers in zip(pdf["flags"], pdf["numbers"]):
            out.append((flag.tolist(), number.tolist()))
            then = np.asarray(numbers, float).reshape(rule.flags, n)[flag, all_sets]
            flag, number = np.asarray(flags, int).reshape(rule.flags, n)[flag, all_sets], np.where(then > NEVER, then, number)
        return pdf[place].assign(flag=[f for f, _ in out], number=[x for _, x in out])

    key = "symbol string, timeframe string, _chunk long, _slice int"
    if chunks.filter("_chunk > 0").head(1):
        sums = dealt.mapInPandas(summaries, f"{key}, flags array<int>, numbers array<double>")
        begun = sums.groupBy(*KEYS, "_slice").applyInPandas(starts, f"{key}, flag array<int>, number array<double>")
        dealt = dealt.join(begun, [*KEYS, "_chunk", "_slice"])
    else:
        dealt = dealt.withColumns({"flag": F.lit(None).cast("array<int>"), "number": F.lit(None).cast("array<double>")})

    def evaluate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for row in df.to_dict("records"):
                own, c = of(row["_slice"]), _arrays(row, names)
                flag = np.zeros(len(own), int) if row["flag"] is None else np.asarray(row["flag"], int)
                number = np.full(len(own), NEVER) if row["number"] is None else np.asarray(row["number"], float)
                for at in _blocks(own, len(c["ret"])):
                    part = own.iloc[at]
                    held, _, _ = rule.positions(c, part, flag[at], number[at])
                    earlier = np.column_stack([rule.before(c, part, flag[at], number[at]), held[:, :-1]])
                    net = np.where(held, np.nan_to_num(c["ret"])[None, :], 0.0) - (held != earlier) * (part["cost_bps"].to_numpy(float)[:, None] / 1e4)
                    out = pd.DataFrame({
                        "param_id": part["param_id"].to_numpy(), "n": len(c["ret"]), "trades": (held & ~earlier).sum(1), "s": net.sum(1), "q": (net * net).sum(1),
                    })
                    out.insert(1, "symbol", [row["symbol"]] * len(part))
                    out.insert(2, "timeframe", [row["timeframe"]] * len(part))
                    yield out

    out = dealt.mapInPandas(evaluate, "param_id long, symbol string, timeframe string, n long, trades long, s double, q double")
    out = out.groupBy("param_id", *KEYS).agg(*[F.sum(x).alias(x) for x in ("n", "trades", "s", "q")])
    mean = F.col("s") / F.col("n")
    spread = F.try_divide(F.col("q") - F.col("n") * mean * mean, F.col("n") - 1)
    # a spread below the last digits of the squares is none
    sd = F.when(spread > 1e-14 * F.try_divide("q", "n"), F.sqrt(spread))
    return out.select("param_id", *KEYS, F.col("n").alias("n_bars"), F.col("trades").alias("n_trades"), F.col("s").alias("total"), F.try_divide(mean, sd).alias("sharpe"))


def strategy_sweep(bars: DataFrame, params: DataFrame, rule, chunk_rows: int = 100_000) -> DataFrame:
    """param_id, symbol, timeframe, n_bars, n_trades, total, sharpe of a strategy under every parameter set.

    ``rule`` is a strategy (``EmaCross``, ``BuyTheDip``); ``params`` has its parameters and a ``param_id``, whole and
    unique. A position taken at a bar's close earns the return to the next one; each
    change of it costs ``cost_bps``. A return that is missing counts as none. Sets go to
    every task, about ``SETS`` at a time.
    """
    parts = -(-params.count() // SETS)
    part = F.pmod(F.xxhash64("param_id"), F.lit(max(parts, 1)))
    frames = [params.filter(part == i).orderBy("param_id").toPandas() for i in range(parts)]
    return reduce(DataFrame.unionByName, [_sweep_part(bars, sets, rule, chunk_rows) for sets in frames if len(sets)] or [_nothing(bars)])


def _nothing(bars: DataFrame) -> DataFrame:
    none = F.lit(None)
    return bars.limit(0).select(none.cast("long").alias("param_id"), *KEYS, *[none.cast(t).alias(n) for n, t in (("n_bars", "long"), ("n_trades", "long"), ("total", "double"), ("sharpe", "double"))])
