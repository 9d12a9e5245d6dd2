"""Rolling indicators as specifications that build a column.

A spec knows its id (``sma_20``; a parameter is added only where it is not the default:
``ema_20_s3``), its lookback and its column over a bar table. All of them share one window
partitioning and order, so any list of specs is one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import KERNELS
from .schema import KEYS, TIMEFRAMES, by_time, last_rows, round6, typical_price


@dataclass(frozen=True)
class FeatureSpec:
    id: str
    lookback: int
    build: Callable[[], Column] = field(compare=False)
    depends: tuple[str, ...] = ()
    #: Kind and options of its numpy kernel; whether its values are whole numbers.
    kernel: tuple[str, dict] | None = field(default=None, compare=False)
    whole: bool = False

    def column(self) -> Column:
        return self.build().alias(self.id)


def _period(period: int) -> int:
    if isinstance(period, float) and period.is_integer():
        period = int(period)
    if not isinstance(period, int) or isinstance(period, bool) or period <= 0:
        raise ValueError(f"period must be a positive integer, not {period!r}")
    return period


def sma(period: int) -> FeatureSpec:
    """Mean of the last ``period`` closes; null until there are as many."""
    p = _period(period)

    def build() -> Column:
        w = last_rows(p)
        return F.when(F.count("close").over(w) == p, round6(F.avg("close").over(w)))

    return FeatureSpec(f"sma_{p}", p, build, kernel=("sma", {"period": p}))


def ema(period: int, smoothing: float = 2.0) -> FeatureSpec:
    """Exponential average over the last 2 * period bars, recomputed at every bar.

    The seed is the mean of the oldest ``period`` closes of that stretch; null until then.
    """
    p, alpha = _period(period), smoothing / (period + 1)
    name = f"ema_{p}" + ("" if smoothing == 2.0 else f"_s{smoothing:g}")

    def build() -> Column:
        c = F.collect_list("close").over(last_rows(2 * p))
        seed = F.aggregate(F.slice(c, 1, p), F.lit(0.0), lambda a, x: a + x) / p
        value = F.aggregate(F.slice(c, p + 1, p), seed, lambda e, x: x * F.lit(alpha) + e * F.lit(1 - alpha))
        return F.when(F.size(c) >= p, round6(value))

    return FeatureSpec(name, 2 * p, build, kernel=("ema", {"period": p, "smoothing": smoothing}))


def rsi(period: int) -> FeatureSpec:
    """Relative strength over ``period`` changes with simple averages; 100 where nothing fell."""
    p = _period(period)

    def build() -> Column:
        w, d = last_rows(p), F.col("_change")
        up, down = F.sum(F.greatest(d, F.lit(0.0))).over(w) / p, F.sum(F.greatest(-d, F.lit(0.0))).over(w) / p
        value = F.when(down == 0, F.lit(100.0)).otherwise(round6(100 - 100 / (1 + up / F.nullif(down, F.lit(0.0)))))
        return F.when(F.count(d).over(w) == p, value)

    return FeatureSpec(f"rsi_{p}", p + 1, build, kernel=("rsi", {"period": p}))


def vwap(period: int) -> FeatureSpec:
    """Volume-weighted mean typical price of the last ``period`` bars; null without volume."""
    p = _period(period)

    def build() -> Column:
        w = last_rows(p)
        money, volume = F.sum(typical_price() * F.col("volume")).over(w), F.sum("volume").over(w)
        return F.when(F.count("close").over(w) == p, round6(money / F.nullif(volume, F.lit(0.0))))

    return FeatureSpec(f"vwap_{p}", p, build, kernel=("vwap", {"period": p}))


def engulfing_candle() -> FeatureSpec:
    """1 or -1 where the body strictly engulfs an opposite previous body, else 0."""

    def build() -> Column:
        w = by_time()
        o, c, po, pc = F.col("open"), F.col("close"), F.lag("open").over(w), F.lag("close").over(w)
        up, before = c > o, pc > po
        return (
            F.when(po.isNull(), F.lit(None).cast("int"))
            .when(up == before, 0)
            .when(up & (o < pc) & (c > po), 1)
            .when(~up & (o > pc) & (c < po), -1)
            .otherwise(0)
        )

    return FeatureSpec("engulfing_candle", 2, build, kernel=("engulfing_candle", {}), whole=True)


def swing_highlow(period: int) -> FeatureSpec:
    """Marker of the bar period / 2 back: 1 a swing high, -1 a low, 0 neither or both."""
    p = _period(period)
    if p % 2:
        raise ValueError("period must be even")

    def build() -> Column:
        lb, w = p // 2, by_time()
        high, low = F.lag("high", lb).over(w), F.lag("low", lb).over(w)
        left, right = w.rowsBetween(-p, -lb - 1), w.rowsBetween(-lb + 1, 0)
        is_high = (high > F.max("high").over(left)) & (high > F.max("high").over(right))
        is_low = (low < F.min("low").over(left)) & (low < F.min("low").over(right))
        enough = F.count(F.lit(1)).over(w.rowsBetween(-p, 0)) == p + 1
        return F.when(enough, F.when(is_high & ~is_low, 1).when(is_low & ~is_high, -1).otherwise(0))

    return FeatureSpec(f"swing_highlow_{p}", p + 1, build, kernel=("swing_highlow", {"period": p}), whole=True)


def named_column(name: str) -> Column:
    """The column of a name that may have dots, as ``ema_5_s1.5``."""
    return F.col(f"`{name}`")


def difference(a: str, b: str) -> FeatureSpec:
    """One feature less another, as of a fast and a slow average."""
    return FeatureSpec(f"{a}_minus_{b}", 1, lambda: round6(named_column(a) - named_column(b)), (a, b), ("difference", {"a": a, "b": b}))


def mean_of(source: str, period: int) -> FeatureSpec:
    """Mean of a feature's last ``period`` values; null while one of them is."""
    p = _period(period)

    def build() -> Column:
        w, c = last_rows(p), named_column(source)
        return F.when(F.count(c).over(w) == p, round6(F.avg(c).over(w)))

    return FeatureSpec(f"{source}_mean_{p}", p, build, (source,), ("mean_of", {"source": source, "period": p}))


BUILDERS = {
    "sma": sma, "ema": ema, "rsi": rsi, "vwap": vwap, "engulfing_candle": engulfing_candle, "swing_highlow": swing_highlow,
    "difference": difference, "mean_of": mean_of,
}


def spec(kind: str, **params) -> FeatureSpec:
    """A spec from plain data; an unknown kind or key is an error."""
    if kind not in BUILDERS:
        raise ValueError(f"unknown feature {kind!r}")
    known = BUILDERS[kind].__code__.co_varnames[: BUILDERS[kind].__code__.co_argcount]
    extra = sorted(set(params) - set(known))
    if extra:
        raise ValueError(f"unknown option for {kind}: {', '.join(extra)}")
    return BUILDERS[kind](**params)


def stages(specs: Iterable[FeatureSpec], columns: Iterable[str] = ()) -> list[list[FeatureSpec]]:
    """The specs in as few rounds as their dependencies are deep; a round needs what earlier ones made.

    ``columns`` are there from the start. Within a round the given order stays. Duplicate ids,
    needs that nothing meets, and cycles (named with their members) are errors.
    """
    left, have, rounds = list(specs), set(columns), []
    ids = [s.id for s in left]
    if len(set(ids)) != len(ids):
        raise ValueError(f"duplicate feature ids: {sorted(i for i in set(ids) if ids.count(i) > 1)}")
    missing = [d for s in left for d in s.depends if d not in ids and d not in have]
    if missing:
        raise ValueError(f"features need columns that are not there: {missing}")
    have -= set(ids)  # a feature stands before a column of its name
    while left:
        ready = [s for s in left if have.issuperset(s.depends)]
        if not ready:
            raise ValueError(f"features depend on each other in a cycle: {' -> '.join(_cycle(left))}")
        rounds.append(ready)
        have.update(s.id for s in ready)
        left = [s for s in left if s.id not in have]
    return rounds


def _cycle(specs: list[FeatureSpec]) -> list[str]:
    """One cycle among specs none of which can go first: following needs must come round."""
    needs = {s.id: s.depends for s in specs}
    path = [specs[0].id]
    while True:
        then = next(d for d in needs[path[-1]] if d in needs)
        if then in path:
            return [*path[path.index(then) :], then]
        path.append(then)


def history(rounds: list[list[FeatureSpec]]) -> int:
    """Bars that the specs look back on, along their dependencies."""
    reach: dict[str, int] = {}
    for s in (s for r in rounds for s in r):
        reach[s.id] = s.lookback + max((reach.get(d, 0) for d in s.depends), default=0)
    return max(reach.values(), default=1)


def feature_chain(bars: DataFrame, specs: Iterable[FeatureSpec], chunk_rows: int | None = None, kernels: bool = False) -> DataFrame:
    """``bars`` with one column for each spec: one exchange and one sort for all of them.

    Specs may depend on each other in any order of the list; each round of ``stages`` is one
    select, and all of them share the exchange. With ``chunk_rows`` a symbol's bars are dealt to
    chunks of so many, each with the bars before it that features look back on, so that one
    long symbol spreads over many tasks. With ``kernels`` numpy computes the features, over Arrow
    batches of sorted partitions, which pays for long periods. The result is the same for bars without nulls.
    """
    specs = list(specs)
    rounds, ids = stages(specs, bars.columns), [s.id for s in specs]
    if chunk_rows:
        chunked = with_history(numbered(bars, chunk_rows), chunk_rows, history(rounds))
        named = chunked.withColumn("_symbol", F.col("symbol")).withColumn("symbol", F.concat_ws("\x00", "symbol", "_chunk"))
        out = feature_chain(named, specs, kernels=kernels).filter("not _history")
        return out.select(*[named_column("_symbol" if c == "symbol" else c).alias(c) for c in bars.columns], *map(named_column, ids))
    if kernels:
        return _by_kernels(bars, rounds, ids)
    out = bars.withColumn("_change", F.col("close") - F.lag("close").over(by_time()))
    for ready in rounds:
        out = out.select("*", *[s.column() for s in ready])
    return out.select(*map(named_column, [*bars.columns, *ids]))


#: Columns that kernels read.
_NUMBERS = ("open", "high", "low", "close", "volume")


def _by_kernels(bars: DataFrame, rounds: list[list[FeatureSpec]], ids: list[str]) -> DataFrame:
    """Kernels over each symbol's bars, a batch at a time behind the tail of bars that features look back on."""
    specs, keep = [s for r in rounds for s in r], history(rounds)
    lacking = [s.id for s in specs if s.kernel is None]
    if lacking:
        raise ValueError(f"features without a kernel: {', '.join(lacking)}")
    ints = {s.id for s in specs if s.whole}

    def segments(batch: pa.RecordBatch) -> list[int]:
        """Where symbol or timeframe change."""
        n, new = batch.num_rows, np.zeros(batch.num_rows, bool)
        for k in KEYS:
            codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return [0, *np.flatnonzero(new).tolist(), n]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, tail = None, {c: np.zeros(0) for c in _NUMBERS}
        for batch in batches:
            if not batch.num_rows:
                continue
            numbers = {c: batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in _NUMBERS}
            made: dict[str, list] = {i: [] for i in ids}
            cuts = segments(batch)
            for a, b in zip(cuts, cuts[1:]):
                key = tuple(batch.column(k)[a].as_py() for k in KEYS)
                if key != now:
                    now, tail = key, {c: np.zeros(0) for c in _NUMBERS}
                old = len(tail["close"])
                have = {c: np.concatenate([tail[c], numbers[c][a:b]]) for c in _NUMBERS}
                for s in specs:
                    kind, options = s.kernel
                    have[s.id] = KERNELS[kind](have, **options)
                    made[s.id].append(have[s.id][old:])
                tail = {c: have[c][-keep:] for c in _NUMBERS}
            values = {i: np.concatenate(v) for i, v in made.items()}
            columns = [pa.array(np.nan_to_num(v).astype("int32") if i in ints else v, mask=np.isnan(v)) for i, v in values.items()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *ids])

    types = [T.StructField(i, T.IntegerType() if i in ints else T.DoubleType()) for i in ids]
    dealt = bars.repartition(*KEYS).sortWithinPartitions(*KEYS, "close_ts")
    return dealt.mapInArrow(run, T.StructType([*bars.schema.fields, *types]))


def numbered(bars: DataFrame, chunk_rows: int) -> DataFrame:
    """``bars`` with ``bar_idx``, their number (from 0) within symbol and timeframe.

    Bars are numbered within stretches of time that hold about ``chunk_rows``; a table of one
    row a stretch gives what comes before. No window holds a whole symbol's bars.
    """
    step = F.coalesce(F.create_map(*[F.lit(x) for kv in TIMEFRAMES.items() for x in kv])[F.col("timeframe")], F.lit(TIMEFRAMES["1m"])).cast("long")
    b = bars.withColumn("_t", F.floor(F.col("close_ts") / (step * chunk_rows)))
    before = F.sum("_n").over(Window.partitionBy(*KEYS).orderBy("_t").rowsBetween(Window.unboundedPreceding, -1))
    offsets = b.groupBy(*KEYS, "_t").agg(F.count("*").alias("_n")).select(*KEYS, "_t", F.coalesce(before, F.lit(0)).alias("_before"))
    here = F.row_number().over(Window.partitionBy(*KEYS, "_t").orderBy("close_ts"))
    return b.withColumn("_i", here).join(offsets, [*KEYS, "_t"]).withColumn("bar_idx", F.col("_before") + F.col("_i") - 1).select(*bars.columns, "bar_idx")


def with_history(bars: DataFrame, chunk_rows: int, lookback: int) -> DataFrame:
    """Bars under ``_chunk``, and once more (``_history``) under each later chunk that looks back on them."""
    own = F.floor(F.col("bar_idx") / chunk_rows)
    last = F.floor((F.col("bar_idx") + lookback) / chunk_rows)
    return bars.withColumn("_chunk", F.explode(F.sequence(own, last))).withColumn("_history", F.col("_chunk") > own)
