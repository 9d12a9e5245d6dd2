"""Swings, trend and pullback signals as plain window functions.

The pullback strategy is sequential as described (a flag is set by a pullback, cleared by a
signal or a new high). Here it is set-based: a new high opens a segment, trend bars part a
segment into blocks, and a trend bar signals when its block has a pullback bar up to it,
for after any trend bar the flag is down. Segments and blocks refine the symbol key, so
all windows reuse one exchange.

With ``chunk_rows`` the same results come from scans over chunks of so many bars (``scan``), so
that one long symbol spreads over many tasks. A run's length is the distance to the last bar
that broke it, a run of swings is the count of swings since the last one that did not rise,
and the flag is up where the last pullback is no older than the last new high and newer
than the last trend bar: all of them are maxima, sums and last values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import KEYS, by_time
from .scan import CHUNK, Scan, in_chunks, scan


def swing_columns(lookback: int = 2, keys=KEYS) -> dict[str, Column]:
    """swing_high, swing_low: price of the bar ``lookback`` back where it is one, known only now."""
    lb, w = lookback, by_time(keys)
    left, right = w.rowsBetween(-2 * lb, -lb - 1), w.rowsBetween(-lb + 1, 0)
    full = F.count(F.lit(1)).over(w.rowsBetween(-2 * lb, 0)) == 2 * lb + 1
    high, low = F.lag("high", lb).over(w), F.lag("low", lb).over(w)
    is_high = full & (high > F.max("high").over(left)) & (high > F.max("high").over(right))
    is_low = full & (low < F.min("low").over(left)) & (low < F.min("low").over(right))
    return {"swing_high": F.when(is_high, high), "swing_low": F.when(is_low, low)}


def swing_points(bars: DataFrame, lookback: int = 2) -> DataFrame:
    """symbol, close_ts (of the confirming bar), kind, price."""
    s = bars.withColumns(swing_columns(lookback)).select(*KEYS, "close_ts", "swing_high", "swing_low")
    return s.unpivot([*KEYS, "close_ts"], ["swing_high", "swing_low"], "kind", "price").filter("price is not null")


def _run(bars: DataFrame, good: Column, out: str) -> DataFrame:
    """Length of the current run of rows for which ``good`` holds, 0 elsewhere."""
    w = by_time()
    b = bars.withColumn("_good", F.coalesce(good, F.lit(False)))
    b = b.withColumn("_island", F.sum(F.when(F.col("_good"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*KEYS, "_island").orderBy("close_ts").rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn(out, F.sum(F.col("_good").cast("long")).over(inside)).drop("_good", "_island")


def _rises(keys=KEYS) -> Column:
    return F.coalesce(F.col("close") > F.lag("close").over(by_time(keys)), F.lit(False))


def _broken(rises: str = "_rises") -> Scan:
    """Number of the last bar that did not rise."""
    return Scan("max", F.when(~F.col(rises), F.col("bar_idx")))


def _run_length() -> Column:
    return (F.col("bar_idx") - F.coalesce("_broken", F.lit(-1))).cast("long")


def consecutive_up(bars: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    if chunk_rows:
        b = scan(in_chunks(bars, chunk_rows, 1, {"_rises": _rises(CHUNK)}), {"_broken": _broken()})
        return b.select(*bars.columns, _run_length().alias("consecutive_up"))
    return _run(bars, _rises(), "consecutive_up")


def recent_high(bars: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    if chunk_rows:
        return scan(in_chunks(bars, chunk_rows, 0, {}), {"recent_high": Scan("max", F.col("high"))}).select(*bars.columns, "recent_high")
    return bars.withColumn("recent_high", F.max("high").over(by_time().rowsBetween(Window.unboundedPreceding, 0)))


def _depth() -> Column:
    return F.try_divide(F.col("recent_high") - F.col("close"), "recent_high")


def pullback_depth(bars: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """How far the close lies under the highest high so far; null while that is zero."""
    return recent_high(bars, chunk_rows).withColumn("pullback_depth", _depth())


def _swing_runs(bars: DataFrame, price: str, out: str) -> DataFrame:
    """Length of the current run of rising swing prices, carried to every bar."""
    upto = by_time().rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(price, ignorenulls=True).over(upto)
    b = bars.withColumn("_rise", F.when(F.col(price).isNotNull(), F.coalesce(F.col(price) > before, F.lit(False))))
    every = by_time().rowsBetween(Window.unboundedPreceding, 0)
    b = b.withColumn("_island", F.sum(F.when(~F.col("_rise"), 1).otherwise(0)).over(every))
    inside = Window.partitionBy(*KEYS, "_island").orderBy("close_ts").rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum(F.when(F.col("_rise"), 1).otherwise(0)).over(inside)
    return b.withColumn(out, n.cast("long")).drop("_rise", "_island")


def _maturity(early: int, confirmed: int, mature: int) -> Column:
    both = F.least("higher_highs", "higher_lows")
    return F.when(both >= mature, "mature").when(both >= confirmed, "confirmed").when(F.col("consecutive_up") >= early, "early").otherwise("none")


def _trend_in_chunks(bars: DataFrame, chunk_rows: int, early: int, confirmed: int, mature: int, lookback: int, strict_legacy: bool) -> DataFrame:
    """The columns of ``trend_maturity`` and ``pullback_depth``, with ``bar_idx``, ``_chunk`` and ``_before_high``."""
    swings = swing_columns(lookback, CHUNK)
    if strict_legacy:
        swings["swing_high"] = F.lit(None).cast("double")
    b = in_chunks(bars, chunk_rows, 2 * lookback + 1, {"_rises": _rises(CHUNK), **swings})
    kinds = ("swing_high", "swing_low")
    b = scan(b, {
        "_broken": _broken(), "recent_high": Scan("max", F.col("high")), "_before_high": Scan("max", F.col("high"), before=True),
        **{f"_last_{k}": Scan("last", F.col(k), before=True) for k in kinds}, **{f"_n_{k}": Scan("sum", F.col(k).isNotNull().cast("long")) for k in kinds},
    })
    # swings so far, at the last one that did not rise
    fell = {k: F.when(F.col(k).isNotNull() & ~F.coalesce(F.col(k) > F.col(f"_last_{k}"), F.lit(False)), F.col(f"_n_{k}")) for k in kinds}
    b = scan(b, {f"_base_{k}": Scan("max", fell[k]) for k in kinds})
    runs = {name: F.col(f"_n_{k}") - F.coalesce(f"_base_{k}", F.lit(0)) for name, k in zip(("higher_highs", "higher_lows"), kinds)}
    b = b.withColumns({**runs, "consecutive_up": _run_length(), "pullback_depth": _depth()})
    return b.withColumn("maturity", _maturity(early, confirmed, mature))


def trend_maturity(
    bars: DataFrame, early: int = 3, confirmed: int = 2, mature: int = 3, lookback: int = 2, strict_legacy: bool = False, chunk_rows: int | None = None
) -> DataFrame:
    """Add higher_highs, higher_lows, consecutive_up and maturity (none, early, confirmed, mature).

    ``strict_legacy`` turns swing highs off, so that only early trends appear.
    """
    if chunk_rows:
        b = _trend_in_chunks(bars, chunk_rows, early, confirmed, mature, lookback, strict_legacy)
        return b.select(*bars.columns, "consecutive_up", "higher_highs", "higher_lows", "maturity")
    b = consecutive_up(bars.withColumns(swing_columns(lookback)))
    if strict_legacy:
        b = b.withColumn("swing_high", F.lit(None).cast("double"))
    b = _swing_runs(_swing_runs(b, "swing_high", "higher_highs"), "swing_low", "higher_lows")
    return b.withColumn("maturity", _maturity(early, confirmed, mature)).drop("swing_high", "swing_low")


def _hits_in_chunks(b: DataFrame, pullback: float) -> DataFrame:
    """Trend bars at which the flag is up, of the bars of ``_trend_in_chunks``."""
    new, trend = F.coalesce(F.col("high") > F.col("_before_high"), F.lit(True)), F.col("maturity") != "none"
    at = lambda c: F.when(c, F.col("bar_idx"))
    b = scan(b, {
        "_pulled": Scan("max", at(F.col("pullback_depth") >= pullback)), "_opened": Scan("max", at(new)), "_trended": Scan("max", at(trend), before=True),
    })
    return b.filter(trend & (F.col("_pulled") >= F.col("_opened")) & (F.col("_pulled") > F.coalesce("_trended", F.lit(-1))))


def buy_the_dip(
    bars: DataFrame, early: int = 3, confirmed: int = 2, mature: int = 3, pullback: float = 0.03, lookback: int = 2, strict_legacy: bool = False,
    chunk_rows: int | None = None,
) -> DataFrame:
    """Signals: symbol, timeframe, side, ts, expires_at, source, metadata."""
    if chunk_rows:
        hit = _hits_in_chunks(_trend_in_chunks(bars, chunk_rows, early, confirmed, mature, lookback, strict_legacy), pullback)
    else:
        hit = _hits(trend_maturity(pullback_depth(bars), early, confirmed, mature, lookback, strict_legacy), pullback)
    return hit.select(
        *KEYS, F.lit("buy").alias("side"), F.col("close_ts").alias("ts"), F.lit(0).cast("long").alias("expires_at"),
        F.lit("buy_the_dip").alias("source"),
        F.struct(
            F.col("maturity").alias("trend_maturity"), "pullback_depth", "recent_high",
            F.col("higher_highs").cast("int").alias("swing_high_count"), F.col("higher_lows").cast("int").alias("swing_low_count"),
        ).alias("metadata"),
    )


def _hits(b: DataFrame, pullback: float) -> DataFrame:
    """Trend bars at which the flag is up, by segments and blocks."""
    w = by_time()
    before = F.lag("recent_high").over(w)
    b = b.withColumn("_new", F.coalesce(F.col("high") > before, F.lit(True)))
    b = b.withColumn("_segment", F.sum(F.col("_new").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    b = b.withColumn("_trend", F.col("maturity") != "none").withColumn("_pull", (F.col("pullback_depth") >= pullback).cast("int"))
    seg = Window.partitionBy(*KEYS, "_segment").orderBy("close_ts").rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("_block", F.coalesce(F.sum(F.col("_trend").cast("int")).over(seg), F.lit(0)))
    blk = Window.partitionBy(*KEYS, "_segment", "_block").orderBy("close_ts").rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("_hit", F.max("_pull").over(blk)).filter(F.col("_trend") & (F.col("_hit") == 1))
