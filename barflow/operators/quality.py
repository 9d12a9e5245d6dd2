"""Checks, filters and presentation of bars."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.schema import BAR_COLUMNS, KEYS, by_time, step_ms


def drop_malformed(bars: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Bars with a closing time other than 0 or null; ``seen`` is told how many were dropped."""
    good = F.coalesce(F.col("close_ts") != 0, F.lit(False))
    if seen is not None:
        bars = bars.observe(seen, F.sum((~good).cast("long")).alias("dropped"), F.count(F.lit(1)).alias("bars"))
    return bars.filter(good)


def quarantine(df: DataFrame, checks: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every check, and the others with ``reason`` (the first check failed)."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()])
    marked = df.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def time_window(bars: DataFrame, start_ms: int = 0, end_ms: int = 0) -> DataFrame:
    """Bars that open in [start, end]; 0 leaves a side open."""
    if start_ms < 0 or end_ms < 0 or (start_ms and end_ms and end_ms <= start_ms):
        raise ValueError("the time window is inverted or negative")
    if start_ms:
        bars = bars.filter(F.col("open_ts") >= start_ms)
    return bars.filter(F.col("open_ts") <= end_ms) if end_ms else bars


def date_range(df: DataFrame, ts: str, start: str | None = None, end: str | None = None) -> DataFrame:
    if start:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp"))
    return df.filter(F.col(ts) <= F.lit(end).cast("timestamp")) if end else df


def dedupe_bars(bars: DataFrame, seq: str) -> DataFrame:
    """One bar for each key and close: the first to arrive by ``seq``."""
    first = bars.groupBy(*KEYS, "close_ts").agg(F.min_by(F.struct(*bars.columns), seq).alias("b"))
    return first.select("b.*")


def find_gaps(bars: DataFrame, timeframe: str) -> DataFrame:
    """Where consecutive bars lie further apart than a step: gap_start, gap_end (ms), missing."""
    step = step_ms(timeframe)
    nxt = bars.select(*KEYS, "open_ts", F.lead("open_ts").over(by_time()).alias("next"))
    gaps = nxt.filter(F.col("next") - F.col("open_ts") > step)
    return gaps.select(
        *KEYS, (F.col("open_ts") + step).alias("gap_start"), (F.col("next") - 1).alias("gap_end"),
        F.expr(f"(next - open_ts) div {step} - 1").cast("long").alias("missing"),
    )


def fan_in(*dfs: DataFrame) -> DataFrame:
    """Everything of every input, duplicates included."""
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def limit_bars(bars: DataFrame, n: int) -> DataFrame:
    """The first n bars of each symbol; 0 is no limit."""
    if n == 0:
        return bars
    return bars.withColumn("_n", F.row_number().over(by_time())).filter(F.col("_n") <= n).drop("_n")


def last_n(bars: DataFrame, n: int) -> DataFrame:
    """The newest n bars of each symbol, numbered from the newest."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc("close_ts"))
    return bars.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def sort_events(df: DataFrame) -> DataFrame:
    return df.orderBy("close_ts", *KEYS)


def volume_direction(bars: DataFrame) -> DataFrame:
    return bars.withColumn("direction", F.when(F.col("close") >= F.col("open"), "up").otherwise("down"))


def pattern_markers(enriched: DataFrame, pattern: str) -> DataFrame:
    """Marker points: below the low of a bullish bar, above the high of a bearish one."""
    m = F.col(pattern)
    y = F.when(m == 1, F.col("low") * 0.998).when(m == -1, F.col("high") * 1.002)
    kind = F.when(m == 1, "bullish").when(m == -1, "bearish")
    return enriched.filter(m.isin(1, -1)).select("symbol", "close_ts", y.alias("y"), kind.alias("kind"))


def unpivot_features(enriched: DataFrame, features: list[str]) -> DataFrame:
    """symbol, close_ts, feature, value; absent features give no row."""
    wide = enriched.select("symbol", "close_ts", *[F.col(f).cast("double").alias(f) for f in features])
    return wide.unpivot(["symbol", "close_ts"], features, "feature", "value").filter("value is not null")


def export_summary(df: DataFrame) -> DataFrame:
    """Span, row count and number of filled indicator columns of each key."""
    extra = [c for c in df.columns if c not in BAR_COLUMNS]
    filled = sum((F.max(F.col(c).isNotNull().cast("int")) for c in extra), F.lit(0)).cast("long")
    return df.groupBy(*KEYS).agg(
        F.min("close_ts").alias("min_ts"), F.max("close_ts").alias("max_ts"), F.count("*").alias("n_rows"), filled.alias("n_indicators")
    )


#: Which indicator is drawn where, by its name; the first match wins.
INDICATOR_KINDS = {
    "overlay": r"^(sma|ema|ma[_\d]|bb|vwap)",
    "oscillator": r"^(rsi|macd|stoch|cci|mfi|adx)",
    "candle": r"_candle$",
}


def classify_indicators(columns: list[str], only: list[str] | None = None) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {k: [] for k in INDICATOR_KINDS}
    for c in columns:
        if c in BAR_COLUMNS or (only is not None and c not in only):
            continue
        kind = next((k for k, p in INDICATOR_KINDS.items() if re.search(p, c, re.I)), None)
        if kind:
            out[kind].append(c)
    return out
