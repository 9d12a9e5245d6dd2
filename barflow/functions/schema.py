"""Bars, timeframes and keys.

A bar row: symbol, timeframe, open_ts, close_ts (epoch milliseconds), open, high, low,
close, volume. ``KEYS`` are the grouping keys of every rolling operator.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: The closed set of timeframes, in milliseconds.
TIMEFRAMES = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "1h": 3_600_000, "1d": 86_400_000}

KEYS = ("symbol", "timeframe")

BAR_COLUMNS = ("symbol", "timeframe", "open_ts", "close_ts", "open", "high", "low", "close", "volume")


def step_ms(timeframe: str) -> int:
    if timeframe not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {timeframe!r}; one of {', '.join(TIMEFRAMES)}")
    return TIMEFRAMES[timeframe]


def by_time(keys=KEYS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("close_ts")


def last_rows(n: int, keys=KEYS) -> WindowSpec:
    """The current bar and the n - 1 before it."""
    return by_time(keys).rowsBetween(-(n - 1), 0)


def round6(c: Column) -> Column:
    """Half away from zero at six decimals.

    A sum's last bits depend on its order; nine decimals first, so that they can't turn a
    tie. No negative zero.
    """
    return F.round(F.round(c * 1e6, 3), 0) / 1e6 + F.lit(0.0)


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def from_ms(c: Column) -> Column:
    return F.timestamp_millis(c)


def to_ms(c: Column) -> Column:
    return F.unix_millis(c.cast("timestamp"))


def bars_per_year(timeframe: str) -> float:
    """Of a 365-day year."""
    return 365 * 86_400_000 / step_ms(timeframe)
