"""Ticks to bars, finer bars to coarser ones, and bars out of tick-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import step_ms, to_ms


def ticks_to_bars(df: DataFrame, ts: str, symbol: str, price: str, size: str, timeframe: str, tie: list[str]) -> DataFrame:
    """OHLCV bars. First and last price are by (ts, tie); one shuffle, pre-aggregated.

    A hot symbol spreads over its time buckets, so no task holds a whole symbol.
    """
    step = step_ms(timeframe)
    ms = to_ms(F.col(ts))
    t = df.select(
        F.col(symbol).cast("string").alias("symbol"), F.floor(ms / step).cast("long").alias("b"),
        F.expr(price).cast("double").alias("p"), F.expr(size).cast("double").alias("v"), F.struct(ms.alias("ms"), *tie).alias("at"),
    )
    bars = t.groupBy("symbol", "b").agg(
        F.min_by("p", "at").alias("open"), F.max("p").alias("high"), F.min("p").alias("low"),
        F.max_by("p", "at").alias("close"), F.sum("v").alias("volume"),
    )
    return bars.select(
        "symbol", F.lit(timeframe).alias("timeframe"), (F.col("b") * step).alias("open_ts"),
        (F.col("b") * step + step - 1).alias("close_ts"), "open", "high", "low", "close", "volume",
    )


def rollup_bars(bars: DataFrame, to_timeframe: str) -> DataFrame:
    """Coarser bars: first open, last close, extremes and sums."""
    step = step_ms(to_timeframe)
    b = bars.withColumn("b", F.floor(F.col("open_ts") / step).cast("long"))
    out = b.groupBy("symbol", "b").agg(
        F.min_by("open", "open_ts").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "open_ts").alias("close"), F.sum("volume").alias("volume"),
    )
    return out.select(
        "symbol", F.lit(to_timeframe).alias("timeframe"), (F.col("b") * step).alias("open_ts"),
        (F.col("b") * step + step - 1).alias("close_ts"), "open", "high", "low", "close", "volume",
    )


def event_bars(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ticks_to_bars(df, "ts", "event_type", "value", "1.0", timeframe, ["event_id"])


def user_bars(spark: SparkSession, sf_dir: str, timeframe: str = "1h") -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ticks_to_bars(df, "ts", "user_id", "value", "1.0", timeframe, ["event_id"])


def line_bars(spark: SparkSession, sf_dir: str, timeframe: str = "1d") -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return ticks_to_bars(
        df, "l_shipdate", "l_suppkey", "try_divide(l_extendedprice, l_quantity)", "l_quantity", timeframe,
        ["l_orderkey", "l_linenumber", "l_partkey"],
    )
