"""As-of prices, aligned symbols, parameter expansion and walk windows."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import KEYS


def asof_price(events: DataFrame, bars: DataFrame, ts: str, bucket_ms: int = 86_400_000) -> DataFrame:
    """``events`` with ``price``: the close of the last bar closed by then (null before the first).

    Of the event's symbol, and of its timeframe if events have one; else bars of any timeframe
    count, the longest of those that close at one time. A union and windows over (symbol,
    bucket of time), with the last price of the buckets before in a table of one row a bucket:
    no range join, and a symbol with most of the rows spreads over its buckets.
    """
    keys = [c for c in KEYS if c in events.columns]
    opened = F.col("open_ts") if "open_ts" in bars.columns else F.col("close_ts")
    e = events.select(*keys, F.col(ts).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast("double").alias("_p"), F.struct(*events.columns).alias("_e"))
    b = bars.select(*keys, F.col("close_ts").alias("_t"), F.lit(0).alias("_kind"), F.col("close").alias("_p"), opened.alias("_o"))
    both = e.unionByName(b, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_t") / bucket_ms))
    newest = F.max_by("_p", F.when(F.col("_p").isNotNull(), F.struct(F.col("_t"), -F.col("_o"))))
    over = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = both.groupBy(*keys, "_b").agg(newest.alias("_end")).select(*keys, "_b", F.last("_end", ignorenulls=True).over(over).alias("_before"))
    w = Window.partitionBy(*keys, "_b").orderBy("_t", "_kind", F.desc("_o")).rowsBetween(Window.unboundedPreceding, 0)
    here = both.withColumn("_here", F.last("_p", ignorenulls=True).over(w)).filter("_kind = 1")
    same = [here[c].eqNullSafe(before[c]) for c in [*keys, "_b"]]
    return here.join(before, same, "left").select("_e.*", F.coalesce("_here", "_before").alias("price"))


def align_symbols(bars: DataFrame, benchmark: str) -> DataFrame:
    """Bars of every symbol beside the benchmark's close at the same time."""
    ref = bars.filter(F.col("symbol") == benchmark).select("timeframe", "close_ts", F.col("close").alias("ref_close"))
    return bars.filter(F.col("symbol") != benchmark).join(ref, ["timeframe", "close_ts"])


#: Parameter sets that are broadcast at once: a few MB.
SETS = 50_000


def expand_params(bars: DataFrame, params: DataFrame) -> DataFrame:
    """Bars under every parameter set. The sets are counted and broadcast in slices of about
    ``SETS``, so bars stay where they are and no slice outgrows an executor."""
    slices = -(-params.count() // SETS)
    if slices <= 1:
        return bars.crossJoin(F.broadcast(params))  # a sweep is the product of both
    part = F.pmod(F.xxhash64(*params.columns), F.lit(slices))
    return reduce(DataFrame.unionByName, [bars.crossJoin(F.broadcast(params.filter(part == i))) for i in range(slices)])


def walk_windows(bars: DataFrame, train: int, test: int, step: int, anchored: bool = False) -> DataFrame:
    """Bars with the walk-forward windows they are in: window_id, part (train or test).

    Window k trains on bars [k * step, k * step + train) (from 0 if anchored) and tests on
    the next ``test`` bars. A bar finds its windows by arithmetic: no range join.
    """
    idx = F.row_number().over(Window.partitionBy("symbol", "timeframe").orderBy("close_ts")) - 1
    b = bars.withColumn("bar_idx", idx.cast("long"))
    n = F.count(F.lit(1)).over(Window.partitionBy("symbol", "timeframe"))
    b = b.withColumn("_last", F.expr("0L") + F.floor((n - train - test) / step))  # the last whole window
    end = F.floor(F.col("bar_idx") / step)
    low = F.greatest(F.lit(0), F.ceil((F.col("bar_idx") - (train + test) + 1) / step)).cast("long")
    high = F.col("_last") if anchored else F.least(F.col("_last"), end)
    k = b.filter("_last >= 0").withColumn("_low", low).withColumn("_high", high.cast("long"))
    k = k.filter("_low <= _high").withColumn("window_id", F.explode(F.sequence("_low", "_high")))
    part = F.when(F.col("bar_idx") < F.col("window_id") * step + train, "train").otherwise("test")
    return k.withColumn("part", part).drop("_low", "_high", "_last")


def missing_samples(samples: DataFrame, results: DataFrame) -> DataFrame:
    """Samples without a result."""
    return samples.join(results.select("sample_id"), "sample_id", "left_anti")


def check_complete(samples: DataFrame, results: DataFrame, limit: float = 0.05) -> int:
    """How many samples lack a result: a warning below a share of ``limit``, an error from there on."""
    total, missing = samples.count(), missing_samples(samples, results).count()
    if missing and missing >= limit * total:
        raise ValueError(f"{missing} of {total} samples have no result ({missing / total:.1%}): run them again")
    if missing:
        warnings.warn(f"{missing} of {total} samples have no result ({missing / total:.1%})", stacklevel=2)
    return missing


def expire_signals(signals: DataFrame, at: int) -> DataFrame:
    """Signals still good at ``at``; expiry 0 or null is never."""
    e = F.coalesce("expires_at", F.lit(0))
    return signals.filter((e == 0) | (e >= at))
