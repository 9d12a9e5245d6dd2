"""Parameter sets, sweeps, walk-forward selection and the gate over all of it."""

from __future__ import annotations

from collections.abc import Iterable
from math import prod

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.schema import KEYS
from .backtest import MODULUS, bar_returns, mixed, null_test
from .joins import SETS, expand_params
from .nulls import from_seeds
from .sequences import permuted


def _whole(df: DataFrame, names: Iterable[str]) -> DataFrame:
    return df.withColumns({c: F.rint(c) for c in names})


def grid(spark: SparkSession, axes: dict[str, list[float]], ints: Iterable[str] = ()) -> DataFrame:
    """Every combination of the axes' values, numbered in the axes' order; ``ints`` are rounded half to even."""
    n, stride, columns = prod(map(len, axes.values())), 1, []
    for name, vs in reversed(axes.items()):
        columns.append(F.get(F.array(*[F.lit(float(v)) for v in vs]), F.floor(F.col("id") / stride).cast("int") % len(vs)).alias(name))
        stride *= len(vs)
    return _whole(spark.range(n).select(F.col("id").alias("param_id"), *reversed(columns)), ints)


def lhs_params(spark: SparkSession, bounds: dict[str, tuple[float, float]], n: int, seed: int = 0, ints: Iterable[str] = ()) -> DataFrame:
    """Latin hypercube: in each dimension every one of n strata is used once; ``ints`` are rounded half to even.

    A set's stratum in a dimension is a keyed permutation of its number: sets need not know each other.
    """
    df = spark.range(n).withColumnRenamed("id", "param_id")
    for k, (name, (lo, hi)) in enumerate(bounds.items()):
        df = permuted(df, "param_id", n, 1000 * seed + 10 * k, f"_s{k}")
        jitter = F.expr(f"(({mixed('param_id', str(1000 * seed + 500 + k))}) + 0.5) / {MODULUS}")
        df = df.withColumn(name, F.lit(float(lo)) + (F.col(f"_s{k}") + jitter) / n * (hi - lo)).drop(f"_s{k}")
    return _whole(df, ints)


def random_params(spark: SparkSession, bounds: dict[str, tuple[float, float]], n: int, seed: int = 0, ints: Iterable[str] = ()) -> DataFrame:
    """Independent uniform sets, each from its number; ``ints`` are rounded half to even."""
    u = {name: F.expr(f"(({mixed('param_id', str(1000 * seed + 700 + k))}) + 0.5) / {MODULUS}") for k, name in enumerate(bounds)}
    df = spark.range(n).withColumnRenamed("id", "param_id")
    return _whole(df.select("param_id", *[(F.lit(float(lo)) + u[name] * (hi - lo)).alias(name) for name, (lo, hi) in bounds.items()]), ints)


def threshold_returns(bars: DataFrame, params: DataFrame) -> DataFrame:
    """Each bar under each parameter set: long for a bar after a fall of ``entry`` or more.

    The fall is over one bar, or over ``lookback`` bars where the sets have that column. Falls
    are computed once for each lookback; parameter sets only compare with them. A fall from a
    zero close is none. Bars are numbered (``bar_idx``) before they meet the sets.
    """
    w = Window.partitionBy(*KEYS).orderBy("close_ts")
    most = int(params.agg(F.max("lookback")).first()[0] or 1) if "lookback" in params.columns else 1
    falls = F.array(*[1 - F.try_divide("close", F.lag("close", k).over(w)) for k in range(1, most + 1)])
    index = F.row_number().over(w).cast("long") - 1
    e = expand_params(bar_returns(bars).select(*KEYS, "close_ts", "ret", index.alias("bar_idx"), falls.alias("_falls")), params)
    fall = F.get("_falls", (F.col("lookback") - 1).cast("int") if "lookback" in params.columns else F.lit(0))
    pos = F.coalesce((fall >= F.col("entry")).cast("int"), F.lit(0))
    net = pos * F.coalesce("ret", F.lit(0.0)) - pos * F.col("cost_bps") / 1e4
    return e.select("param_id", "symbol", "timeframe", "close_ts", "bar_idx", pos.alias("position"), net.alias("ret"))


def param_sweep(bars: DataFrame, params: DataFrame) -> DataFrame:
    """Bars, trades, total and mean-over-deviation of each parameter set, symbol and timeframe."""
    r = threshold_returns(bars, params)
    sd = F.nullif(F.stddev_samp("ret"), F.lit(0.0))
    return r.groupBy("param_id", *KEYS).agg(
        F.count("*").alias("n_bars"), F.sum("position").cast("long").alias("n_trades"), F.sum("ret").alias("total"), (F.avg("ret") / sd).alias("sharpe")
    )


#: How far each parameter is moved.
FACTORS = (0.85, 0.9, 0.95, 1.0, 1.05, 1.1, 1.15)


def perturb(params: DataFrame, names: str | list[str], factors=FACTORS, combined: bool = False) -> DataFrame:
    """Each parameter set with parameters scaled: base_id, factor, moved (the name, or ``all``).

    Each of ``names`` alone; with ``combined`` also all of them by the same factor at once.
    """
    names = [names] if isinstance(names, str) else names
    moves = [*names, *["all"] * combined]
    tags = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(m).alias("moved"), F.lit(f).alias("factor")) for i, (m, f) in enumerate((m, f) for m in moves for f in factors)])
    p = params.withColumnRenamed("param_id", "base_id").withColumn("_t", F.explode(tags))
    p = p.withColumns({n: F.when(F.col("_t.moved").isin(n, "all"), F.col(n) * F.col("_t.factor")).otherwise(F.col(n)) for n in names})
    number = (F.col("base_id") * (len(moves) * len(factors)) + F.col("_t.i")).alias("param_id")
    return p.select("base_id", *[c for c in params.columns if c != "param_id"], "_t.factor", "_t.moved", number)


def degradation(metrics: DataFrame, perturbed: DataFrame, metric: str, limit: float = 0.2, within: float = 0.1) -> DataFrame:
    """Loss of each factor against factor 1, and whether those within 10 % lose 20 % at most."""
    m = metrics.join(perturbed.select("param_id", "base_id", "factor", "moved"), "param_id")
    base = m.filter("factor = 1.0").select("base_id", "moved", *KEYS, F.col(metric).alias("_base"))
    m = m.join(base, ["base_id", "moved", *KEYS])
    loss = (F.col("_base") - F.col(metric)) / F.nullif(F.abs("_base"), F.lit(0.0))
    ok = (F.abs(F.col("factor") - 1) > within + 1e-9) | (loss <= limit)
    return m.select("base_id", "moved", *KEYS, "factor", loss.alias("loss"), ok.alias("ok"))


def best_params(metrics: DataFrame, by: list[str], metric: str) -> DataFrame:
    """The parameter set with the largest metric in each group; ties go to the smaller id."""
    return metrics.groupBy(*by).agg(F.max_by("param_id", F.struct(F.col(metric), -F.col("param_id"))).alias("param_id"), F.max(metric).alias(metric))


def _buckets(returns: DataFrame, step: int) -> DataFrame:
    if "bar_idx" in returns.columns:  # numbered already: bars are added up by bucket before anything is shuffled
        return returns.withColumn("_b", F.floor(F.col("bar_idx") / step).cast("long"))
    w = Window.partitionBy("param_id", *KEYS).orderBy("close_ts")
    return returns.withColumn("_b", F.floor((F.row_number().over(w) - 1) / step).cast("long"))


def walk_forward(returns: DataFrame, train: int, test: int, step: int, anchored: bool = False) -> DataFrame:
    """For each symbol, timeframe and window: the best parameter set in training, its result there and next.

    Window k trains on bars [k * step, k * step + train) (from bar 0 if anchored) and tests on
    the next ``test``. ``train`` and ``test`` are multiples of ``step``, so windows are sums of
    step-wide buckets: bars are aggregated once, never joined with windows.
    """
    if train % step or test % step:
        raise ValueError("train and test must be multiples of step")
    b = _buckets(returns, step)
    s = b.groupBy("param_id", *KEYS, "_b").agg(F.count("*").alias("n"), F.sum("ret").alias("s"), F.sum(F.col("ret") * F.col("ret")).alias("q"))
    tr, te = train // step, test // step
    k = Window.partitionBy("param_id", *KEYS).orderBy("_b")
    inside, after = k.rowsBetween(Window.unboundedPreceding if anchored else 0, tr - 1), k.rowsBetween(tr, tr + te - 1)

    def sharpe(win):
        n, total, squares = (F.sum(c).over(win) for c in ("n", "s", "q"))
        mean = total / n
        return mean / F.nullif(F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0))), F.lit(0.0))

    whole = F.col("_b") * step + train if anchored else F.lit(train)
    m = s.select(
        "param_id", *KEYS, "_b", F.col("_b").alias("window_id"), sharpe(inside).alias("train_sharpe"), sharpe(after).alias("test_sharpe"),
        F.sum("s").over(after).alias("test_total"), F.sum("n").over(inside).alias("_tn"), F.sum("n").over(after).alias("_n"),
    ).filter((F.col("_tn") == whole) & (F.col("_n") == test) & F.col("train_sharpe").isNotNull())
    pick = F.struct("train_sharpe", (-F.col("param_id")).alias("_p"))
    return m.groupBy(*KEYS, "window_id").agg(F.max_by(F.struct("param_id", "train_sharpe", "test_sharpe", "test_total"), pick).alias("r")).select(
        *KEYS, "window_id", "r.*"
    )


def stitched(returns: DataFrame, wf: DataFrame, train: int, test: int, step: int) -> DataFrame:
    """The out-of-sample series: each test segment's bars under the parameter set chosen for it.

    Where test segments overlap (``test`` over ``step``), a bar belongs to the newest window.
    symbol, timeframe, window_id, param_id, close_ts, ret.
    """
    tr, te = train // step, test // step
    # the window whose test segment starts at a bucket, else the newest one that still covers it
    chosen = wf.select(*KEYS, "window_id", "param_id", F.explode(F.sequence(F.col("window_id") + tr, F.col("window_id") + tr + te - 1)).alias("_b"))
    newest = chosen.groupBy(*KEYS, "_b").agg(F.max_by(F.struct("window_id", "param_id"), "window_id").alias("r")).select(*KEYS, "_b", "r.*")
    return _buckets(returns, step).join(newest, [*KEYS, "_b", "param_id"]).select(*KEYS, "window_id", "param_id", "close_ts", "ret")


def wf_stability(wf: DataFrame, params: DataFrame | None = None) -> DataFrame:
    """Decay from training to test, and how far the choice moves between windows.

    With ``params`` also the standard deviation of each chosen parameter (``sd_<name>``).
    """
    moves = []
    if params is not None:
        names = [c for c in params.columns if c != "param_id"]
        wf = wf.join(params, "param_id")
        moves = [F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"sd_{c}") for c in names]
    return wf.groupBy(*KEYS).agg(
        F.count("*").alias("n_windows"), F.avg("train_sharpe").alias("train_sharpe"), F.avg("test_sharpe").alias("test_sharpe"),
        (F.avg("train_sharpe") - F.avg("test_sharpe")).alias("decay"), F.countDistinct("param_id").alias("n_params"), *moves,
    )


def null_metrics(null_returns: DataFrame, entry: float, cost_bps: float) -> DataFrame:
    """rep, symbol, timeframe, total, sharpe of the threshold strategy on every null series."""
    w = Window.partitionBy("rep", *KEYS).orderBy("close_ts")
    pos = F.coalesce((-F.lag("ret").over(w) >= entry).cast("int"), F.lit(0))
    n = null_returns.withColumn("_r", pos * (F.col("ret") - cost_bps / 1e4))
    return n.groupBy("rep", *KEYS).agg(F.sum("_r").alias("total"), (F.avg("_r") / F.nullif(F.stddev_samp("_r"), F.lit(0.0))).alias("sharpe"))


def _walk_scorer(params: DataFrame, train: int, test: int, step: int, anchored: bool):
    """A function from one series of returns to its mean test Sharpe ratio, or None where no window fits.

    A series is scored under all parameter sets in one numpy pass, so neither series times sets
    nor windows times bars ever become rows. ``params`` is a sweep's small table: its rows
    (``SETS`` at most) go to every task.
    """
    if train % step or test % step:
        raise ValueError("train and test must be multiples of step")
    rows = params.orderBy("param_id").select("entry", "cost_bps").limit(SETS + 1).collect()
    if len(rows) > SETS:
        raise ValueError(f"more than {SETS} parameter sets: sweep them in parts")
    entry, cost = (np.array([r[c] for r in rows]) for c in ("entry", "cost_bps"))
    tr, te = train // step, test // step

    def score(ret: np.ndarray) -> float | None:
        total, squares = np.zeros((2, len(entry), len(ret) // step))
        whole = total.shape[1] * step
        for at in range(0, len(entry), 256):  # so many sets at a time
            fell = np.concatenate(([-np.inf], -ret[:-1]))[None, :whole] >= entry[at : at + 256, None]
            net = np.where(fell, ret[None, :whole] - cost[at : at + 256, None] / 1e4, 0.0).reshape(fell.shape[0], -1, step)
            total[at : at + 256], squares[at : at + 256] = net.sum(2), (net * net).sum(2)
        test_sharpe = []
        for k in range(total.shape[1] - tr - te + 1):
            inside, after = slice(0 if anchored else k, k + tr), slice(k + tr, k + tr + te)
            first, then = (_ratio(total[:, s].sum(1), squares[:, s].sum(1), total[:, s].shape[1] * step) for s in (inside, after))
            if np.isfinite(first).any():
                test_sharpe.append(then[np.nanargmax(first)])
        good = [x for x in test_sharpe if np.isfinite(x)]
        return (float(np.mean(good)) if good else np.nan) if test_sharpe else None

    return score


def mc_walk_forward(null_returns: DataFrame, params: DataFrame, train: int, test: int, step: int, anchored: bool = False) -> DataFrame:
    """Walk-forward on every null series: rep, symbol, timeframe, mean test Sharpe ratio.

    Series without a window are left out. Of series that are rows already; ``seeded_walk_forward``
    draws them where they are scored.
    """
    one = _walk_scorer(params, train, test, step, anchored)

    def score(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        found = one(df.sort_values("close_ts")["ret"].to_numpy())
        out = pd.DataFrame([] if found is None else [(*key, found)], columns=["rep", *KEYS, "test_sharpe"])
        return out.astype({"rep": "int64", "test_sharpe": "float64"})

    rows = null_returns.select("rep", *KEYS, "close_ts", "ret")
    out = rows.groupBy("rep", *KEYS).applyInPandas(score, "rep long, symbol string, timeframe string, test_sharpe double")
    return out.withColumn("test_sharpe", F.when(~F.isnan("test_sharpe"), F.col("test_sharpe")))


def seeded_walk_forward(
    bars: DataFrame, n_reps: int, params: DataFrame, train: int, test: int, step: int, anchored: bool = False, seed: int = 0, block: int = 1
) -> DataFrame:
    """``mc_walk_forward`` on the series of ``permute_returns``, drawn from their seeds in the tasks that score them."""
    one = _walk_scorer(params, train, test, step, anchored)

    def score(ret: np.ndarray) -> dict[str, np.ndarray]:
        found = [one(r) for r in ret]
        return {"test_sharpe": np.array([np.nan if x is None else x for x in found]), "_fits": np.array([float(x is not None) for x in found])}

    return from_seeds(bars, n_reps, score, ["test_sharpe", "_fits"], seed, block).filter("_fits = 1").drop("_fits")


def _ratio(total: np.ndarray, squares: np.ndarray, n: int) -> np.ndarray:
    """Mean over deviation; not a number where there is no deviation."""
    mean = total / n
    sd = np.sqrt(np.maximum(squares / n - mean * mean, 0.0))
    return np.divide(mean, sd, out=np.full(len(mean), np.nan), where=sd > 0)


def walk_forward_test(stability: DataFrame, null: DataFrame) -> DataFrame:
    """The real mean test Sharpe ratio against those of ``mc_walk_forward``, as ``null_test``.

    Symbols without a real test Sharpe ratio are left out: nothing of theirs is significant.
    """
    observed = stability.filter("test_sharpe is not null").select(*KEYS, "test_sharpe")
    return null_test(observed, null.filter("test_sharpe is not null"), KEYS, "test_sharpe")


def progress_gate(
    stability: DataFrame, significance: DataFrame, max_decay: float = 0.5, max_params: int = 4, out_of_sample: DataFrame | None = None,
    surface: DataFrame | None = None,
) -> DataFrame:
    """Of each symbol and timeframe: smooth surface, significance, stable walk-forward, and all of them.

    ``surface`` (from ``degradation``) is smooth where every small move of a parameter is ok;
    ``out_of_sample`` (``walk_forward_test``) must reject as well. A part that is not given
    does not count; a symbol missing from a part fails it.
    """
    j = stability.join(significance.select(*KEYS, "rejects"), list(KEYS), "left")
    significant, beats, smooth = F.coalesce("rejects", F.lit(False)), F.lit(True), F.lit(True)
    if out_of_sample is not None:
        j = j.join(out_of_sample.select(*KEYS, F.col("rejects").alias("_oos")), list(KEYS), "left")
        beats = F.coalesce("_oos", F.lit(False))
    if surface is not None:
        j = j.join(surface.groupBy(*KEYS).agg(F.min(F.coalesce("ok", F.lit(False))).alias("_ok")), list(KEYS), "left")
        smooth = F.coalesce("_ok", F.lit(False))
    stable = F.coalesce((F.col("decay") <= max_decay) & (F.col("n_params") <= max_params), F.lit(False))
    return j.select(
        *KEYS, smooth.alias("smooth"), significant.alias("significant"), stable.alias("stable"), beats.alias("beats_null"),
        (smooth & significant & stable & beats).alias("go"),
    )


def surface_slice(
    metrics: DataFrame, params: DataFrame, x: str | list[str], others: list[str], metric: str = "total", anchor: float = 0.5
) -> DataFrame:
    """Mean of ``metric`` along ``x`` (or over the plane of two names), the others held at the values nearest an anchor.

    The anchor is a quantile of each other parameter: 0.5 is the median.
    """
    x = [x] if isinstance(x, str) else x
    p = params
    if others:
        p = p.crossJoin(F.broadcast(params.agg(*[F.percentile(o, F.lit(anchor)).alias(f"_m_{o}") for o in others])))  # one row
    for o in others:
        p = p.withColumn("_g", F.round(F.abs(F.col(o) - F.col(f"_m_{o}")), 12))
        nearest = p.agg(F.min("_g").alias("_n"))
        p = p.crossJoin(F.broadcast(nearest)).filter("_g = _n").drop("_g", "_n")  # one row
    return metrics.join(p.select("param_id", *x), "param_id").groupBy(*x).agg(F.avg(metric).alias(f"mean_{metric}"), F.count("*").alias("n"))
