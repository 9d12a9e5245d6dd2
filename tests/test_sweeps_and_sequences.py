"""Strategy sweeps against loops, samples from their index alone, kernels against columns."""

import math
import random

import pytest
from pyspark.sql import functions as F

from barflow.functions import features as ft
from barflow.operators import sequences, sobol, strategy, sweeps, validation

from .test_scans import BARS, rows, walk


@pytest.fixture(scope="module")
def bars(spark):
    data = walk(150, 11) + walk(70, 12, "y") + walk(40, 13, "x", "1d") + walk(1, 14, "z")
    random.Random(1).shuffle(data)
    return spark.createDataFrame(data, BARS).na.fill(1.0).cache()


def scored(closes, held, cost_bps):
    """n_bars, n_trades, total, sharpe of positions taken at closes."""
    net, trades = [], 0
    for i, h in enumerate(held):
        ret = closes[i + 1] / closes[i] - 1 if i + 1 < len(closes) and closes[i] else 0.0
        before = held[i - 1] if i else 0
        net.append(h * ret - abs(h - before) * cost_bps / 1e4)
        trades += h > before
    mean = sum(net) / len(net)
    sd = math.sqrt(sum((x - mean) ** 2 for x in net) / (len(net) - 1)) if len(net) > 1 else 0
    return len(net), trades, sum(net), mean / sd if sd > 1e-12 else None


def check(got, want):
    got = {(r.param_id, r.symbol, r.timeframe): tuple(r)[3:] for r in got.collect()}
    assert got.keys() == want.keys()
    for k, (n, trades, total, sharpe) in want.items():
        assert got[k][:2] == (n, trades) and got[k][2] == pytest.approx(total) and got[k][3] == (None if sharpe is None else pytest.approx(sharpe)), k


def by_key(df):
    out = {}
    for r in df.orderBy("close_ts").collect():
        out.setdefault((r.symbol, r.timeframe), []).append(r)
    return out


@pytest.mark.parametrize("chunk", [7, 1000])
def test_sweep_of_crossings(spark, monkeypatch, bars, chunk):
    monkeypatch.setattr(sweeps, "SLICE", 5)
    monkeypatch.setattr(sweeps, "CELLS", 200)
    params = validation.grid(spark, {"fast": [2, 3], "slow": [3, 6], "cost_bps": [0, 25, 50]})
    series, want = by_key(ft.feature_chain(bars, [ft.ema(p) for p in (2, 3, 6)])), {}
    for p in params.collect():
        for k, rs in series.items():
            held = [int((r[f"ema_{p.fast:g}"] or 0) > (r[f"ema_{p.slow:g}"] or 1e99)) for r in rs]
            want[(p.param_id, *k)] = scored([r.close for r in rs], held, p.cost_bps)
    check(sweeps.strategy_sweep(bars, params, sweeps.EmaCross(), chunk), want)
    plan = sweeps.strategy_sweep(bars, params, sweeps.EmaCross(), chunk)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("chunk", [9, 1000])
def test_sweep_of_pullbacks(spark, monkeypatch, bars, chunk):
    monkeypatch.setattr(sweeps, "SLICE", 7)
    params = validation.grid(spark, {"early": [1, 3], "confirmed": [1, 2], "pullback": [0.0, 0.2], "lookback": [1, 2], "hold": [1, 4], "cost_bps": [10]})
    series, want, signals = by_key(bars), {}, {}
    for p in params.collect():
        key = (int(p.early), int(p.confirmed), p.pullback, int(p.lookback))
        if key not in signals:
            s = strategy.buy_the_dip(bars, key[0], key[1], 99, key[2], key[3])
            signals[key] = {(r.symbol, r.timeframe, r.ts) for r in s.collect()}
        for k, rs in series.items():
            hit = [i for i, r in enumerate(rs) if (*k, r.close_ts) in signals[key]]
            held = [int(any(0 <= i - h < p.hold for h in hit)) for i in range(len(rs))]
            want[(p.param_id, *k)] = scored([r.close for r in rs], held, p.cost_bps)
    check(sweeps.strategy_sweep(bars, params, sweeps.BuyTheDip(), chunk), want)


def test_sweep_of_nothing(spark, bars):
    params = validation.grid(spark, {"fast": [2], "slow": [3], "cost_bps": [0]})
    assert sweeps.strategy_sweep(bars, params.limit(0), sweeps.EmaCross()).count() == 0
    assert sweeps.strategy_sweep(bars.limit(0), params, sweeps.EmaCross()).count() == 0


@pytest.mark.parametrize("n", [1, 2, 7, 97, 120, 1009])
def test_permutations_use_every_stratum_once(spark, n):
    for key in (0, 5):
        df = sequences.permuted(spark.range(n), "id", n, key, "p")
        assert sorted(r.p for r in df.collect()) == list(range(n))
    a, b = (([r.p for r in sequences.permuted(spark.range(n), "id", n, k, "p").orderBy("id").collect()]) for k in (1, 2))
    assert n < 50 or (a != b and a != list(range(n)))


def test_hypercube_needs_no_other_row(spark):
    df = validation.lhs_params(spark, {"a": (0.0, 1.0), "b": (-5.0, 5.0), "c": (1, 9)}, 53, seed=3, ints=["c"])
    assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = df.collect()
    assert sorted(int(r.a * 53) for r in got) == list(range(53)) and sorted(int((r.b + 5) / 10 * 53) for r in got) == list(range(53))
    assert all(r.c == round(r.c) and 1 <= r.c <= 9 for r in got)
    free = validation.random_params(spark, {"a": (0.0, 1.0), "c": (1, 9)}, 500, seed=1, ints=["c"]).collect()
    assert abs(sum(r.a for r in free) / 500 - 0.5) < 0.05 and {r.c for r in free} == set(range(1, 10))
    assert [tuple(r) for r in validation.random_params(spark, {"a": (0.0, 1.0), "c": (1, 9)}, 500, seed=1, ints=["c"]).filter("param_id = 7").collect()] == [tuple(free[7])]


def test_every_dimension_fills_its_intervals(spark):
    for seed in (0, 4):
        cols = [F.expr(sequences.sobol_number("id", d, 256, seed)).alias(f"d{d}") for d in range(21)]
        got = spark.range(256).select(*cols).collect()
        for d in range(21):
            assert sorted(int(r[d] * 256) for r in got) == list(range(256))
        # any two dimensions: the first 256 points have 256 boxes of 16 x 16 or nearly so
        assert len({(int(r[0] * 16), int(r[1] * 16)) for r in got}) == 256
    hashed = spark.range(64).select(F.expr(sequences.sobol_number("id", 30, 64)).alias("u")).collect()
    assert all(0 < r.u < 1 for r in hashed)


def test_sobol_points_estimate_better_than_hashed_ones(spark):
    pi = math.pi
    problem = sobol.load_problem({"parameters": [{"name": f"x{i}", "bounds": [-pi, pi]} for i in (1, 2, 3)], "metrics": ["y"]})
    y = F.sin("x1") + 7 * F.pow(F.sin("x2"), 2) + 0.1 * F.pow("x3", 4) * F.sin("x1")
    true = {("S1", "x1"): 0.3139, ("S1", "x2"): 0.4424, ("S1", "x3"): 0.0, ("ST", "x1"): 0.5576, ("ST", "x2"): 0.4424, ("ST", "x3"): 0.2437}

    def error(sequence, seed):
        r = sobol.saltelli_samples(spark, problem, 1024, seed, sequence).withColumn("y", y)
        got = {(x.kind, x.param): x.value for x in sobol.sobol_indices(r, problem, "y").collect() if x.kind != "S2"}
        return sum(abs(got[k] - v) for k, v in true.items())

    assert max(error("sobol", s) for s in (0, 1)) < min(error("hash", s) for s in (0, 1))
    with pytest.raises(ValueError, match="sequence"):
        sobol.saltelli_samples(spark, problem, 8, 0, "other")


@pytest.mark.parametrize("chunk", [None, 20])
def test_kernels_equal_columns(spark, bars, chunk):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "9")  # symbols go over batches
    try:
        gap = ft.difference("sma_3", "ema_4")
        specs = [ft.mean_of(gap.id, 2), gap, ft.sma(3), ft.ema(4), ft.ema(5, 1.5), ft.rsi(3), ft.vwap(2), ft.engulfing_candle(), ft.swing_highlow(4)]
        whole, made = ft.feature_chain(bars, specs), ft.feature_chain(bars, specs, chunk, kernels=True)
        assert made.dtypes == whole.dtypes
        cols = ["close_ts", *(f"`{s.id}`" for s in specs)]
        assert rows(made, *cols) == rows(whole, *cols)
        assert ft.feature_chain(bars.limit(0), specs, chunk, kernels=True).count() == 0
        assert ft.feature_chain(bars, specs, kernels=True)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with pytest.raises(ValueError, match="kernel"):
        ft.feature_chain(bars, [ft.FeatureSpec("own", 1, lambda: F.lit(1))], kernels=True)
