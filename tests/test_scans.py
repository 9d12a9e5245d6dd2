"""Running state over chunks against whole symbols; feature dependencies; null series from seeds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barflow.functions import features as ft
from barflow.functions.kernels import KERNELS
from barflow.functions.schema import KEYS
from barflow.operators import backtest, nulls, scan, strategy, validation
from barflow.streaming import streams

BARS = "symbol string, timeframe string, open_ts long, close_ts long, open double, high double, low double, close double, volume double"


def walk(n, seed, symbol="x", timeframe="1h", gaps=True):
    """Bars with plateaus, missing hours, zero prices and now and then a null."""
    rng, at, p, out = random.Random(seed), 0, 20, []
    for i in range(n):
        at += rng.choice([1, 1, 1, 1, 40]) if gaps else 1
        p = max(0, p + rng.choice([-2, -1, 0, 0, 1, 2]))
        high, low = p + rng.choice([0, 1]), max(0, p - rng.choice([0, 1]))
        out.append((symbol, timeframe, at * 3600000, at * 3600000 + 3599999, float(p), float(high) if i % 97 else None, float(low), float(p) if i % 89 else None, float(i % 3)))
    return out


def rows(df, *cols):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*KEYS, *cols).collect()), key=str)


@pytest.fixture(scope="module")
def bars(spark):
    data = walk(240, 1) + walk(90, 2, "y") + walk(60, 3, "x", "1d") + walk(1, 4, "z")
    random.Random(0).shuffle(data)
    return spark.createDataFrame(data, BARS).cache()


@pytest.mark.parametrize("chunk", [3, 41, 1000])
def test_chunks_equal_whole_symbols(bars, chunk):
    whole, parts = strategy.trend_maturity(bars), strategy.trend_maturity(bars, chunk_rows=chunk)
    cols = ("close_ts", "higher_highs", "higher_lows", "consecutive_up", "maturity")
    assert rows(whole, *cols) == rows(parts, *cols) and set(parts.columns) == set(whole.columns)
    for f in (strategy.recent_high, strategy.consecutive_up, strategy.pullback_depth):
        assert f(bars, chunk).columns == f(bars).columns and rows(f(bars, chunk), *f(bars).columns[2:]) == rows(f(bars), *f(bars).columns[2:])
    r = backtest.bar_returns(bars)
    assert rows(backtest.drawdown(r, chunk_rows=chunk), "close_ts", "equity", "drawdown") == rows(backtest.drawdown(r), "close_ts", "equity", "drawdown")
    assert strategy.recent_high(bars.limit(0), chunk).count() == 0


@pytest.mark.parametrize("options", [{}, {"early": 1, "confirmed": 1, "mature": 2, "pullback": 0.0, "lookback": 1}, {"strict_legacy": True, "early": 2}])
def test_chunked_signals_equal_whole_ones(bars, options):
    whole = rows(strategy.buy_the_dip(bars, **options), "ts", "metadata")
    assert whole and rows(strategy.buy_the_dip(bars, **options, chunk_rows=7), "ts", "metadata") == whole


def test_no_window_holds_a_symbol(bars):
    """Windows over bars are by chunk; only the table of chunks is by symbol."""
    plan = strategy.buy_the_dip(bars, chunk_rows=20)._jdf.queryExecution().executedPlan().toString()
    over_bars = [line for line in plan.splitlines() if "Window [" in line and "_end_" not in line]
    assert over_bars and all("_chunk" in line.split("windowspecdefinition(")[1].split("specifiedwindowframe")[0] for line in over_bars)


def test_scan_kinds(spark):
    data = [("k", "t", c, i, v) for c, i, v in ((0, 0, None), (0, 1, 2), (2, 5, None), (2, 6, -1), (3, 9, 4))]
    df = spark.createDataFrame(data, "symbol string, timeframe string, _chunk long, close_ts long, v long")
    out = scan.scan(df, {k: scan.Scan(kind, F.col("v"), before) for k, kind, before in (("s", "sum", False), ("m", "max", False), ("l", "last", True), ("b", "sum", True))})
    got = [tuple(r) for r in out.orderBy("close_ts").select("s", "m", "l", "b").collect()]
    assert got == [(None, None, None, None), (2, 2, None, None), (2, 2, 2, 2), (1, 2, 2, 2), (5, 4, -1, 1)]


def test_dependencies_in_any_order(bars):
    gap = ft.difference("sma_3", "sma_5")
    mean = ft.mean_of(gap.id, 2)
    specs = [mean, gap, ft.sma(5), ft.sma(3)]
    assert [[s.id for s in r] for r in ft.stages(specs)] == [["sma_5", "sma_3"], [gap.id], [mean.id]]
    plain = ft.feature_chain(bars, specs[::-1])
    for order in (specs, specs[1:] + specs[:1]):
        for chunk in (None, 6):
            assert rows(ft.feature_chain(bars, order, chunk_rows=chunk), "close_ts", *(s.id for s in specs)) == rows(plain, "close_ts", *(s.id for s in specs))
    assert ft.feature_chain(bars, specs)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert ft.history(ft.stages(specs)) == 8


def test_faults_of_dependencies_are_named(bars):
    one = lambda i, *d: ft.FeatureSpec(i, 1, lambda: F.lit(1), d)
    with pytest.raises(ValueError, match="b -> c -> b"):
        ft.stages([one("a", "b"), one("b", "c"), one("c", "b"), one("d")])
    with pytest.raises(ValueError, match="a -> a"):
        ft.feature_chain(bars, [one("a", "a")])
    with pytest.raises(ValueError, match="nowhere"):
        ft.stages([one("a", "nowhere")], ["close"])
    with pytest.raises(ValueError, match="duplicate"):
        ft.stages([one("a"), one("a")])
    assert [s.id for s in ft.stages([one("a", "close")], ["close"])[0]] == ["a"]


def test_every_kind_has_a_kernel(spark, bars):
    assert set(KERNELS) == set(ft.BUILDERS)
    data = spark.createDataFrame(walk(60, 9), BARS).na.fill(1.0)
    specs = [("mean_of", {"source": "sma_3_minus_ema_4", "period": 3}), ("difference", {"a": "sma_3", "b": "ema_4"}), ("swing_highlow", {"period": 4}), ("sma", {"period": 3}), ("ema", {"period": 4})]
    built = [ft.spec(k, **o) for k, o in specs]
    want = [tuple(r) for r in ft.feature_chain(data, built).orderBy("close_ts").select(*[F.col(s.id).cast("double") for s in built]).collect()]
    have = data.orderBy("close_ts").toPandas()
    columns = {c: have[c].to_numpy() for c in streams.NAMES}
    for i in (3, 4, 1, 0, 2):
        columns[built[i].id] = KERNELS[specs[i][0]](columns, **specs[i][1])
    got = list(zip(*(columns[s.id] for s in built)))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert [None if np.isnan(x) else float(x) for x in g] == pytest.approx(list(w))
    with pytest.raises(ValueError, match="unknown feature|no stream"):
        streams.stream_features(bars, [("nothing", {})])


@pytest.mark.parametrize("block", [1, 3])
def test_seeded_series_are_those_of_permute_returns(spark, monkeypatch, block):
    monkeypatch.setattr(nulls, "CELLS", 100)  # a few repetitions at a time
    data = spark.createDataFrame(walk(50, 5, gaps=False) + walk(33, 6, "y") + walk(1, 7, "z"), BARS).na.fill(1.0)
    kept = nulls.from_seeds(data, 9, lambda m: {f"r{i}": m[:, i] if i < m.shape[1] else np.full(len(m), np.nan) for i in range(50)}, [f"r{i}" for i in range(50)], 4, block, per_task=4)
    plain = backtest.permute_returns(data, 9, 4, block)
    by_row = {(r.rep, r.symbol): [x for x in tuple(r)[3:] if x is not None] for r in kept.collect()}
    by_rep = {}
    for r in plain.orderBy("close_ts").collect():
        by_rep.setdefault((r.rep, r.symbol), []).append(r.ret)
    assert {k: v for k, v in by_row.items() if v} == {k: pytest.approx(v) for k, v in by_rep.items()}


def test_null_scores_equal_plain_ones(spark):
    data = spark.createDataFrame(walk(80, 8, gaps=False) + walk(40, 9, "y"), BARS).na.fill(1.0)
    found = nulls.null_scores(data, 6, 0.05, 10, 365.0, seed=2, observed=True)
    got = {(r.rep, r.symbol): r for r in found.collect()}
    series = {}
    for r in backtest.permute_returns(data, 6, 2).orderBy("close_ts").collect():
        series.setdefault((r.rep, r.symbol), []).append(r.ret)
    for r in backtest.bar_returns(data).filter("ret is not null").orderBy("close_ts").collect():
        series.setdefault((-1, r.symbol), []).append(r.ret)
    assert set(got) == set(series)
    for k, ret in series.items():
        net = [(x - 0.001 if -before >= 0.05 else 0.0) for before, x in zip([0.0, *ret[:-1]], ret)]
        equity, top, worst = 1.0, 1.0, 0.0
        for x in net:
            equity *= 1 + max(x, -0.999999)
            top = max(top, equity)
            worst = min(worst, equity / top - 1)
        sd = np.std(net, ddof=1)
        assert got[k].total == pytest.approx(sum(net)) and got[k].max_drawdown == pytest.approx(worst)
        assert got[k].log_cagr == pytest.approx(np.log(equity) * 365 / len(net))
        assert got[k].sharpe == (pytest.approx(np.mean(net) / sd) if sd > 0 else None)
    sig = nulls.significance(found)
    assert sig.count() == 6 and {r.metric for r in sig.collect()} == {"sharpe", "log_cagr", "max_drawdown"} and all(r.n_null <= 6 for r in sig.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "_h" not in plan and "Window [row_number" not in plan  # no order of bars is a row


def test_seeded_walk_forward_equals_walk_forward_on_rows(spark):
    data = spark.createDataFrame(walk(120, 3, gaps=False) + walk(30, 4, "y"), BARS).na.fill(1.0)
    params = validation.grid(spark, {"entry": [0.02, 0.1], "cost_bps": [0, 20]})
    rows_ = validation.mc_walk_forward(backtest.permute_returns(data, 5, 6), params, 40, 20, 20)
    seeded = validation.seeded_walk_forward(data, 5, params, 40, 20, 20, seed=6)
    key = lambda r: (r.rep, r.symbol)
    a, b = ({key(r): r.test_sharpe for r in df.collect()} for df in (rows_, seeded))
    assert a.keys() == b.keys() and {k[1] for k in a} == {"x"}
    assert all(a[k] == pytest.approx(b[k]) for k in a)
