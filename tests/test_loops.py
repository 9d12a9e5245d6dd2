"""Set-based operators against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from barflow.functions.schema import round6
from barflow.operators import backtest, joins, quality, strategy, validation

from .test_bars import make


def prices(n, seed):
    rnd, x = random.Random(seed), [50.0]
    for _ in range(n - 1):
        x.append(round(max(0.0, x[-1] * (1 + rnd.uniform(-0.1, 0.1))), 4) if rnd.random() > 0.03 else 0.0 if rnd.random() < 0.3 else 40.0)
    return x


def returns(x):
    return [x[i + 1] / x[i] - 1 if x[i] else None for i in range(len(x) - 1)] + [None]


def same(a, b):
    return (a is None) == (b is None) and (a is None or abs(a - b) < 1e-9)


@pytest.mark.parametrize("seed,hold", [(0, 3), (1, 5), (2, None)])
def test_backtest_trades_and_drawdown(spark, seed, hold):
    rnd, x = random.Random(seed), prices(80, seed)
    b = make(spark, x)
    sides = {i: rnd.choice(["buy", "sell"]) for i in rnd.sample(range(80), 18)}
    s = spark.createDataFrame([("a", "1h", side, (i + 1) * 3600000 - 1) for i, side in sides.items()], "symbol string, timeframe string, side string, ts long")
    run = backtest.run_backtest(b, s, hold=hold, cost_bps=7)
    ret, position, before, equity, top = returns(x), [], 0, 1.0, 1.0
    want, spells, down = [], [], []
    for i in range(80):
        if hold is None:
            now = {"buy": 1, "sell": 0}.get(sides.get(i), before)
        else:
            now = int(any(sides.get(j) == "buy" for j in range(max(0, i - hold + 1), i + 1)))
        net = now * (ret[i] or 0.0) - abs(now - before) * 7e-4
        want.append((now, abs(now - before), net))
        if now and not before:
            spells.append([i, i])
        elif now:
            spells[-1][1] = i
        before = now
        equity *= 1 + max(net, -0.999999)
        top = max(top, equity)
        down.append(equity / top - 1)
    got = run.orderBy("close_ts").collect()
    assert [(r.position, r.turnover) for r in got] == [w[:2] for w in want] and all(same(r.ret, w[2]) for r, w in zip(got, want))
    d = backtest.drawdown(run).orderBy("close_ts").collect()
    assert all(abs(r.drawdown - w) < 1e-9 for r, w in zip(d, down))
    t = backtest.trades(run, 3, 2).orderBy("entry_ts").collect()
    assert [((r.entry_ts + 1) // 3600000 - 1, (r.exit_ts + 1) // 3600000 - 1) for r in t] == [tuple(s) for s in spells] and spells
    pnl = [x[min(z + 1, 79)] / x[a] - 1 - 0.001 if x[a] else None for a, z in spells]
    assert all(same(r.pnl, p) for r, p in zip(t, pnl))
    best = sorted((p for p in pnl if p is not None), reverse=True)
    c = backtest.trade_concentration(backtest.trades(run, 3, 2), 2).first()
    assert same(c.total_pnl, sum(best)) and same(c.top_pnl, sum(best[:2])) and same(c.rest_pnl, sum(best) - sum(best[:2]))
    m = backtest.backtest_metrics(run, ("symbol", "timeframe"), 8760).first()
    nets = [w[2] for w in want]
    mean = sum(nets) / 80
    sd = (sum((v - mean) ** 2 for v in nets) / 79) ** 0.5
    assert same(m.sharpe, mean / sd * 8760**0.5) and same(m.max_drawdown, min(down)) and same(m.total, sum(nets)) and m.n_trades == len(spells)


def test_swings_runs_and_depth(spark):
    x = prices(70, 5)
    b = make(spark, x)
    rows = b.orderBy("close_ts").collect()
    highs, lows = [r.high for r in rows], [r.low for r in rows]
    swings = {(r.close_ts, r.kind): r.price for r in strategy.swing_points(b, 2).collect()}
    for k in range(2, 68):
        near = [k - 2, k - 1, k + 1, k + 2]
        at = rows[k + 2].close_ts
        assert swings.get((at, "swing_high")) == (highs[k] if all(highs[k] > highs[j] for j in near) else None)
        assert swings.get((at, "swing_low")) == (lows[k] if all(lows[k] < lows[j] for j in near) else None)
    up = [r.consecutive_up for r in strategy.consecutive_up(b).orderBy("close_ts").collect()]
    depth = [r.pullback_depth for r in strategy.pullback_depth(b).orderBy("close_ts").collect()]
    run = 0
    for i in range(70):
        run = run + 1 if i and x[i] > x[i - 1] else 0
        top = max(highs[: i + 1])
        assert up[i] == run and same(depth[i], (top - x[i]) / top if top else None)


def test_perturbation_and_surfaces(spark):
    b = make(spark, prices(60, 7))
    grid = validation.grid(spark, {"entry": [0.02, 0.05], "cost_bps": [4]})
    p = validation.perturb(grid, ["entry", "cost_bps"], combined=True)
    got = {(r.base_id, r.moved, round(r.factor, 2)): (r.entry, r.cost_bps) for r in p.collect()}
    assert len(got) == 2 * 3 * 7 and p.select("param_id").distinct().count() == 42
    for (base, moved, f), (entry, cost) in got.items():
        assert abs(entry - [0.02, 0.05][base] * (f if moved in ("entry", "all") else 1)) < 1e-12 and abs(cost - 4 * (f if moved in ("cost_bps", "all") else 1)) < 1e-12
    m = {r.param_id: r.total for r in validation.param_sweep(b, p).collect()}
    base = {(r.base_id, r.moved): m[r.param_id] for r in p.filter("factor = 1.0").collect()}
    number = {(r.base_id, r.moved, r.factor): r.param_id for r in p.collect()}
    for r in validation.degradation(validation.param_sweep(b, p), p, "total").collect():
        start, now = base[r.base_id, r.moved], m[number[r.base_id, r.moved, r.factor]]
        loss = (start - now) / abs(start) if start else None
        assert same(r.loss, loss) and (abs(r.factor - 1) > 0.1 + 1e-9) | (loss is not None and loss <= 0.2) == bool(r.ok)
    grid = validation.grid(spark, {"entry": [0.01, 0.03, 0.05], "cost_bps": [0, 1, 2, 3], "lookback": [1, 2]})
    sets = {r.param_id: r for r in grid.collect()}
    assert len(sets) == 24 and (sets[0].entry, sets[23].lookback) == (0.01, 2.0)
    total = {r.param_id: r.total for r in validation.param_sweep(b, grid).collect()}
    for anchor, entry in ((0.5, 0.03), (0.0, 0.01)):
        got = {(r.cost_bps, r.lookback): r.mean_total for r in validation.surface_slice(validation.param_sweep(b, grid), grid, ["cost_bps", "lookback"], ["entry"], anchor=anchor).collect()}
        assert len(got) == 8
        for (c, k), v in got.items():
            assert same(v, next(total[i] for i, r in sets.items() if (r.entry, r.cost_bps, r.lookback) == (entry, c, k)))


def test_stitched_series_follows_the_choices(spark):
    b = make(spark, prices(63, 9))
    grid = validation.grid(spark, {"entry": [0.01, 0.03, 0.06], "cost_bps": [0]})
    r = validation.threshold_returns(b, grid)
    for anchored in (False, True):
        wf = validation.walk_forward(r, 20, 10, 10, anchored)
        chosen = {w.window_id: w for w in wf.collect()}
        rows = {(x.param_id, (x.close_ts + 1) // 3600000 - 1): x.ret for x in r.collect()}
        assert chosen
        for k, w in chosen.items():
            train = range(0 if anchored else 10 * k, 10 * k + 20)

            def ratio(p, bars):
                v = [rows[p, i] for i in bars]
                mean = sum(v) / len(v)
                sd = max(sum(z * z for z in v) / len(v) - mean * mean, 0) ** 0.5
                return mean / sd if sd else None

            scores = {p: ratio(p, train) for p in range(3)}
            best = max((p for p in scores if scores[p] is not None), key=lambda p: (round(scores[p], 12), -p))
            assert w.param_id == best and same(w.train_sharpe, scores[best])
            assert same(w.test_sharpe, ratio(best, range(10 * k + 20, 10 * k + 30)))
        out = validation.stitched(r, wf, 20, 10, 10).orderBy("close_ts").collect()
        assert [(x.close_ts + 1) // 3600000 - 1 for x in out] == list(range(20, 20 + 10 * len(chosen)))
        assert all(same(x.ret, rows[chosen[x.window_id].param_id, (x.close_ts + 1) // 3600000 - 1]) for x in out)


def test_rounding_and_windows(spark):
    got = [r.v for r in spark.createDataFrame([(2.5e-6,), (-2.5e-6,), (0.1234565,), (-0.0,)], "x double").select(round6(F.col("x")).alias("v")).collect()]
    assert got == [3e-6, -3e-6, 0.123457, 0.0] and str(got[3]) == "0.0"
    b = make(spark, range(1, 13))
    w = joins.walk_windows(b, 4, 2, 2, anchored=True)
    train = {r.window_id: r.n for r in w.filter("part = 'train'").groupBy("window_id").agg(F.count("*").alias("n")).collect()}
    assert train == {0: 4, 1: 6, 2: 8, 3: 10}
    assert [r.rank for r in quality.last_n(b, 3).orderBy(F.desc("close_ts")).collect()] == [1, 2, 3]
