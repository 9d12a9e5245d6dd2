import random

import pytest
from pyspark.sql import functions as F

from barflow.functions import features as ft
from barflow.functions.schema import BAR_COLUMNS, step_ms
from barflow.jobs import queries
from barflow.operators import backtest, joins, quality, sobol, strategy, validation
from barflow.sources import bars as src
from barflow.sources import files
from barflow.streaming import streams

SCHEMA = "symbol string, timeframe string, open_ts long, close_ts long, open double, high double, low double, close double, volume double"


def make(spark, closes, symbol="a", volumes=None):
    rows = []
    for i, c in enumerate(closes):
        o = closes[i - 1] if i else c
        rows.append((symbol, "1h", i * 3600000, (i + 1) * 3600000 - 1, float(o), float(max(o, c)) + 1, float(min(o, c)) - 1, float(c), 1.0 if volumes is None else float(volumes[i])))
    return spark.createDataFrame(rows, SCHEMA)


def column(df, name):
    return [r[name] for r in df.orderBy("close_ts").collect()]


def loop_ema(x, p):
    out, a = [], 2 / (p + 1)
    for i in range(len(x)):
        s = x[max(0, i + 1 - 2 * p) : i + 1]
        if len(s) < p:
            out.append(None)
            continue
        e = sum(s[:p]) / p
        for v in s[p:]:
            e = v * a + e * (1 - a)
        out.append(e)
    return out


@pytest.mark.parametrize("n", [2, 3, 5, 6, 7, 20])
def test_ema_is_windowed(spark, n):
    x = [random.Random(i).uniform(1, 100) for i in range(n)]
    got = column(ft.feature_chain(make(spark, x), [ft.ema(3)]), "ema_3")
    for g, e in zip(got, loop_ema(x, 3)):
        assert (g is None) == (e is None) and (g is None or abs(g - e) < 1e-6)


def test_rsi_flat_is_100_and_vwap_without_volume_is_null(spark):
    b = make(spark, [5] * 6, volumes=[0] * 6)
    f = ft.feature_chain(b, [ft.rsi(3), ft.vwap(2), ft.sma(3)])
    assert column(f, "rsi_3") == [None] * 3 + [100.0] * 3
    assert column(f, "vwap_2") == [None] * 6
    assert column(f, "sma_3") == [None, None, 5.0, 5.0, 5.0, 5.0]


def test_chain_is_one_exchange_and_checks_its_specs(spark):
    f = ft.feature_chain(make(spark, range(1, 9)), [ft.sma(2), ft.rsi(3), ft.vwap(2), ft.engulfing_candle(), ft.ema(2)])
    plan = f._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
    with pytest.raises(ValueError, match="duplicate"):
        ft.feature_chain(make(spark, [1, 2]), [ft.sma(2), ft.sma(2)])
    with pytest.raises(ValueError, match="unknown option"):
        ft.spec("sma", period=3, colour=1)
    assert ft.ema(20, 3).id == "ema_20_s3" and ft.sma(14.0).id == "sma_14"


def test_time_window_and_timeframes(spark):
    with pytest.raises(ValueError):
        quality.time_window(make(spark, [1]), 10, 5)
    with pytest.raises(ValueError):
        step_ms("2h")
    assert quality.time_window(make(spark, range(5)), 3600000, 7200000).count() == 2


def loop_dip(highs, lows, closes, early=3, confirmed=2, mature=3, pull=0.03, lb=2):
    """The strategy as a plain loop."""
    out, up, top, inside, sh, sl = [], 0, None, False, [], []
    for i, c in enumerate(closes):
        up = up + 1 if i and c > closes[i - 1] else 0
        k = i - lb
        if k >= lb:
            side = [*range(k - lb, k), *range(k + 1, k + lb + 1)]
            if all(highs[k] > highs[j] for j in side):
                sh.append(highs[k])
            if all(lows[k] < lows[j] for j in side):
                sl.append(lows[k])

        def run(s):
            n = 0
            while n + 1 < len(s) and s[-1 - n] > s[-2 - n]:
                n += 1
            return n

        if top is None or highs[i] > top:
            top, inside = highs[i], False
        if (top - c) / top >= pull:
            inside = True
        both = min(run(sh), run(sl))
        kind = "mature" if both >= mature else "confirmed" if both >= confirmed else "early" if up >= early else "none"
        if kind != "none" and inside:
            out.append((i, kind))
            inside = False
    return out


@pytest.mark.parametrize("seed", range(4))
def test_buy_the_dip_equals_the_loop(spark, seed):
    rnd, x = random.Random(seed), [100.0]
    for _ in range(300):
        x.append(max(5.0, x[-1] * (1 + rnd.uniform(-0.05, 0.052))))
    b = make(spark, x)
    rows = b.orderBy("close_ts").collect()
    want = loop_dip([r.high for r in rows], [r.low for r in rows], x)
    got = [((r.ts + 1) // 3600000 - 1, r.metadata.trend_maturity) for r in strategy.buy_the_dip(b).orderBy("ts").collect()]
    assert got == want and got


def test_asof_gaps_dedupe(spark):
    b = make(spark, [1, 2, 3])
    e = spark.createDataFrame([("a", 3600000 - 1), ("a", 3600000 - 2), ("b", 5)], "symbol string, ts long")
    assert {(r.symbol, r.ts): r.price for r in joins.asof_price(e, b, "ts").collect()} == {("a", 3599999): 1.0, ("a", 3599998): None, ("b", 5): None}
    gap = quality.find_gaps(b.filter("open_ts <> 3600000"), "1h").collect()
    assert [(r.gap_start, r.missing) for r in gap] == [(3600000, 1)]
    twice = quality.fan_in(b.withColumn("seq", F.lit(2)), b.withColumn("seq", F.lit(1)))
    assert {r.seq for r in quality.dedupe_bars(twice, "seq").collect()} == {1}


def test_permutation_keeps_the_returns(spark):
    b = make(spark, [1, 2, 4, 3, 5, 8, 7])
    real = sorted(round(r.ret, 9) for r in backtest.bar_returns(b).filter("ret is not null").collect())
    for rep in range(3):
        null = [round(r.ret, 9) for r in backtest.permute_returns(b, 3, seed=5).filter(F.col("rep") == rep).collect()]
        assert sorted(null) == real


def test_ishigami(spark):
    p = 3.141592653589793
    problem = sobol.load_problem({"parameters": [{"name": f"x{i}", "bounds": [-p, p]} for i in (1, 2, 3)], "metrics": ["y"]})
    y = F.sin("x1") + 7 * F.pow(F.sin("x2"), 2) + 0.1 * F.pow("x3", 4) * F.sin("x1")
    r = sobol.saltelli_samples(spark, problem, 8192).withColumn("y", y)
    assert r.count() == 8192 * 8
    got = {(x.kind, x.param): x.value for x in sobol.sobol_indices(r, problem, "y").collect() if x.kind != "S2"}
    for key, want in {("S1", "x1"): 0.314, ("S1", "x2"): 0.442, ("S1", "x3"): 0, ("ST", "x1"): 0.558, ("ST", "x2"): 0.442, ("ST", "x3"): 0.244}.items():
        assert abs(got[key] - want) < 0.04, (key, got[key])


def test_problem_faults():
    with pytest.raises(ValueError, match="bounds"):
        sobol.load_problem({"parameters": [{"name": "a", "bounds": [2, 1]}], "metrics": ["y"]})
    with pytest.raises(ValueError, match="type"):
        sobol.load_problem({"parameters": [{"name": "a", "bounds": [0, 1], "type": "integer"}], "metrics": ["y"]})


def test_klines_csv_quarantines_bad_rows(spark, tmp_path):
    good = [",".join(map(str, [i * 3600000, 1, 2, 0.5, 1.5, 10, (i + 1) * 3600000 - 1, 0, 0, 0, 0, 0])) for i in range(3)]
    bad = ["open_time,open,high,low,close,volume,close_time,a,b,c,d,e", "1,2,3,4,5", good[0].replace("1.5", "1d"), good[0].replace(",1.5", ", 1.5")]
    (tmp_path / "BTCUSDT-1h-2024-01.csv").write_text("\n".join(good + bad) + "\n")
    bars, rest = files.read_klines_csv(spark, str(tmp_path))
    assert bars.count() == 3 and rest.count() == 4
    assert bars.select("symbol", "timeframe").distinct().collect() == [("BTCUSDT", "1h")]


def test_grid_lhs_and_walk_windows(spark):
    g = validation.grid(spark, {"entry": [1, 2], "cost_bps": [3, 4, 5]})
    assert sorted(r.param_id for r in g.collect()) == list(range(6))
    lhs = validation.lhs_params(spark, {"a": (0.0, 1.0)}, 20).collect()
    assert sorted(int(r.a * 20) for r in lhs) == list(range(20))
    w = joins.walk_windows(make(spark, range(1, 11)), 4, 2, 2)
    assert [(r.window_id, r.n) for r in w.groupBy("window_id").agg(F.count("*").alias("n")).orderBy("window_id").collect()] == [(0, 6), (1, 6), (2, 6)]


def test_streamed_bars_equal_batch(spark, tmp_path):
    rows = [(i, 1704067200 + 97 * i, "a" if i % 3 else "b", float(i % 17)) for i in range(400)]
    t = spark.createDataFrame(rows, "id long, s long, symbol string, p double").withColumn("ts", F.timestamp_seconds("s"))
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    out = streams.stream_ticks_to_bars(stream, "ts", "symbol", "p", "1.0", "1h", "1 minute")
    q = streams.replay(out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")))
    q.awaitTermination(60)
    got = {(r.symbol, r.open_ts): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = src.ticks_to_bars(t, "ts", "symbol", "p", "1.0", "1h", ["id"])
    closed = {(r.symbol, r.open_ts): r for r in want.select(*BAR_COLUMNS).collect()}
    assert got and set(got) <= set(closed) and all(got[k].close == closed[k].close and got[k].volume == closed[k].volume for k in got)


def test_gate_compares_the_real_walk_forward_with_its_null(spark):
    form = "symbol string, timeframe string, decay double, n_params long, test_sharpe double"
    stability = spark.createDataFrame([("a", "1h", 0.1, 1, 9.5), ("b", "1h", 0.1, 1, 3.0), ("c", "1h", 0.1, 1, None)], form)
    null = spark.createDataFrame([(i, s, "1h", i / 10.0) for i in range(99) for s in "abc"], "rep long, symbol string, timeframe string, test_sharpe double")
    oos = validation.walk_forward_test(stability, null)
    got = {r.symbol: (r.n_null, r.p_value, r.rejects) for r in oos.collect()}
    assert got == {"a": (99, pytest.approx(0.05), True), "b": (99, pytest.approx(0.7), False)}
    every = stability.select("symbol", "timeframe", F.lit(True).alias("rejects"))
    gate = validation.progress_gate(stability, every, out_of_sample=oos)
    assert {r.symbol: (r.stable, r.significant, r.beats_null, r.go) for r in gate.collect()} == {
        "a": (True, True, True, True), "b": (True, True, False, False), "c": (True, True, False, False)}
    rough = spark.createDataFrame([("a", "1h", True), ("a", "1h", False), ("b", "1h", True)], "symbol string, timeframe string, ok boolean")
    assert {r.symbol: r.smooth for r in validation.progress_gate(stability, every, surface=rough).collect()} == {"a": False, "b": True, "c": False}


def test_significance_queries_take_a_thousand_null_series():
    assert queries.N_NULL >= 1000


def test_zero_prices_raise_nowhere(spark):
    x = [5, 0, 0, 3, 4, 0, 2, 2.5, 3, 3.5, 0, 1, 1.2, 1.4]
    b = make(spark, x).withColumn("high", F.col("close"))
    assert [r is None for r in column(backtest.bar_returns(b), "ret")] == [False, True, True, False, False, True, False, False, False, False, True, False, False, True]
    flat = b.withColumns({c: F.lit(0.0) for c in ("open", "high", "low", "close")})
    assert set(column(strategy.pullback_depth(flat), "pullback_depth")) == {None}
    for bars in (b, flat):
        run = backtest.run_backtest(bars, strategy.buy_the_dip(bars, early=2), hold=3, cost_bps=5)
        assert backtest.backtest_metrics(run, ("symbol", "timeframe"), 8760).count() == 1
        backtest.trade_concentration(backtest.trades(run)).collect()
        validation.param_sweep(bars, validation.grid(spark, {"entry": [0.1], "cost_bps": [0], "lookback": [1, 2]})).collect()
    problem = sobol.load_problem({"parameters": [{"name": "a", "bounds": [0, 1]}, {"name": "b", "bounds": [0, 1]}], "metrics": ["y"]})
    same = sobol.saltelli_samples(spark, problem, 8).withColumn("y", F.lit(2.0))
    assert {r.value for r in sobol.sobol_indices(same, problem, "y").collect()} == {None}


def test_two_timeframes_of_a_symbol_do_not_mix(spark):
    hours = make(spark, [100, 90, 95, 80, 99, 70, 75, 60, 88, 91])
    days = make(spark, [10, 9, 12, 8, 13, 7, 9, 14, 8, 9]).withColumn("timeframe", F.lit("1d"))
    both, grid = hours.unionByName(days), validation.grid(spark, {"entry": [0.02, 0.1], "cost_bps": [0]})
    key = lambda rows: sorted(map(tuple, rows))
    for f in (lambda b: validation.param_sweep(b, grid), lambda b: validation.walk_forward(validation.threshold_returns(b, grid), 4, 2, 2),
              lambda b: backtest.run_backtest(b, strategy.buy_the_dip(b, early=1, pullback=0.01), hold=2).drop("open_ts")):
        assert key(f(both).collect()) == key(f(hours).collect() + f(days).collect())


def test_metrics_count_trades(spark):
    b = make(spark, [10, 11, 12, 11, 10, 9, 10, 11])
    s = spark.createDataFrame([("a", "1h", "buy", 3600000 * 1 - 1), ("a", "1h", "sell", 3600000 * 3 - 1), ("a", "1h", "buy", 3600000 * 4 - 1), ("a", "1h", "sell", 3600000 * 5 - 1), ("a", "1h", "buy", 3600000 * 7 - 1)],
                              "symbol string, timeframe string, side string, ts long")
    run = backtest.run_backtest(b, s, hold=None)
    assert column(run, "position") == [1, 1, 0, 1, 0, 0, 1, 1]
    m = backtest.backtest_metrics(run, ("symbol", "timeframe"), 8).first()
    assert (m.n_trades, m.win_rate, m.turnover) == (3, 0.5, 5)  # the third is still open
    assert abs(m.cagr - (1.1 * 12 / 11 * 10 / 11 * 1.1 - 1)) < 1e-9


def test_average_cost_equals_a_loop(spark):
    rnd = random.Random(4)
    rows = [(s, rnd.choice(["buy", "sell"]), float(rnd.randrange(0, 9)), float(rnd.randrange(1, 50)), i, str(i)) for i in range(300) for s in "abc"]
    fills = spark.createDataFrame([*rows, ("a", "buy", None, 1.0, 5, "x"), (None, "buy", 1.0, 1.0, 5, "x")], "symbol string, side string, fill_size double, fill_price double, filled_at long, order_id string")
    want = {}
    for s, side, q, p, *_ in rows:
        lots, realised = want.setdefault(s, [[0.0, 0.0], 0.0])
        q = q if side == "buy" else -q
        size, cost = lots
        if size * q < 0:
            closed = min(abs(size), abs(q))
            realised += closed * (p - cost) * (1 if size > 0 else -1)
            cost = p if abs(q) > abs(size) else cost
        elif q:
            cost = (cost * abs(size) + p * abs(q)) / abs(size + q)
        want[s] = [[size + q, cost], realised]
    prices = spark.createDataFrame([("a", 20.0), ("b", 30.0)], "symbol string, price double")
    got = {r.symbol: r for r in backtest.positions_from_fills(fills, prices).collect()}
    assert set(got) == set("abc") and got["c"].unrealised is None
    for s, ((size, cost), realised) in want.items():
        assert got[s].size == size and abs(got[s].realised - realised) < 1e-6 and abs(got[s].entry_price - (cost if size else 0.0)) < 1e-9
    assert abs(got["a"].unrealised - got["a"].size * (20 - got["a"].entry_price)) < 1e-9 and got["b"].exposure == got["b"].size * 30
    assert backtest.average_cost(fills.limit(0)).count() == 0


def test_monte_carlo_walk_forward_equals_walk_forward(spark):
    rnd, rows = random.Random(8), []
    for rep in range(4):
        for s in "ab":
            rows += [(rep, s, "1h", i, rnd.gauss(0, 0.1)) for i in range(23)]
    null = spark.createDataFrame(rows, "rep long, symbol string, timeframe string, close_ts long, ret double")
    grid = validation.grid(spark, {"entry": [0.01, 0.05, 0.1], "cost_bps": [0, 20]})
    sets = grid.orderBy("param_id").collect()
    for anchored in (False, True):
        got = {(r.rep, r.symbol): r.test_sharpe for r in validation.mc_walk_forward(null, grid, 8, 4, 4, anchored).collect()}
        runs = []  # each series as a symbol of its own, through the set-based operator
        for rep, s, t, i, ret in rows:
            before = next((x[4] for x in rows if x[:2] == (rep, s) and x[3] == i - 1), None)
            for p in sets:
                pos = int(before is not None and -before >= p.entry)
                runs.append((p.param_id, f"{rep}{s}", t, i, pos * (ret - p.cost_bps / 1e4)))
        r = spark.createDataFrame(runs, "param_id long, symbol string, timeframe string, close_ts long, ret double")
        want = {(int(x.symbol[0]), x.symbol[1]): x.test_sharpe for x in validation.wf_stability(validation.walk_forward(r, 8, 4, 4, anchored)).collect()}
        assert set(got) == set(want) and all((got[k] is None) == (want[k] is None) and (got[k] is None or abs(got[k] - want[k]) < 1e-9) for k in got)


def test_sobol_confidence_follows_the_sample_size(spark):
    problem = sobol.load_problem({"parameters": [{"name": "x1", "bounds": [0, 1]}, {"name": "x2", "bounds": [0, 1]}], "metrics": ["y"]})
    conf = {}
    for n in (64, 4096):
        r = sobol.saltelli_samples(spark, problem, n).withColumn("y", F.col("x1") * 3 + F.col("x2")).withColumn("s", F.lit("a"))
        conf[n] = {x.param: (x.s1_conf, x.st_conf) for x in sobol.sobol_confidence(r, problem, "y", ["s"]).collect()}
    for p in ("x1", "x2"):
        for i in (0, 1):  # errors shrink as the root of the sample size: 8 times
            assert 4 < conf[64][p][i] / conf[4096][p][i] < 16


def test_missing_results_warn_and_then_raise(spark):
    s = spark.range(100).withColumnRenamed("id", "sample_id")
    assert joins.check_complete(s, s) == 0
    with pytest.warns(UserWarning, match="3 of 100"):
        assert joins.check_complete(s, s.filter("sample_id >= 3")) == 3
    with pytest.raises(ValueError, match="5 of 100"):
        joins.check_complete(s, s.filter("sample_id >= 5"))


def test_params_in_slices_are_the_whole_product(spark, monkeypatch):
    b, g = make(spark, [1, 2, 3]), validation.grid(spark, {"entry": [1, 2, 3], "cost_bps": [0, 1]})
    monkeypatch.setattr(joins, "SETS", 2)
    got = [(r.close_ts, r.param_id) for r in joins.expand_params(b, g).collect()]
    assert len(got) == 18 and len(set(got)) == 18


def test_asof_price_across_buckets(spark):
    rnd = random.Random(1)
    bars = [(s, "1h", t, float(t)) for s in "ab" for t in rnd.sample(range(1000), 40)]
    events = [(s, rnd.randrange(1000), i) for i, s in enumerate("ab" * 100)] + [("c", 5, 999), (None, 5, 1000)]
    b = spark.createDataFrame(bars, "symbol string, timeframe string, close_ts long, close double")
    e = spark.createDataFrame(events, "symbol string, at long, n long")
    for bucket in (7, 100, 10_000):
        got = {r.n: r.price for r in joins.asof_price(e, b, "at", bucket).collect()}
        assert got == {n: max((t for s2, _, t, _ in bars if s2 == s and t <= at), default=None) for s, at, n in events}
