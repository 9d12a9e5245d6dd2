"""Registered queries: each applies one operator to bars made of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features as ft
from ..functions.schema import bars_per_year, round6, typical_price
from ..operators import backtest as bt
from ..operators import joins, nulls, quality, sobol, strategy, sweeps, validation
from ..sources import bars as src
from ..sources import files
from ..sources.shared import shared_dir, stored
from ..streaming import streams, timed

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: The shipped feature list of the flagship query.
SPECS = [ft.engulfing_candle(), ft.vwap(20), ft.vwap(50), ft.ema(20), ft.ema(50), ft.sma(20), ft.rsi(14)]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """Six decimals: sums in another order differ in the last bits."""
    return df.withColumns({c: round6(F.col(c)) for c in cols})


def table(spark, sf, name) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def ticks_to_bars(spark, sf):
    return src.event_bars(spark, sf, "1h")


@query
def line_bars(spark, sf):
    return rounded(src.line_bars(spark, sf), "open", "high", "low", "close")


@query
def rollup_bars(spark, sf):
    return src.rollup_bars(src.event_bars(spark, sf, "1m"), "15m")


@query
def feature_chain(spark, sf):
    bars = quality.drop_malformed(src.event_bars(spark, sf, "1h"))
    return ft.feature_chain(bars, SPECS, kernels=True)


@query
def feature_chain_lines(spark, sf):
    return rounded(ft.feature_chain(src.line_bars(spark, sf), SPECS, kernels=True), "open", "high", "low", "close")


@query
def feature_chain_chunked(spark, sf):
    """Minute bars of a few long symbols, in chunks of 500."""
    return ft.feature_chain(src.event_bars(spark, sf, "1m"), SPECS, chunk_rows=500, kernels=True)


@query
def feature_dependencies(spark, sf):
    """Features of features, each before what it needs: the mean of the gap of two averages, and how far the gap is from it."""
    gap = ft.difference("ema_20", "ema_50")
    mean = ft.mean_of(gap.id, 9)
    bars = quality.drop_malformed(src.event_bars(spark, sf, "1h"))
    out = ft.feature_chain(bars, [ft.difference(gap.id, mean.id), mean, ft.sma(20), gap, ft.ema(50), ft.ema(20)])
    return out.select("symbol", "close_ts", F.col(gap.id).alias("gap"), F.col(mean.id).alias("gap_mean"), F.col(f"{gap.id}_minus_{mean.id}").alias("gap_left"))


@query
def swing_highlow(spark, sf):
    return ft.feature_chain(src.event_bars(spark, sf), [ft.swing_highlow(4)]).select("symbol", "close_ts", "swing_highlow_4")


@query
def drop_malformed(spark, sf):
    b = src.event_bars(spark, sf).withColumn("close_ts", F.when(F.col("close_ts") % 7 == 0, 0).otherwise(F.col("close_ts")))
    return quality.drop_malformed(b)


@query
def quarantine(spark, sf):
    _, bad = quality.quarantine(
        src.event_bars(spark, sf), {"flat": F.col("high") > F.col("low"), "cheap": F.col("close") >= 5, "thin": F.col("volume") >= 2}
    )
    return bad


@query
def time_window(spark, sf):
    return quality.time_window(src.event_bars(spark, sf), 1704412800000, 1705276800000)


@query
def date_range(spark, sf):
    e = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return quality.date_range(e, "ts", "2024-01-05", "2024-01-10").select("event_id", "event_type", "value")


@query
def dedupe_bars(spark, sf):
    b = src.event_bars(spark, sf)
    both = quality.fan_in(b.withColumn("seq", F.lit(1)), src.event_bars(spark, sf).withColumn("close", F.col("close") + 1).withColumn("seq", F.lit(2)))
    return quality.dedupe_bars(both, "seq")


@query
def fan_in(spark, sf):
    return quality.fan_in(src.event_bars(spark, sf, "1d"), src.event_bars(spark, sf, "1d"), src.user_bars(spark, sf, "1d"))


@query
def find_gaps(spark, sf):
    return quality.find_gaps(src.user_bars(spark, sf), "1h")


@query
def limit_bars(spark, sf):
    return quality.limit_bars(src.user_bars(spark, sf), 5)


@query
def last_n(spark, sf):
    return quality.last_n(src.event_bars(spark, sf), 20)


@query
def sort_events(spark, sf):
    return quality.sort_events(src.event_bars(spark, sf, "1d"))


@query
def volume_direction(spark, sf):
    return quality.volume_direction(src.event_bars(spark, sf))


@query
def typical(spark, sf):
    return src.event_bars(spark, sf).select("symbol", "close_ts", round6(typical_price()).alias("typical_price"), F.timestamp_millis("close_ts").cast("string").alias("closed"))


@query
def pattern_markers(spark, sf):
    e = ft.feature_chain(src.event_bars(spark, sf), [ft.engulfing_candle()])
    return rounded(quality.pattern_markers(e, "engulfing_candle"), "y")


@query
def unpivot_features(spark, sf):
    return quality.unpivot_features(feature_chain(spark, sf), [s.id for s in SPECS])


@query
def export_summary(spark, sf):
    return quality.export_summary(ft.feature_chain(src.user_bars(spark, sf), [ft.sma(20), ft.rsi(14), ft.vwap(50)]))


@query
def month_range(spark, sf):
    """The months of all bars, and which symbols traded in them."""
    b = src.line_bars(spark, sf).select("symbol", F.trunc(F.timestamp_millis("open_ts"), "MM").alias("month")).distinct()
    span = b.agg(F.min("month").cast("string").alias("a"), F.max("month").cast("string").alias("z")).first()
    months = files.month_range(spark, span["a"] or "1970-01-01", span["z"] or "1970-01-01")
    return months.join(b, "month", "left").groupBy(F.col("month").cast("string").alias("month")).agg(F.count("symbol").alias("n_symbols"))


@query
def klines_csv(spark, sf):
    """Bars written as headerless kline files and read back."""
    path, b = f"{shared_dir(spark)}/klines", src.event_bars(spark, sf)
    fields = {"open_time": "open_ts", "close_time": "close_ts", **{c: c for c in ("open", "high", "low", "close", "volume")}}
    b.select(*[F.col(fields[c]).cast("string").alias(c) if c in fields else F.lit("0").alias(c) for c in files.KLINE_COLUMNS], "symbol").write.partitionBy("symbol").csv(path)
    return files.read_klines_csv(spark, path, F.regexp_extract("_metadata.file_path", "symbol=([^/]+)/", 1), "1h")[0]


@query
def kline_json(spark, sf):
    """Bars packed as one JSON payload a symbol and day, and parsed again."""
    b = src.event_bars(spark, sf)
    k = F.array(*[F.col(c).cast("string") for c in ("open_ts", "open", "high", "low", "close", "volume", "close_ts")])
    bodies = b.groupBy("symbol", F.floor(F.col("open_ts") / 86_400_000).alias("day")).agg(F.to_json(F.collect_list(k)).alias("body"))
    return files.parse_kline_json(bodies, "body", F.col("symbol"), "1h")


@query
def enriched_jsonl(spark, sf):
    """Enriched bars written as JSON lines and read back."""
    path = f"{shared_dir(spark)}/enriched"
    files.write_enriched(ft.feature_chain(src.event_bars(spark, sf), SPECS), path)
    doubles = ["open", "high", "low", "close", "volume", *[s.id for s in SPECS if s.id != "engulfing_candle"]]
    schema = "timestamp long, open_ts long, engulfing_candle int, " + ", ".join(f"{c} double" for c in doubles) + ", symbol string, timeframe string"
    return files.read_enriched(spark, path, schema).withColumnRenamed("timestamp", "close_ts").drop("time")


@query
def results_csv(spark, sf):
    """A result table written as CSV with a header and read back with its columns checked."""
    path = f"{shared_dir(spark)}/results"
    files.write_samples(_results(spark, sf).select("symbol", "sample_id", "lookback", "entry", "cost_bps", "y"), path, csv=True)
    return rounded(files.read_results(spark, path, ["sample_id", "lookback", "entry", "cost_bps", "y"]), "entry", "cost_bps", "y")


@query
def analysis_tables(spark, sf):
    """Indices and categories as one long table, written and read back."""
    path, idx = f"{shared_dir(spark)}/analysis", stored(_indices(spark, sf))
    files.write_analysis({"indices": idx, "groups": sobol.group_indices(idx, PROBLEM, ["symbol"])}, path)
    return rounded(files.read_analysis(spark, path), "value")


@query
def list_pairs(spark, sf):
    """Customers as trading pairs, one exchange document a nation."""
    pair = F.struct(
        F.col("c_name").alias("symbol"), F.when(F.col("c_acctbal") > 0, "TRADING").otherwise("BREAK").alias("status"),
        F.upper(F.col("c_mktsegment")).alias("quoteAsset"),
    )
    info = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.collect_list(pair).alias("symbols"))
    return files.list_pairs(info, "building", "CUSTOMER#00")


@query
def list_tickers(spark, sf):
    """The last day of every symbol as a ticker, prices as text."""
    b = src.event_bars(spark, sf, "1d").groupBy(F.concat(F.upper("symbol"), F.lit("USDT")).alias("symbol")).agg(
        F.max_by("close", "close_ts").cast("string").alias("lastPrice"), F.max_by("volume", "close_ts").cast("string").alias("volume"))
    return files.list_tickers(b, "usdt")


@query
def swing_points(spark, sf):
    return strategy.swing_points(src.event_bars(spark, sf)).drop("timeframe")


@query
def consecutive_up(spark, sf):
    return strategy.consecutive_up(src.user_bars(spark, sf)).select("symbol", "close_ts", "consecutive_up")


@query
def pullback_depth(spark, sf):
    return rounded(strategy.pullback_depth(src.event_bars(spark, sf)).select("symbol", "close_ts", "recent_high", "pullback_depth"), "pullback_depth")


@query
def trend_maturity(spark, sf):
    return strategy.trend_maturity(src.event_bars(spark, sf)).select("symbol", "close_ts", "higher_highs", "higher_lows", "consecutive_up", "maturity")


@query
def buy_the_dip(spark, sf):
    s = strategy.buy_the_dip(src.user_bars(spark, sf))
    return s.select(
        "symbol", "side", "ts", "metadata.trend_maturity", round6(F.col("metadata.pullback_depth")).alias("pullback_depth"), "metadata.recent_high",
        "metadata.swing_high_count", "metadata.swing_low_count",
    )


@query
def trend_maturity_chunked(spark, sf):
    """Trends of a few long symbols' minute bars, by scans over chunks of 400."""
    b = strategy.trend_maturity(src.event_bars(spark, sf, "1m"), chunk_rows=400)
    return b.select("symbol", "close_ts", "higher_highs", "higher_lows", "consecutive_up", "maturity")


@query
def buy_the_dip_chunked(spark, sf):
    """Signals on minute bars, by scans over chunks of 400."""
    s = strategy.buy_the_dip(src.event_bars(spark, sf, "1m"), chunk_rows=400)
    return s.select("symbol", "ts", "metadata.trend_maturity", round6(F.col("metadata.pullback_depth")).alias("pullback_depth"), "metadata.recent_high")


@query
def drawdown_chunked(spark, sf):
    """Drawdowns of hourly bars, by scans over chunks of 50."""
    d = bt.drawdown(bt.bar_returns(src.event_bars(spark, sf)), chunk_rows=50)
    return rounded(d.select("symbol", "close_ts", "drawdown"), "drawdown")


@query
def expire_signals(spark, sf):
    s = strategy.buy_the_dip(src.event_bars(spark, sf)).withColumn("expires_at", F.col("ts") + 86_400_000)
    return joins.expire_signals(s, 1705276800000).select("symbol", "ts", "expires_at")


@query
def bar_returns(spark, sf):
    return rounded(bt.bar_returns(src.event_bars(spark, sf)).select("symbol", "close_ts", "ret"), "ret")


@query
def rolling_sharpe(spark, sf):
    return rounded(bt.rolling_sharpe(bt.bar_returns(src.event_bars(spark, sf)), 20).select("symbol", "close_ts", "rolling_sharpe"), "rolling_sharpe")


@query
def drawdown(spark, sf):
    d = bt.drawdown(bt.bar_returns(src.line_bars(spark, sf)))
    return rounded(d.select("symbol", "close_ts", "drawdown"), "drawdown")


@query
def rolling_pair(spark, sf):
    p = joins.align_symbols(src.event_bars(spark, sf), "click")
    return rounded(bt.rolling_pair(p, 20).select("symbol", "close_ts", "corr", "beta", "spread"), "corr", "beta", "spread")


@query
def align_symbols(spark, sf):
    return joins.align_symbols(src.event_bars(spark, sf), "click").select("symbol", "close_ts", "close", "ref_close")


@query
def asof_price(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("event_type").alias("symbol"), (F.unix_millis(F.col("ts").cast("timestamp"))).alias("ts"))
    return joins.asof_price(e, src.event_bars(spark, sf), "ts")


@query
def expand_params(spark, sf):
    params = validation.grid(spark, {"entry": [0.02, 0.05], "cost_bps": [0, 5]})
    return joins.expand_params(src.event_bars(spark, sf, "1d"), params).select("symbol", "close_ts", "close", "param_id", "entry", "cost_bps")


@query
def walk_windows(spark, sf):
    return joins.walk_windows(src.event_bars(spark, sf), 100, 50, 50).select("symbol", "close_ts", "bar_idx", "window_id", "part")


def _run(spark, sf):
    bars = src.user_bars(spark, sf)
    return bt.run_backtest(bars, strategy.buy_the_dip(bars), hold=5, cost_bps=10)


@query
def run_backtest(spark, sf):
    return rounded(_run(spark, sf).select("symbol", "close_ts", "position", "turnover", "ret"), "ret")


@query
def backtest_metrics(spark, sf):
    m = bt.backtest_metrics(_run(spark, sf), ("symbol", "timeframe"), bars_per_year("1h"))
    return rounded(m.drop("cagr"), "sharpe", "log_cagr", "max_drawdown", "profit_factor", "total", "win_rate")


@query
def trades(spark, sf):
    return rounded(bt.trades(_run(spark, sf), 5, 5).drop("timeframe", "spell"), "pnl")


@query
def trade_concentration(spark, sf):
    c = bt.trade_concentration(bt.trades(_run(spark, sf), 5, 5))
    return rounded(c.drop("timeframe", "top_share"), "total_pnl", "top_pnl", "rest_pnl", "trade_sharpe", "rest_sharpe")


@query
def trade_periods(spark, sf):
    t = bt.trade_periods(bt.trades(_run(spark, sf), 5, 5)).withColumn("period", F.col("period").cast("string"))
    return rounded(t, "total_pnl", "win_rate")


def _fills(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"), F.when(F.col("l_returnflag") == "R", "sell").otherwise("buy").alias("side"),
        F.col("l_quantity").alias("fill_size"), F.try_divide("l_extendedprice", "l_quantity").alias("fill_price"),
        F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("filled_at"), F.struct("l_orderkey", "l_linenumber", "l_partkey").cast("string").alias("order_id"),
    )


@query
def net_positions(spark, sf):
    return bt.net_positions(_fills(spark, sf)).withColumn("cash_flow", F.round("cash_flow", 2))


@query
def average_cost(spark, sf):
    return rounded(bt.average_cost(_fills(spark, sf)), "entry_price", "realised")


@query
def positions_from_fills(spark, sf):
    prices = src.line_bars(spark, sf).groupBy("symbol").agg(F.max_by("close", "close_ts").alias("price"))
    return rounded(bt.positions_from_fills(_fills(spark, sf), prices), "entry_price", "realised", "price", "unrealised", "exposure")


_GRID = {"entry": [0.05, 0.1, 0.2, 0.3, 0.5], "cost_bps": [0, 5, 10]}
#: A coarse sweep of the size that the reference asks for: 2,000 sets.
SWEEP = {"entry": [round(0.01 * k, 2) for k in range(1, 51)], "cost_bps": list(range(40))}


def _swept(spark, sf):
    m = validation.param_sweep(src.event_bars(spark, sf, "1d"), validation.grid(spark, SWEEP, ints=["cost_bps"]))
    return rounded(m.drop("timeframe"), "total", "sharpe")


@query
def param_sweep(spark, sf):
    return _swept(spark, sf)


@query
def best_params(spark, sf):
    return validation.best_params(_swept(spark, sf), ["symbol"], "total")


#: Periods of two averages, and costs: 2,000 sets.
CROSS = {"fast": [2, 3, 4, 5, 6, 8, 10, 12, 15, 20], "slow": [10, 15, 20, 25, 30, 35, 40, 45, 50, 60], "cost_bps": list(range(20))}
#: The pullback strategy's parameters: 1,296 sets.
DIPS = {"early": [2, 3, 4], "confirmed": [1, 2], "pullback": [0.0, 0.01, 0.03, 0.1, 0.2, 0.4], "lookback": [1, 2, 3], "hold": [1, 3, 5, 8], "cost_bps": [0, 5, 10]}


@query
def sweep_ema_cross(spark, sf):
    """Crossings of two averages over hourly bars, for every pair of periods and cost."""
    m = sweeps.strategy_sweep(src.event_bars(spark, sf), validation.grid(spark, CROSS), sweeps.EmaCross())
    return rounded(m.drop("timeframe"), "total", "sharpe")


@query
def sweep_buy_the_dip(spark, sf):
    """The pullback strategy over hourly bars, in chunks of 300 bars."""
    m = sweeps.strategy_sweep(src.event_bars(spark, sf), validation.grid(spark, DIPS), sweeps.BuyTheDip(), chunk_rows=300)
    return rounded(m.drop("timeframe"), "total", "sharpe")


def _perturbed(spark, sf):
    p = validation.perturb(validation.grid(spark, {"entry": [0.1, 0.3], "cost_bps": [5]}), ["entry", "cost_bps"], combined=True)
    m = validation.param_sweep(src.event_bars(spark, sf), p)
    return validation.degradation(rounded(m, "total"), p, "total")


@query
def perturb(spark, sf):
    return rounded(_perturbed(spark, sf).drop("timeframe"), "loss")


@query
def surface_slice(spark, sf):
    grid = validation.grid(spark, SWEEP)
    s = validation.surface_slice(_swept(spark, sf), grid, "entry", ["cost_bps"])
    return rounded(s, "mean_total")


@query
def surface_plane(spark, sf):
    """Two parameters of three over a plane, the third at its lower quartile."""
    params = validation.grid(spark, {"entry": _GRID["entry"], "cost_bps": list(range(40)), "lookback": [1, 2, 3, 4, 5]})
    m = rounded(validation.param_sweep(src.event_bars(spark, sf, "1d"), params), "total")
    return rounded(validation.surface_slice(m, params, ["cost_bps", "lookback"], ["entry"], anchor=0.25), "mean_total")


@query
def lhs_sweep(spark, sf):
    """2,000 sets drawn as a Latin hypercube, two of their parameters whole numbers."""
    bounds = {"entry": (0.02, 0.5), "cost_bps": (0, 40), "lookback": (1, 5)}
    params = validation.lhs_params(spark, bounds, 2000, seed=2, ints=["cost_bps", "lookback"])
    m = validation.param_sweep(src.event_bars(spark, sf, "1d"), params)
    return rounded(m.select("param_id", "symbol", "n_trades", "total"), "total")


#: Null series of a significance test (the reference asks for 1,000 or more).
N_NULL = 1000


@query
def permute_returns(spark, sf):
    return rounded(bt.permute_returns(src.event_bars(spark, sf, "1d"), N_NULL, seed=1, block=3).drop("timeframe"), "ret")


@query
def null_prices(spark, sf):
    """Prices rebuilt along every null series of daily bars, as logarithms: their digits count alike at any size."""
    bars = src.event_bars(spark, sf, "1d")
    p = bt.null_prices(bars, bt.permute_returns(bars, N_NULL, seed=1))
    return p.select("rep", "symbol", "close_ts", round6(F.log("close")).alias("log_close"))


def _null(spark, sf):
    bars = src.event_bars(spark, sf)
    observed = validation.param_sweep(bars, validation.grid(spark, {"entry": [0.3], "cost_bps": [5]}))
    null = nulls.null_scores(bars, N_NULL, 0.3, 5, bars_per_year("1h"), seed=7)
    return bt.null_test(rounded(observed, "sharpe"), rounded(null, "sharpe"), ("symbol", "timeframe"), "sharpe")


@query
def null_test(spark, sf):
    return _null(spark, sf).drop("timeframe")


@query
def null_test_metrics(spark, sf):
    """Sharpe ratio, growth and drawdown of the real daily series against a thousand null ones in blocks of three."""
    found = nulls.null_scores(src.event_bars(spark, sf, "1d"), N_NULL, 0.1, 5, bars_per_year("1d"), seed=11, block=3, observed=True)
    return rounded(nulls.significance(rounded(found, *nulls.SCORES)).drop("timeframe"), "p_value", "quantile")


def _walk(spark, sf, anchored=False):
    r = validation.threshold_returns(src.event_bars(spark, sf), validation.grid(spark, _GRID))
    return r, validation.walk_forward(r, 200, 50, 50, anchored)


@query
def walk_forward(spark, sf):
    return rounded(_walk(spark, sf)[1].drop("timeframe"), "train_sharpe", "test_sharpe", "test_total")


@query
def walk_forward_anchored(spark, sf):
    return rounded(_walk(spark, sf, True)[1].drop("timeframe"), "train_sharpe", "test_sharpe", "test_total")


@query
def stitched(spark, sf):
    r, wf = _walk(spark, sf)
    return rounded(validation.stitched(r, wf, 200, 50, 50).drop("timeframe"), "ret")


@query
def wf_stability(spark, sf):
    s = validation.wf_stability(_walk(spark, sf)[1], validation.grid(spark, _GRID)).drop("timeframe")
    return rounded(s, "train_sharpe", "test_sharpe", "decay", "sd_entry", "sd_cost_bps")


def _mc_walk(spark, sf):
    bars = src.event_bars(spark, sf)
    return rounded(validation.seeded_walk_forward(bars, N_NULL, validation.grid(spark, _GRID), 200, 50, 50, seed=3), "test_sharpe")


def _walk_test(stability, null):
    return validation.walk_forward_test(rounded(stability, "test_sharpe"), null)


@query
def mc_walk_forward(spark, sf):
    """Every null series' mean test Sharpe ratio, beside the real one and its p value."""
    null = stored(_mc_walk(spark, sf))
    test = _walk_test(validation.wf_stability(_walk(spark, sf)[1]), null)
    return null.join(test, ["symbol", "timeframe"], "left").select("rep", "symbol", "test_sharpe", "observed", "n_null", "p_value", "rejects")


@query
def progress_gate(spark, sf):
    stability = stored(validation.wf_stability(_walk(spark, sf)[1]))
    gate = validation.progress_gate(
        stability, _null(spark, sf), out_of_sample=_walk_test(stability, _mc_walk(spark, sf)), surface=_perturbed(spark, sf)
    )
    return gate.drop("timeframe")


#: The strategy's parameters, one of each category.
PROBLEM = sobol.load_problem({
    "parameters": [
        {"name": "lookback", "bounds": [1, 5], "type": "int", "category": "signal-structural"},
        {"name": "entry", "bounds": [0.05, 0.5], "category": "signal-threshold"},
        {"name": "cost_bps", "bounds": [0, 50], "category": "execution"},
    ],
    "metrics": ["y"],
})


def _results(spark, sf):
    """Every sample as the strategy's parameters over each symbol's daily bars: y is the total return."""
    samples = sobol.saltelli_samples(spark, PROBLEM)
    sets = samples.select(F.col("sample_id").alias("param_id"), "lookback", "entry", "cost_bps")
    total = validation.param_sweep(src.event_bars(spark, sf, "1d"), sets).select(F.col("param_id").alias("sample_id"), "symbol", F.col("total").alias("y"))
    return stored(rounded(total.join(samples, "sample_id"), "y"))


def _indices(spark, sf):
    return sobol.sobol_indices(_results(spark, sf), PROBLEM, "y", ["symbol"])


@query
def saltelli_results(spark, sf):
    r = _results(spark, sf).select("symbol", "sample_id", "base_id", "block", "j", "lookback", "entry", "cost_bps", "y")
    return rounded(r, "entry", "cost_bps")


@query
def sobol_indices(spark, sf):
    return rounded(_indices(spark, sf), "value")


@query
def sobol_confidence(spark, sf):
    return rounded(sobol.sobol_confidence(_results(spark, sf), PROBLEM, "y", ["symbol"]), "s1_conf", "st_conf")


@query
def group_indices(spark, sf):
    return rounded(sobol.group_indices(_indices(spark, sf), PROBLEM, ["symbol"]), "s1", "st")


@query
def group_contributions(spark, sf):
    return rounded(sobol.group_contributions(sobol.group_indices(_indices(spark, sf), PROBLEM, ["symbol"]), ["symbol"]), "s1", "percent")


@query
def interaction_shares(spark, sf):
    return rounded(sobol.interaction_shares(_indices(spark, sf), ["symbol"]), "share")


@query
def cross_group(spark, sf):
    return rounded(sobol.cross_group(_indices(spark, sf), PROBLEM, ["symbol"]), "s2")


@query
def interaction_matrix(spark, sf):
    m = sobol.interaction_matrix(sobol.cross_group(_indices(spark, sf), PROBLEM, ["symbol"]), ["symbol"])
    return rounded(m, "signal_structural", "signal_threshold", "execution")


@query
def params_at_bounds(spark, sf):
    return sobol.params_at_bounds(_results(spark, sf), PROBLEM, "y", ["symbol"])


@query
def diagnostics(spark, sf):
    results, by = _results(spark, sf), ["symbol"]
    idx = stored(sobol.sobol_indices(results, PROBLEM, "y", by))
    bounds = sobol.params_at_bounds(results, PROBLEM, "y", by)
    return sobol.diagnostics(sobol.group_indices(idx, PROBLEM, by), sobol.cross_group(idx, PROBLEM, by), bounds, by)


@query
def top_params(spark, sf):
    return sobol.top_params(rounded(_indices(spark, sf), "value"), 3, ["symbol"])


@query
def heatmap(spark, sf):
    return rounded(sobol.heatmap(_results(spark, sf), PROBLEM, "entry", "cost_bps", "y", 20), "mean")


@query
def sweep(spark, sf):
    return rounded(sobol.sweep(_results(spark, sf), PROBLEM, "cost_bps", "y", 30), "mean", "sd", "centre")


@query
def fill_nan_mean(spark, sf):
    r = _results(spark, sf).withColumn("y", F.when(F.col("sample_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("y")))
    return rounded(sobol.fill_nan_mean(r, ["y"], ["symbol"]).select("symbol", "sample_id", "y"), "y")


@query
def missing_samples(spark, sf):
    r = _results(spark, sf).select("symbol", F.concat_ws("/", "symbol", F.col("sample_id").cast("string")).alias("sample_id"), "y")
    return joins.missing_samples(r.select("sample_id"), r.filter("y > 0"))


@query
def sample_plan(spark, sf):
    return sobol.sample_plan(src.user_bars(spark, sf).groupBy("symbol").agg(F.count("*").alias("n_bars")), PROBLEM)


def _drained(stream: DataFrame) -> DataFrame:
    """All rows that a stream emits for what is there now."""
    spark = stream.sparkSession
    at = shared_dir(spark)
    writer = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/progress")
    streams.replay(writer).awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


@query
def stream_ticks_to_bars(spark, sf):
    ticks = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/events.parquet*")
    return _drained(streams.stream_ticks_to_bars(ticks, "ts", "event_type", "value", "1.0", "1h", "10 minutes"))


@query
def stream_features(spark, sf):
    at = shared_dir(spark)
    src.event_bars(spark, sf).write.parquet(at)
    specs = [("sma", {"period": 20}), ("ema", {"period": 20}), ("rsi", {"period": 14}), ("engulfing_candle", {})]
    out = _drained(streams.stream_features(streams.stream_bars(spark, at, 10_000), specs))
    ids = ["sma_20", "ema_20", "rsi_14", "engulfing_candle"]
    out = out.select("symbol", "close_ts", "close", *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ids])
    return out.withColumn("engulfing_candle", F.col("engulfing_candle").cast("int"))


@query
def stream_signals(spark, sf):
    at = shared_dir(spark)
    src.user_bars(spark, sf).write.parquet(at)
    out = _drained(streams.stream_signals(streams.stream_bars(spark, at, 10_000)))
    return rounded(out.drop("timeframe", "source"), "pullback_depth")


@query
def stream_klines(spark, sf):
    """Headerless kline files of every symbol, read as a stream."""
    path, b = f"{shared_dir(spark)}/klines", src.event_bars(spark, sf)
    fields = {"open_time": "open_ts", "close_time": "close_ts", **{c: c for c in ("open", "high", "low", "close", "volume")}}
    b.select(*[F.col(fields[c]).cast("string").alias(c) if c in fields else F.lit("0").alias(c) for c in files.KLINE_COLUMNS], "symbol").write.partitionBy("symbol").csv(path)
    return _drained(streams.stream_klines(spark, path, 10_000, F.regexp_extract("_metadata.file_path", "symbol=([^/]+)/", 1), "1h")[0])


@query
def stream_ordered_features(spark, sf):
    """Bars that come up to six hours late, held back until they are in order."""
    at, delay, parts = shared_dir(spark), 6 * 3_600_000, 4
    b = stored(src.event_bars(spark, sf).withColumn("_key", F.col("close_ts") + F.pmod(F.xxhash64("symbol", "close_ts"), F.lit(delay))))
    low, high = b.agg(F.min("_key"), F.max("_key")).first()
    step = ((high or 0) - (low or 0)) // parts + 1
    for i in range(parts):  # one file after the other
        mine = b.filter(F.floor((F.col("_key") - F.lit(low or 0)) / step) == i).drop("_key")
        mine.coalesce(1).write.mode("append").parquet(at)
    specs = [("difference", {"a": "sma_20", "b": "ema_20"}), ("sma", {"period": 20}), ("ema", {"period": 20}), ("rsi", {"period": 14})]
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    timed.use_timers(spark)
    try:
        out = _drained(timed.ordered_features(streams.stream_bars(spark, at, 1), specs, "6 hours"))
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    ids = {"sma_20": "sma_20", "ema_20": "ema_20", "rsi_14": "rsi_14", "sma_20_minus_ema_20": "gap"}
    return out.select("symbol", "close_ts", "close", *[F.when(~F.isnan(c), F.col(c)).alias(n) for c, n in ids.items()])
