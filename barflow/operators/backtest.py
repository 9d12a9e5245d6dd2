"""Causal backtest: positions, returns, metrics, trades, and null distributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import KEYS, by_time
from .scan import Scan, in_chunks, scan


def bar_returns(bars: DataFrame) -> DataFrame:
    """``ret``: from this close to the next; null on the last bar and after a close of zero."""
    return bars.withColumn("ret", F.try_divide(F.lead("close").over(by_time()), "close") - 1)


def rolling_sharpe(returns: DataFrame, n: int) -> DataFrame:
    w = by_time().rowsBetween(-(n - 1), 0)
    sd = F.stddev_samp("ret").over(w)
    full = F.count("ret").over(w) == n
    return returns.withColumn("rolling_sharpe", F.when(full & (sd > 0), F.avg("ret").over(w) / F.nullif(sd, F.lit(0.0))))


def drawdown(returns: DataFrame, keys=KEYS, chunk_rows: int | None = None) -> DataFrame:
    """equity (compounded), drawdown (equity over its maximum so far, less one).

    With ``chunk_rows`` by scans over chunks, for long symbols (``keys`` are then symbol and timeframe).
    """
    grown = F.log1p(F.greatest(F.coalesce("ret", F.lit(0.0)), F.lit(-0.999999)))
    fall = F.col("equity") / F.greatest("_top", F.lit(1.0)) - 1
    if chunk_rows:
        if tuple(keys) != KEYS:
            raise ValueError(f"chunks are of {', '.join(KEYS)}")
        r = scan(in_chunks(returns, chunk_rows, 0, {}), {"_log": Scan("sum", grown)}).withColumn("equity", F.exp("_log"))
        return scan(r, {"_top": Scan("max", F.col("equity"))}).select(*returns.columns, "equity", fall.alias("drawdown"))
    upto = Window.partitionBy(*keys).orderBy("close_ts").rowsBetween(Window.unboundedPreceding, 0)
    r = returns.withColumn("equity", F.exp(F.sum(grown).over(upto)))
    return r.withColumn("_top", F.max("equity").over(upto)).withColumn("drawdown", fall).drop("_top")


def rolling_pair(pairs: DataFrame, n: int) -> DataFrame:
    """corr, beta and spread of close against ref_close over the last n bars."""
    w = by_time().rowsBetween(-(n - 1), 0)
    full = F.count("close").over(w) == n
    beta = F.covar_samp("close", "ref_close").over(w) / F.nullif(F.var_samp("ref_close").over(w), F.lit(0.0))
    return pairs.withColumns({
        "corr": F.when(full, F.corr("close", "ref_close").over(w)),
        "beta": F.when(full, beta),
        "spread": F.col("close") - F.col("ref_close"),
    })


def run_backtest(bars: DataFrame, signals: DataFrame, hold: int | None = 5, cost_bps: float = 0.0) -> DataFrame:
    """Long from a buy signal's bar for ``hold`` bars: position, ret (net of cost on changes).

    With ``hold=None`` a position is held from a buy signal to the next sell signal (side); of
    two at one bar the sell counts. Signals with a timeframe act on bars of theirs only. A
    missing return (last bar, zero close) counts as none.
    """
    keys = [c for c in KEYS if c in signals.columns]
    side = F.max((F.col("side") == "sell").cast("int")) if "side" in signals.columns else F.lit(0)
    s = signals.groupBy(*keys, F.col("ts").alias("close_ts")).agg((1 - side).alias("_sig"))
    b = bar_returns(bars).join(s, [*keys, "close_ts"], "left")
    w = by_time()
    if hold is None:
        held = F.coalesce(F.last("_sig", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    else:
        held = F.coalesce(F.max("_sig").over(w.rowsBetween(-(hold - 1), 0)), F.lit(0))
    b = b.withColumn("position", held).withColumn("_change", F.abs(F.col("position") - F.coalesce(F.lag("position").over(w), F.lit(0))))
    net = F.col("position") * F.coalesce("ret", F.lit(0.0)) - F.col("_change") * (cost_bps / 1e4)
    return b.select(*bars.columns, "position", F.col("_change").alias("turnover"), net.alias("ret"))


def backtest_metrics(returns: DataFrame, by: tuple[str, ...], bars_per_year: float) -> DataFrame:
    """sharpe, cagr, log_cagr (log of 1 + cagr), max_drawdown, profit_factor, total, turnover, n_trades, win_rate for each run key.

    A trade runs from its entry to the bar before the next one; what is still held at the last
    bar counts as a trade, but not for the win rate. ``cagr`` compounds over a 365-day year.
    """
    d = drawdown(returns, by)
    w = Window.partitionBy(*by).orderBy("close_ts")
    d = d.withColumn("_new", ((F.col("position") != 0) & (F.coalesce(F.lag("position").over(w), F.lit(0)) == 0)).cast("long"))
    d = d.withColumn("_trade", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    own = Window.partitionBy(*by, "_trade")
    closed = (F.col("_new") == 1) & (F.min(F.abs("position")).over(own) == 0)
    d = d.withColumn("_closed", closed.cast("long")).withColumn("_won", (closed & (F.sum("ret").over(own) > 0)).cast("long"))
    n = F.count("ret")
    sd = F.stddev_samp("ret")
    m = d.groupBy(*by).agg(
        n.alias("n_bars"),
        (F.avg("ret") / F.nullif(sd, F.lit(0.0)) * F.lit(bars_per_year**0.5)).alias("sharpe"),
        F.sum(F.log1p(F.greatest("ret", F.lit(-0.999999)))).alias("_log"),
        F.min("drawdown").alias("max_drawdown"),
        (F.sum(F.greatest("ret", F.lit(0.0))) / F.nullif(F.abs(F.sum(F.least("ret", F.lit(0.0)))), F.lit(0.0))).alias("profit_factor"),
        F.sum("ret").alias("total"),
        F.sum("turnover").alias("turnover"), F.sum("_new").alias("n_trades"), F.try_divide(F.sum("_won"), F.sum("_closed")).alias("win_rate"),
    )
    m = m.withColumn("log_cagr", F.try_divide(F.col("_log") * bars_per_year, "n_bars")).drop("_log")
    return m.withColumn("cagr", F.expm1(F.least("log_cagr", F.lit(700.0))))


def trades(positions: DataFrame, fee_bps: float = 0.0, slip_bps: float = 0.0) -> DataFrame:
    """Contiguous holding spells: entry, exit, bars held, pnl after costs on both sides."""
    w = by_time()
    p = positions.withColumn("_exit", F.coalesce(F.lead("close").over(w), F.col("close")))
    p = p.withColumn("_new", ((F.col("position") != 0) & (F.coalesce(F.lag("position").over(w), F.lit(0)) == 0)).cast("int"))
    p = p.withColumn("spell", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("position <> 0")
    t = p.groupBy(*KEYS, "spell").agg(
        F.min("close_ts").alias("entry_ts"), F.max("close_ts").alias("exit_ts"), F.count("*").alias("bars_held"),
        F.min_by("close", "close_ts").alias("entry_price"), F.max_by("_exit", "close_ts").alias("exit_price"),
    )
    cost = 2 * (fee_bps + slip_bps) / 1e4
    return t.withColumn("pnl", F.try_divide("exit_price", "entry_price") - 1 - cost)  # null after an entry at zero


def trade_concentration(trades_: DataFrame, n: int = 5) -> DataFrame:
    """Of each symbol and timeframe: total pnl, pnl of its n best trades, what is left without them,
    the best ones' share, and mean over deviation of all trades and of the rest."""
    w = Window.partitionBy(*KEYS).orderBy(F.desc_nulls_last("pnl"), "entry_ts")
    t = trades_.withColumn("_r", F.row_number().over(w))
    top, rest = F.when(F.col("_r") <= n, F.col("pnl")), F.when(F.col("_r") > n, F.col("pnl"))
    ratio = lambda c: F.try_divide(F.avg(c), F.stddev_samp(c))
    g = t.groupBy(*KEYS).agg(
        F.count("*").alias("n_trades"), F.sum("pnl").alias("total_pnl"), F.coalesce(F.sum(top), F.lit(0.0)).alias("top_pnl"),
        ratio(F.col("pnl")).alias("trade_sharpe"), ratio(rest).alias("rest_sharpe"),
    )
    return g.withColumns({"rest_pnl": F.col("total_pnl") - F.col("top_pnl"), "top_share": F.try_divide("top_pnl", "total_pnl")})


def trade_periods(trades_: DataFrame, period: str = "MM") -> DataFrame:
    """Trades, pnl and share of winners of each symbol, timeframe and calendar period of entry."""
    at = F.trunc(F.timestamp_millis("entry_ts"), period).alias("period")
    return trades_.groupBy(*KEYS, at).agg(
        F.count("*").alias("n_trades"), F.sum("pnl").alias("total_pnl"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate")
    )


def net_positions(fills: DataFrame) -> DataFrame:
    """Signed size and cash flow of each symbol."""
    sign = F.when(F.col("side") == "buy", 1).otherwise(-1)
    return fills.groupBy("symbol").agg(
        F.sum(sign * F.col("fill_size")).alias("net_size"), F.sum(-sign * F.col("fill_size") * F.col("fill_price")).alias("cash_flow"),
        F.count("*").alias("n_fills"),
    )


def average_cost(fills: DataFrame) -> DataFrame:
    """symbol, size, entry_price, realised: the pnl realised by average cost.

    Sequential by nature: a partition holds whole symbols in order of time, and a loop carries
    three numbers from fill to fill, so no symbol is ever held in memory. Rows lacking a size
    or a price are left out.
    """

    def ledger(batches):
        import pandas as pd

        now, size, cost, realised = None, 0.0, 0.0, 0.0
        for df in batches:
            out = []
            for symbol, side, q, price in df[["symbol", "side", "fill_size", "fill_price"]].itertuples(index=False):
                if symbol != now:
                    if now is not None:
                        out.append((now, size, cost if size else 0.0, realised))
                    now, size, cost, realised = symbol, 0.0, 0.0, 0.0
                q = q if side == "buy" else -q
                if size * q >= 0:
                    cost = (cost * abs(size) + price * abs(q)) / (abs(size) + abs(q)) if q else cost
                else:
                    realised += min(abs(size), abs(q)) * (price - cost) * (1 if size > 0 else -1)
                    cost = price if abs(q) > abs(size) else cost
                size += q
            yield pd.DataFrame(out, columns=["symbol", "size", "entry_price", "realised"])
        if now is not None:
            yield pd.DataFrame([(now, size, cost if size else 0.0, realised)], columns=["symbol", "size", "entry_price", "realised"])

    rows = fills.filter("symbol is not null and fill_size is not null and fill_price is not null")
    rows = rows.repartition("symbol").sortWithinPartitions("symbol", "filled_at", "order_id").select("symbol", "side", "fill_size", "fill_price")
    return rows.mapInPandas(ledger, "symbol string, size double, entry_price double, realised double")


def positions_from_fills(fills: DataFrame, prices: DataFrame) -> DataFrame:
    """symbol, size, entry_price, realised, price, unrealised, exposure.

    ``prices`` has symbol and price (its last one); without a price the last two are null.
    """
    p = average_cost(fills).join(prices.select("symbol", "price"), "symbol", "left")
    return p.withColumns({"unrealised": F.col("size") * (F.col("price") - F.col("entry_price")), "exposure": F.col("size") * F.col("price")})


#: A linear congruence modulo a Mersenne prime, squared between steps.
MODULUS = 2_147_483_647


def mixed(x: str, salt: str) -> str:
    """SQL of a reproducible hash of two non-negative integers, the same in any engine."""
    a = f"((({x}) % 1000003) * 48271 + ({salt}) * 69621 + 7) % {MODULUS}"
    b = f"(({a}) * ({a}) + ({x})) % {MODULUS}"
    return f"(({b}) % 46337 * (({b}) % 46327) + ({b}) * 16807 + ({x})) % {MODULUS}"


def permute_returns(bars: DataFrame, n_reps: int, seed: int = 0, block: int = 1) -> DataFrame:
    """Null series: each symbol's returns in a shuffled order, once for every repetition.

    rep, symbol, timeframe, close_ts, ret. Blocks of ``block`` bars stay together. The order
    comes from a hash of (repetition, block), not from row order, so it repeats anywhere.
    """
    r = bar_returns(bars).filter("ret is not null")
    w = Window.partitionBy(*KEYS).orderBy("close_ts")
    r = r.withColumn("_i", F.row_number().over(w).cast("long") - 1).select(*KEYS, "close_ts", "ret", "_i")
    reps = r.withColumn("rep", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_reps - 1).cast("long"))))
    reps = reps.withColumn("_h", F.expr(mixed(f"_i div {block}", f"rep + {seed}")))
    drawn = reps.withColumn("_j", F.row_number().over(Window.partitionBy("rep", *KEYS).orderBy("_h", "_i")).cast("long") - 1)
    here = reps.select("rep", *KEYS, "close_ts", F.col("_i").alias("_j"))
    return here.join(drawn.select("rep", *KEYS, "_j", "ret"), ["rep", *KEYS, "_j"]).drop("_j")


def null_prices(bars: DataFrame, null_returns: DataFrame) -> DataFrame:
    """rep, symbol, timeframe, close_ts, close: prices rebuilt along null series, from the first close.

    The close of a bar's successor follows its return, so each price stands at the bar after it.
    """
    first = bars.groupBy(*KEYS).agg(F.min_by("close", "close_ts").alias("_first"))
    upto = Window.partitionBy("rep", *KEYS).orderBy("close_ts").rowsBetween(Window.unboundedPreceding, 0)
    grown = F.exp(F.sum(F.log1p(F.greatest("ret", F.lit(-0.999999)))).over(upto))
    return null_returns.join(first, list(KEYS)).select("rep", *KEYS, "close_ts", (F.col("_first") * grown).alias("close"))


def null_test(observed: DataFrame, null: DataFrame, by: tuple[str, ...], metric: str) -> DataFrame:
    """p value (1 + how many null values reach the observed) / (1 + n), its quantile rank, and whether 5 % rejects.

    Missing null values do not count; of a missing observed value nothing is rejected.
    """
    j = null.select(*by, F.col(metric).alias("_null")).join(observed.select(*by, metric), list(by))
    reached, below = (F.sum(F.when(c, 1).otherwise(0)) for c in (F.col("_null") >= F.col(metric), F.col("_null") < F.col(metric)))
    n = F.count("_null")
    g = j.groupBy(*by, F.col(metric).alias("observed")).agg(
        n.alias("n_null"), ((1 + reached) / (1 + n)).alias("p_value"), F.try_divide(below, n).alias("quantile")
    )
    known = F.col("observed").isNotNull()
    return g.withColumn("p_value", F.when(known, F.col("p_value"))).withColumn("rejects", F.coalesce(known & (F.col("p_value") <= 0.05), F.lit(False)))
