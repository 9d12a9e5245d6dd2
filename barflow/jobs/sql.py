"""DuckDB twins of the registered queries."""

from __future__ import annotations

import re

from ..functions.schema import TIMEFRAMES
from ..operators.backtest import MODULUS, mixed
from ..operators.sequences import permutation, sobol_number
from ..operators.validation import FACTORS
from .queries import CROSS, DIPS, N_NULL, SWEEP

R6 = "(round(round(({}) * 1e6, 3)) / 1e6 + 0.0)"


def r6(x: str) -> str:
    return R6.format(x)


def bars(kind: str, tf: str, name: str = "bars") -> str:
    step = TIMEFRAMES[tf]
    sym, ts, price, size, tie, table = {
        "event": ("event_type", "ts", "value", "1.0", "event_id", "events"),
        "user": ("user_id", "ts", "value", "1.0", "event_id", "events"),
        "line": ("l_suppkey", "l_shipdate", "l_extendedprice / nullif(l_quantity, 0)", "l_quantity", "l_orderkey, l_linenumber, l_partkey", "lineitem"),
    }[kind]
    return f"""{name} AS (
  SELECT symbol, '{tf}' AS timeframe, b * {step} AS open_ts, b * {step} + {step - 1} AS close_ts,
    first(p ORDER BY ms, {tie}) AS open, max(p) AS high, min(p) AS low, last(p ORDER BY ms, {tie}) AS close, sum(v) AS volume
  FROM (SELECT CAST({sym} AS VARCHAR) AS symbol, epoch_us({ts}) // 1000 AS ms, epoch_us({ts}) // 1000 // {step} AS b,
    CAST({price} AS DOUBLE) AS p, CAST({size} AS DOUBLE) AS v, {tie} FROM {table}) GROUP BY symbol, b)"""


W = "PARTITION BY symbol, timeframe ORDER BY close_ts"


def rows(n: int) -> str:
    return f"({W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def _sma(p):
    return f"CASE WHEN count(close) OVER {rows(p)} = {p} THEN {r6(f'avg(close) OVER {rows(p)}')} END AS sma_{p}"


def _ema(p):
    a = 2.0 / (p + 1)
    c = f"list(close) OVER {rows(2 * p)}"
    return (
        f"CASE WHEN count(close) OVER {rows(2 * p)} >= {p} THEN "
        + r6(f"list_reduce(list_prepend(list_sum(list_slice({c}, 1, {p})) / {p}, list_slice({c}, {p + 1}, {2 * p})), lambda e, x: x * {a!r} + e * {1 - a!r})")
        + f" END AS ema_{p}"
    )


def _rsi(p):
    up, down = (f"sum(greatest({s}change, 0.0)) OVER {rows(p)} / {p}" for s in ("", "-"))
    return (
        f"CASE WHEN count(change) OVER {rows(p)} = {p} THEN CASE WHEN {down} = 0 THEN 100.0 "
        f"ELSE {r6(f'100 - 100 / (1 + ({up}) / nullif({down}, 0))')} END END AS rsi_{p}"
    )


def _vwap(p):
    money, vol = f"sum((high + low + close) / 3 * volume) OVER {rows(p)}", f"sum(volume) OVER {rows(p)}"
    return f"CASE WHEN count(close) OVER {rows(p)} = {p} AND {vol} <> 0 THEN {r6(f'({money}) / nullif({vol}, 0)')} END AS vwap_{p}"


ENGULF = f"""CASE WHEN lag(open) OVER ({W}) IS NULL THEN NULL
  WHEN (close > open) = (lag(close) OVER ({W}) > lag(open) OVER ({W})) THEN 0
  WHEN close > open AND open < lag(close) OVER ({W}) AND close > lag(open) OVER ({W}) THEN 1
  WHEN NOT close > open AND open > lag(close) OVER ({W}) AND close < lag(open) OVER ({W}) THEN -1 ELSE 0 END AS engulfing_candle"""
CHANGE = f"ch AS (SELECT *, close - lag(close) OVER ({W}) AS change FROM bars)"
FEATURES = ", ".join([ENGULF, _vwap(20), _vwap(50), _ema(20), _ema(50), _sma(20), _rsi(14)])
COLS = "symbol, timeframe, open_ts, close_ts, open, high, low, close, volume"
RCOLS = "symbol, timeframe, open_ts, close_ts, " + ", ".join(f"{r6(c)} AS {c}" for c in ("open", "high", "low", "close")) + ", volume"
EV, US, LI = bars("event", "1h"), bars("user", "1h"), bars("line", "1d")
DAY = bars("event", "1d")

RET = f"ret AS (SELECT *, lead(close) OVER ({W}) / nullif(close, 0) - 1 AS ret FROM bars)"
UNB = f"({W} ROWS UNBOUNDED PRECEDING)"


def swings(lb: int) -> str:
    left, right = f"({W} ROWS BETWEEN {2 * lb} PRECEDING AND {lb + 1} PRECEDING)", f"({W} ROWS BETWEEN {lb - 1} PRECEDING AND CURRENT ROW)"
    full = f"count(*) OVER {rows(2 * lb + 1)} = {2 * lb + 1}"
    high, low = f"lag(high, {lb}) OVER ({W})", f"lag(low, {lb}) OVER ({W})"
    return (
        f"CASE WHEN {full} AND {high} > max(high) OVER {left} AND {high} > max(high) OVER {right} THEN {high} END AS swing_high, "
        f"CASE WHEN {full} AND {low} < min(low) OVER {left} AND {low} < min(low) OVER {right} THEN {low} END AS swing_low"
    )


UPS = f"""u0 AS (SELECT *, coalesce(close > lag(close) OVER ({W}), false) AS up, {swings(2)} FROM bars),
u1 AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER {UNB} AS isl,
  CASE WHEN swing_high IS NOT NULL THEN coalesce(swing_high > last_value(swing_high IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) END AS rh,
  CASE WHEN swing_low IS NOT NULL THEN coalesce(swing_low > last_value(swing_low IGNORE NULLS) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) END AS rl FROM u0),
u2 AS (SELECT *, sum(CASE WHEN NOT rh THEN 1 ELSE 0 END) OVER {UNB} AS ih, sum(CASE WHEN NOT rl THEN 1 ELSE 0 END) OVER {UNB} AS il FROM u1),
u3 AS (SELECT *, CAST(sum(CASE WHEN up THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, timeframe, isl ORDER BY close_ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS consecutive_up,
  CAST(sum(CASE WHEN rh THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, timeframe, ih ORDER BY close_ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS higher_highs,
  CAST(sum(CASE WHEN rl THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, timeframe, il ORDER BY close_ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS higher_lows,
  max(high) OVER {UNB} AS recent_high FROM u2),
trend AS (SELECT *, (recent_high - close) / nullif(recent_high, 0) AS pullback_depth,
  CASE WHEN least(higher_highs, higher_lows) >= 3 THEN 'mature' WHEN least(higher_highs, higher_lows) >= 2 THEN 'confirmed'
    WHEN consecutive_up >= 3 THEN 'early' ELSE 'none' END AS maturity FROM u3)"""

DIP = f"""{UPS},
s0 AS (SELECT *, sum(CASE WHEN coalesce(high > prev_high, true) THEN 1 ELSE 0 END) OVER {UNB} AS seg
  FROM (SELECT *, lag(recent_high) OVER ({W}) AS prev_high FROM trend)),
s1 AS (SELECT *, coalesce(sum(CASE WHEN maturity <> 'none' THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, timeframe, seg ORDER BY close_ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS blk FROM s0),
s2 AS (SELECT *, max(CASE WHEN pullback_depth >= 0.03 THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, timeframe, seg, blk ORDER BY close_ts ROWS UNBOUNDED PRECEDING) AS hit FROM s1),
sig AS (SELECT * FROM s2 WHERE maturity <> 'none' AND hit = 1)"""

RUN = f"""{US}, {DIP}, {RET},
p0 AS (SELECT ret.*, CASE WHEN sig.symbol IS NOT NULL THEN 1 END AS s FROM ret LEFT JOIN sig ON ret.symbol = sig.symbol AND ret.close_ts = sig.close_ts),
p1 AS (SELECT *, coalesce(max(s) OVER {rows(5)}, 0) AS position FROM p0),
p2 AS (SELECT *, abs(position - coalesce(lag(position) OVER ({W}), 0)) AS turnover FROM p1),
run AS (SELECT {COLS}, position, turnover, position * coalesce(ret, 0.0) - turnover * 0.001 AS ret FROM p2)"""

TRADES = f"""{RUN},
t0 AS (SELECT *, coalesce(lead(close) OVER ({W}), close) AS xp, CASE WHEN position <> 0 AND coalesce(lag(position) OVER ({W}), 0) = 0 THEN 1 ELSE 0 END AS nw FROM run),
t1 AS (SELECT *, sum(nw) OVER {UNB} AS spell FROM t0),
tr AS (SELECT symbol, min(close_ts) AS entry_ts, max(close_ts) AS exit_ts, count(*) AS bars_held, arg_min(close, close_ts) AS entry_price,
  arg_max(xp, close_ts) AS exit_price FROM t1 WHERE position <> 0 GROUP BY symbol, timeframe, spell),
trades AS (SELECT *, exit_price / nullif(entry_price, 0) - 1 - 0.002 AS pnl FROM tr)"""

DD = f"""dd AS (SELECT *, exp(sum(ln(1 + greatest(coalesce(ret, 0.0), -0.999999))) OVER {UNB}) AS equity FROM {{src}}),
dr AS (SELECT *, equity / greatest(max(equity) OVER {UNB}, 1.0) - 1 AS drawdown FROM dd)"""


def grid_sql(entries, costs) -> str:
    vals = ", ".join(f"({i * len(costs) + k}, CAST({e} AS DOUBLE), CAST({c} AS DOUBLE))" for i, e in enumerate(entries) for k, c in enumerate(costs))
    return f"params(param_id, entry, cost_bps) AS (VALUES {vals})"


THR = f"""f AS (SELECT *, 1 - close / nullif(lag(close) OVER ({W}), 0) AS fall FROM ret),
thr AS (SELECT param_id, symbol, timeframe, close_ts, coalesce(CASE WHEN fall >= entry THEN 1 ELSE 0 END, 0) AS position,
  coalesce(CASE WHEN fall >= entry THEN 1 ELSE 0 END, 0) * coalesce(ret, 0.0) - coalesce(CASE WHEN fall >= entry THEN 1 ELSE 0 END, 0) * cost_bps / 1e4 AS ret FROM f, params),
ps AS (SELECT param_id, symbol, count(*) AS n_bars, CAST(sum(position) AS BIGINT) AS n_trades, sum(ret) AS total, avg(ret) / nullif(stddev_samp(ret), 0) AS sharpe FROM thr GROUP BY param_id, symbol)"""
GRID = grid_sql([0.05, 0.1, 0.2, 0.3, 0.5], [0, 5, 10])


def perm(n_reps: int, seed: int, block: int = 1) -> str:
    h = mixed(f"(i // {block})", f"rep + {seed}")
    return f"""pr AS (SELECT symbol, timeframe, close_ts, ret, row_number() OVER ({W}) - 1 AS i FROM ret WHERE ret IS NOT NULL),
reps AS (SELECT symbol, timeframe, close_ts, ret, i, CAST(rep AS BIGINT) AS rep, {h} AS h FROM (SELECT pr.*, unnest(range(0, {n_reps})) AS rep FROM pr)),
drawn AS (SELECT rep, symbol, timeframe, ret, row_number() OVER (PARTITION BY rep, symbol, timeframe ORDER BY h, i) - 1 AS i FROM reps),
null_ret AS (SELECT reps.rep, reps.symbol, reps.timeframe, reps.close_ts, drawn.ret FROM reps JOIN drawn USING (rep, symbol, timeframe, i))"""


def sweep_sql() -> str:
    """The grid of the coarse sweep."""
    entries, n = SWEEP["entry"], len(SWEEP["cost_bps"])
    return f"""params AS (SELECT e_i * {n} + c AS param_id, entry, CAST(c AS DOUBLE) AS cost_bps
  FROM (SELECT unnest({entries}::DOUBLE[]) AS entry, unnest(range(0, {len(entries)})) AS e_i), (SELECT unnest(range(0, {n})) AS c))"""


def lhs_sql(bounds: dict, n: int, seed: int, ints=()) -> str:
    table, cols = f"SELECT CAST(range AS BIGINT) AS param_id FROM range({n})", []
    for k, (name, (lo, hi)) in enumerate(bounds.items()):
        for step, sql in permutation("param_id", n, 1000 * seed + 10 * k, f"s{k}"):
            table, last = f"SELECT *, {sql} AS {step} FROM ({table})", step
        value = f"{float(lo)} + ({last} + (({mixed('param_id', str(1000 * seed + 500 + k))}) + 0.5) / {MODULUS}) / {n} * ({hi} - {lo})"
        cols.append(f"round_even({value}, 0) AS {name}" if name in ints else f"{value} AS {name}")
    return f"params AS MATERIALIZED (SELECT param_id, {', '.join(cols)} FROM ({table}))"


def lookback_sql(most: int, params: str = "params") -> str:
    """Totals of each parameter set (with a lookback) and symbol."""
    falls = ", ".join(f"1 - close / nullif(lag(close, {k}) OVER ({W}), 0)" for k in range(1, most + 1))
    pos = "coalesce(CASE WHEN falls[CAST(lookback AS INTEGER)] >= entry THEN 1 ELSE 0 END, 0)"
    return f"""fl AS (SELECT *, [{falls}] AS falls FROM ret),
ths AS (SELECT {params}.*, symbol, {pos} AS position, {pos} * coalesce(ret, 0.0) - {pos} * cost_bps / 1e4 AS ret FROM fl, {params})"""


def product_sql(axes: dict[str, list]) -> str:
    """Every combination of the axes' values, numbered in the axes' order."""
    stride, number, tables = 1, [], []
    for name, values in reversed(axes.items()):
        number.append(f"{name}_i * {stride}")
        tables.append(f"(SELECT unnest({[float(v) for v in values]}::DOUBLE[]) AS {name}, unnest(range(0, {len(values)})) AS {name}_i)")
        stride *= len(values)
    return f"params AS (SELECT CAST({' + '.join(number)} AS BIGINT) AS param_id, {', '.join(axes)} FROM {', '.join(tables)})"


#: Position -> metrics of each parameter set and symbol.
SWEPT = f"""n0 AS (SELECT *, coalesce(lag(position) OVER (PARTITION BY param_id, symbol ORDER BY close_ts), 0) AS earlier FROM held),
n1 AS (SELECT *, position * coalesce(ret, 0.0) - abs(position - earlier) * cost_bps / 1e4 AS net FROM n0)
SELECT param_id, symbol, count(*) AS n_bars, CAST(sum(CASE WHEN position > earlier THEN 1 ELSE 0 END) AS BIGINT) AS n_trades, {r6('sum(net)')} AS total,
  {r6('avg(net) / nullif(stddev_samp(net), 0)')} AS sharpe FROM n1 GROUP BY param_id, symbol"""


def cross_sql() -> str:
    periods = sorted({*CROSS["fast"], *CROSS["slow"]})
    long = ", ".join(f"CAST({p} AS DOUBLE)" for p in periods)
    pick = lambda k: f"list_extract(emas, list_position([{long}], {k}))"
    return f"""{EV}, {RET}, {product_sql(CROSS)}, e0 AS (SELECT symbol, close_ts, ret, {', '.join(_ema(p) for p in periods)} FROM ret),
e1 AS (SELECT symbol, close_ts, ret, [{', '.join(f'ema_{p}' for p in periods)}] AS emas FROM e0),
held AS (SELECT param_id, symbol, close_ts, ret, cost_bps, coalesce(CASE WHEN {pick('fast')} > {pick('slow')} THEN 1 ELSE 0 END, 0) AS position FROM e1, params)"""


def dips_sql() -> str:
    parts = []
    for lb in DIPS["lookback"]:
        chain = UPS.replace(swings(2), swings(lb)).replace("FROM bars)", "FROM ret)")
        parts.append(re.sub(r"\b(u0|u1|u2|u3|trend)\b", rf"\1_{lb}", chain))
    union = " UNION ALL ".join(f"SELECT CAST({lb} AS DOUBLE) AS lookback, symbol, close_ts, ret, high, recent_high, pullback_depth, consecutive_up, least(higher_highs, higher_lows) AS swung FROM trend_{lb}" for lb in DIPS["lookback"])
    own, upto = "PARTITION BY param_id, symbol ORDER BY close_ts", "ROWS UNBOUNDED PRECEDING"
    return f"""{EV}, {RET}, {product_sql(DIPS)}, {', '.join(parts)}, every AS ({union}),
d0 AS (SELECT *, coalesce(high > lag(recent_high) OVER (PARTITION BY lookback, symbol ORDER BY close_ts), true) AS nw, row_number() OVER (PARTITION BY lookback, symbol ORDER BY close_ts) AS i FROM every),
d1 AS (SELECT param_id, symbol, close_ts, ret, cost_bps, hold, i, nw, swung >= confirmed OR consecutive_up >= early AS tr, pullback_depth >= pullback AS pl FROM d0 JOIN params USING (lookback)),
d2 AS (SELECT *, max(CASE WHEN pl THEN i END) OVER ({own} {upto}) AS lp, max(CASE WHEN nw THEN i END) OVER ({own} {upto}) AS ln,
  coalesce(max(CASE WHEN tr THEN i END) OVER ({own} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lt FROM d1),
d3 AS (SELECT *, max(CASE WHEN tr AND lp >= ln AND lp > lt THEN i END) OVER ({own} {upto}) AS ls FROM d2),
held AS (SELECT param_id, symbol, close_ts, ret, cost_bps, coalesce(CASE WHEN i - ls < hold THEN 1 ELSE 0 END, 0) AS position FROM d3)"""


def walk(anchored: bool = False) -> str:
    start, whole = ("UNBOUNDED PRECEDING", "b * 50 + 200") if anchored else ("CURRENT ROW", "200")
    return f"""wb AS (SELECT *, (row_number() OVER (PARTITION BY param_id, symbol, timeframe ORDER BY close_ts) - 1) // 50 AS b FROM thr),
ws AS (SELECT param_id, symbol, b, count(*) AS n, sum(ret) AS s, sum(ret * ret) AS q FROM wb GROUP BY param_id, symbol, b),
wm AS (SELECT param_id, symbol, b, b AS window_id, sum(n) OVER tr AS tn, sum(s) OVER tr AS ts, sum(q) OVER tr AS tq, sum(n) OVER te AS n2, sum(s) OVER te AS s2, sum(q) OVER te AS q2 FROM ws
  WINDOW tr AS (PARTITION BY param_id, symbol ORDER BY b ROWS BETWEEN {start} AND 3 FOLLOWING), te AS (PARTITION BY param_id, symbol ORDER BY b ROWS BETWEEN 4 FOLLOWING AND 4 FOLLOWING)),
wx AS (SELECT param_id, symbol, window_id, (ts / tn) / nullif(sqrt(greatest(tq / tn - (ts / tn) * (ts / tn), 0.0)), 0) AS train_sharpe,
  (s2 / n2) / nullif(sqrt(greatest(q2 / n2 - (s2 / n2) * (s2 / n2), 0.0)), 0) AS test_sharpe, s2 AS test_total FROM wm WHERE tn = {whole} AND n2 = 50),
wf AS (SELECT symbol, window_id, param_id, train_sharpe, test_sharpe, test_total FROM (SELECT *, row_number() OVER (PARTITION BY symbol, window_id ORDER BY train_sharpe DESC, param_id) AS k
  FROM wx WHERE train_sharpe IS NOT NULL) WHERE k = 1),
wst AS (SELECT symbol, count(*) AS n_windows, avg(train_sharpe) AS train_sharpe, avg(test_sharpe) AS test_sharpe, avg(train_sharpe) - avg(test_sharpe) AS decay, count(DISTINCT param_id) AS n_params,
  coalesce(stddev_samp(entry), 0.0) AS sd_entry, coalesce(stddev_samp(cost_bps), 0.0) AS sd_cost_bps FROM wf JOIN params USING (param_id) GROUP BY symbol)"""


WALK = walk()
WF_COLS = f"symbol, window_id, CAST(param_id AS BIGINT) AS param_id, {r6('train_sharpe')} AS train_sharpe, {r6('test_sharpe')} AS test_sharpe, {r6('test_total')} AS test_total"

#: Parameter, bounds, category of the sensitivity analysis.
_PARAMS = [("lookback", 1.0, 5.0, "signal-structural"), ("entry", 0.05, 0.5, "signal-threshold"), ("cost_bps", 0.0, 50.0, "execution")]


def _value(k: int) -> str:
    name, lo, hi, _ = _PARAMS[k]
    u = lambda d: sobol_number("base_id", d, 1024, xor=lambda a, b: f"xor({a}, {b})")
    from_b = f"block = 'B' OR (block = 'AB' AND coalesce(j = {k}, false)) OR (block = 'BA' AND NOT coalesce(j = {k}, false))"
    value = f"{lo} + CASE WHEN {from_b} THEN {u(3 + k)} ELSE {u(k)} END * {hi - lo}"
    return f"round_even({value}, 0) AS {name}" if name == "lookback" else f"{value} AS {name}"


SOBOL = f"""{DAY}, {RET},
blocks(i, block, j) AS (VALUES (0, 'A', NULL), (1, 'AB', 0), (2, 'AB', 1), (3, 'AB', 2), (4, 'BA', 0), (5, 'BA', 1), (6, 'BA', 2), (7, 'B', NULL)),
samples AS (SELECT base_id * 8 + i AS sample_id, base_id, block, CAST(j AS INTEGER) AS j, {_value(0)}, {_value(1)}, {_value(2)}
  FROM (SELECT CAST(range AS BIGINT) AS base_id FROM range(1024)), blocks), {lookback_sql(5, 'samples')},
results AS (SELECT symbol, sample_id, base_id, block, j, lookback, entry, cost_bps, {r6('sum(ret)')} AS y FROM ths GROUP BY symbol, sample_id, base_id, block, j, lookback, entry, cost_bps)"""
_pick = lambda b, j=None: f"max(CASE WHEN block = '{b}'" + ("" if j is None else f" AND j = {j}") + " THEN y END)"
INDEX = f"""{SOBOL}, wide AS (SELECT symbol, base_id, {_pick('A')} AS a, {_pick('B')} AS b, {', '.join(f"{_pick('AB', k)} AS ab{k}, {_pick('BA', k)} AS ba{k}" for k in range(3))} FROM results GROUP BY symbol, base_id),
sc AS (SELECT symbol, avg(y) AS mu, stddev_pop(y) AS sd FROM (SELECT symbol, unnest([a, b]) AS y FROM wide) GROUP BY symbol),
zz AS (SELECT symbol, (a - mu) / nullif(sd, 0) AS a, (b - mu) / nullif(sd, 0) AS b, {', '.join(f'(ab{k} - mu) / nullif(sd, 0) AS ab{k}, (ba{k} - mu) / nullif(sd, 0) AS ba{k}' for k in range(3))} FROM wide JOIN sc USING (symbol)),
est AS (SELECT symbol, {', '.join(f'avg(b * (ab{k} - a)) AS s{k}, avg((a - ab{k}) ** 2) / 2 AS t{k}' for k in range(3))},
  {', '.join(f'avg(ba{j} * ab{k} - a * b) AS v{j}{k}' for j in range(3) for k in range(j + 1, 3))} FROM zz GROUP BY symbol),
idx AS ({' UNION ALL '.join([f"SELECT symbol, 'S1' AS kind, '{_PARAMS[k][0]}' AS param, CAST(NULL AS VARCHAR) AS param2, s{k} AS value FROM est" for k in range(3)]
  + [f"SELECT symbol, 'ST', '{_PARAMS[k][0]}', NULL, t{k} FROM est" for k in range(3)]
  + [f"SELECT symbol, 'S2', '{_PARAMS[j][0]}', '{_PARAMS[k][0]}', v{j}{k} - s{j} - s{k} FROM est" for j in range(3) for k in range(j + 1, 3)])}),
cats(param, category) AS (VALUES {', '.join(f"('{p[0]}', '{p[3]}')" for p in _PARAMS)}),
grp AS (SELECT symbol, category, sum(CASE WHEN kind = 'S1' THEN value ELSE 0 END) AS s1, sum(CASE WHEN kind = 'ST' THEN value ELSE 0 END) AS st FROM idx JOIN cats USING (param) WHERE kind <> 'S2' GROUP BY symbol, category),
prs(category1, category2) AS (VALUES ('signal-structural', 'signal-structural'), ('signal-structural', 'signal-threshold'), ('signal-structural', 'execution'),
  ('signal-threshold', 'signal-threshold'), ('signal-threshold', 'execution'), ('execution', 'execution')),
s2c AS (SELECT symbol, c1.category AS category1, c2.category AS category2, value FROM idx JOIN cats c1 ON idx.param = c1.param JOIN cats c2 ON idx.param2 = c2.param WHERE kind = 'S2'),
crs AS (SELECT e.symbol, category1, category2, coalesce(sum(value), 0.0) AS s2 FROM (SELECT symbol FROM est) e CROSS JOIN prs LEFT JOIN s2c USING (symbol, category1, category2) GROUP BY e.symbol, category1, category2)"""
BOUNDS = f"""tb AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY {r6('y')} DESC, sample_id) AS r, floor(count(*) OVER (PARTITION BY symbol) * 0.1) AS k FROM results),
bnd AS ({' UNION ALL '.join(f"SELECT symbol, '{n}' AS param, CASE WHEN avg(CASE WHEN {n} <= {lo + 0.05 * (hi - lo)} THEN 1 ELSE 0 END) > 0.5 THEN 'lower' WHEN avg(CASE WHEN {n} >= {hi - 0.05 * (hi - lo)} THEN 1 ELSE 0 END) > 0.5 THEN 'upper' ELSE 'none' END AS bound FROM tb WHERE r <= k GROUP BY symbol" for n, lo, hi, _ in _PARAMS)})"""


def _binned(k: int, n: int) -> str:
    x, lo, hi, _ = _PARAMS[k]
    return f"CAST(least(greatest(floor(({x} - {lo}) / {hi - lo} * {n}), 0), {n - 1}) AS BIGINT)"


_MOVES = [(m, f) for m in ("entry", "cost_bps", "all") for f in FACTORS]
PERTURBED = "fac(param_id, base_id, base_entry, factor, moved) AS (VALUES " + ", ".join(
    f"({len(_MOVES) * i + k}, {i}, CAST({e} AS DOUBLE), CAST({f} AS DOUBLE), '{m}')" for i, e in enumerate((0.1, 0.3)) for k, (m, f) in enumerate(_MOVES)
) + """), params AS (SELECT param_id, CASE WHEN moved = 'cost_bps' THEN base_entry ELSE base_entry * factor END AS entry,
  CASE WHEN moved = 'entry' THEN CAST(5 AS DOUBLE) ELSE 5 * factor END AS cost_bps FROM fac)"""
NULL = f"""{EV}, {RET}, {grid_sql([0.3], [5])}, {THR}, {perm(N_NULL, 7)},
nn AS (SELECT rep, symbol, coalesce(CASE WHEN -lag(ret) OVER (PARTITION BY rep, symbol ORDER BY close_ts) >= 0.3 THEN 1 ELSE 0 END, 0) * (ret - 0.0005) AS r FROM null_ret),
ns AS (SELECT rep, symbol, {r6('avg(r) / nullif(stddev_samp(r), 0)')} AS sharpe FROM nn GROUP BY rep, symbol),
ob AS (SELECT symbol, {r6('sharpe')} AS observed FROM ps),
nt AS (SELECT symbol, observed, count(ns.sharpe) AS n_null, CASE WHEN observed IS NOT NULL THEN (1 + count(*) FILTER (ns.sharpe >= observed)) / (1 + count(ns.sharpe)) END AS p_value,
  count(*) FILTER (ns.sharpe < observed) / nullif(count(ns.sharpe), 0) AS quantile FROM ob JOIN ns USING (symbol) GROUP BY symbol, observed)"""
LEDGER = """f AS (SELECT CAST(l_suppkey AS VARCHAR) AS symbol, CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS q, l_extendedprice / nullif(l_quantity, 0) AS p,
  epoch_us(l_shipdate) // 1000 AS t, '{' || l_orderkey || ', ' || l_linenumber || ', ' || l_partkey || '}' AS o FROM lineitem),
e AS (SELECT symbol, t, o, {'size': CAST(0 AS DOUBLE), 'cost': CAST(0 AS DOUBLE), 'realised': CAST(0 AS DOUBLE), 'q': CAST(q AS DOUBLE), 'p': CAST(p AS DOUBLE)} AS fill
  FROM f WHERE symbol IS NOT NULL AND p IS NOT NULL),
l AS (SELECT symbol, list(fill ORDER BY t, o) AS fs FROM e GROUP BY symbol),
ac0 AS (SELECT symbol, list_reduce(list_prepend({'size': CAST(0 AS DOUBLE), 'cost': CAST(0 AS DOUBLE), 'realised': CAST(0 AS DOUBLE), 'q': CAST(0 AS DOUBLE), 'p': CAST(0 AS DOUBLE)}, fs), lambda a, x: {
  'size': a.size + x.q,
  'cost': CASE WHEN a.size * x.q >= 0 THEN CASE WHEN x.q = 0 THEN a.cost ELSE (a.cost * abs(a.size) + x.p * abs(x.q)) / (abs(a.size) + abs(x.q)) END WHEN abs(x.q) > abs(a.size) THEN x.p ELSE a.cost END,
  'realised': CASE WHEN a.size * x.q >= 0 THEN a.realised ELSE a.realised + least(abs(a.size), abs(x.q)) * (x.p - a.cost) * CASE WHEN a.size > 0 THEN 1 ELSE -1 END END,
  'q': CAST(0 AS DOUBLE), 'p': CAST(0 AS DOUBLE)}) AS r FROM l),
ac AS (SELECT symbol, r.size AS size, CASE WHEN r.size <> 0 THEN r.cost ELSE 0.0 END AS entry_price, r.realised AS realised FROM ac0)"""
_LHS = {"entry": (0.02, 0.5), "cost_bps": (0, 40), "lookback": (1, 5)}
_PLANE = "params AS (SELECT row_number() OVER () AS param_id, * FROM (SELECT unnest([0.05, 0.1, 0.2, 0.3, 0.5]::DOUBLE[]) AS entry), (SELECT CAST(unnest(range(0, 40)) AS DOUBLE) AS cost_bps), (SELECT CAST(unnest(range(1, 6)) AS DOUBLE) AS lookback))"

SQL = {
    "ticks_to_bars": f"WITH {EV} SELECT {COLS} FROM bars",
    "line_bars": f"WITH {LI} SELECT {RCOLS} FROM bars",
    "rollup_bars": f"""WITH {bars('event', '1m', 'fine')} SELECT symbol, '15m' AS timeframe, open_ts // 900000 * 900000 AS open_ts, open_ts // 900000 * 900000 + 899999 AS close_ts,
        arg_min(open, open_ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, open_ts) AS close, sum(volume) AS volume FROM fine GROUP BY symbol, open_ts // 900000""",
    "feature_chain": f"WITH {EV}, {CHANGE} SELECT {COLS}, {FEATURES} FROM ch",
    "feature_chain_chunked": f"WITH {bars('event', '1m')}, {CHANGE} SELECT {COLS}, {FEATURES} FROM ch",
    "klines_csv": f"WITH {EV} SELECT {COLS} FROM bars",
    "kline_json": f"WITH {EV} SELECT {COLS} FROM bars",
    "enriched_jsonl": f"WITH {EV}, {CHANGE} SELECT {COLS}, {FEATURES} FROM ch",
    "results_csv": f"WITH {SOBOL} SELECT symbol, CAST(sample_id AS DOUBLE) AS sample_id, lookback, {r6('entry')} AS entry, {r6('cost_bps')} AS cost_bps, y FROM results",
    "analysis_tables": f"""WITH {INDEX} SELECT 'indices' AS kind, concat_ws('/', symbol, kind, param, param2) AS key, 'value' AS name, {r6('value')} AS value FROM idx
        UNION ALL SELECT 'groups', concat_ws('/', symbol, category), unnest(['s1', 'st']), unnest([{r6('s1')}, {r6('st')}]) FROM grp""",
    "list_pairs": "SELECT c_name AS symbol, 'TRADING' AS status, upper(c_mktsegment) AS quoteAsset FROM customer WHERE c_acctbal > 0 AND upper(c_mktsegment) = 'BUILDING' AND lower(c_name) LIKE '%customer#00%'",
    "list_tickers": f"WITH {DAY} SELECT upper(symbol) || 'USDT' AS symbol, arg_max(close, close_ts) AS lastPrice, arg_max(volume, close_ts) AS volume FROM bars GROUP BY symbol",
    "stream_klines": f"WITH {EV} SELECT {COLS} FROM bars",
    "stream_ordered_features": f"""WITH {EV}, {CHANGE}, f AS (SELECT symbol, close_ts, close, {_sma(20)}, {_ema(20)}, {_rsi(14)} FROM ch)
        SELECT *, {r6('sma_20 - ema_20')} AS gap FROM f WHERE close_ts <= (SELECT max(close_ts) FROM bars) - 21600000""",
    "stream_signals": f"""WITH {US}, {DIP} SELECT symbol, 'buy' AS side, close_ts AS ts, maturity AS trend_maturity, {r6('pullback_depth')} AS pullback_depth, recent_high,
        CAST(higher_highs AS INTEGER) AS swing_high_count, CAST(higher_lows AS INTEGER) AS swing_low_count FROM sig""",
    "feature_chain_lines": f"WITH {LI}, {CHANGE} SELECT {RCOLS}, {FEATURES} FROM ch".replace(RCOLS, RCOLS),
    "swing_highlow": f"""WITH {EV}, s AS (SELECT *, {swings(2)}, count(*) OVER {rows(5)} AS n FROM bars) SELECT symbol, close_ts,
        CASE WHEN n = 5 THEN CASE WHEN swing_high IS NOT NULL AND swing_low IS NULL THEN 1 WHEN swing_low IS NOT NULL AND swing_high IS NULL THEN -1 ELSE 0 END END AS swing_highlow_4 FROM s""",
    "drop_malformed": f"WITH {EV} SELECT {COLS} FROM bars WHERE close_ts % 7 <> 0",
    "quarantine": f"""WITH {EV}, q AS (SELECT {COLS}, CASE WHEN NOT high > low THEN 'flat' WHEN NOT close >= 5 THEN 'cheap' WHEN NOT volume >= 2 THEN 'thin' END AS reason FROM bars)
        SELECT * FROM q WHERE reason IS NOT NULL""",
    "time_window": f"WITH {EV} SELECT {COLS} FROM bars WHERE open_ts BETWEEN 1704412800000 AND 1705276800000",
    "date_range": "SELECT event_id, event_type, value FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-10'",
    "dedupe_bars": f"WITH {EV} SELECT {COLS}, 1 AS seq FROM bars",
    "fan_in": f"WITH {DAY}, {bars('user', '1d', 'ub')} SELECT {COLS} FROM bars UNION ALL SELECT {COLS} FROM bars UNION ALL SELECT {COLS} FROM ub",
    "find_gaps": f"""WITH {US}, n AS (SELECT symbol, timeframe, open_ts, lead(open_ts) OVER ({W}) AS nx FROM bars)
        SELECT symbol, timeframe, open_ts + 3600000 AS gap_start, nx - 1 AS gap_end, (nx - open_ts) // 3600000 - 1 AS missing FROM n WHERE nx - open_ts > 3600000""",
    "limit_bars": f"WITH {US} SELECT {COLS} FROM (SELECT *, row_number() OVER ({W}) AS n FROM bars) WHERE n <= 5",
    "last_n": f"WITH {EV} SELECT * FROM (SELECT {COLS}, row_number() OVER (PARTITION BY symbol, timeframe ORDER BY close_ts DESC) AS rank FROM bars) WHERE rank <= 20",
    "sort_events": f"WITH {DAY} SELECT {COLS} FROM bars ORDER BY close_ts, symbol",
    "volume_direction": f"WITH {EV} SELECT {COLS}, CASE WHEN close >= open THEN 'up' ELSE 'down' END AS direction FROM bars",
    "stream_ticks_to_bars": f"WITH {EV} SELECT {COLS} FROM bars WHERE (close_ts + 1) * 1000 <= (SELECT max(epoch_us(ts)) - 600000000 FROM events)",
    "stream_features": f"WITH {EV}, {CHANGE} SELECT symbol, close_ts, close, {_sma(20)}, {_ema(20)}, {_rsi(14)}, {ENGULF} FROM ch",
    "typical": f"WITH {EV} SELECT symbol, close_ts, {r6('(high + low + close) / 3')} AS typical_price, strftime(make_timestamp(close_ts * 1000), '%Y-%m-%d %H:%M:%S.%g') AS closed FROM bars",
    "perturb": f"""WITH {EV}, {RET}, {PERTURBED}, {THR}, m AS (SELECT base_id, factor, moved, symbol, {r6('total')} AS total FROM ps JOIN fac USING (param_id)),
        l AS (SELECT m.base_id, m.moved, m.symbol, m.factor, (b.total - m.total) / nullif(abs(b.total), 0) AS loss FROM m JOIN m b ON m.base_id = b.base_id AND m.symbol = b.symbol AND m.moved = b.moved AND b.factor = 1.0)
        SELECT CAST(base_id AS BIGINT) AS base_id, moved, symbol, factor, {r6('loss')} AS loss, abs(factor - 1) > 0.1 + 1e-9 OR loss <= 0.2 AS ok FROM l""",
    "pattern_markers": f"""WITH {EV}, e AS (SELECT *, {ENGULF} FROM bars) SELECT symbol, close_ts, {r6('CASE WHEN engulfing_candle = 1 THEN low * 0.998 ELSE high * 1.002 END')} AS y,
        CASE WHEN engulfing_candle = 1 THEN 'bullish' ELSE 'bearish' END AS kind FROM e WHERE engulfing_candle IN (1, -1)""",
    "unpivot_features": f"""WITH {EV}, {CHANGE}, e AS (SELECT {COLS}, {FEATURES} FROM ch) """ + " UNION ALL ".join(
        f"SELECT symbol, close_ts, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM e WHERE {c} IS NOT NULL" for c in "engulfing_candle vwap_20 vwap_50 ema_20 ema_50 sma_20 rsi_14".split()),
    "export_summary": f"""WITH {US}, n AS (SELECT symbol, timeframe, min(close_ts) AS min_ts, max(close_ts) AS max_ts, count(*) AS n_rows FROM bars GROUP BY symbol, timeframe)
        SELECT *, CAST((n_rows >= 20)::INT + (n_rows >= 15)::INT + (n_rows >= 50)::INT AS BIGINT) AS n_indicators FROM n""",
    "month_range": f"""WITH {LI}, b AS (SELECT DISTINCT symbol, date_trunc('month', make_timestamp(open_ts * 1000)) AS m FROM bars),
        a AS (SELECT unnest(generate_series(min(m), max(m), INTERVAL 1 MONTH)) AS m FROM b)
        SELECT strftime(a.m, '%Y-%m-%d') AS month, count(b.symbol) AS n_symbols FROM a LEFT JOIN b ON a.m = b.m GROUP BY a.m""",
    "swing_points": f"""WITH {EV}, s AS (SELECT *, {swings(2)} FROM bars) SELECT symbol, close_ts, 'swing_high' AS kind, swing_high AS price FROM s WHERE swing_high IS NOT NULL
        UNION ALL SELECT symbol, close_ts, 'swing_low', swing_low FROM s WHERE swing_low IS NOT NULL""",
    "consecutive_up": f"WITH {US}, {UPS} SELECT symbol, close_ts, consecutive_up FROM trend",
    "pullback_depth": f"WITH {EV}, {UPS} SELECT symbol, close_ts, recent_high, {r6('pullback_depth')} AS pullback_depth FROM trend",
    "sweep_ema_cross": f"WITH {cross_sql()}, {SWEPT}",
    "sweep_buy_the_dip": f"WITH {dips_sql()}, {SWEPT}",
    "trend_maturity_chunked": f"WITH {bars('event', '1m')}, {UPS} SELECT symbol, close_ts, higher_highs, higher_lows, consecutive_up, maturity FROM trend",
    "buy_the_dip_chunked": f"WITH {bars('event', '1m')}, {DIP} SELECT symbol, close_ts AS ts, maturity AS trend_maturity, {r6('pullback_depth')} AS pullback_depth, recent_high FROM sig",
    "drawdown_chunked": f"WITH {EV}, {RET}, {DD.format(src='ret')} SELECT symbol, close_ts, {r6('drawdown')} AS drawdown FROM dr",
    "feature_dependencies": f"""WITH {EV}, {CHANGE}, g0 AS (SELECT symbol, timeframe, close_ts, {_ema(20)}, {_ema(50)} FROM ch),
        g1 AS (SELECT *, {r6('ema_20 - ema_50')} AS gap FROM g0), g2 AS (SELECT *, CASE WHEN count(gap) OVER {rows(9)} = 9 THEN {r6(f'avg(gap) OVER {rows(9)}')} END AS gap_mean FROM g1)
        SELECT symbol, close_ts, gap, gap_mean, {r6('gap - gap_mean')} AS gap_left FROM g2""",
    "null_test_metrics": f"""WITH {DAY}, {RET}, {perm(N_NULL, 11, 3)}, every AS (SELECT rep, symbol, close_ts, ret FROM null_ret UNION ALL SELECT -1, symbol, close_ts, ret FROM pr),
        nn AS (SELECT rep, symbol, close_ts, coalesce(CASE WHEN -lag(ret) OVER (PARTITION BY rep, symbol ORDER BY close_ts) >= 0.1 THEN 1 ELSE 0 END, 0) * (ret - 0.0005) AS r FROM every),
        gr AS (SELECT *, sum(ln(1 + greatest(r, -0.999999))) OVER (PARTITION BY rep, symbol ORDER BY close_ts) AS g FROM nn),
        dn AS (SELECT *, exp(g - greatest(max(g) OVER (PARTITION BY rep, symbol ORDER BY close_ts), 0)) - 1 AS d FROM gr),
        sc AS (SELECT rep, symbol, {r6('avg(r) / nullif(stddev_samp(r), 0)')} AS sharpe, {r6('arg_max(g, close_ts) * 365 / count(*)')} AS log_cagr, {r6('min(d)')} AS max_drawdown FROM dn GROUP BY rep, symbol),
        ln AS (SELECT rep, symbol, unnest(['sharpe', 'log_cagr', 'max_drawdown']) AS metric, unnest([sharpe, log_cagr, max_drawdown]) AS v FROM sc)
        SELECT o.symbol, o.metric, o.v AS observed, count(n.v) AS n_null, {r6('CASE WHEN o.v IS NOT NULL THEN (1 + count(*) FILTER (n.v >= o.v)) / (1 + count(n.v)) END')} AS p_value,
          {r6('count(*) FILTER (n.v < o.v) / nullif(count(n.v), 0)')} AS quantile, coalesce(CASE WHEN o.v IS NOT NULL THEN (1 + count(*) FILTER (n.v >= o.v)) / (1 + count(n.v)) END <= 0.05, false) AS rejects
        FROM ln o JOIN ln n ON o.symbol = n.symbol AND o.metric = n.metric AND n.rep >= 0 WHERE o.rep = -1 GROUP BY o.symbol, o.metric, o.v""",
    "trend_maturity": f"WITH {EV}, {UPS} SELECT symbol, close_ts, higher_highs, higher_lows, consecutive_up, maturity FROM trend",
    "buy_the_dip": f"""WITH {US}, {DIP} SELECT symbol, 'buy' AS side, close_ts AS ts, maturity AS trend_maturity, {r6('pullback_depth')} AS pullback_depth, recent_high,
        CAST(higher_highs AS INTEGER) AS swing_high_count, CAST(higher_lows AS INTEGER) AS swing_low_count FROM sig""",
    "expire_signals": f"WITH {EV}, {DIP} SELECT symbol, close_ts AS ts, close_ts + 86400000 AS expires_at FROM sig WHERE close_ts + 86400000 >= 1705276800000",
    "bar_returns": f"WITH {EV}, {RET} SELECT symbol, close_ts, {r6('ret')} AS ret FROM ret",
    "rolling_sharpe": f"""WITH {EV}, {RET} SELECT symbol, close_ts, CASE WHEN count(ret) OVER {rows(20)} = 20 AND stddev_samp(ret) OVER {rows(20)} > 0
        THEN {r6(f'avg(ret) OVER {rows(20)} / (stddev_samp(ret) OVER {rows(20)})')} END AS rolling_sharpe FROM ret""",
    "drawdown": f"WITH {LI}, {RET}, {DD.format(src='ret')} SELECT symbol, close_ts, {r6('drawdown')} AS drawdown FROM dr",
    "align_symbols": f"WITH {EV} SELECT x.symbol, x.close_ts, x.close, y.close AS ref_close FROM bars x JOIN bars y ON x.close_ts = y.close_ts AND y.symbol = 'click' WHERE x.symbol <> 'click'",
    "rolling_pair": f"""WITH {EV}, al AS (SELECT x.symbol, x.timeframe, x.close_ts, x.close, y.close AS rc FROM bars x JOIN bars y ON x.close_ts = y.close_ts AND y.symbol = 'click' WHERE x.symbol <> 'click')
        SELECT symbol, close_ts, CASE WHEN count(close) OVER {rows(20)} = 20 THEN {r6(f'corr(close, rc) OVER {rows(20)}')} END AS corr,
        CASE WHEN count(close) OVER {rows(20)} = 20 THEN {r6(f'covar_samp(close, rc) OVER {rows(20)} / (var_samp(rc) OVER {rows(20)})')} END AS beta, {r6('close - rc')} AS spread FROM al""",
    "asof_price": f"""WITH {EV}, e AS (SELECT event_id, event_type AS symbol, epoch_us(ts) // 1000 AS ts FROM events)
        SELECT e.event_id, e.symbol, e.ts, b.close AS price FROM e ASOF LEFT JOIN bars b ON e.symbol = b.symbol AND e.ts >= b.close_ts""",
    "expand_params": f"WITH {DAY}, {grid_sql([0.02, 0.05], [0, 5])} SELECT symbol, close_ts, close, CAST(param_id AS BIGINT) AS param_id, entry, cost_bps FROM bars, params",
    "walk_windows": f"""WITH {EV}, i AS (SELECT symbol, close_ts, row_number() OVER ({W}) - 1 AS bar_idx, count(*) OVER (PARTITION BY symbol, timeframe) AS n FROM bars),
        w AS (SELECT symbol, unnest(range(0, (max(n) - 150) // 50 + 1)) AS window_id FROM i GROUP BY symbol HAVING max(n) >= 150)
        SELECT i.symbol, close_ts, bar_idx, window_id, CASE WHEN bar_idx < window_id * 50 + 100 THEN 'train' ELSE 'test' END AS part
        FROM i JOIN w ON i.symbol = w.symbol AND bar_idx >= window_id * 50 AND bar_idx < window_id * 50 + 150""",
    "run_backtest": f"WITH {RUN} SELECT symbol, close_ts, position, turnover, {r6('ret')} AS ret FROM run",
    "backtest_metrics": f"""WITH {RUN}, {DD.format(src='run')},
        n AS (SELECT *, CASE WHEN position <> 0 AND coalesce(lag(position) OVER ({W}), 0) = 0 THEN 1 ELSE 0 END AS nw FROM dr), t AS (SELECT *, sum(nw) OVER {UNB} AS tr FROM n),
        g AS (SELECT symbol, timeframe, tr, min(abs(position)) = 0 AS closed, sum(ret) > 0 AS won FROM t WHERE tr > 0 GROUP BY symbol, timeframe, tr),
        w AS (SELECT symbol, timeframe, count(*) AS n_trades, count(*) FILTER (closed AND won) / nullif(count(*) FILTER (closed), 0) AS win_rate FROM g GROUP BY symbol, timeframe),
        m AS (SELECT symbol, timeframe, count(ret) AS n_bars, {r6('avg(ret) / nullif(stddev_samp(ret), 0) * sqrt(8760.0)')} AS sharpe, {r6('min(drawdown)')} AS max_drawdown,
        {r6('sum(ln(1 + greatest(ret, -0.999999))) * 8760.0 / nullif(count(ret), 0)')} AS log_cagr,
        {r6('sum(greatest(ret, 0.0)) / nullif(abs(sum(least(ret, 0.0))), 0)')} AS profit_factor, {r6('sum(ret)')} AS total, CAST(sum(turnover) AS BIGINT) AS turnover FROM dr GROUP BY symbol, timeframe)
        SELECT m.*, coalesce(n_trades, 0) AS n_trades, {r6('win_rate')} AS win_rate FROM m LEFT JOIN w USING (symbol, timeframe)""",
    "trades": f"WITH {TRADES} SELECT symbol, entry_ts, exit_ts, bars_held, entry_price, exit_price, {r6('pnl')} AS pnl FROM trades",
    "trade_concentration": f"""WITH {TRADES}, r AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pnl DESC NULLS LAST, entry_ts) AS k FROM trades),
        c AS (SELECT *, CASE WHEN k > 5 THEN pnl END AS rp, CASE WHEN k <= 5 THEN pnl END AS tp FROM r)
        SELECT symbol, count(*) AS n_trades, {r6('sum(pnl)')} AS total_pnl, {r6('coalesce(sum(tp), 0.0)')} AS top_pnl, {r6('sum(pnl) - coalesce(sum(tp), 0.0)')} AS rest_pnl,
        {r6('avg(pnl) / nullif(stddev_samp(pnl), 0)')} AS trade_sharpe, {r6('avg(rp) / nullif(stddev_samp(rp), 0)')} AS rest_sharpe FROM c GROUP BY symbol""",
    "trade_periods": f"""WITH {TRADES} SELECT symbol, '1h' AS timeframe, strftime(date_trunc('month', make_timestamp(entry_ts * 1000)), '%Y-%m-%d') AS period, count(*) AS n_trades,
        {r6('sum(pnl)')} AS total_pnl, {r6('avg(CASE WHEN pnl > 0 THEN 1.0 WHEN pnl <= 0 THEN 0.0 END)')} AS win_rate FROM trades GROUP BY symbol, date_trunc('month', make_timestamp(entry_ts * 1000))""",
    "average_cost": f"WITH {LEDGER} SELECT symbol, size, {r6('entry_price')} AS entry_price, {r6('realised')} AS realised FROM ac",
    "positions_from_fills": f"""WITH {LI}, {LEDGER}, px AS (SELECT symbol, arg_max(close, close_ts) AS price FROM bars GROUP BY symbol)
        SELECT symbol, size, {r6('entry_price')} AS entry_price, {r6('realised')} AS realised, {r6('price')} AS price, {r6('size * (price - entry_price)')} AS unrealised, {r6('size * price')} AS exposure FROM ac LEFT JOIN px USING (symbol)""",
    "net_positions": """SELECT CAST(l_suppkey AS VARCHAR) AS symbol, sum(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 1 END * l_quantity) AS net_size,
        round(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE -1 END * l_quantity * (l_extendedprice / l_quantity)), 2) AS cash_flow, count(*) AS n_fills FROM lineitem GROUP BY l_suppkey""",
    "param_sweep": f"WITH {DAY}, {RET}, {sweep_sql()}, {THR} SELECT CAST(param_id AS BIGINT) AS param_id, symbol, n_bars, n_trades, {r6('total')} AS total, {r6('sharpe')} AS sharpe FROM ps",
    "lhs_sweep": f"""WITH {DAY}, {RET}, {lhs_sql(_LHS, 2000, 2, ('cost_bps', 'lookback'))}, {lookback_sql(5)}
        SELECT param_id, symbol, CAST(sum(position) AS BIGINT) AS n_trades, {r6('sum(ret)')} AS total FROM ths GROUP BY param_id, symbol""",
    "best_params": f"""WITH {DAY}, {RET}, {sweep_sql()}, {THR} SELECT symbol, CAST(param_id AS BIGINT) AS param_id, total FROM (SELECT symbol, param_id, {r6('total')} AS total,
        row_number() OVER (PARTITION BY symbol ORDER BY {r6('total')} DESC, param_id) AS k FROM ps) WHERE k = 1""",
    "surface_slice": f"WITH {DAY}, {RET}, {sweep_sql()}, {THR}, t AS (SELECT param_id, {r6('total')} AS total FROM ps) SELECT entry, {r6('avg(total)')} AS mean_total, count(*) AS n FROM t JOIN params USING (param_id) WHERE cost_bps IN (19, 20) GROUP BY entry",
    "surface_plane": f"""WITH {DAY}, {RET}, {_PLANE}, {lookback_sql(5)}, t AS (SELECT cost_bps, lookback, symbol, {r6('sum(ret)')} AS total FROM ths WHERE entry = 0.1 GROUP BY cost_bps, lookback, symbol)
        SELECT cost_bps, lookback, {r6('avg(total)')} AS mean_total, count(*) AS n FROM t GROUP BY cost_bps, lookback""",
    "permute_returns": f"WITH {DAY}, {RET}, {perm(N_NULL, 1, 3)} SELECT rep, symbol, close_ts, {r6('ret')} AS ret FROM null_ret",
    "null_prices": f"""WITH {DAY}, {RET}, {perm(N_NULL, 1)}, f AS (SELECT symbol, arg_min(close, close_ts) AS f FROM bars GROUP BY symbol)
        SELECT rep, symbol, close_ts, {r6('ln(nullif(f, 0)) + sum(ln(1 + greatest(ret, -0.999999))) OVER (PARTITION BY rep, symbol ORDER BY close_ts ROWS UNBOUNDED PRECEDING)')} AS log_close FROM null_ret JOIN f USING (symbol)""",
    "null_test": f"WITH {NULL} SELECT symbol, observed, n_null, p_value, quantile, coalesce(p_value <= 0.05, false) AS rejects FROM nt",
    "walk_forward": f"WITH {EV}, {RET}, {GRID}, {THR}, {WALK} SELECT {WF_COLS} FROM wf",
    "walk_forward_anchored": f"WITH {EV}, {RET}, {GRID}, {THR}, {walk(True)} SELECT {WF_COLS} FROM wf",
    "stitched": f"""WITH {EV}, {RET}, {GRID}, {THR}, {WALK} SELECT wb.symbol, window_id, CAST(wb.param_id AS BIGINT) AS param_id, close_ts, {r6('ret')} AS ret
        FROM wb JOIN wf ON wb.symbol = wf.symbol AND wb.param_id = wf.param_id AND wb.b = wf.window_id + 4""",
    "wf_stability": f"""WITH {EV}, {RET}, {GRID}, {THR}, {WALK} SELECT symbol, n_windows, {r6('train_sharpe')} AS train_sharpe, {r6('test_sharpe')} AS test_sharpe, {r6('decay')} AS decay, n_params,
        {r6('sd_entry')} AS sd_entry, {r6('sd_cost_bps')} AS sd_cost_bps FROM wst""",
    "saltelli_results": f"WITH {SOBOL} SELECT symbol, sample_id, base_id, block, j, lookback, {r6('entry')} AS entry, {r6('cost_bps')} AS cost_bps, y FROM results",
    "sobol_indices": f"WITH {INDEX} SELECT symbol, kind, param, param2, {r6('value')} AS value FROM idx",
    "group_indices": f"WITH {INDEX} SELECT symbol, category, {r6('s1')} AS s1, {r6('st')} AS st FROM grp",
    "group_contributions": f"""WITH {INDEX}, t AS (SELECT *, sum(s1) OVER (PARTITION BY symbol) AS t FROM grp)
        SELECT symbol, category, {r6('s1')} AS s1, {r6('CASE WHEN t > 0 THEN 100 * s1 / t ELSE 0.0 END')} AS percent FROM t""",
    "interaction_shares": f"""WITH {INDEX}, v AS (SELECT symbol, param, max(CASE WHEN kind = 'S1' THEN value END) AS s1, max(CASE WHEN kind = 'ST' THEN value END) AS st FROM idx WHERE kind <> 'S2' GROUP BY symbol, param)
        SELECT symbol, param, {r6('CASE WHEN st > 0.001 THEN (st - s1) / st ELSE 0.0 END')} AS share FROM v""",
    "cross_group": f"WITH {INDEX} SELECT symbol, category1, category2, {r6('s2')} AS s2 FROM crs",
    "interaction_matrix": f"""WITH {INDEX}, m AS (SELECT * FROM crs UNION ALL SELECT symbol, category2, category1, s2 FROM crs WHERE category1 <> category2)
        SELECT symbol, category1 AS category, """ + ", ".join(r6(f"sum(CASE WHEN category2 = '{c}' THEN s2 END)") + f" AS {c.replace('-', '_')}" for c in ("signal-structural", "signal-threshold", "execution")) + " FROM m GROUP BY symbol, category1",
    "params_at_bounds": f"WITH {SOBOL}, {BOUNDS} SELECT symbol, param, bound FROM bnd",
    "diagnostics": f"""WITH {INDEX}, {BOUNDS}, g AS (SELECT symbol, sum(CASE WHEN category = 'execution' THEN s1 END) AS e, sum(s1) AS s, sum(st) AS t FROM grp GROUP BY symbol),
        c AS (SELECT symbol, sum(CASE WHEN category1 <> category2 THEN s2 ELSE 0.0 END) AS c FROM crs GROUP BY symbol), b AS (SELECT symbol, max((bound <> 'none')::INT) AS b FROM bnd GROUP BY symbol),
        d AS (SELECT symbol, coalesce(s > 0 AND e / s > 0.5, false) AS execution_dominates, c > 0.3 AS high_cross_group, t > 1.5 AS low_additivity, b = 1 AS parameter_at_bound FROM g JOIN c USING (symbol) JOIN b USING (symbol)),
        f AS (SELECT *, CAST(execution_dominates::INT + high_cross_group::INT + low_additivity::INT + parameter_at_bound::INT AS BIGINT) AS n_flags FROM d)
        SELECT *, CASE WHEN n_flags = 0 THEN 'PASS' WHEN n_flags <= 2 THEN 'REVIEW' ELSE 'FAIL' END AS verdict FROM f""",
    "top_params": f"WITH {INDEX}, k AS (SELECT symbol, param, {r6('value')} AS st, row_number() OVER (PARTITION BY symbol ORDER BY {r6('value')} DESC, param) AS rank FROM idx WHERE kind = 'ST') SELECT * FROM k WHERE rank <= 3",
    "heatmap": f"""WITH {SOBOL}, b AS (SELECT {_binned(1, 20)} AS bin1, {_binned(2, 20)} AS bin2, avg(y) AS mean FROM results GROUP BY 1, 2),
        c AS (SELECT range // 20 AS bin1, range % 20 AS bin2 FROM range(400)) SELECT bin1, bin2, {r6('mean')} AS mean FROM c LEFT JOIN b USING (bin1, bin2)""",
    "sweep": f"""WITH {SOBOL}, b AS (SELECT {_binned(2, 30)} AS bin, avg(y) AS mean, stddev_samp(y) AS sd FROM results GROUP BY 1)
        SELECT range AS bin, {r6('mean')} AS mean, {r6('sd')} AS sd, {r6(f'0.0 + (range + 0.5) * {50 / 30}')} AS centre FROM range(30) LEFT JOIN b ON range = bin""",
    "fill_nan_mean": f"""WITH {SOBOL}, n AS (SELECT symbol, sample_id, CASE WHEN sample_id % 11 = 0 THEN NULL ELSE y END AS y FROM results)
        SELECT symbol, sample_id, {r6('coalesce(y, avg(y) OVER (PARTITION BY symbol))')} AS y FROM n""",
    "missing_samples": f"WITH {SOBOL} SELECT symbol || '/' || sample_id AS sample_id FROM results WHERE NOT y > 0",
    "sample_plan": f"WITH {US} SELECT symbol, count(*) AS n_bars, CAST(8192 AS BIGINT) AS sample_rows, 8192.0::DOUBLE AS seconds, 1024.0::DOUBLE AS seconds_by_8 FROM bars GROUP BY symbol",
}
