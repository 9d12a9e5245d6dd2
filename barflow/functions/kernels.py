"""The rolling indicators as numpy kernels over one symbol's bars in time order.

Used where bars come in pieces with their history (streams); equal to the column forms.
Bars are columns by name, as a frame or as a dict of arrays; a feature that depends on others
finds them among the columns. NaN stands for an absent value.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np

Bars = Mapping[str, np.ndarray]


def _round6(x: np.ndarray) -> np.ndarray:
    y = np.round(x * 1e6, 3)
    return np.sign(y) * np.floor(np.abs(y) + 0.5) / 1e6 + 0.0


def _windows(x: np.ndarray, p: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, p)


def _sums(x: np.ndarray, p: int) -> np.ndarray:
    """Sum of the last p values, added in order as a plain loop would; NaN until there are as many."""
    out = np.full(len(x), np.nan)
    if len(x) >= p:
        total = np.zeros(len(x) - p + 1)
        for i in range(p):
            total += x[i : len(x) - p + 1 + i]
        out[p - 1 :] = total
    return out


def sma(bars: Bars, period: int) -> np.ndarray:
    return _round6(_sums(np.asarray(bars["close"]), period) / period)


def ema(bars: Bars, period: int, smoothing: float = 2.0) -> np.ndarray:
    x, p, a = np.asarray(bars["close"]), period, smoothing / (period + 1)
    out = np.full(len(x), np.nan)
    for i in range(p - 1, min(len(x), 2 * p - 1)):  # shorter history: the seed is the first p
        e = sum(x[:p].tolist()) / p
        for v in x[p : i + 1].tolist():
            e = v * a + e * (1 - a)
        out[i] = e
    n = len(x) - 2 * p + 1
    if n > 0:  # every full window at once, step by step
        e = _sums(x, p)[p - 1 : p - 1 + n] / p
        for i in range(p, 2 * p):
            e = x[i : i + n] * a + e * (1 - a)
        out[2 * p - 1 :] = e
    return _round6(out)


def rsi(bars: Bars, period: int) -> np.ndarray:
    d = np.diff(np.asarray(bars["close"]))
    up, down = (_sums(np.maximum(s * d, 0), period) / period for s in (1, -1))
    with np.errstate(divide="ignore", invalid="ignore"):
        value = np.where(down == 0, 100.0, _round6(100 - 100 / (1 + up / down)))
    return np.concatenate([[np.nan], np.where(np.isnan(up), np.nan, value)])[: len(bars["close"])]


def vwap(bars: Bars, period: int) -> np.ndarray:
    high, low, close, v = (np.asarray(bars[c]) for c in ("high", "low", "close", "volume"))
    money = (high + low + close) / 3 * v
    a, b = (_sums(x, period) for x in (money, v))
    with np.errstate(divide="ignore", invalid="ignore"):
        return _round6(np.where(b == 0, np.nan, a / b))


def engulfing_candle(bars: Bars) -> np.ndarray:
    o, c = np.asarray(bars["open"]), np.asarray(bars["close"])
    out = np.full(len(o), np.nan)
    up = c > o
    turn_up = up[1:] & ~up[:-1] & (o[1:] < c[:-1]) & (c[1:] > o[:-1])
    turn_down = ~up[1:] & up[:-1] & (o[1:] > c[:-1]) & (c[1:] < o[:-1])
    out[1:] = np.where(turn_up, 1, np.where(turn_down, -1, 0))
    return out


def swing_highlow(bars: Bars, period: int) -> np.ndarray:
    lb, high, low = period // 2, np.asarray(bars["high"]), np.asarray(bars["low"])
    out = np.full(len(high), np.nan)
    if len(high) > period:
        (h, w), others = (_windows(x, period + 1) for x in (high, low)), np.arange(period + 1) != lb
        is_high, is_low = h[:, lb] > h[:, others].max(axis=1), w[:, lb] < w[:, others].min(axis=1)
        out[period:] = is_high.astype(int) - is_low.astype(int)
    return out


def difference(bars: Bars, a: str, b: str) -> np.ndarray:
    return _round6(np.asarray(bars[a], float) - np.asarray(bars[b], float))


def mean_of(bars: Bars, source: str, period: int) -> np.ndarray:
    return _round6(_sums(np.asarray(bars[source], float), period) / period)


KERNELS = {
    "sma": sma, "ema": ema, "rsi": rsi, "vwap": vwap, "engulfing_candle": engulfing_candle, "swing_highlow": swing_highlow,
    "difference": difference, "mean_of": mean_of,
}
