"""Recursive indicators: exponential averages, Wilder smoothing and what is chained from them.

All of them, and the numeric statistics of `operators/tsnumeric.py`, are worked out in one grouped-pandas pass a ticker: one
exchange by ticker and one Arrow transfer, however many features are asked for. The exponential average is the weighted mean with
weights (1 - a)^age, seeded by the first value; a null carries the value on while its weight decays.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd


def ema(x: pd.Series, span: int, least: int = 0) -> pd.Series:
    return x.ewm(span=span, adjust=False, min_periods=least).mean()


def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return a / b.where(b != 0)


def _typical(g: pd.DataFrame) -> pd.Series:
    return (g.px_high + g.px_low + g.px_last) / 3


def rsi(g: pd.DataFrame, n: int) -> pd.Series:
    move = g.px_last.diff()
    gain, loss = (s.ewm(alpha=1 / n, adjust=False, min_periods=n).mean() for s in (move.clip(lower=0), (-move).clip(lower=0)))
    out = 100 - 100 / (1 + ratio(gain, loss))
    return out.mask((loss == 0) & (gain > 0), 100.0)


def macd(g: pd.DataFrame) -> pd.DataFrame:
    line = ema(g.px_last, 12, 12) - ema(g.px_last, 26, 26)
    signal = ema(line, 9, 9)
    return pd.DataFrame({"macd": line, "macd_signal": signal, "macd_histogram": line - signal})


def trix(g: pd.DataFrame) -> pd.Series:
    x = g.px_last
    for _ in range(3):
        x = ema(x, 21, 21)
    return ratio(x - x.shift(), x.shift())


def true_range(g: pd.DataFrame) -> pd.Series:
    before = g.px_last.shift()
    return pd.concat([g.px_high - g.px_low, (g.px_high - before).abs(), (g.px_low - before).abs()], axis=1).max(axis=1)


def wilder_atr(g: pd.DataFrame, n: int = 14) -> pd.Series:
    """The mean of the first n true ranges, nulls left out, stands at row n; afterwards a Wilder average. Null with fewer rows."""
    tr = true_range(g).to_numpy()
    out = np.full(len(tr), np.nan)
    if len(tr) >= n:
        seed = tr[:n][~np.isnan(tr[:n])]
        out[n - 1] = seed.mean() if len(seed) else np.nan
        for i in range(n, len(tr)):
            out[i] = ((n - 1) * out[i - 1] + tr[i]) / n
    return pd.Series(out, g.index)


def _directional(g: pd.DataFrame, moves: pd.Series, n: int = 21) -> pd.Series:
    smooth = moves.rolling(n).sum() - moves.rolling(n).mean() + moves
    return ratio(smooth, wilder_atr(g, n)) * 100


def _moves(g: pd.DataFrame) -> tuple[pd.Series, pd.Series]:
    up, down = g.px_high.diff(), -g.px_low.diff()
    return up.where((up > down) & (up > 0), 0.0), down.where((down > up) & (down > 0), 0.0)


def plus_di(g: pd.DataFrame) -> pd.Series:
    return _directional(g, _moves(g)[0])


def minus_di(g: pd.DataFrame) -> pd.Series:
    return _directional(g, _moves(g)[1])


def mean_price_volatility(g: pd.DataFrame, n: int) -> pd.Series:
    return ema(_typical(g).rolling(n).std(), n, n)


def mass_index(g: pd.DataFrame) -> pd.Series:
    first = ema(g.px_high - g.px_low, 9)
    return ratio(first, ema(first, 9)).rolling(25).sum()


def stc(g: pd.DataFrame) -> pd.Series:
    fast = ema(g.px_last, 23)
    x = fast - ema(fast, 50)
    for _ in range(2):
        low = x.rolling(10).min()
        x = ema(100 * ratio(x - low, x.rolling(10).max() - low), 3)
    return x


def amih_l(g: pd.DataFrame) -> pd.Series:
    """Absolute value taken after smoothing, as millionths."""
    returns = ratio(g.px_last, g.px_last.shift()) - 1
    return ratio(ema(returns, 21, 21).abs(), ema(g.px_last * g.px_volume, 21, 21)) * 1_000_000


#: name -> (column names for a window or None, function)
WINDOWED: dict[str, tuple[str, Callable[[pd.DataFrame, int], pd.Series]]] = {
    "ema": ("ema_{}", lambda g, n: ema(g.px_last, n, n)),
    "rsi": ("rsi_{}", rsi),
    "mean_price_volatility": ("mean_std_{}", mean_price_volatility),
}
SWITCHES: dict[str, tuple[tuple[str, ...], Callable[[pd.DataFrame], pd.Series | pd.DataFrame]]] = {
    "macd": (("macd", "macd_signal", "macd_histogram"), macd),
    "trix": (("trix",), trix),
    "atr": (("atr",), wilder_atr),
    "plus_di": (("plus_di",), plus_di),
    "minus_di": (("minus_di",), minus_di),
    "mass_index": (("mass_index",), mass_index),
    "stc": (("stc",), stc),
    "amih_l": (("amih_l",), amih_l),
}
