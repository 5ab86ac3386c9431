"""Rolling statistics of the last 50 closes that have no SQL form, in numpy; and the grouped-pandas pass that runs them.

Each function takes the array of all full windows of a ticker, one a row, and returns one value (or several columns) a window.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quantpanel.operators import recursive
from quantpanel.session import ship_package

N = 50


def lempel_ziv_complexity(x: np.ndarray) -> np.ndarray:
    """Phrases of the sequence "above its median", parsed left to right; a phrase grows while it has occurred before its own end."""
    above = x > np.median(x, axis=1, keepdims=True)
    return np.array([_phrases("".join("1" if v else "0" for v in row)) for row in above], float)


def _phrases(s: str) -> int:
    count, start, size = 1, 0, 1
    while start + size <= len(s):
        if s.find(s[start : start + size], 0, start + size - 1) >= 0:
            size += 1
        else:
            count += 1
            start, size = start + size, 1
    return count


def fft_aggregated(x: np.ndarray) -> np.ndarray:
    """Mean, population variance, and bias-corrected skewness and excess kurtosis of the magnitudes of all bins."""
    a = np.abs(np.fft.fft(x, axis=1))
    n = a.shape[1]
    mean = a.mean(1)
    d = a - mean[:, None]
    m2, m3, m4 = ((d**k).mean(1) for k in (2, 3, 4))
    with np.errstate(divide="ignore", invalid="ignore"):
        skew = math.sqrt(n * (n - 1)) / (n - 2) * m3 / m2**1.5
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * m4 / m2**2 - 3 * (n - 1))
    flat = m2 < 1e-14 * np.maximum(1, mean) ** 2
    return np.stack([mean, m2, np.where(flat, 0.0, skew), np.where(flat, 0.0, kurt)], 1)


def _entropy(p: np.ndarray) -> np.ndarray:
    total = p.sum(1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        q = p / total
        return np.where(total[:, 0] > 0, -np.where(q > 0, q * np.log(q), 0).sum(1), np.nan)


def _welch(x: np.ndarray) -> np.ndarray:
    """One-sided power density of one Hann segment of the whole window, mean removed."""
    n = x.shape[1]
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    power = np.abs(np.fft.rfft((x - x.mean(1, keepdims=True)) * hann, axis=1)) ** 2 / (hann**2).sum()
    power[:, 1 : -1 if n % 2 == 0 else None] *= 2
    return power


def fourier_entropy(x: np.ndarray) -> np.ndarray:
    return _entropy(_welch(x))


def spkt_welch_density(x: np.ndarray) -> np.ndarray:
    """The density at the first frequency above 0."""
    return _welch(x)[:, 1]


def permutation_entropy(x: np.ndarray) -> np.ndarray:
    """Order 3, delay 1, in bits: entropy of the orders of all neighbouring triples (equal values by place)."""
    triples = np.stack([x[:, :-2], x[:, 1:-1], x[:, 2:]], 2)
    code = (np.argsort(triples, axis=2, kind="stable") * np.array([9, 3, 1])).sum(2)
    counts = np.stack([(code == c).sum(1) for c in (5, 7, 11, 15, 19, 21)], 1).astype(float)
    return _entropy(counts) / math.log(2)


def _in_blocks(f: Callable[[np.ndarray], np.ndarray], x: np.ndarray, rows: int = 500) -> np.ndarray:
    """f of so many windows at a time, which stay in the cache."""
    return np.concatenate([f(x[i : i + rows]) for i in range(0, len(x), rows)]) if len(x) else np.zeros(0)


def _near_templates(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each template of two and of three values (down) of each window (across): how many others of its window lie within r = 0.2
    population standard deviations of it (largest distance). Pairs are looked at lag by lag, for all windows at once."""
    n, r = x.shape[1], 0.2 * x.std(1)
    t = np.ascontiguousarray(x.T)
    two, three = np.zeros((n - 1, len(x)), np.uint16), np.zeros((n - 2, len(x)), np.uint16)
    for lag in range(1, n - 1):
        near = np.abs(t[lag:] - t[:-lag]) <= r
        near2 = near[:-1] & near[1:]
        two[:-lag] += near2
        two[lag:] += near2
        if lag < n - 2:
            near3 = near2[:-1] & near[2:]
            three[:-lag] += near3
            three[lag:] += near3
    return two, three


def sample_entropy(x: np.ndarray) -> np.ndarray:
    """m = 2, r = 0.2 population standard deviations."""

    def of(x: np.ndarray) -> np.ndarray:
        two, three = (c.astype(np.int64) for c in _near_templates(x))
        near2, near3 = two[:-1].sum(0) - two[-1], three.sum(0)  # without the last template of two, which has no third value
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where((near2 > 0) & (near3 > 0), -np.log(near3 / near2), np.where(near2 > 0, np.inf, np.nan))

    out = _in_blocks(of, x)
    return np.where(np.isfinite(out), out, np.nan)


def approximate_entropy(x: np.ndarray) -> np.ndarray:
    """m = 2, r = 0.2 population standard deviations; templates match themselves."""

    def of(x: np.ndarray) -> np.ndarray:
        phi = [np.log((c + 1) / len(c)).mean(0) for c in _near_templates(x)]
        return np.abs(phi[0] - phi[1])

    return _in_blocks(of, x)


# MacKinnon's response-surface coefficients for the p-value of the Dickey-Fuller tau with a constant, one series.
TAU_MAX, TAU_MIN, TAU_STAR = 2.74, -18.83, -1.61
TAU_SMALL = (2.1659, 1.4412, 3.8269e-2)
TAU_LARGE = (1.7339, 9.3202e-1, -1.2745e-1, -1.0368e-2)


def _normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def tau_p_value(tau: float) -> float:
    if tau > TAU_MAX:
        return 1.0
    if tau < TAU_MIN:
        return 0.0
    surface = TAU_SMALL if tau <= TAU_STAR else TAU_LARGE
    return _normal_cdf(sum(c * tau**i for i, c in enumerate(surface)))


def _tau(x: np.ndarray) -> float:
    """Augmented Dickey-Fuller statistic with a constant; the number of lags has the least AIC on a common sample."""
    n = len(x)
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    d = np.diff(x)

    def fit(lags: int, drop: int) -> tuple[float, float]:
        y = d[drop:]
        columns = [x[drop:-1], *(d[drop - j : len(d) - j] for j in range(1, lags + 1)), np.ones(len(y))]
        a = np.stack(columns, 1)
        q, upper = np.linalg.qr(a)
        coefficients = np.linalg.solve(upper, q.T @ y)
        rest = y - a @ coefficients
        ssr = float(rest @ rest)
        inverse = np.linalg.inv(upper)
        error = math.sqrt(ssr / (len(y) - a.shape[1]) * float(inverse[0] @ inverse[0]))
        aic = len(y) * (math.log(2 * math.pi) + math.log(ssr / len(y)) + 1) + 2 * a.shape[1]
        return aic, float(coefficients[0]) / error

    lags = min(range(most + 1), key=lambda k: (fit(k, most)[0], k))
    return fit(lags, lags)[1]


def _moments(x: np.ndarray, d: np.ndarray, lags: int, drop: int, x_last: bool) -> np.ndarray:
    """Sums of products, less their means, of the columns of all windows' regressions: the level, d lagged by 1 to `lags` (the level behind
    them if x_last) and d itself. x and d have a window a column."""
    end = len(d)
    columns = [x[drop:-1] - x[drop:-1].mean(0), *(d[drop - j : end - j] for j in range(1, lags + 1)), d[drop:]]
    if x_last:
        columns = [*columns[1:-1], columns[0], columns[-1]]
    columns = [c - c.mean(0) for c in columns]
    out = np.empty((len(columns), len(columns), x.shape[1]))
    for i, a in enumerate(columns):
        for j, b in enumerate(columns[: i + 1]):
            out[i, j] = out[j, i] = np.einsum("tw,tw->w", a, b)
    return out


def _eliminate(m: np.ndarray, k: int) -> None:
    """Takes column k out of those behind it."""
    share = m[k + 1 :, k] / m[k, k]
    m[k + 1 :, k + 1 :] -= share[:, None] * m[k, k + 1 :][None]


#: Where a pivot or a rest is a smaller share of what it was, or two numbers of lags are nearer by AIC, a window is worked out by _tau().
PIVOT, NEAR_AIC = 1e-7, 1e-6


def _taus(x: np.ndarray) -> np.ndarray:
    """_tau() of many windows at once, by elimination in their matrices of moments; nan where these are too near to singular."""
    n = x.shape[1]
    most = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    x = np.ascontiguousarray(x.T)
    d = np.diff(x, axis=0)
    size = len(d) - most
    m = _moments(x, d, most, most, False)
    own = np.einsum("iiw->iw", m).copy()
    aic, sound = np.empty((most + 1, x.shape[1])), np.ones(x.shape[1], bool)
    for k in range(most + 1):
        sound &= m[k, k] > PIVOT * own[k]
        _eliminate(m, k)
        sound &= m[-1, -1] > PIVOT * own[-1]
        aic[k] = size * np.log(m[-1, -1] / size) + 2 * (k + 2)
    lags = np.nan_to_num(aic, nan=np.inf).argmin(0)
    two = np.partition(aic, 1, axis=0)[:2]
    sound &= two[1] - two[0] > NEAR_AIC
    out = np.full(x.shape[1], np.nan)
    for k in np.unique(lags[sound]).tolist():
        at = np.flatnonzero(sound & (lags == k))
        m = _moments(x[:, at], d[:, at], k, k, True)
        own, good = np.einsum("iiw->iw", m).copy(), np.ones(len(at), bool)
        for i in range(k):
            good &= m[i, i] > PIVOT * own[i]
            _eliminate(m, i)
        good &= m[k, k] > PIVOT * own[k]
        rest = m[-1, -1] - m[k, -1] ** 2 / m[k, k]
        good &= rest > PIVOT * own[-1]
        tau = m[k, -1] / m[k, k] / np.sqrt(rest / (len(d) - k - (k + 2)) / m[k, k])
        out[at] = np.where(good, tau, np.nan)
    return out


def adfuller(x: np.ndarray) -> np.ndarray:
    """The p-value; null for a flat window or where the regression fails."""

    def of(x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), np.nan)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            tau = _taus(x)
        for i, t in enumerate(tau.tolist()):
            try:
                if t == t:
                    out[i] = tau_p_value(t)
                elif np.ptp(x[i]) > 0:
                    out[i] = tau_p_value(_tau(x[i]))
            except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
                pass
        return out

    return _in_blocks(of, x)


def _ricker(points: int, a: float) -> np.ndarray:
    t = np.arange(points) - (points - 1) / 2
    return 2 / (math.sqrt(3 * a) * math.pi**0.25) * (1 - (t / a) ** 2) * np.exp(-(t**2) / (2 * a**2))


@cache
def _wavelets(n: int, widths: tuple[int, ...]) -> np.ndarray:
    """A row of n values times this gives its transforms by all widths, one behind the other."""
    return np.concatenate([np.stack([np.convolve(one, _ricker(min(10 * w, n), w)[::-1], "same") for one in np.eye(n)]) for w in widths], 1)


#: Neighbours nearer than this share of the largest value are told apart in the order of np.convolve's sums.
NEAR_PEAK = 1e-9


def _transforms(x: np.ndarray, widths: tuple[int, ...]) -> np.ndarray:
    """(window, width, place); windows with near ties, as flat ones have, get them by np.convolve."""
    n = x.shape[1]
    rows = (x @ _wavelets(n, widths)).reshape(len(x), len(widths), n)
    near = np.abs(np.diff(rows, axis=2)).min((1, 2)) <= NEAR_PEAK * np.abs(rows).max((1, 2))
    for k in np.flatnonzero(near).tolist():
        rows[k] = [np.convolve(x[k], _ricker(min(10 * w, n), w)[::-1], "same") for w in widths]
    return rows


def number_cwt_peaks(x: np.ndarray, widths: Sequence[int] = tuple(range(1, 10)), gap: int = 3) -> np.ndarray:
    """Ridge lines of the wavelet transform that are long and stand out: maxima linked from the widest wavelet to the narrowest.

    The maxima of a level, of all windows, are linked at once: each goes on the line whose end is nearest (the older of two), if it is
    near enough and no maximum before it took that line, else it begins a line.
    """
    return _in_blocks(lambda part: _ridges(_transforms(part, tuple(widths)), widths, gap), x)


def _ridges(rows: np.ndarray, widths: Sequence[int], gap: int) -> np.ndarray:
    many, levels, n = rows.shape
    inner = np.zeros(rows.shape, bool)
    inner[:, :, 1:-1] = (rows[:, :, 1:-1] > rows[:, :, :-2]) & (rows[:, :, 1:-1] > rows[:, :, 2:])
    # lines, oldest first: window, last column, last level, length, levels missed, open
    window, end, level_of, length, missed = (np.zeros(0, np.int64) for _ in range(5))
    alive = np.zeros(0, bool)
    for level in range(levels - 1, -1, -1):
        far = int(max(1.0, widths[level] / 4))
        w, c = np.nonzero(inner[:, level])
        none = len(window)
        at_end = np.full((many, n + 2 * far), none)  # the oldest open line that ends there
        open_ = np.flatnonzero(alive)[::-1]
        at_end[window[open_], end[open_] + far] = open_
        line = at_end[w, c + far]
        for off in range(1, far + 1):
            line = np.where(line == none, np.minimum(at_end[w, c + far - off], at_end[w, c + far + off]), line)
        first = np.full(none + 1, -1)
        first[line[::-1]] = np.arange(len(line))[::-1]
        goes_on = (line < none) & (first[line] == np.arange(len(line)))
        met = np.zeros(none, bool)
        met[line[goes_on]] = True
        end[line[goes_on]], level_of[line[goes_on]] = c[goes_on], level
        length += met
        missed = np.where(met, 0, missed + alive)
        alive &= missed <= gap
        new = ~goes_on
        begun = int(new.sum())
        window, end, alive = np.concatenate([window, w[new]]), np.concatenate([end, c[new]]), np.concatenate([alive, np.ones(begun, bool)])
        level_of, length, missed = (np.concatenate([a, np.full(begun, v)]) for a, v in ((level_of, level), (length, 1), (missed, 0)))
    kept = length >= math.ceil(levels / 4)
    window, end, level_of = window[kept], end[kept], level_of[kept]
    # the tenth percentile of the narrowest transform around the line's end
    wide = max(1, math.ceil(n / 20))
    low, high = np.maximum(0, end - wide // 2), np.minimum(n, end + wide // 2 + wide % 2)
    ground = np.full(len(end), np.nan)
    for size in np.unique(high - low).tolist():
        some = np.flatnonzero(high - low == size)
        ground[some] = np.percentile(rows[window[some, None], 0, low[some, None] + np.arange(size)], 10, axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        out = (ground != 0) & (np.abs(rows[window, level_of, end] / ground) >= 1)
    return np.bincount(window[out], minlength=many).astype(float)


#: name -> (columns, function of all windows)
STATISTICS: dict[str, tuple[tuple[str, ...], Callable[[np.ndarray], np.ndarray]]] = {
    "lempel_ziv_complexity": (("lempel_ziv_complexity",), lempel_ziv_complexity),
    "fft_aggregated": (("fft_mean", "fft_var", "fft_skew", "fft_kurt"), fft_aggregated),
    "fourier_entropy": (("fourier_entropy",), fourier_entropy),
    "permutation_entropy": (("permutation_entropy",), permutation_entropy),
    "sample_entropy": (("sample_entropy",), sample_entropy),
    "approximate_entropy": (("approx_entropy",), approximate_entropy),
    "adfuller": (("adfuller",), adfuller),
    "number_cwt_peaks": (("number_cwt_peaks",), number_cwt_peaks),
    "spkt_welch_density": (("spkt_welch_density",), spkt_welch_density),
}


def rolling_matrix(x: np.ndarray, f: Callable[[np.ndarray], np.ndarray], width: int, n: int = N) -> np.ndarray:
    """f over every window of n rows without a null, null elsewhere; one row a row of x."""
    out = np.full((len(x), width), np.nan)
    if len(x) >= n:
        windows = np.lib.stride_tricks.sliding_window_view(x, n)
        ready = np.flatnonzero(~np.isnan(windows).any(1))
        if len(ready):
            out[ready + n - 1] = np.asarray(f(windows[ready])).reshape(len(ready), width)
    return out


def columns_of(features: dict[str, bool | Sequence[int]]) -> list[str]:
    out: list[str] = []
    for name, value in features.items():
        if name in recursive.WINDOWED:
            out += [recursive.WINDOWED[name][0].format(n) for n in value or ()]
        elif name in recursive.SWITCHES:
            out += recursive.SWITCHES[name][0] if value else ()
        elif name in STATISTICS:
            out += STATISTICS[name][0] if value else ()
        else:
            raise TypeError(f"unknown feature {name}")
    return out


def compute(g: pd.DataFrame, features: dict[str, bool | Sequence[int]]) -> pd.DataFrame:
    """The features of one ticker's rows, in order of dates."""
    out: dict[str, np.ndarray] = {}
    for name, value in features.items():
        if name in recursive.WINDOWED:
            column, f = recursive.WINDOWED[name]
            out |= {column.format(n): f(g, int(n)).to_numpy(float) for n in value or ()}
        elif name in recursive.SWITCHES and value:
            columns, f = recursive.SWITCHES[name]
            made = f(g)
            out |= {c: (made[c] if isinstance(made, pd.DataFrame) else made).to_numpy(float) for c in columns}
        elif name in STATISTICS and value:
            columns, f = STATISTICS[name]
            made = rolling_matrix(g.px_last.to_numpy(float), f, len(columns))
            out |= {c: made[:, i] for i, c in enumerate(columns)}
    return pd.DataFrame(out, index=g.index)


NEEDED = ("px_last", "px_high", "px_low", "px_volume")


def series_features(panel: DataFrame, **features: bool | Sequence[int]) -> DataFrame:
    """The panel with the recursive and numeric features asked for, all in one pass over each ticker.

    Infinite results are null. Rows of one ticker are one task's, as each of these series is worked out from its own past.
    """
    ship_package(panel.sparkSession)
    columns = columns_of(features)
    if not columns:
        return panel
    rest = [f for f in panel.schema.fields if f.name not in columns]
    schema = T.StructType([*rest, *(T.StructField(c, T.DoubleType()) for c in columns)])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("dates", kind="stable").reset_index(drop=True)
        inputs = pd.DataFrame({c: pd.to_numeric(g[c]).astype(float) for c in NEEDED if c in g})
        made = compute(inputs, features).replace([np.inf, -np.inf], np.nan)  # nan becomes null on the way back
        return pd.concat([g[[f.name for f in rest]], made[columns]], axis=1)

    return panel.groupBy("ticker").applyInPandas(run, schema)
