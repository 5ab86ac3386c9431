"""Features against plain pandas on edge panels."""

import datetime as dt
import math
import time

import numpy as np
import pandas as pd
import pytest

from quantpanel.operators import recursive, tsnumeric
from quantpanel.operators.fundamental import fundamental
from quantpanel.operators.technical import technical
from quantpanel.operators.tsnumeric import series_features
from quantpanel.operators.tsstats import tsstats


def panel(spark, prices, ticker="a", volume=100.0):
    day = dt.date(2020, 1, 1)
    rows = [(ticker, day + dt.timedelta(i), p, None if p is None else p * 1.01, None if p is None else p * 0.99, volume, 1.0) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "ticker string, dates date, px_last double, px_high double, px_low double, px_volume double, turnover double")


def column(df, name):
    return [r[name] for r in df.orderBy("dates").collect()]


def same(a, b):
    return all((x is None and (y is None or math.isnan(y))) or (x is not None and y is not None and math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b, strict=True))


GAP = [100 + math.sin(i) * 5 + i * 0.1 for i in range(120)]
GAP[30] = GAP[70] = None


def test_windows_need_all_values(spark):
    out = technical(panel(spark, GAP), sma=[20], volatility=[20], max_return=[5], cmo=[14])
    s = pd.Series(GAP, dtype=float)
    assert same(column(out, "sma_20"), s.rolling(20).mean())
    assert same(column(out, "volatility_20"), s.pct_change(fill_method=None).rolling(20).std())
    assert same(column(out, "max_return_5"), s / s.shift().rolling(5).min() - 1)


def test_one_exchange_for_all_features(spark):
    out = technical(panel(spark, GAP), sma=[5, 20], roc=[5], bb=True, ulcer=True, mfi=True, cci=[20], kyle_l=True, ultimate=True)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1


def test_flat_and_zero_volume(spark):
    flat = [50.0] * 60
    out = technical(panel(spark, flat, volume=0.0), bb=True, cci=[20], mfi=True, kyle_l=True, vroc=[5])
    row = out.orderBy("dates").collect()[-1]
    assert row["mfi_21"] is None and row["kyle_l"] is None and row["vroc_5"] is None
    more = series_features(tsstats(panel(spark, flat), binned_entropy=True, linear_trend_timewise=True), rsi=[14], adfuller=True, permutation_entropy=True)
    row = more.orderBy("dates").collect()[-1]
    assert row["binned_entropy"] == 0 and row["lintrend_corr"] is None and row["rsi_14"] is None and row["adfuller"] is None


def test_monotone(spark):
    up = [100.0 + i for i in range(60)]
    row = series_features(tsstats(panel(spark, up), linear_trend_timewise=True, first_location_maximum=True), rsi=[14]).orderBy("dates").collect()[-1]
    assert row["rsi_14"] == 100 and row["lintrend_corr"] == pytest.approx(1) and row["first_location_of_maximum"] == pytest.approx(0.98)


@pytest.mark.parametrize("n", [13, 49, 50])
def test_short_series(spark, n):
    out = series_features(tsstats(panel(spark, [100.0 + (i * 7) % 11 for i in range(n)]), mean_change=True), atr=True, fft_aggregated=True)
    last = out.orderBy("dates").collect()[-1]
    assert (last["atr"] is None) == (n < 14)
    assert (last["mean_change"] is None) == (last["fft_mean"] is None) == (n < 50)


def test_exponential_average_decays_through_gaps(spark):
    out = series_features(panel(spark, GAP), ema=[10])
    value, weight, expected, seen = None, 1.0, [], 0
    for x in GAP:
        if value is not None:
            weight *= 1 - 2 / 11
        if x is not None:
            seen += 1
            value = x if value is None else (weight * value + 2 / 11 * x) / (weight + 2 / 11)
            weight = 1.0
        expected.append(value if seen >= 10 else None)
    assert same(column(out, "ema_10"), [math.nan if v is None else v for v in expected])


def test_trend_skips_nulls(spark):
    out = tsstats(panel(spark, GAP), linear_trend_timewise=True).orderBy("dates").collect()
    held = np.array([x for x in GAP[60:110] if x is not None])
    slope, intercept = np.polyfit(np.arange(len(held)), held, 1)
    assert out[109]["lintrend_slope"] == pytest.approx(slope) and out[109]["lintrend_intercept"] == pytest.approx(intercept)
    assert out[48]["lintrend_slope"] is None


def test_numeric_statistics_by_definition():
    x = np.random.default_rng(3).normal(size=(3, 50)).cumsum(1)
    for row, made in zip(x, tsnumeric.fft_aggregated(x), strict=True):
        a = pd.Series(np.abs(np.fft.fft(row)))
        assert made == pytest.approx([a.mean(), a.var(ddof=0), a.skew(), a.kurt()])
    for row, s, ap, pe in zip(x, tsnumeric.sample_entropy(x), tsnumeric.approximate_entropy(x), tsnumeric.permutation_entropy(x), strict=True):
        r = 0.2 * row.std()

        def templates(m, upto):
            return [row[i : i + m] for i in range(upto)]

        def near(t):
            return sum(max(abs(a - b)) <= r for i, a in enumerate(t) for j, b in enumerate(t) if i != j)

        assert s == pytest.approx(-math.log(near(templates(3, 48)) / near(templates(2, 48))))

        def phi(m):
            t = templates(m, 51 - m)
            return np.mean([math.log(np.mean([max(abs(a - b)) <= r for b in t])) for a in t])

        assert ap == pytest.approx(abs(phi(2) - phi(3)))
        orders = pd.Series([tuple(np.argsort(row[i : i + 3], kind="stable")) for i in range(48)]).value_counts(normalize=True)
        assert pe == pytest.approx(-(orders * np.log2(orders)).sum())


def test_lempel_ziv_and_unit_root():
    assert tsnumeric._phrases("0001101001000101") == 6
    rng = np.random.default_rng(1)
    walk, noise = rng.normal(size=50).cumsum(), rng.normal(size=50)
    p = tsnumeric.adfuller(np.stack([walk, noise]))
    assert p[0] > 0.1 and p[1] < 0.01
    # tabulated: -2.86 is the asymptotic 5 % point, -3.43 the 1 % point
    assert tsnumeric.tau_p_value(-2.86) == pytest.approx(0.05, abs=2e-3) and tsnumeric.tau_p_value(-3.43) == pytest.approx(0.01, abs=1e-3)


def test_unit_root_by_least_squares():
    """The statistic by plain least squares on every number of lags."""
    rng = np.random.default_rng(5)
    for walk in (True, False):
        x = rng.normal(size=50).cumsum() if walk else rng.normal(size=50)
        d, most = np.diff(x), min(math.ceil(12 * (50 / 100) ** 0.25), 23)

        def least_squares(lags, drop):
            a = np.array([[x[t], *(d[t - j] for j in range(1, lags + 1)), 1.0] for t in range(drop, 49)])
            y = d[drop:]
            b, *_ = np.linalg.lstsq(a, y, rcond=None)
            ssr = ((y - a @ b) ** 2).sum()
            error = math.sqrt(ssr / (len(y) - a.shape[1]) * np.linalg.inv(a.T @ a)[0, 0])
            return len(y) * math.log(ssr / len(y)) + 2 * a.shape[1], b[0] / error

        lags = min(range(most + 1), key=lambda k: least_squares(k, most)[0])
        assert tsnumeric._tau(x) == pytest.approx(least_squares(lags, lags)[1], rel=1e-6)


def test_wilder_seed_skips_nulls():
    g = pd.DataFrame({"px_high": [3.0, None, *[4.0] * 20], "px_low": [1.0, None, *[2.0] * 20], "px_last": [2.0, None, *[3.0] * 20]})
    tr = recursive.true_range(g)
    assert tr.isna().sum() == 1
    assert recursive.wilder_atr(g)[13] == pytest.approx(np.nanmean(tr[:14])) and recursive.wilder_atr(g)[14:].notna().all()


def test_peaks_of_a_wave():
    t = np.arange(50)
    assert tsnumeric.number_cwt_peaks(np.stack([np.sin(2 * np.pi * t / 12.5) + 2]))[0] >= 3


def test_wilder_seed():
    g = pd.DataFrame({"px_high": np.arange(1.0, 31), "px_low": np.arange(30.0) - 1, "px_last": np.arange(30.0)})
    tr = recursive.true_range(g)
    assert recursive.wilder_atr(g, 14)[13] == pytest.approx(tr[:14].mean()) and recursive.wilder_atr(g.head(13), 14).isna().all()


def test_unknown_and_missing(spark):
    with pytest.raises(TypeError):
        technical(panel(spark, [1.0]), nothing=True)
    with pytest.raises(NotImplementedError):
        technical(panel(spark, [1.0]), beta=[5])
    with pytest.raises(ValueError):
        technical(panel(spark, [1.0]).drop("px_high"), sma=[5])
    with pytest.raises(ValueError):
        fundamental(panel(spark, [1.0]), pe_ratio=True)


def _odd_windows():
    """Windows of few values, flat stretches, straight and periodic lines: where sums of products are singular and maxima tie."""
    rng, t = np.random.default_rng(0), np.arange(50.0)
    odd = [np.full(50, 0.1), t, t**2, np.exp(t), np.where(t < 25, 1.0, 2.0), t % 2, np.sin(t / 3), np.r_[np.zeros(49), 1.0], np.r_[np.zeros(20), rng.random(30)]]
    return np.stack([*odd, *np.round(rng.normal(size=(40, 50)), 1), *np.round(rng.normal(size=(40, 50)).cumsum(1)), *rng.normal(1, 0.1, (40, 50)).cumprod(1)])


def _fast_enough(f, microseconds):
    x = np.random.default_rng(2).normal(1e4, 3e3, (3000, 50))
    best = min(_cpu(f, x) for _ in range(3))
    assert best / len(x) * 1e6 < microseconds


def _cpu(f, x):
    began = time.process_time()
    f(x)
    return time.process_time() - began


def test_entropies_of_odd_windows():
    x = _odd_windows()
    for row, s, ap in zip(x, tsnumeric.sample_entropy(x), tsnumeric.approximate_entropy(x), strict=True):
        r = 0.2 * row.std()
        near = {m: [[max(abs(row[i + k] - row[j + k]) for k in range(m)) <= r for j in range(51 - m)] for i in range(51 - m)] for m in (2, 3)}
        phi = [np.mean([math.log(sum(line) / len(line)) for line in near[m]]) for m in (2, 3)]
        assert ap == pytest.approx(abs(phi[0] - phi[1]), abs=1e-12)
        two, three = (sum(map(sum, (line[:48] for line in near[m][:48]))) - 48 for m in (2, 3))
        assert s == pytest.approx(-math.log(three / two)) if two and three else np.isnan(s)


@pytest.mark.parametrize("f", [tsnumeric.sample_entropy, tsnumeric.approximate_entropy])
def test_entropies_are_fast(f):
    """A panel has tens of millions of windows; pair by pair they took about 400 microseconds each."""
    _fast_enough(f, 60)


def test_unit_root_in_blocks_equals_one_by_one():
    x = np.concatenate([_odd_windows(), np.random.default_rng(4).normal(1e4, 3e3, (200, 50))])
    for row, p in zip(x, tsnumeric.adfuller(x), strict=True):
        try:
            expected = tsnumeric.tau_p_value(tsnumeric._tau(row)) if np.ptp(row) > 0 else np.nan
        except (np.linalg.LinAlgError, ValueError, ZeroDivisionError):
            expected = np.nan
        assert p == pytest.approx(expected, abs=1e-9, nan_ok=True)


def test_unit_root_is_fast():
    """Twelve regressions a window took 1.8 milliseconds."""
    _fast_enough(tsnumeric.adfuller, 200)


def _peaks_step_by_step(row, widths=range(1, 10), gap=3):
    rows = np.stack([np.convolve(row, tsnumeric._ricker(min(10 * w, len(row)), w)[::-1], "same") for w in widths])
    lines, done = [], []  # last column, last level, length, levels missed
    for level in range(len(rows) - 1, -1, -1):
        before, taken = [line[0] for line in lines], set()
        for c in [c for c in range(1, len(row) - 1) if rows[level, c] > rows[level, c - 1] and rows[level, c] > rows[level, c + 1]]:
            near = min(range(len(before)), key=lambda i: abs(before[i] - c), default=None)
            if near is not None and near not in taken and abs(before[near] - c) <= max(1, widths[level] / 4):
                taken.add(near)
                lines[near][:] = [c, level, lines[near][2] + 1, 0]
            else:
                lines.append([c, level, 1, 0])
        for i in range(len(before)):
            lines[i][3] += i not in taken
        done += [line for line in lines if line[3] > gap]
        lines = [line for line in lines if line[3] <= gap]
    found = 0
    for c, level, length, _ in done + lines:
        ground = np.percentile(rows[0, max(0, c - 1) : c + 2], 10)
        found += length >= 3 and ground != 0 and abs(rows[level, c] / ground) >= 1
    return found


def test_peaks_of_all_windows_equal_those_of_each():
    x = np.concatenate([_odd_windows(), np.random.default_rng(4).normal(1e4, 3e3, (200, 50)), np.zeros((1, 50))])
    assert tsnumeric.number_cwt_peaks(x).tolist() == [_peaks_step_by_step(row) for row in x]


def test_peaks_are_fast():
    """Window by window they took 6 milliseconds each."""
    _fast_enough(tsnumeric.number_cwt_peaks, 300)


def test_stc_of_a_long_series():
    """The SQL's closed form leaves the range of doubles after 1,024 rows; the recursion doesn't."""
    price = np.random.default_rng(6).normal(1e4, 3e3, 3000)

    def average(x, span):
        out, a = [], 2 / (span + 1)
        for v in x:
            out.append(v if not out or np.isnan(out[-1]) else (1 - a) * out[-1] + a * v)
        return np.array(out)

    fast = average(price, 23)
    x = fast - average(fast, 50)
    for _ in range(2):
        low, high = (np.array([np.nan] * 9 + [f(x[i - 9 : i + 1]) for i in range(9, len(x))]) for f in (np.min, np.max))
        x = average(100 * (x - low) / (high - low), 3)
    made = recursive.stc(pd.DataFrame({"px_last": price})).to_numpy()
    assert np.allclose(made, x, equal_nan=True, atol=1e-6) and np.isfinite(made[100:]).all()
