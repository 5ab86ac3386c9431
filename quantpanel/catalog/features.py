"""One query a feature over the whole panel of bars, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.catalog import sql as q
from quantpanel.operators.fundamental import fundamental
from quantpanel.operators.technical import technical
from quantpanel.operators.tsnumeric import NEEDED, columns_of, series_features
from quantpanel.operators.tsstats import tsstats
from quantpanel.sources.bars import load_bars

Query = Callable[[SparkSession, str], DataFrame]
FEATURES: dict[str, tuple[Query, str | None]] = {}


def rounded(df: DataFrame, digits: dict[str, int | None], keys: tuple[str, ...] = ("ticker", "dates")) -> DataFrame:
    """The keys and the columns, rounded as the SQL rounds them; +0.0 turns -0.0 into 0.0."""
    return df.select(*keys, *(F.col(c) if d is None else (F.round(F.col(c), d) + F.lit(0.0)).alias(c) for c, d in digits.items()))


def _add(name: str, operator: Callable[..., DataFrame], arguments: dict, digits: dict[str, int | None], sql: str | None) -> None:
    # what goes through Python cannot be pruned by the optimizer
    columns = ("ticker", "dates", *NEEDED) if operator is series_features else ("*",)
    FEATURES[name] = (lambda spark, sf_dir: rounded(operator(load_bars(spark, sf_dir).select(*columns), **arguments), digits)), sql


def windowed(name: str, arguments: dict, digits: dict[str, int | None], *stages: dict[str, str], operator: Callable[..., DataFrame] = technical) -> None:
    _add(name, operator, arguments, digits, q.select(stages, digits))


TP = "(px_high+px_low+px_last)/3"
DELTA = {"d": f"px_last - {q.lag('px_last')}"}
RET = {"r": f"px_last/nullif({q.lag('px_last')}, 0) - 1"}

windowed("sma", {"sma": [20]}, {"sma_20": 4}, {"sma_20": q.avg(20, "px_last")})
windowed("price_gap", {"price_gap": [20]}, {"price_gap_20": 4}, {"m": q.avg(20, "px_last")}, {"price_gap_20": "px_last - m"})
windowed("price_vs_sma", {"price_vs_sma": [20]}, {"price_div_sma_20": 6}, {"m": q.avg(20, "px_last")}, {"price_div_sma_20": "px_last / nullif(m, 0)"})
windowed("roc", {"roc": [10]}, {"roc_10": 4}, {"roc_10": f"(px_last / nullif({q.lag('px_last', 10)}, 0) - 1) * 100"})
windowed("momentum_change", {"momentum_change": True}, {"roc_126": 4, "momentum_change": 4}, {"roc_126": f"(px_last / nullif({q.lag('px_last', 126)}, 0) - 1) * 100"}, {"momentum_change": f"roc_126 - {q.lag('roc_126', 126)}"})
windowed("volatility", {"volatility": [20]}, {"volatility_20": 6}, RET, {"volatility_20": q.full(20, "stddev_samp({})", "r")})
windowed("volume_sma", {"volume_sma": [20]}, {"volume_sma_20": 4}, {"volume_sma_20": q.avg(20, "px_volume")})
windowed("volume_std", {"volume_std": [20]}, {"volume_std_20": 4}, {"volume_std_20": q.full(20, "stddev_samp({})", "px_volume")})
windowed("vroc", {"vroc": [10]}, {"vroc_10": 4}, {"vroc_10": f"(px_volume / nullif({q.lag('px_volume', 10)}, 0) - 1) * 100"})
windowed("turnover", {"turnover": [20]}, {"turnover_20": 5}, {"turnover_20": q.avg(20, "turnover")})
windowed("obv", {"obv": True}, {"obv": 2}, DELTA, {"obv": q.running("sum(coalesce(sign(d) * px_volume, 0))")})
windowed("force_index", {"force_index": True}, {"force_index": 6}, DELTA, {"force_index": "d * px_volume"})
windowed("cmo", {"cmo": [14]}, {"cmo_14": 4}, DELTA, {"u": "CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END", "v": "CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END"}, {"g": q.total(14, "u"), "l": q.total(14, "v")}, {"cmo_14": "100 * (g - l) / nullif(g + l, 0)"})
windowed(
    "ultimate", {"ultimate": True}, {"ultimate": 5}, {"prev": q.lag("px_last")},
    {"lo": "CASE WHEN prev IS NOT NULL THEN least(px_low, prev) END", "hi": "CASE WHEN prev IS NOT NULL THEN greatest(px_high, prev) END"},
    {"bp": "px_last - lo", "tr": "hi - lo"},
    {f"a{n}": f"({q.total(n, 'bp')}) / nullif({q.total(n, 'tr')}, 0)" for n in (7, 14, 28)},
    {"ultimate": "(4*a7 + 2*a14 + a28) / 7"},
)
windowed("awesome", {"awesome": True}, {"awesome_oscillator": 4}, {"m": "(px_high+px_low)/2"}, {"awesome_oscillator": f"({q.avg(5, 'm')}) - ({q.avg(34, 'm')})"})
windowed("max_return", {"max_return": [21]}, {"max_return_21": 5}, {"before": q.lag("px_last")}, {"max_return_21": f"px_last / nullif({q.full(21, 'min({})', 'before')}, 0) - 1"})
windowed("bollinger", {"bb": True}, {"bb_upper": 3, "bb_lower": 3, "bb_position": 5}, {"tp": TP}, {"m": q.avg(20, "tp"), "s": q.full(20, "stddev_samp({})", "tp")}, {"bb_upper": "m + 2*s", "bb_lower": "m - 2*s"}, {"bb_position": "(px_last - bb_lower) / nullif(bb_upper - bb_lower, 0)"})
windowed("ulcer", {"ulcer": True}, {"ulcer_index": 4}, {"top": q.full(21, "max({})", "px_high")}, {"dd": "pow((px_last - top) / nullif(top, 0) * 100, 2)"}, {"ulcer_index": f"sqrt({q.avg(21, 'dd')})"})
windowed("mfi", {"mfi": True}, {"mfi_21": 4}, {"tp": TP}, {"move": f"tp - {q.lag('tp')}", "flow": "tp * px_volume"}, {"up": "CASE WHEN move > 0 THEN flow ELSE 0 END", "down": "CASE WHEN move < 0 THEN flow ELSE 0 END"}, {"mfi_21": f"100 - 100 / (1 + ({q.total(21, 'up')}) / nullif({q.total(21, 'down')}, 0))"})
windowed("cci", {"cci": [20]}, {"cci_20": 3}, {"tp": TP}, {"m": q.avg(20, "tp")}, {"off": "abs(tp - m)"}, {"cci_20": f"(tp - m) / nullif(0.015E0 * ({q.avg(20, 'off')}), 0)"})
windowed(
    "kyle_lambda", {"kyle_l": True}, {"kyle_l": 6}, RET, {"x": "coalesce(sign(r), 0) * ln(nullif(px_last * px_volume, 0))"},
    {"n": f"least(count(r) {q.frame(21)}, count(x) {q.frame(21)})", "cv": f"covar_samp(r, x) {q.frame(21)}", "vx": f"var_pop(x) {q.frame(21)}", "vr": f"var_pop(r) {q.frame(21)}"},
    {"kyle_l": "CASE WHEN n = 21 AND vr > 0 THEN cv / nullif(vx, 0) END"},
)
windowed(
    "corwin_schultz", {"corwin_schultz": True}, {"corwin_schultz": 6}, {"sq": "pow(ln(px_high / px_low), 2)"},
    {"b5": q.total(5, "sq"), "g": f"pow(ln(({q.full(5, 'max({})', 'px_high')}) / ({q.full(5, 'min({})', 'px_low')})), 2)"},
    {"a": f"((sqrt(2) - 1) * ({q.avg(21, 'b5')}) - g / 2) / ((sqrt(2) - 1) / (3 - 2 * sqrt(2)))"}, {"a0": "CASE WHEN a >= 0 THEN a ELSE 0 END"},
    {"corwin_schultz": "2 * (exp(a0) - 1) / (1 + exp(a0))"},
)
windowed("price_ratio", {"price_ratio": [21]}, {"momentum_21": 6, "reversal_21": 6}, {"before": q.lag("px_last", 21)}, {"momentum_21": "before / nullif(px_last, 0)", "reversal_21": "px_last / nullif(before, 0)"})
_ACC = [(10, 20), (10, 40), (10, 60), (20, 40), (20, 60), (40, 60)]
windowed("volume_acceleration", {"acceleration_rate": True}, {f"vol_acc_{a}_{b}": 10 for a, b in _ACC}, {f"v{n}": q.avg(n, "px_volume") for n in (10, 20, 40, 60)}, {f"vol_acc_{a}_{b}": f"v{a} / nullif(v{b}, 0)" for a, b in _ACC})

# ------------------------------------------------------------------ recursive


def recursive(name: str, arguments: dict, digits: dict[str, int | None], *stages: dict[str, str]) -> None:
    windowed(name, arguments, digits, *stages, operator=series_features)


def _ema(out: str, x: str, alpha: str, least: int = 0) -> tuple[dict[str, str], dict[str, str]]:
    k, value = q.ema(x, alpha, least)
    return {f"{x}_k": k}, {out: value}


def _span(n: int) -> str:
    return f"2E0/{n + 1}"


_TR = f"greatest(px_high - px_low, abs(px_high - {q.lag('px_last')}), abs(px_low - {q.lag('px_last')}))"


def _wilder(n: int) -> list[dict[str, str]]:
    """atr of n rows: the mean of the first n true ranges, then the Wilder average."""
    seeded = f"CASE WHEN rn = {n} THEN avg(tr) {q.frame(n)} WHEN rn > {n} THEN tr END"
    return [{"tr": _TR, "rn": f"row_number() OVER ({q.SERIES})"}, {"z": seeded}, *_ema("atr", "z", f"1E0/{n}")]


recursive("ema", {"ema": [20]}, {"ema_20": 4}, *_ema("ema_20", "px_last", _span(20), 20))
recursive(
    "rsi", {"rsi": [14]}, {"rsi_14": 4}, DELTA, {"g": "CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0 END", "l": "CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0 END"},
    {"g_k": q.ema("g", "1E0/14")[0], "l_k": q.ema("l", "1E0/14")[0]}, {"eg": q.ema("g", "1E0/14", 14)[1], "el": q.ema("l", "1E0/14", 14)[1]},
    {"rsi_14": "CASE WHEN el = 0 AND eg > 0 THEN 100 ELSE 100 - 100 / (1 + eg / nullif(el, 0)) END"},
)
recursive(
    "macd", {"macd": True}, {"macd": 4, "macd_signal": 4, "macd_histogram": 4}, {"px_last_k": q.ema("px_last", "0")[0]},
    {"fast": q.ema("px_last", _span(12), 12)[1], "slow": q.ema("px_last", _span(26), 26)[1]}, {"macd": "fast - slow"}, *_ema("macd_signal", "macd", _span(9), 9), {"macd_histogram": "macd - macd_signal"},
)
recursive("trix", {"trix": True}, {"trix": 7}, *_ema("e1", "px_last", _span(21), 21), *_ema("e2", "e1", _span(21), 21), *_ema("e3", "e2", _span(21), 21), {"trix": f"(e3 - {q.lag('e3')}) / nullif({q.lag('e3')}, 0)"})
recursive("atr", {"atr": True}, {"atr": 4}, *_wilder(14))
for _name, _cond, _move in (("plus_di", "up > down AND up > 0", "up"), ("minus_di", "down > up AND down > 0", "down")):
    recursive(
        _name, {_name: True}, {_name: 3}, *_wilder(21), {"up": f"px_high - {q.lag('px_high')}", "down": f"{q.lag('px_low')} - px_low"},
        {"dm": f"CASE WHEN {_cond} THEN {_move} ELSE 0 END"}, {_name: f"(({q.total(21, 'dm')}) - ({q.avg(21, 'dm')}) + dm) / nullif(atr, 0) * 100"},
    )
recursive("mean_price_volatility", {"mean_price_volatility": [20]}, {"mean_std_20": 4}, {"tp": TP}, {"s": q.full(20, "stddev_samp({})", "tp")}, *_ema("mean_std_20", "s", _span(20), 20))
recursive("mass_index", {"mass_index": True}, {"mass_index": 5}, {"w": "px_high - px_low"}, *_ema("e1", "w", _span(9)), *_ema("e2", "e1", _span(9)), {"x": "e1 / nullif(e2, 0)"}, {"mass_index": q.total(25, "x")})
_RANGE = "100 * ({0} - ({1})) / nullif(({2}) - ({1}), 0)"
recursive(
    "stc", {"stc": True}, {"stc": 4}, *_ema("e1", "px_last", _span(23)), *_ema("e2", "e1", _span(50)), {"m": "e1 - e2"},
    {"s": _RANGE.format("m", q.full(10, "min({})", "m"), q.full(10, "max({})", "m"))}, *_ema("es", "s", _span(3)),
    {"dd": _RANGE.format("es", q.full(10, "min({})", "es"), q.full(10, "max({})", "es"))}, *_ema("stc", "dd", _span(3)),
)
recursive(
    "amihud", {"amih_l": True}, {"amih_l": 5}, {"r": RET["r"], "dv": "px_last * px_volume"}, {"r_k": q.ema("r", "0")[0], "dv_k": q.ema("dv", "0")[0]},
    {"er": q.ema("r", _span(21), 21)[1], "ed": q.ema("dv", _span(21), 21)[1]}, {"amih_l": "abs(er) / nullif(ed, 0) * 1000000"},
)

# ------------------------------------------------------------------ statistics of the last 50 closes


def stats(name: str, arguments: dict, digits: dict[str, int | None], *stages: dict[str, str]) -> None:
    windowed(name, arguments, digits, *stages, operator=tsstats)


L50 = {"l": q.full(50, "list({})", "px_last"), "m": q.avg(50, "px_last")}
_READY = f"count(px_last) {q.frame(50)} = 50"
stats("mean_change", {"mean_change": True}, {"mean_change": 9}, {"mean_change": f"CASE WHEN {_READY} THEN (px_last - {q.lag('px_last', 49)}) / 49 END"})
stats("mean_abs_change", {"mean_abs_change": True}, {"mean_abs_change": 4}, DELTA, {"a": "abs(d)"}, {"mean_abs_change": q.avg(49, "a")})
stats("mean_second_derivative", {"mean_second_derivative_central": True}, {"mean_second_derivative_central": 11}, {"mean_second_derivative_central": f"CASE WHEN {_READY} THEN (px_last - {q.lag('px_last', 1)} - {q.lag('px_last', 48)} + {q.lag('px_last', 49)}) / 96 END"})
stats("cid_ce", {"cid_ce": True}, {"cid_ce": 3}, DELTA, {"sq": "d * d"}, {"cid_ce": f"sqrt({q.total(49, 'sq')})"})
stats("time_reversal_asymmetry", {"time_reversal_asymmetry_statistic": True}, {"time_reversal_asymmetry_statistic": -3}, {"t": f"px_last * px_last * {q.lag('px_last', 2)} - pow({q.lag('px_last', 1)}, 2)"}, {"time_reversal_asymmetry_statistic": f"CASE WHEN {_READY} THEN {q.avg(48, 't')} END"})
stats("energy_ratio", {"energy_ratio_chunks": True}, {"energy_ratio_by_chunks": 6}, {"sq": "px_last * px_last"}, {"energy_ratio_by_chunks": f"({q.total(25, 'sq', 25)}) / nullif({q.total(50, 'sq')}, 0)"})
_M = {f"m{k}": f"list_sum(list_transform(l, lambda v: pow(v - m, {k}))) / 50" for k in (2, 3, 4)}
stats("skewness", {"skewness": True}, {"skewness": 5}, L50, _M, {"skewness": "sqrt(50) * m3 / nullif(pow(m2, 1.5), 0)"})
stats("kurtosis", {"kurtosis": True}, {"kurtosis": 5}, L50, _M, {"kurtosis": "49E0 / (48 * 47) * (51 * m4 / nullif(m2 * m2, 0) - 147)"})
stats("variation_coefficient", {"variation_coefficient": True}, {"variation_coefficient": 6}, {"variation_coefficient": f"({q.full(50, 'stddev_pop({})', 'px_last')}) / nullif({q.avg(50, 'px_last')}, 0)"})
stats(
    "linear_trend", {"linear_trend_timewise": True}, {"lintrend_slope": 5, "lintrend_corr": 6, "lintrend_intercept": 4, "lintrend_p": 6, "lintrend_stderr": 4},
    {"rn": f"row_number() OVER ({q.SERIES})"},
    {"c": f"count(px_last) {q.frame(50)}", "slope": f"regr_slope(px_last, rn) {q.frame(50)}", "co": f"corr(px_last, rn) {q.frame(50)}", "a": f"avg(px_last) {q.frame(50)}", "v": f"var_pop(px_last) {q.frame(50)}"},
    {"lintrend_slope": "CASE WHEN c >= 2 AND rn >= 50 THEN slope END", "lintrend_corr": "CASE WHEN c >= 2 AND rn >= 50 THEN co END"},
    {"lintrend_intercept": "a - lintrend_slope * (c - 1) / 2", "lintrend_p": "2 * (1 - abs(lintrend_corr))", "lintrend_stderr": "CASE WHEN c >= 2 AND rn >= 50 THEN sqrt(greatest((1 - lintrend_corr * lintrend_corr) * v, 0)) END"},
)
for _side, _sign in (("above", ">"), ("below", "<")):
    stats(f"count_{_side}_mean", {f"count_{_side}_mean": True}, {f"count_{_side}_mean": None}, L50, {f"count_{_side}_mean": f"cast(len(list_filter(l, lambda v: v {_sign} m)) AS double)"})
    stats(
        f"longest_strike_{_side}_mean", {f"longest_strike_{_side}_mean": True}, {f"longest_strike_{_side}_mean": None}, L50,
        {"runs": f"regexp_extract_all(list_aggregate(list_transform(l, lambda v: CASE WHEN v {_sign} m THEN '1' ELSE '0' END), 'string_agg', ''), '1+')"},
        {f"longest_strike_{_side}_mean": "cast(nullif(list_max(list_transform(runs, lambda s: length(s))), 0) AS double)"},
    )
stats("first_location_maximum", {"first_location_maximum": True}, {"first_location_of_maximum": 4}, L50, {"first_location_of_maximum": "(list_position(l, list_max(l)) - 1) / 50"})
stats("first_location_minimum", {"first_location_minimum": True}, {"first_location_of_minimum": 4}, L50, {"first_location_of_minimum": "(list_position(l, list_min(l)) - 1) / 50"})
stats("last_location_maximum", {"last_location_of_maximum": True}, {"last_location_of_maximum": 4}, L50, {"last_location_of_maximum": "(50 - list_position(list_reverse(l), list_max(l))) / 50"})
stats("index_mass_quantile", {"index_mass_quantile": 0.5}, {"index_mass_quantile": 4}, L50, {"half": "list_sum(list_transform(l, lambda v: abs(v))) * 0.5E0"}, {"index_mass_quantile": "CASE WHEN l IS NOT NULL THEN len(list_filter(range(1, 51), lambda i: list_sum(list_transform(l[1:i], lambda v: abs(v))) < half)) / 50 END"})
stats(
    "binned_entropy", {"binned_entropy": True}, {"binned_entropy": 5}, {"l": q.full(10, "list({})", "px_last")}, {"lo": "list_min(l)", "hi": "list_max(l)"},
    {"b": "list_transform(l, lambda v: least(9, floor((v - lo) / nullif(hi - lo, 0) * 10)))"},
    {"binned_entropy": "CASE WHEN l IS NULL THEN NULL WHEN hi = lo THEN 0 ELSE -list_sum(list_transform(list_distinct(b), lambda x: len(list_filter(b, lambda y: y = x)) / 10 * ln(len(list_filter(b, lambda y: y = x)) / 10))) END"},
)
for _name in ("adfuller", "number_cwt_peaks"):
    _add(_name, series_features, {_name: True}, {c: None for c in columns_of({_name: True})}, None)


def numeric(name: str, digits: dict[str, int | None], sql: str) -> None:
    _add(name, series_features, {name: True}, digits, sql)


_STEPS = "(a > b)::int * 4 + (b > c)::int * 2 + (a > c)::int"  # which of three neighbours are out of order
numeric(
    "permutation_entropy", {"permutation_entropy": 6},
    q.select(
        [
            {"a": q.lag("px_last", 2), "b": q.lag("px_last"), "c": "px_last", "rn": f"row_number() OVER ({q.SERIES})"},
            {"code": f"CASE WHEN a IS NOT NULL THEN {_STEPS} END"},
            {f"n{k}": f"count(*) FILTER (WHERE code = {k}) {q.frame(48)}" for k in (0, 2, 3, 4, 5, 7)},
            {"permutation_entropy": "CASE WHEN rn >= 50 THEN " + " + ".join(f"CASE WHEN n{k} > 0 THEN -(n{k} / 48E0) * log2(n{k} / 48E0) ELSE 0 END" for k in (0, 2, 3, 4, 5, 7)) + " END"},
        ],
        {"permutation_entropy": 6},
    ),
)

# the sums of the discrete Fourier transform, frequency by frequency; w: the window, hann: one segment's weights
_FOURIER = f"""WITH {q.BARS}, l AS (SELECT ticker, dates, {q.full(50, 'list({})', 'px_last')} AS w FROM bars),
t AS (SELECT cast(range AS double) AS t, 0.5E0 - 0.5E0 * cos(2 * pi() * range / 50) AS h FROM range(50)),
b AS (SELECT range AS k, list(cos(2 * pi() * range * t / 50) ORDER BY t) AS c, list(sin(2 * pi() * range * t / 50) ORDER BY t) AS s,
  list(h * cos(2 * pi() * range * t / 50) ORDER BY t) AS hc, list(h * sin(2 * pi() * range * t / 50) ORDER BY t) AS hs,
  sum(h * cos(2 * pi() * range * t / 50)) AS zc, sum(h * sin(2 * pi() * range * t / 50)) AS zs, sum(h * h) AS hh FROM range(26), t GROUP BY range)"""
_BINS = ", f AS (SELECT ticker, dates, k, CASE WHEN k IN (0, 25) THEN 1 ELSE 2 END AS n, sqrt(pow(list_dot_product(w, c), 2) + pow(list_dot_product(w, s), 2)) AS x FROM l, b WHERE w IS NOT NULL)"
_FFT = {"fft_mean": 3, "fft_var": 1, "fft_skew": 5, "fft_kurt": 4}
numeric(
    "fft_aggregated", _FFT,
    _FOURIER + _BINS + """, m AS (SELECT ticker, dates, sum(n * x) / 50 AS fft_mean FROM f GROUP BY ticker, dates),
d AS (SELECT ticker, dates, any_value(fft_mean) AS fft_mean, sum(n * pow(x - fft_mean, 2)) / 50 AS fft_var, sum(n * pow(x - fft_mean, 3)) / 50 AS m3, sum(n * pow(x - fft_mean, 4)) / 50 AS m4 FROM f JOIN m USING (ticker, dates) GROUP BY ticker, dates),
g AS (SELECT l.ticker, l.dates, fft_mean, fft_var, sqrt(50 * 49E0) / 48 * m3 / pow(fft_var, 1.5) AS fft_skew, 49E0 / (48 * 47) * (51 * m4 / pow(fft_var, 2) - 147) AS fft_kurt FROM l LEFT JOIN d USING (ticker, dates))
SELECT ticker, dates, """ + ", ".join(f"round({c}, {n}) + 0.0 AS {c}" for c, n in _FFT.items()) + " FROM g",
)
_POWER = """, c AS (SELECT ticker, dates, w, list_sum(w) / 50 AS mean FROM l WHERE w IS NOT NULL),
f AS (SELECT ticker, dates, k, CASE WHEN k IN (0, 25) THEN 1 ELSE 2 END * (pow(list_dot_product(w, hc) - mean * zc, 2) + pow(list_dot_product(w, hs) - mean * zs, 2)) / hh AS x FROM c, b)"""
numeric(
    "fourier_entropy", {"fourier_entropy": 6},
    _FOURIER + _POWER + """, s AS (SELECT ticker, dates, sum(x) AS total FROM f GROUP BY ticker, dates),
e AS (SELECT ticker, dates, -sum(CASE WHEN x > 0 THEN x / total * ln(x / total) ELSE 0 END) AS e FROM f JOIN s USING (ticker, dates) GROUP BY ticker, dates)
SELECT l.ticker, l.dates, round(e, 6) + 0.0 AS fourier_entropy FROM l LEFT JOIN e USING (ticker, dates)""",
)
numeric("spkt_welch_density", {"spkt_welch_density": 2}, _FOURIER + _POWER + " SELECT l.ticker, l.dates, round(x, 2) + 0.0 AS spkt_welch_density FROM l LEFT JOIN f ON f.ticker = l.ticker AND f.dates = l.dates AND k = 1")

# pairs of templates of two and of three values that lie within r of each other, place by place
_WINDOWS = f"WITH {q.BARS}, l AS (SELECT ticker, dates, {q.full(50, 'list({})', 'px_last')} AS w FROM bars), r AS (SELECT ticker, dates, w, 0.2E0 * list_aggregate(w, 'stddev_pop') AS r FROM l WHERE w IS NOT NULL)"
_PLACES = ", i AS (SELECT ticker, dates, w, r, unnest(range(1, {last})) AS i FROM r), j AS (SELECT ticker, dates, i, abs(w[i] - w[j]) <= r AND abs(w[i + 1] - w[j + 1]) <= r AS two, j < 49 AND i < 49 AND abs(w[i] - w[j]) <= r AND abs(w[i + 1] - w[j + 1]) <= r AND abs(w[i + 2] - w[j + 2]) <= r AS three, i < 49 AND j < 49 AS inner_ FROM (SELECT *, unnest(range(1, {last})) AS j FROM i))"
numeric(
    "sample_entropy", {"sample_entropy": 6},
    _WINDOWS + _PLACES.format(last=49) + """, n AS (SELECT ticker, dates, count(*) FILTER (WHERE two) - 48 AS two, count(*) FILTER (WHERE three) - 48 AS three FROM j GROUP BY ticker, dates)
SELECT l.ticker, l.dates, CASE WHEN two > 0 AND three > 0 THEN round(-ln(three / cast(two AS double)), 6) + 0.0 END AS sample_entropy FROM l LEFT JOIN n USING (ticker, dates)""",
)
numeric(
    "approximate_entropy", {"approx_entropy": 6},
    _WINDOWS + _PLACES.format(last=50) + """, n AS (SELECT ticker, dates, i, count(*) FILTER (WHERE two) AS two, count(*) FILTER (WHERE three) AS three FROM j GROUP BY ticker, dates, i),
p AS (SELECT ticker, dates, avg(ln(two / 49E0)) AS p2, avg(ln(three / 48E0)) FILTER (WHERE i < 49) AS p3 FROM n GROUP BY ticker, dates)
SELECT l.ticker, l.dates, round(abs(p2 - p3), 6) + 0.0 AS approx_entropy FROM l LEFT JOIN p USING (ticker, dates)""",
)
# a phrase grows while it stands somewhere in the text before its own last letter
numeric(
    "lempel_ziv_complexity", {"lempel_ziv_complexity": None},
    f"""WITH RECURSIVE {q.BARS}, l AS (SELECT ticker, dates, {q.full(50, 'list({})', 'px_last')} AS w FROM bars),
x AS (SELECT ticker, dates, list_aggregate(list_transform(w, lambda v: CASE WHEN v > m THEN '1' ELSE '0' END), 'string_agg', '') AS x FROM (SELECT *, list_aggregate(w, 'median') AS m FROM l WHERE w IS NOT NULL)),
p AS (SELECT ticker, dates, x, 1 AS phrases, 0 AS start, 1 AS size FROM x
  UNION ALL SELECT ticker, dates, x, CASE WHEN old THEN phrases ELSE phrases + 1 END, CASE WHEN old THEN start ELSE start + size END, CASE WHEN old THEN size + 1 ELSE 1 END
  FROM (SELECT *, contains(substr(x, 1, start + size - 1), substr(x, start + 1, size)) AS old FROM p WHERE start + size <= 50)),
n AS (SELECT ticker, dates, cast(max(phrases) AS double) AS n FROM p GROUP BY ticker, dates)
SELECT l.ticker, l.dates, n AS lempel_ziv_complexity FROM l LEFT JOIN n USING (ticker, dates)""",
)

# ------------------------------------------------------------------ fundamentals


def ratio(name: str, expression: str, digits: int = 6, *stages: dict[str, str]) -> None:
    _add(name, fundamental, {name: True}, {name: digits}, q.select([*stages, {name: expression}], {name: digits}))


_EQUITY = "(bs_tot_asset - bs_total_liabilities)"
ratio("pe_ratio", "CASE WHEN is_eps > 0 THEN px_last / is_eps END", 9)
ratio("earnings_yield", "is_eps / nullif(px_last, 0)")
ratio("debt_to_assets", "bs_total_liabilities / nullif(bs_tot_asset, 0)")
ratio("debt_to_capital", f"bs_total_liabilities / nullif(bs_total_liabilities + {_EQUITY}, 0)")
ratio("equity_ratio", f"{_EQUITY} / nullif(bs_tot_asset, 0)")
ratio("market_to_book", f"CASE WHEN {_EQUITY} > 0 THEN cur_mkt_cap / {_EQUITY} END", 3)
ratio("adjusted_roic", "operating_roic - wacc")
ratio("operating_efficiency", "oper_margin * sales_growth")
ratio("levered_roa", "return_on_asset * (1 + coalesce(tot_debt_to_tot_eqy, 0))")
ratio("eps_growth", "CASE WHEN before > 0 THEN (is_eps - before) / before END", 4, {"before": q.lag("is_eps")})
_add(
    "pe_band", fundamental, {"pe_band": ([60], [25, 75])}, {"pe_band_60_25": 9, "pe_band_60_75": 9},
    q.select([{"pe": "CASE WHEN is_eps > 0 THEN px_last / is_eps END"}, {f"pe_band_60_{p}": f"quantile_cont(pe, {p / 100}) {q.frame(60)}" for p in (25, 75)}], {"pe_band_60_25": 9, "pe_band_60_75": 9}),
)
