"""Rolling statistics of the last 50 closes (binned entropy: 10) as window expressions and array functions.

A value exists only where all 50 closes are there, except for the linear trend, which takes the closes that are there (two at least) among 50
rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantpanel.functions.windows import divide, full, lag, last_rows, values
from quantpanel.plans.stages import FeaturePlan

N = 50


def _p() -> Column:
    return F.col("px_last")


def _ready() -> Column:
    return F.count(_p()).over(last_rows(N)) == N


def _array(plan: FeaturePlan, n: int = N) -> Column:
    return plan.helper(1, f"closes_{n}", values(n, _p()))


def _delta(plan: FeaturePlan) -> Column:
    return plan.helper(1, "delta", _p() - lag(_p()))


def mean_change(plan: FeaturePlan) -> None:
    plan.output(1, "mean_change", F.when(_ready(), (_p() - lag(_p(), N - 1)) / (N - 1)))


def mean_abs_change(plan: FeaturePlan) -> None:
    d = F.abs(_delta(plan))
    plan.output(2, "mean_abs_change", full(N - 1, d, F.avg))


def mean_second_derivative_central(plan: FeaturePlan) -> None:
    ends = _p() - lag(_p(), 1) - lag(_p(), N - 2) + lag(_p(), N - 1)
    plan.output(1, "mean_second_derivative_central", F.when(_ready(), ends / (2 * (N - 2))))


def cid_ce(plan: FeaturePlan) -> None:
    d = _delta(plan)
    plan.output(2, "cid_ce", F.sqrt(full(N - 1, d * d, F.sum)))


def time_reversal_asymmetry_statistic(plan: FeaturePlan) -> None:
    one, two = lag(_p(), 1), lag(_p(), 2)
    term = plan.helper(1, "reversal_term", _p() * _p() * two - one * one)
    plan.output(2, "time_reversal_asymmetry_statistic", F.when(_ready(), full(N - 2, term, F.avg)))


def energy_ratio_chunks(plan: FeaturePlan) -> None:
    sq = _p() * _p()
    plan.output(1, "energy_ratio_by_chunks", divide(full(N // 2, sq, F.sum, end=N // 2), full(N, sq, F.sum)))


def skewness(plan: FeaturePlan) -> None:
    """Root of the row count times the population skewness."""
    plan.output(1, "skewness", F.when(_ready(), N**0.5 * F.skewness(_p()).over(last_rows(N))))


def kurtosis(plan: FeaturePlan) -> None:
    """Sample excess kurtosis; the built-in is the population's."""
    pop = F.kurtosis(_p()).over(last_rows(N)) + 3
    plan.output(1, "kurtosis", F.when(_ready() & (F.var_pop(_p()).over(last_rows(N)) > 0), (N - 1) / ((N - 2) * (N - 3)) * ((N + 1) * pop - 3 * (N - 1))))


def variation_coefficient(plan: FeaturePlan) -> None:
    w = last_rows(N)
    plan.output(1, "variation_coefficient", F.when(_ready(), divide(F.stddev_pop(_p()).over(w), F.avg(_p()).over(w))))


def linear_trend_timewise(plan: FeaturePlan) -> None:
    """Least squares over the non-null closes of the last 50 rows, numbered 0, 1, ... among themselves."""
    found = plan.helper(1, "held", F.collect_list(_p()).over(last_rows(N)))
    numbered = F.transform(found, lambda x, i: F.struct(i.cast("double").alias("t"), x.alias("x")))
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("sx", "stx", "sxx")))
    # centred on the mean, so that large prices do not cancel
    m = plan.helper(2, "trend_m", F.size(found).cast("double"))
    mean = plan.helper(2, "trend_mean", F.aggregate(found, F.lit(0.0), lambda a, x: a + x) / F.when(F.size(found) > 0, F.size(found)))
    mid = (F.col("_trend_m") - 1) / 2
    plan.helper(1, "trend_rows", F.count(F.lit(1)).over(last_rows(N)))
    sums = plan.helper(
        3,
        "trend_sums",
        F.aggregate(
            numbered,
            zero,
            lambda a, p: F.struct(
                (a["sx"] + (p["x"] - mean)).alias("sx"),
                (a["stx"] + (p["t"] - mid) * (p["x"] - mean)).alias("stx"),
                (a["sxx"] + (p["x"] - mean) * (p["x"] - mean)).alias("sxx"),
            ),
        ),
    )
    stt = m * (m * m - 1) / 12
    enough = (F.col("_trend_m") >= 2) & (F.col("_trend_rows") == N)
    slope = plan.output(4, "lintrend_slope", F.when(enough, sums["stx"] / stt))
    corr = plan.output(4, "lintrend_corr", F.when(enough, divide(sums["stx"], F.sqrt(stt * sums["sxx"]))))
    plan.output(5, "lintrend_intercept", mean - slope * mid)
    plan.output(5, "lintrend_p", 2 * (1 - F.abs(corr)))
    plan.output(5, "lintrend_stderr", F.when(enough, F.sqrt(F.greatest(sums["sxx"] - slope * sums["stx"], F.lit(0.0)) / m)))


def count_above_mean(plan: FeaturePlan) -> None:
    x, mean = _array(plan), plan.helper(1, "mean_50", full(N, _p(), F.avg))
    plan.output(2, "count_above_mean", F.when(x.isNotNull(), F.size(F.filter(x, lambda v: v > mean)).cast("double")))


def count_below_mean(plan: FeaturePlan) -> None:
    x, mean = _array(plan), plan.helper(1, "mean_50", full(N, _p(), F.avg))
    plan.output(2, "count_below_mean", F.when(x.isNotNull(), F.size(F.filter(x, lambda v: v < mean)).cast("double")))


def first_location_maximum(plan: FeaturePlan) -> None:
    x = _array(plan)
    plan.output(2, "first_location_of_maximum", (F.array_position(x, F.array_max(x)) - 1) / N)


def first_location_minimum(plan: FeaturePlan) -> None:
    x = _array(plan)
    plan.output(2, "first_location_of_minimum", (F.array_position(x, F.array_min(x)) - 1) / N)


def last_location_of_maximum(plan: FeaturePlan) -> None:
    x = _array(plan)
    plan.output(2, "last_location_of_maximum", (N - F.array_position(F.reverse(x), F.array_max(x))) / N)


def index_mass_quantile(plan: FeaturePlan, q: float) -> None:
    """How many closes' absolute values stay below the share q of the whole, as a share of 50."""
    x = _array(plan)
    goal = plan.helper(2, "mass_goal", F.aggregate(x, F.lit(0.0), lambda a, v: a + F.abs(v)) * q)
    zero = F.struct(F.lit(0.0).alias("mass"), F.lit(0).alias("n"))
    step = lambda a, v: F.struct((a["mass"] + F.abs(v)).alias("mass"), (a["n"] + F.when(a["mass"] + F.abs(v) < goal, 1).otherwise(0)).alias("n"))
    plan.output(3, "index_mass_quantile", F.aggregate(x, zero, step)["n"] / N)


def _longest(x: Column, hit: Callable[[Column], Column]) -> Column:
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, v: Column) -> Column:
        run = F.when(hit(v), a["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"))

    best = F.aggregate(x, zero, step)["best"]
    return F.when(best > 0, best.cast("double"))


def longest_strike_above_mean(plan: FeaturePlan) -> None:
    x, mean = _array(plan), plan.helper(1, "mean_50", full(N, _p(), F.avg))
    plan.output(2, "longest_strike_above_mean", _longest(x, lambda v: v > mean))


def longest_strike_below_mean(plan: FeaturePlan) -> None:
    x, mean = _array(plan), plan.helper(1, "mean_50", full(N, _p(), F.avg))
    plan.output(2, "longest_strike_below_mean", _longest(x, lambda v: v < mean))


def binned_entropy(plan: FeaturePlan) -> None:
    """Entropy (nats) of ten equally wide bins of the last ten closes; the last bin is closed."""
    x = _array(plan, 10)
    low, high = F.array_min(x), F.array_max(x)
    bins = plan.helper(2, "bins", F.transform(x, lambda v: F.least(F.lit(9), F.floor((v - low) / F.when(high > low, high - low) * 10)).cast("int")))
    share = lambda b: F.size(F.filter(bins, lambda v: v == b)) / 10.0
    entropy = F.aggregate(F.array_distinct(bins), F.lit(0.0), lambda a, b: a - share(b) * F.ln(share(b)))
    plan.output(3, "binned_entropy", F.when(x.isNotNull(), F.when(F.array_max(x) == F.array_min(x), 0.0).otherwise(entropy)))


SWITCHES: dict[str, Callable[[FeaturePlan], None]] = {
    f.__name__: f
    for f in (
        mean_change, mean_abs_change, mean_second_derivative_central, cid_ce, time_reversal_asymmetry_statistic, energy_ratio_chunks, skewness,
        linear_trend_timewise, kurtosis, variation_coefficient, count_above_mean, count_below_mean, first_location_maximum, first_location_minimum,
        last_location_of_maximum, longest_strike_above_mean, longest_strike_below_mean, binned_entropy,
    )
}


def plan_tsstats(plan: FeaturePlan, **features: bool | float) -> FeaturePlan:
    for name, value in features.items():
        if name == "index_mass_quantile":
            if value:
                index_mass_quantile(plan, float(value))
        elif name in SWITCHES:
            if value:
                SWITCHES[name](plan)
        else:
            raise TypeError(f"unknown feature {name}")
    return plan


def tsstats(panel: DataFrame, **features: bool | float) -> DataFrame:
    return plan_tsstats(FeaturePlan(), **features).apply(panel)
