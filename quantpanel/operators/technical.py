"""Windowed technical indicators as DataFrame window expressions.

`technical(panel, sma=[20], obv=True, ...)` adds one column a feature and window. Every rolling value needs its full number of
non-null inputs. Nulls are the only missing values; divisions by zero give null.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantpanel.functions.windows import divide, full, lag, last_rows, so_far
from quantpanel.plans.stages import FeaturePlan

REQUIRED = ("ticker", "dates", "px_last", "px_high", "px_low", "px_volume")


def _p() -> Column:
    return F.col("px_last")


def _h() -> Column:
    return F.col("px_high")


def _l() -> Column:
    return F.col("px_low")


def _v() -> Column:
    return F.col("px_volume")


def _tp() -> Column:
    return (_h() + _l() + _p()) / 3


def _prev(plan: FeaturePlan) -> Column:
    return plan.helper(1, "prev", lag(_p()))


def _delta(plan: FeaturePlan) -> Column:
    return plan.helper(1, "delta", _p() - lag(_p()))


def _ret(plan: FeaturePlan) -> Column:
    return plan.helper(1, "ret", divide(_p(), lag(_p())) - 1)


def sma(plan: FeaturePlan, n: int) -> None:
    plan.output(1, f"sma_{n}", full(n, _p(), F.avg))


def price_gap(plan: FeaturePlan, n: int) -> None:
    plan.output(1, f"price_gap_{n}", _p() - full(n, _p(), F.avg))


def price_vs_sma(plan: FeaturePlan, n: int) -> None:
    plan.output(1, f"price_div_sma_{n}", divide(_p(), full(n, _p(), F.avg)))


def roc(plan: FeaturePlan, n: int) -> None:
    plan.output(1, f"roc_{n}", (divide(_p(), lag(_p(), n)) - 1) * 100)


def momentum_change(plan: FeaturePlan) -> None:
    """roc_126 less itself 126 rows ago; also gives roc_126."""
    roc(plan, 126)
    plan.output(1, "momentum_change", (divide(_p(), lag(_p(), 126)) - divide(lag(_p(), 126), lag(_p(), 252))) * 100)


def volatility(plan: FeaturePlan, n: int) -> None:
    plan.output(2, f"volatility_{n}", full(n, _ret(plan), F.stddev_samp))


def volume_sma(plan: FeaturePlan, n: int) -> None:
    plan.output(1, f"volume_sma_{n}", full(n, _v(), F.avg))


def volume_std(plan: FeaturePlan, n: int) -> None:
    plan.output(1, f"volume_std_{n}", full(n, _v(), F.stddev_samp))


def vroc(plan: FeaturePlan, n: int) -> None:
    plan.output(1, f"vroc_{n}", (divide(_v(), lag(_v(), n)) - 1) * 100)


def turnover(plan: FeaturePlan, n: int) -> None:
    plan.output(1, f"turnover_{n}", full(n, F.col("turnover"), F.avg))


def obv(plan: FeaturePlan) -> None:
    signed = F.coalesce(F.signum(_delta(plan)) * _v(), F.lit(0.0))
    plan.output(2, "obv", F.sum(signed).over(so_far()))


def force_index(plan: FeaturePlan) -> None:
    plan.output(1, "force_index", (_p() - lag(_p())) * _v())


def cmo(plan: FeaturePlan, n: int) -> None:
    d = _delta(plan)
    up = full(n, F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), F.sum)
    down = full(n, F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0))), F.sum)
    plan.output(2, f"cmo_{n}", divide(up - down, up + down) * 100)


def ultimate(plan: FeaturePlan) -> None:
    """Weighted buying pressure over 7, 14 and 28 rows; null where any of the four prices is null."""
    prev = _prev(plan)
    low = F.when(_l().isNotNull() & prev.isNotNull(), F.least(_l(), prev))
    high = F.when(_h().isNotNull() & prev.isNotNull(), F.greatest(_h(), prev))
    bp, tr = plan.helper(2, "bp", _p() - low), plan.helper(2, "true_range", high - low)
    parts = [divide(full(n, bp, F.sum), full(n, tr, F.sum)) for n in (7, 14, 28)]
    plan.output(3, "ultimate", (4 * parts[0] + 2 * parts[1] + parts[2]) / 7)


def awesome(plan: FeaturePlan) -> None:
    mid = (_h() + _l()) / 2
    plan.output(1, "awesome_oscillator", full(5, mid, F.avg) - full(34, mid, F.avg))


def max_return(plan: FeaturePlan, n: int) -> None:
    plan.output(1, f"max_return_{n}", divide(_p(), full(n, _p(), F.min, end=1)) - 1)


def bb(plan: FeaturePlan) -> None:
    mean, spread = full(20, _tp(), F.avg), full(20, _tp(), F.stddev_samp)
    upper = plan.output(1, "bb_upper", mean + 2 * spread)
    lower = plan.output(1, "bb_lower", mean - 2 * spread)
    plan.output(2, "bb_position", divide(_p() - lower, upper - lower))


def ulcer(plan: FeaturePlan) -> None:
    top = full(21, _h(), F.max)
    draw = plan.helper(1, "drawdown_sq", F.pow(divide(_p() - top, top) * 100, F.lit(2.0)))
    plan.output(2, "ulcer_index", F.sqrt(full(21, draw, F.avg)))


def mfi(plan: FeaturePlan) -> None:
    flow, move = _tp() * _v(), plan.helper(1, "tp_move", _tp() - lag(_tp()))
    up = F.when(flow.isNotNull(), F.when(move > 0, flow).otherwise(0.0))
    down = F.when(flow.isNotNull(), F.when(move < 0, flow).otherwise(0.0))
    plan.output(2, "mfi_21", 100 - 100 / (1 + divide(full(21, up, F.sum), full(21, down, F.sum))))


def cci(plan: FeaturePlan, n: int) -> None:
    """The mean deviation takes each row's distance from its own rolling mean."""
    mean = plan.helper(1, f"tp_mean_{n}", full(n, _tp(), F.avg))
    off = F.abs(_tp() - mean)
    plan.output(2, f"cci_{n}", divide(_tp() - mean, 0.015 * full(n, off, F.avg)))


def kyle_l(plan: FeaturePlan) -> None:
    """Sample covariance over population variance of return and signed log dollar volume, 21 rows."""
    ret = _ret(plan)
    dollars = _p() * _v()
    x = plan.helper(2, "signed_dollars", F.coalesce(F.signum(ret), F.lit(0.0)) * F.ln(F.when(dollars > 0, dollars)))
    w = last_rows(21)
    ready = (F.count(ret).over(w) == 21) & (F.count(x).over(w) == 21)
    flat = (F.stddev_pop(ret).over(w) == 0) | (F.stddev_pop(x).over(w) == 0)
    plan.output(3, "kyle_l", F.when(ready & ~flat, divide(F.covar_samp(ret, x).over(w), F.var_pop(x).over(w))))


def corwin_schultz(plan: FeaturePlan) -> None:
    """High-low spread; rows without a full window count as 0, as a negative alpha does."""
    log_range = F.ln(_h() / F.when(_l() > 0, _l()))
    sum5 = plan.helper(1, "range_sq_5", full(5, log_range * log_range, F.sum))
    high, low = full(5, _h(), F.max), full(5, _l(), F.min)
    g = plan.helper(1, "gamma", F.pow(F.ln(high / F.when(low > 0, low)), F.lit(2.0)))
    root = math.sqrt(2) - 1
    alpha = (root * full(21, sum5, F.avg) - g / 2) / ((math.sqrt(2) - 1) / (3 - 2 * math.sqrt(2)))
    a = plan.helper(2, "alpha", F.when(alpha >= 0, alpha).otherwise(0.0))
    plan.output(3, "corwin_schultz", 2 * (F.exp(a) - 1) / (1 + F.exp(a)))


def price_ratio(plan: FeaturePlan, n: int) -> None:
    plan.output(1, f"momentum_{n}", divide(lag(_p(), n), _p()))
    plan.output(1, f"reversal_{n}", divide(_p(), lag(_p(), n)))


def acceleration_rate(plan: FeaturePlan) -> None:
    """Ratios of moving averages of volume."""
    for a, b in ((10, 20), (10, 40), (10, 60), (20, 40), (20, 60), (40, 60)):
        plan.output(1, f"vol_acc_{a}_{b}", divide(full(a, _v(), F.avg), full(b, _v(), F.avg)))


def beta(plan: FeaturePlan, n: int) -> None:
    raise NotImplementedError("beta")


#: Features of a list of windows, and switches, in the order of their columns.
WINDOWED: dict[str, Callable[[FeaturePlan, int], None]] = {
    f.__name__: f for f in (sma, price_gap, price_vs_sma, roc, volatility, volume_sma, volume_std, vroc, turnover, cmo, max_return, cci, price_ratio, beta)
}
SWITCHES: dict[str, Callable[[FeaturePlan], None]] = {
    f.__name__: f for f in (momentum_change, obv, force_index, ultimate, awesome, bb, ulcer, mfi, kyle_l, corwin_schultz, acceleration_rate)
}


def plan_technical(plan: FeaturePlan, **features: bool | Sequence[int]) -> FeaturePlan:
    for name, value in features.items():
        if name in WINDOWED:
            for n in value or ():
                if n < 1:
                    raise ValueError(f"{name}: windows are at least 1")
                WINDOWED[name](plan, int(n))
        elif name in SWITCHES:
            if value:
                SWITCHES[name](plan)
        else:
            raise TypeError(f"unknown feature {name}")
    return plan


def technical(panel: DataFrame, **features: bool | Sequence[int]) -> DataFrame:
    if missing := [c for c in REQUIRED if c not in panel.columns]:
        raise ValueError(f"the panel lacks {missing}")
    return plan_technical(FeaturePlan(), **features).apply(panel)
