"""Fundamental ratios. All are projections but the price-earnings band (a rolling percentile) and earnings growth (a lag)."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantpanel.functions.windows import divide, lag, last_rows
from quantpanel.plans.stages import FeaturePlan

REQUIRED = (
    "px_last", "is_eps", "bs_tot_asset", "bs_total_liabilities", "cur_mkt_cap", "operating_roic", "wacc", "oper_margin", "sales_growth",
    "return_on_asset", "tot_debt_to_tot_eqy",
)
c = F.col


def _equity() -> Column:
    return c("bs_tot_asset") - c("bs_total_liabilities")


def _pe() -> Column:
    return F.when(c("is_eps") > 0, c("px_last") / c("is_eps"))


def _eps_growth() -> Column:
    before = lag(c("is_eps"))
    return F.when(before > 0, (c("is_eps") - before) / before)


RATIOS: dict[str, Callable[[], Column]] = {
    "pe_ratio": _pe,
    "earnings_yield": lambda: divide(c("is_eps"), c("px_last")),
    "debt_to_assets": lambda: divide(c("bs_total_liabilities"), c("bs_tot_asset")),
    "debt_to_capital": lambda: divide(c("bs_total_liabilities"), c("bs_total_liabilities") + _equity()),
    "equity_ratio": lambda: divide(_equity(), c("bs_tot_asset")),
    "market_to_book": lambda: F.when(_equity() > 0, c("cur_mkt_cap") / _equity()),
    "adjusted_roic": lambda: c("operating_roic") - c("wacc"),
    "operating_efficiency": lambda: c("oper_margin") * c("sales_growth"),
    "levered_roa": lambda: c("return_on_asset") * (1 + F.coalesce(c("tot_debt_to_tot_eqy"), F.lit(0.0))),
    "eps_growth": _eps_growth,
}


def plan_fundamental(plan: FeaturePlan, pe_band: tuple[Sequence[int], Sequence[float]] | None = None, **ratios: bool) -> FeaturePlan:
    for name, wanted in ratios.items():
        if name not in RATIOS:
            raise TypeError(f"unknown feature {name}")
        if wanted:
            plan.output(1, name, RATIOS[name]())
    if pe_band:
        pe = plan.helper(1, "pe", _pe())
        for n in pe_band[0]:
            for q in pe_band[1]:
                if not 0 <= q <= 100:
                    warnings.warn(f"pe_band: percentile {q} is outside 0..100 and left out", UserWarning, stacklevel=2)
                    continue
                # one value is enough: the band exists where any of the rows has a ratio
                plan.output(2, f"pe_band_{n}_{q}", F.percentile(pe, F.lit(q / 100)).over(last_rows(n)))
    return plan


def fundamental(panel: DataFrame, pe_band: tuple[Sequence[int], Sequence[float]] | None = None, **ratios: bool) -> DataFrame:
    if missing := [x for x in REQUIRED if x not in panel.columns]:
        raise ValueError(f"the panel lacks {missing}")
    return plan_fundamental(FeaturePlan(), pe_band, **ratios).apply(panel)
