"""Trading signals, business-day arithmetic and as-of lookups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantpanel.functions.windows import DATES, TICKER, divide

#: Two standard-normal quantiles between the 5th and 95th percentile.
Z_SPAN = 2 * 1.64485


def signal_join(predictions: DataFrame, panel: DataFrame, *columns: str) -> DataFrame:
    """Predictions with the panel's price (and the named columns) of their ticker and date; those without a price go."""
    right = panel.select(TICKER, DATES, "px_last", *columns)
    return predictions.join(right, [TICKER, DATES], "left").where(F.col("px_last").isNotNull())


def predicted_sharpe() -> Column:
    return divide(F.col("q50"), (F.col("q90") - F.col("q10")) / Z_SPAN)


def predicted_skewness() -> Column:
    width = F.col("q90") - F.col("q10")
    return F.when(width == 0, 0.0).otherwise((F.col("q90") + F.col("q10") - 2 * F.col("q50")) / F.when(width != 0, width))


def quantile_spread() -> Column:
    return F.col("q90") - F.col("q10")


def with_signals(predictions: DataFrame) -> DataFrame:
    return predictions.withColumns({"predicted_sharpe": predicted_sharpe(), "predicted_skewness": predicted_skewness(), "quantile_spread": quantile_spread()})


RULES: dict[str, Callable[[], Column]] = {
    "sharpe": lambda: predicted_sharpe() > 1,
    "skewness": lambda: predicted_skewness() > 0.1,
    "spread": lambda: (quantile_spread() > 30) & (F.col("q50") > 0),
    "floor": lambda: (F.col("q10") > -5) & (F.col("q50") > 0),
    "combined": lambda: (predicted_sharpe() > 0.5) & (predicted_skewness() > 0.05),
}


def rule_class(column: str = "predicted_class", target: int = 4) -> Column:
    return F.col(column) == target


def business_days_after(day: Column, n: Column | int) -> Column:
    """The n-th Monday-to-Friday day after `day`; n = 0 on a weekend is the Monday after. Closed form, no calendar table."""
    n = F.lit(n) if isinstance(n, int) else n
    weekday = F.weekday(day)
    base = F.date_sub(day, F.greatest(weekday - 4, F.lit(0)).cast("int"))
    start = F.least(weekday, F.lit(4))
    moved = F.date_add(base, (n + 2 * F.floor((start + n) / 5)).cast("int"))
    return F.when((n == 0) & (weekday > 4), F.date_add(day, (7 - weekday).cast("int"))).otherwise(moved)


def as_of(left: DataFrame, right: DataFrame, on: str, value: str, out: str, by: tuple[str, ...] = ()) -> DataFrame:
    """left with `out`: right's `value` of the last row at or before left's `on` (a null value counts as that row's value).

    Both sides are put in one ordered stream and the last right row is carried on: one exchange by `by`, one sort, no range join.
    A single series (no `by`) is one task's, so its left side should be distinct dates, which bounds it.
    """
    keys = [*by, on]
    a = left.select(*keys).distinct().select(*keys, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    b = right.where(F.col(on).isNotNull()).select(*keys, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    order = (Window.partitionBy(*by) if by else Window.partitionBy()).orderBy(on, "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_side") == 0, F.struct("_v")), ignorenulls=True).over(order)
    found = a.unionByName(b).withColumn("_found", last).where("_side = 1").select(*keys, F.col("_found._v").alias(out))
    return left.join(found, keys, "left")


def first_price_from(trades: DataFrame, prices: DataFrame, close: str = "expected_close", most: int = 7, until: Column | None = None) -> DataFrame:
    """trades (with a unique trade_id) with exit_date and exit_price: the first price of the ticker 0..most business days after `close`.

    Each trade is looked up at most+1 dates by equality; the nearest hit is kept by one aggregation.
    """
    tries = trades.select("trade_id", TICKER, F.col(close).alias("_close"), F.explode(F.sequence(F.lit(0), F.lit(most))).alias("_k"))
    tries = tries.withColumn(DATES, business_days_after(F.col("_close"), F.col("_k")))
    if until is not None:
        tries = tries.where(F.col(DATES) <= until)
    hits = tries.join(prices.where(F.col("px_last").isNotNull()).select(TICKER, DATES, "px_last"), [TICKER, DATES])
    best = hits.groupBy("trade_id").agg(F.min(F.struct("_k", F.col(DATES).alias("d"), "px_last")).alias("m"))
    best = best.select("trade_id", F.col("m.d").alias("exit_date"), F.col("m.px_last").alias("exit_price"))
    return trades.join(best, "trade_id", "left")
