"""Back-tests of trading rules.

Two plans give the same log. Where cash cannot bind, trades are independent and everything is relational: positions are joined to
prices on the days they are open, and daily sums accumulate over a window. Where cash may bind, one ordered pass decides which trades are
opened. `run_backtest` counts how many positions could be open at once and picks the plan.
"""

from __future__ import annotations

import math
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantpanel.functions.windows import DATES, TICKER
from quantpanel.operators.signals import as_of, business_days_after, first_price_from
from quantpanel.session import ship_package, written

LOG = f"{DATES} date, mtm_value double, cum_realized_pnl double, cash double, invested_value double, total_equity double"


def trades(signals: DataFrame, prices: DataFrame, index: DataFrame, amount: float, hold: int, most: int, excess: str | None = None) -> DataFrame:
    """One row a candidate (ticker, dates, px_last > 0): trade_id, quantity, expected_close, exit_date and profit. Repeated signals are
    candidates of their own.

    Profit is amount x excess / 100. Excess is the label where known, else the stock's return to its first price within `most` business
    days of the expected close, less the index's return as of both days; 0 where neither is known.
    """
    rows = signals.where(F.col("px_last") > 0)
    label = F.col(excess) if excess else F.lit(None).cast("double")
    rows = rows.select(TICKER, DATES, F.col("px_last").alias("entry_price"), label.cast("double").alias("label"))
    again = F.row_number().over(Window.partitionBy(TICKER, DATES).orderBy("entry_price", "label"))  # rows alike in all may swap
    rows = rows.withColumn("trade_id", F.xxhash64(TICKER, F.col(DATES).cast("string"), again))
    rows = rows.withColumn("quantity", F.lit(amount) / F.col("entry_price")).withColumn("expected_close", business_days_after(F.col(DATES), hold))
    bounds = rows.agg(F.min(DATES).alias("first"), F.max(DATES).alias("last")).first()
    if bounds is None or bounds["first"] is None:
        return rows.select("*", F.lit(None).cast("date").alias("exit_date"), F.lit(0.0).alias("profit"))
    end = business_days_after(F.lit(bounds["last"]), hold + most + 5)
    unknown = first_price_from(rows, prices, "expected_close", most, until=end)
    levels = index.select(DATES, F.col("px_last").alias("index_price"))
    unknown = as_of(unknown, levels, DATES, "index_price", "index_in")
    out_levels = levels.withColumnRenamed(DATES, "exit_date")
    unknown = as_of(unknown, out_levels, "exit_date", "index_price", "index_out")
    stock = (F.col("exit_price") / F.col("entry_price") - 1) * 100
    market = (F.col("index_out") / F.when(F.col("index_in") != 0, F.col("index_in")) - 1) * 100
    gain = F.coalesce(F.col("label"), stock - market, F.lit(0.0))
    return unknown.withColumn("profit", F.lit(amount) * gain / 100).select(*rows.columns, "exit_date", "profit")


def simulation_dates(candidates: DataFrame, prices: DataFrame, hold: int, most: int) -> DataFrame:
    """The distinct dates of candidates and prices, from the first candidate to the last one's latest possible close."""
    bounds = candidates.agg(F.min(DATES).alias("a"), F.max(DATES).alias("b"))
    end = business_days_after(F.col("b"), hold + most + 5)
    every = candidates.select(DATES).union(prices.select(DATES)).distinct()
    return every.join(F.broadcast(bounds)).where((F.col(DATES) >= F.col("a")) & (F.col(DATES) <= end)).select(DATES)


def unconstrained(rows: DataFrame, prices: DataFrame, dates: DataFrame, capital: float, amount: float) -> DataFrame:
    """The log where every candidate is opened. Work: one row a trade and day held."""
    calendar = F.broadcast(dates)  # one row a trading day
    closes = dates.select(F.col(DATES).alias("close_date"))
    ends = rows.select("expected_close").distinct().join(F.broadcast(closes), F.col("close_date") >= F.col("expected_close")).groupBy("expected_close").agg(F.min("close_date").alias("closed"))
    rows = rows.join(F.broadcast(ends), "expected_close", "left")
    opened = rows.groupBy(DATES).agg(F.count(F.lit(1)).alias("n_in"))
    closed = rows.where(F.col("closed").isNotNull()).groupBy(F.col("closed").alias(DATES)).agg(F.count(F.lit(1)).alias("n_out"), F.sum("profit").alias("profit"))
    # the days held are laid out a trade and kept where the calendar has them: no comparison of every trade with every day
    stop = F.coalesce(F.date_sub("closed", 1), F.col("_last"))
    held = rows.join(F.broadcast(dates.agg(F.max(DATES).alias("_last")))).where(stop >= F.col(DATES))
    held = held.select(TICKER, F.explode(F.sequence(F.col(DATES), stop)).alias("d"), "quantity").withColumnRenamed("d", DATES)
    held = held.join(calendar, DATES, "left_semi")
    held = held.join(prices.select(TICKER, DATES, "px_last"), [TICKER, DATES], "left")
    worth = held.groupBy(DATES).agg(F.sum(F.coalesce(F.col("quantity") * F.col("px_last"), F.lit(float(amount)))).alias("worth"))
    so_far = Window.orderBy(DATES).rowsBetween(Window.unboundedPreceding, 0)  # a row a day
    log = dates.join(opened, DATES, "left").join(closed, DATES, "left").join(worth, DATES, "left").na.fill(0)
    log = log.withColumn("pnl", F.sum("profit").over(so_far)).withColumn("open", F.sum(F.col("n_in") - F.col("n_out")).over(so_far))
    cash = F.lit(float(capital)) + F.col("pnl") - F.col("open") * float(amount)
    return log.select(
        DATES, (cash + F.col("worth")).alias("mtm_value"), F.col("pnl").alias("cum_realized_pnl"), cash.alias("cash"),
        (F.col("open") * float(amount)).alias("invested_value"), (F.lit(float(capital)) + F.col("pnl")).alias("total_equity"),
    )


def constrained(rows: DataFrame, prices: DataFrame, dates: DataFrame, capital: float, amount: float) -> DataFrame:
    """The log where a candidate is opened only while cash lasts, by date and ticker. Sequential by nature: one ordered pass over the
    candidates (a few numbers each) decides; marking to market stays relational."""
    ship_package(rows.sparkSession)

    def decide(g: pd.DataFrame) -> pd.DataFrame:
        days = sorted(set(g.loc[g.kind == "day", DATES]))
        wanted = deque(sorted(g.loc[g.kind == "trade", [DATES, TICKER, "trade_id", "expected_close", "profit"]].itertuples(index=False, name=None)))
        cash, held, taken = float(capital), [], []
        for day in days:
            still = []
            for close, profit in held:
                if day >= close:
                    cash += amount + profit
                else:
                    still.append((close, profit))
            held = still
            while wanted and wanted[0][0] <= day:
                when, _, trade, close, profit = wanted.popleft()
                if when == day and cash >= amount:
                    cash -= amount
                    held.append((close, profit))
                    taken.append(trade)
        return pd.DataFrame({"trade_id": pd.Series(taken, dtype="int64")})

    day_rows = dates.select(F.lit("day").alias("kind"), DATES, F.lit(None).cast(rows.schema[TICKER].dataType).alias(TICKER), F.lit(0).cast("long").alias("trade_id"), F.lit(None).cast("date").alias("expected_close"), F.lit(0.0).alias("profit"))
    trade_rows = rows.select(F.lit("trade").alias("kind"), DATES, TICKER, "trade_id", "expected_close", "profit")
    taken = day_rows.unionByName(trade_rows).withColumn("one", F.lit(1)).groupBy("one").applyInPandas(lambda g: decide(g), "trade_id long")
    return unconstrained(rows.join(taken, "trade_id", "left_semi"), prices, dates, capital, amount)


def most_open(rows: DataFrame) -> int:
    """The largest number of candidates between entry and expected close on any day."""
    steps = rows.select(F.col(DATES).alias("d"), F.lit(1).alias("n")).union(rows.select("expected_close", F.lit(-1)))
    daily = steps.groupBy("d").agg(F.sum("n").alias("n"))  # closes come before opens of a day
    running = F.sum("n").over(Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0))
    opened = rows.groupBy(F.col(DATES).alias("d")).agg(F.count(F.lit(1)).alias("o"))
    top = daily.withColumn("r", running).join(opened, "d", "left").agg(F.max("r")).first()[0]
    return int(top or 0)


def run_backtest(
    signals: DataFrame, prices: DataFrame, index: DataFrame, capital: float = 1e9, amount: float = 1e6, hold: int = 20, most: int = 5, excess: str | None = None, plan: str = "auto"
) -> DataFrame:
    """(dates, mtm_value, cum_realized_pnl, cash, invested_value, total_equity), a row a simulated date. signals: the candidates that a
    rule has chosen, with px_last. No candidates: no rows. plan: auto, unconstrained or constrained.

    A position due on a day without trading is closed on the next simulated date, so it may be open longer than planned; auto allows
    for that, and for losses, with a margin: the relational plan is taken only where half the capital would do.
    """
    rows = written(trades(signals, prices, index, amount, hold, most, excess))  # used several times
    dates = simulation_dates(rows, prices, hold, most)
    if plan == "auto":
        plan = "unconstrained" if most_open(rows) * amount * 2 <= capital else "constrained"
    return {"unconstrained": unconstrained, "constrained": constrained}[plan](rows, prices, dates, capital, amount)


def benchmark(log: DataFrame, index: DataFrame, capital: float) -> DataFrame:
    """(dates, index_value): the index carried on to the log's dates, worth `capital` at the first date that has a level."""
    levels = as_of(log.select(DATES), index.select(DATES, "px_last"), DATES, "px_last", "level")
    first = F.first(F.when(F.col("level") != 0, F.col("level")), ignorenulls=True).over(Window.orderBy(DATES).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return levels.select(DATES, (F.lit(float(capital)) * F.col("level") / first).alias("index_value"))


def sharpe_like(log: DataFrame) -> float | None:
    """Mean over deviation of the daily changes of the marked value."""
    change = F.col("mtm_value") / F.lag("mtm_value").over(Window.orderBy(DATES)) - 1
    row = log.select(change.alias("c")).agg(F.avg("c").alias("m"), F.stddev_samp("c").alias("s")).first()
    return row["m"] / row["s"] if row and row["s"] and not math.isnan(row["s"]) else None
