"""The panel of bars derived from line items: supplier is ticker, one bar a ship date. And the index and predictions that go with it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantpanel.functions.windows import full, lag


def bars_of(lineitem: DataFrame) -> DataFrame:
    """One aggregation, keyed by supplier and day; only eight columns are read."""
    price, day = F.col("l_extendedprice") / F.col("l_quantity"), F.to_date("l_shipdate")
    close = F.max(F.struct(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), price.alias("px")))["px"]
    return lineitem.groupBy(F.col("l_suppkey").alias("ticker"), day.alias("dates")).agg(
        F.max(price * (1 + F.col("l_tax"))).alias("px_high"),
        F.min(price * (1 - F.col("l_discount"))).alias("px_low"),
        close.alias("px_last"),
        F.sum("l_quantity").alias("px_volume"),
        F.max("l_extendedprice").alias("turnover"),
        ((F.max(F.when(F.col("l_returnflag") != "N", F.col("l_discount"))) - 0.03) * 100).alias("is_eps"),
        F.max("l_extendedprice").alias("bs_tot_asset"),
        (F.max(F.col("l_extendedprice") * F.col("l_discount")) * 20).alias("bs_total_liabilities"),
        (F.max("l_extendedprice") * 3).alias("cur_mkt_cap"),
        F.max("l_discount").alias("operating_roic"),
        F.min("l_tax").alias("wacc"),
        F.max("l_tax").alias("oper_margin"),
        F.min("l_discount").alias("sales_growth"),
        F.max("l_tax").alias("return_on_asset"),
        F.max(F.when(F.col("l_returnflag") == "R", F.col("l_discount"))).alias("tot_debt_to_tot_eqy"),
    )


def index_of(orders: DataFrame) -> DataFrame:
    top = F.max(F.struct(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("px")))["px"]
    return orders.groupBy(F.to_date("o_orderdate").alias("dates")).agg(top.alias("px_last"))


def load_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars_of(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def load_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark.read.parquet(f"{sf_dir}/orders.parquet"))


def predictions_of(bars: DataFrame) -> DataFrame:
    """(ticker, dates, q10, q50, q90) from the mean and deviation of the last 20 five-row changes."""
    roc = bars.select("ticker", "dates", ((F.col("px_last") / lag(F.col("px_last"), 5) - 1) * 100).alias("r"))
    out = roc.select("ticker", "dates", full(20, F.col("r"), F.avg).alias("q50"), full(20, F.col("r"), F.stddev_samp).alias("s"))
    return out.where("s is not null").select("ticker", "dates", (F.col("q50") - 1.2816 * F.col("s")).alias("q10"), "q50", (F.col("q50") + 1.2816 * F.col("s")).alias("q90"))
