"""Cleaning, profiling and the small relational operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantpanel.functions.windows import DATES, TICKER, so_far

FILLED = (
    "total_equity", "book_val_per_sh", "revenue_per_sh", "return_com_eqy", "tot_debt_to_tot_asset", "tot_debt_to_tot_eqy", "bs_tot_liab2", "bs_tot_asset", "is_eps",
)


def forward_fill(panel: DataFrame, columns: Sequence[str] = FILLED) -> DataFrame:
    """The last known value of each column within the ticker; columns that the panel lacks are left out."""
    present = [c for c in columns if c in panel.columns]
    return panel.withColumns({c: F.last(c, ignorenulls=True).over(so_far()) for c in present})


def drop_columns(panel: DataFrame, *columns: str) -> DataFrame:
    """Names that are missing are no error."""
    return panel.drop(*columns)


def drop_dividends(panel: DataFrame) -> DataFrame:
    return panel.drop("dvd_sh_12m")


def numeric(panel: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text to double; what is no number (such as '#NAME?') becomes null, as infinities and NaN do."""
    def clean(c: str):
        x = F.expr(f"try_cast(`{c}` as double)")
        return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)

    return panel.withColumns({c: clean(c) for c in columns})


def drop_empty_rows(panel: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return panel.na.drop("all", subset=list(columns) if columns else None)


def drop_empty_columns(panel: DataFrame) -> DataFrame:
    """One aggregation counts all columns; one row comes back."""
    counts = panel.agg(*(F.count(F.col(f"`{c}`")).alias(c) for c in panel.columns)).first()
    return panel.drop(*(c for c in panel.columns if not counts[c]))


def null_profile(panel: DataFrame) -> DataFrame:
    """(column_name, nulls, ratio), one pass over the table."""
    total = F.count(F.lit(1))
    pairs = [F.struct(F.lit(c).alias("column_name"), F.sum(F.col(f"`{c}`").isNull().cast("long")).alias("nulls"), total.alias("n")) for c in panel.columns]
    out = panel.agg(F.array(*pairs).alias("all")).select(F.inline("all"))
    return out.select("column_name", F.coalesce("nulls", F.lit(0)).alias("nulls"), F.when(F.col("n") > 0, F.col("nulls") / F.col("n")).alias("ratio"))


def drop_sparse_columns(train: DataFrame, test: DataFrame, most: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Columns that are null in more than `most` of the training rows are dropped from both."""
    ratios = train.agg(*(F.avg(F.col(f"`{c}`").isNull().cast("double")).alias(c) for c in train.columns)).first()
    gone = [c for c in train.columns if (ratios[c] or 0) > most]
    return train.drop(*gone), test.drop(*gone)


def drop_missing(panel: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    return panel.na.drop("any", subset=list(columns) if columns else None)


def value_counts(panel: DataFrame, column: str) -> DataFrame:
    """(value, n), nulls too."""
    return panel.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def date_slice(panel: DataFrame, first: str, last: str) -> DataFrame:
    """Both ends included; reaches the scan as a pushed filter."""
    return panel.where(F.col(DATES).between(F.lit(first).cast("date"), F.lit(last).cast("date")))


def distinct_dates(*panels: DataFrame) -> DataFrame:
    out = panels[0].select(DATES)
    for p in panels[1:]:
        out = out.union(p.select(DATES))
    return out.distinct()


def common_tickers(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(TICKER).intersect(b.select(TICKER))


def union_panels(a: DataFrame, b: DataFrame) -> DataFrame:
    """Union by name; columns that one side lacks are null there."""
    return a.unionByName(b, allowMissingColumns=True)


def newest(panel: DataFrame, n: int, *ties: str) -> DataFrame:
    """The last n rows by date (a top-k, no sort of the whole)."""
    return panel.orderBy(F.col(DATES).desc(), *ties).limit(n)


def first_ticker_ordinal(names: DataFrame) -> DataFrame:
    """(ticker, ordinal): text before the first white space, lowest ordinal of each name."""
    clean = names.withColumn(TICKER, F.regexp_replace(TICKER, r"\s.*", ""))
    rank = F.row_number().over(Window.partitionBy(TICKER).orderBy("ordinal"))
    return clean.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
