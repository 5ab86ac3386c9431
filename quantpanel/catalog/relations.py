"""Queries of the relational operators: sources, cleaning, labels, folds, models, signals and back-tests."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantpanel.catalog import sql as q
from quantpanel.catalog.features import rounded
from quantpanel.operators import backtest, cleaning, labels, modelling, partitioning, signals
from quantpanel.operators.technical import technical
from quantpanel.session import scratch, written
from quantpanel.sources import files
from quantpanel.sources.bars import load_bars, load_index, predictions_of
from quantpanel.streaming.bars import event_bars

Query = Callable[[SparkSession, str], DataFrame]
RELATIONS: dict[str, tuple[Query, str | None]] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        RELATIONS[f.__name__] = f, sql
        return f

    return add


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


@register(_with(q.BARS) + "SELECT * FROM bars")
def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_bars(spark, sf_dir)


@register(_with(q.INDEX) + "SELECT * FROM idx")
def market_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_index(spark, sf_dir)


@register(_with(q.BARS) + f"SELECT ticker, dates, {q.running('last_value(tot_debt_to_tot_eqy IGNORE NULLS)')} AS tot_debt_to_tot_eqy, {q.running('last_value(is_eps IGNORE NULLS)')} AS is_eps FROM bars")
def forward_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.forward_fill(load_bars(spark, sf_dir)).select("ticker", "dates", "tot_debt_to_tot_eqy", "is_eps")


@register("SELECT DISTINCT l_suppkey AS ticker FROM lineitem WHERE l_shipdate < DATE '1998-01-01' INTERSECT SELECT l_suppkey FROM lineitem WHERE l_shipdate >= DATE '1998-01-01'")
def common_tickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = load_bars(spark, sf_dir)
    return cleaning.common_tickers(b.where("dates < '1998-01-01'"), b.where("dates >= '1998-01-01'"))


@register("SELECT DISTINCT cast(l_shipdate AS date) AS dates FROM lineitem UNION SELECT DISTINCT cast(o_orderdate AS date) FROM orders")
def distinct_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.distinct_dates(load_bars(spark, sf_dir), load_index(spark, sf_dir))


@register(_with(q.BARS) + "SELECT ticker, dates, px_last FROM bars WHERE dates BETWEEN DATE '1995-01-01' AND DATE '1995-12-31'")
def date_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.date_slice(load_bars(spark, sf_dir), "1995-01-01", "1995-12-31").select("ticker", "dates", "px_last")


@register(_with(q.BARS) + "SELECT ticker, dates, px_last, is_eps FROM bars WHERE is_eps IS NOT NULL AND tot_debt_to_tot_eqy IS NOT NULL")
def drop_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.drop_missing(load_bars(spark, sf_dir)).select("ticker", "dates", "px_last", "is_eps")


@register(
    _with(q.BARS)
    + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE {c} IS NULL) AS nulls, round(avg(CASE WHEN {c} IS NULL THEN 1E0 ELSE 0 END), 9) AS ratio FROM bars" for c in ("ticker", "dates", "px_last", "is_eps", "tot_debt_to_tot_eqy"))
)
def null_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = load_bars(spark, sf_dir).select("ticker", "dates", "px_last", "is_eps", "tot_debt_to_tot_eqy")
    return cleaning.null_profile(b).withColumn("ratio", F.round("ratio", 9))


@register(_with(q.BARS) + "SELECT operating_roic AS value, count(*) AS n FROM bars GROUP BY 1")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.value_counts(load_bars(spark, sf_dir), "operating_roic")


@register(_with(q.BARS) + "SELECT ticker, dates, px_last FROM bars ORDER BY dates DESC, ticker LIMIT 25")
def newest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.newest(load_bars(spark, sf_dir).select("ticker", "dates", "px_last"), 25, "ticker")


@register(_with(q.BARS) + "SELECT ticker, dates, px_last, CASE WHEN dates < DATE '1998-01-01' THEN is_eps END AS is_eps FROM bars")
def union_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = load_bars(spark, sf_dir).select("ticker", "dates", "px_last", "is_eps")
    return cleaning.union_panels(b.where("dates < '1998-01-01'"), b.where("dates >= '1998-01-01'").drop("is_eps"))


@register(_with(q.BARS) + "SELECT ticker, dates, px_last, is_eps FROM bars WHERE dates >= DATE '1996-01-01'")
def drop_sparse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = load_bars(spark, sf_dir).select("ticker", "dates", "px_last", "is_eps", "tot_debt_to_tot_eqy")
    return cleaning.drop_sparse_columns(b.where("dates < '1996-01-01'"), b.where("dates >= '1996-01-01'"))[1]


@register("SELECT p_partkey, p_size FROM part")
def drop_empty_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column that is null in every row goes, one that is null in most of them stays."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    return cleaning.drop_empty_columns(part.withColumn("p_none", F.when(F.col("p_size") < 0, 1)))


@register(_with(q.BARS) + "SELECT ticker, dates, px_last FROM bars")
def drop_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named columns go, unknown names are passed over; the dividends column goes."""
    b = load_bars(spark, sf_dir).select("ticker", "dates", "px_last", "is_eps", F.col("turnover").alias("dvd_sh_12m"))
    return cleaning.drop_dividends(cleaning.drop_columns(b, "is_eps", "no_such_column"))


@register(_with(q.BARS) + "SELECT ticker, dates, CASE WHEN cast(round(operating_roic * 100) AS integer) % 3 > 0 THEN px_last END AS px_last FROM bars")
def numeric_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers as text, among them the vendor's sentinel and other text that is no number."""
    bad = F.round(F.col("operating_roic") * 100).cast("int")
    text = F.when(bad % 3 > 0, F.col("px_last").cast("string")).when(bad % 2 == 0, "#NAME?").otherwise("Infinity")
    return cleaning.numeric(load_bars(spark, sf_dir).select("ticker", "dates", text.alias("px_last")), ["px_last"])


@register("SELECT split_part(s_name, ' ', 1) AS ticker, min(s_suppkey) AS ordinal FROM supplier GROUP BY 1")
def ticker_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_name").alias("ticker"), F.col("s_suppkey").alias("ordinal"))
    return cleaning.first_ticker_ordinal(names)


# ------------------------------------------------------------------ files


@register(_with(q.BARS) + "SELECT cast(ticker AS varchar) AS ticker, dates, px_last, px_volume FROM bars WHERE cast(ticker AS varchar) <> (SELECT min(cast(ticker AS varchar)) FROM bars)")
def wide_panel_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written in the vendor's layout and read back; the first block is left out."""
    path = scratch(spark)
    files.write_wide_panel(load_bars(spark, sf_dir), path)
    return files.read_wide_panel(spark, path)


_TO_WINDOW = "SELECT cast(ticker AS varchar) AS ticker, dates, round(q10, 6) + 0.0 AS q10, round(q50, 6) + 0.0 AS q50, round(q90, 6) + 0.0 AS q90, cast(year(dates) AS integer) AS window_id FROM pred"


@register(_with(q.BARS, f"roc AS (SELECT ticker, dates, px_last, (px_last / {q.lag('px_last', 5)} - 1) * 100 AS r FROM bars)", f"st AS (SELECT ticker, dates, {q.avg(20, 'r')} AS q50, {q.full(20, 'stddev_samp({})', 'r')} AS s FROM roc)", "pred AS (SELECT ticker, dates, q50 - 1.2816E0 * s AS q10, q50, q50 + 1.2816E0 * s AS q90 FROM st WHERE s IS NOT NULL)") + _TO_WINDOW)
def prediction_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written a folder a window and read back."""
    path = scratch(spark)
    made = predictions_of(load_bars(spark, sf_dir)).withColumn("window_id", F.year("dates")).withColumn("ticker", F.col("ticker").cast("string"))
    files.write_predictions(rounded(made, {"q10": 6, "q50": 6, "q90": 6}, ("ticker", "dates", "window_id")), path)
    return spark.read.schema("ticker string, dates date, q10 double, q50 double, q90 double, window_id int").parquet(path)


@register(_with(q.BARS) + "SELECT cast(ticker AS varchar) AS ticker, dates, px_last, is_eps FROM bars")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    files.write_csv(load_bars(spark, sf_dir).select("ticker", "dates", "px_last", "is_eps"), path)
    return files.read_predictions(spark, path)


@register(_with(q.INDEX) + "SELECT dates, px_last FROM idx")
def index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    files.write_csv(load_index(spark, sf_dir).select(F.col("dates").alias("Dates"), F.col("px_last").alias("PX_LAST")), path)
    return files.read_index(spark, path)


@register(_with(q.INDEX) + "SELECT dates, px_last FROM idx WHERE day(dates) > 1")
def tolerant_index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments, padded names in capitals, two-digit years in one half of the lines, and lines without a date or a price."""
    path = scratch(spark)
    date = F.when(F.month("dates") % 2 == 0, F.date_format("dates", "d.M.yy")).otherwise(F.date_format("dates", "yyyy-MM-dd"))
    price = F.when(F.day("dates") == 1, F.lit("")).otherwise(F.format_string(" %s ", F.col("px_last").cast("string")))
    lines = load_index(spark, sf_dir).select(F.concat(date, F.lit(","), price).alias("value")).unionByName(spark.createDataFrame([("# a note",), ("no date,5",)], "value string"))
    head = spark.createDataFrame([("# made by hand",), ("  DATES , Px_Last",)], "value string")
    head.coalesce(1).unionByName(lines.coalesce(1)).coalesce(1).write.text(path)
    return files.read_index_tolerant(spark, path)


# ------------------------------------------------------------------ labels

DAYS = 20
_EXCESS = [
    q.BARS,
    q.INDEX,
    f"fwd AS (SELECT dates, (lead(px_last, {DAYS}) OVER (ORDER BY dates) / nullif(px_last, 0) - 1) * 100 AS index_returns_20 FROM idx)",
    f"ret AS (SELECT ticker, dates, px_last, (lead(px_last, {DAYS}) OVER ({q.SERIES}) / nullif(px_last, 0) - 1) * 100 AS eq_returns_20 FROM bars)",
    "ex AS (SELECT r.*, f.index_returns_20, r.eq_returns_20 - f.index_returns_20 AS excess_returns_20 FROM ret r LEFT JOIN fwd f ON r.dates = f.dates)",
]


def _excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = load_bars(spark, sf_dir).select("ticker", "dates", "px_last")
    return labels.excess_returns(panel, load_index(spark, sf_dir), DAYS)


@register(_with(*_EXCESS) + "SELECT ticker, dates, " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in ("eq_returns_20", "index_returns_20", "excess_returns_20")) + " FROM ex")
def excess_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_excess(spark, sf_dir), {"eq_returns_20": 4, "index_returns_20": 4, "excess_returns_20": 4})


_BINARY = "SELECT ticker, dates, CASE WHEN excess_returns_20 IS NULL THEN NULL WHEN excess_returns_20 >= bar THEN 1 ELSE 0 END AS label FROM "


@register(_with(*_EXCESS) + _BINARY + "(SELECT *, quantile_cont(excess_returns_20, 0.75) OVER (PARTITION BY dates) AS bar FROM ex)")
def binary_label_by_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.binary_label(_excess(spark, sf_dir), "excess_returns_20", 0.75).select("ticker", "dates", "label")


@register(_with(*_EXCESS) + _BINARY + "(SELECT ex.*, b.bar FROM ex, (SELECT quantile_cont(excess_returns_20, 0.75) AS bar FROM ex) b)")
def binary_label_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.binary_label(_excess(spark, sf_dir), "excess_returns_20", 0.75, per_date=False).select("ticker", "dates", "label")


@register(
    _with(*_EXCESS, "e AS (SELECT *, list_sort(list_distinct(quantile_cont(excess_returns_20, [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]) OVER (PARTITION BY dates))) AS edges FROM ex)",
          "b AS (SELECT *, CASE WHEN excess_returns_20 IS NOT NULL AND len(edges) > 1 THEN greatest(0, len(list_filter(edges, lambda v: v < excess_returns_20)) - 1) END AS bin FROM e)")
    + "SELECT ticker, dates, cast(max(bin) OVER (PARTITION BY dates) + 1 - bin AS integer) AS label FROM b"
)
def nary_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.nary_label(_excess(spark, sf_dir), "excess_returns_20", 5).select("ticker", "dates", F.col("label").cast("int"))


@register()
def regime_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.regime_label(load_bars(spark, sf_dir).select("ticker", "dates"), load_index(spark, sf_dir))


# ------------------------------------------------------------------ folds


def _fold_sql(place: str, total: str, size: str, most: int, gap: int) -> str:
    parts = f"placed AS (SELECT ticker, dates, {place} AS p, {total} AS n FROM bars), folds AS (SELECT *, {size} AS size, unnest(range(5)) AS fold FROM placed), "
    parts += f"cut AS (SELECT *, n - (5 - fold) * size AS test_start FROM folds WHERE size > 0 AND n - 5 * size - {gap} > 0), "
    parts += f"named AS (SELECT *, CASE WHEN p >= test_start AND p < test_start + size THEN 'test' WHEN p < test_start - {gap} AND p >= test_start - {gap} - {most} THEN 'train' END AS role FROM cut)"
    return _with(q.BARS, parts) + "SELECT ticker, dates, cast(fold AS integer) AS fold, role FROM named WHERE role IS NOT NULL"


@register(_fold_sql(f"row_number() OVER ({q.SERIES}) - 1", "count(*) OVER (PARTITION BY ticker)", "60", 504, 2))
def purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = load_bars(spark, sf_dir).select("ticker", "dates")
    return partitioning.purged_folds(panel, 5, 504, 60, 2)


@register(_fold_sql(f"dense_rank() OVER ({q.SERIES}) - 1", "count(*) OVER (PARTITION BY ticker)", "n // 6", 10_000_000, 3))
def purged_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = load_bars(spark, sf_dir).select("ticker", "dates")
    return partitioning.purged_group_folds(panel, 5, gap=3)


@register(
    _with(*_EXCESS, "bars2 AS (SELECT ticker, dates, px_last FROM bars)")
    + "SELECT ticker, dates, fold, role, CASE WHEN x IS NULL THEN NULL WHEN x >= quantile_cont(x, 0.75) OVER (PARTITION BY fold, role, dates) THEN 1 ELSE 0 END AS label FROM ("
    f"SELECT f.*, e - index_returns_20 AS x FROM (SELECT ticker, dates, fold, role, (lead(px_last, {DAYS}) OVER (PARTITION BY ticker, fold, role ORDER BY dates) / nullif(px_last, 0) - 1) * 100 AS e FROM ("
    "SELECT ticker, dates, px_last, cast(fold AS integer) AS fold, CASE WHEN p >= n - (5 - fold) * 60 AND p < n - (5 - fold) * 60 + 60 THEN 'test' WHEN p < n - (5 - fold) * 60 - 2 AND p >= n - (5 - fold) * 60 - 506 THEN 'train' END AS role "
    f"FROM (SELECT *, row_number() OVER ({q.SERIES}) - 1 AS p, count(*) OVER (PARTITION BY ticker) AS n, unnest(range(5)) AS fold FROM bars2) WHERE n > 302) WHERE role IS NOT NULL) f LEFT JOIN fwd ON fwd.dates = f.dates)"
)
def label_per_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excess returns and labels worked out inside each fold and role: no return reaches over a fold's border."""
    folds = partitioning.purged_folds(load_bars(spark, sf_dir).select("ticker", "dates", "px_last"), 5, 504, 60, 2)
    out = labels.excess_to_labels(folds, load_index(spark, sf_dir), DAYS, quantile=0.75, keys=("ticker", "fold", "role"))
    return out.select("ticker", "dates", "fold", "role", "label")


N_TRAIN, N_VALID = 2, 1


@register(
    _with(
        q.BARS,
        "d AS (SELECT dates, row_number() OVER (ORDER BY dates) - 1 AS place FROM (SELECT DISTINCT dates FROM bars))",
        "p AS (SELECT b.ticker, d.place FROM bars b JOIN d ON b.dates = d.dates)",
        f"hits AS (SELECT ticker, w, count(*) FILTER (WHERE place < w) AS n_train, count(*) FILTER (WHERE place >= w) AS n_test FROM (SELECT ticker, place, unnest(range(place - {N_VALID} + 1, place + {N_TRAIN} + 1)) AS w FROM p) GROUP BY ticker, w)",
    )
    + f"SELECT cast(w AS integer) AS window_id, ticker FROM hits WHERE n_train = {N_TRAIN} AND n_test = {N_VALID} AND w >= {N_TRAIN} AND w <= (SELECT count(*) FROM d) - {N_VALID}"
)
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitioning.walk_forward(load_bars(spark, sf_dir), N_TRAIN, N_VALID)


@register(
    _with(*_EXCESS, "e AS (SELECT ticker, dates, excess_returns_20 FROM ex)", "bars2 AS (SELECT * FROM e)")
    + "SELECT fold, role, count(*) AS n_rows, round(avg(x), 6) + 0.0 AS avg_excess FROM (SELECT cast(fold AS integer) AS fold, excess_returns_20 AS x, "
    "CASE WHEN p >= n - (5 - fold) * 60 AND p < n - (5 - fold) * 60 + 60 THEN 'test' WHEN p < n - (5 - fold) * 60 - 2 AND p >= n - (5 - fold) * 60 - 506 THEN 'train' END AS role "
    f"FROM (SELECT *, row_number() OVER ({q.SERIES}) - 1 AS p, count(*) OVER (PARTITION BY ticker) AS n, unnest(range(5)) AS fold FROM bars2) WHERE n > 302) WHERE role IS NOT NULL GROUP BY fold, role"
)
def features_to_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars, features, excess returns and purged folds end to end."""
    panel = technical(load_bars(spark, sf_dir), sma=[20], roc=[10], volatility=[20])
    folds = partitioning.purged_folds(labels.excess_returns(panel, load_index(spark, sf_dir), DAYS), 5, 504, 60, 2)
    return folds.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n_rows"), (F.round(F.avg("excess_returns_20"), 6) + F.lit(0.0)).alias("avg_excess"))


# ------------------------------------------------------------------ signals

_PRED = [
    q.BARS,
    f"roc AS (SELECT ticker, dates, px_last, (px_last / {q.lag('px_last', 5)} - 1) * 100 AS r FROM bars)",
    f"st AS (SELECT ticker, dates, px_last, {q.avg(20, 'r')} AS q50, {q.full(20, 'stddev_samp({})', 'r')} AS s FROM roc)",
    "pred AS (SELECT ticker, dates, px_last, q50 - 1.2816E0 * s AS q10, q50, q50 + 1.2816E0 * s AS q90 FROM st WHERE s IS NOT NULL)",
    "sig AS (SELECT *, q50 / nullif((q90 - q10) / (2 * 1.64485E0), 0) AS predicted_sharpe, CASE WHEN q90 = q10 THEN 0 ELSE (q90 + q10 - 2 * q50) / (q90 - q10) END AS predicted_skewness, q90 - q10 AS quantile_spread FROM pred)",
]


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = load_bars(spark, sf_dir)
    return signals.with_signals(signals.signal_join(predictions_of(b), b))


@register(_with(*_PRED) + "SELECT ticker, dates, px_last, round(predicted_sharpe, 5) + 0.0 AS predicted_sharpe, round(predicted_skewness, 5) + 0.0 AS predicted_skewness, round(quantile_spread, 4) + 0.0 AS quantile_spread FROM sig")
def quantile_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_signals(spark, sf_dir), {"px_last": None, "predicted_sharpe": 5, "predicted_skewness": 5, "quantile_spread": 4})


@register(
    _with(*_PRED)
    + "SELECT count(*) FILTER (WHERE predicted_sharpe > 0.2) AS sharpe, count(*) FILTER (WHERE quantile_spread > 30 AND q50 > 0) AS spread, count(*) FILTER (WHERE q10 > -5 AND q50 > 0) AS floor FROM sig"
)
def signal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda c, n: F.count(F.when(c, 1)).alias(n)
    rules = signals.RULES
    return _signals(spark, sf_dir).agg(count(signals.predicted_sharpe() > 0.2, "sharpe"), count(rules["spread"](), "spread"), count(rules["floor"](), "floor"))


@register(
    _with(*_PRED, f"cls AS (SELECT *, row_number() OVER ({q.SERIES}) % 5 AS predicted_class FROM sig)")
    + "SELECT count(*) FILTER (WHERE predicted_sharpe > 1) AS sharpe, count(*) FILTER (WHERE predicted_skewness > 0.1) AS skewness, count(*) FILTER (WHERE quantile_spread > 30 AND q50 > 0) AS spread, count(*) FILTER (WHERE q10 > -5 AND q50 > 0) AS floor, "
    "count(*) FILTER (WHERE predicted_sharpe > 0.5 AND predicted_skewness > 0.05) AS combined, count(*) FILTER (WHERE predicted_class = 4) AS class FROM cls"
)
def all_signal_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule at its own threshold; the class is a row's place in its ticker, modulo 5."""
    place = F.row_number().over(Window.partitionBy("ticker").orderBy("dates"))
    rules = {name: rule() for name, rule in signals.RULES.items()} | {"class": signals.rule_class()}
    return _signals(spark, sf_dir).withColumn("predicted_class", place % 5).agg(*(F.count(F.when(c, 1)).alias(n) for n, c in rules.items()))


@register(
    "WITH d AS (SELECT DISTINCT cast(l_shipdate AS date) AS dates FROM lineitem), days AS (SELECT cast(range AS date) AS day FROM range(DATE '1990-01-01', DATE '2002-01-01', INTERVAL 1 DAY) WHERE isodow(range) <= 5), "
    "r AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM days), base AS (SELECT d.dates, max(r.i) AS i FROM d JOIN r ON r.day <= d.dates GROUP BY d.dates) "
    "SELECT b.dates, x.day AS after_20, y.day AS after_1 FROM base b JOIN r x ON x.i = b.i + 20 JOIN r y ON y.i = b.i + 1"
)
def business_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load_bars(spark, sf_dir).select("dates").distinct()
    return d.select("dates", signals.business_days_after(F.col("dates"), 20).alias("after_20"), signals.business_days_after(F.col("dates"), 1).alias("after_1"))


@register(_with(q.BARS, q.INDEX) + "SELECT b.ticker, b.dates, i.px_last AS index_price FROM bars b ASOF LEFT JOIN idx i ON b.dates >= i.dates")
def as_of_index_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.as_of(load_bars(spark, sf_dir).select("ticker", "dates"), load_index(spark, sf_dir), "dates", "px_last", "index_price")


@register(
    _with(q.BARS, "shifted AS (SELECT ticker, dates, dates + 7 AS due FROM bars)", "hit AS (SELECT s.ticker, s.dates, min(b.dates) AS exit_date FROM shifted s JOIN bars b ON b.ticker = s.ticker AND b.dates >= s.due AND b.dates <= s.due + 7 AND isodow(b.dates) <= 5 WHERE isodow(s.due) <= 5 GROUP BY 1, 2)")
    + "SELECT h.ticker, h.dates, h.exit_date, b.px_last AS exit_price FROM hit h JOIN bars b ON b.ticker = h.ticker AND b.dates = h.exit_date"
)
def first_price_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Within five business days of a weekday one week on."""
    b = load_bars(spark, sf_dir)
    due = b.select("ticker", "dates", F.date_add("dates", 7).alias("expected_close"), F.xxhash64("ticker", "dates").alias("trade_id")).where(F.weekday("expected_close") < 5)
    found = signals.first_price_from(due, b, most=5)
    return found.where("exit_date is not null").select("ticker", "dates", "exit_date", "exit_price")


def _backtest(spark: SparkSession, sf_dir: str, plan: str, capital: float = 1e9) -> DataFrame:
    b = load_bars(spark, sf_dir)
    chosen = _signals(spark, sf_dir).where(signals.predicted_sharpe() > 0.6)
    log = backtest.run_backtest(chosen, b.select("ticker", "dates", "px_last"), load_index(spark, sf_dir), capital, plan=plan)
    return rounded(log, {c: 0 for c in ("mtm_value", "cum_realized_pnl", "cash", "invested_value", "total_equity")}, ("dates",))


_HOLD, _MOST = 20, 5
_TRADES = [
    *_PRED,
    q.INDEX,
    "cand AS (SELECT ticker, dates, px_last FROM sig WHERE predicted_sharpe > 0.6 AND px_last > 0)",
    "bd AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM (SELECT cast(range AS date) AS day FROM range(DATE '1990-01-01', DATE '2005-01-01', INTERVAL 1 DAY) WHERE isodow(range) <= 5))",
    "base AS (SELECT c.*, b.i FROM cand c ASOF JOIN bd b ON c.dates >= b.day)",
    f"due AS (SELECT base.*, b.day AS expected_close, b.i AS ci FROM base JOIN bd b ON b.i = base.i + {_HOLD})",
    f"ends AS (SELECT f.first, b.day AS stop FROM (SELECT min(dates) AS first, max(i) AS i FROM base) f JOIN bd b ON b.i = f.i + {_HOLD + _MOST + 5})",
    f"hit AS (SELECT d.ticker, d.dates, min(b.i) AS i FROM due d JOIN bd b ON b.i BETWEEN d.ci AND d.ci + {_MOST} JOIN bars p ON p.ticker = d.ticker AND p.dates = b.day, ends WHERE b.day <= stop GROUP BY 1, 2)",
    "shut AS (SELECT h.ticker, h.dates, b.day AS exit_date, p.px_last AS exit_price FROM hit h JOIN bd b ON b.i = h.i JOIN bars p ON p.ticker = h.ticker AND p.dates = b.day)",
    "full_ AS (SELECT d.*, s.exit_date, s.exit_price FROM due d LEFT JOIN shut s USING (ticker, dates))",
    "lvin AS (SELECT f.*, x.px_last AS index_in FROM full_ f ASOF LEFT JOIN idx x ON f.dates >= x.dates)",
    "lvout AS (SELECT f.*, x.px_last AS index_out FROM lvin f ASOF LEFT JOIN idx x ON f.exit_date >= x.dates)",
    "trade AS (SELECT ticker, dates, 1e6 / px_last AS quantity, expected_close, 1e6 * coalesce((exit_price / px_last - 1) * 100 - (index_out / nullif(index_in, 0) - 1) * 100, 0) / 100 AS profit FROM lvout)",
    "cal AS (SELECT dates FROM (SELECT dates FROM cand UNION SELECT dates FROM bars), ends WHERE dates BETWEEN first AND stop)",
]


def _log_sql(taken: str, capital: str, *more: str) -> str:
    """The log of the trades taken: what is open, what has been closed, and what it is worth, a row a day."""
    return (
        _with(
            *_TRADES, *more,
            f"t AS (SELECT k.*, c.dates AS closed FROM {taken} k ASOF LEFT JOIN cal c ON k.expected_close <= c.dates)",
            "ins AS (SELECT dates, count(*) AS n FROM t GROUP BY dates)",
            "outs AS (SELECT closed AS dates, count(*) AS n, sum(profit) AS profit FROM t WHERE closed IS NOT NULL GROUP BY closed)",
            "worth AS (SELECT c.dates, sum(coalesce(t.quantity * p.px_last, 1e6)) AS w FROM cal c JOIN t ON t.dates <= c.dates AND c.dates < coalesce(t.closed, DATE '2100-01-01') LEFT JOIN bars p ON p.ticker = t.ticker AND p.dates = c.dates GROUP BY c.dates)",
            "run AS (SELECT c.dates, coalesce(w, 0) AS w, sum(coalesce(o.profit, 0)) OVER (ORDER BY c.dates) AS pnl, sum(coalesce(i.n, 0) - coalesce(o.n, 0)) OVER (ORDER BY c.dates) AS open FROM cal c LEFT JOIN ins i USING (dates) LEFT JOIN outs o USING (dates) LEFT JOIN worth USING (dates))",
        ).replace("WITH ", "WITH RECURSIVE ", 1)
        + f"SELECT dates, round({capital} + pnl - open * 1e6 + w, 0) + 0.0 AS mtm_value, round(pnl, 0) + 0.0 AS cum_realized_pnl, round({capital} + pnl - open * 1e6, 0) + 0.0 AS cash, round(open * 1e6, 0) + 0.0 AS invested_value, round({capital} + pnl, 0) + 0.0 AS total_equity FROM run"
    )


@register(_log_sql("trade", "1e9"))
def backtest_unconstrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _backtest(spark, sf_dir, "unconstrained")


# day by day: what is due is paid back with its profit, then as many of the day's candidates are opened, by ticker, as cash allows
_CASH = [
    "days AS (SELECT c.dates, row_number() OVER (ORDER BY c.dates) AS n, list(struct_pack(ticker := t.ticker, dates := t.dates, close := t.expected_close, profit := t.profit) ORDER BY t.ticker) FILTER (WHERE t.ticker IS NOT NULL) AS wanted FROM cal c LEFT JOIN trade t ON t.dates = c.dates GROUP BY c.dates)",
    "sim AS (SELECT cast(0 AS bigint) AS n, 2e7::double AS cash, [x for x in (SELECT any_value(wanted) FROM days WHERE wanted IS NOT NULL) if false] AS held, [x for x in (SELECT any_value(wanted) FROM days WHERE wanted IS NOT NULL) if false] AS taken"
    " UNION ALL SELECT n, cash - 1e6 * len(taken), list_concat(kept, taken), taken FROM (SELECT n, cash, kept, wanted[1:greatest(0, floor(cash / 1e6))::bigint] AS taken FROM ("
    "SELECT d.n, s.cash + coalesce(list_sum([1e6 + x.profit for x in s.held if x.close <= d.dates]), 0) AS cash, [x for x in s.held if x.close > d.dates] AS kept, coalesce(d.wanted, [x for x in s.held if false]) AS wanted FROM sim s JOIN days d ON d.n = s.n + 1)))",
    "picked AS (SELECT t.* FROM (SELECT unnest(taken, recursive := true) FROM sim) u JOIN trade t ON t.ticker = u.ticker AND t.dates = u.dates)",
]


@register(_log_sql("picked", "2e7", *_CASH))
def backtest_cash_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _backtest(spark, sf_dir, "constrained", 2e7)


@register(
    _with(q.BARS, q.INDEX, "d AS (SELECT DISTINCT dates FROM bars)", "lv AS (SELECT d.dates, i.px_last AS level FROM d ASOF LEFT JOIN idx i ON d.dates >= i.dates)")
    + "SELECT dates, round(1000000 * level / first_value(level IGNORE NULLS) OVER (ORDER BY dates ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 3) + 0.0 AS index_value FROM lv"
)
def benchmark_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = load_bars(spark, sf_dir).select("dates").distinct()
    return rounded(backtest.benchmark(log, load_index(spark, sf_dir), 1e6), {"index_value": 3}, ("dates",))


# ------------------------------------------------------------------ models


FEATURES = ["roc_10", "volatility_20", "price_div_sma_20"]
N_FOLDS = 5


def _learning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features and targets in five folds of at most 504 training rows and 60 test rows a ticker, two rows apart; a row is written once, with its roles."""
    panel = technical(load_bars(spark, sf_dir), roc=[10], volatility=[20], price_vs_sma=[20])
    rows = labels.excess_returns(panel, load_index(spark, sf_dir), DAYS).na.drop("any", subset=[*FEATURES, "excess_returns_20"])
    return written(partitioning.purged_roles(rows.select("ticker", "dates", *FEATURES, "excess_returns_20"), N_FOLDS, 504, 60, 2))


@register()
def quantile_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One forest a fold; every fold's test rows are predicted."""
    folds = _learning(spark, sf_dir)

    def fold(k: int) -> DataFrame:
        model = modelling.fit_quantile_forest(partitioning.role_rows(folds, k, "train"), FEATURES, "excess_returns_20", trees=10, depth=5)
        return model.predict(partitioning.role_rows(folds, k, "test"), ["ticker", "dates"]).withColumn("fold", F.lit(k))

    return reduce(DataFrame.unionByName, map(fold, range(N_FOLDS)))


@register()
def bin_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One classifier a fold; the score of every fold."""
    folds = _learning(spark, sf_dir)

    def fold(k: int) -> DataFrame:
        train, test = (modelling.quantile_bins(partitioning.role_rows(folds, k, r), "excess_returns_20") for r in ("train", "test"))
        return modelling.macro_f1(modelling.fit_classifier(train, FEATURES, "bin", trees=10, depth=5)(test), "bin", "predicted_class").withColumn("fold", F.lit(k))

    return reduce(DataFrame.unionByName, map(fold, range(N_FOLDS)))


@register(
    _with(q.BARS, "e AS (SELECT quantile_cont(px_last, [0.2, 0.4, 0.6, 0.8]) AS edges FROM bars)")
    + "SELECT ticker, dates, cast(len(list_filter(edges, lambda v: v <= px_last)) AS integer) AS bin FROM bars, e"
)
def quantile_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.quantile_bins(load_bars(spark, sf_dir).select("ticker", "dates", "px_last"), "px_last").select("ticker", "dates", "bin")


_PAIRS = "p AS (SELECT ticker, dates, ntile(5) OVER (ORDER BY dates, ticker) AS fold, px_last AS a, px_low AS b, cast(operating_roic * 100 AS integer) % 5 AS ca, cast(oper_margin * 100 AS integer) % 5 AS cb FROM bars)"


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    fold = F.ntile(5).over(Window.orderBy("dates", "ticker"))
    code = lambda c: F.round(F.col(c) * 100).cast("int") % 5
    return load_bars(spark, sf_dir).select("ticker", "dates", fold.alias("fold"), F.col("px_last").alias("a"), F.col("px_low").alias("b"), code("operating_roic").alias("ca"), code("oper_margin").alias("cb"))


@register(_with(q.BARS, _PAIRS) + "SELECT cast(fold AS integer) AS fold, round(sqrt(avg((a - b) * (a - b))), 5) AS rmse FROM p GROUP BY fold")
def rmse_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.rmse(_pairs(spark, sf_dir), "a", "b").withColumn("rmse", F.round("rmse", 5))


@register(_with(q.BARS, _PAIRS) + "SELECT round(avg(r), 5) AS mean_rmse FROM (SELECT sqrt(avg((a - b) * (a - b))) AS r FROM p GROUP BY fold)")
def mean_rmse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.mean_rmse(_pairs(spark, sf_dir), "a", "b").withColumn("mean_rmse", F.round("mean_rmse", 5))


@register(
    _with(q.BARS, _PAIRS, "c AS (SELECT DISTINCT ca AS k FROM p UNION SELECT DISTINCT cb FROM p)")
    + "SELECT round(avg(f), 8) AS macro_f1 FROM (SELECT k, 2.0E0 * count(*) FILTER (WHERE ca = k AND cb = k) / (count(*) FILTER (WHERE ca = k) + count(*) FILTER (WHERE cb = k)) AS f FROM c, p GROUP BY k)"
)
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modelling.macro_f1(_pairs(spark, sf_dir), "ca", "cb").withColumn("macro_f1", F.round("macro_f1", 8))


@register()
def walk_forward_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every window of 252 training dates and one test date; members need no full attendance here, as bars are sparse."""
    panel = technical(load_bars(spark, sf_dir), roc=[10], volatility=[20], price_vs_sma=[20])
    rows = labels.excess_returns(panel, load_index(spark, sf_dir), DAYS)
    return modelling.walk_forward_train(rows, FEATURES, "excess_returns_20", full_attendance=False)


# ------------------------------------------------------------------ extension


@register(
    "SELECT event_type AS ticker, date_trunc('day', ts) AS start, min(struct_pack(ts:=ts, event_id:=event_id, value:=value)).value AS px_open, max(struct_pack(ts:=ts, event_id:=event_id, value:=value)).value AS px_last, "
    "max(value) AS px_high, min(value) AS px_low, count(*) AS n_events FROM events GROUP BY 1, 2"
)
def event_day_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_bars(spark.read.parquet(f"{sf_dir}/events.parquet"))


