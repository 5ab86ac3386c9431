"""Cross-validation folds and walk-forward windows as relations: columns (fold, role), never lists of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantpanel.functions.windows import DATES, TICKER


def _check(n_splits: int, **sizes: int | None) -> None:
    if not isinstance(n_splits, int) or n_splits < 2:
        raise ValueError("n_splits must be an integer of at least 2")
    for name, size in sizes.items():
        if size is not None and size < (0 if name == "gap" else 1):
            raise ValueError(f"{name} is too small")


def _roles(place: Column, total: Column, n_splits: int, max_train: int | None, test_size: int | None, gap: int) -> Column:
    """An array of (fold, role) for a row at `place` of `total` places; empty where the ticker has too few."""
    size = F.lit(test_size) if test_size else F.floor(total / (n_splits + 1))
    fits = (size > 0) & (total - n_splits * size - gap > 0)

    def role(k: Column) -> Column:
        test = total - n_splits * size + k * size
        end = test - gap
        start = F.greatest(F.lit(0), end - max_train) if max_train else F.lit(0)
        name = F.when((place >= test) & (place < test + size), "test").when((place >= start) & (place < end), "train")
        return F.struct(k.cast("int").alias("fold"), name.alias("role"))

    found = F.filter(F.transform(F.sequence(F.lit(0), F.lit(n_splits - 1)), role), lambda r: r["role"].isNotNull())
    return F.when(fits, found)


#: Helper columns; columns of the panel named fold or role are replaced by those of the result.
PLACE, TOTAL, ROLE = "__fold_place", "__fold_total", "__fold_role"


def _explode(panel: DataFrame, roles: Column) -> DataFrame:
    kept = [F.col(f"`{c}`") for c in panel.columns if c not in (PLACE, TOTAL, "fold", "role")]
    return panel.withColumn(ROLE, F.explode(roles)).select(*kept, f"{ROLE}.fold", f"{ROLE}.role")


def purged_folds(panel: DataFrame, n_splits: int = 5, max_train_size: int | None = None, test_size: int | None = None, gap: int = 0) -> DataFrame:
    """Each row once for every fold it has a role in. Per ticker: the last n_splits blocks of rows are the tests, training ends `gap`
    rows before. Tickers with too few rows are left out. One exchange by ticker, no Python."""
    _check(n_splits, max_train_size=max_train_size, test_size=test_size, gap=gap)
    by = Window.partitionBy(TICKER)
    placed = panel.withColumn(PLACE, F.row_number().over(by.orderBy(DATES)) - 1).withColumn(TOTAL, F.count(F.lit(1)).over(by))
    return _explode(placed, _roles(F.col(PLACE), F.col(TOTAL), n_splits, max_train_size, test_size, gap))


def purged_roles(panel: DataFrame, n_splits: int = 5, max_train_size: int | None = None, test_size: int | None = None, gap: int = 0) -> DataFrame:
    """Each row once, with all its (fold, role) in the array column ROLE: what purged_folds() gives a row for each. See role_rows()."""
    _check(n_splits, max_train_size=max_train_size, test_size=test_size, gap=gap)
    by = Window.partitionBy(TICKER)
    placed = panel.withColumn(PLACE, F.row_number().over(by.orderBy(DATES)) - 1).withColumn(TOTAL, F.count(F.lit(1)).over(by))
    return placed.withColumn(ROLE, _roles(F.col(PLACE), F.col(TOTAL), n_splits, max_train_size, test_size, gap)).drop(PLACE, TOTAL).where(F.size(ROLE) > 0)


def role_rows(placed: DataFrame, fold: int, role: str) -> DataFrame:
    """The rows of purged_roles() that have the role in the fold."""
    return placed.where(F.exists(ROLE, lambda r: (r["fold"] == fold) & (r["role"] == role))).drop(ROLE)


def purged_group_folds(panel: DataFrame, n_splits: int = 5, max_train_group_size: int | None = None, max_test_group_size: int | None = None, gap: int = 0) -> DataFrame:
    """The same on distinct days: rows of one day are in one role."""
    _check(n_splits, max_train_group_size=max_train_group_size, max_test_group_size=max_test_group_size, gap=gap)
    day = F.to_date(DATES)
    by = Window.partitionBy(TICKER)
    placed = panel.withColumn(PLACE, F.dense_rank().over(by.orderBy(day)) - 1).withColumn(TOTAL, F.max(F.col(PLACE)).over(by) + 1)
    return _explode(placed, _roles(F.col(PLACE), F.col(TOTAL), n_splits, max_train_group_size, max_test_group_size, gap))


def folds_with_both_roles(folds: DataFrame) -> DataFrame:
    """Only folds that have both training and test rows."""
    whole = folds.groupBy("fold").agg(F.count_distinct("role").alias("n")).where("n = 2").select("fold")
    return folds.join(F.broadcast(whole), "fold", "left_semi")


def fold_part(folds: DataFrame, fold: int, role: str) -> DataFrame:
    return folds.where((F.col("fold") == fold) & (F.col("role") == role)).drop("fold", "role")


def walk_forward(panel: DataFrame, n_train: int = 252, n_valid: int = 1) -> DataFrame:
    """(window_id, ticker, first_train, first_test, end): the tickers of each walk-forward window.

    Windows are numbered by the place of their first test date among the D distinct dates. A ticker belongs to a window if it has exactly
    n_train rows in the training dates and exactly n_valid in the test dates. Only memberships are made, not n_train copies of the
    panel: window_rows() joins the rows of the windows that are wanted. Counts come from running counts a ticker at its own dates,
    looked up at the window's edges, so the work is tickers x windows, not tickers x windows x n_train.
    """
    if n_train < 1 or n_valid < 1:
        raise ValueError("n_train and n_valid are at least 1")
    dates = panel.select(DATES).distinct().withColumn("place", F.row_number().over(Window.orderBy(DATES)) - 1)
    count = dates.count()  # one row a trading day
    placed = panel.select(TICKER, DATES).join(F.broadcast(dates), DATES)
    # how many rows each ticker has at each place, and so far; the calendar has a row a day, so it may be broadcast
    per = placed.groupBy(TICKER, "place").agg(F.count(F.lit(1)).alias("n"))
    grid = per.select(TICKER).distinct().join(F.broadcast(dates.select("place")))
    running = Window.partitionBy(TICKER).orderBy("place")
    grid = grid.join(per, [TICKER, "place"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    train, test = running.rowsBetween(-n_train, -1), running.rowsBetween(0, n_valid - 1)
    found = grid.withColumn("_train", F.sum("n").over(train)).withColumn("_test", F.sum("n").over(test))
    last = count - n_valid
    found = found.where((F.col("place") >= n_train) & (F.col("place") <= last) & (F.col("_train") == n_train) & (F.col("_test") == n_valid))
    return found.select(F.col("place").cast("int").alias("window_id"), TICKER)


def window_rows(panel: DataFrame, members: DataFrame, n_train: int = 252, n_valid: int = 1) -> DataFrame:
    """The panel's rows of the given memberships, with window_id and role."""
    dates = panel.select(DATES).distinct().withColumn(PLACE, F.row_number().over(Window.orderBy(DATES)) - 1)
    placed = panel.join(F.broadcast(dates), DATES)
    near = F.sequence(F.col(PLACE) - (n_valid - 1), F.col(PLACE) + n_train)
    rows = placed.withColumn("window_id", F.explode(near)).join(members, ["window_id", TICKER], "left_semi")
    role = F.when(F.col(PLACE) < F.col("window_id"), "train").otherwise("test")
    return rows.select(*panel.columns, F.col("window_id").cast("int").alias("window_id"), role.alias("role"))
