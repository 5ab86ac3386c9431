"""Window building blocks. Order is only ever that of `dates` inside a `ticker`; every frame counts rows, never days."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

TICKER, DATES = "ticker", "dates"


def series(keys: tuple[str, ...] = (TICKER,)) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(DATES)


def last_rows(n: int, end: int = 0, keys: tuple[str, ...] = (TICKER,)) -> WindowSpec:
    """The n rows that end `end` rows before the current one."""
    return series(keys).rowsBetween(-(n - 1) - end, -end)


def so_far(keys: tuple[str, ...] = (TICKER,)) -> WindowSpec:
    return series(keys).rowsBetween(Window.unboundedPreceding, 0)


def full(n: int, x: Column, agg: Callable[[Column], Column], end: int = 0, keys: tuple[str, ...] = (TICKER,)) -> Column:
    """agg over n rows, null unless all n values are there."""
    w = last_rows(n, end, keys)
    return F.when(F.count(x).over(w) == n, agg(x).over(w))


def values(n: int, x: Column, keys: tuple[str, ...] = (TICKER,)) -> Column:
    """The last n values as an array in row order, null unless all are there."""
    return full(n, x, F.collect_list, keys=keys)


def lag(x: Column, n: int = 1, keys: tuple[str, ...] = (TICKER,)) -> Column:
    return F.lag(x, n).over(series(keys))


def divide(a: Column, b: Column) -> Column:
    """a / b, null where b is 0: no infinities, no errors."""
    return a / F.when(b != 0, b)


def change(x: Column, n: int = 1, keys: tuple[str, ...] = (TICKER,)) -> Column:
    """x / x[n rows before] - 1."""
    return divide(x, lag(x, n, keys)) - 1
