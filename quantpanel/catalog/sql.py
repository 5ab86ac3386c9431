"""SQL text for DuckDB, written from the operators' definitions and not from the DataFrame code."""

from __future__ import annotations

from collections.abc import Sequence

BARS = """bars AS (
SELECT l_suppkey AS ticker, cast(l_shipdate AS date) AS dates,
  max(l_extendedprice/l_quantity*(1+l_tax)) AS px_high, min(l_extendedprice/l_quantity*(1-l_discount)) AS px_low,
  max(struct_pack(k:=l_orderkey, n:=l_linenumber, px:=l_extendedprice/l_quantity)).px AS px_last,
  sum(l_quantity) AS px_volume, max(l_extendedprice) AS turnover,
  (max(CASE WHEN l_returnflag <> 'N' THEN l_discount END) - 0.03E0)*100 AS is_eps,
  max(l_extendedprice) AS bs_tot_asset, max(l_extendedprice*l_discount)*20 AS bs_total_liabilities,
  max(l_extendedprice)*3 AS cur_mkt_cap, max(l_discount) AS operating_roic, min(l_tax) AS wacc,
  max(l_tax) AS oper_margin, min(l_discount) AS sales_growth, max(l_tax) AS return_on_asset,
  max(CASE WHEN l_returnflag = 'R' THEN l_discount END) AS tot_debt_to_tot_eqy
FROM lineitem GROUP BY l_suppkey, cast(l_shipdate AS date))"""
INDEX = """idx AS (
SELECT cast(o_orderdate AS date) AS dates, max(struct_pack(k:=o_orderkey, px:=o_totalprice)).px AS px_last
FROM orders GROUP BY 1)"""
SERIES = "PARTITION BY ticker ORDER BY dates"


def frame(n: int, end: int = 0) -> str:
    to = f"{end} PRECEDING" if end else "CURRENT ROW"
    return f"OVER ({SERIES} ROWS BETWEEN {n - 1 + end} PRECEDING AND {to})"


def full(n: int, agg: str, x: str, end: int = 0) -> str:
    """agg is a pattern with {} for x."""
    w = frame(n, end)
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg.format(x)} {w} END"


def avg(n: int, x: str, end: int = 0) -> str:
    return full(n, "avg({})", x, end)


def total(n: int, x: str, end: int = 0) -> str:
    return full(n, "sum({})", x, end)


def lag(x: str, n: int = 1) -> str:
    return f"lag({x}, {n}) OVER ({SERIES})"


def running(expr: str) -> str:
    return f"{expr} OVER ({SERIES} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def ema(x: str, alpha: str, least: int = 0) -> tuple[str, str]:
    """(steps so far, average) of a column that is null at most at its start; the second needs the first as column x_k."""
    keep = f"(1E0-({alpha}))"
    k = running(f"count({x})") + " - 1"
    term = f"CASE WHEN {x} IS NULL THEN NULL WHEN {x}_k = 0 THEN {x} ELSE ({alpha})*{x}*pow({keep}, -{x}_k) END"
    return k, f"CASE WHEN {x}_k + 1 >= {max(least, 1)} THEN pow({keep}, {x}_k) * {running(f'sum({term})')} END"


def select(stages: Sequence[dict[str, str]], outputs: dict[str, int | None], source: str = "bars", ctes: Sequence[str] = (BARS,), keys: str = "ticker, dates") -> str:
    """Each stage adds columns to the one before; outputs are rounded to the digits given (None: as they are)."""
    parts = list(ctes)
    before = source
    for i, stage in enumerate(stages):
        parts.append(f"s{i} AS (SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in stage.items()) + f" FROM {before})")
        before = f"s{i}"
    shown = ", ".join(n if d is None else f"round({n}, {d}) + 0.0 AS {n}" for n, d in outputs.items())
    return f"WITH {', '.join(parts)} SELECT {keys}, {shown} FROM {before}"
