"""Staged feature plans.

A feature declares columns with the stage at which their inputs exist: stage 1 reads the panel, stage 2 also stage 1, and so on.
The planner emits one select a stage for all features together, so that every stage's window functions over the same partitioning
and order share one sort, and the whole feature set needs one exchange by ticker. Helper columns start with "_" and end with the
plan; features that declare the same helper share it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class FeaturePlan:
    def __init__(self) -> None:
        self.columns: dict[str, tuple[int, Column]] = {}
        self.outputs: list[str] = []

    def helper(self, stage: int, name: str, column: Column) -> Column:
        """Declares a shared intermediate column and returns a reference to it."""
        name = f"_{name}"
        self.columns.setdefault(name, (stage, column))
        return F.col(name)

    def output(self, stage: int, name: str, column: Column) -> Column:
        if name not in self.outputs:
            self.outputs.append(name)
            self.columns[name] = (stage, column)
        return F.col(name)

    def apply(self, panel: DataFrame) -> DataFrame:
        """The panel's columns, then the outputs in order of declaration; a column of an output's name is replaced."""
        kept = [c for c in panel.columns if c not in self.outputs]
        done = list(kept)
        out = panel.select(*kept)
        for stage in sorted({s for s, _ in self.columns.values()}):
            new = {n: c for n, (s, c) in self.columns.items() if s == stage}
            out = out.select(*(F.col(f"`{c}`") for c in done), *(c.alias(n) for n, c in new.items()))
            done += new
        return out.select(*(F.col(f"`{c}`") for c in kept), *self.outputs)
