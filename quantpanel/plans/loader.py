"""The facade: a panel, its transforms, labels and folds behind one object. All steps are lazy."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame

from quantpanel.functions.windows import DATES, TICKER
from quantpanel.operators import cleaning, labels, partitioning
from quantpanel.operators.fundamental import plan_fundamental
from quantpanel.operators.technical import SWITCHES, WINDOWED, plan_technical
from quantpanel.operators.tsnumeric import columns_of, series_features
from quantpanel.operators.tsstats import SWITCHES as STATS
from quantpanel.operators.tsstats import plan_tsstats
from quantpanel.plans.stages import FeaturePlan


class CovariateTransform:
    """A transform of panels: subclasses give transform(panel)."""

    def __init__(self, **features: Any) -> None:
        self.features = features

    def transform(self, panel: DataFrame) -> DataFrame:
        raise NotImplementedError


class TechnicalCovariateTransform(CovariateTransform):
    """Windowed features go into one staged plan, recursive and numeric ones into one grouped pass."""

    def transform(self, panel: DataFrame) -> DataFrame:
        windowed = {k: v for k, v in self.features.items() if k in WINDOWED or k in SWITCHES}
        stats = {k: v for k, v in self.features.items() if k in STATS or k == "index_mass_quantile"}
        rest = {k: v for k, v in self.features.items() if k not in windowed and k not in stats}
        columns_of(rest)  # unknown names raise here
        plan = plan_tsstats(plan_technical(FeaturePlan(), **windowed), **stats)
        return series_features(plan.apply(panel), **rest)


class FundamentalCovariateTransform(CovariateTransform):
    def transform(self, panel: DataFrame) -> DataFrame:
        return plan_fundamental(FeaturePlan(), **self.features).apply(panel)


class LabelTransform:
    """Excess returns over label_duration rows; subclasses add a label."""

    def __init__(self, index: DataFrame, label_duration: int) -> None:
        self.index, self.days = index, label_duration

    def transform(self, panel: DataFrame, keys: Sequence[str] = (TICKER,)) -> DataFrame:
        return labels.excess_to_labels(panel, self.index, self.days, keys=keys)


ExcessReturnTransform = LabelTransform


class BinaryLabelTransform(LabelTransform):
    def __init__(self, index: DataFrame, label_duration: int, quantile: float, per_date: bool = True) -> None:
        super().__init__(index, label_duration)
        if not 0 <= quantile <= 1:
            raise ValueError("quantile must lie between 0 and 1")
        self.quantile, self.per_date = quantile, per_date

    def transform(self, panel: DataFrame, keys: Sequence[str] = (TICKER,)) -> DataFrame:
        return labels.excess_to_labels(panel, self.index, self.days, quantile=self.quantile, per_date=self.per_date, keys=keys)


class NaryLabelTransform(LabelTransform):
    def __init__(self, index: DataFrame, label_duration: int, n_labels: int) -> None:
        super().__init__(index, label_duration)
        if not isinstance(n_labels, int) or n_labels < 1:
            raise ValueError("n_labels must be a positive integer")
        self.n_labels = n_labels

    def transform(self, panel: DataFrame, keys: Sequence[str] = (TICKER,)) -> DataFrame:
        return labels.excess_to_labels(panel, self.index, self.days, n_labels=self.n_labels, keys=keys)


class KMRFLabelTransform:
    def __init__(self, index: DataFrame, kama_n: int = 10, gamma: float = 0.5) -> None:
        self.index, self.kama_n, self.gamma = index, kama_n, gamma

    def transform(self, panel: DataFrame, keys: Sequence[str] = (TICKER,)) -> DataFrame:
        return labels.regime_label(panel, self.index, self.kama_n, self.gamma)


class PurgedTimeSeriesPartition:
    def __init__(self, n_splits: int = 5, max_train_size: int | None = None, test_size: int | None = None, gap: int = 0) -> None:
        self.kwargs = {"n_splits": n_splits, "max_train_size": max_train_size, "test_size": test_size, "gap": gap}
        partitioning._check(**self.kwargs)

    def split(self, panel: DataFrame) -> DataFrame:
        return partitioning.purged_folds(panel, **self.kwargs)


class PurgedGroupTimeSeriesPartition:
    def __init__(self, n_splits: int = 5, max_train_group_size: int | None = None, max_test_group_size: int | None = None, gap: int = 0) -> None:
        self.kwargs = {"n_splits": n_splits, "max_train_group_size": max_train_group_size, "max_test_group_size": max_test_group_size, "gap": gap}
        partitioning._check(**self.kwargs)

    def split(self, panel: DataFrame) -> DataFrame:
        return partitioning.purged_group_folds(panel, **self.kwargs)


class EvaluationPartitioner:
    def __init__(self, panel: DataFrame, n_train: int = 252, n_valid: int = 1) -> None:
        self.panel, self.n_train, self.n_valid = panel, n_train, n_valid

    def partition_data(self) -> DataFrame:
        """(window_id, ticker) memberships; rows(window) gives a window's rows."""
        return partitioning.walk_forward(self.panel, self.n_train, self.n_valid)

    def rows(self, members: DataFrame) -> DataFrame:
        return partitioning.window_rows(self.panel, members, self.n_train, self.n_valid)


class DataLoader:
    """Transforms are (class, arguments) pairs, applied in any order. get_cv_folds() gives one relation with fold and role."""

    def __init__(
        self,
        panel: DataFrame,
        covariate_transform: Sequence[tuple[type[CovariateTransform], dict]] = (),
        label_transform: Sequence[tuple[type, dict]] = (),
        cols2drop: Sequence[str] = (),
        partition_class: type | None = None,
        partition_kwargs: dict | None = None,
        label_per_partition: bool = False,
    ) -> None:
        self.panel, self.covariates, self.label_config = panel, list(covariate_transform), list(label_transform)
        self.cols2drop, self.per_partition = list(cols2drop), label_per_partition
        self.partition = partition_class(**(partition_kwargs or {})) if partition_class else None

    def transform_covariates(self) -> DataFrame:
        out = self.panel
        for kind, arguments in self.covariates:
            out = kind(**arguments).transform(out)
        return out

    def transform_labels(self, panel: DataFrame | None = None, keys: Sequence[str] = (TICKER,)) -> DataFrame:
        out = self.transform_covariates() if panel is None else panel
        for kind, arguments in self.label_config:
            out = kind(**arguments).transform(out, keys)
        return out

    def transform_data(self) -> DataFrame:
        """Covariates, labels, forward fill, dropped columns."""
        out = self.transform_covariates()
        if not self.per_partition:
            out = self.transform_labels(out)
        return cleaning.forward_fill(cleaning.drop_dividends(out)).drop(*self.cols2drop)

    def get_cv_folds(self) -> DataFrame:
        if self.partition is None:
            raise ValueError("no partition class")
        folds = self.partition.split(self.transform_data())
        if self.per_partition:
            folds = self.transform_labels(folds, (TICKER, "fold", "role"))
        return partitioning.folds_with_both_roles(folds)


__all__ = [n for n in dir() if n[0].isupper() and n not in ("Any", "Sequence", "DATES", "TICKER", "STATS", "SWITCHES", "WINDOWED")]
