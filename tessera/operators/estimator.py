"""Estimators that choose a context, fit an ensemble on it and aggregate: fit and predict on DataFrames."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from . import aggregation as A
from . import distribution as D
from . import selection as S
from . import subsets as U
from .backends import Backend, make_backend
from .encode import split_rows


def resolve_budget(budget: int | float | None, n: int) -> int | None:
    """A fraction of the rows, a number of rows, or None for all."""
    if budget is None:
        return None
    if isinstance(budget, float):
        if not 0 < budget <= 1:
            raise ValueError("a fraction must be in (0, 1]")
        return max(1, round(budget * n))
    return min(budget, n)


@dataclass
class _Context:
    """method: a selector, or a per-estimator one, or none; budget: rows or a fraction; aggregation: a rule."""

    method: str = "random"
    budget: int | float | None = None
    aggregation: str = ""
    options: dict = field(default_factory=dict)
    temperature: float = 1.0
    backend: dict | Backend = field(default_factory=dict)
    seed: int = 0
    val_fraction: float = 0.2

    task = "classification"
    rules = A.CLF
    default_rule, default_backend = "mean", {"name": "centroid", "estimators": 4}

    def _model(self) -> tuple[Backend, int]:
        if isinstance(self.backend, Backend):
            return self.backend, getattr(self.backend, "estimators", 1)
        spec = self.backend or self.default_backend
        model = make_backend(spec)
        return model, spec.get("estimators", getattr(model, "estimators", 1))

    def _rule(self) -> str:
        name = self.aggregation or self.default_rule
        if name not in self.rules:
            raise KeyError(f"unknown rule {name}; there are {', '.join(sorted(self.rules))}")
        return name

    def _select(self, rows: DataFrame, k: int) -> DataFrame:
        """(row_id, est): chosen from the rows of the fit alone."""
        b = None if self.method in ("none", None) else resolve_budget(self.budget, rows.count())
        each = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("est")
        if b is None:
            return rows.select("row_id", each)
        if self.method in U.PER_ESTIMATOR:
            return U.subsets(rows, self.method, b, k, self.seed, self.task)
        return S.select_context(rows, self.method, b, self.seed, self.task).select("row_id", each)


@dataclass
class ContextClassifier(_Context):
    def fit(self, rows: DataFrame) -> ClassifierModel:
        """rows: row_id, y, features.  Rules that need held-out rows get theirs from a slice of these."""
        (model, k), rule, options = self._model(), self._rule(), dict(self.options)
        factor = 1.0
        if rule in A.NEEDS_VALIDATION:
            parts = split_rows(rows, self.seed, self.val_fraction)
            train, held = parts.where("part = 'train'").drop("part"), parts.where("part = 'test'").drop("part")
            out = model.clf_outputs(train, train.select("row_id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("est")), held)
            if rule == "val_weighted":
                loss = {r["est"]: r["loss"] for r in A.estimator_log_losses(out, held, self.temperature).collect()}
                low, tau = min(loss.values()), options.get("tau", 0.1)
                rule, options = "weighted", {"weights": [2.718281828459045 ** ((low - loss[e]) / tau) for e in sorted(loss)]}
            else:
                rule, options, factor = "mean", {}, A.fit_temperature(out, held.select("row_id", "y"), self.temperature)
        return ClassifierModel(self, model, rows, written(self._select(rows, k), "context"), rule, options, self.temperature * factor)


@dataclass
class ClassifierModel:
    settings: ContextClassifier
    backend: Backend
    train: DataFrame
    context: DataFrame
    rule: str
    options: dict
    temperature: float

    def outputs(self, rows: DataFrame) -> DataFrame:
        return self.backend.clf_outputs(self.train, self.context, rows)

    def predict_proba(self, rows: DataFrame) -> DataFrame:
        """(row_id, cls, p)."""
        return A.aggregate_clf(self.rule, self.outputs(rows), self.temperature, **self.options)

    def predict(self, rows: DataFrame) -> DataFrame:
        """(row_id, cls): the first of the likeliest classes."""
        best = F.min(F.struct((-F.col("p")).alias("n"), F.col("cls").alias("c"))).alias("b")
        return self.predict_proba(rows).groupBy("row_id").agg(best).select("row_id", F.col("b.c").alias("cls"))


@dataclass
class ContextRegressor(_Context):
    bins: int = 40

    task = "regression"
    rules = A.REG
    default_rule, default_backend = "mixture", {"name": "histogram", "estimators": 4}

    def fit(self, rows: DataFrame) -> RegressorModel:
        """rows: row_id, y, features."""
        (model, k), rule = self._model(), self._rule()
        return RegressorModel(self, model, rows, written(self._select(rows, k), "context"), rule, written(D.borders(rows, n=self.bins), "bins"))


@dataclass
class RegressorModel:
    settings: ContextRegressor
    backend: Backend
    train: DataFrame
    context: DataFrame
    rule: str
    bins: DataFrame

    def outputs(self, rows: DataFrame) -> DataFrame:
        return self.backend.reg_outputs(self.train, self.context, rows, self.bins)

    def predict_distribution(self, rows: DataFrame, levels=A.LEVELS) -> dict[str, DataFrame]:
        """mean, quantiles at ``levels`` and, where the rule has them, bins."""
        return A.aggregate_reg(self.rule, self.outputs(rows), self.bins, levels, **self.settings.options)

    def predict(self, rows: DataFrame) -> DataFrame:
        """(row_id, mean)."""
        return self.predict_distribution(rows)["mean"]


#: The model of a classifier, by its former name.
ContextModel = ClassifierModel
