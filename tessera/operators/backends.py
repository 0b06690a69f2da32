"""Models behind one interface: contexts and rows in, long outputs out.

``centroid`` and ``histogram`` are plain aggregates, so any engine gives the same figures;
``forest`` uses Spark ML.  Other models plug in as classes with the same two methods.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import MISSING_LOGIT, align

ALPHA = 0.01


class Backend(ABC):
    name = ""

    def params(self) -> dict:
        return {"name": self.name}

    @abstractmethod
    def clf_outputs(self, train: DataFrame, context: DataFrame, rows: DataFrame) -> DataFrame:
        """(row_id, est, cls, logit); train has row_id, y, features; context has est, row_id."""

    def reg_outputs(self, train: DataFrame, context: DataFrame, rows: DataFrame, bins: DataFrame) -> DataFrame:
        raise NotImplementedError(f"{self.name} has no regression")

    def outputs(self, task: str, train: DataFrame, context: DataFrame, rows: DataFrame, bins: DataFrame | None = None) -> DataFrame:
        """Long outputs for a task.  Where both context and rows have grp, rows are served by their own group's fits."""
        if "grp" in context.columns and "grp" in rows.columns:
            return self.grouped_outputs(task, train, context, rows, bins)
        return self.clf_outputs(train, context, rows) if task == "classification" else self.reg_outputs(train, context, rows, bins)

    def grouped_outputs(self, task: str, train: DataFrame, context: DataFrame, rows: DataFrame, bins: DataFrame | None = None) -> DataFrame:
        """One fit for each group after the other; groups are few."""
        out = None
        for g in sorted(r[0] for r in context.select("grp").distinct().collect()):
            own = self.outputs(task, train, context.where(F.col("grp") == g).drop("grp"), rows.where(F.col("grp") == g).drop("grp"), bins)
            out = own if out is None else out.unionByName(own)
        return out

    def native(self, task: str, train: DataFrame, context: DataFrame, rows: DataFrame, bins: DataFrame | None = None) -> DataFrame:
        """The model's own answer: the plain mean of its estimators, (row_id, cls, p) or (row_id, bin, p)."""
        from . import aggregation as A

        out = self.outputs(task, train, context, rows, bins)
        return A.mean(out) if task == "classification" else out.groupBy("row_id", "bin").agg(F.avg("p").alias("p"))

    def embed(self, fit: DataFrame, rows: DataFrame, seed: int = 0, task: str = "classification", n_estimators: int = 1) -> DataFrame:
        """(row_id, features) as the model sees rows, the mean over estimators fitted on ``fit``."""
        return rows.select("row_id", "features")

    def subsample_methods(self) -> list[str]:
        return ["auto", "stratified", "balanced", "majority_downsample", "explicit"]


class CentroidBackend(Backend):
    """Class means of each context; estimator e leaves out features whose place + e divides by the
    number of estimators (if there are two or more)."""

    name = "centroid"

    def __init__(self, estimators: int = 4):
        self.estimators = estimators

    def params(self):
        return {"name": self.name, "estimators": self.estimators}

    def clf_outputs(self, train, context, rows):
        return self._outputs(train, context, rows, [])

    def grouped_outputs(self, task, train, context, rows, bins=None):
        if task != "classification":
            return super().grouped_outputs(task, train, context, rows, bins)
        return self._outputs(train, context, rows, ["grp"])

    def _outputs(self, train, context, rows, by):
        from pyspark.ml.functions import array_to_vector, vector_to_array
        from pyspark.ml.stat import Summarizer

        e = self.estimators
        own = train.join(context, "row_id").select(*by, "est", F.col("y").alias("cls"), array_to_vector("features").alias("v"))
        means = own.groupBy(*by, "est", "cls").agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("mu"))
        # every estimator has every class; one row (a group) holds them all, so rows meet their models where they are
        classes = train.select(F.col("y").alias("cls")).distinct()
        grid = context.select(*by, "est").distinct().join(F.broadcast(classes)).join(F.broadcast(means), [*by, "est", "cls"], "left")
        models = F.broadcast(grid.groupBy(*by).agg(F.collect_list(F.struct("est", "cls", "mu")).alias("models")))
        used = lambda est, i: F.pmod(i + est, F.lit(e)) != 0 if e > 1 else F.lit(True)
        gaps = lambda m: F.filter(F.zip_with("features", m["mu"], lambda x, c: (x - c) * (x - c)), lambda d, i: used(m["est"], i))
        logit = lambda m: F.when(m["mu"].isNull(), MISSING_LOGIT).otherwise(-F.aggregate(gaps(m), F.lit(0.0), lambda s, d: s + d) / F.size(gaps(m)))
        out = rows.select("row_id", "features", *by)
        out = out.join(models, by) if by else out.join(models)
        return out.select("row_id", F.inline(F.transform("models", lambda m: F.struct(m["est"].alias("est"), m["cls"].alias("cls"), logit(m).alias("logit")))))


class HistogramBackend(Backend):
    """Target histograms by one feature cell each: (count + alpha) / (rows + alpha * bins).  Cells are columns by
    name, or, without names, half units of standardised feature number est."""

    name = "histogram"

    def __init__(self, cells: list[str] | None = None, estimators: int = 4):
        self.cells, self.estimators = cells, len(cells) if cells else estimators

    def params(self):
        return {"name": self.name, "cells": self.cells, "estimators": self.estimators}

    def clf_outputs(self, train, context, rows):
        raise ValueError("histogram has no classification")

    def _cell(self):
        if self.cells:
            return F.element_at(F.array(*[F.col(c).cast("string") for c in self.cells]), F.col("est") + 1)
        x = F.get("features", F.pmod(F.col("est"), F.size("features")))
        return F.least(F.greatest(F.floor(2 * x), F.lit(-6)), F.lit(6)).cast("string")

    def grouped_outputs(self, task, train, context, rows, bins=None):
        return self._outputs(train, context, rows, bins, ["grp"])

    def reg_outputs(self, train, context, rows, bins):
        return self._outputs(train, context, rows, bins, [])

    def _outputs(self, train, context, rows, bins, by):
        w = bins.agg(F.min("bin").alias("b0"), F.max("bin").alias("b1"), F.count("*").alias("nb"))
        inside = ((F.col("y") >= F.col("lo")) | (F.col("bin") == F.col("b0"))) & ((F.col("y") < F.col("hi")) | (F.col("bin") == F.col("b1")))
        edged = bins.join(F.broadcast(w))
        own = train.join(context, "row_id").withColumn("cell", self._cell()).join(F.broadcast(edged), inside)
        counts = own.groupBy(*by, "est", "cell", "bin").agg(F.count("*").alias("n"))
        totals = counts.groupBy(*by, "est", "cell").agg(F.sum("n").alias("t"))
        est = F.broadcast(context.select(*by, "est").distinct())
        grid = (rows.join(est, by) if by else rows.join(est)).withColumn("cell", self._cell()).select(*by, "row_id", "est", "cell").join(F.broadcast(edged.select("bin", "nb")))
        got = grid.join(counts, [*by, "est", "cell", "bin"], "left").join(totals, [*by, "est", "cell"], "left")
        return got.select("row_id", "est", "bin", ((F.coalesce("n", F.lit(0)) + ALPHA) / (F.coalesce("t", F.lit(0)) + ALPHA * F.col("nb"))).alias("p"))


class ForestBackend(Backend):
    """A Spark ML forest for each estimator, seeded seed * 1000 + e.  Logits are log probabilities; for regression
    each tree votes for the bin of its answer."""

    name = "forest"

    def __init__(self, estimators: int = 2, trees: int = 10, seed: int = 0, eps: float = 1e-3):
        self.estimators, self.trees, self.seed, self.eps = estimators, trees, seed, eps

    def params(self):
        return {"name": self.name, "estimators": self.estimators, "trees": self.trees, "seed": self.seed, "eps": self.eps}

    def _forest(self, task, fit, seed):
        from pyspark.ml.classification import RandomForestClassifier
        from pyspark.ml.regression import RandomForestRegressor

        kind = RandomForestClassifier if task == "classification" else RandomForestRegressor
        return kind(featuresCol="v", labelCol="label", numTrees=self.trees, seed=seed).fit(fit)

    def _ready(self, train, task):
        """Rows with vector and label, and the labels in the order of their codes."""
        from pyspark.ml.functions import array_to_vector

        rows = train.withColumn("v", array_to_vector("features"))
        if task != "classification":
            return rows.withColumn("label", F.col("y").cast("double")), None
        labels = sorted(r[0] for r in train.select("y").distinct().collect())
        return rows.withColumn("label", (F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("y")) - 1).cast("double")), labels

    def _each(self, context):
        return sorted(r[0] for r in context.select("est").distinct().collect())

    def clf_outputs(self, train, context, rows):
        from pyspark.ml.functions import array_to_vector, vector_to_array

        (ready, labels), out = self._ready(train, "classification"), None
        for e in self._each(context):
            own = ready.join(context.where(F.col("est") == e).select("row_id"), "row_id", "left_semi")
            model = self._forest("classification", own, self.seed * 1000 + e)
            p = model.transform(rows.withColumn("v", array_to_vector("features"))).select("row_id", F.posexplode(vector_to_array("probability")).alias("c", "p"))
            one = p.select("row_id", F.lit(e).alias("est"), F.element_at(F.array(*[F.lit(x) for x in labels]), F.col("c") + 1).alias("cls"), F.ln(F.col("p") * (1 - len(labels) * self.eps) + self.eps).alias("logit"))
            out = one if out is None else out.union(one)
        return align(out, train.select(F.col("y").alias("cls")).distinct())

    def _answers(self, model, rows, task):
        """``rows`` with ``trees``: each tree's class probabilities one after the other, or its value."""
        from pyspark.ml.functions import array_to_vector, vector_to_array

        out, names = rows.withColumn("v", array_to_vector("features")), []
        for i, tree in enumerate(model.trees):
            if task == "classification":
                tree.setProbabilityCol(f"t{i}").setPredictionCol("").setRawPredictionCol("")
                names.append(vector_to_array(f"t{i}"))
            else:
                tree.setPredictionCol(f"t{i}")
                names.append(F.array(f"t{i}"))
            out = tree.transform(out)
        return out.select(*rows.columns, F.concat(*names).alias("trees"))

    def reg_outputs(self, train, context, rows, bins):
        (ready, _), out = self._ready(train, "regression"), None
        edges = [r["lo"] for r in bins.orderBy("bin").collect()]
        nb = len(edges)
        # the bin of an answer: the last whose left edge it reaches; the first for all below
        bin_of = lambda x: F.greatest(F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= x)) - 1, F.lit(0))
        for e in self._each(context):
            own = ready.join(context.where(F.col("est") == e).select("row_id"), "row_id", "left_semi")
            votes = self._answers(self._forest("regression", own, self.seed * 1000 + e), rows, "regression").select("row_id", F.transform("trees", bin_of).alias("votes"))
            share = lambda b: (F.size(F.filter("votes", lambda v: v == b)) + ALPHA) / (F.size("votes") + ALPHA * nb)
            one = votes.select("row_id", F.lit(e).alias("est"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(nb - 1)), share)).alias("bin", "p"))
            out = one if out is None else out.union(one)
        return out

    def embed(self, fit, rows, seed=0, task="classification", n_estimators=1):
        """Answers of each tree fitted on ``fit``; the mean over estimators."""
        (ready, _), out = self._ready(fit, task), None
        for e in range(n_estimators):
            one = self._answers(self._forest(task, ready, seed * 1000 + e), rows.select("row_id", "features"), task).select("row_id", F.col("trees").alias(f"x{e}"))
            out = one if out is None else out.join(one, "row_id")
        total = F.col("x0")
        for e in range(1, n_estimators):
            total = F.zip_with(total, F.col(f"x{e}"), lambda a, b: a + b)
        return out.select("row_id", F.transform(total, lambda x: x / n_estimators).alias("features"))


BACKENDS = {"centroid": CentroidBackend, "histogram": HistogramBackend, "forest": ForestBackend}


def make_backend(spec: dict) -> Backend:
    spec = dict(spec)
    name = spec.pop("name")
    if name not in BACKENDS:
        raise ValueError(f"unknown backend {name}; there are {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name](**spec)
