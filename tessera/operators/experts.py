"""Experts: one fit for each routed context, combined for each row by its gate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from . import aggregation as A
from . import routing as R
from .backends import Backend, CentroidBackend
from .subsets import subsets


#: Whether features are weighted, and coverage, of each kind of expert.
VARIANTS = {"experts_scaled": (False, 1.0), "experts_weighted": (True, 1.0), "experts_overlap": (False, 2.0), "experts_full": (True, 2.0)}


def _combined(task: str, out: DataFrame, gate: DataFrame, bins: DataFrame | None):
    return A.sample_weighted(out, gate) if task == "classification" else A.sample_weighted_mixture(out, bins, gate)


def expert_outputs(train: DataFrame, plan: R.ExpertPlan, rows: DataFrame, routes: DataFrame, model: Backend | None = None, task: str = "classification", bins: DataFrame | None = None) -> DataFrame:
    """(row_id, est, ..., logit or p): est is the expert's centre; rows meet their own experts only."""
    served = rows.join(routes.select("row_id", F.col("expert").alias("grp")), "row_id")
    context = plan.context.select("grp", F.col("grp").alias("est"), "row_id")
    return (model or CentroidBackend(1)).outputs(task, train, context, served, bins)


def expert_mixture(train: DataFrame, rows: DataFrame, budget: int, estimators: int, seed: int = 0, coverage: float = 1.0, clusters: int | None = None, hard: bool = False, tau: float | None = None, weighted: bool = False) -> DataFrame:
    """(row_id, cls, p) of a row's ``estimators`` nearest experts, weighted by a softmax of distances (``tau``
    fitted or the plan's own), or of the nearest alone."""
    plan = R.expert_plan(train, budget, estimators, seed, coverage, clusters, weighted=weighted)
    routes = R.expert_route(plan, rows)
    if hard:
        routes = routes.where("slot = 0")
    out = expert_outputs(train, plan, rows, routes)
    gate = R.gate_weights(routes.select("row_id", F.col("expert").alias("est"), "d2"), tau or plan.tau)
    return A.sample_weighted(out, gate)


def tuned_experts(train: DataFrame, rows: DataFrame, method: str, budget: int, estimators: int, seed: int = 0, model: Backend | None = None, task: str = "classification", bins: DataFrame | None = None, most: int = R.cluster.MAX_CLUSTERS) -> dict:
    """Predictions by suffix: '' (gate fitted on held-out training rows), '+heuristic' (the plan's own temperature) and
    '+hard' (the nearest expert alone) of one of VARIANTS."""
    weighted, coverage = VARIANTS[method]
    held = R.gate_holdout(train, seed, task=task)
    pool = train.join(held.where("not held"), "row_id", "left_semi")
    slice_ = train.join(held.where("held"), "row_id", "left_semi")
    plan = R.expert_plan(pool, budget, estimators, seed, coverage, most=most, weighted=weighted, task=task)
    plan.context = written(plan.context, "experts")
    d = lambda routes: routes.select("row_id", F.col("expert").alias("est"), "d2")
    own, mine = R.expert_route(plan, slice_), R.expert_route(plan, rows)
    score = R.gate_scores(expert_outputs(pool, plan, slice_, own, model, task, bins), slice_.select("row_id", "y"), bins=bins)
    fit = R.fit_gate(d(own), score, plan.tau, wide=True)
    out = expert_outputs(pool, plan, rows, mine, model, task, bins)
    gates = {"": R.gate_weights(d(mine), fit.tau), "+heuristic": R.gate_weights(d(mine), plan.tau), "+hard": R.gate_weights(d(mine.where("slot = 0")), plan.tau)}
    return {k: _combined(task, out, w, bins) for k, w in gates.items()}


def tuned_gate(train: DataFrame, rows: DataFrame, budget: int, estimators: int, seed: int = 0, model: Backend | None = None, task: str = "classification", bins: DataFrame | None = None, ridge: float = 1e-3) -> dict:
    """Cluster experts whose gate is fitted on rows held out of training, by suffix: '' (temperature), '+bias' (and
    an offset an expert) and '+heuristic' (not fitted)."""
    held = R.gate_holdout(train, seed, task=task)
    pool = train.join(held.where("not held"), "row_id", "left_semi")
    slice_ = train.join(held.where("held"), "row_id", "left_semi")
    context = written(subsets(pool, "cluster_experts", budget, estimators, seed, task), "experts")
    model = model or CentroidBackend(1)
    d_held, tau0 = R.gate_distances(pool, slice_, estimators, seed)
    score = R.gate_scores(model.outputs(task, pool, context, slice_, bins), slice_.select("row_id", "y"), bins=bins)
    plain, biased = R.fit_gate(d_held, score, tau0), R.fit_gate(d_held, score, tau0, True, ridge)
    d, _ = R.gate_distances(pool, rows, estimators, seed)
    out = model.outputs(task, pool, context, rows, bins)
    gates = {"": R.gate_weights(d, plain.tau), "+bias": R.gate_weights(d, biased.tau, biased.bias or None), "+heuristic": R.gate_weights(d, tau0)}
    return {k: _combined(task, out, w, bins) for k, w in gates.items()}


def tuned_cluster_experts(train: DataFrame, rows: DataFrame, budget: int, estimators: int, seed: int = 0, bias: bool = False) -> DataFrame:
    """(row_id, cls, p) of ``tuned_gate`` with or without the offsets."""
    return tuned_gate(train, rows, budget, estimators, seed, ridge=0.01)["+bias" if bias else ""]


def local_outputs(train: DataFrame, rows: DataFrame, routed: dict[str, DataFrame], model: Backend | None = None, task: str = "classification", bins: DataFrame | None = None) -> DataFrame:
    """Outputs of each group of rows served by its own contexts (local_mix, crumb)."""
    context = written(routed["context"], "local")
    return (model or CentroidBackend(1)).outputs(task, train, context, rows.join(routed["groups"], "row_id"), bins)


def local_predictions(train: DataFrame, rows: DataFrame, routed: dict[str, DataFrame]) -> DataFrame:
    """(row_id, cls, p) of ``local_outputs``, averaged over estimators."""
    return A.mean(local_outputs(train, rows, routed))


def resample_scores(values: DataFrame, contexts: DataFrame) -> DataFrame:
    """(context, n, mean, improvement over 'full'): how a mean moves when rows are repeated or redrawn."""
    m = contexts.join(values, "row_id").groupBy("context").agg(F.count("*").alias("n"), F.avg("y").alias("mean"))
    full = m.where("context = 'full'").select(F.col("mean").alias("f"))
    return m.join(F.broadcast(full)).select("context", "n", "mean", (F.col("f") - F.col("mean")).alias("improvement"))
