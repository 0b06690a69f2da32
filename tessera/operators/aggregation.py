"""Ensemble aggregation over long relations.

Classification: out (row_id, est, cls, logit) to pred (row_id, cls, p).  Regression: out
(row_id, est, bin, p) and bins (bin, lo, hi) to mean, quantiles and, where defined, bin probabilities.
Rules are functions in a registry; adding one is a function and a line.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import freed, written
from . import distribution as D

CLF: dict[str, Callable] = {}
REG: dict[str, Callable] = {}
NEEDS_VALIDATION = {"val_weighted", "mean_temp_offline"}
#: Quantile levels that predictions are decoded at: 0.025 to 0.975 by 0.025.
LEVELS = [round(0.025 * i, 3) for i in range(1, 40)]


def clf(name: str):
    return lambda f: CLF.setdefault(name, f)


def reg(name: str):
    return lambda f: REG.setdefault(name, f)


def aggregate_clf(name: str, out: DataFrame, temperature: float = 1.0, **options) -> DataFrame:
    if name not in CLF:
        raise KeyError(f"unknown rule {name}; there are {', '.join(sorted(CLF))}")
    return CLF[name](out, temperature, **options)


def aggregate_reg(name: str, out: DataFrame, bins: DataFrame, levels=LEVELS, **options) -> dict[str, DataFrame]:
    if name not in REG:
        raise KeyError(f"unknown rule {name}; there are {', '.join(sorted(REG))}")
    return REG[name](out, bins, levels, **options)


def softmax(value: Column, keys: list[str], temperature: float | Column = 1.0) -> Column:
    w = Window.partitionBy(*keys)
    z = F.exp((value - F.max(value).over(w)) / temperature)
    return z / F.sum(z).over(w)


def proba(out: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(row_id, est, cls, p): softmax of each estimator, at the temperature.  Rows are dealt by row_id alone, which
    serves every later grouping of a row's estimators and classes: one shuffle for a rule."""
    w = Window.partitionBy("row_id", "est")
    z = out.repartition("row_id").withColumn("z", F.exp((F.col("logit") - F.max("logit").over(w)) / F.lit(float(temperature))))
    return z.select("row_id", "est", "cls", (F.col("z") / F.sum("z").over(w)).alias("p"))


def renorm(pred: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """p over its row's sum, unless that is 1 to 1e-12; a sum of 1e-12 or less takes the fallback."""
    w = Window.partitionBy("row_id")
    rows = pred.withColumn("s", F.sum("p").over(w))
    safe = F.when(F.abs(F.col("s") - 1) <= 1e-12, F.col("p")).when(F.col("s") > 1e-12, F.col("p") / F.col("s"))
    if fallback is None:
        return rows.select("row_id", "cls", F.coalesce(safe, F.col("p")).alias("p"))
    return rows.join(fallback.select("row_id", "cls", F.col("p").alias("q")), ["row_id", "cls"]).select("row_id", "cls", F.coalesce(safe, F.col("q")).alias("p"))


@clf("mean")
def mean(out, temperature=1.0):
    return proba(out, temperature).groupBy("row_id", "cls").agg(F.avg("p").alias("p"))


@clf("logit_mean")
def logit_mean(out, temperature=1.0):
    one = out.groupBy("row_id", "cls").agg(F.avg("logit").alias("logit")).withColumn("est", F.lit(0))
    return proba(one, temperature).drop("est")


@clf("median")
def median(out, temperature=1.0):
    p = proba(out, temperature)
    both = p.groupBy("row_id", "cls").agg(F.percentile("p", F.lit(0.5)).alias("p"), F.avg("p").alias("q"))
    return renorm(both.select("row_id", "cls", "p"), both.select("row_id", "cls", F.col("q").alias("p")))


@clf("trimmed_mean")
def trimmed_mean(out, temperature=1.0, trim=0.2):
    w = Window.partitionBy("row_id", "cls")
    p = proba(out, temperature).withColumn("rn", F.row_number().over(w.orderBy("p", "est"))).withColumn("e", F.count("*").over(w))
    cut = F.floor(F.lit(float(trim)) * F.col("e"))
    return renorm(p.where((F.col("rn") > cut) & (F.col("rn") <= F.col("e") - cut)).groupBy("row_id", "cls").agg(F.avg("p").alias("p")))


def _weighted(p: DataFrame) -> DataFrame:
    """p with w: the weighted mean over estimators."""
    return p.groupBy("row_id", "cls").agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("p"))


@clf("entropy_weighted")
def entropy_weighted(out, temperature=1.0, tau=1.0):
    p = proba(out, temperature)
    h = p.groupBy("row_id", "est").agg(F.sum(F.when(F.col("p") > 0, -F.col("p") * F.ln("p")).otherwise(0.0)).alias("h"))
    w = h.select("row_id", "est", softmax(-F.col("h") / F.lit(float(tau)), ["row_id"]).alias("w"))
    return renorm(_weighted(p.join(w, ["row_id", "est"])))


@clf("weighted")
def weighted(out, temperature=1.0, weights: list[float] = ()):
    if any(w < 0 for w in weights) or not sum(weights) > 0:
        raise ValueError("weights must be zero or more, one for each estimator")
    estimators = out.select("est").distinct().count()
    if len(weights) != estimators:
        raise ValueError(f"{len(weights)} weights for {estimators} estimators")
    return _weighted(proba(out, temperature).withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("est") + 1)))


def estimator_log_losses(out: DataFrame, truth: DataFrame, temperature: float = 1.0) -> DataFrame:
    """(est, loss) over rows with a true class."""
    p = proba(out, temperature).join(truth.select("row_id", F.col("y").alias("cls")), ["row_id", "cls"])
    return p.groupBy("est").agg((-F.avg(F.ln(F.least(F.greatest("p", F.lit(1e-15)), F.lit(1.0))))).alias("loss"))


@clf("val_weighted")
def val_weighted(out, temperature=1.0, val_out: DataFrame | None = None, val_truth: DataFrame | None = None, tau=0.1):
    """Weights fall with each estimator's loss on rows held out of training."""
    if val_out is None or val_truth is None:
        raise ValueError("val_weighted needs held-out outputs and labels")
    loss = estimator_log_losses(val_out, val_truth, temperature)
    w = loss.select("est", softmax(-F.col("loss") / F.lit(float(tau)), [F.lit(0)]).alias("w"))
    return _weighted(proba(out, temperature).join(F.broadcast(w), "est"))


def _mean_loss_at(out: DataFrame, truth: DataFrame, temperature: float, scales: list[float]) -> dict[float, float]:
    """Loss of the mean rule at each scale of the temperature, in one job."""
    s = F.explode(F.array(*[F.lit(float(x)) for x in scales])).alias("s")
    w = Window.partitionBy("s", "row_id", "est")
    z = out.select("*", s).withColumn("z", F.exp((F.col("logit") - F.max("logit").over(w)) / (F.lit(float(temperature)) * F.col("s"))))
    p = z.withColumn("p", F.col("z") / F.sum("z").over(w)).groupBy("s", "row_id", "cls").agg(F.avg("p").alias("p"))
    true = p.join(truth.select("row_id", F.col("y").alias("cls")), ["row_id", "cls"])
    rows = true.groupBy("s").agg((-F.avg(F.ln(F.least(F.greatest("p", F.lit(1e-15)), F.lit(1.0))))).alias("loss")).collect()
    return {r["s"]: r["loss"] for r in rows}


def temperature_grid(n: int = 25, low: float = 0.05, high: float = 20.0) -> list[float]:
    grid = [math.exp(math.log(low) + (math.log(high) - math.log(low)) * i / (n - 1)) for i in range(n)]
    return sorted({*grid, 1.0})


def fit_temperature(val_out: DataFrame, val_truth: DataFrame, temperature: float = 1.0, refine: int = 2) -> float:
    """The scale of least loss: on a log grid (1 is always in it), then on finer ones around the best."""
    val_out = written(val_out, "held")
    at = _mean_loss_at(val_out, val_truth, temperature, temperature_grid())
    width = 0.3
    for _ in range(refine):
        best = min(at, key=lambda s: (at[s], abs(math.log(s))))
        near = [best * math.exp(width * i / 4) for i in range(-4, 5)]
        at |= _mean_loss_at(val_out, val_truth, temperature, near)
        width /= 4
    freed(val_out)
    return min(at, key=lambda s: (at[s], abs(math.log(s))))


@clf("mean_temp_offline")
def mean_temp_offline(out, temperature=1.0, val_out=None, val_truth=None):
    if val_out is None or val_truth is None:
        raise ValueError("mean_temp_offline needs held-out outputs and labels")
    return mean(out, temperature * fit_temperature(val_out, val_truth, temperature))


def sample_weighted(out: DataFrame, gate: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Weights (row_id, est, w) for each row."""
    return _weighted(proba(out, temperature).join(gate, ["row_id", "est"]))


def single(out: DataFrame, temperature: float = 1.0) -> DataFrame:
    return proba(out.where("est = 0"), temperature).drop("est")


def first_estimators(out: DataFrame, k: int) -> DataFrame:
    return out.where(F.col("est") < k)


def _decoded(p: DataFrame, bins: DataFrame, levels) -> dict[str, DataFrame]:
    return {"mean": D.mean(p, bins), "quantiles": D.quantiles(p, bins, levels), "bins": p}


@reg("mixture")
def mixture(out, bins, levels=LEVELS):
    return _decoded(out.groupBy("row_id", "bin").agg(F.avg("p").alias("p")), bins, levels)


@reg("log_pool")
def log_pool(out, bins, levels=LEVELS):
    """The geometric mean, renormalised: a bin that one estimator rules out is ruled out."""
    pooled = out.groupBy("row_id", "bin").agg(F.when(F.min("p") > 0, F.exp(F.avg(F.when(F.col("p") > 0, F.ln("p"))))).otherwise(0.0).alias("p"))
    w = Window.partitionBy("row_id")
    s = F.sum("p").over(w)
    return _decoded(pooled.withColumn("s", s).select("row_id", "bin", F.when(F.col("s") > 0, F.col("p") / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).otherwise(0.0).alias("p")), bins, levels)


def _per_estimator(out, bins, levels):
    each = D.quantiles(out, bins, levels, keys=("row_id", "est"))
    means = D.mean(out, bins, keys=("row_id", "est")).groupBy("row_id").agg(F.avg("mean").alias("mean"))
    return each, means


@reg("quantile_mean")
def quantile_mean(out, bins, levels=LEVELS):
    each, means = _per_estimator(out, bins, levels)
    return {"mean": means, "quantiles": each.groupBy("row_id", "level").agg(F.avg("q").alias("q")), "bins": None}


@reg("quantile_median")
def quantile_median(out, bins, levels=LEVELS):
    each, means = _per_estimator(out, bins, levels)
    return {"mean": means, "quantiles": each.groupBy("row_id", "level").agg(F.percentile("q", F.lit(0.5)).alias("q")), "bins": None}


def sample_weighted_mixture(out: DataFrame, bins: DataFrame, gate: DataFrame, levels=LEVELS) -> dict[str, DataFrame]:
    p = out.join(gate, ["row_id", "est"]).groupBy("row_id", "bin").agg((F.sum(F.col("w") * F.col("p")) / F.sum("w")).alias("p"))
    return _decoded(p, bins, levels)
