"""Scores of predictions as aggregates: one row each, so several run in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-15
#: Buckets of scores for ranks.
RANK_BUCKETS = 256
#: Metric, whether more is better, least and greatest value.
METRICS = {
    "log_loss": (False, 0.0, None), "accuracy": (True, 0.0, 1.0), "roc_auc": (True, 0.0, 1.0), "ece": (False, 0.0, 1.0), "brier": (False, 0.0, 2.0),
    "rmse": (False, 0.0, None), "crps": (False, 0.0, None), "nll": (False, None, None), "coverage": (True, 0.0, 1.0),
}


def higher_is_better(metric: str) -> bool:
    return METRICS[metric][0]


def metric_table(spark) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in METRICS.items()], "metric string, higher boolean, low double, high double")


def _true(pred: DataFrame, truth: DataFrame) -> DataFrame:
    return pred.join(truth.select("row_id", F.col("y").alias("cls")), ["row_id", "cls"])


def log_loss(pred, truth, by=()):
    return _true(pred, truth).groupBy(*by).agg((-F.avg(F.ln(F.least(F.greatest("p", F.lit(EPS)), F.lit(1.0))))).alias("log_loss"))


def _top(pred, by=()):
    """(row_id, top, conf): the first of the likeliest classes."""
    best = F.min(F.struct((-F.col("p")).alias("n"), F.col("cls").alias("c"))).alias("b")
    return pred.groupBy(*by, "row_id").agg(best).select(*by, "row_id", F.col("b.c").alias("top"), (-F.col("b.n")).alias("conf"))


def accuracy(pred, truth, by=()):
    return _top(pred, by).join(truth, "row_id").groupBy(*by).agg(F.avg((F.col("top") == F.col("y")).cast("double")).alias("accuracy"))


def roc_auc(pred, truth, by=()):
    """Area by mid-ranks: of the second class if there are two, else the plain mean over classes that
    some but not all rows have; one class alone: null."""
    rows = pred.join(truth, "row_id").withColumn("hit", (F.col("y") == F.col("cls")).cast("long"))
    keys = [*by, "cls"]
    # ranks by value, from counts of each value: ties share one row, so no class is ranked row by row
    at = rows.groupBy(*keys, "p").agg(F.count("*").alias("n"), F.sum("hit").alias("h"))
    # what lies in lower buckets is added to ranks inside a bucket, so a class's scores don't meet in one task
    at = at.withColumn("bucket", F.least(F.greatest(F.floor(F.col("p") * RANK_BUCKETS), F.lit(0)), F.lit(RANK_BUCKETS - 1)))
    low = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    below = at.groupBy(*keys, "bucket").agg(F.sum("n").alias("m")).select(*[F.col(k).alias(f"b_{k}") for k in keys], F.col("bucket").alias("b_bucket"), F.coalesce(F.sum("m").over(low), F.lit(0)).alias("below"))
    on = F.col("bucket") == F.col("b_bucket")
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    w = Window.partitionBy(*keys, "bucket").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    at = at.join(below, on).withColumn("rank", F.col("below") + F.sum("n").over(w) - F.col("n") + (F.col("n") + 1) / F.lit(2.0))
    one = at.groupBy(*keys).agg(F.sum(F.col("rank") * F.col("h")).alias("r"), F.sum("h").cast("double").alias("pos"), F.sum(F.col("n") - F.col("h")).cast("double").alias("neg"))
    ok = (F.col("pos") > 0) & (F.col("neg") > 0)
    area = F.when(ok, (F.col("r") - F.col("pos") * (F.col("pos") + 1) / 2.0) / F.when(ok, F.col("pos") * F.col("neg")).otherwise(1.0))
    one = one.withColumn("area", area)
    k = Window.partitionBy(*(by or [F.lit(0)]))
    one = one.withColumn("k", F.count("*").over(k)).withColumn("last", F.max("cls").over(k))
    return one.where((F.col("k") > 2) | (F.col("cls") == F.col("last"))).groupBy(*by).agg(F.avg("area").alias("roc_auc"))


def ece(pred, truth, bins=15, by=()):
    top = _top(pred, by).join(truth, "row_id").withColumn("bin", F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)))
    each = top.groupBy(*by, "bin").agg(F.count("*").alias("n"), F.avg((F.col("top") == F.col("y")).cast("double")).alias("acc"), F.avg("conf").alias("conf"))
    return each.groupBy(*by).agg((F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n")).alias("ece"))


def brier(pred, truth, by=()):
    hit = (F.col("cls") == F.col("y")).cast("double")
    rows = pred.join(truth, "row_id").groupBy(*by, "row_id").agg(F.sum((F.col("p") - hit) * (F.col("p") - hit)).alias("b"))
    return rows.groupBy(*by).agg(F.avg("b").alias("brier"))


def rmse(pred, truth, by=()):
    return pred.join(truth, "row_id").groupBy(*by).agg(F.sqrt(F.avg((F.col("mean") - F.col("y")) * (F.col("mean") - F.col("y")))).alias("rmse"))


def nll(densities):
    return densities.agg((-F.avg("log_density")).alias("nll"))


def pinball(y: Column, q: Column, level: Column) -> Column:
    d = y - q
    return F.greatest(level * d, (level - 1) * d)


def crps(quantiles, truth, by=()):
    return quantiles.join(truth, "row_id").groupBy(*by).agg((2 * F.avg(pinball(F.col("y"), F.col("q"), F.col("level")))).alias("crps"))


def coverage(quantiles, truth, low=0.05, high=0.95):
    both = quantiles.where(F.col("level").isin(low, high)).groupBy("row_id").agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    return both.join(truth, "row_id").agg(F.avg(F.col("y").between(F.col("lo"), F.col("hi")).cast("double")).alias("coverage"))


def score_classification(pred, truth, by=(), bins=15):
    """(by, metric, value) of log_loss, accuracy, roc_auc, ece.  One pass gives all but the ranks."""
    best = F.min(F.struct((-F.col("p")).alias("n"), F.col("cls").alias("c"))).alias("b")
    rows = pred.join(truth.select("row_id", "y"), "row_id")
    per = rows.groupBy(*by, "row_id", "y").agg(best, F.max(F.when(F.col("cls") == F.col("y"), F.col("p"))).alias("true"))
    loss, conf = -F.ln(F.least(F.greatest("true", F.lit(EPS)), F.lit(1.0))), -F.col("b.n")
    bin_ = F.least(F.floor(conf * bins), F.lit(bins - 1)).alias("bin")
    part = per.groupBy(*by, bin_).agg(F.count("*").alias("n"), F.count("true").alias("known"), F.sum(loss).alias("loss"), F.sum((F.col("b.c") == F.col("y")).cast("double")).alias("hit"), F.sum(conf).alias("conf"))
    one = part.groupBy(*by).agg((F.sum("loss") / F.nullif(F.sum("known"), F.lit(0))).alias("log_loss"), (F.sum("hit") / F.sum("n")).alias("accuracy"), (F.sum(F.abs(F.col("hit") - F.col("conf"))) / F.sum("n")).alias("ece"))
    long = one.select(*by, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("log_loss", "accuracy", "ece")])))
    return long.unionByName(roc_auc(pred, truth, by=by).select(*by, F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value")))


def score_regression(mean, quantiles, truth, by=()):
    a = rmse(mean, truth, by).select(*by, F.lit("rmse").alias("metric"), F.col("rmse").alias("value"))
    return a.union(crps(quantiles, truth, by).select(*by, F.lit("crps").alias("metric"), F.col("crps").alias("value")))
