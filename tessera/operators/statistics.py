"""Paired statistics over a long results table: datasets are the unit, seeds are averaged first.

All comparisons of a report run as one job: groups are (method, baseline, budget_key, metric).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import special
from ..functions.seeding import hash_order
from .metrics import METRICS

ALIGN = ["dataset", "split_seed", "seed", "budget", "n_estimators"]
#: Differences up to which the signed-rank test is exact.
WILCOXON_EXACT = 50
GROUP = ["method", "baseline", "budget_key", "metric"]


def clean(results: DataFrame) -> DataFrame:
    """NaN as null in numbers, null as '' in texts: what the operators expect."""
    kinds = dict(results.dtypes)
    nan = {c: F.nullif(F.col(c), F.lit(float("nan"))) for c, k in kinds.items() if k == "double"}
    text = {c: F.coalesce(c, F.lit("")) for c in ("flags", "budget_key") if c in kinds}
    return results.withColumns(nan | text)


def has_flag(flags: Column, flag: str, exact: bool = True) -> Column:
    """Whether a list of flags has the flag, or, not ``exact``, has it in any of its names."""
    text = F.coalesce(flags, F.lit(""))
    return F.array_contains(F.split(text, ","), flag) if exact else F.contains(text, F.lit(flag))


def add_flag(flags: Column, flag: str) -> Column:
    return F.concat_ws(",", F.nullif(F.coalesce(flags, F.lit("")), F.lit("")), F.lit(flag))


def orientation(metric: Column) -> Column:
    return F.when(metric.isin(*[m for m, v in METRICS.items() if v[0]]), 1.0).otherwise(-1.0)


def paired(results: DataFrame, family: DataFrame, exclude: tuple[str, ...] = ("saturated",)) -> DataFrame:
    """(method, baseline, budget_key, metric, dataset, diff): mean of method - baseline over seeds, for each
    row (method, baseline, budget_key, metric) of the family (null budget_key: all budgets).  Flagged
    method rows are left out.  Missing keys match missing keys."""
    f = F.broadcast(family)
    m = results.alias("m").join(f.alias("f"), (F.col("m.method") == F.col("f.method")) & (F.col("m.metric") == F.col("f.metric")) & (F.col("f.budget_key").isNull() | (F.col("m.budget_key") == F.col("f.budget_key"))))
    m = m.select("f.*", *[F.col(f"m.{k}").alias(k) for k in ALIGN], F.col("m.value").alias("vm"), F.col("m.flags").alias("flags"))
    for flag in exclude:
        m = m.where(~has_flag(F.col("flags"), flag))
    b = results.select(F.col("method").alias("bm"), F.col("metric").alias("bmetric"), *[F.col(k).alias(f"b_{k}") for k in ALIGN], F.col("value").alias("vb"))
    on = (F.col("baseline") == F.col("bm")) & (F.col("metric") == F.col("bmetric"))
    for k in ALIGN:
        on = on & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    return m.join(b, on).groupBy(*GROUP, "dataset").agg(F.avg(F.col("vm") - F.col("vb")).alias("diff"))


def sign_p(wins: Column, losses: Column) -> Column:
    """Exact two-sided sign test from counts; no counts: 1."""
    n = (wins + losses).cast("int")
    m = F.least(wins, losses).cast("int")
    zero = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))
    step = lambda a, i: F.struct((a["term"] * (n - i + 1) / i).alias("term"), (a["sum"] + a["term"] * (n - i + 1) / i).alias("sum"))
    ways = F.aggregate(F.when(m > 0, F.sequence(F.lit(1), F.greatest(m, F.lit(1)))).otherwise(F.array().cast("array<int>")), zero, step)["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2.0 * ways / F.pow(F.lit(2.0), n.cast("double"))))


def bootstrap_ci(values: DataFrame, by: list[str], value: str = "value", tie: str = "dataset", n_boot: int = 2000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """(by, ci_low, ci_high): percentile interval of the mean.  One value: that value; nulls don't count."""
    w = Window.partitionBy(*by)
    rows = values.where(F.col(value).isNotNull()).withColumn("i", F.row_number().over(w.orderBy(tie)) - 1).withColumn("n", F.count("*").over(w))
    got = rows.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("i", F.col(value).cast("double").alias("v")))).alias("x"), F.max("n").alias("n"))
    drawn = got.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    pick = lambda j: F.pmod(F.conv(F.substring(hash_order(seed, "boot", F.col("b"), j), 1, 12), 16, 10).cast("long"), F.col("n")).cast("int")
    total = F.aggregate(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")), F.lit(0.0), lambda a, j: a + F.get("x", pick(j))["v"])
    means = drawn.select(*by, (total / F.col("n")).alias("m"))
    q = means.groupBy(*by).agg(F.percentile("m", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    return q.select(*by, F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def _sum_of_terms(first: Column, count: Column, ratio) -> Column:
    """first + first * ratio(1) + first * ratio(1) * ratio(2) + ...: ``count`` terms."""
    zero = F.struct(first.alias("term"), F.lit(0.0).alias("sum"))
    step = lambda a, k: F.struct((a["term"] * ratio(k)).alias("term"), (a["sum"] + a["term"]).alias("sum"))
    return F.aggregate(F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>")), zero, step)["sum"]


def t_tail(t: Column, df: Column) -> Column:
    """Two-sided tail of Student's t for a whole number of degrees of freedom, by its finite sum."""
    angle, df = F.atan(F.abs(t) / F.sqrt(df.cast("double"))), df.cast("int")
    sin, cos2 = F.sin(angle), F.cos(angle) * F.cos(angle)
    odd = 2 / math.pi * (angle + sin * _sum_of_terms(F.cos(angle), F.floor((df - 1) / 2).cast("int"), lambda k: cos2 * (2 * k) / (2 * k + 1)))
    even = sin * _sum_of_terms(F.lit(1.0), F.floor(df / 2).cast("int"), lambda k: cos2 * (2 * k - 1) / (2 * k))
    return F.greatest(F.lit(0.0), 1 - F.when(F.pmod(df, F.lit(2)) == 1, odd).otherwise(even))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution: a series near the middle, a continued fraction beyond."""
    x = F.abs(z) / math.sqrt(2)
    series = 1 - 2 / math.sqrt(math.pi) * F.exp(-x * x) * _sum_of_terms(x, F.lit(80), lambda k: 2 * x * x / (2 * k + 1))
    far = F.greatest(x, F.lit(1.0))
    fraction = F.aggregate(F.sequence(F.lit(120), F.lit(1), F.lit(-1)), F.lit(1.0), lambda t, k: 1 + k / (2 * far * far) / t)
    return F.least(F.lit(1.0), F.when(x < 2.5, series).otherwise(F.exp(-far * far) / (far * math.sqrt(math.pi)) / fraction))


def paired_t(d: Column) -> Column:
    """p of the two-sided paired t-test of an array of differences; null for fewer than two or no spread."""
    n = F.size(d).cast("double")
    mean = F.aggregate(d, F.lit(0.0), lambda s, x: s + x) / n
    ss = F.aggregate(d, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    ok = (n >= 2) & (ss > 0)
    t = mean / F.sqrt(F.when(ok, ss / (n - 1) / n).otherwise(1.0))
    return F.when(ok, t_tail(t, F.greatest(n - 1, F.lit(1.0))))


def wilcoxon(d: Column) -> Column:
    """p of the two-sided signed-rank test of an array of differences: nulls and infinities don't count, zeros are left
    out, ties get mid-ranks; exact up to WILCOXON_EXACT differences without ties or zeros, else normal with tie
    correction; no differences: 1."""
    known = F.filter(d, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.array_sort(F.transform(F.filter(known, lambda v: v != 0), lambda v: F.struct(F.abs(v).alias("a"), (v > 0).alias("up"))))
    n = F.size(x)
    less = lambda v: F.size(F.filter(x, lambda o: o["a"] < v["a"]))
    same = lambda v: F.size(F.filter(x, lambda o: o["a"] == v["a"]))
    ranks = F.transform(x, lambda v: F.struct((less(v) + (same(v) + 1) / 2.0).alias("r"), v["up"].alias("up"), same(v).cast("double").alias("t")))
    total = lambda f: F.aggregate(ranks, F.lit(0.0), lambda s, v: s + f(v))
    plus = total(lambda v: F.when(v["up"], v["r"]).otherwise(0.0))
    least = F.least(plus, n * (n + 1) / 2.0 - plus)
    ties = total(lambda v: v["t"] * v["t"] - 1)
    # ways to reach each rank sum, one rank after the other
    width = (least + 1).cast("int")
    start = F.transform(F.sequence(F.lit(0), least.cast("int")), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    grow = lambda w, k: F.transform(w, lambda v, i: v + F.when(i >= k, F.get(w, (i - k).cast("int"))).otherwise(0.0))
    ways = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.slice(start, F.lit(1), width), grow)
    exact = F.least(F.lit(1.0), 2.0 * F.aggregate(ways, F.lit(0.0), lambda s, v: s + v) / F.pow(F.lit(2.0), n.cast("double")))
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0)
    z = (least - n * (n + 1) / 4.0) / F.when(sd > 0, sd).otherwise(1.0)
    rough = F.when(sd > 0, normal_tail(z)).otherwise(1.0)
    return F.when(n == 0, 1.0).when((n <= WILCOXON_EXACT) & (ties == 0) & (n == F.size(known)), exact).otherwise(rough)


def holm(rows: DataFrame, p: str = "p_sign", by: list[str] = (), tie: list[str] = GROUP) -> DataFrame:
    """rows with p_holm: step-down adjusted inside ``by``, monotone, at most 1."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    ordered = w.orderBy(p, *tie)
    step = rows.withColumn("__a", F.least(F.lit(1.0), (F.count("*").over(w) - F.row_number().over(ordered) + 1) * F.col(p)))
    return step.withColumn("p_holm", F.max("__a").over(ordered.rowsBetween(Window.unboundedPreceding, 0))).drop("__a")


def compare(results: DataFrame, family: DataFrame, n_boot: int = 2000, alpha: float = 0.05, seed: int = 0, exclude: tuple[str, ...] = ("saturated",)) -> DataFrame:
    """One row for each member of the family: n_datasets, mean_diff, improvement (more is better),
    interval, p_sign, p_wilcoxon, win_rate, significant, p_holm, significant_holm."""
    d = paired(results, family, exclude).withColumn("imp", F.col("diff") * orientation(F.col("metric")))
    one = d.groupBy(*GROUP).agg(
        F.count("*").alias("n_datasets"), F.avg("diff").alias("mean_diff"), F.avg("imp").alias("improvement"), F.count_if(F.col("imp") > 0).alias("wins"), F.count_if(F.col("imp") < 0).alias("losses"), F.transform(F.sort_array(F.collect_list(F.struct("dataset", "imp"))), lambda s: s["imp"]).alias("imps")
    )
    ci = bootstrap_ci(d, GROUP, "imp", n_boot=n_boot, alpha=alpha, seed=seed)
    on = F.lit(True)
    right = ci.select(*[F.col(g).alias(f"r_{g}") for g in GROUP], "ci_low", "ci_high")
    for g in GROUP:
        on = on & F.col(g).eqNullSafe(F.col(f"r_{g}"))
    both = one.join(right, on).withColumn("p_sign", sign_p(F.col("wins"), F.col("losses")))
    both = both.withColumn("win_rate", (F.col("wins") + 0.5 * (F.col("n_datasets") - F.col("wins") - F.col("losses"))) / F.col("n_datasets")).withColumn("p_wilcoxon", wilcoxon(F.col("imps")))
    clear = (F.col("ci_low") > 0) | (F.col("ci_high") < 0)
    both = holm(both.withColumn("significant", (F.col("n_datasets") >= 2) & clear & (F.col("p_sign") < alpha)))
    return both.select(*GROUP, "n_datasets", "mean_diff", "improvement", "ci_low", "ci_high", "p_sign", "p_wilcoxon", "win_rate", "significant", "p_holm", ((F.col("p_holm") < alpha) & clear).alias("significant_holm"))


def excluded_datasets(results: DataFrame, method: str, metric: str, flag: str = "saturated") -> DataFrame:
    """Datasets of which every row of the method carries the flag."""
    own = results.where((F.col("method") == method) & (F.col("metric") == metric))
    return own.groupBy("dataset").agg(F.min(has_flag(F.col("flags"), flag).cast("int")).alias("all")).where("all = 1").select("dataset")


def by_tier(results: DataFrame, method: str, baseline: str, metric: str, **options) -> tuple[DataFrame, float | None]:
    """compare in each tier and pooled (tier ''), and the p of a rank test between tiers of two datasets or more."""
    spark = results.sparkSession
    family = spark.createDataFrame([(method, baseline, None, metric)], "method string, baseline string, budget_key string, metric string")
    tiers = sorted(r[0] for r in results.select("tier").distinct().collect())
    out = compare(results, family, **options).withColumn("tier", F.lit(""))
    groups = []
    for tier in tiers:
        own = results.where(F.col("tier") == tier)
        out = out.unionByName(compare(own, family, **options).withColumn("tier", F.lit(tier)))
        d = [r["diff"] for r in paired(own, family).collect()]
        if len(d) >= 2:
            groups.append(d)
    return out, special.kruskal(groups) if len(groups) >= 2 else None


def paired_t_by_dataset(results: DataFrame, baseline: str, metric: str) -> DataFrame:
    """(dataset, method, n, mean_diff, p_t, p_holm) of every other method against the baseline over seeds."""
    own = results.where(F.col("metric") == metric)
    b = own.where(F.col("method") == baseline).select("dataset", F.col("split_seed").alias("s0"), F.col("seed").alias("s1"), F.col("budget").alias("s2"), F.col("value").alias("vb"))
    m = own.where(F.col("method") != baseline).alias("m")
    j = m.join(b.alias("b"), (F.col("m.dataset") == F.col("b.dataset")) & F.col("split_seed").eqNullSafe(F.col("s0")) & F.col("seed").eqNullSafe(F.col("s1")) & F.col("m.budget").eqNullSafe(F.col("s2")))
    d = j.groupBy(F.col("m.dataset").alias("dataset"), "method").agg(F.count("*").alias("n"), F.avg(F.col("value") - F.col("vb")).alias("mean_diff"), F.sort_array(F.collect_list(F.col("value") - F.col("vb"))).alias("d"))
    d = d.withColumn("p_t", paired_t(F.col("d"))).drop("d")
    tested = holm(d.where("p_t is not null"), "p_t", ["dataset"], ["method"])
    return tested.unionByName(d.where("p_t is null").withColumn("p_holm", F.lit(None).cast("double")))
