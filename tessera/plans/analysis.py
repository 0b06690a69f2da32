"""Reports of a results table: one set of tables for each kind of experiment.

Each table is one grouped job over the results, whatever the number of methods, metrics and budgets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import effects as X
from ..operators import statistics as T
from ..sources.results import read_meta, read_results, read_timing, table_name
from .runner import CANARY

#: Metrics that claims are made on, and extra rows of a cell's method.
PRIMARY = {"classification": "log_loss", "regression": "rmse"}
EXTRA = r"(\+.*|_corrected)$"


def saturated(flags) -> object:
    return T.has_flag(flags, "saturated", exact=False)


def analyze_aggregation(results: DataFrame, **options) -> DataFrame:
    """Every rule against mean (regression: mixture) at each ensemble size: the comparison's columns, task and n_estimators."""
    base = F.when(F.col("task") == "classification", "mean").otherwise("mixture")
    # the ensemble size stands in for the budget key, so that one family holds all
    rows = results.withColumn("budget_key", F.col("n_estimators").cast("string"))
    family = rows.where(F.col("method") != base).select("method", base.alias("baseline"), "budget_key", "metric").distinct()
    found = T.compare(rows, family, **options)
    return found.withColumns({"n_estimators": F.col("budget_key").cast("int"), "task": F.when(F.col("baseline") == "mean", "classification").otherwise("regression")}).drop("budget_key")


def analyze_coreset(results: DataFrame, family: list | None = None, **options) -> dict[str, DataFrame]:
    """family, effects, effect_summary, ratio_curves of the confirm datasets, and the saturated_cells of all: those are
    listed, and left out of summaries and curves."""
    spark = results.sparkSession
    rows = X.annotate_saturation(results)
    confirm = rows.where("split = 'confirm'")
    out = {}
    if family:
        out["family"] = T.compare(confirm, spark.createDataFrame([tuple(f) for f in family], "method string, baseline string, budget_key string, metric string"), **options)
    primary = F.when(F.col("task") == "classification", PRIMARY["classification"]).otherwise(PRIMARY["regression"])
    pairs = confirm.where((F.col("metric") == primary) & ~F.col("method").isin("full", "random", CANARY)).select("method", "metric").distinct().collect()
    effects = None
    for m, metric in sorted((r["method"], r["metric"]) for r in pairs):
        e = X.effect_sizes(confirm, m, metric)
        effects = e if effects is None else effects.unionByName(e)
    if effects is not None:
        fit = effects.where(~saturated(F.col("flags")))
        out["effects"] = effects
        long = fit.unpivot(["method", "metric", "dataset"], ["gap_closed", "multiplier"], "column", "value").where("value is not null")
        per = long.groupBy("method", "metric", "column", "dataset").agg(F.avg("value").alias("value"))
        keys = ["method", "metric", "column"]
        out["effect_summary"] = per.groupBy(*keys).agg(F.count("*").alias("n_datasets"), F.avg("value").alias("mean")).join(T.bootstrap_ci(per, keys, n_boot=options.get("n_boot", 2000)), keys)
        curve = fit.groupBy("method", "metric", "tier", F.round("ratio", 6).alias("ratio"), "dataset").agg(F.avg("gap_closed").alias("gap_closed"))
        out["ratio_curves"] = curve.groupBy("method", "metric", "tier", "ratio").agg(F.avg("gap_closed").alias("gap_closed"), F.count("gap_closed").alias("n_datasets"))
    out["saturated_cells"] = rows.where(saturated(F.col("flags"))).select("dataset", "budget", "metric").distinct()
    return out


def dev_table(results: DataFrame, baseline: str = "random", timing: DataFrame | None = None) -> DataFrame:
    """For each dataset, task, budget, metric and method: n, mean, se over (split_seed, seed), improvement on the baseline,
    its se, p, p_holm over the table and significant_holm; with timings the mean cost of the cell's method."""
    keys = ["dataset", "task", "budget", "metric"]
    base = results.where(F.col("method") == baseline).select(*[F.col(k).alias(f"b_{k}") for k in [*keys, "split_seed", "seed"]], F.col("value").alias("vb"))
    on = F.col("method") != baseline
    for k in [*keys, "split_seed", "seed"]:
        on = on & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    both = results.join(base, on, "left").withColumn("imp", (F.col("value") - F.col("vb")) * T.orientation(F.col("metric")))
    # differences of a group are as many as seeds
    one = both.groupBy(*keys, "method").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), (F.stddev_samp("value") / F.sqrt(F.count("value"))).alias("se"),
        F.sort_array(F.collect_list("imp")).alias("imps"), F.avg("imp").alias("improvement"), (F.stddev_samp("imp") / F.sqrt(F.count("imp"))).alias("imp_se"),
    )
    enough = F.size("imps") >= 2
    one = one.withColumns({"improvement": F.when(enough, F.col("improvement")), "imp_se": F.when(enough, F.col("imp_se")), "p": T.paired_t(F.col("imps"))}).drop("imps")
    out = T.holm(one.where("p is not null"), "p", tie=[*keys, "method"]).unionByName(one.where("p is null").withColumn("p_holm", F.lit(None).cast("double")))
    out = out.withColumn("significant_holm", F.col("p_holm") < 0.05)
    if timing is None:
        return out
    cost = timing.groupBy("dataset", "method").agg(F.avg("total_s").alias("total_s"), F.avg("select_s").alias("select_s"), F.avg("n_fits").alias("n_fits")).withColumnRenamed("method", "cell_method")
    return out.withColumn("cell_method", F.regexp_replace("method", EXTRA, "")).join(cost, ["dataset", "cell_method"], "left").drop("cell_method")


def step_table(results: DataFrame, along: str) -> DataFrame:
    """From each level of ``along`` (budget or n_estimators) to the next, the rest held, paired over seeds:
    n_seeds, value_from, value_to, improvement, se, p, p_holm over the table, significant_holm."""
    fixed = ["dataset", "task", "method", "metric", "n_estimators" if along == "budget" else "budget"]
    levels = results.select(*fixed, along).distinct().withColumn("next", F.lead(along).over(Window.partitionBy(*fixed).orderBy(along))).where("next is not null")
    a = results.join(levels, [*fixed, along]).select(*fixed, along, "next", "seed", F.col("value").alias("va"))
    b = results.select(*fixed, F.col(along).alias("next"), "seed", F.col("value").alias("vb"))
    d = a.join(b, [*fixed, "next", "seed"]).withColumn("imp", (F.col("vb") - F.col("va")) * T.orientation(F.col("metric")))
    one = d.groupBy(*fixed, F.col(along).alias(f"{along}_from"), F.col("next").alias(f"{along}_to")).agg(
        F.count("*").alias("n_seeds"), F.avg("va").alias("value_from"), F.avg("vb").alias("value_to"), F.avg("imp").alias("improvement"), (F.stddev_samp("imp") / F.sqrt(F.count("*"))).alias("se"), F.sort_array(F.collect_list("imp")).alias("imps")
    )
    one = one.withColumn("p", T.paired_t(F.col("imps"))).drop("imps")
    out = T.holm(one.where("p is not null"), "p", tie=[*fixed, f"{along}_from"]).unionByName(one.where("p is null").withColumn("p_holm", F.lit(None).cast("double")))
    return out.withColumn("significant_holm", F.col("p_holm") < 0.05)


def analyze_scaling(results: DataFrame, timing: DataFrame | None = None) -> dict[str, DataFrame]:
    """summary (mean, sd, n_seeds, se and, with timings, cost), and what a larger context or ensemble brings."""
    keys = ["dataset", "task", "method", "metric", "budget", "n_estimators"]
    s = results.groupBy(*keys).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("value").alias("n_seeds")).withColumn("se", F.col("sd") / F.sqrt("n_seeds"))
    if timing is not None:
        cost = ["select_s", "fit_s", "predict_s", "total_s"]
        s = s.join(timing.groupBy("dataset", "budget", "n_estimators").agg(*[F.avg(c).alias(c) for c in cost]), ["dataset", "budget", "n_estimators"], "left")
    return {"summary": s, "context_steps": step_table(results, "budget"), "estimator_steps": step_table(results, "n_estimators")}


def analyze(spark: SparkSession, path: str, out: str | None = None) -> dict[str, DataFrame]:
    """The tables that fit a results path: scaling; coreset, on confirm datasets or, if there are none, exploratory;
    else rules.  Printed, and with ``out`` written beside each other."""
    rows = read_results(spark, path)
    try:
        meta = read_meta(spark, table_name(path, "meta"))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        meta = {}
    kinds = {r[0] for r in rows.select("experiment").distinct().collect()}
    timing = read_timing(spark, path)
    timing = None if timing.isEmpty() else timing
    if "scaling" in kinds:
        tables = analyze_scaling(rows, timing)
    elif "coreset" in kinds and rows.where("split = 'confirm'").isEmpty():
        tables = {"dev": dev_table(rows, meta.get("config", {}).get("baseline", "random"), timing)}
    elif "coreset" in kinds:
        tables = analyze_coreset(rows, meta.get("family") or family_of_results(rows))
    else:
        tables = {"comparisons": analyze_aggregation(rows)}
    for name, t in tables.items():
        if out:
            t.write.mode("overwrite").parquet(table_name(out, f"analysis.{name}"))
        print(report(name, t))
    return tables


def family_of_results(rows: DataFrame, baseline: str = "random") -> list[tuple]:
    """Comparisons of all methods that there are, where no run has fixed them."""
    own = rows.where((F.col("split") == "confirm") & ~F.col("method").isin("full", baseline, CANARY))
    return [(r["method"], baseline, r["budget_key"], r["metric"]) for r in own.select("method", "budget_key", "metric").distinct().collect()]


def report(name: str, table: DataFrame, rows: int = 200) -> str:
    """A table as text, its first rows by all keys."""
    shown = table.limit(rows).toPandas()
    return f"== {name} ==\n" + (shown.to_string(index=False) if len(shown) else "(no rows)")
