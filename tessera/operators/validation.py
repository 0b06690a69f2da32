"""Constraints on a results table, each a query that returns its violations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.results import KEYS, RESULTS
from .metrics import metric_table

TOLERANCE = 1e-9


def schema_problems(results: DataFrame) -> list[str]:
    """Missing columns and other types (numbers may be of any number type)."""
    have, numbers, out = dict(results.dtypes), {"int", "bigint", "double", "float"}, []
    for f in RESULTS:
        want = f.dataType.simpleString()
        if f.name not in have:
            out.append(f"missing column {f.name}")
        elif have[f.name] != want and not (want in numbers and have[f.name] in numbers):
            out.append(f"{f.name} is {have[f.name]}, not {want}")
    return out


def unknown_metrics(results: DataFrame) -> DataFrame:
    return results.join(F.broadcast(metric_table(results.sparkSession)), "metric", "left_anti").groupBy("metric").agg(F.count("*").alias("n"))


def bad_values(results: DataFrame) -> DataFrame:
    v = F.col("value")
    return results.where(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))


def duplicates(results: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Keys that several rows have; null keys are equal."""
    return results.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def out_of_range(results: DataFrame) -> DataFrame:
    m = metric_table(results.sparkSession)
    low, high = F.coalesce("low", F.lit(float("-inf"))), F.coalesce("high", F.lit(float("inf")))
    return results.join(F.broadcast(m), "metric").where((F.col("value") < low - TOLERANCE) | (F.col("value") > high + TOLERANCE)).select(*results.columns)


def over_budget(results: DataFrame) -> DataFrame:
    return results.where((F.col("method") != "full") & (F.col("budget") > F.col("n_train")))


def missing_cells(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected combinations (any columns) that no row has."""
    keys = expected.columns
    have = results.select(*[F.col(k).alias(f"h_{k}") for k in keys]).distinct()
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"h_{k}"))
    return expected.join(have, on, "left_anti")


def grid(results: DataFrame, *columns: str) -> DataFrame:
    """All combinations of the columns' values, each group of values small: what a full grid would hold."""
    out = None
    for c in columns:
        own = results.select(c).distinct()
        out = own if out is None else out.join(F.broadcast(own))
    return out


def missing_baselines(results: DataFrame, baselines: list[str]) -> DataFrame:
    """Cells (dataset, split_seed, seed, budget) of methods without one of the baselines."""
    cell = ["dataset", "split_seed", "seed", "budget"]
    wanted = results.where(F.col("role") == "method").select(*cell).distinct().withColumn("method", F.explode(F.array(*[F.lit(b) for b in baselines])))
    return missing_cells(results, wanted)


def short_curves(results: DataFrame, least: int = 6, method: str = "random") -> DataFrame:
    per = results.where(F.col("method") == method).groupBy("dataset").agg(F.count_distinct("budget").alias("n"))
    return results.select("dataset").distinct().join(per, "dataset", "left").select("dataset", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def timing_problems(timing: DataFrame, results: DataFrame) -> DataFrame:
    """Cells without a timing, and timings out of range."""
    lost = missing_cells(timing, results.select("cell").distinct()).select("cell", F.lit("missing").alias("problem"))
    bad = timing.where("total_s < 0 or fit_s < 0 or predict_s < 0 or total_s < fit_s + predict_s - 1e-6").select("cell", F.lit("range").alias("problem"))
    return lost.union(bad)


def validate(results: DataFrame, failures: DataFrame | None = None, expected: DataFrame | None = None, baselines: list[str] = (), least_budgets: int = 0) -> list[str]:
    """All problems as text; empty if there are none."""
    out = schema_problems(results)
    if any(p.startswith("missing") for p in out):
        return out
    checks = {"unknown metrics": unknown_metrics(results), "values that aren't finite": bad_values(results), "duplicate keys": duplicates(results), "values out of range": out_of_range(results), "budgets over n_train": over_budget(results)}
    if failures is not None:
        checks["failed cells"] = failures
    if expected is not None:
        checks["missing cells"] = missing_cells(results, expected)
    if baselines:
        checks["missing baselines"] = missing_baselines(results, list(baselines))
    if least_budgets:
        checks["short curves"] = short_curves(results, least_budgets)
    for name, rows in checks.items():
        n = rows.count()
        if n:
            out.append(f"{n} {name}, such as {[r.asDict() for r in rows.limit(3).collect()]}")
    return out


def validate_path(spark, path: str) -> list[str]:
    """All problems of a results path, held against what its meta expects: cells, baselines, budgets, open failures
    and, for scaling, timings."""
    from ..sources.results import FAILURES, open_failures, read_meta, read_results, read_side, read_timing, table_name

    results = read_results(spark, path)
    try:
        meta = read_meta(spark, table_name(path, "meta"))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        meta = {}
    failures = open_failures(read_side(spark, FAILURES, table_name(path, "failures")), results)
    expected = meta.get("expected")
    kind = meta.get("experiment")
    wanted = spark.createDataFrame([tuple(e) for e in expected], "dataset string, split_seed int, seed int, method string, budget_key string") if expected else None
    methods = meta.get("config", {}).get("coreset_methods", [])
    out = validate(results, failures, wanted, [b for b in meta.get("baselines", []) if b != "full"], 6 if kind == "coreset" and "random" in methods else 0)
    if kind == "scaling":
        bad = timing_problems(read_timing(spark, path), results)
        n = bad.count()
        out += [f"{n} timing problems, such as {[r.asDict() for r in bad.limit(3).collect()]}"] * bool(n)
    return out
