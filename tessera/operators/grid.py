"""Tiers, budgets and cell grids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Lower bounds of tiers, default absolute budgets and fractions.
TIERS = [("tiny", 200), ("small", 1_000), ("medium", 10_000), ("large", 100_000)]


def tier_of(n: Column) -> Column:
    """The last tier whose bound n reaches; below the first: the first."""
    out = F.lit(TIERS[0][0])
    for name, low in TIERS[1:]:
        out = F.when(n >= low, F.lit(name)).otherwise(out)
    return out


def _candidates(sizes: DataFrame, fractions: list[float], absolute: list[int], classes: int) -> DataFrame:
    """(sizes, pos, key, budget): half-even rounding, at least max(classes, 2)."""
    least = max(classes, 2)
    rows = [F.struct(F.lit(i).alias("pos"), F.lit(f"f{f:g}").alias("key"), F.greatest(F.bround(F.lit(float(f)) * F.col("n"), 0).cast("long"), F.lit(least).cast("long")).alias("budget")) for i, f in enumerate(fractions)]
    rows += [F.struct(F.lit(len(fractions) + i).alias("pos"), F.lit(f"a{b}").alias("key"), F.greatest(F.lit(int(b)).cast("long"), F.lit(least).cast("long")).alias("budget")) for i, b in enumerate(absolute)]
    return sizes.withColumn("__k", F.explode(F.array(*rows))).select(*sizes.columns, "__k.*").where(F.col("budget") < F.col("n"))


def resolve_budgets(sizes: DataFrame, fractions: list[float], absolute: list[int], classes: int = 2) -> DataFrame:
    """(dataset, budget), distinct and under n, for sizes (dataset, n)."""
    return _candidates(sizes, fractions, absolute, classes).select("dataset", "budget").distinct()


def budget_keys(sizes: DataFrame, fractions: list[float], absolute: list[int], classes: int = 2) -> DataFrame:
    """(dataset, budget, budget_key): of keys with one budget the first."""
    return _candidates(sizes, fractions, absolute, classes).groupBy("dataset", "budget").agg(F.min_by("key", "pos").alias("budget_key"))


def learning_curve_budgets(n: int, points: int = 6, classes: int = 0) -> list[int]:
    """Log-spaced from max(5 * max(classes, 2), 10) to n / 2; more points until enough differ."""
    low, high = max(5 * max(classes, 2), 10), n // 2
    if high <= low:
        return [high] if high > 0 else []
    for k in range(points, 4 * points + 1):
        got = sorted({round(math.exp(math.log(low) + (math.log(high) - math.log(low)) * i / max(1, k - 1))) for i in range(k)})
        if len(got) >= points or high - low < points:
            break
    return got


def scaling_budgets(n: int, start: int = 512, factor: float = 2, most: int | None = None) -> list[int]:
    """start, start * factor, ... and the cap itself."""
    if factor <= 1:
        raise ValueError("factor must exceed 1")
    cap = min(n, most) if most else n
    out, b = [], float(start)
    while b < cap:
        out.append(round(b))
        b *= factor
    return [*out, cap]


def cell_id(experiment: Column, dataset: Column, split_seed: Column, seed: Column, method: Column, key: Column, budget: Column, estimators: Column | None = None) -> Column:
    parts = [experiment, dataset, F.concat(F.lit("s"), split_seed.cast("string")), F.concat(F.lit("r"), seed.cast("string")), method, key, budget.cast("string")]
    return F.concat_ws("|", *parts, *([F.when(estimators.isNotNull() & (estimators >= 0), F.concat(F.lit("E"), estimators.cast("string")))] if estimators is not None else []))


def curve(m_inf: float, a: float, alpha: float, budget: Column) -> Column:
    """A power-law learning curve."""
    return F.lit(float(m_inf)) + F.lit(float(a)) * F.pow(budget.cast("double"), F.lit(-float(alpha)))
