"""Budgets over groups by largest remainder.  The group table is small: one row a class or bin."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def allocate(sizes: DataFrame, budget: int, min_one: bool = False) -> DataFrame:
    """(grp, n, take) for sizes (grp, n): in proportion to size, at most n, summing to the budget or
    all rows; with ``min_one`` each group that isn't empty gets one first (if the budget allows).
    Remainders go by fraction, then group."""
    whole = Window.partitionBy(F.lit(0))
    first = F.when(F.lit(min_one) & (F.col("n") > 0) & (F.sum((F.col("n") > 0).cast("long")).over(whole) <= budget), 1).otherwise(0).cast("long")
    rows = sizes.select("grp", F.col("n").cast("long").alias("n")).withColumn("first", first)
    rows = rows.withColumn("room", F.col("n") - F.col("first")).withColumn("rooms", F.sum("room").over(whole))
    rows = rows.withColumn("left", F.least(F.lit(budget).cast("long"), F.sum("n").over(whole)) - F.sum("first").over(whole))
    share = F.when(F.col("rooms") > 0, F.col("left").cast("double") * F.col("room").cast("double") / F.greatest("rooms", F.lit(1)).cast("double")).otherwise(0.0)
    rows = rows.withColumn("share", share).withColumn("base", F.floor("share").cast("long"))
    rows = rows.withColumn("rest", F.col("left") - F.sum("base").over(whole))
    place = F.row_number().over(whole.orderBy(F.desc(F.col("share") - F.col("base")), "grp"))
    return rows.select("grp", "n", (F.col("first") + F.col("base") + F.when((place <= F.col("rest")) & (F.col("base") < F.col("room")), 1).otherwise(0)).cast("long").alias("take"))


def stratified_counts(sizes: DataFrame, budget: int) -> DataFrame:
    """One for each class, the rest in proportion; fewer than the classes is an error."""
    if budget < sizes.count():
        raise ValueError("budget is smaller than the number of classes")
    return allocate(sizes, budget, min_one=True)
