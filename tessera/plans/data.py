"""Relations that the queries work on, made from the plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distribution as D
from ..operators.backends import CentroidBackend, HistogramBackend
from ..operators.encode import split_rows
from ..operators.subsets import subsets

ESTIMATORS, CONTEXT = 4, 200
REG_CELLS, REG_CONTEXT, REG_BINS = ["c0", "c1", "c2"], 80, 10
QUARTERS = [0.05, 0.25, 0.5, 0.75, 0.95]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("y"), F.col("embedding").cast("array<double>").alias("features"))


def orders(spark, sf) -> DataFrame:
    """Three classes and a price."""
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_orderstatus").alias("y"))


def prices(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("y"))


def graded(spark, sf) -> DataFrame:
    """Imbalanced classes."""
    return table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("y"))


def clf(spark, sf, validation: bool = False) -> dict[str, DataFrame]:
    """Outputs of the centroid model on the test rows (or on a part of the training rows)."""
    parts = split_rows(vectors(spark, sf), 0, 0.3)
    train, test = parts.where("part = 'train'").drop("part"), parts.where("part = 'test'").drop("part")
    if validation:
        again = split_rows(train, 1, 0.3)
        train, test = again.where("part = 'train'").drop("part"), again.where("part = 'test'").drop("part")
    context = subsets(train, "perest_random", CONTEXT, ESTIMATORS, 0)
    out = CentroidBackend(ESTIMATORS).clf_outputs(train, context, test)
    return {"train": train, "test": test, "context": context, "out": out, "truth": test.select("row_id", "y")}


def reg(spark, sf) -> dict[str, DataFrame]:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_retailprice").alias("y"), F.col("p_brand").alias("c0"), (F.col("p_size") % 5).cast("string").alias("c1"), F.substring("p_type", 1, 4).alias("c2"))
    parts = split_rows(part, 0, 0.3, None)
    train, test = parts.where("part = 'train'").drop("part"), parts.where("part = 'test'").drop("part")
    bins = D.borders(train, n=REG_BINS).select("bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"))
    context = subsets(train, "perest_random", REG_CONTEXT, len(REG_CELLS), 0)
    out = HistogramBackend(REG_CELLS).reg_outputs(train, context, test, bins)
    return {"train": train, "test": test, "bins": bins, "out": out, "truth": test.select("row_id", "y")}


def gate(out: DataFrame) -> DataFrame:
    """A fixed weight for each row and estimator."""
    return out.select("row_id", "est").distinct().withColumn("w", 1.0 + F.pmod(F.col("row_id") + F.col("est"), F.lit(3)))
