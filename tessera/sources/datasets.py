"""Datasets from specifications: parquet, csv, json, tables, synthetic; filters and bounded samples."""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.seeding import first_by_hash, hash_order

SOURCES = {}


def source(name: str):
    return lambda f: SOURCES.setdefault(name, f)


def load_dataset(spark: SparkSession, spec: dict) -> DataFrame:
    """The spec's rows without null targets, at most max_rows of them."""
    kind = spec.get("source")
    if kind not in SOURCES:
        raise ValueError(f"unknown source {kind}; there are {', '.join(sorted(SOURCES))}")
    rows = SOURCES[kind](spark, spec)
    if spec.get("target"):
        rows = drop_null_target(rows, spec["target"])
    return limit_rows(rows, spec["max_rows"], spec.get("seed", 0), spec.get("id", "row_id")) if spec.get("max_rows") else rows


@source("parquet")
def _parquet(spark, spec):
    return spark.read.parquet(spec["path"])


@source("csv")
def _csv(spark, spec):
    return spark.read.schema(spec["schema"]).csv(spec["path"], header=True)


@source("json")
def _json(spark, spec):
    return spark.read.schema(spec["schema"]).json(spec["path"])


@source("table")
def _named(spark, spec):
    return spark.table(spec["table"])


@source("synthetic")
def _synthetic(spark, spec):
    return make_synthetic(spark, **{k: v for k, v in spec.items() if k in ("n", "n_features", "n_classes", "task", "noise", "seed", "heavy_tail", "imbalance")})


def drop_null_target(rows: DataFrame, target: str) -> DataFrame:
    """Null, NaN and the text 'nan' are no targets."""
    return rows.where(F.col(target).isNotNull() & (F.lower(F.col(target).cast("string")) != "nan"))


def limit_rows(rows: DataFrame, n: int, seed: int, id: str = "row_id") -> DataFrame:
    return first_by_hash(rows, hash_order(seed, "max_rows", id), n, id)


def uniform(seed: int, tag: str, *columns) -> F.Column:
    """In (0, 1), from 12 hexadecimal digits of an md5."""
    return (F.conv(F.substring(hash_order(seed, tag, *columns), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def normal(seed: int, tag: str, *columns):
    return F.sqrt(-2 * F.ln(uniform(seed, tag + "a", *columns))) * F.cos(2 * math.pi * uniform(seed, tag + "b", *columns))


def make_synthetic(spark: SparkSession, n: int, n_features: int = 5, n_classes: int = 2, task: str = "classification", imbalance: list[float] | None = None, noise: float = 0.0, seed: int = 0, heavy_tail: bool = False) -> DataFrame:
    """(row_id, y, features).  Classes are Gaussian blobs with given shares and flipped labels (each class
    has two rows at least); regression is a linear part, a wave and a square, with noise."""
    ids = spark.range(n).withColumnRenamed("id", "row_id")
    z = F.array(*[normal(seed, f"x{j}", "row_id") for j in range(n_features)])
    if task == "regression":
        w = [math.cos(1.7 * j + seed) for j in range(n_features)]
        rows = ids.withColumn("features", z)
        line = sum((F.col("features")[j] * w[j] for j in range(n_features)), F.lit(0.0)) / math.sqrt(n_features)
        wave = F.sin(2 * F.col("features")[0]) + 0.5 * F.col("features")[min(1, n_features - 1)] ** 2
        e = normal(seed, "e", "row_id")
        e = e / F.sqrt(-F.ln(uniform(seed, "t", "row_id"))) if heavy_tail else e
        return rows.select("row_id", (line + wave + noise * e).alias("y"), "features")
    shares = imbalance or [1 / n_classes] * n_classes
    total, run, pick = sum(shares), 0.0, F.lit(n_classes - 1)
    u = uniform(seed, "class", "row_id")
    for c in reversed(range(n_classes)):
        run = sum(shares[: c + 1]) / total
        pick = F.when(u < run, F.lit(c)).otherwise(pick)
    first = F.when(F.col("row_id") < 2 * n_classes, (F.col("row_id") % n_classes).cast("int")).otherwise(pick)
    rows = ids.withColumn("c", first)
    centre = F.array(*[F.cos(F.col("c") * (2.0 + j) + seed) * 2.0 for j in range(n_features)])
    flip = (uniform(seed, "flip", "row_id") < noise) & (F.col("row_id") >= 2 * n_classes)
    y = F.when(flip, (F.col("c") + 1 + F.floor(uniform(seed, "to", "row_id") * max(1, n_classes - 1)).cast("int")) % n_classes).otherwise(F.col("c"))
    return rows.select("row_id", y.cast("int").alias("y"), F.zip_with(centre, z, lambda a, b: a + b).alias("features"))


def describe(df: DataFrame, target: str, columns: list[str]) -> DataFrame:
    """One row: rows, features, share missing, distinct targets, least and greatest target."""
    missing = sum((F.count_if(F.col(c).isNull()) for c in columns), F.lit(0))
    return df.agg(F.count("*").alias("n_rows"), F.lit(len(columns)).alias("n_features"), (missing / (F.count("*") * len(columns))).alias("missing"), F.count_distinct(target).alias("n_targets"), F.min(F.col(target)).alias("low"), F.max(F.col(target)).alias("high"))


def describe_all(spark: SparkSession, config: dict) -> DataFrame:
    """A row for each dataset of a configuration: sizes, target and problems; one that can't be read is a row too."""
    out = []
    for spec in config["datasets"]:
        task, target, problems = spec.get("task", "classification"), spec.get("target", "y"), []
        row = {"dataset": spec["name"], "split": spec.get("split", "dev"), "task": task}
        try:
            rows = load_dataset(spark, spec)
            columns = [c for c in rows.columns if c not in (target, spec.get("id", "row_id"))]
            d = describe(rows, target, columns).first()
            n = d["n_rows"]
            train = round(n * (1 - config.get("test_size", 0.3)))
            if task == "classification":
                least = rows.groupBy(target).count().agg(F.min("count")).first()[0] or 0
                said = f"{d['n_targets']} classes, smallest {least / max(n, 1):.1%}"
                problems += ["looks like a regression target or has a class of one row"] * (d["n_targets"] > 50 or least < 2)
            else:
                said = f"range {d['low']:.4g} to {d['high']:.4g}, {d['n_targets']} distinct"
                problems += ["fewer than 10 distinct targets"] * (d["n_targets"] < 10)
            large = [b for b in config.get("budget_absolute", []) if 2 * b >= train]
            problems += [f"budgets {large} need more than twice as many training rows"] * bool(large)
            row |= {"n_rows": n, "n_features": d["n_features"], "n_train": train, "missing": d["missing"], "target": said, "problems": "; ".join(problems)}
        except Exception as e:  # noqa: BLE001  every dataset is reported
            row["problems"] = f"{type(e).__name__}: {str(e)[:120]}"
        out.append(row)
    names = "dataset string, split string, task string, n_rows long, n_features int, n_train long, missing double, target string, problems string"
    return spark.createDataFrame([tuple(r.get(c.split()[0]) for c in names.split(", ")) for r in out], names)


@lru_cache(maxsize=64)
def cached(spark: SparkSession, key: tuple) -> DataFrame:
    """A dataset by its specification (sorted items), kept in memory."""
    return load_dataset(spark, dict(key)).cache()
