"""Deterministic Lloyd clustering: fitted on a bounded hash sample, assigned to all rows.

The fit takes FIT_ROWS rows at most whatever the table, so it runs on the driver; assignment is one
pass over all rows with the centres (MAX_CLUSTERS at most) sent along.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.seeding import first_by_hash, first_each, hash_order

FIT_ROWS, MAX_CLUSTERS, ROUNDS = 4000, 128, 5


def lloyd(points: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres after ``rounds``: starts at the first k points; ties go to the lower centre, a centre
    without points stays."""
    centres = points[: min(k, len(points))].astype(float).copy()
    for _ in range(rounds):
        d = ((points[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2) if len(points) * len(centres) * points.shape[1] < 1 << 24 else np.stack([((points - c) ** 2).sum(axis=1) for c in centres], axis=1)
        near = d.argmin(axis=1)
        for c in range(len(centres)):
            if (near == c).any():
                centres[c] = points[near == c].mean(axis=0)
    return centres


def fit(df: DataFrame, k: int, seed: int, features: str = "features", tie: str = "row_id", tag: str = "kmeans") -> np.ndarray:
    rows = first_by_hash(df.select(tie, features), hash_order(seed, tag, tie), FIT_ROWS, tie).collect()
    points = np.array([r[features] for r in rows], float)
    return lloyd(points, min(k, MAX_CLUSTERS)) if len(points) else np.zeros((0, 0))


def fit_groups(df: DataFrame, k: dict, seed: int, features: str = "features", tag: str = "kmeans") -> DataFrame:
    """(grp, centres) for each group of ``k``: the samples of all groups come in one job."""
    rows = df.where(F.col("grp").isin(list(k)))
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
    some = first_each(rows.select("grp", "row_id", features), hash_order(seed, tag, "row_id"), FIT_ROWS, ("grp",), sizes)
    by: dict = {}
    for r in some.withColumn("h", hash_order(seed, tag, "row_id")).orderBy("h", "row_id").collect():
        by.setdefault(r["grp"], []).append(r[features])
    found = [(g, [(i, [float(x) for x in c]) for i, c in enumerate(lloyd(np.array(x, float), min(k[g], MAX_CLUSTERS)))]) for g, x in by.items()]
    return df.sparkSession.createDataFrame(found, T.StructType([df.schema["grp"], *T._parse_datatype_string("centres array<struct<c:int,v:array<double>>>").fields]))


def nearest_in_group(df: DataFrame, centres: DataFrame, features: str = "features") -> DataFrame:
    """``df`` with the nearest centre c of its own group, and d2."""
    best = F.array_min(F.transform("centres", lambda c: F.struct(distance2(F.col(features), c["v"]).alias("d2"), c["c"].alias("c"))))
    return df.join(F.broadcast(centres), "grp").withColumn("__b", best).withColumns({"c": F.col("__b.c"), "d2": F.col("__b.d2")}).drop("__b", "centres")


def distance2(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def centres_table(spark, centres: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centres)], "c int, centre array<double>")


def distances(df: DataFrame, centres: DataFrame, features: str = "features", keep: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """(keep, c, d2) for every row and centre."""
    return df.join(F.broadcast(centres)).select(*keep, "c", distance2(features, "centre").alias("d2"))


def nearest(df: DataFrame, centres: np.ndarray, features: str = "features") -> DataFrame:
    """``df`` with its nearest centre c and d2: no shuffle, the centres are a literal."""
    literal = F.array(*[F.struct(F.lit(i).alias("c"), F.array(*[F.lit(float(x)) for x in c]).alias("v")) for i, c in enumerate(centres)])
    best = F.array_min(F.transform(literal, lambda c: F.struct(distance2(F.col(features), c["v"]).alias("d2"), c["c"].alias("c"))))
    return df.withColumn("__b", best).withColumn("c", F.col("__b.c")).withColumn("d2", F.col("__b.d2")).drop("__b")
