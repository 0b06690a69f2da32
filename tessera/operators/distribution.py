"""Piecewise-uniform densities over bins (bin, lo, hi), as scalar operations on relations.

With ``tails`` the outer bins are half-normal: scale is width / 0.67449.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TAIL = 0.67449


def borders(df: DataFrame, label: str = "y", n: int = 40) -> DataFrame:
    """(bin, lo, hi) between n + 1 target quantiles, distinct, with a margin of a tenth at both ends;
    fewer than three distinct ones: the target's range and 1 more at both ends."""
    at = F.array(*[F.lit(i / n) for i in range(n + 1)])
    q = df.agg(F.array_distinct(F.percentile(label, at)).alias("q"), F.min(label).cast("double").alias("a"), F.max(label).cast("double").alias("b"))
    margin = F.lit(0.1) * (F.col("b") - F.col("a"))
    inner = F.slice("q", F.lit(2), F.greatest(F.size("q") - 2, F.lit(0)))
    edges = F.when(F.size("q") < 3, F.array(F.col("a") - 1, F.col("b") + 1)).otherwise(F.concat(F.array(F.col("a") - margin), inner, F.array(F.col("b") + margin)))
    edged = q.select(edges.alias("e"))
    return edged.select("e", F.explode(F.sequence(F.lit(0), F.size("e") - 2)).alias("bin")).select("bin", F.element_at("e", F.col("bin") + 1).alias("lo"), F.element_at("e", F.col("bin") + 2).alias("hi"))


def bucket_means(bins: DataFrame, tails: bool = False) -> DataFrame:
    """(bin, lo, hi, mid)."""
    mid = (F.col("lo") + F.col("hi")) / 2.0
    if not tails:
        return bins.withColumn("mid", mid)
    w = Window.partitionBy(F.lit(0))
    shift = (F.col("hi") - F.col("lo")) / TAIL * math.sqrt(2 / math.pi)
    return bins.withColumn("mid", F.when(F.col("bin") == F.min("bin").over(w), F.col("hi") - shift).when(F.col("bin") == F.max("bin").over(w), F.col("lo") + shift).otherwise(mid))


def mean(p: DataFrame, bins: DataFrame, keys: tuple[str, ...] = ("row_id",), tails: bool = False) -> DataFrame:
    return p.join(F.broadcast(bucket_means(bins, tails).select("bin", "mid")), "bin").groupBy(*keys).agg((F.sum(F.col("p") * F.col("mid")) / F.sum("p")).alias("mean"))


def quantiles(p: DataFrame, bins: DataFrame, levels: list[float], keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """(keys, level, q): in the first bin whose running sum reaches the level, linearly; a bin without
    mass gives its left edge."""
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    run = p.join(F.broadcast(bins), "bin").withColumn("p", F.col("p") / F.sum("p").over(whole)).withColumn("cum", F.sum("p").over(w)).withColumn("top", F.max("bin").over(whole))
    # the sum before a bin is the last bin's; cum - p may differ in its last bit, and a level between them would be lost
    run = run.withColumn("last", F.lag("cum").over(Window.partitionBy(*keys).orderBy("bin")))
    before = F.col("cum") - F.col("p")
    wanted = F.array(*[F.lit(float(x)) for x in levels])
    # each level belongs to the bin that brings the sum to it (the last bin takes what rounding leaves)
    hit = F.filter(wanted, lambda q: (q <= F.col("cum")) & (F.col("last").isNull() | (q > F.col("last"))) | (F.col("bin") == F.col("top")) & (q > F.col("cum")))
    at = run.withColumn("level", F.explode(hit))
    inside = F.when(F.col("p") > 0, (F.col("level") - before) / F.when(F.col("p") > 0, F.col("p")).otherwise(1.0)).otherwise(0.0)
    q = F.col("lo") + F.least(F.greatest(inside, F.lit(0.0)), F.lit(1.0)) * (F.col("hi") - F.col("lo"))
    first = F.row_number().over(Window.partitionBy(*keys, "level").orderBy("bin"))
    return at.withColumn("q", q).withColumn("n", first).where("n = 1").select(*keys, "level", "q")


def log_density(p: DataFrame, bins: DataFrame, truth: DataFrame, tails: bool = False) -> DataFrame:
    """(row_id, log_density) of y in its bin (lo < y <= hi; beyond the ends the outer bins); no mass: -inf."""
    w = Window.partitionBy(F.lit(0))
    marked = bins.withColumn("first", F.col("bin") == F.min("bin").over(w)).withColumn("last", F.col("bin") == F.max("bin").over(w))
    inside = ((F.col("y") > F.col("lo")) | F.col("first")) & ((F.col("y") <= F.col("hi")) | F.col("last"))
    at = truth.join(F.broadcast(marked), inside).join(p, ["row_id", "bin"])
    flat = -F.ln(F.col("hi") - F.col("lo"))
    if tails:
        flat = F.when(F.col("first"), _half_normal(F.col("hi") - F.col("y"))).when(F.col("last"), _half_normal(F.col("y") - F.col("lo"))).otherwise(flat)
    return at.select("row_id", F.when(F.col("p") > 0, F.ln(F.when(F.col("p") > 0, F.col("p")).otherwise(1.0)) + flat).otherwise(float("-inf")).alias("log_density"))


def _half_normal(x: Column) -> Column:
    s = (F.col("hi") - F.col("lo")) / TAIL
    return F.when(x >= 0, 0.5 * math.log(2 / math.pi) - F.ln(s) - x * x / (2 * s * s)).otherwise(float("-inf"))


def translate(p: DataFrame, frm: DataFrame, to: DataFrame, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Probabilities on other bins: each source bin's mass by overlap; what lies beyond the ends of
    ``to`` goes to its outer bins."""
    w = Window.partitionBy(F.lit(0))
    f = frm.select(F.col("bin").alias("fb"), F.col("lo").alias("a"), F.col("hi").alias("b"))
    t = to.withColumn("first", F.col("bin") == F.min("bin").over(w)).withColumn("last", F.col("bin") == F.max("bin").over(w)).select(F.col("bin").alias("tb"), F.when(F.col("first"), float("-inf")).otherwise(F.col("lo")).alias("lo"), F.when(F.col("last"), float("inf")).otherwise(F.col("hi")).alias("hi"))
    share = f.join(F.broadcast(t), (F.col("a") < F.col("hi")) & (F.col("b") > F.col("lo"))).withColumn("share", (F.least("b", "hi") - F.greatest("a", "lo")) / (F.col("b") - F.col("a")))
    return p.withColumnRenamed("bin", "fb").join(F.broadcast(share.select("fb", "tb", "share")), "fb").groupBy(*keys, F.col("tb").alias("bin")).agg(F.sum(F.col("p") * F.col("share")).alias("p"))


#: Kinds of densities: uniform in every bin, or with half-normal tails.
KINDS = {"bar": False, "full_support": True}


@dataclass(frozen=True)
class Distribution:
    """Bins and whether their ends have tails; the functions above with both filled in."""

    kind: str
    bins: DataFrame

    @property
    def tails(self) -> bool:
        return KINDS[self.kind]

    def mean(self, p: DataFrame, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
        return mean(p, self.bins, keys, self.tails)

    def quantiles(self, p: DataFrame, levels: list[float], keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
        return quantiles(p, self.bins, levels, keys)

    def log_density(self, p: DataFrame, truth: DataFrame) -> DataFrame:
        return log_density(p, self.bins, truth, self.tails)

    def to_row(self) -> dict:
        """What ``from_row`` takes: the kind and the borders, which are few."""
        rows = self.bins.orderBy("bin").collect()
        return {"kind": self.kind, "borders": [float(r["lo"]) for r in rows] + [float(rows[-1]["hi"])]}


def make_distribution(spark: SparkSession, kind: str, edges: list[float]) -> Distribution:
    if kind not in KINDS:
        raise ValueError(f"unknown distribution {kind}; there are {', '.join(sorted(KINDS))}")
    if len(edges) < 2 or any(b <= a for a, b in zip(edges, edges[1:])):
        raise ValueError("borders must rise")
    return Distribution(kind, spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(edges, edges[1:]))], "bin int, lo double, hi double"))


def from_row(spark: SparkSession, row: dict) -> Distribution:
    return make_distribution(spark, row["kind"], row["borders"])


def to_arrays(out: DataFrame, value: str, axis: str) -> DataFrame:
    """Long outputs (row_id, est, axis, value) as one array a row and estimator, in the order of ``axis``."""
    packed = out.groupBy("row_id", "est").agg(F.sort_array(F.collect_list(F.struct(axis, value))).alias("x"))
    return packed.select("row_id", "est", F.transform("x", lambda s: s[axis]).alias(axis), F.transform("x", lambda s: s[value]).alias(value))


def from_arrays(arrays: DataFrame, value: str, axis: str) -> DataFrame:
    return arrays.select("row_id", "est", F.inline(F.arrays_zip(axis, value)))
