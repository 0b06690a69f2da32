"""Seeded order without random streams: rows go by an md5 of seed, tag and row id.

The order is the same for any partitioning and in any engine that has md5.  Ranks in that order
are counted in buckets of hash prefixes, so that no rank of a whole table meets in one task.
The first k of a group are looked for among the rows whose hash, or whose score, is small enough.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that a bucket of ranks stands for; hexadecimal digits of a prefix, at most.
BUCKET_ROWS, MOST_DIGITS = 1 << 20, 6
#: Up to so many rows a group Spark limits groups before it shuffles them.
GROUP_LIMIT = 1000


def hash_order(seed: int, tag: str, *columns: str | Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(tag), *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]))


def unit(order: Column) -> Column:
    """An md5 as a number in [0, 1), in the same order."""
    return F.conv(F.substring(order, 1, 12), 16, 10).cast("double") / float(1 << 48)


def digits_for(n: int) -> int:
    """Prefix digits that leave a bucket some BUCKET_ROWS of ``n`` rows."""
    return max(2, min(MOST_DIGITS, math.ceil(math.log2(max(1, n / BUCKET_ROWS)) / 4)))


def ranked(df: DataFrame, order: Column, tie: str = "row_id", by: tuple[str, ...] = (), name: str = "rn", digits: int = 3) -> DataFrame:
    """``df`` with ``name``: place from 1 by (order, tie), inside each ``by``; order is an md5."""
    rows = df.withColumn("__h", order).withColumn("__b", F.substring("__h", 1, digits))
    sized = rows.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    # as many rows for each group as there are prefixes, at most
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    before = sized.select(*by, "__b", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", tie))
    on = ["__b", *by]
    return rows.join(before, on).withColumn(name, (F.col("__before") + inside).cast("long")).select(*df.columns, name)


def first_by_hash(df: DataFrame, order: Column, k: int, tie: str = "row_id") -> DataFrame:
    """The ``k`` first rows (a distributed top k)."""
    return df.withColumn("__h", order).orderBy("__h", tie).limit(k).select(*df.columns)


def first_each(df: DataFrame, order: Column, k: int | Column, by: tuple[str, ...], sizes: DataFrame, tie: str = "row_id") -> DataFrame:
    """The first ``k`` rows of each group by (order, tie); sizes: (by, n) for every group, few rows; k may be a
    column of ``sizes``.  Rows whose hash is beyond twice the share that k needs are left out before the shuffle;
    that enough are left is counted, and all rows are taken where they aren't."""
    want = F.lit(k) if isinstance(k, int) else k
    found = sizes.select(*by, want.cast("long").alias("__k"), F.least(F.lit(1.0), (2 * want + 64) / F.col("n")).alias("__share"), F.least(want, F.col("n")).cast("long").alias("__need"))
    known = found.collect()
    spread = df.sparkSession.createDataFrame(known, found.schema)
    rows = df.withColumn("__h", order).join(F.broadcast(spread), list(by))
    if any(r["__share"] < 1 for r in known):
        some = rows.where((F.col("__share") >= 1) | (unit(F.col("__h")) <= F.col("__share")))
        have = {tuple(r[k] for k in by): r["n"] for r in some.groupBy(*by).agg(F.count("*").alias("n")).collect()}
        if all(have.get(tuple(r[k] for k in by), 0) >= r["__need"] for r in known):
            rows = some
    place = F.row_number().over(Window.partitionBy(*by).orderBy("__h", tie))
    return rows.withColumn("__p", place).where(F.col("__p") <= F.col("__k")).select(*df.columns)


def least_each(df: DataFrame, score: Column, k: int, by: tuple[str, ...], tie: str = "row_id") -> DataFrame:
    """The ``k`` rows of least (score, tie) in each group.  Beyond GROUP_LIMIT a sketch of each group's scores
    gives a bound that k rows are under for certain, so that little more than k rows a group meet."""
    rows = df.withColumn("__s", score.cast("double"))
    if k > GROUP_LIMIT:
        steps, accuracy = 500, 20_000
        at = F.percentile_approx("__s", F.array(*[F.lit(i / steps) for i in range(1, steps + 1)]), F.lit(accuracy))
        cuts = rows.groupBy(*by).agg(at.alias("__at"), F.count("*").alias("__n"))
        # the sketch is off by one part in ``accuracy`` of the rows at most
        step = F.ceil((F.lit(k) / F.col("__n") + 2.0 / accuracy) * steps).cast("int")
        cuts = cuts.select(*by, F.when(step < steps, F.element_at("__at", F.greatest(step, F.lit(1)))).otherwise(float("inf")).alias("__cut"))
        rows = rows.join(F.broadcast(cuts), list(by)).where(F.col("__s") <= F.col("__cut"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("__s", tie))
    return rows.withColumn("__p", place).where(F.col("__p") <= k).select(*df.columns)
