"""Class coverage of chosen contexts: a row of each class that is missing is swapped in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seeding import hash_order


def cover_classes(df: DataFrame, chosen: DataFrame, by: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """(by, row_id): ``chosen`` (by, row_id, protected) with every class of ``df`` in each context, if it has room.

    For each missing class its first row by hash comes in; out goes a row whose class has others in the
    context: unprotected ones first, then by hash.  A context of fewer rows than classes stays.
    Contexts keep their sizes; they are of bounded size, and classes are few.
    """
    classes = df.select("y").distinct()
    rows = chosen.join(df.select("row_id", "y"), "row_id").withColumn("h", hash_order(seed, "cover", *by, "row_id"))
    keys = list(by) or ["__all"]
    rows = rows if by else rows.withColumn("__all", F.lit(0))
    size = rows.groupBy(*keys).agg(F.count("*").alias("size"), F.collect_set("y").alias("have"))
    n = classes.agg(F.count("*").alias("classes"))
    lacking = size.join(F.broadcast(n)).where(F.col("size") >= F.col("classes")).join(F.broadcast(classes)).where(~F.array_contains("have", F.col("y"))).select(*keys, "y")
    fresh = df.select("row_id", "y").join(F.broadcast(lacking), "y").withColumn("h", hash_order(seed, "cover", *by, "row_id"))
    come = fresh.groupBy(*keys, "y").agg(F.min(F.struct("h", "row_id")).alias("m")).select(*keys, F.col("m.row_id").alias("row_id"))
    last = Window.partitionBy(*keys, "y").orderBy(F.desc("protected"), F.desc("h"), F.desc("row_id"))
    spare = rows.withColumn("z", F.row_number().over(last)).where("z > 1")
    spare = spare.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy("protected", "h", "row_id")))
    go = spare.join(F.broadcast(lacking.groupBy(*keys).agg(F.count("*").alias("m"))), keys).where(F.col("r") <= F.col("m")).select(*keys, "row_id")
    return rows.select(*keys, "row_id").join(F.broadcast(go), [*keys, "row_id"], "left_anti").unionByName(come).select(*by, "row_id")
