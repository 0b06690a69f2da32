"""Greedy choice from all rows of each group, one row a step.

A group of up to ONE_TASK rows goes through its steps in one task.  For larger ones each step is a
distributed maximum over all rows: a job whose result is one row a group, sent along with the next.
Both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tables import freed, written
from .cluster import distance2

#: Rows of a group that one task takes; steps after which the state of all rows is worked out and kept.
ONE_TASK, KEEP_EVERY = 4000, 16


def greedy(rows: DataFrame, by: tuple[str, ...], steps: str, start: float, update: Callable[[Column, Column], Column], score: Callable[[Column, int], Column], tie: tuple[str, ...], one_task: Callable, limit: int | None = None) -> DataFrame:
    """(by, row_id) of the rows chosen; rows: (by, row_id, features, ...).

    In each group as many rows as its column ``steps`` says, or all.  Step t takes the row of highest
    score(state, t), then lowest ``tie``; the state of a row starts at ``start`` and becomes
    update(state, squared distance to the row taken).  one_task does the same for a pandas group.
    """
    limit = ONE_TASK if limit is None else limit
    spark, rows = rows.sparkSession, written(rows, "candidates")
    schema = T.StructType([rows.schema[k] for k in (*by, "row_id")])
    sized = rows.groupBy(*by).agg(F.count("*").alias("n"), F.first(steps).alias("steps")).collect()
    left = {tuple(r[k] for k in by): min(r["n"], r["steps"]) for r in sized if r["n"] > limit}
    same = lambda a, b: [a[k].eqNullSafe(b[f"__{k}"]) for k in by]
    keys = lambda found, schema_: spark.createDataFrame(found, T.StructType([*[T.StructField(f"__{k}", rows.schema[k].dataType) for k in by], *schema_]))
    if not left:
        return rows.groupBy(*by).applyInPandas(one_task, schema)
    large = F.broadcast(keys(list(left), []))
    small = rows.join(large, same(rows, large), "left_anti").groupBy(*by).applyInPandas(one_task, schema)
    state = written(rows.join(large, same(rows, large), "left_semi").withColumns({"state": F.lit(float(start)), "taken": F.lit(False)}), "state")
    picks = T.StructField("picks", T.ArrayType(T.StructType([T.StructField("id", rows.schema["row_id"].dataType), T.StructField("v", T.ArrayType(T.DoubleType()))])))
    chosen, new = [], {k: [] for k in left}
    for t in range(max(left.values())):
        sent = F.broadcast(keys([(*k, v) for k, v in new.items() if left[k] > t], [picks]))
        now = state.join(sent, same(state, sent)).drop(*[f"__{k}" for k in by])
        now = now.withColumns({"state": F.aggregate("picks", F.col("state"), lambda s, p: update(s, distance2(F.col("features"), p["v"]))), "taken": F.col("taken") | F.exists("picks", lambda p: p["id"] == F.col("row_id"))}).drop("picks")
        if t and t % KEEP_EVERY == 0:
            last, state = state, written(now, "state")
            freed(last)
            now, new = state, {k: [] for k in left}
        best = now.where(~F.col("taken")).groupBy(*by).agg(F.min_by(F.struct("row_id", "features"), F.struct(-score(F.col("state"), t), *tie)).alias("b"))
        for r in best.collect():
            k = tuple(r[x] for x in by)
            chosen.append((*k, r["b"]["row_id"]))
            new[k].append((r["b"]["row_id"], [float(x) for x in r["b"]["features"]]))
    return small.unionByName(spark.createDataFrame(chosen, schema))
