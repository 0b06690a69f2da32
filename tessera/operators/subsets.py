"""One context for each estimator: (est, row_id)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seeding import digits_for, first_each, hash_order, least_each, ranked, unit
from . import cluster
from .allocate import allocate, stratified_counts
from .encode import groups_of
from .greedy import greedy
from .selection import _cell_shares, strata

PER_ESTIMATOR: dict[str, Callable] = {}


def per_estimator(name: str):
    def add(f):
        PER_ESTIMATOR[name] = f
        return f

    return add


def subsets(df: DataFrame, method: str, budget: int, estimators: int, seed: int = 0, task: str = "classification", **options) -> DataFrame:
    if method not in PER_ESTIMATOR:
        raise KeyError(f"unknown method {method}; there are {', '.join(sorted(PER_ESTIMATOR))}")
    return PER_ESTIMATOR[method](df, budget, estimators, seed, task, **options)


def _each(df: DataFrame, estimators: int) -> DataFrame:
    return df.withColumn("est", F.explode(F.sequence(F.lit(0), F.lit(estimators - 1))))


@per_estimator("perest_random")
def perest_random(df, budget, estimators, seed, task="classification", tag="est"):
    sizes = df.sparkSession.range(estimators).select(F.col("id").cast("int").alias("est"), F.lit(df.count()).alias("n"))
    return first_each(_each(df.select("row_id"), estimators), hash_order(seed, tag, "est", "row_id"), budget, ("est",), sizes).select("est", "row_id")


@per_estimator("perest_partition")
def perest_partition(df, budget, estimators, seed, task="classification"):
    """Windows of one cyclic order; together they cover all rows if estimators * budget allows."""
    n = df.count()
    if budget >= n:
        return _each(df.select("row_id"), estimators).select("est", "row_id")
    step = n / estimators if estimators * budget >= n else float(budget)
    rows = _each(ranked(df.select("row_id"), hash_order(seed, "partition", "row_id"), digits=digits_for(n)), estimators)
    return rows.where(F.pmod(F.col("rn") - 1 - F.floor(F.col("est").cast("double") * step), F.lit(n)) < budget).select("est", "row_id")


def _by_group(rows: DataFrame, take: DataFrame, by: tuple[str, ...], estimators: int, order) -> DataFrame:
    sizes = _each(rows.groupBy(*by).agg(F.count("*").alias("n")).join(F.broadcast(take), list(by)), estimators)
    return first_each(_each(rows.select("row_id", *by), estimators), order, F.col("take"), ("est", *by), sizes).select("est", "row_id")


@per_estimator("perest_stratified")
def perest_stratified(df, budget, estimators, seed, task="classification"):
    rows = groups_of(df, task, bins=min(budget, 100))
    take = allocate(rows.groupBy("grp").agg(F.count("*").alias("n")), budget, min_one=task == "classification").select("grp", "take")
    return _by_group(rows, take, ("grp",), estimators, hash_order(seed, "perest_stratified", "est", "row_id"))


@per_estimator("perest_representative")
def perest_representative(df, budget, estimators, seed, task="classification", n_cells=32):
    rows = strata(df, budget, seed, task, n_cells)
    return _by_group(rows, _cell_shares(rows, budget, task == "classification"), ("grp", "cell"), estimators, hash_order(seed, "perest_representative", "est", "row_id"))


def _kcenter(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["h", "row_id"], kind="stable").reset_index(drop=True)
    x = np.stack(pdf["features"].to_numpy())
    n = min(int(pdf["take"].iloc[0]), len(x))
    chosen, far = [], np.full(len(x), np.inf)
    for _ in range(n):
        at = int(far.argmax()) if chosen else 0
        chosen.append(at)
        far = np.minimum(far, ((x - x[at]) ** 2).sum(axis=1))
        far[at] = -1
    return pdf.loc[chosen, ["est", "grp", "row_id"]]


@per_estimator("perest_kcenter")
def perest_kcenter(df, budget, estimators, seed, task="classification", one_task=None):
    """Greedy farthest-point cover of all rows of each group; the first by hash, of equally far
    ones too."""
    rows = groups_of(df, task)
    take = allocate(rows.groupBy("grp").agg(F.count("*").alias("n")), budget, min_one=True).select("grp", "take")
    every = _each(rows.select("row_id", "grp", "features"), estimators).join(F.broadcast(take), "grp").where(F.col("take") > 0)
    every = every.withColumn("h", hash_order(seed, "kcenter", "est", "row_id"))
    return greedy(every, ("est", "grp"), "take", float("inf"), F.least, lambda far, t: far, ("h", "row_id"), _kcenter, one_task).select("est", "row_id")


@per_estimator("cluster_experts")
def cluster_experts(df, budget, estimators, seed, task="classification"):
    """Estimator e gets rows of cluster e by hash, then the nearest others; every class is in."""
    centres = cluster.fit(df, estimators, seed, tag="experts")
    rows = cluster.nearest(df, centres).withColumnRenamed("c", "own").drop("d2")
    every = cluster.distances(rows, cluster.centres_table(df.sparkSession, centres), keep=("row_id", "y", "own")).withColumnRenamed("c", "est")
    every = every.withColumn("h", hash_order(seed, "experts", "est", "row_id"))
    home = F.col("own") == F.col("est")
    score = F.when(home, unit(F.col("h")) - 1).otherwise(F.col("d2"))
    if task == "classification":
        first = every.groupBy("est", "y").agg(F.min(F.struct("h", "row_id")).alias("m")).select("est", F.col("m.row_id").alias("id"))
        cover = F.broadcast(first.groupBy("est").agg(F.collect_list("id").alias("cover")))
        every = every.join(cover, "est")
        score = F.when(F.array_contains("cover", F.col("row_id")), score - 1e18).otherwise(score)
    return least_each(every, score, budget, ("est",)).select("est", "row_id")


def passes(n: int, k: int, estimators: int) -> list[tuple[int, int, int, int]]:
    """(pass, est, from, to): a pool of n rows is drawn from in turn; when it ends inside a draw the
    next pass leaves out what the draw has.  Places are from 0."""
    out, number, at, size = [], 0, 0, n
    for est in range(estimators):
        need = k
        if size - at >= need:
            out.append((number, est, at, at + need))
            at += need
            continue
        taken = size - at
        if taken:
            out.append((number, est, at, size))
        number, size, at = number + 1, n - taken, need - taken
        out.append((number, est, 0, at))
    return out


def pool_draws(df: DataFrame, k: int, estimators: int, seed: int, tag: str = "pool") -> DataFrame:
    """(est, row_id): rows are used about equally often (see ``passes``)."""
    n = df.count()
    if k >= n:
        return _each(df.select("row_id"), estimators).select("est", "row_id")
    plan = passes(n, k, estimators)
    ids, out, tail = df.select("row_id"), None, None
    for number in sorted({p[0] for p in plan}):
        left = ids.join(tail, "row_id", "left_anti") if tail is not None else ids
        order = ranked(left, hash_order(seed, f"{tag}{number}", "row_id"), digits=digits_for(n))
        own = [p for p in plan if p[0] == number]
        spans = F.array(*[F.struct(F.lit(e).alias("est"), F.lit(a).alias("a"), F.lit(b).alias("b")) for _, e, a, b in own])
        drawn = order.withColumn("s", F.explode(F.filter(spans, lambda s: (s["a"] < F.col("rn")) & (F.col("rn") <= s["b"])))).select(F.col("s.est").alias("est"), "row_id")
        out = drawn if out is None else out.union(drawn)
        nxt = [p for p in plan if p[0] == number + 1]
        tail = drawn.where(F.col("est") == nxt[0][1]).select("row_id") if nxt else None
        if tail is not None and not any(p[1] == nxt[0][1] for p in own):
            tail = None
    return out


def emulate_subsample(df: DataFrame, k: int | float, method: str, estimators: int, seed: int, task: str = "classification", given: DataFrame | None = None) -> DataFrame | None:
    """The model's own subsampling: auto, stratified, balanced, majority_downsample or given rows.
    A fraction k is int(k * n) + 1 rows; k of all rows or more: no subsampling (None)."""
    if method == "explicit":
        if given is None:
            raise ValueError("explicit subsampling needs its rows")
        return given.join(df.select("row_id"), "row_id", "left_semi").select("est", "row_id")
    n = df.count()
    k = int(k * n) + 1 if isinstance(k, float) else k
    if k >= n:
        return None
    if method == "auto":
        method = "stratified" if task == "classification" else "balanced"
    if method == "balanced":
        return pool_draws(df, k, estimators, seed)
    if task != "classification":
        raise ValueError(f"{method} needs classes")
    sizes = df.groupBy(F.col("y").alias("grp")).agg(F.count("*").alias("n"))
    counts = {r["grp"]: r["n"] for r in sizes.collect()}
    if method == "majority_downsample":
        top = max(counts.values())
        if sum(c == top for c in counts.values()) == 1:
            major = max(counts, key=counts.get)
            whole = _each(df.where(F.col("y") != F.lit(major)).select("row_id"), estimators).select("est", "row_id")
            if k <= n - top:
                raise ValueError(f"{k} rows must exceed the {n - top} rows outside the largest class")
            return whole.union(pool_draws(df.where(F.col("y") == F.lit(major)), k - (n - top), estimators, seed))
        method = "stratified"
    if method != "stratified":
        raise ValueError(f"unknown subsampling {method}")
    out = None
    for row in sorted(stratified_counts(sizes, k).collect(), key=lambda r: str(r["grp"])):
        own = pool_draws(df.where(F.col("y") == F.lit(row["grp"])), row["take"], estimators, seed, f"pool:{row['grp']}:")
        out = own if out is None else out.union(own)
    return out


def context_key(contexts: DataFrame) -> DataFrame:
    """(est, key): a digest of each estimator's rows, for cache keys: sums of two parts of each id's hash, so rows
    add up where they are."""
    h = F.md5(F.col("row_id").cast("string"))
    part = lambda at: F.sum(F.conv(F.substring(h, at, 12), 16, 10).cast("decimal(20,0)")).cast("string")
    return contexts.groupBy("est").agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.count("*").cast("string"), part(1), part(13)), 256).alias("key")).select("est", "key", "n")
