"""Row selection: every selector returns distinct rows of the table, min(budget, rows) of them, the
same for a seed, with every class present if the budget allows (but for ``random``)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.seeding import first_by_hash, hash_order, least_each, ranked, unit
from ..functions.tables import written
from . import cluster
from .allocate import allocate
from .coverage import cover_classes
from .encode import groups_of

SELECTORS: dict[str, Callable] = {}
#: Selectors that change class shares, and those that don't promise every class.
PRIOR_SHIFTING, COVERAGE_EXEMPT = {"balanced", "uncertainty_mix"}, {"random"}
CELL_ROWS, TARGET_BINS = 5, 100


def selector(name: str):
    def add(f):
        SELECTORS[name] = f
        return f

    return add


def select_context(df: DataFrame, method: str, budget: int, seed: int = 0, task: str = "classification", **options) -> DataFrame:
    """Rows of ``df`` (row_id, y, perhaps features) that the method picks."""
    if not isinstance(budget, int) or isinstance(budget, bool) or budget <= 0:
        raise ValueError("budget must be a positive whole number")
    if method not in SELECTORS:
        raise KeyError(f"unknown method {method}; there are {', '.join(sorted(SELECTORS))}")
    return SELECTORS[method](df, budget, seed, task, **options)


def method_info(method: str) -> dict[str, bool]:
    return {"prior_shifting": method in PRIOR_SHIFTING, "covers_classes": method not in COVERAGE_EXEMPT}


@selector("full")
def full(df, budget=None, seed=0, task="classification"):
    return df


@selector("random")
def random(df, budget, seed, task="classification"):
    return first_by_hash(df, hash_order(seed, "random", "row_id"), budget)


def _taken(df: DataFrame, sizes: DataFrame, order, by: tuple[str, ...], columns) -> DataFrame:
    """The first ``take`` rows of each group, in hash order."""
    return ranked(df, order, "row_id", by).join(F.broadcast(sizes), list(by)).where(F.col("rn") <= F.col("take")).select(*columns)


@selector("stratified")
def stratified(df, budget, seed, task="classification", bins=TARGET_BINS, tag="stratified"):
    """Shares of classes kept, one row of each at least; for regression shares of target bins."""
    rows = groups_of(df, task, bins=min(budget, bins))
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
    take = allocate(sizes, budget, min_one=task == "classification").select("grp", "take")
    return _taken(rows, take, hash_order(seed, tag, "row_id"), ("grp",), df.columns)


@selector("balanced")
def balanced(df, budget, seed, task="classification"):
    """As equal as sizes allow: levels of one row a group, the last level in a seeded group order."""
    rows = groups_of(df, task)
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n")).withColumn("g", hash_order(seed, "group", "grp"))
    # groups (few) by size: those up to one are taken whole while the rest can have as many rows each
    one = Window.partitionBy(F.lit(0))
    up = one.orderBy("n", "g")
    below = F.coalesce(F.sum("n").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.count("*").over(one) - F.row_number().over(up) + 1
    each = sizes.select("grp", "g", "n", below.alias("below"), rest.alias("rest"))
    level = F.max(F.when(F.col("below") + F.col("n") * F.col("rest") > budget, F.floor((F.lit(budget) - F.col("below")) / F.col("rest"))).otherwise(F.col("n"))).over(one)
    each = each.withColumn("level", F.greatest(level, F.lit(0)))
    each = each.withColumn("left", F.lit(budget) - F.sum(F.least("n", "level")).over(one))
    each = each.withColumn("more", F.row_number().over(one.orderBy(F.when(F.col("n") > F.col("level"), 0).otherwise(1), "g")))
    take = each.select("grp", (F.least("n", "level") + F.when((F.col("n") > F.col("level")) & (F.col("more") <= F.col("left")), 1).otherwise(0)).alias("take"))
    return _taken(rows, take, hash_order(seed, "balanced", "row_id"), ("grp",), df.columns)


def nested(df: DataFrame, budgets: list[int], seed: int) -> DataFrame:
    """(row_id, budget): prefixes of one order, so smaller budgets are inside larger ones; one pass."""
    top = F.array(*[F.lit(int(b)) for b in sorted(budgets)])
    return ranked(df.select("row_id"), hash_order(seed, "nest", "row_id")).select("row_id", F.explode(F.filter(top, lambda b: b >= F.col("rn"))).alias("budget"))


@selector("nested")
def nested_random(df, budget, seed, task="classification"):
    return first_by_hash(df, hash_order(seed, "nest", "row_id"), budget)


def strata(df: DataFrame, budget: int, seed: int, task: str, n_cells: int = 32) -> DataFrame:
    """``df`` with grp (class or bin) and cell: clusters inside a group, as many as its share of the
    budget has CELL_ROWS rows for.  Groups are few (classes, or ten bins)."""
    rows = groups_of(df, task)
    sizes = allocate(rows.groupBy("grp").agg(F.count("*").alias("n")), budget, min_one=task == "classification").where("take > 0").collect()
    cells = {r["grp"]: max(1, min(n_cells, r["take"] // CELL_ROWS, r["n"])) for r in sizes}
    if not cells:
        return rows.withColumn("cell", F.lit(0))
    return cluster.nearest_in_group(rows, cluster.fit_groups(rows, cells, seed, tag="cells")).withColumnRenamed("c", "cell").drop("d2")


def _cell_shares(rows: DataFrame, budget: int, min_one: bool) -> DataFrame:
    """(grp, cell, take): the budget over groups, then each group's over its cells."""
    cells = rows.groupBy("grp", "cell").agg(F.count("*").alias("n"))
    by_group = allocate(cells.groupBy("grp").agg(F.sum("n").alias("n")), budget, min_one).select("grp", F.col("take").alias("own"))
    w = Window.partitionBy("grp")
    part = cells.join(by_group, "grp").withColumn("share", F.col("own").cast("double") * F.col("n").cast("double") / F.sum("n").over(w).cast("double")).withColumn("base", F.floor("share").cast("long"))
    rest = F.col("own") - F.sum("base").over(w)
    place = F.row_number().over(w.orderBy(F.desc(F.col("share") - F.col("base")), "cell"))
    return part.select("grp", "cell", (F.col("base") + F.when((place <= rest) & (F.col("base") < F.col("n")), 1).otherwise(0)).alias("take"))


@selector("representative")
def representative(df, budget, seed, task="classification", n_cells=32):
    """In proportion over class and cluster."""
    rows = strata(df, budget, seed, task, n_cells)
    take = _cell_shares(rows, budget, task == "classification")
    return _taken(rows, take, hash_order(seed, "representative", "row_id"), ("grp", "cell"), df.columns)


@selector("kmeans_stratified")
def kmeans_stratified(df, budget, seed, task="classification"):
    """For each class one cluster a row of its budget: nearest row first, the rest by hash."""
    rows = groups_of(df, task)
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"))
    take = {r["grp"]: r["take"] for r in allocate(sizes, budget, min_one=True).collect()}
    own = cluster.nearest_in_group(rows, cluster.fit_groups(rows, {g: max(1, t) for g, t in take.items()}, seed, tag="kmeans"))
    own = own.withColumn("h", hash_order(seed, "fill", "row_id"))
    lead = own.groupBy("grp", "c").agg(F.min(F.struct("d2", "row_id")).alias("m")).select("grp", F.col("m.row_id").alias("lead"))
    near = F.broadcast(lead.groupBy("grp").agg(F.collect_list("lead").alias("leads")))
    own = own.join(near, "grp").withColumn("late", F.when(F.array_contains("leads", F.col("row_id")), 0).otherwise(1))
    taken = df.sparkSession.createDataFrame([(g, int(t)) for g, t in take.items()], T.StructType([own.schema["grp"], T.StructField("take", T.LongType())]))
    place = F.row_number().over(Window.partitionBy("grp").orderBy("late", "h", "row_id"))
    # a group's later rows are known by hash alone, so only so many of them can be among its budget
    most = max(take.values(), default=1)
    some = least_each(own, F.col("late") + unit(F.col("h")), most, ("grp",)) if most else own
    return some.withColumn("p", place).join(F.broadcast(taken), "grp").where(F.col("p") <= F.col("take")).select(*df.columns)


def embedded(df: DataFrame, seed: int, task: str, pilot: int = 1000, backend: object = None, estimators: int = 1) -> DataFrame:
    """``df`` with features as the backend sees them: fitted on a pilot sample, the mean over estimators."""
    some = first_by_hash(df, hash_order(seed, "embed", "row_id"), pilot)
    seen = backend.embed(some, df, seed, task, estimators)
    return df.drop("features").join(seen.select("row_id", "features"), "row_id").select(*df.columns)


@selector("embedding_kmeans")
def embedding_kmeans(df, budget, seed, task="classification", pilot=1000, backend=None, estimators=1):
    """One cluster a row of the budget (MAX_CLUSTERS at most) over the embedding, classes apart or not."""
    rows = df if backend is None else embedded(df, seed, task, pilot, backend, estimators)
    own = cluster.nearest(rows, cluster.fit(rows, budget, seed, tag="embedding")).withColumn("h", hash_order(seed, "fill", "row_id"))
    ids = lambda key, first: F.broadcast(own.groupBy(key).agg(F.min(first).alias("m")).agg(F.collect_list("m.row_id").alias(f"{key}_ids")))
    own = own.join(ids("c", F.struct("d2", "row_id"))).withColumn("late", F.when(F.array_contains("c_ids", F.col("row_id")), 0).otherwise(1))
    own = own.join(ids("y", F.struct("h", "row_id"))) if task == "classification" else own.withColumn("y_ids", F.array().cast("array<long>"))
    own = own.withColumn("cover", F.when(F.array_contains("y_ids", F.col("row_id")), 0).otherwise(1))
    kept = own.orderBy("cover", "late", "h", "row_id").limit(budget)
    return kept.select(*df.columns) if backend is None else df.join(kept.select("row_id"), "row_id", "left_semi")


def uncertainty(df: DataFrame, seed: int, task: str, pilot: int = 500, trees: int = 20) -> DataFrame:
    """(row_id, score): entropy of a forest fitted on a pilot sample, or spread of its trees' answers."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import StringIndexer
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.regression import RandomForestRegressor

    rows = df.withColumn("v", array_to_vector("features"))
    some = first_by_hash(rows, hash_order(seed, "pilot", "row_id"), pilot)
    if task == "classification":
        index = StringIndexer(inputCol="y_text", outputCol="label", stringOrderType="alphabetAsc").fit(some.withColumn("y_text", F.col("y").cast("string")))
        model = RandomForestClassifier(featuresCol="v", labelCol="label", numTrees=trees, seed=seed, maxDepth=6).fit(index.transform(some.withColumn("y_text", F.col("y").cast("string"))))
        p = model.transform(rows).withColumn("p", vector_to_array("probability"))
        return p.select("row_id", F.aggregate("p", F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.ln(x)).otherwise(0.0)).alias("score"))
    model = RandomForestRegressor(featuresCol="v", labelCol="y", numTrees=trees, seed=seed, maxDepth=6).fit(some)
    centre = some.agg(F.avg("y")).first()[0]
    return model.transform(rows).select("row_id", F.abs(F.col("prediction") - F.lit(centre)).alias("score"))


@selector("uncertainty_mix")
def uncertainty_mix(df, budget, seed, task="classification", frac_hard=0.5, pilot=500):
    """The rows a pilot forest is least sure of, and a random rest; every class is in."""
    hard = uncertainty(df, seed, task, pilot).orderBy(F.desc("score"), "row_id").limit(round(frac_hard * budget)).select("row_id")
    rest = first_by_hash(df.select("row_id").join(hard, "row_id", "left_anti"), hash_order(seed, "rest", "row_id"), budget - round(frac_hard * budget))
    chosen = hard.withColumn("protected", F.lit(1)).union(rest.withColumn("protected", F.lit(0)))
    if task == "classification":
        # the forest is not fitted again for each side of the swap
        chosen = cover_classes(df, written(chosen, "uncertain"), (), seed)
    return df.join(chosen.select("row_id"), "row_id", "left_semi")


def canary_shuffled(df: DataFrame, budget: int, seed: int) -> DataFrame:
    """(row_id, y): a random context whose labels are dealt anew among its rows."""
    some = first_by_hash(df.select("row_id", "y"), hash_order(seed, "random", "row_id"), budget)
    a = ranked(some, hash_order(seed, "left", "row_id")).select("row_id", "rn")
    b = ranked(some, hash_order(seed, "right", "row_id")).select("y", "rn")
    return a.join(b, "rn").select("row_id", "y")


def resampled(df: DataFrame, factor: int, seed: int) -> DataFrame:
    """(context, row_id, copy): all rows, each ``factor`` times, a bootstrap of as many, and of one size."""
    ids = ranked(df.select("row_id"), hash_order(seed, "slot", "row_id"))
    n = df.count()
    times = F.explode(F.sequence(F.lit(0), F.lit(factor - 1))).alias("copy")
    whole = ids.select(F.lit("full").alias("context"), "row_id", F.lit(0).alias("copy"))
    dup = ids.select(F.lit(f"dup{factor}").alias("context"), "row_id", times)
    draw = F.pmod(F.conv(F.substring(hash_order(seed, "boot", "rn", "copy"), 1, 12), 16, 10).cast("long"), F.lit(max(n, 1))) + 1
    drawn = ids.select("rn", times).withColumn("draw", draw)
    hit = drawn.join(ids.select(F.col("rn").alias("draw"), "row_id"), "draw")
    boot = hit.select(F.lit(f"boot{factor}").alias("context"), "row_id", "copy")
    one = hit.where("copy = 0").select(F.lit("boot1").alias("context"), "row_id", "copy")
    return whole.union(dup).union(boot).union(one)
