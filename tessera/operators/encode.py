"""Labels, features, splits and priors as relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.seeding import digits_for, first_by_hash, hash_order, ranked
from .allocate import allocate

MISSING_LOGIT = -50.0


def encode_labels(df: DataFrame, label: str = "y") -> DataFrame:
    """Label codes 0.. in order: (label, code).  The labels of a table are few."""
    distinct = df.select(label).where(F.col(label).isNotNull()).distinct()
    return distinct.select(label, (F.row_number().over(Window.orderBy(label)) - 1).cast("int").alias("code"))


def fit_table_encoder(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, code) of text columns: codes in order of value."""
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").where("value is not null").distinct()
    return values.withColumn("code", (F.dense_rank().over(Window.partitionBy("column").orderBy("value")) - 1).cast("double"))


def apply_table_encoder(df: DataFrame, encoder: DataFrame, columns: list[str]) -> DataFrame:
    """Each column replaced by its code; values not seen at fit become null."""
    for c in columns:
        own = encoder.where(F.col("column") == c).select(F.col("value").alias(f"__{c}"), F.col("code").alias(f"__{c}_code"))
        df = df.join(own, F.col(c).cast("string") == F.col(f"__{c}"), "left").drop(f"__{c}").withColumn(c, F.col(f"__{c}_code")).drop(f"__{c}_code")
    return df


def to_numeric(df: DataFrame, id: str = "row_id") -> DataFrame:
    """Numbers and booleans as double, text as codes, nan as null."""
    kinds = dict(df.dtypes)
    text = [c for c, k in kinds.items() if k == "string" and c != id]
    out = apply_table_encoder(df, fit_table_encoder(df, text), text) if text else df
    plain = [c for c in df.columns if c not in text and c != id]
    return out.withColumns({c: F.nullif(F.col(c).cast("double"), F.lit(float("nan"))) for c in plain}).select(*df.columns)


def fill(column: Column, median: Column) -> Column:
    """Missing becomes the median, infinities 0."""
    x = F.coalesce(F.nanvl(column, median), median)
    return F.when(F.abs(x) == float("inf"), 0.0).otherwise(x)


def fit_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """(pos, median, mean, sd) of each column: median-filled, population sd, 0 becomes 1."""
    long = df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in columns])).alias("pos", "x"))
    medians = long.where(~F.isnan("x")).groupBy("pos").agg(F.percentile("x", F.lit(0.5)).alias("median"))
    filled = long.join(F.broadcast(medians), "pos").withColumn("x", fill(F.col("x"), F.col("median")))
    return filled.groupBy("pos").agg(F.first("median").alias("median"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).withColumn("sd", F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0))


def apply_features(df: DataFrame, fitted: DataFrame, columns: list[str], id: str = "row_id") -> DataFrame:
    """(id, features): standardised with what was fitted, on these or other rows."""
    row = fitted.groupBy().agg(F.sort_array(F.collect_list(F.struct("pos", "median", "mean", "sd"))).alias("fit"))
    values = F.array(*[F.col(c).cast("double") for c in columns])
    scaled = F.zip_with(values, "fit", lambda x, f: (fill(x, f["median"]) - f["mean"]) / f["sd"])
    return df.join(F.broadcast(row)).select(id, scaled.alias("features"))


def fit_projection(features: DataFrame, seed: int = 0, dims: int = 50, rows: int = 5000):
    """Principal components of standardised features (id, features) wider than ``dims``, fitted on a hash sample of
    at most ``rows``; None if they aren't wider."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    width = features.select(F.size("features")).first()
    if width is None or width[0] <= dims:
        return None
    id = features.columns[0]
    some = first_by_hash(features, hash_order(seed, "pca", id), rows, id).withColumn("v", array_to_vector("features"))
    return PCA(k=dims, inputCol="v", outputCol="p").fit(some)


def apply_projection(features: DataFrame, model) -> DataFrame:
    """(id, features) on the components; unchanged without a model."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    if model is None:
        return features
    return model.transform(features.withColumn("v", array_to_vector("features"))).withColumn("features", vector_to_array("p")).drop("v", "p")


def feature_transform(fit: DataFrame, columns: list[str], seed: int = 0, dims: int = 50, id: str = "row_id"):
    """A map from rows to (id, features): medians, scales and components are those of ``fit``."""
    scales = fit_features(fit, columns)
    model = fit_projection(apply_features(fit, scales, columns, id), seed, dims)
    return lambda rows: apply_projection(apply_features(rows, scales, columns, id), model)


def split_rows(df: DataFrame, seed: int, test_size: float = 0.3, label: str | None = "y", tie: str = "row_id") -> DataFrame:
    """``df`` with part 'train' or 'test': ceil(test_size * n) test rows, by class in proportion if
    every class has two rows or more (or ``label`` is None: over all)."""
    if label is not None:
        sizes = df.groupBy(F.col(label).alias("grp")).agg(F.count("*").alias("n"))
        small, total = sizes.agg(F.min("n"), F.sum("n")).first()
        if total and small >= 2:
            take = allocate(sizes, _ceil(test_size * total)).select(F.col("grp").alias(label), "take")
            return ranked(df, hash_order(seed, "split", tie), tie, (label,), digits=digits_for(total)).join(F.broadcast(take), label).withColumn("part", F.when(F.col("rn") <= F.col("take"), "test").otherwise("train")).select(*df.columns, "part")
    total = df.count()
    return ranked(df, hash_order(seed, "split", tie), tie, digits=digits_for(total)).withColumn("part", F.when(F.col("rn") <= _ceil(test_size * total), "test").otherwise("train")).select(*df.columns, "part")


def _ceil(x: float) -> int:
    return -int(-x // 1)


def groups_of(df: DataFrame, task: str, label: str = "y", bins: int = 10) -> DataFrame:
    """``df`` with grp: the class, or the bin of the target between its distinct inner quantiles."""
    if task == "classification":
        return df.withColumn("grp", F.col(label))
    at = [i / bins for i in range(1, bins)]
    edges = df.agg(F.array_distinct(F.percentile(label, F.array(*[F.lit(x) for x in at]))).alias("edges"))
    return df.join(F.broadcast(edges)).withColumn("grp", F.size(F.filter("edges", lambda e: e <= F.col(label)))).drop("edges")


def class_prior(df: DataFrame, classes: DataFrame, label: str = "y") -> DataFrame:
    """(cls, prior) for all classes, absent ones 0."""
    counts = df.groupBy(F.col(label).alias("cls")).agg(F.count("*").alias("n"))
    return classes.join(counts, "cls", "left").select("cls", (F.coalesce("n", F.lit(0)) / F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(F.lit(0)))).alias("prior"))


def align(out: DataFrame, classes: DataFrame, value: str = "logit", missing: float = MISSING_LOGIT, keys: tuple[str, ...] = ("row_id", "est")) -> DataFrame:
    """All classes for each key: those the model lacks get ``missing``."""
    grid = out.select(*keys).distinct().join(F.broadcast(classes.select("cls")))
    return grid.join(out, [*keys, "cls"], "left").withColumn(value, F.coalesce(value, F.lit(missing)))


def prior_correct(pred: DataFrame, context: DataFrame, target: DataFrame) -> DataFrame:
    """p * target / context prior, renormalised; context prior 0 gives 0; a row of sum 0 stays."""
    both = pred.join(F.broadcast(context.select("cls", F.col("prior").alias("c"))), "cls").join(F.broadcast(target.select("cls", F.col("prior").alias("t"))), "cls")
    w = Window.partitionBy("row_id")
    both = both.withColumn("q", F.when(F.col("c") > 0, F.col("p") * F.col("t") / F.when(F.col("c") > 0, F.col("c")).otherwise(1.0)).otherwise(0.0)).withColumn("s", F.sum("q").over(w))
    return both.select("row_id", "cls", F.when(F.col("s") > 0, F.col("q") / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).otherwise(F.col("p")).alias("p"))


def split_hash(test: DataFrame) -> DataFrame:
    """A short digest of the test ids: of the sums of two parts of each id's hash, whatever their order."""
    h = F.md5(F.col("row_id").cast("string"))
    part = lambda at: F.sum(F.conv(F.substring(h, at, 12), 16, 10).cast("decimal(20,0)")).cast("string")
    return test.agg(F.substring(F.sha1(F.concat_ws(":", F.count("*").cast("string"), part(1), part(13))), 1, 16).alias("test_hash"), F.count("*").alias("n"))
