"""The results table: schema, scans, appends, shards, caches and side files."""

from __future__ import annotations

import json
import logging
import os
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType(), "boolean": T.BooleanType()}


def _schema(text: str) -> T.StructType:
    """A flat schema; needs no session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in text.split(","))])


#: Columns of results, timings and failures.
RESULTS = _schema("experiment string, dataset string, split string, tier string, task string, seed int, method string, budget double, ratio double, n_train int, metric string, value double, backend string, role string, flags string, split_seed int, n_estimators int, budget_key string, cell string")
TIMING = _schema("cell string, dataset string, method string, budget double, n_estimators int, seed int, split_seed int, select_s double, fit_s double, predict_s double, total_s double, n_fits int, ingest_seq long")
FAILURES = _schema("cell string, dataset string, split_seed int, seed int, method string, budget double, error_type string, oom boolean, message string, ingest_seq long")
KEYS = ["experiment", "dataset", "split_seed", "seed", "method", "budget", "n_estimators", "metric", "budget_key"]


def read_results(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Schema on read; NaN is null, missing text is ''."""
    from ..operators.statistics import clean

    reader = spark.read.schema(RESULTS)
    return clean(reader.csv(path, header=True) if kind == "csv" else reader.parquet(path))


def append(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """Columns in order; the write commits whole or not at all."""
    out = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RESULTS]).write.mode("append")
    out.option("header", True).csv(path) if kind == "csv" else out.parquet(path)


def append_side(spark: SparkSession, rows: list[dict], schema: T.StructType, path: str) -> None:
    """Rows of a side table (timing, failures): a few at a time, as one small file."""
    spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema).coalesce(1).write.mode("append").parquet(path)


def read_side(spark: SparkSession, schema: T.StructType, *paths: str) -> DataFrame:
    """Side tables of those paths that there are; the last row of each cell."""
    out = spark.createDataFrame([], schema)
    for p in paths:
        if _files(spark, p):
            out = out.unionByName(spark.read.schema(schema).parquet(p))
    return keep_last(out)


def read_timing(spark: SparkSession, path: str) -> DataFrame:
    """Timings of a results path, the last of each cell."""
    return read_side(spark, TIMING, table_name(path, "timing"))


def _files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, on any file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return sorted(f.getPath().toString() for f in found) if found else []


def shard_paths(spark: SparkSession, path: str) -> list[str]:
    """Results of the shards of a path, without their side tables."""
    base = path.rstrip("/")
    return [f for f in _files(spark, f"{base}.shard*") if "." not in f.rsplit("/", 1)[-1].rsplit(".shard", 1)[-1]]


def merge(spark: SparkSession, path: str, shards: list[str] | None = None) -> DataFrame:
    """One results table of all shards of a path, with failures that are still open, timings and meta beside it."""
    shards = shards or shard_paths(spark, path)
    if not shards:
        raise FileNotFoundError(f"no shards of {path}")
    rows = merged_in_order(merge_shards([read_results(spark, s) for s in shards]))
    rows.write.mode("overwrite").parquet(path)
    out = read_results(spark, path)
    open_failures(read_side(spark, FAILURES, *[table_name(s, "failures") for s in shards]), out).write.mode("overwrite").parquet(table_name(path, "failures"))
    read_side(spark, TIMING, *[table_name(s, "timing") for s in shards]).write.mode("overwrite").parquet(table_name(path, "timing"))
    for s in shards:
        if _files(spark, table_name(s, "meta")):
            write_meta(spark, table_name(path, "meta"), read_meta(spark, table_name(s, "meta")))
            break
    return out


def keep_last(rows: DataFrame, key: str = "cell", order: str = "ingest_seq") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def open_failures(failures: DataFrame, results: DataFrame) -> DataFrame:
    """The last failure of each cell that has no result."""
    return keep_last(failures.join(results.select("cell").distinct(), "cell", "left_anti"))


def pending(cells: DataFrame, results: DataFrame, shard: int = 0, shards: int = 1) -> DataFrame:
    """Cells (cell_idx, cell) of a shard that aren't done."""
    return cells.where(F.pmod("cell_idx", F.lit(shards)) == shard).join(results.select("cell").distinct(), "cell", "left_anti")


def merge_shards(shards: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards).dropDuplicates([*KEYS, "cell"])


def merged_in_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("cell", "method", "metric", "n_estimators")


def unpivot_scores(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value) rows of wide scores."""
    return wide.unpivot(keys, metrics, "metric", "value")


def table_name(path: str, kind: str, shard: int | None = None) -> str:
    """Where a kind of side table (failures, timing, meta, analysis) of a results path lies."""
    base = path.rstrip("/")
    return base + (f".shard{shard}" if shard is not None else "") + ("" if kind == "results" else f".{kind}")


def canonical(value) -> str:
    """Text of a nested value that doesn't depend on the order of keys."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def cache_key(**parts) -> str:
    import hashlib

    return hashlib.sha256(canonical(parts).encode()).hexdigest()[:32]


class OutputCache:
    """Tables by key under a folder that the cluster shares."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, key: str) -> str:
        return f"{self.folder}/key={key}"

    def exists(self, key: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path(key) + "/_SUCCESS")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def get(self, key: str) -> DataFrame | None:
        return self.spark.read.parquet(self.path(key)) if self.exists(key) else None

    def put(self, key: str, rows: DataFrame) -> DataFrame:
        rows.write.mode("overwrite").parquet(self.path(key))
        return self.spark.read.parquet(self.path(key))

    def get_or_put(self, key: str, make) -> DataFrame:
        got = self.get(key)
        return got if got is not None else self.put(key, make())


def write_meta(spark: SparkSession, path: str, meta: dict) -> None:
    """Written beside and moved into place, so a reader sees the old text or the new one."""
    fresh = f"{path.rstrip('/')}.new-{uuid.uuid4().hex}"
    spark.createDataFrame([(canonical(meta),)], "meta string").coalesce(1).write.text(fresh)
    new, old = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (fresh, path))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(old, True)
    if not fs.rename(new, old):
        raise OSError(f"{fresh} could not be moved to {path}")


def read_meta(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(path).collect()))


def setup_logging(name: str = "tessera", file: str | None = None) -> logging.Logger:
    """Log lines on the screen and, given a file, in it; once each however often it is called."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    form = logging.Formatter("%(asctime)s %(levelname)s %(message)s")
    have = {getattr(h, "baseFilename", "") for h in log.handlers}
    for key, make in [("", logging.StreamHandler)] + ([(os.path.abspath(file), lambda: logging.FileHandler(file))] if file else []):
        if key not in have:
            handler = make()
            handler.setFormatter(form)
            log.addHandler(handler)
    return log
