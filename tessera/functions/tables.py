"""Intermediate tables written to the folder that the cluster shares: they cut lineage and outlive executors."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); a temporary one only in
    local mode, where driver and executors are one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has gone; the folder's owner cleans up
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (out, path)
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextmanager
def scratch():
    """Tables written inside are deleted at its end."""
    _scopes.append([])
    try:
        yield
    finally:
        freed(*_scopes.pop())


_scopes: list[list[DataFrame]] = []


_paths: dict[int, tuple[DataFrame, str]] = {}


def freed(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made; nothing may read them any more."""
    for t in tables:
        _, path = _paths.pop(id(t), (None, None))
        if path:
            _remove(t.sparkSession, path)
