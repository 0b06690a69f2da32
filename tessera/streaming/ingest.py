"""Results that arrive as files: kept last by cell, appended without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.results import KEYS, RESULTS


def result_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Rows of result files as they come."""
    return spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def append_new(rows: DataFrame, path: str, checkpoint: str):
    """A query that adds each key once; a batch that is run again adds nothing.  The target is partitioned by
    dataset, and a batch is held against the keys of its own datasets only."""

    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        fresh = batch.dropDuplicates(KEYS)
        datasets = [r[0] for r in batch.select("dataset").distinct().collect()]
        try:
            have = spark.read.schema(RESULTS).parquet(path).where(F.col("dataset").isin(datasets)).select(*[F.col(k).alias(f"h_{k}") for k in KEYS]).distinct()
            on = F.lit(True)
            for k in KEYS:
                on = on & F.col(k).eqNullSafe(F.col(f"h_{k}"))
            fresh = fresh.join(have, on, "left_anti")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.select(*[f.name for f in RESULTS]).write.partitionBy("dataset").mode("append").parquet(path)
        batch.unpersist()

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_means(rows: DataFrame) -> DataFrame:
    """Mean and count of each method and metric so far."""
    return rows.groupBy("method", "metric").agg(F.avg("value").alias("mean"), F.count("*").alias("n"))
