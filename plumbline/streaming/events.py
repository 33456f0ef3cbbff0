"""Streaming forms of the job operators: the same expressions over unbounded input, with watermarks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, at: str, key: str, window: str = "7 days", late: str = "1 day") -> DataFrame:
    """(key, start, n) for tumbling windows; rows later than the watermark are dropped."""
    return (
        events.withWatermark(at, late).groupBy(F.window(at, window).alias("w"), key).agg(F.count("*").alias("n"))
        .select(key, F.col("w.start").alias("start"), "n")
    )


def dedupe(events: DataFrame, key: str, at: str, late: str = "1 day") -> DataFrame:
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def latest_by_key(keys: list[str], at: str, store: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that keeps a table of the newest row for each key; batch n writes version n from version n - 1, so a repeated batch does no harm."""

    def run(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        others = [c for c in batch.columns if c not in keys]
        every = batch if n == 0 else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{store}/{n - 1}"))
        newest = every.groupBy(*keys).agg(F.max_by(F.struct(*others), at).alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in others))
        newest.write.mode("overwrite").parquet(f"{store}/{n}")

    return run
