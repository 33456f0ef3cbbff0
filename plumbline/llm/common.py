"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters outside this class (space, tab to carriage return).
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: With this Spark deletes what an action shuffled when the action ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of this machine's own only in local mode, where nobody else needs it."""
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None)
    if not named and not conf.get("spark.master", "local").startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or "file:///tmp/checkpoints"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Settings (dots as two underscores) for what is planned within, the former ones afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write `df` as Parquet in the shared folder and read it again.

    Unlike a cached table the files survive a lost executor, and their size is known to the planner.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/plumbline/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that `materialize` wrote, once nothing is left to be computed from it."""
    spark = df.sparkSession
    for folder in {f.rpartition("/")[0] for f in df.inputFiles() if "/plumbline/" in f}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only (doc_id, text), so that no other column of the caller can clash; a null text is the empty one."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_key(text: str = "text") -> Column:
    """Tells rows with the same doc_id but other texts apart."""
    return F.xxhash64(F.col(text)).alias("text_key")


def words_sql(text: str) -> str:
    """SQL for the array of words of a text column."""
    return rf"filter(split({text}, '[\\x20\\x09-\\x0D]+'), w -> w <> '')"


def partitions(spark: SparkSession, df: DataFrame) -> int:
    """Input splits of `df`: a number of tasks that grows with the data."""
    return max(df.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
