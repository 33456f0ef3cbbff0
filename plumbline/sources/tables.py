"""Stores on Parquet: upserts, partition replacement, caches, exports and checks on what was written."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """What `spark.checkpoint.dir` names; a folder of this machine's own only in local mode."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return named or "file:///tmp/checkpoints"


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` without its lineage, in the shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again: what several steps read is computed once."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/plumbline/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The schema's columns in order: missing ones are added as nulls, others dropped, types cast."""
    have = {f.name for f in df.schema}
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows whose key is not among the new, and the new ones (of repeated keys in `new` the last by `ord`, if there)."""
    if "ord" in new.columns:
        others = [c for c in new.columns if c not in keys]
        new = new.groupBy(*keys).agg(F.max_by(F.struct(*others), "ord").alias("r")).select(*keys, *(F.col(f"r.{c}").alias(c) for c in others if c != "ord"))
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*old.columns))


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Insert and do nothing on conflict."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Overwrite only the partitions that `df` has rows of."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def cache_misses(inputs: DataFrame, cache: DataFrame, stage: str) -> DataFrame:
    """Inputs with their `digest` that the cache (stage, digest) has no entry of."""
    names = sorted(inputs.columns)
    digest = F.sha2(F.concat(F.lit(f"{stage}:"), F.to_json(F.struct(*names))), 256)
    keyed = inputs.withColumn("digest", digest)
    return keyed.join(cache.where(F.col("stage") == stage).select("digest"), "digest", "left_anti")


def content_addressed(texts: DataFrame) -> DataFrame:
    """(hash, text): one row for each distinct text."""
    return texts.select(F.sha2("text", 256).alias("hash"), "text").groupBy("hash").agg(F.first("text").alias("text"))


def export_labelled(sources: dict[str, DataFrame], current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, excluded): all sources' rows whose digest is current, and counts (kind, reason, n) of the others."""
    parts = [d.select(F.lit(k).alias("kind"), "project", "check_id", "state", "digest") for k, d in sources.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    known = current.select("project", "check_id", F.col("digest").alias("now"))
    joined = every.join(known, ["project", "check_id"], "left")
    reason = F.when(F.col("now").isNull(), "no-current-input").when(F.col("now") != F.col("digest"), "stale")
    marked = joined.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("now", "reason"), marked.where("reason IS NOT NULL").groupBy("kind", "reason").agg(F.count("*").alias("n"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def eligible_pack(tables: dict[str, DataFrame], eligible: DataFrame, key: str) -> dict[str, DataFrame]:
    """Of each table only the rows of eligible keys."""
    return {name: d.join(eligible.select(key), key, "left_semi") for name, d in tables.items()}


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n)."""
    parts = [d.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, d in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def violations(df: DataFrame, keys: list[str] = (), domains: dict[str, list] = {}, required: list[str] = ()) -> DataFrame:  # noqa: B006
    """(rule, n) of a table: repeated keys, values outside their domain, nulls where a value is required."""
    parts = [df.agg(F.count_if(F.col(c).isNull()).alias("n")).select(F.lit(f"null:{c}").alias("rule"), "n") for c in required]
    parts += [df.agg(F.count_if(~F.col(c).isin(v)).alias("n")).select(F.lit(f"domain:{c}").alias("rule"), "n") for c, v in domains.items()]
    if keys:
        parts.append(df.groupBy(*keys).agg(F.count("*").alias("k")).agg(F.count_if(F.col("k") > 1).alias("n")).select(F.lit("key:" + ",".join(keys)).alias("rule"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where("n > 0")
