"""Packs: tables written with a manifest of their files, and files checked against it before anything is loaded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "manifest.json"


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of all files under a folder but its manifest and what writers leave beside data; a file is one task's value, 2 GB at most."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = "/" + path.partition("://")[2].lstrip("/") if "://" in path else path.removeprefix("file:")
    name = F.regexp_replace(F.col("path"), f"^.*?{_quoted(root.rstrip('/'))}/", "")
    files = found.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    return files.where(~F.col("file").startswith(f"{MANIFEST}/") & ~F.element_at(F.split("file", "/"), -1).rlike(r"^[._]"))


def _quoted(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/_" else f"\\{c}" for c in text)


def write_manifest(spark: SparkSession, path: str) -> None:
    """Written last: a pack without one is not complete."""
    file_digests(spark, path).write.json(f"{path}/{MANIFEST}")


def write_pack(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.parquet(f"{path}/{name}")
    write_manifest(next(iter(tables.values())).sparkSession, path)


def refusals(listed: DataFrame, found: DataFrame) -> DataFrame:
    """(file, problem): files that are changed, missing or extra by two tables (file, bytes, sha256)."""
    both = listed.alias("l").join(found.alias("f"), "file", "full_outer")
    problem = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("l.sha256").isNull(), "extra").when((F.col("l.sha256") != F.col("f.sha256")) | (F.col("l.bytes") != F.col("f.bytes")), "changed")
    return both.select("file", problem.alias("problem")).where("problem IS NOT NULL")


def pack_refusals(spark: SparkSession, path: str) -> DataFrame:
    listed = spark.read.schema("file string, bytes long, sha256 string").json(f"{path}/{MANIFEST}")
    return refusals(listed, file_digests(spark, path))


def load_pack(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of a pack whose files are those of its manifest, byte for byte; else an error that names the first few files."""
    bad = pack_refusals(spark, path).orderBy("file").limit(5).collect()
    if bad:
        raise ValueError("the pack is not as it was written: " + ", ".join(f"{r.file} {r.problem}" for r in bad))
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
