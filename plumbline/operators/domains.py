"""Registrable domains by a table of public suffixes, with wildcard and exception rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_suffixes(spark: SparkSession, path: str) -> DataFrame:
    """(rule) of a suffix list: a rule a line up to the first blank, comments and empty lines left out."""
    line = F.regexp_extract("value", r"^\s*(\S*)", 1)
    return spark.read.text(path).select(F.lower(line).alias("rule")).where((F.col("rule") != "") & ~F.col("rule").startswith("//")).distinct()


def registrable_domains(hosts: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(host, suffix, domain) of the distinct hosts: the longest rule (rule) that fits gives the public suffix, and with one more label the domain.

    `*.x` stands for any one label before `.x`; `!y.x` takes `y.x` out of it and wins over every other rule. A host without a rule has
    its last label for suffix. A host that is itself a public suffix has no domain; addresses of numbers are their own.
    Hosts are exploded into their endings, which meet the rules by an equi-join, so neither side is looked through for the other.
    """
    names = hosts.select(F.lower("host").alias("host")).where("host <> ''").distinct().withColumn("labels", F.split("host", r"\."))
    named = names.where(~F.col("host").rlike(r"^[0-9.]+$|^\["))
    ends = named.select("host", F.posexplode(F.expr("transform(sequence(1, size(labels)), i -> array_join(slice(labels, size(labels) - i + 1, i), '.'))")).alias("i", "end"))
    rest = F.when(F.col("i") > 0, F.regexp_replace("end", r"^[^.]*\.", ""))
    forms = F.array_compact(F.array(
        F.struct(F.col("end").alias("rule"), F.lit(False).alias("wins"), (F.col("i") + 1).alias("size")), F.when(rest.isNotNull(), F.struct(F.concat(F.lit("*."), rest).alias("rule"), F.lit(False).alias("wins"), (F.col("i") + 1).alias("size"))),
        F.struct(F.concat(F.lit("!"), "end").alias("rule"), F.lit(True).alias("wins"), F.col("i").alias("size")),
    ))
    asked = ends.select("host", F.explode(forms).alias("f")).select("host", "f.*")
    met = asked.join(suffixes.select(F.lower("rule").alias("rule")).distinct(), "rule").groupBy("host").agg(F.max(F.struct("wins", "size")).alias("best"))
    size = F.coalesce("best.size", F.lit(1))
    known = names.join(met, "host", "left").withColumn("size", F.when(F.col("host").rlike(r"^[0-9.]+$|^\["), None).otherwise(size))
    last = lambda k: F.array_join(F.expr(f"slice(labels, size(labels) - ({k}) + 1, {k})"), ".")
    domain = F.when(F.col("size").isNull(), F.col("host")).when(F.size("labels") > F.col("size"), last("size + 1"))
    return known.select("host", F.when(F.col("size").isNotNull(), last("least(size, size(labels))")).alias("suffix"), domain.alias("domain"))
