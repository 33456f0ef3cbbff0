"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, decontaminate, extract, fingerprints, licenses, lines, oracles, pieces, quality, simhash, suffix, treeweight, variants, warc
from .common import materialize, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "text", "line_dedup.n_lines", "line_dedup.n_removed")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = licenses.files_of_documents(table(spark, sf_dir, "documents"))
    return licenses.scan(files, licenses.templates(spark)).withColumnRenamed("id", "doc_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon = quality.fit_lexicon(docs, table(spark, sf_dir, "labels"))
    # The stored ledger is all that policies and ablations read.
    entries = quality.apply_policy(materialize(quality.ledger(docs, lexicon)))
    failed = F.col("fail_bits").bitwiseAND(F.lit(quality.POLICIES["base-1"])) != 0
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "fail_bits"
    )


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the strictest policy removes, alone and in all, from the stored ledger: (policy, rule, n_failed, ...)."""
    docs = table(spark, sf_dir, "documents")
    lexicon = quality.fit_lexicon(docs, table(spark, sf_dir, "labels"))
    return quality.ablation(materialize(quality.ledger(docs, lexicon)))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses_of_pages(table(spark, sf_dir, "pages"))).withColumnRenamed("id", "page_id")


def op7_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = treeweight.score(table(spark, sf_dir, "documents"))
    # The closing zero byte is coded, too.
    return found.withColumn("bits_per_byte", -F.col("score") / (F.log10(F.lit(2.0)) * (F.col("n_bytes") + 1)))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(suffix.repeated_bytes(table(spark, sf_dir, "documents")))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = pieces.decode(pieces.encode(table(spark, sf_dir, "documents")))
    same = F.xxhash64("decoded") == F.col("digest")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", same.alias("decodes"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group(table(spark, sf_dir, "documents"))


def op12_sort_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.report(*clustering.cluster(table(spark, sf_dir, "embeddings")))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With `n_near` for ids divisible by 100, the search's queries: documents within three bits of theirs, itself included."""
    lines = materialize(fingerprints.compare(table(spark, sf_dir, "documents")))
    asks = F.col("doc_id") % 100 == 0
    distinct = lines.groupBy("fp").agg(F.count("*").alias("n"), F.max(F.coalesce(asks, F.lit(False))).alias("asked"))
    found = lines.join(fingerprints.search(distinct), "fp", "left")
    text = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return found.select("doc_id", "n_chars", "edited_sha256", text("fp").alias("fingerprint"), text("edited_fp").alias("edited_fingerprint"), "near_edited", "near_next", F.when(asks, F.col("n_near")).alias("n_near"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_line_dedup,
        op3_license_scan,
        op4_quality_rules,
        quality_ablation,
        op5_html_extraction,
        op6_warc_derivatives,
        op7_context_tree_weighting,
        op8_decontamination,
        op9_suffix_array,
        op10_sentencepiece,
        op11_spelling_variants,
        op12_sort_means,
        op13_fingerprints,
    )
}
ORACLES = oracles.ORACLES
