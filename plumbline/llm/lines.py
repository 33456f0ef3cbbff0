"""Line dedup over overlapping three-line windows.

Blank lines carry no content and are skipped; every run of three consecutive other lines is a window,
identified by 128 hashed bits of its trimmed lines. Of equal windows in the whole corpus the first one,
by (doc_id, text, line), stays; the lines of every later one go, overlapping windows merged.

Documents of fewer than three such lines lose nothing. Null text: empty text, no lines. Repeated rows
(same doc_id and text) count as one occurrence, so both stay as the first does. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TRIM = r"regexp_replace(l, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '')"


def windows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, h1, h2, first_line, last_line) of every window."""
    rows = docs.select("doc_id", "text_key", F.expr(rf"transform(split(text, '\n'), (l, i) -> struct({_TRIM} AS l, i AS i))").alias("n"))
    rows = rows.select("doc_id", "text_key", F.expr("filter(n, x -> x.l <> '')").alias("n"))
    three = """zip_with(zip_with(n, slice(n, 2, size(n)), (a, b) -> struct(a, b)), slice(n, 3, size(n)),
        (ab, c) -> IF(c IS NULL, NULL, struct(
            xxhash64(ab.a.l, ab.b.l, c.l) AS h1, xxhash64(1, c.l, ab.b.l, ab.a.l) AS h2,
            ab.a.i AS first_line, c.i AS last_line)))"""
    rows = rows.where("size(n) >= 3").select("doc_id", "text_key", F.explode(F.expr(f"filter({three}, x -> x IS NOT NULL)")).alias("w"))
    return rows.select("doc_id", "text_key", "w.*")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans): the windows of a document that occur earlier in the corpus."""
    all_windows = windows(docs)
    # Counted and reduced map-side: a window that a third of the rows hold reaches the reducer once per task.
    at = F.struct("doc_id", "text_key", "first_line")
    first = all_windows.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.max(at).alias("last")).where("last > first")
    # A plain equi-join: adaptive execution splits the partition of a hot window.
    later = all_windows.join(first.select("h1", "h2", "first"), ["h1", "h2"]).where(at > F.col("first"))
    return later.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first_line", "last_line")).alias("spans"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of `docs` but with the text deduplicated, and in `line_dedup` a struct of n_lines and n_removed.

    Input that has a column of that name is refused.
    """
    if "line_dedup" in {c.lower() for c in docs.columns}:
        raise ValueError("the input has a column line_dedup, which is the name of the result: rename it first")
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    rows = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
        F.struct(F.lit(0), *(F.col(f"`{c}`") for c in others)).alias("others"),
    ).withColumn("text_key", F.xxhash64("text"))
    spans = repeated_spans(rows.select("doc_id", "text", "text_key")).select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "spans")
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
    joined = joined.withColumn("lines", F.expr(r"split(text, '\n')")).withColumn(
        "gone", F.expr("array_distinct(flatten(transform(coalesce(spans, array()), s -> sequence(s.first_line, s.last_line))))")
    )
    kept = "transform(array_except(sequence(0, size(lines) - 1), gone), i -> lines[i])"
    return joined.select(
        F.col("doc_id").alias(id_col),
        F.when(F.size("gone") == 0, F.col("text")).otherwise(F.expr(f"array_join({kept}, '\n')")).alias(text_col),
        *(F.col("others").getField(c).alias(c) for c in others),
        F.struct(F.size("lines").cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed")).alias("line_dedup"),
    )
