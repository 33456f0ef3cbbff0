"""Sampling frames: windows, strata, seeded order, screening walks, PRISMA counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbers import seeded_key


def frame_windows(spark: SparkSession, start: int, end_exclusive: int, seconds: int = 7 * 86400) -> DataFrame:
    """(window_no, start, end_exclusive) contiguous half-open epoch windows; the last is clamped."""
    n = max(0, -(-(end_exclusive - start) // seconds))
    at = F.col("id") * seconds + start
    return spark.range(n).select(F.col("id").alias("window_no"), at.alias("start"), F.least(at + seconds, F.lit(end_exclusive)).alias("end_exclusive"))


def window_counts(posts: DataFrame, start: str, end_exclusive: str, days: int = 7) -> DataFrame:
    """Posts for each window of the frame, by arithmetic on the timestamp: (window_no, n)."""
    at = F.unix_timestamp("created_at") - F.unix_timestamp(F.lit(start).cast("timestamp"))
    inside = (F.col("created_at") >= F.lit(start).cast("timestamp")) & (F.col("created_at") < F.lit(end_exclusive).cast("timestamp"))
    return posts.where(inside).groupBy(F.floor(at / (days * 86400)).cast("long").alias("window_no")).agg(F.count("*").alias("n"))


def dedupe_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last by `order`; reduced map-side."""
    others = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*others), order).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in others))


def with_stratum(posts: DataFrame, starts: list[str], column: str = "created_at") -> DataFrame:
    """`quarter`: 1.. by half-open boundaries, 0 outside; the last start is the exclusive end."""
    q = F.lit(0)
    for i in reversed(range(len(starts) - 1)):
        inside = (F.col(column) >= F.lit(starts[i]).cast("timestamp")) & (F.col(column) < F.lit(starts[i + 1]).cast("timestamp"))
        q = F.when(inside, i + 1).otherwise(q)
    return posts.withColumn("quarter", q)


def seeded_top(rows: DataFrame, seed: str, key: str, n: int, by: str | None = None) -> DataFrame:
    """The first n of the seeded order, of each `by` group if given: (columns, draw_rank)."""
    ordered = rows.withColumn("draw_key", seeded_key(seed, F.col(key)))
    if by is None:
        few = ordered.orderBy("draw_key").limit(n)  # takes n of each partition first, no global sort
        return few.withColumn("draw_rank", F.row_number().over(Window.orderBy("draw_key"))).drop("draw_key")
    # Rank limits are pushed below the shuffle: each task keeps n of each group.
    w = Window.partitionBy(by).orderBy("draw_key")
    return ordered.withColumn("draw_rank", F.row_number().over(w)).where(F.col("draw_rank") <= n).drop("draw_key")


def screened_walk(posts: DataFrame, seed: str, target: int, quarters: int = 4) -> DataFrame:
    """Outcomes of walking each quarter in seeded order until `target` inclusions, without a sequential walk.

    Needs id, key (null: unknown, never a duplicate), quarter, pass1, reachable, boundary_ok, text_len, pass2. The first
    row of a key that would pass is its inclusion; quarters are taken in order and earlier inclusions make duplicates.
    The cut is found by a limit over one row for each key, so no quarter is ever sorted whole; only walked rows are ranked.
    (id, quarter, draw_key, outcome, stage2, text_source, n)
    """
    rows = posts.withColumn("draw_key", seeded_key(seed, F.col("id"))).withColumn("group_key", F.coalesce(F.concat(F.lit("k"), "key"), F.concat(F.lit("i"), "id")))
    passes = F.col("pass1") & F.col("reachable") & F.col("boundary_ok") & ((F.col("text_len") < 500) | F.col("pass2"))
    included, walked = None, []
    for q in range(1, quarters + 1):
        mine = rows.where(F.col("quarter") == q)
        firsts = mine.where(passes).groupBy("group_key").agg(F.min("draw_key").alias("first_key"))
        if included is not None:
            firsts = firsts.join(included.select("group_key"), "group_key", "left_anti")
        chosen = firsts.orderBy("first_key").limit(target)
        cut = chosen.agg(F.when(F.count("*") >= target, F.max("first_key")).otherwise(F.lit("~")).alias("cut"))
        reached = mine.join(F.broadcast(cut), F.col("draw_key") <= F.col("cut")).drop("cut")
        earlier = reached.withColumn("was_included", F.lit(False))
        if included is not None:
            earlier = reached.join(included.select("group_key", F.lit(True).alias("was")), "group_key", "left").withColumn("was_included", F.coalesce("was", F.lit(False))).drop("was")
        seen = earlier.join(chosen, "group_key", "left").withColumn("duplicate", F.col("was_included") | F.coalesce(F.col("first_key") < F.col("draw_key"), F.lit(False)))
        walked.append(seen.drop("was_included"))
        included = chosen.select("group_key") if included is None else included.select("group_key").union(chosen.select("group_key"))
    every = walked[0]
    for w in walked[1:]:
        every = every.unionByName(w)
    outcome = (
        F.when(F.col("key").isNotNull() & F.col("duplicate"), "duplicate")
        .when(~F.col("pass1"), "excluded-stage1")
        .when(~F.col("reachable"), "not-collectable-unreachable")
        .when(~F.col("boundary_ok"), "not-collectable-boundary")
        .when((F.col("text_len") >= 500) & ~F.col("pass2"), "excluded-stage2")
        .otherwise("included")
    )
    every = every.withColumn("outcome", outcome)
    stage2 = F.when(F.col("outcome") == "included", F.when(F.col("text_len") < 500, "insufficient-text").otherwise("screened"))
    in_order = Window.orderBy("quarter", "draw_key").rowsBetween(Window.unboundedPreceding, 0)  # of walked rows only
    n = F.when(F.col("outcome") == "included", F.count_if(F.col("outcome") == "included").over(in_order))
    return every.select("id", "quarter", "draw_key", "outcome", stage2.alias("stage2"), n.alias("n"))


def extend_walk(posts: DataFrame, walked: DataFrame) -> DataFrame:
    """Candidates for an extension: what no earlier walk has an outcome for."""
    return posts.join(walked.select("id"), "id", "left_anti")


def prisma_counts(outcomes: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, outcome, n) and a row `screened` for all."""
    return (
        outcomes.groupBy(*by, "outcome").agg(F.count("*").alias("n"))
        .unionByName(outcomes.groupBy(*by).agg(F.lit("screened").alias("outcome"), F.count("*").alias("n")))
    )


def merge_small(counts: DataFrame, floor: int = 10) -> DataFrame:
    """Fold (family, reason, n) below the floor into the family's `other`; an `other` below the floor joins the smallest large one.

    Ties go to the smaller reason; if no reason is large, `other` stays. Families keep their sums.
    """
    small = (F.col("n") < floor) | (F.col("reason") == "other")
    large = counts.where(~small)
    other = counts.where(small).groupBy("family").agg(F.sum("n").alias("other_n")).where("other_n > 0")
    target = large.groupBy("family").agg(F.min_by("reason", F.struct("n", "reason")).alias("target"))
    moved = other.join(target, "family", "left").withColumn("moves", (F.col("other_n") < floor) & F.col("target").isNotNull())
    kept = large.join(moved.where("moves").select("family", "target", "other_n"), "family", "left").select(
        "family", "reason", (F.col("n") + F.when(F.col("reason") == F.col("target"), F.col("other_n")).otherwise(0)).cast("long").alias("n")
    )
    return kept.unionByName(moved.where("NOT moves").select("family", F.lit("other").alias("reason"), F.col("other_n").cast("long").alias("n")))


def seeded_subsets(rows: DataFrame, key: str, sizes: dict[str, int], seeds: dict[str, str]) -> DataFrame:
    """Disjoint subsets drawn one after another, each in its own seeded order: (key, subset, draw_rank)."""
    left, parts = rows.select(key).distinct(), []
    for name, n in sizes.items():
        drawn = seeded_top(left, seeds[name], key, n).select(key, F.lit(name).alias("subset"), F.col("draw_rank").cast("long").alias("draw_rank"))
        parts.append(drawn)
        left = left.join(F.broadcast(drawn.select(key)), key, "left_anti")  # at most n rows
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_usable(candidates: DataFrame, classes: str, points: str, most: int = 250) -> DataFrame:
    """The best usable candidate of each class among the `most` with most points: (class columns of the row)."""
    top = candidates.orderBy(F.desc(points), "id").limit(most)
    return top.where("usable").groupBy(classes).agg(F.max_by("id", F.struct(points, (-F.col("id").cast("long")))).alias("id"))
