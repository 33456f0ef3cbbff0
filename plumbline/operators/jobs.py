"""Job logs: status, queues, quotas, spend, usage, access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed


def numbered(events: DataFrame, job: str, *order: str) -> DataFrame:
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(job).orderBy(*order)).cast("long"))


def latest_by_stage(events: DataFrame, stages: list[str]) -> DataFrame:
    """(job, stage, ord, status): each stage's newest status; of missing ones those before the last seen are skipped, later ones wait."""
    newest = events.groupBy("job", "stage").agg(F.max_by("status", F.struct("at", "event_id")).alias("status"))
    domain = F.posexplode(F.array(*(F.lit(s) for s in stages))).alias("ord", "stage")
    every = events.select("job").distinct().select("job", domain)
    joined = every.join(newest, ["job", "stage"], "left")
    last = F.max(F.when(F.col("status").isNotNull(), F.col("ord"))).over(Window.partitionBy("job"))  # a handful of rows each
    return joined.select("job", "stage", "ord", F.coalesce("status", F.when(F.col("ord") < last, "skipped").otherwise("waiting")).alias("status"))


def queue_positions(jobs: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(id, ahead): active jobs with a smaller id. Two levels: ranges of `width` ids are counted, then rows within a range.

    So no task has more than `width` rows of the table, and the window over the ranges' counts one row for each range.
    """
    ranged = jobs.where("active").select("id", F.floor(F.col("id") / width).alias("r"))
    counts = ranged.groupBy("r").agg(F.count("*").alias("n"))
    before = counts.select("r", (F.sum("n").over(Window.orderBy("r")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("r").orderBy("id")) - 1
    return ranged.join(before, "r").select("id", (F.col("before") + within).cast("long").alias("ahead"))


def rolling_count(events: DataFrame, keys: list[str], at: str = "at", seconds: int = 86400) -> DataFrame:
    """`recent`: earlier events of the key strictly within the last `seconds`; equal times do not count each other.

    Time is cut into spans of `seconds`; an event counts in its own span and stands by in the next, so that a key's spans are apart
    and a key with most of the events is no single task's work. Moved on by `seconds`, an event that stands by falls among those of the
    span, and counts for those before it: two running counts and a total, which take a pass each, however many events a window has.
    """
    micros, length = F.unix_micros(F.col(at).cast("timestamp")), seconds * 1_000_000
    span = F.floor(micros / length)
    one = lambda own, by: F.struct((span + by).alias("span"), (micros + by * length).alias("at"), F.lit(own).alias("own"))
    placed = events.select("*", F.explode(F.array(one(True, 0), one(False, 1))).alias("_s"))
    part = Window.partitionBy(*keys, "_s.span")
    upto = lambda last: part.orderBy("_s.at").rangeBetween(Window.unboundedPreceding, last)
    own = F.col("_s.own")
    recent = F.count_if(own).over(upto(-1)) + F.count_if(~own).over(part) - F.count_if(~own).over(upto(0))
    return placed.withColumn("recent", recent).where("_s.own").drop("_s")


def quota_resets(events: DataFrame, keys: list[str], limit: int, seconds: int = 86400) -> DataFrame:
    """Over-quota events with `resets_at`: when the oldest of the last `limit` events leaves the window."""
    w = Window.partitionBy(*keys).orderBy("at", "event_id")
    marked = rolling_count(events, keys, "at", seconds).withColumn("oldest", F.lag("at", limit).over(w))
    return marked.where(F.col("recent") >= limit).withColumn("resets_at", F.timestamp_seconds(F.unix_seconds("oldest") + seconds)).drop("oldest")


def running_spend(usage: DataFrame, keys: list[str], cap: float, order: str = "ord") -> DataFrame:
    """`spent` before each row, and whether the row still fits the cap."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum("cost").over(w), F.lit(0.0))
    return usage.withColumn("spent", spent).withColumn("fits", spent + F.col("cost") <= cap)


def usage_receipt(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """(stage, model, calls, input, output, charged, list_cost) and a total row with both null: one pass with grouping sets."""
    priced = usage.join(F.broadcast(prices), "model", "left")  # a price list: tens of rows
    cost = F.col("input") * F.col("prompt") + F.col("output") * F.col("completion")
    return priced.groupingSets([[priced["stage"], priced["model"]], []], "stage", "model").agg(
        F.count("*").alias("calls"), F.sum("input").alias("input"), F.sum("output").alias("output"), F.sum("charged").alias("charged"), F.sum(cost).alias("list_cost")
    )


def cache_usage(usage: DataFrame) -> DataFrame:
    """(prefix, calls, first_hit, later_hits, cached, input) of calls that share a prompt prefix."""
    first = F.min_by("cached", "ord")
    hits = F.count_if(F.col("cached") > 0)
    sums = usage.groupBy("prefix").agg(F.count("*").alias("calls"), (first > 0).alias("first_hit"), (hits - (first > 0).cast("int")).cast("long").alias("later_hits"), F.sum("cached").alias("cached"), F.sum("input").alias("input"))
    return sums.where("calls > 1")


def prompt_sizes(rows: DataFrame, cap: int, by: list[str] = ()) -> DataFrame:
    """(by, n, p50, p90, most, refused) of `tokens`: nearest-rank percentiles, refused from the cap on."""
    pct = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY tokens)").cast("long")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), pct(0.5).alias("p50"), pct(0.9).alias("p90"), F.max("tokens").alias("most"), F.count_if(F.col("tokens") >= cap).alias("refused"))


def rolling_projection(done: DataFrame, keys: list[str], total: int) -> DataFrame:
    """After each completion: mean cost so far and the projected total: adds `mean_cost`, `projected`."""
    w = Window.partitionBy(*keys).orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return done.withColumn("mean_cost", F.avg("cost").over(w)).withColumn("projected", F.col("mean_cost") * total)


def running_totals(rows: DataFrame, keys: list[str], order: str, columns: list[str], n_ranges: int | None = None) -> DataFrame:
    """Adds `sum_<column>`: whole-number sums of a key's rows up to each, in an order without ties.

    Rows are cut into ranges of key and order, so that a key with most of the rows is many tasks' work: sums are taken within ranges, and what
    lies before a range comes from the ranges' totals, of which a key has at most as many as there are ranges.
    """
    n = n_ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(rows.repartitionByRange(n, *keys, order).withColumn("_range", F.spark_partition_id()))
    totals = ranged.groupBy(*keys, "_range").agg(*(F.sum(c).alias(f"_{c}") for c in columns))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_range", *(F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns))
    within = Window.partitionBy(*keys, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranged.join(offsets, [*keys, "_range"])
    return joined.select(*rows.columns, *((F.col(f"_{c}") + F.coalesce(F.sum(c).over(within), F.lit(0))).cast("long").alias(f"sum_{c}") for c in columns))


def calibrated_projection(done: DataFrame, planned: DataFrame, keys: list[str], prompt: float, completion: float, every: int = 20) -> DataFrame:
    """After each completion (keys, ord, estimated, input, output) what all that is `planned` (keys, items, estimated, cap) will cost.

    Input left over is estimated by the ratio of real to estimated input so far, output by its mean so far. The run stops at the first row
    whose projection passes the cap, or whose usage is unknown (null): later rows are not there. `reason` names that row, and each
    `every`-th completion.
    """
    missing = (F.col("input").isNull() | F.col("output").isNull()).cast("long")
    sums = running_totals(done.withColumn("one", F.lit(1)).withColumn("missing", missing), keys, "ord", ["one", "estimated", "input", "output", "missing"])
    s = sums.join(planned.select(*keys, F.col("items").alias("_items"), F.col("estimated").alias("_estimated"), F.col("cap").alias("_cap")), keys)
    verified = (F.col("sum_missing") == 0) & (F.col("sum_estimated") > 0)
    ratio = F.col("sum_input").cast("double") / F.col("sum_estimated")
    mean = F.col("sum_output").cast("double") / F.col("sum_one")
    left_in, left_out = F.ceil((F.col("_estimated") - F.col("sum_estimated")) * ratio), F.ceil(mean * (F.col("_items") - F.col("sum_one")))
    spent = F.col("sum_input") * F.lit(prompt) + F.col("sum_output") * F.lit(completion)
    known = lambda c: F.when(verified, c)
    rows = s.select(
        *keys, "ord", F.col("sum_one").alias("completed"), known(ratio).alias("ratio"), known(mean).alias("mean_output"), known(left_in).alias("left_input"), known(left_out).alias("left_output"),
        spent.alias("spent"), known(spent + left_in * prompt + left_out * completion).alias("projected"), verified.alias("verified"), "_cap",
    )
    within = F.coalesce(F.col("projected") <= F.col("_cap"), F.lit(False))
    judged = rows.withColumn("within_cap", within)
    stop = judged.where(~F.col("within_cap")).groupBy(*keys).agg(F.min("ord").alias("_stop"))
    reason = F.when(~F.col("verified"), "usage-unavailable").when(~F.col("within_cap"), "projected-budget-exceeded").when(F.col("completed") % every == 0, "completed")
    return judged.join(stop, keys, "left").where(F.col("_stop").isNull() | (F.col("ord") <= F.col("_stop"))).withColumn("reason", reason).drop("_stop", "_cap", "verified")


def early_failures(results: DataFrame, keys: list[str], first: int = 20, allowed: int = 2) -> DataFrame:
    """(keys, failures, goes_on): failures among the first results by `ord`."""
    w = Window.partitionBy(*keys).orderBy("ord")
    early = results.withColumn("r", F.row_number().over(w)).where(F.col("r") <= first)
    return early.groupBy(*keys).agg(F.count_if(~F.col("ok")).alias("failures"), (F.count_if(~F.col("ok")) <= allowed).alias("goes_on"))


def budget_summary(ledger: DataFrame, caps: DataFrame, reserve: float = 0.0) -> DataFrame:
    """(host, cap, spent, available): unresolved reservations count as spent."""
    spent = F.sum(F.coalesce("settled", "reserved"))
    sums = ledger.groupBy("host").agg(spent.alias("spent"))
    s = F.coalesce("spent", F.lit(0.0))
    return caps.join(sums, "host", "left").select("host", "cap", s.alias("spent"), F.greatest(F.lit(0.0), F.col("cap") - s - reserve).alias("available"))


def stage_accounting(items: DataFrame) -> DataFrame:
    """(stage, total, accounted, success, failed, stopped, adds_up) of (stage, status)."""
    c = lambda s: F.count_if(F.col("status") == s)
    sums = items.groupBy("stage").agg(F.count("*").alias("total"), c("success").alias("success"), c("failed").alias("failed"), c("stopped").alias("stopped"))
    accounted = F.col("success") + F.col("failed")
    return sums.withColumn("accounted", accounted).withColumn("adds_up", accounted + F.col("stopped") == F.col("total"))


def retry_totals(attempts: DataFrame, stages: list[str]) -> DataFrame:
    """(config, items, and one count for each stage reached): a failed first attempt is replaced by the retry; stages include earlier ones."""
    last = attempts.groupBy("config", "item").agg(F.max_by("reached", "attempt").alias("reached"))
    return last.groupBy("config").agg(F.count("*").alias("items"), *(F.count_if(F.col("reached") >= i + 1).alias(s) for i, s in enumerate(stages)))


def decide_access(role: Column, grants: Column, project: Column, basis: Column, hold: Column, in_sample: Column, view: Column) -> Column:
    identifiable = view == "identifiable"
    return F.coalesce(
        F.when(role == "admin", True)
        .when(role == "judge", F.when(view == "deidentified", in_sample).otherwise(basis.isNotNull() & ~hold))
        .when(role == "company", identifiable & F.array_contains(grants, project)),
        F.lit(False),
    )


def page_of(rows: DataFrame, order: list[Column], page: int, size: int = 50) -> DataFrame:
    """One page, clamped to the pages there are; the rows up to it come from a limit, not a sort of all."""
    n = rows.count()
    page = min(max(page, 1), max(1, -(-n // size)))
    return rows.orderBy(*order).limit(page * size).offset((page - 1) * size)


def finish_time(progress: DataFrame) -> DataFrame:
    """(key, rate, eta) of (key, done, total, started, now)."""
    seconds = (F.unix_micros("now") - F.unix_micros("started")) / 1e6
    rate = F.try_divide(F.col("done"), seconds)
    return progress.select("key", rate.alias("rate"), F.try_divide(F.col("total") - F.col("done"), rate).alias("eta"))


def log_records(lines: DataFrame, prefix: str, schema: str) -> DataFrame:
    """Records of log lines that start with the prefix and go on with a JSON object of the schema; others are dropped."""
    tail = F.expr(f"substring(value, {len(prefix) + 1})")
    parsed = lines.where(F.startswith("value", F.lit(prefix))).select(F.trim(tail).alias("tail")).where("tail LIKE '{%' AND try_parse_json(tail) IS NOT NULL")
    return parsed.select(F.from_json("tail", schema).alias("r")).select("r.*")


def approved(journal: DataFrame, any_rejection: bool = False) -> DataFrame:
    """(item, digest) whose latest record approves; with `any_rejection`, only if none ever rejected."""
    last = journal.groupBy("item", "digest").agg(F.max_by("verdict", F.struct("at", "ord")).alias("verdict"), F.bool_or(F.col("verdict") == "reject").alias("rejected"))
    keep = F.col("verdict") == "approve"
    return last.where(keep & ~F.col("rejected") if any_rejection else keep).select("item", "digest")


def replay_steps(pages: DataFrame, cited: DataFrame) -> DataFrame:
    """(project, step, kind, ref): pages in order, each followed by its cited spans once, then the report."""
    a = pages.select("project", "page_ix", F.lit(0).alias("k"), F.lit(0).alias("s"), F.lit("page").alias("kind"), F.col("url").alias("ref"))
    b = cited.select("project", "page_ix", "span_ix", "span_id").distinct().select("project", "page_ix", F.lit(1).alias("k"), F.col("span_ix").alias("s"), F.lit("span").alias("kind"), F.col("span_id").alias("ref"))
    c = pages.select("project").distinct().select("project", F.lit((1 << 31) - 1).alias("page_ix"), F.lit(2).alias("k"), F.lit(0).alias("s"), F.lit("report").alias("kind"), F.lit("").alias("ref"))
    w = Window.partitionBy("project").orderBy("page_ix", "k", "s")
    return a.unionByName(b).unionByName(c).select("project", F.row_number().over(w).cast("long").alias("step"), "kind", "ref")
