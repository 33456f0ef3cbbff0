"""Validation of what people and collectors hand in: screening audits, cross-checks, edits, decisions, prices and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import AUDIT_BAR, STATES
from ..functions.numbers import ratio, wilson
from .evidence import page_sets
from .states import latest

#: Reasons of the log that say nothing of a project.
OPERATIONAL = ("duplicate", "unreachable-at-screening")
#: All that counts as white space in a quote.
_BLANKS = r"[\u0009-\u000D\u0020\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]+"


def screening_audit(records: DataFrame) -> DataFrame:
    """One row: n, assessable, not_assessable, errors, error_rate, low, high, within of (assessable, include, reason).

    An error is an assessable record that the auditor would include. Null flags count as false; without assessable records the rate is 0.
    """
    ok = F.coalesce("assessable", F.lit(False))
    sums = records.agg(F.count("*").alias("n"), F.count_if(ok).alias("assessable"), F.count_if(~ok).alias("not_assessable"), F.count_if(ok & F.coalesce("include", F.lit(False))).alias("errors"))
    rate = F.coalesce(ratio(F.col("errors"), F.col("assessable")), F.lit(0.0))
    low, high = wilson(F.col("errors"), F.col("assessable"))
    return sums.select("*", rate.alias("error_rate"), low.alias("low"), high.alias("high"), (rate <= AUDIT_BAR).alias("within"))


def audit_histogram(records: DataFrame, log: DataFrame) -> DataFrame:
    """(part, code, n): "original" counts the records' first reasons, a null one as unknown; "operational" the log's exclusions (kind, reason) for such causes."""
    first = records.groupBy(F.lit("original").alias("part"), F.coalesce("reason", F.lit("unknown")).alias("code")).agg(F.count("*").alias("n"))
    causes = log.where((F.col("kind") == "excluded") & F.col("reason").isin(*OPERATIONAL))
    return first.union(causes.groupBy(F.lit("operational").alias("part"), F.col("reason").alias("code")).agg(F.count("*").alias("n")))


def cross_check(projects: DataFrame, pages: tuple[DataFrame, DataFrame], quotes: tuple[DataFrame, DataFrame], states: tuple[DataFrame, DataFrame]) -> DataFrame:
    """Two collections of the same projects side by side, one row for each of `projects` (project).

    Pages (project, url): both, left_only, right_only, jaccard, which is 1 where neither has any. Quotes (project, quote), alike but for
    case and white space: left_quotes, right_quotes, shared; empty ones do not count. Checks (project, check_id, state) of the left:
    checks, and agree, those whose state on the right is the same. Repeated pages and quotes count once; sums are made before they are joined.
    """
    sets = page_sets(*pages)
    texts = [d.select("project", F.trim(F.regexp_replace(F.lower("quote"), _BLANKS, " ")).alias("q")).where("q <> ''").distinct().withColumn(c, F.lit(1)) for d, c in zip(quotes, ("l", "r"), strict=True)]
    both = texts[0].join(texts[1], ["project", "q"], "full_outer").groupBy("project")
    shared = both.agg(F.count("l").alias("left_quotes"), F.count("r").alias("right_quotes"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("shared"))
    right = states[1].select("project", "check_id", F.col("state").alias("other"))
    pairs = states[0].select("project", "check_id", "state").join(right, ["project", "check_id"], "left")
    agreed = pairs.groupBy("project").agg(F.count("*").alias("checks"), F.count_if(F.col("state") == F.coalesce("other", F.lit("missing"))).alias("agree"))
    out = projects.select("project").distinct()
    for part in (sets, shared, agreed):
        out = out.join(part, "project", "left")
    counts = ["both", "left_only", "right_only", "left_quotes", "right_quotes", "shared", "checks", "agree"]
    return out.select("project", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("jaccard", F.lit(1.0)).alias("jaccard"))


def cross_check_figure(checked: DataFrame) -> DataFrame:
    """(n, mean_jaccard, agreement) over the rows of `cross_check`; zero where there is nothing to divide by."""
    zero = F.lit(0.0)
    return checked.agg(F.count("*").alias("n"), F.coalesce(F.avg("jaccard"), zero).alias("mean_jaccard"), F.coalesce(ratio(F.sum("agree"), F.sum("checks")), zero).alias("agreement"))


def _first_fault(*rules: tuple[Column, Column]) -> Column:
    """The message of the first rule that holds; a rule that is null does not hold."""
    out = F.lit(None).cast("string")
    for broken, message in reversed(rules):
        out = F.when(broken, message).otherwise(out)
    return out


def _open_projects(rows: DataFrame, unlocked: DataFrame, check_ids: DataFrame) -> DataFrame:
    """`rows` with is_open and known_check."""
    opened = unlocked.where("unlocked").select("project").distinct().withColumn("is_open", F.lit(True))
    known = check_ids.select("check_id").distinct().withColumn("known_check", F.lit(True))
    return rows.join(opened, "project", "left").join(known, "check_id", "left")


def edit_faults(edits: DataFrame, spans: DataFrame, check_ids: DataFrame, unlocked: DataFrame) -> DataFrame:
    """(edit_id, project, check_id, fault, filtered_state, filtered_spans) of (edit_id, project, check_id, state, span_ids); `edit_id` names a row.

    The fault is the first of: gold locked, unknown check, invalid state, unknown span (the first cited that is not among the project's
    `spans` (project, span_id)); null for an edit that counts, whose state is unknown if it cites none or says so. A refused edit has no
    filtered state. Null span lists cite none. Cited spans meet known ones one by one, so a project of any size is split.
    """
    cited = edits.select("edit_id", "project", F.posexplode("span_ids").alias("at", "span_id"))
    strange = cited.join(spans.select("project", "span_id").distinct(), ["project", "span_id"], "left_anti")
    strange = strange.groupBy("edit_id").agg(F.min_by(F.coalesce(F.col("span_id").cast("string"), F.lit("")), "at").alias("strange"))
    rows = _open_projects(edits, unlocked, check_ids).join(strange, "edit_id", "left")
    fault = _first_fault(
        (F.col("is_open").isNull(), F.lit("gold locked")),
        (F.col("known_check").isNull(), F.concat(F.lit("unknown check id: "), F.coalesce("check_id", F.lit("")))),
        (~F.coalesce(F.col("state").isin(*STATES), F.lit(False)), F.concat(F.lit("invalid state: "), F.coalesce("state", F.lit("")))),
        (F.col("strange").isNotNull(), F.concat(F.lit("unknown span id: "), "strange")),
    )
    none = (F.col("state") == "unknown") | (F.coalesce(F.size("span_ids"), F.lit(0)) <= 0)
    kept = F.when(none, F.slice("span_ids", 1, 0)).otherwise(F.col("span_ids"))
    state = F.when(none, "unknown").otherwise(F.col("state"))
    valid = F.col("fault").isNull()
    named = rows.withColumn("fault", fault)
    return named.select("edit_id", "project", "check_id", "fault", F.when(valid, state).alias("filtered_state"), F.when(valid, kept).alias("filtered_spans"))


def decision_faults(decisions: DataFrame, model: DataFrame, edits: DataFrame, check_ids: DataFrame, unlocked: DataFrame) -> DataFrame:
    """(decision_id, project, check_id, fault, confirmed_state) of (decision_id, project, check_id, decision, actor).

    A decision is on the newest edit's state (project, check_id, at, ord, state, actor; of equal times the first), else on the model's
    (project, check_id, state). The fault is the first of: gold locked, unknown check, no model state, own edit, a downgrade of what is
    no pass, not a positive. Without one the confirmed state is null if rejected, claimed if downgraded, else as it was.
    """
    newest = latest(edits.select("project", "check_id", "at", "ord", "state", "actor"), ["project", "check_id"], "at", "ord")
    newest = newest.select("project", "check_id", F.col("state").alias("edit_state"), F.col("actor").alias("editor"), F.lit(True).alias("edited"))
    states = model.select("project", "check_id", F.col("state").alias("model_state"), F.lit(True).alias("modelled"))
    rows = _open_projects(decisions, unlocked, check_ids).join(states, ["project", "check_id"], "left").join(newest, ["project", "check_id"], "left")
    state = F.when(F.col("edited"), F.col("edit_state")).otherwise(F.col("model_state"))
    positive = F.coalesce(state.isin("pass", "claimed"), F.lit(False))
    fault = _first_fault(
        (F.col("is_open").isNull(), F.lit("gold locked")),
        (F.col("known_check").isNull(), F.concat(F.lit("unknown check id: "), F.coalesce("check_id", F.lit("")))),
        (F.col("modelled").isNull(), F.concat(F.lit("no model state for "), "check_id")),
        ((F.col("editor") != "") & (F.col("editor") == F.col("actor")), F.lit("cannot decide on own edit")),
        ((F.col("decision") == "downgraded") & ~(state.eqNullSafe("pass")), F.lit("downgrade only from pass")),
        (~positive, F.concat(F.lit("not a positive: "), F.coalesce(state, F.lit("")))),
    )
    confirmed = F.when(F.col("decision") == "rejected", None).when(F.col("decision") == "downgraded", "claimed").otherwise(F.col("state_now"))
    named = rows.withColumn("state_now", state).withColumn("fault", fault)
    return named.select("decision_id", "project", "check_id", "fault", F.when(F.col("fault").isNull(), confirmed).alias("confirmed_state"))


def call_costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """`usage` (model, input, output, cached) with `list_cost` and `measured_cost` by prices (model, prompt, completion, cached_prompt).

    A model's name counts without ":cloud". Cache hits cost less only if they are known, are no more than the input and have a rate.
    A model without a price has no cost.
    """
    rates = prices.select(F.col("model").alias("priced"), "prompt", "completion", "cached_prompt")
    rows = usage.join(rates, F.regexp_replace("model", ":cloud$", "") == F.col("priced"), "left")
    usable = F.col("cached_prompt").isNotNull() & F.col("cached").between(F.lit(0), F.col("input"))
    hits = F.when(usable, F.col("cached")).otherwise(F.lit(0))
    cost = lambda n: n * F.col("prompt") + F.col("output") * F.col("completion")
    measured = cost(F.col("input") - hits) + hits * F.coalesce("cached_prompt", F.lit(0.0))
    return rows.withColumn("list_cost", cost(F.col("input"))).withColumn("measured_cost", measured).drop("priced", "prompt", "completion", "cached_prompt")


def budget_ledger(ledger: DataFrame, caps: DataFrame) -> DataFrame:
    """(stage, host, fault, charged, host_charged, host_left) of a stored ledger (stage, cap, estimated, spent, reserved).

    Reservations that nobody settled count as spent. A stage is at fault if it is not among `caps` (stage, cap, host, host_cap), has
    another cap, or holds an amount that is negative, null or not finite. What a host has left is its own cap less all its stages' charges.
    """
    rows = ledger.join(caps.select("stage", F.col("cap").alias("approved"), "host", "host_cap"), "stage", "left")
    amounts = [F.col(c) for c in ("estimated", "spent", "reserved")]
    sound = F.lit(True)
    for x in amounts:
        sound = sound & F.coalesce((x >= 0) & (x < float("inf")), F.lit(False))
    fault = _first_fault((F.col("approved").isNull(), F.lit("unknown stage")), (~F.col("cap").eqNullSafe(F.col("approved")), F.lit("cap mismatch")), (~sound, F.lit("invalid amount")))
    charged = F.col("spent") + F.col("reserved")
    hosts = rows.groupBy("host").agg(F.sum(charged).alias("host_charged"))
    out = rows.select("stage", "host", "host_cap", fault.alias("fault"), charged.alias("charged")).join(hosts, "host", "left")
    return out.select("stage", "host", "fault", "charged", "host_charged", (F.col("host_cap") - F.col("host_charged")).alias("host_left"))
