"""Check states: chunk merge, quote filter, edits, confirmation, rule gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import STATE_RANK, STATES


def state_rank(state: Column) -> Column:
    out = F.lit(0)
    for name, rank in STATE_RANK.items():
        out = F.when(state == name, rank).otherwise(out)
    return out


def merge_chunks(codings: DataFrame) -> DataFrame:
    """(project, check_id, state, span_ids) from (project, check_id, chunk, state, span_ids).

    The strongest state over chunks wins and keeps the distinct spans of the chunks that have it, first seen first; unknown keeps
    none. A check's lists are gathered once, beside their rank; a project's rows move once, to the aggregation and to what is asked of
    its spans after it.
    """
    rank = state_rank(F.col("state"))
    lists = F.collect_list(F.struct("chunk", "span_ids", rank.alias("rank")))
    best = codings.repartition("project").groupBy("project", "check_id").agg(F.max(rank).alias("rank"), lists.alias("lists"))
    names = F.element_at(F.array(*(F.lit(s) for s, _ in sorted(STATE_RANK.items(), key=lambda x: x[1]))), F.col("rank") + 1)
    strongest = F.sort_array(F.filter("lists", lambda x: x["rank"] == F.col("rank")))
    spans = F.array_distinct(F.flatten(F.transform(strongest, lambda x: x["span_ids"])))
    return best.select("project", "check_id", names.alias("state"), F.when(F.col("rank") > 0, spans).otherwise(F.array().cast(codings.schema["span_ids"].dataType)).alias("span_ids"))


def quote_or_unknown(states: DataFrame, known: DataFrame) -> DataFrame:
    """Downgrade to unknown without spans: no span cited, or one that is not among the project's `known` (project, known_ids)."""
    return resolved_or_unknown(states.join(known, "project", "left"))


def resolved_or_unknown(cited: DataFrame) -> DataFrame:
    """The same of states whose rows hold their project's `known_ids`; null: none."""
    unresolved = F.size(F.array_except("span_ids", F.coalesce("known_ids", F.slice("span_ids", 1, 0)))) > 0
    drop = (F.col("state") == "unknown") | (F.size("span_ids") == 0) | unresolved
    return cited.select(
        "project", "check_id", F.when(drop, "unknown").otherwise(F.col("state")).alias("state"), F.when(drop, F.slice("span_ids", 1, 0)).otherwise(F.col("span_ids")).alias("span_ids")
    )


def citations_resolve(state: Column, span_ids: Column, known_ids: Column) -> Column:
    """Every cited span is known, and none is cited exactly if the state is unknown."""
    return (F.size(F.array_except(span_ids, known_ids)) == 0) & ((state == "unknown") == (F.size(span_ids) == 0))


def gate_state(state: Column) -> Column:
    return F.when(state == "claimed", "unknown").otherwise(state)


def tally(states: DataFrame, domain: DataFrame) -> DataFrame:
    """(check_id, pass, claimed, fail, unknown), zero-filled over the domain, which drops other checks."""
    counts = states.groupBy("check_id").agg(*(F.count_if(F.col("state") == s).alias(s) for s in STATES))
    return domain.join(counts, "check_id", "left").select("check_id", *(F.coalesce(s, F.lit(0)).cast("long").alias(s) for s in STATES))


def floor_effect(tallied: DataFrame) -> DataFrame:
    return tallied.withColumn("at_floor", F.col("pass") + F.col("claimed") == 0)


def latest(rows: DataFrame, keys: list[str], at: str, order: str) -> DataFrame:
    """The newest row of each key; of equal times the first by `order`. Reduced map-side, no window."""
    others = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(F.col(at), -F.col(order))).alias("r"))
    return picked.select(*keys, *(F.col(f"r.{c}").alias(c) for c in others))


def effective_states(model: DataFrame, edits: DataFrame) -> DataFrame:
    """Model states overridden by the newest edit of (project, check_id): adds `edited`."""
    newest = latest(edits, ["project", "check_id"], "at", "ord").select("project", "check_id", F.col("state").alias("edit_state"))
    joined = model.join(newest, ["project", "check_id"], "left")
    return joined.select("project", "check_id", F.coalesce("edit_state", "state").alias("state"), F.col("edit_state").isNotNull().alias("edited"))


def pick_decision(decisions: DataFrame, keys: list[str]) -> DataFrame:
    """One decision for each key: a person's before an agent's, then the newest, then the last inserted."""
    others = [c for c in decisions.columns if c not in keys]
    best = decisions.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct((F.col("kind") == "person"), "at", "ord")).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in others))


def published_states(effective: DataFrame, decisions: DataFrame) -> DataFrame:
    """(project, check_id, published, basis) from effective states with their input digest, and decisions bound to one.

    A decision on another digest is stale: it shows, but does not count.
    """
    keys = ["project", "check_id"]
    positive = F.col("state").isin("pass", "claimed")
    current = pick_decision(decisions.join(effective.select(*keys, "digest"), [*keys, "digest"], "left_semi"), keys).select(*keys, "decision", "confirmed_state")
    any_decision = decisions.groupBy(*keys).agg(F.lit(True).alias("any_decision"))
    joined = effective.join(current, keys, "left").join(any_decision, keys, "left")
    basis = (
        F.when(~positive, "not-positive").when(F.col("decision") == "confirm", "confirmed").when(F.col("decision") == "downgrade", "downgraded")
        .when(F.col("decision") == "reject", "rejected").when(F.col("any_decision"), "stale").otherwise("unconfirmed")
    )
    published = F.when(basis.isin("not-positive", "confirmed"), F.col("state")).when(basis == "downgraded", F.col("confirmed_state")).when(basis == "rejected", "unknown")
    return joined.select(*keys, published.alias("published"), basis.alias("basis"))


def decision_status(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """(project, check_id, status): decided on the current digest, stale, or undecided."""
    keys = ["project", "check_id"]
    now = decisions.select(*keys, "digest").distinct().withColumn("now", F.lit(True))
    ever = decisions.select(*keys).distinct().withColumn("ever", F.lit(True))
    status = F.when(F.col("now"), "decided").when(F.col("ever"), "stale").otherwise("undecided")
    return items.join(now, [*keys, "digest"], "left").join(ever, keys, "left").select(*keys, status.alias("status"))


def rule_gate(states: DataFrame, decision_of: DataFrame) -> DataFrame:
    """(project, decision, status): any fail blocks, else anything that is no pass leaves evidence short."""
    joined = states.join(F.broadcast(decision_of), "check_id")  # the checks of a review: tens of rows
    s = gate_state(F.col("state"))
    status = F.when(F.bool_or(s == "fail"), "BLOCKED").when(F.bool_or(s.isin("unknown", "not-applicable")), "INSUFFICIENT_EVIDENCE").otherwise("PASS")
    return joined.groupBy("project", "decision").agg(status.alias("status"))


def dependent_check(gated: DataFrame, source: str, check_id: str) -> DataFrame:
    """State of a check that mirrors another decision's status: (project, check_id, state)."""
    state = F.when(F.col("status") == "PASS", "pass").when(F.col("status") == "BLOCKED", "fail").otherwise("not-applicable")
    return gated.where(F.col("decision") == source).select("project", F.lit(check_id).alias("check_id"), state.alias("state"))


def inconsistent_gates(gated: DataFrame, states: DataFrame, decision_of: DataFrame) -> DataFrame:
    """PASS decisions of which a required check does not pass: (project, decision, n_missing)."""
    passing = states.where("state = 'pass'").select("project", "check_id")
    required = gated.where("status = 'PASS'").join(F.broadcast(decision_of), "decision").select("project", "decision", "check_id")
    return required.join(passing, ["project", "check_id"], "left_anti").groupBy("project", "decision").agg(F.count("*").alias("n_missing"))


def evidence_refs(states: DataFrame, spans: DataFrame, decision_of: DataFrame) -> DataFrame:
    """(project, decision, refs): distinct sorted "url#span" of positive checks."""
    cited = states.where(F.col("state").isin("pass", "claimed")).select("project", "check_id", F.explode("span_ids").alias("span_id"))
    joined = cited.join(spans, ["project", "span_id"]).join(F.broadcast(decision_of), "check_id")
    return joined.groupBy("project", "decision").agg(F.array_sort(F.collect_set(F.concat_ws("#", "url", "span_id"))).alias("refs"))


def confirmation_changes(published: DataFrame) -> DataFrame:
    """(check_id, proposed, changed, rejected, downgraded)."""
    b = F.col("basis")
    return published.groupBy("check_id").agg(
        F.count_if(b != "not-positive").alias("proposed"), F.count_if(b.isin("rejected", "downgraded")).alias("changed"),
        F.count_if(b == "rejected").alias("rejected"), F.count_if(b == "downgraded").alias("downgraded"),
    )


def expand_fixture(rows: DataFrame, checks: list[str], letters: dict[str, tuple[str, str]]) -> DataFrame:
    """(project, check_id, state, basis) from one letter for each check in order."""
    names = F.array(*(F.lit(c) for c in checks))
    code = F.create_map(*(x for k, (s, b) in letters.items() for x in (F.lit(k), F.struct(F.lit(s).alias("state"), F.lit(b).alias("basis")))))
    each = rows.select("project", F.posexplode(F.split("states", "")).alias("i", "letter")).where(F.col("letter") != "")
    return each.select("project", F.element_at(names, F.col("i") + 1).alias("check_id"), code[F.col("letter")]["state"].alias("state"), code[F.col("letter")]["basis"].alias("basis"))


def input_digest(check_id: Column, state: Column, span_ids: Column) -> Column:
    """What a decision binds to: a digest of the check, its state and its spans, in a canonical form."""
    return F.sha2(F.to_json(F.struct(check_id.alias("check"), state.alias("state"), span_ids.alias("spans"))), 256)


def first_valid_attempt(attempts: DataFrame, domain: DataFrame, most: int = 3) -> DataFrame:
    """The first valid of at most `most` attempts of each item, else every check unknown: (item, check_id, state)."""
    first = attempts.where(F.col("valid") & (F.col("attempt") <= most)).groupBy("item").agg(F.min_by("states", "attempt").alias("states"))
    every = attempts.select("item").distinct().join(first, "item", "left").crossJoin(F.broadcast(domain))  # the checks of a review: tens of rows
    return every.select("item", "check_id", F.coalesce(F.col("states")[F.col("check_id")], F.lit("unknown")).alias("state"))


def priority_window(keys: list[str], *order: Column):
    return Window.partitionBy(*keys).orderBy(*order)
