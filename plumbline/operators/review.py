"""Review work: trails, queues, eligibility, refusals, and the small joins and sets between stores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import AUDIT_BAR, RECALL_BAR, STATES
from ..functions.numbers import ratio, wilson
from ..functions.text import json_in, within
from .states import rule_gate

# Gate statuses whose checks may be published, and the size of a screening audit.
PUBLISHABLE = ["released", "released-not-estimable", "corrected-revalidated", "person-coded"]
AUDIT_ROWS = 50


# --- gate and publication ---


def publishable_checks(gate: DataFrame, ready: Column | None = None) -> DataFrame:
    """(check_id): checks whose status may be published; none if the validation is not `ready`."""
    ok = F.col("status").isin(PUBLISHABLE)
    return gate.where(ok if ready is None else ok & ready).select("check_id").distinct()


def published_decisions(published: DataFrame, projects: DataFrame, publishable: DataFrame, decision_of: DataFrame) -> DataFrame:
    """(project, decision, status): the rule gate over published states, everything else unknown.

    A check counts with its published state only if it may be published and has one of pass, claimed and fail.
    """
    shown = published.join(publishable, "check_id", "left_semi").where(F.col("published").isin("pass", "claimed", "fail"))
    every = projects.select("project").crossJoin(F.broadcast(decision_of.select("check_id").distinct()))  # the checks of a review: tens of rows
    states = every.join(shown.select("project", "check_id", "published"), ["project", "check_id"], "left")
    return rule_gate(states.select("project", "check_id", F.coalesce("published", F.lit("unknown")).alias("state")), decision_of)


def decision_tally(states: DataFrame, decision_of: DataFrame) -> DataFrame:
    """(project, decision, pass, claimed, unknown, fail, awaiting): `gate` decides passes and fails, `shown` tells the others apart.

    `shown` null is a check that awaits review; a check with `override` counts as unknown if it neither passes nor fails.
    """
    s = states.join(decision_of, "check_id")
    kind = (
        F.when(F.col("gate").isin("pass", "fail"), F.col("gate")).when(F.col("override"), "unknown").when(F.col("shown") == "claimed", "claimed")
        .when(F.col("shown").isNull(), "awaiting").otherwise("unknown")
    )
    return s.withColumn("kind", kind).groupBy("project", "decision").agg(*(F.count_if(F.col("kind") == k).alias(k) for k in [*STATES, "awaiting"]))


def eligible_projects(sample: DataFrame, cutoff: Column) -> DataFrame:
    """(project, outcome): why a sampled project is in the gate's comparison or not, the first reason that holds.

    Needs protected, has_manifest, has_spans, primary_at, primary_complete, gold_at, gold_digest, digest, gold_outcome, gold_checks, n_checks.
    """
    before = lambda c: F.coalesce(F.col(c) < cutoff, F.lit(True))
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    outcome = (
        F.when(~no("protected"), "protected").when(no("has_manifest"), "incomplete-gold").when(no("has_spans"), "stale-gold").when(before("primary_at") | no("primary_complete"), "stale-primary")
        .when(before("gold_at") | ~F.col("gold_digest").eqNullSafe(F.col("digest")), "stale-gold").when(~F.col("gold_outcome").eqNullSafe(F.lit("labelled")), "no-gold")
        .when(F.coalesce("gold_checks", F.lit(0)) < F.col("n_checks"), "incomplete-gold").otherwise("included")
    )
    return sample.select("project", outcome.alias("outcome"))


def validation_status(audit: DataFrame, recall: DataFrame) -> DataFrame:
    """(name, audit_status, recall_status, ready) of the records of two validations, joined by `name`.

    A missed audit is a limitation of selection if a signed action binds it; a missed recall is repaired by a re-measurement that was
    applied to the sample and meets the bar, or named as a limitation in wording.
    """
    stopped = lambda c: F.coalesce(F.col(c), F.lit(False))
    measured = (F.col("n") == AUDIT_ROWS) & (F.col("assessable") > 0) & F.col("error_rate").isNotNull() & ~stopped("audit_stopped")
    a = F.when(~F.coalesce(measured, F.lit(False)), "missing").when(F.col("error_rate") <= AUDIT_BAR, "within").when(stopped("signed_action"), "selection-limitation").otherwise("missed")
    taken = F.coalesce(F.col("accepted"), F.lit(False)) & F.col("recall").isNotNull() & ~stopped("recall_stopped")
    r = (
        F.when(~taken, "missing").when(F.col("recall") >= RECALL_BAR, "within").when(F.col("action") == "wording-only", "limitation-applied")
        .when((F.col("action") == "apply-to-sample") & (F.col("remeasured") >= RECALL_BAR), "corrected").otherwise("missed")
    )
    both = audit.join(recall, "name").select("name", a.alias("audit_status"), r.alias("recall_status"))
    ready = F.col("audit_status").isin("within", "selection-limitation") & F.col("recall_status").isin("within", "corrected", "limitation-applied")
    return both.withColumn("ready", ready)


def hypothesis_family(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """(family, id, p_holm, sensitivity_p_holm, rejected, supported) of (family, id, p, sensitivity_p, tested).

    Both analyses are adjusted over the family's tested hypotheses; one is supported if both reject it.
    A hypothesis without an analysis of its own sensitivity goes in with the same p.
    """
    some = tests.where("tested").withColumn("sensitivity_p", F.coalesce("sensitivity_p", "p"))
    size = F.count("*").over(Window.partitionBy("family"))
    adjusted = some
    for p, out in (("p", "p_holm"), ("sensitivity_p", "sensitivity_p_holm")):
        w = Window.partitionBy("family").orderBy(p, "id")  # a family is a handful of hypotheses
        step = F.least(F.lit(1.0), (size - F.row_number().over(w) + 1) * F.col(p))
        adjusted = adjusted.withColumn("step", step).withColumn(out, F.max("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rejected = F.col("p_holm") <= alpha
    return adjusted.select("family", "id", "p_holm", "sensitivity_p_holm", rejected.alias("rejected"), (rejected & (F.col("sensitivity_p_holm") <= alpha)).alias("supported"))


def gate_report(gate: DataFrame) -> DataFrame:
    """(check_id, line): a Markdown row for each check of a gate; an inestimable figure says so, and a line with a cell missing is null."""
    precision = F.coalesce(F.col("precision").cast("string"), F.lit("not estimable"))
    status = F.when(F.col("status") == "released-not-estimable", "not estimable").otherwise(F.col("status"))
    cells = [F.col("check_id"), F.col("n").cast("string"), F.col("gold_passes").cast("string"), F.col("ac1").cast("string"), precision, status]
    return gate.select("check_id", F.concat(*(x for c in cells for x in (F.lit("| "), c, F.lit(" "))), F.lit("|")).alias("line"))


# --- review ---


def review_trail(model: DataFrame, second: DataFrame, confirmations: DataFrame, edits: DataFrame, gold: DataFrame, published: DataFrame, blind: bool = False) -> DataFrame:
    """One row for each (project, check_id) of the model with what every other source says of it.

    Confirmations and edits are lists in order of time. A blind reviewer sees no judgement, only the cited spans.
    """
    keys = ["project", "check_id"]
    base = model.select(*keys, "span_ids", F.col("state").alias("model_state"))
    if blind:
        return base.drop("model_state")
    listed = lambda d, cols, name: d.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", *cols))).alias(name))
    parts = [
        second.select(*keys, F.col("state").alias("second_state")), listed(confirmations, ["ord", "decision", "kind"], "confirmations"), listed(edits, ["ord", "state", "kind"], "edits"),
        gold.select(*keys, F.col("state").alias("gold_state")), published.select(*keys, "published", "basis"),
    ]
    joined = reduce(lambda a, b: a.join(b, keys, "left"), parts, base)
    return joined.withColumn("basis", F.coalesce("basis", F.lit("unconfirmed")))


def gold_unlock(projects: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(project, unlocked): a project with its current digest is unlocked by a gold outcome on that very digest."""
    now = outcomes.select("project", "digest").distinct().withColumn("unlocked", F.lit(True))
    return projects.select("project", "digest").join(now, ["project", "digest"], "left").select("project", F.coalesce("unlocked", F.lit(False)).alias("unlocked"))


def work_queue(effective: DataFrame, unlocked: DataFrame, spans: DataFrame, flags: DataFrame) -> DataFrame:
    """(project, check_id, state, n_spans, n_found, flagged): the positives of unlocked projects that await confirmation.

    `n_found` counts the cited spans whose text is there, `flagged` those that try to instruct the reader.
    """
    mine = effective.join(unlocked.where("unlocked"), "project", "left_semi").where(F.col("state").isin("pass", "claimed"))
    cited = mine.select("project", "check_id", F.explode("span_ids").alias("span_id")).distinct()
    marks = cited.join(spans.select("project", "span_id").distinct().withColumn("there", F.lit(True)), ["project", "span_id"], "left")
    marks = marks.join(flags.select("project", "span_id").distinct().withColumn("bad", F.lit(True)), ["project", "span_id"], "left")
    counts = marks.groupBy("project", "check_id").agg(F.count("there").alias("n_found"), F.count("bad").alias("flagged"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return mine.join(counts, ["project", "check_id"], "left").select("project", "check_id", "state", F.size("span_ids").cast("long").alias("n_spans"), zero("n_found"), zero("flagged"))


def complete_prefix(ordered: DataFrame, done: DataFrame) -> DataFrame:
    """(grp, n): how many of a group's items, in order of `position` from 1, are done before the first that is not."""
    marks = ordered.join(done.select("item").distinct().withColumn("ok", F.lit(True)), "item", "left")
    return marks.groupBy("grp").agg(F.coalesce(F.min(F.when(F.col("ok").isNull(), F.col("position"))) - 1, F.max("position")).cast("long").alias("n"))


def top_disagreements(pairs: DataFrame, most: int = 10) -> DataFrame:
    """(check_id, project, rank, place) of (check_id, project, coder, gold): false passes first, then missed ones, then others, by project.

    `place` counts from 1 to `most`. Spark keeps only the first rows of a check on either side of the shuffle.
    """
    other = pairs.where("coder <> gold")
    rank = F.when((F.col("coder") == "pass") & (F.col("gold") != "pass"), 0).when((F.col("coder") != "pass") & (F.col("gold") == "pass"), 1).otherwise(2)
    at = F.row_number().over(Window.partitionBy("check_id").orderBy("rank", "project"))
    return other.withColumn("rank", rank).withColumn("place", at).where(F.col("place") <= most).select("check_id", "project", "rank", "place")


def best_configuration(matrix: DataFrame, order: list[str], least_rate: float = 0.95, least_n: int = 20) -> DataFrame:
    """(model, config, qualified): of the models in `order` the best measured configuration that qualifies, else the best of all.

    Better is: more valid replies, then fewer retries, then a schema, then no thinking. One row, by a minimum, not a sort.
    """
    measured = matrix.where("valid_rate IS NOT NULL")
    place = F.array_position(F.array(*(F.lit(m) for m in order)), F.col("model"))
    ok = (F.col("n") >= least_n) & (F.col("valid_rate") >= least_rate) & (place > 0)
    better = F.struct((~ok).alias("a"), F.when(ok, place).alias("b"), -F.col("valid_rate"), "retry_rate", (F.col("mode") != "schema").alias("c"), F.col("thinking").alias("d"), "model", "config")
    return measured.agg(F.min_by(F.struct("model", "config", ok.alias("qualified")), better).alias("r")).where("r IS NOT NULL").select("r.*")


def own_repositories(links: DataFrame, most_asked: int = 10, most_kept: int = 3) -> DataFrame:
    """(project, repo, place): of a project's first `most_asked` repositories in order seen, the first `most_kept` that are its own."""
    asked = links.withColumn("asked", F.row_number().over(Window.partitionBy("project").orderBy("seen"))).where(F.col("asked") <= most_asked)
    at = F.row_number().over(Window.partitionBy("project").orderBy("seen"))
    return asked.where("own").withColumn("place", at).where(F.col("place") <= most_kept).select("project", "repo", "place")


def recall_items(replies: DataFrame, check_ids: list[str]) -> DataFrame:
    """(id, outcome, items) of (id, raw): the valid items of each reply, in order, as structs (check_id, url, quote, state).

    A reply's JSON is an array, or an object with an array `items`. An item is valid if its check is known, its state is pass or claimed, and its
    address and quote are strings, the quote not blank. `outcome` is items, else what a gatherer retries: unreadable, no items array,
    empty, no valid items. A null or empty reply is unreadable.
    """
    text = lambda k: f"IF(schema_of_variant(try_variant_get(x, '$.{k}', 'variant')) = 'STRING', try_variant_get(x, '$.{k}', 'string'), NULL)"
    parsed = replies.select("id", F.try_parse_json(json_in(F.col("raw"))).alias("v"))
    rows = parsed.withColumn("found", F.expr("IF(startswith(schema_of_variant(v), 'ARRAY'), try_variant_get(v, '$', 'array<variant>'), try_variant_get(v, '$.items', 'array<variant>'))"))
    read = F.expr(f"transform(found, x -> named_struct('check_id', {text('checkId')}, 'url', {text('url')}, 'quote', {text('quote')}, 'state', {text('state')}))")
    valid = F.filter(read, lambda x: x["check_id"].isin(check_ids) & x["state"].isin("pass", "claimed") & x["url"].isNotNull() & x["quote"].rlike(r"\S"))
    rows = rows.withColumn("items", F.coalesce(valid, F.expr("CAST(array() AS array<struct<check_id: string, url: string, quote: string, state: string>>)")))
    outcome = F.when(F.col("v").isNull(), "unreadable").when(F.col("found").isNull(), "no items array").when(F.size("found") == 0, "empty").when(F.size("items") == 0, "no valid items")
    return rows.select("id", outcome.otherwise("items").alias("outcome"), "items")


# --- joins and sets ---


def with_default(left: DataFrame, right: DataFrame, keys: list[str], column: str, default: str = "missing") -> DataFrame:
    """`left` with a column of `right`, or the default where it has no row, and whether both agree on it."""
    theirs = right.select(*keys, F.col(column).alias("_theirs"))
    joined = left.join(theirs, keys, "left").withColumn("other", F.coalesce("_theirs", F.lit(default))).drop("_theirs")
    return joined.withColumn("agree", F.col(column) == F.col("other"))


def cited_pages(states: DataFrame, manifests: DataFrame) -> DataFrame:
    """(project, check_id, url) of the pages that span ids "p<k>-..." point to: the k-th of the project's manifest, from 1."""
    k = F.regexp_extract("span_id", r"^p(\d+)-", 1)
    cited = states.select("project", "check_id", F.explode("span_ids").alias("span_id")).where(k != "").select("project", "check_id", k.cast("long").alias("page"))
    pages = manifests.select("project", F.posexplode("urls").alias("i", "url")).withColumn("page", (F.col("i") + 1).cast("long"))
    return cited.join(pages, ["project", "page"]).select("project", "check_id", "url").distinct()


def first_boundary(urls: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(url, ordinal or null): the first boundary, in order, that an address lies in.

    Boundaries meet addresses by equal hosts: each address asks for its host and every parent of it, so no loop over all pairs runs.
    """
    from ..functions.text import host

    h = F.regexp_replace(host(F.col("url")), r"^www\.", "")
    labels = F.split(h, r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    asked = urls.select("url").distinct().select("url", F.explode(parents).alias("own"))
    known = boundaries.select("ordinal", F.regexp_replace(F.lower("host"), r"^www\.", "").alias("own"), F.struct("host", "path_prefix", "exact").alias("b"))
    met = asked.join(known, "own").where(within(F.col("url"), F.col("b"))).groupBy("url").agg(F.min("ordinal").alias("ordinal"))
    return urls.select("url").join(met, "url", "left")


def enrich(rows: DataFrame, extra: DataFrame, key: str) -> DataFrame:
    """Rows with the columns of `extra`; `error` names the key of a row that has none there."""
    marked = extra.withColumn("_there", F.lit(True))
    joined = rows.join(marked, key, "left")
    return joined.withColumn("error", F.when(F.col("_there").isNull(), F.concat(F.lit("missing "), F.col(key).cast("string")))).drop("_there")


def union_first(sources: list[DataFrame], keys: list[str]) -> DataFrame:
    """The union of sources; of rows with the same keys those of the first source stay."""
    tagged = reduce(DataFrame.unionByName, [d.withColumn("_source", F.lit(i)) for i, d in enumerate(sources)])
    others = [c for c in tagged.columns if c not in (*keys, "_source")]
    picked = tagged.groupBy(*keys).agg(F.min_by(F.struct(*others), "_source").alias("r"))
    return picked.select(*keys, *(F.col(f"r.{c}").alias(c) for c in others))


def domain_difference(found: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, problem): what is missing from a domain and what does not belong to it; empty if both are equal."""
    missing = wanted.select(key).distinct().join(found.select(key).distinct(), key, "left_anti").withColumn("problem", F.lit("missing"))
    extra = found.select(key).distinct().join(wanted.select(key).distinct(), key, "left_anti").withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)


def missing_columns(stores: dict[str, DataFrame], wanted: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(store, column) pairs that are wanted and not there; a store that is not there lacks all."""
    return [(s, c) for s, cols in wanted.items() for c in cols if s not in stores or c not in stores[s].columns]


# --- counts ---


def supported_recall(items: DataFrame) -> DataFrame:
    """(judged, supported, unsupported, boilerplate, supported_found, recall, low, high) of items (supported, boilerplate, found)."""
    sums = items.agg(
        F.count("*").alias("judged"), F.count_if("supported").alias("supported"), F.count_if(~F.col("supported")).alias("unsupported"),
        F.count_if("boilerplate").alias("boilerplate"), F.count_if(F.col("supported") & F.col("found")).alias("supported_found"),
    )
    low, high = wilson(F.col("supported_found"), F.col("supported"))
    return sums.select("*", F.coalesce(ratio(F.col("supported_found"), F.col("supported")), F.lit(0.0)).alias("recall"), low.alias("low"), high.alias("high"))


def view_summaries(views: DataFrame) -> DataFrame:
    """(ref, view, title, passes) of stored JSON views: how many of a view's decisions pass; only identifiable ones show a title."""
    v = F.from_json("json", "title string, decisions array<struct<status: string>>")
    passes = F.size(F.filter(F.coalesce(v["decisions"], F.array().cast("array<struct<status: string>>")), lambda d: d["status"] == "PASS"))
    return views.select("ref", "view", F.when(F.col("view") == "identifiable", v["title"]).alias("title"), passes.cast("long").alias("passes"))


def injection_decisions(decisions: DataFrame, flags: DataFrame) -> DataFrame:
    """(decision, n, invalid): decisions on positives of projects that have flagged spans.

    One that matches its input counts in `n`; one that does not, confirms or downgrades, and cites a flagged span is `invalid`.
    """
    flagged = decisions.join(flags.select("project").distinct(), "project", "left_semi").where(F.col("state").isin("pass", "claimed"))
    mine = flags.groupBy("project").agg(F.collect_set("span_id").alias("bad_spans"))
    cites = F.arrays_overlap("span_ids", "bad_spans") & F.col("decision").isin("confirmed", "downgraded")
    return flagged.join(mine, "project").groupBy("decision").agg(F.count_if("matches").alias("n"), F.count_if(~F.col("matches") & cites).alias("invalid"))


def accounting_faults(runs: DataFrame) -> DataFrame:
    """(run, rule): the invariants of a confirmation run's terminal counts that do not hold."""
    c = F.col
    rules = {
        "inconsistent-accounting": (c("total") > 0) & (c("valid") == c("confirmed") + c("rejected") + c("downgraded")) & (c("accounted") == c("valid") + c("failed"))
        & (c("total") == c("accounted") + c("stopped")) & (c("remaining") == c("total") - c("valid")) & (c("cached") <= c("valid"))
        & (c("attempted") >= c("valid") - c("cached")) & (c("attempted") <= c("total") - c("cached")),
        "no-valid-confirmations": ~((c("valid") == 0) & (c("failed") > 0)),
        "false-completion": ~c("complete") | ((c("valid") == c("total")) & (c("failed") == 0) & (c("stopped") == 0) & (c("awaiting") == 0) & c("reason").isNull()),
        "missing-stop-reason": c("complete") | c("reason").isNotNull() | (c("failed") > 0) | (c("awaiting") > 0),
        "budget-overspend": c("spent") <= c("cap"),
    }
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())))
    return runs.select("run", F.explode(broken).alias("rule"))


def confirmation_accounting(items: DataFrame, by: str) -> DataFrame:
    """(by, total, cached, attempted, valid, failed, accounted, remaining, stopped, ok) of items (by, result, cached), result null if not reached."""
    valid, failed = F.col("result").isin("confirmed", "rejected", "downgraded"), F.col("result") == "failed"
    sums = items.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(valid & F.col("cached")).alias("cached"), F.count_if(F.col("result").isNotNull() & ~(valid & F.col("cached"))).alias("attempted"),
        F.count_if(valid).alias("valid"), F.count_if(failed).alias("failed"),
    )
    sums = sums.withColumn("accounted", F.col("valid") + F.col("failed")).withColumn("remaining", F.col("total") - F.col("valid"))
    return sums.withColumn("stopped", F.col("total") - F.col("accounted")).withColumn("ok", (F.col("failed") == 0) & (F.col("valid") == F.col("total")))


def refused_requests(scope: DataFrame, registered: int = 9, cap: int = 20_000, raised: int = 50_000) -> DataFrame:
    """(key, problem): faults of a registered scope of requests over the cap: repeated keys, estimates not between the caps, bad digests, its size."""
    digest = lambda c: F.coalesce(F.col(c).rlike("^[a-f0-9]{64}$"), F.lit(False))
    key = F.concat_ws(":", "project", "check_id")
    rows = scope.select(key.alias("key"), "tokens", (digest("input_digest") & digest("request_digest")).alias("digests"))
    twice = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("repeated").alias("problem"))
    tokens = rows.where(~F.coalesce((F.col("tokens") > cap) & (F.col("tokens") <= raised), F.lit(False))).select("key", F.lit("estimate").alias("problem"))
    digests = rows.where("NOT digests").select("key", F.lit("digest").alias("problem"))
    size = rows.agg(F.count("*").alias("n")).where(F.col("n") != registered).select(F.lit("scope").alias("key"), F.lit("size").alias("problem"))
    return twice.unionByName(tokens).unionByName(digests).unionByName(size)


def pack_faults(views: DataFrame, access: DataFrame, snapshots: DataFrame) -> DataFrame:
    """(ref, problem): what may not be in a pack: views or snapshots without a basis or under a hold, and views of an unknown kind."""
    ok = access.where(F.col("basis").isNotNull() & ~F.coalesce(F.col("hold"), F.lit(False))).select("ref").distinct()
    named = access.where("pseudonym IS NOT NULL").select(F.col("pseudonym").alias("ref")).distinct()
    problem = lambda d, text: d.select("ref", F.lit(text).alias("problem"))
    return (
        problem(views.where("view = 'identifiable'").join(ok, "ref", "left_anti"), "identifiable view without a basis")
        .unionByName(problem(views.where("view = 'deidentified'").join(named, "ref", "left_anti"), "view without an access row"))
        .unionByName(problem(views.where(~F.coalesce(F.col("view").isin("identifiable", "deidentified"), F.lit(False))), "unknown kind of view"))
        .unionByName(problem(snapshots.join(ok, "ref", "left_anti"), "snapshot without a basis"))
    )


def leak_histogram(hits: DataFrame, df: DataFrame) -> DataFrame:
    """(own, kind, words, frequency, n): where a dictionary term still shows, in counts only, never with the term.

    `hits` are (ref, term_of, term, placeholder); `df` counts the projects that use a word.
    """
    words = F.filter(F.split(F.lower("term"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    rows = hits.select((F.col("ref") == F.col("term_of")).alias("own"), F.col("placeholder").alias("kind"), F.least(F.lit(3), F.size(words)).cast("long").alias("words"), F.when(F.size(words) == 1, words[0]).alias("word"))
    joined = rows.join(df, "word", "left")
    n = F.coalesce("df", F.lit(0))
    frequency = F.when(F.col("word").isNull(), "multi").when(n >= 10, ">=10").when(n >= 3, "3-9").otherwise("<3")
    return joined.groupBy("own", "kind", "words", frequency.alias("frequency")).agg(F.count("*").alias("n"))


def in_vocabulary(terms: DataFrame, df: DataFrame, least: int) -> DataFrame:
    """(term, known): every word of the term is used by `least` projects or more."""
    words = F.filter(F.split(F.lower("term"), r"[^\p{L}\p{M}\p{N}]+"), lambda w: w != "")
    each = terms.select("term").distinct().select("term", F.explode_outer(words).alias("word")).join(df, "word", "left")
    return each.groupBy("term").agg(F.bool_and(F.coalesce(F.col("df") >= least, F.lit(False))).alias("known"))


def dictionary_words(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(term): single words of a dictionary, or forms of them by four rules of stems; a dictionary holds base forms only."""
    t = F.col("term")
    stems = F.array(t, F.regexp_replace(t, "(ed|es|s|ing)$", ""), F.regexp_replace(t, "(d|s)$", ""), F.regexp_replace(t, "(ed|ing)$", "e"))
    asked = terms.select("term").distinct().where(t.rlike("^[a-z]+$")).select("term", F.explode(F.array_distinct(stems)).alias("w")).where(F.length("w") >= 3)
    return asked.join(dictionary.select(F.col("word").alias("w")).distinct(), "w", "left_semi").select("term").distinct()


def fresh_proof(drawn: DataFrame, sample: DataFrame, supplied: DataFrame, recomputed: DataFrame, per_stratum: int) -> DataFrame:
    """(rule, key): faults of a fresh sample: rows of the old one, strata of the wrong size, metrics other than recomputed ones."""
    old = drawn.join(sample.select("project"), "project", "left_semi").select(F.lit("in the old sample").alias("rule"), F.col("project").cast("string").alias("key"))
    sizes = drawn.groupBy("quarter").agg(F.count("*").alias("n")).where(F.col("n") != per_stratum).select(F.lit("size of a stratum").alias("rule"), F.col("quarter").cast("string").alias("key"))
    both = supplied.join(recomputed.withColumnRenamed("value", "again"), "check_id", "full_outer").where(~F.col("value").eqNullSafe(F.col("again")))
    return old.unionByName(sizes).unionByName(both.select(F.lit("metric differs").alias("rule"), "check_id").withColumnRenamed("check_id", "key"))
