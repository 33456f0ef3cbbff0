"""Queries over state operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import states as st
from ..registry import query, table
from ..sources import tables as tb
from . import shims
from .shims import DECISIONS, DOMAIN, EDITS, GATED, STATES


@query(f"WITH {STATES} SELECT project, check_id, state, span_ids FROM states0")
def merge_chunk_codings(spark, d):
    return st.merge_chunks(shims.codings(spark, d)).withColumn("span_ids", F.sort_array("span_ids"))


@query(f"WITH {STATES} SELECT project, check_id, state, span_ids FROM states")
def quote_or_unknown(spark, d):
    return shims.states(spark, d).withColumn("span_ids", F.sort_array("span_ids"))


@query(f"WITH {STATES} SELECT project, check_id, len(list_filter(span_ids, lambda x: CAST(x AS BIGINT) % 11 = 0)) = 0 AND (state = 'unknown') = (len(span_ids) = 0) AS resolves FROM states0")
def citation_resolves(spark, d):
    merged = st.merge_chunks(shims.codings(spark, d))
    known = F.filter("span_ids", lambda s: s.cast("long") % 11 != 0)
    return merged.select("project", "check_id", st.citations_resolve(F.col("state"), F.col("span_ids"), known).alias("resolves"))


TALLY = "tally AS (SELECT check_id, " + ", ".join(f"count(*) FILTER (state = '{s}') AS \"{s}\"" for s in ("pass", "claimed", "fail", "unknown")) + " FROM states GROUP BY check_id)"


@query(f"WITH {STATES}, {TALLY} SELECT * FROM tally")
def tally_by_check(spark, d):
    return st.tally(shims.states(spark, d), shims.domain(spark))


@query(f"WITH {STATES}, {TALLY} SELECT *, pass + claimed = 0 AS at_floor FROM tally")
def floor_effect(spark, d):
    return st.floor_effect(st.tally(shims.states(spark, d), shims.domain(spark)))


NEWEST = "newest AS (SELECT * FROM edits QUALIFY row_number() OVER (PARTITION BY project, check_id ORDER BY at_ DESC, ord) = 1)"


@query(f"WITH {EDITS}, {NEWEST} SELECT project, check_id, ord, state FROM newest")
def latest_edit(spark, d):
    return st.latest(shims.edits(spark, d), ["project", "check_id"], "at", "ord").select("project", "check_id", "ord", "state")


EFFECTIVE = "effective AS (SELECT s.project, s.check_id, coalesce(e.state, s.state) AS state, e.state IS NOT NULL AS edited FROM states s LEFT JOIN newest e USING (project, check_id))"


@query(f"WITH {STATES}, {EDITS}, {NEWEST}, {EFFECTIVE} SELECT * FROM effective")
def effective_states(spark, d):
    return st.effective_states(shims.states(spark, d), shims.edits(spark, d))


@query(f"WITH {EDITS} SELECT project, check_id, ord, kind FROM edits QUALIFY row_number() OVER (PARTITION BY project, check_id ORDER BY kind = 'person' DESC, at_ DESC, ord DESC) = 1")
def picked_decision(spark, d):
    return st.pick_decision(shims.edits(spark, d), ["project", "check_id"]).select("project", "check_id", "ord", "kind")


def _bound(spark, d, states=None):
    """States and decisions with digests: a decision is on the current one unless its number is divisible by 5."""
    digest = F.sha2(F.concat_ws("|", "project", "check_id", F.lit("v1")), 256)
    effective = (shims.states(spark, d) if states is None else states).withColumn("digest", digest)
    e = shims.edits(spark, d)
    other = F.sha2(F.concat_ws("|", "project", "check_id", F.lit("v0")), 256)
    decision = F.when(F.col("state") == "pass", "confirm").when(F.col("state") == "claimed", "downgrade").otherwise("reject")
    return effective, e.select("project", "check_id", "at", "ord", "kind", F.when(F.col("ord") % 5 == 0, other).otherwise(digest).alias("digest"), decision.alias("decision"), F.lit("claimed").alias("confirmed_state"))


BOUND = f"""{EDITS}, log AS (SELECT *, ord % 5 <> 0 AS current, CASE state WHEN 'pass' THEN 'confirm' WHEN 'claimed' THEN 'downgrade' ELSE 'reject' END AS decision FROM edits),
  pick AS (SELECT * FROM log WHERE current QUALIFY row_number() OVER (PARTITION BY project, check_id ORDER BY kind = 'person' DESC, at_ DESC, ord DESC) = 1),
  anyd AS (SELECT DISTINCT project, check_id FROM log),
  basis AS (SELECT s.project, s.check_id, s.state, CASE WHEN s.state NOT IN ('pass', 'claimed') THEN 'not-positive' WHEN p.decision = 'confirm' THEN 'confirmed' WHEN p.decision = 'downgrade' THEN 'downgraded'
    WHEN p.decision = 'reject' THEN 'rejected' WHEN a.project IS NOT NULL THEN 'stale' ELSE 'unconfirmed' END AS basis
    FROM states s LEFT JOIN pick p USING (project, check_id) LEFT JOIN anyd a USING (project, check_id)),
  published AS (SELECT project, check_id, CASE WHEN basis IN ('not-positive', 'confirmed') THEN state WHEN basis = 'downgraded' THEN 'claimed' WHEN basis = 'rejected' THEN 'unknown' END AS published, basis FROM basis)"""


@query(f"WITH {STATES}, {BOUND} SELECT * FROM published")
def published_states(spark, d):
    return st.published_states(*_bound(spark, d))


@query(f"""WITH {STATES}, {BOUND} SELECT s.project, s.check_id, CASE WHEN n.project IS NOT NULL THEN 'decided' WHEN a.project IS NOT NULL THEN 'stale' ELSE 'undecided' END AS status
  FROM states s LEFT JOIN (SELECT DISTINCT project, check_id FROM log WHERE current) n USING (project, check_id) LEFT JOIN anyd a USING (project, check_id)""")
def decision_status(spark, d):
    return st.decision_status(*_bound(spark, d))


@query(f"""WITH {STATES}, {BOUND} SELECT check_id, count(*) FILTER (basis <> 'not-positive') AS proposed, count(*) FILTER (basis IN ('rejected', 'downgraded')) AS changed,
  count(*) FILTER (basis = 'rejected') AS rejected, count(*) FILTER (basis = 'downgraded') AS downgraded FROM published GROUP BY check_id""")
def confirmation_changes(spark, d):
    return st.confirmation_changes(st.published_states(*_bound(spark, d)))


@query(f"WITH {STATES}, {DECISIONS}, {GATED} SELECT * FROM gated")
def rule_gate(spark, d):
    return st.rule_gate(shims.states(spark, d), shims.decision_of(spark))


@query(f"""WITH {STATES}, {DECISIONS}, {GATED}, dep AS (SELECT project, '3' AS check_id, CASE status WHEN 'PASS' THEN 'pass' WHEN 'BLOCKED' THEN 'fail' ELSE 'not-applicable' END AS state FROM gated WHERE decision = 'd1'),
  s2 AS (SELECT project, check_id, state FROM states WHERE check_id <> '3' UNION ALL SELECT * FROM dep)
  SELECT project, decision, CASE WHEN bool_or(state = 'fail') THEN 'BLOCKED' WHEN bool_or(state IN ('unknown', 'claimed', 'not-applicable')) THEN 'INSUFFICIENT_EVIDENCE' ELSE 'PASS' END AS status
  FROM s2 JOIN decision_of USING (check_id) GROUP BY ALL""")
def dependent_gate(spark, d):
    s, of = shims.states(spark, d), shims.decision_of(spark)
    mirrored = st.dependent_check(st.rule_gate(s, of), "d1", "3")
    return st.rule_gate(s.where("check_id <> '3'").select("project", "check_id", "state").unionByName(mirrored), of)


@query(f"""WITH {STATES}, {DECISIONS}, {GATED} SELECT g.project, g.decision, count(*) AS n_missing FROM gated g JOIN decision_of o USING (decision) WHERE g.status = 'PASS'
  AND NOT EXISTS (SELECT 1 FROM states s WHERE s.project = g.project AND s.check_id = o.check_id AND s.state = 'pass') GROUP BY ALL""")
def gate_inconsistencies(spark, d):
    s, of = shims.states(spark, d), shims.decision_of(spark)
    return st.inconsistent_gates(st.rule_gate(s, of), s, of)


@query(f"""WITH {STATES}, {DECISIONS} SELECT project, decision, list_sort(list_distinct(list('u' || CAST(CAST(x AS BIGINT) % 3 AS VARCHAR) || '#' || x))) AS refs
  FROM (SELECT project, check_id, unnest(span_ids) AS x FROM states WHERE state IN ('pass', 'claimed')) JOIN decision_of USING (check_id) GROUP BY ALL""")
def evidence_refs(spark, d):
    s = shims.states(spark, d)
    spans = s.select("project", F.explode("span_ids").alias("span_id")).distinct().withColumn("url", F.concat(F.lit("u"), (F.col("span_id").cast("long") % 3).cast("string")))
    return st.evidence_refs(s, spans, shims.decision_of(spark))


@query("""SELECT project, CAST(i AS VARCHAR) AS check_id, CASE letter WHEN 'B' THEN 'pass' WHEN 'A' THEN 'claimed' WHEN 'M' THEN 'fail' ELSE 'unknown' END AS state, CASE letter WHEN 'B' THEN 'confirmed' WHEN 'A' THEN 'unconfirmed' WHEN 'M' THEN 'not-positive' ELSE 'x' END AS basis
  FROM (SELECT c_custkey AS project, i, substr(c_mktsegment, i, 1) AS letter FROM customer, range(1, 4) t(i)) WHERE letter IN ('B', 'A', 'M')""")
def expand_fixture(spark, d):
    letters = {"B": ("pass", "confirmed"), "A": ("claimed", "unconfirmed"), "M": ("fail", "not-positive")}
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("project"), F.substring("c_mktsegment", 1, 3).alias("states"))
    return st.expand_fixture(rows, ["1", "2", "3"], letters).where("state IS NOT NULL")


@query("""WITH a AS (SELECT user_id AS item, CAST(event_id % 4 + 1 AS BIGINT) AS attempt, event_id, value < 30 AS valid, event_type FROM events), f AS (SELECT item, arg_min(event_type, (attempt, event_id)) FILTER (valid AND attempt <= 3) AS s FROM a GROUP BY item)
  SELECT item, check_id, CASE WHEN s IS NULL THEN 'unknown' ELSE s || check_id END AS state FROM f, (SELECT unnest(['1','2','3','4','5','6','7']) AS check_id)""")
def first_valid_attempt(spark, d):
    e = table(spark, d, "events")
    states = F.map_from_entries(F.array(*(F.struct(F.lit(c), F.concat("event_type", F.lit(c))) for c in shims.CHECKS)))
    attempts = e.select(F.col("user_id").alias("item"), (F.col("event_id") % 4 + 1).alias("a"), "event_id", (F.col("value") < 30).alias("valid"), states.alias("states"))
    attempts = attempts.withColumn("attempt", F.struct("a", "event_id")).withColumn("valid", F.col("valid") & (F.col("a") <= 3))
    return st.first_valid_attempt(attempts.withColumn("attempt", F.col("a") + F.col("event_id") * 1e-9), shims.domain(spark), most=4)


@query("""WITH o AS (SELECT user_id AS k, max(event_id) AS v FROM events WHERE event_id % 2 = 0 GROUP BY k), n AS (SELECT user_id AS k, arg_max(event_id, value) AS v FROM events WHERE event_id % 3 = 0 GROUP BY k)
  SELECT * FROM o WHERE k NOT IN (SELECT k FROM n) UNION ALL SELECT * FROM n""")
def store_upsert(spark, d):
    e = table(spark, d, "events")
    old = e.where("event_id % 2 = 0").groupBy(F.col("user_id").alias("k")).agg(F.max("event_id").alias("v"))
    return tb.upsert(old, e.where("event_id % 3 = 0").select(F.col("user_id").alias("k"), F.col("event_id").alias("v"), F.struct("value", -F.col("event_id")).alias("ord")), ["k"])


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def store_insert_missing(spark, d):
    o, li = table(spark, d, "orders").select("o_orderkey"), table(spark, d, "lineitem")
    old = o.join(li.where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")
    return tb.insert_missing(old, o, ["o_orderkey"])


@query("SELECT sha256(text) AS hash, any_value(text) AS text FROM documents GROUP BY 1")
def content_addressed(spark, d):
    return tb.content_addressed(table(spark, d, "documents"))


@query("SELECT sha256(cast(c_custkey AS VARCHAR) || ':' || c_mktsegment) AS digest, c_custkey FROM customer WHERE c_custkey % 3 <> 0")
def stage_cache_misses(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    cached = tb.cache_misses(c.where("c_custkey % 3 = 0"), spark.createDataFrame([], "stage string, digest string"), "code").select(F.lit("code").alias("stage"), "digest")
    return tb.cache_misses(c, cached, "code").select(F.sha2(F.concat_ws(":", "c_custkey", "c_mktsegment"), 256).alias("digest"), "c_custkey")


@query("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'events', count(*) FROM events")
def store_row_counts(spark, d):
    return tb.row_counts({n: table(spark, d, n) for n in ("customer", "orders", "events")})


@query("SELECT 'domain:o_orderstatus' AS rule, count(*) AS n FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT 'key:o_custkey', count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) > 1)")
def schema_violations(spark, d):
    return tb.violations(table(spark, d, "orders"), ["o_custkey"], {"o_orderstatus": ["O", "F"]}, ["o_orderkey"])


@query(f"""WITH {EDITS}, cur AS (SELECT project, check_id, max(ord) AS now FROM edits GROUP BY ALL) SELECT kind, CASE WHEN e.ord = c.now THEN 'current' ELSE 'stale' END AS reason, count(*) AS n
  FROM edits e JOIN cur c USING (project, check_id) GROUP BY ALL""")
def labelled_export_counts(spark, d):
    e = shims.edits(spark, d).withColumn("digest", F.col("ord").cast("string"))
    current = e.groupBy("project", "check_id").agg(F.max("ord").cast("string").alias("digest"))
    rows, excluded = tb.export_labelled({k: e.where(F.col("kind") == k).drop("kind") for k in ("person", "agent")}, current)
    return rows.groupBy("kind").agg(F.lit("current").alias("reason"), F.count("*").alias("n")).unionByName(excluded)
