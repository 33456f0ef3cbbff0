"""Queries over validation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import validation as vl
from ..registry import query, table
from . import shims
from .shims import STATES, USAGE

#: Labels as audited records, documents without one as excluded by the log.
_AUDIT = """r AS (SELECT quality = 1 AS assessable, CASE WHEN doc_id % 5 <> 0 THEN toxic = 1 END AS include, CASE WHEN source <> 'web' AND lang <> 'de' THEN source END AS reason FROM labels JOIN documents USING (doc_id)),
  g AS (SELECT CASE WHEN n_chars < 900 THEN 'excluded' ELSE 'included' END AS kind, CASE lang WHEN 'en' THEN 'duplicate' WHEN 'fr' THEN 'unreachable-at-screening' ELSE lang END AS reason FROM documents)"""
_P = "errors / nullif(assessable, 0)::DOUBLE"
_HALF = f"1.96 * sqrt({_P} * (1 - {_P}) / assessable + 1.96 * 1.96 / (4.0 * assessable * assessable)) / (1 + 1.96 * 1.96 / assessable)"
_MIDDLE = f"({_P} + 1.96 * 1.96 / (2.0 * assessable)) / (1 + 1.96 * 1.96 / assessable)"


def _records(spark, d):
    both = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id")
    include = F.when(F.col("doc_id") % 5 != 0, F.col("toxic") == 1)
    return both.select((F.col("quality") == 1).alias("assessable"), include.alias("include"), F.when((F.col("source") != "web") & (F.col("lang") != "de"), F.col("source")).alias("reason"))


@query(f"""WITH {_AUDIT}, s AS (SELECT count(*) AS n, count(*) FILTER (assessable) AS assessable, count(*) FILTER (NOT assessable) AS not_assessable, count(*) FILTER (assessable AND include) AS errors FROM r)
  SELECT *, round(coalesce({_P}, 0), 9) AS error_rate, round(greatest(0, {_MIDDLE} - {_HALF}), 9) AS low, round(least(1, {_MIDDLE} + {_HALF}), 9) AS high, coalesce({_P}, 0) <= 0.1 AS within FROM s""")
def screening_audit(spark, d):
    out = vl.screening_audit(_records(spark, d))
    return out.select(*(F.round(c, 9).alias(c) if c in ("error_rate", "low", "high") else c for c in out.columns))


@query(f"""WITH {_AUDIT} SELECT 'original' AS part, coalesce(reason, 'unknown') AS code, count(*) AS n FROM r GROUP BY ALL
  UNION ALL SELECT 'operational', reason, count(*) FROM g WHERE kind = 'excluded' AND reason IN ('duplicate', 'unreachable-at-screening') GROUP BY ALL""")
def audit_histogram(spark, d):
    lang = F.col("lang")
    reason = F.when(lang == "en", "duplicate").when(lang == "fr", "unreachable-at-screening").otherwise(lang)
    log = table(spark, d, "documents").select(F.when(F.col("n_chars") < 900, "excluded").otherwise("included").alias("kind"), reason.alias("reason"))
    return vl.audit_histogram(_records(spark, d), log)


#: Line items of large and small quantities as two collections of a customer's pages, orders as their quotes, states with and without edits.
_CHECKED = f"""{STATES}, li AS (SELECT o_custkey AS project, CAST(l_suppkey AS VARCHAR) AS url, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  pg AS (SELECT project, url, bool_or(q > 15) AS l, bool_or(q < 35) AS r FROM li GROUP BY ALL),
  ps AS (SELECT project, count(*) FILTER (l AND r) AS both_, count(*) FILTER (l AND NOT r) AS left_only, count(*) FILTER (r AND NOT l) AS right_only FROM pg WHERE l OR r GROUP BY project),
  qt AS (SELECT o_custkey AS project, lower(o_orderpriority) || ' ' || CAST(o_orderkey % 3 AS VARCHAR) AS q, bool_or(o_orderstatus <> 'F') AS l, bool_or(o_orderstatus <> 'O') AS r FROM orders GROUP BY ALL),
  qs AS (SELECT project, count(*) FILTER (l) AS left_quotes, count(*) FILTER (r) AS right_quotes, count(*) FILTER (l AND r) AS shared FROM qt GROUP BY project),
  sp AS (SELECT project, count(*) AS checks, count(*) FILTER (state = CASE WHEN check_id = '7' THEN 'missing' WHEN project % 5 = 0 THEN 'pass' ELSE state END) AS agree FROM states GROUP BY project),
  checked AS (SELECT c_custkey AS project, coalesce(both_, 0) AS "both", coalesce(left_only, 0) AS left_only, coalesce(right_only, 0) AS right_only, coalesce(left_quotes, 0) AS left_quotes,
    coalesce(right_quotes, 0) AS right_quotes, coalesce(shared, 0) AS shared, coalesce(checks, 0) AS checks, coalesce(agree, 0) AS agree, coalesce(both_ / (both_ + left_only + right_only)::DOUBLE, 1) AS jaccard
    FROM customer LEFT JOIN ps ON ps.project = c_custkey LEFT JOIN qs ON qs.project = c_custkey LEFT JOIN sp ON sp.project = c_custkey)"""


def _checked(spark, d):
    o = table(spark, d, "orders")
    li = table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("project"), F.col("l_suppkey").cast("string").alias("url"), "l_quantity")
    part = lambda flag, text: o.where(flag).select(F.col("o_custkey").alias("project"), text.alias("quote"))
    number = (F.col("o_orderkey") % 3).cast("string")
    left = part(F.col("o_orderstatus") != "F", F.concat(F.lit(" "), "o_orderpriority", F.lit(" \n"), number))
    right = part(F.col("o_orderstatus") != "O", F.concat(F.upper("o_orderpriority"), F.lit("\t"), number, F.lit(" ")))
    s = shims.states(spark, d)
    other = s.where("check_id <> '7'").withColumn("state", F.when(F.col("project") % 5 == 0, "pass").otherwise(F.col("state")))
    projects = table(spark, d, "customer").select(F.col("c_custkey").alias("project"))
    return vl.cross_check(projects, (li.where("l_quantity > 15"), li.where("l_quantity < 35")), (left, right), (s, other))


@query(f"WITH {_CHECKED} SELECT * REPLACE (round(jaccard, 9) AS jaccard) FROM checked")
def cross_check(spark, d):
    return _checked(spark, d).withColumn("jaccard", F.round("jaccard", 9))


@query(f"WITH {_CHECKED} SELECT count(*) AS n, round(avg(jaccard), 9) AS mean_jaccard, round(sum(agree) / sum(checks), 9) AS agreement FROM checked")
def cross_check_figure(spark, d):
    return vl.cross_check_figure(_checked(spark, d)).select("n", F.round("mean_jaccard", 9).alias("mean_jaccard"), F.round("agreement", 9).alias("agreement"))


#: Events as edits that people hand in, and as decisions of those who may have made the edits.
_HANDED = """opened AS (SELECT c_custkey AS project FROM customer WHERE c_custkey % 4 <> 0),
  e AS (SELECT event_id, user_id AS project, CAST(1 + event_id % 8 AS VARCHAR) AS check_id, date_trunc('day', ts) AS at_, 'p' || CAST(event_id % 3 AS VARCHAR) AS actor,
    CASE WHEN value < 2 THEN 'maybe' WHEN value < 10 THEN 'pass' WHEN value < 20 THEN 'claimed' WHEN value < 40 THEN 'fail' ELSE 'unknown' END AS state,
    CASE WHEN event_id % 9 = 0 THEN CAST([] AS BIGINT[]) WHEN event_id % 5 = 0 THEN [event_id % 7, event_id % 11, event_id % 13] ELSE [event_id % 7] END AS span_ids, value FROM events)"""


def _handed(spark, d):
    k, v = F.col("event_id"), F.col("value")
    e = table(spark, d, "events").select(
        k, F.col("user_id").alias("project"), (1 + k % 8).cast("string").alias("check_id"), F.date_trunc("day", "ts").alias("at"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("actor"),
        F.when(v < 2, "maybe").when(v < 10, "pass").when(v < 20, "claimed").when(v < 40, "fail").otherwise("unknown").alias("state"),
        F.when(k % 9 == 0, F.array().cast("array<long>")).when(k % 5 == 0, F.array(k % 7, k % 11, k % 13)).otherwise(F.array(k % 7)).alias("span_ids"), v,
    )
    opened = table(spark, d, "customer").select(F.col("c_custkey").alias("project"), (F.col("c_custkey") % 4 != 0).alias("unlocked"))
    return e, opened


@query(f"""WITH {_HANDED}, known AS (SELECT DISTINCT project, event_id % 13 AS span_id FROM e WHERE value < 30),
  cited AS (SELECT event_id, project, unnest(span_ids) AS span_id, generate_subscripts(span_ids, 1) AS at_ FROM e),
  strange AS (SELECT event_id, arg_min(span_id, at_) AS s FROM cited ANTI JOIN known USING (project, span_id) GROUP BY 1),
  f AS (SELECT e.*, CASE WHEN project NOT IN (FROM opened) THEN 'gold locked' WHEN check_id = '8' THEN 'unknown check id: 8' WHEN state = 'maybe' THEN 'invalid state: maybe'
    WHEN s IS NOT NULL THEN 'unknown span id: ' || CAST(s AS VARCHAR) END AS fault FROM e LEFT JOIN strange USING (event_id))
  SELECT event_id AS edit_id, project, check_id, fault, CASE WHEN fault IS NULL THEN CASE WHEN len(span_ids) = 0 THEN 'unknown' ELSE state END END AS filtered_state,
    CASE WHEN fault IS NULL THEN CASE WHEN state = 'unknown' THEN CAST([] AS BIGINT[]) ELSE span_ids END END AS filtered_spans FROM f""")
def edit_faults(spark, d):
    e, opened = _handed(spark, d)
    known = e.where("value < 30").select("project", (F.col("event_id") % 13).alias("span_id"))
    return vl.edit_faults(e.withColumnRenamed("event_id", "edit_id"), known, shims.domain(spark), opened)


@query(f"""WITH {STATES}, {_HANDED}, newest AS (SELECT project, check_id, state AS edit_state, actor AS editor FROM e WHERE event_id % 5 < 3
    QUALIFY row_number() OVER (PARTITION BY project, check_id ORDER BY at_ DESC, event_id) = 1),
  f AS (SELECT event_id AS decision_id, e.project, e.check_id, CASE WHEN event_id % 4 = 1 THEN 'downgraded' WHEN event_id % 10 = 3 THEN 'rejected' ELSE 'confirmed' END AS decision,
    e.actor, s.state AS model_state, n.editor, coalesce(n.edit_state, s.state) AS now FROM e LEFT JOIN states s USING (project, check_id) LEFT JOIN newest n USING (project, check_id) WHERE event_id % 5 >= 3),
  g AS (SELECT *, CASE WHEN project NOT IN (FROM opened) THEN 'gold locked' WHEN check_id = '8' THEN 'unknown check id: 8' WHEN model_state IS NULL THEN 'no model state for ' || check_id
    WHEN editor = actor THEN 'cannot decide on own edit' WHEN decision = 'downgraded' AND now <> 'pass' THEN 'downgrade only from pass' WHEN now NOT IN ('pass', 'claimed') THEN 'not a positive: ' || now END AS fault FROM f)
  SELECT decision_id, project, check_id, fault, CASE WHEN fault IS NULL THEN CASE decision WHEN 'downgraded' THEN 'claimed' WHEN 'confirmed' THEN now END END AS confirmed_state FROM g""")
def decision_faults(spark, d):
    e, opened = _handed(spark, d)
    k = F.col("event_id")
    decision = F.when(k % 4 == 1, "downgraded").when(k % 10 == 3, "rejected").otherwise("confirmed")
    asked = e.where(k % 5 >= 3).select(k.alias("decision_id"), "project", "check_id", decision.alias("decision"), "actor")
    return vl.decision_faults(asked, shims.states(spark, d), e.where(k % 5 < 3).withColumn("ord", k), shims.domain(spark), opened)


@query(f"""WITH {USAGE}, p AS (SELECT * FROM (VALUES ('m0', 1e-6::DOUBLE, 3e-6::DOUBLE, 1e-7::DOUBLE), ('m1', 3e-7::DOUBLE, 9e-7::DOUBLE, NULL)) AS t(model, prompt, completion, rate)),
  u AS (SELECT *, CASE WHEN event_id % 8 = 0 THEN input + 1 WHEN event_id % 4 = 0 THEN cached END AS known FROM usage),
  h AS (SELECT *, CASE WHEN rate IS NOT NULL AND known <= input THEN known ELSE 0 END AS hits FROM u LEFT JOIN p USING (model))
  SELECT event_id, round(input * prompt + output * completion, 12) AS list_cost, round((input - hits) * prompt + output * completion + hits * coalesce(rate, 0), 12) AS measured_cost FROM h""")
def call_costs(spark, d):
    prices = spark.createDataFrame([("m0", 1e-6, 3e-6, 1e-7), ("m1", 3e-7, 9e-7, None)], "model string, prompt double, completion double, cached_prompt double")
    k = F.col("event_id")
    calls = shims.usage(spark, d).withColumn("cached", F.when(k % 8 == 0, F.col("input") + 1).when(k % 4 == 0, F.col("cached"))).withColumn("model", F.when(k % 5 == 0, F.concat("model", F.lit(":cloud"))).otherwise(F.col("model")))
    return vl.call_costs(calls, prices).select("event_id", F.round("list_cost", 12).alias("list_cost"), F.round("measured_cost", 12).alias("measured_cost"))


@query("""WITH l AS (SELECT o_orderpriority AS stage, CAST(count(*) AS DOUBLE) AS cap, sum(CAST(o_orderkey % 7 AS DOUBLE)) AS spent, sum(CAST(o_custkey % 5 AS DOUBLE)) - CASE WHEN o_orderpriority LIKE '2%' THEN 1e9 ELSE 0 END AS reserved FROM orders GROUP BY 1),
  c AS (SELECT stage, cap + CASE WHEN stage LIKE '3%' THEN 1 ELSE 0 END AS approved, CASE WHEN stage < '3' THEN 'a' ELSE 'b' END AS host, 1e5::DOUBLE AS host_cap FROM l WHERE stage NOT LIKE '5%'),
  j AS (SELECT *, spent + reserved AS charged FROM l LEFT JOIN c USING (stage)), h AS (SELECT host, sum(charged) AS host_charged FROM j WHERE host IS NOT NULL GROUP BY 1)
  SELECT stage, host, CASE WHEN approved IS NULL THEN 'unknown stage' WHEN cap <> approved THEN 'cap mismatch' WHEN reserved < 0 THEN 'invalid amount' END AS fault, charged, host_charged, host_cap - host_charged AS host_left FROM j LEFT JOIN h USING (host)""")
def budget_ledger(spark, d):
    stage = F.col("o_orderpriority")
    sums = table(spark, d, "orders").groupBy(stage.alias("stage")).agg(F.count("*").cast("double").alias("cap"), F.sum((F.col("o_orderkey") % 7).cast("double")).alias("spent"), F.sum((F.col("o_custkey") % 5).cast("double")).alias("held"))
    ledger = sums.select("stage", "cap", F.col("spent").alias("estimated"), "spent", (F.col("held") - F.when(F.col("stage").startswith("2"), 1e9).otherwise(0.0)).alias("reserved"))
    raised = (F.col("cap") + F.when(F.col("stage").startswith("3"), 1.0).otherwise(0.0)).alias("cap")
    caps = sums.where(~F.col("stage").startswith("5")).select("stage", raised, F.when(F.col("stage") < "3", "a").otherwise("b").alias("host"), F.lit(1e5).alias("host_cap"))
    return vl.budget_ledger(ledger, caps)
