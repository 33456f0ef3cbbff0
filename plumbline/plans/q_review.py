"""Queries over review operators and page functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import pages as pg
from ..functions import text as tx
from ..operators import review as rv
from ..operators import states as st
from ..operators import stats as ss
from ..registry import query, table
from . import shims
from .q_states import BOUND, _bound
from .q_stats import COUNTS, DERIVED, METRICS, _r
from .shims import DECISIONS, EDITS, PROJECTS, STATES

#: The gate over line items as pairs of two coders: the second errs the more often, the higher a check's number.
_GATE = f"""gate AS (WITH c AS (SELECT check_id, withheld, person, {COUNTS} FROM (SELECT CAST(l_linenumber AS VARCHAR) AS check_id, (l_returnflag = 'A') <> (l_partkey % 64 < l_linenumber) AS a, l_returnflag = 'A' AS b,
    sum(l_suppkey) OVER w % 2 = 1 AS withheld, count(*) OVER w % 4 = 1 AS person FROM lineitem WINDOW w AS (PARTITION BY l_linenumber)) GROUP BY ALL),
  m AS ({DERIVED}), v AS (SELECT {METRICS}, check_id, withheld, person FROM m),
  s AS (SELECT *, CASE WHEN gold_passes < 10 THEN 'released-not-estimable' WHEN ac1 >= 0.7 AND precision >= 0.85 THEN 'released' ELSE 'missed' END AS base FROM v)
  SELECT check_id, n, gold_passes, ac1, precision, CASE WHEN person THEN 'person-coded' WHEN withheld AND base = 'missed' THEN 'withheld' ELSE base END AS status FROM s)"""
_OK = "('released', 'released-not-estimable', 'corrected-revalidated', 'person-coded')"


def _gate(spark, d):
    li = table(spark, d, "lineitem")
    check, gold = F.col("l_linenumber").cast("string").alias("check_id"), F.col("l_returnflag") == "A"
    pairs = li.select(check, (gold != (F.col("l_partkey") % 64 < F.col("l_linenumber"))).alias("a"), gold.alias("b"))
    flags = li.groupBy(check).agg((F.sum(F.col("l_suppkey").cast("decimal(20,0)")) % 2 == 1).alias("withheld"), (F.count("*") % 4 == 1).alias("person_coded"))
    metrics = _r(ss.binary_agreement(pairs, ["check_id"])).join(flags.withColumnRenamed("check_id", "of"), F.col("check_id").eqNullSafe(F.col("of")))
    return ss.gate_ladder(metrics.drop("of").withColumn("revalidated", F.lit(None).cast("boolean")))


@query(f"WITH {_GATE} SELECT check_id FROM gate WHERE status IN {_OK}")
def publishable_checks(spark, d):
    return rv.publishable_checks(_gate(spark, d), F.col("n") > 0)


@query(f"""WITH {STATES}, {BOUND}, {DECISIONS}, {PROJECTS}, {_GATE},
  x AS (SELECT p.project, d.check_id, coalesce(max(b.published) FILTER (b.published IN ('pass', 'claimed', 'fail') AND g.status IN {_OK}), 'unknown') AS state FROM projects p CROSS JOIN decision_of d
    LEFT JOIN published b ON b.project = p.project AND b.check_id = d.check_id LEFT JOIN gate g ON g.check_id = d.check_id GROUP BY ALL)
  SELECT project, decision, CASE WHEN bool_or(state = 'fail') THEN 'BLOCKED' WHEN bool_or(state IN ('unknown', 'claimed')) THEN 'INSUFFICIENT_EVIDENCE' ELSE 'PASS' END AS status FROM x JOIN decision_of USING (check_id) GROUP BY ALL""")
def published_decisions(spark, d):
    published = st.published_states(*_bound(spark, d))
    return rv.published_decisions(published, shims.projects(spark, d), rv.publishable_checks(_gate(spark, d)), shims.decision_of(spark))


@query(f"""WITH {STATES}, {DECISIONS}, {EDITS}, s AS (SELECT project, check_id, state, CASE WHEN state = 'claimed' THEN 'unknown' ELSE state END AS gate, CASE WHEN project % 3 <> 0 THEN state END AS shown, check_id = '4' AS override FROM states),
  k AS (SELECT project, decision, CASE WHEN gate IN ('pass', 'fail') THEN gate WHEN override THEN 'unknown' WHEN shown = 'claimed' THEN 'claimed' WHEN shown IS NULL THEN 'awaiting' ELSE 'unknown' END AS kind FROM s JOIN decision_of USING (check_id))
  SELECT project, decision, {", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("pass", "claimed", "fail", "unknown", "awaiting"))} FROM k GROUP BY ALL""")
def decision_tally(spark, d):
    s = shims.states(spark, d)
    shown = F.when(F.col("project") % 3 != 0, F.col("state"))
    return rv.decision_tally(s.select("project", "check_id", st.gate_state(F.col("state")).alias("gate"), shown.alias("shown"), (F.col("check_id") == "4").alias("override")), shims.decision_of(spark))


@query("""SELECT o_orderkey AS project, CASE WHEN o_orderkey % 29 = 0 THEN 'protected' WHEN o_orderkey % 23 = 0 THEN 'incomplete-gold' WHEN o_orderkey % 19 = 0 THEN 'stale-gold' WHEN o_orderdate < TIMESTAMP '1993-01-01' OR o_orderstatus = 'P' THEN 'stale-primary'
    WHEN o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 THEN 'stale-gold' WHEN o_orderpriority = '1-URGENT' THEN 'no-gold' WHEN o_orderkey % 9 < 7 THEN 'incomplete-gold' ELSE 'included' END AS outcome FROM orders""")
def eligible_projects(spark, d):
    k = F.col("o_orderkey")
    sample = table(spark, d, "orders").select(
        k.alias("project"), (k % 29 == 0).alias("protected"), (k % 23 != 0).alias("has_manifest"), (k % 19 != 0).alias("has_spans"), F.col("o_orderdate").alias("primary_at"),
        (F.col("o_orderstatus") != "P").alias("primary_complete"), F.when(k % 7 != 0, F.lit("1999-01-01").cast("timestamp")).alias("gold_at"), F.when(k % 5 != 0, "d").otherwise("old").alias("gold_digest"),
        F.lit("d").alias("digest"), F.when(F.col("o_orderpriority") != "1-URGENT", "labelled").alias("gold_outcome"), (k % 9).alias("gold_checks"), F.lit(7).alias("n_checks"),
    )
    return rv.eligible_projects(sample, F.lit("1993-01-01").cast("timestamp"))


@query("""WITH e AS (SELECT event_id AS name, value / 100 AS x, event_id % 3 AS a, event_id % 4 AS b, event_id % 5 AS c FROM events), s AS (SELECT name, CASE WHEN c = 0 THEN 'missing' WHEN x <= 0.1 THEN 'within' WHEN a = 0 THEN 'selection-limitation' ELSE 'missed' END AS audit_status,
    CASE WHEN b = 0 THEN 'missing' WHEN 1 - x >= 0.7 THEN 'within' WHEN a = 1 THEN 'limitation-applied' WHEN a = 2 AND b = 1 THEN 'corrected' ELSE 'missed' END AS recall_status FROM e)
  SELECT *, audit_status IN ('within', 'selection-limitation') AND recall_status IN ('within', 'corrected', 'limitation-applied') AS ready FROM s""")
def validation_status(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("name"), (F.col("value") / 100).alias("x"), (F.col("event_id") % 3).alias("a"), (F.col("event_id") % 4).alias("b"), (F.col("event_id") % 5).alias("c"))
    audit = e.select("name", F.when(F.col("c") != 0, 50).otherwise(49).alias("n"), F.lit(40).alias("assessable"), F.col("x").alias("error_rate"), F.lit(None).cast("boolean").alias("audit_stopped"), (F.col("a") == 0).alias("signed_action"))
    action = F.when(F.col("a") == 1, "wording-only").when(F.col("a") == 2, "apply-to-sample")
    recall = e.select("name", (F.col("b") != 0).alias("accepted"), (1 - F.col("x")).alias("recall"), F.lit(False).alias("recall_stopped"), action.alias("action"), F.when(F.col("b") == 1, 0.9).otherwise(0.1).alias("remeasured"))
    return rv.validation_status(audit, recall)



@query("""WITH t AS (SELECT c_nationkey AS family, c_custkey AS id, (c_custkey * 37 % 1000) / 20000.0::DOUBLE AS p, CASE WHEN c_custkey % 4 = 0 THEN (c_custkey * 37 % 1000) / 20000.0::DOUBLE ELSE (c_custkey * 91 % 1000) / 20000.0::DOUBLE END AS sp FROM customer WHERE c_custkey % 5 <> 0),
  a AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, id) AS i, row_number() OVER (PARTITION BY family ORDER BY sp, id) AS j FROM t),
  h AS (SELECT family, id, max(least(1, (m - i + 1) * p)) OVER (PARTITION BY family ORDER BY p, id) AS p_holm, max(least(1, (m - j + 1) * sp)) OVER (PARTITION BY family ORDER BY sp, id) AS sensitivity_p_holm FROM a)
  SELECT family, id, p_holm, sensitivity_p_holm, p_holm <= 0.05 AS rejected, p_holm <= 0.05 AND sensitivity_p_holm <= 0.05 AS supported FROM h""")
def hypothesis_family(spark, d):
    k = F.col("c_custkey")
    p = lambda m: (k * m % 1000) / 20000
    c = table(spark, d, "customer")
    return rv.hypothesis_family(c.select(F.col("c_nationkey").alias("family"), k.alias("id"), p(37).alias("p"), F.when(k % 4 != 0, p(91)).alias("sensitivity_p"), (k % 5 != 0).alias("tested")))


@query(f"""WITH {_GATE} SELECT check_id, '| ' || check_id || ' | ' || n || ' | ' || gold_passes || ' | ' || CAST(round(ac1, 3) AS VARCHAR) || ' | ' || coalesce(CAST(round(precision, 3) AS VARCHAR), 'not estimable') || ' | ' ||
  CASE WHEN status = 'released-not-estimable' THEN 'not estimable' ELSE status END || ' |' AS line FROM gate""")
def gate_report(spark, d):
    return rv.gate_report(_gate(spark, d).withColumns({c: F.round(c, 3) for c in ("ac1", "precision")}))


# --- review ---


def _sources(spark, d):
    s, e = shims.states(spark, d), shims.edits(spark, d)
    one = e.groupBy("project", "check_id").agg(F.max_by("state", "ord").alias("state"))
    return s, e, one


@query(f"""WITH {STATES}, {BOUND}, one AS (SELECT project, check_id, arg_max(state, ord) AS state FROM edits GROUP BY ALL),
  l AS (SELECT project, check_id, count(*) FILTER (kind = 'person') AS n_confirmations, count(*) FILTER (kind = 'agent') AS n_edits, arg_min(ord, (at_, ord)) FILTER (kind = 'person') AS first_confirmation FROM edits GROUP BY ALL)
  SELECT s.project, s.check_id, s.state AS model_state, CASE WHEN s.project % 2 = 0 THEN o.state END AS second_state, CASE WHEN s.project % 3 = 0 THEN o.state END AS gold_state, p.published, p.basis,
    coalesce(n_confirmations, 0) AS n_confirmations, coalesce(n_edits, 0) AS n_edits, first_confirmation
  FROM states s LEFT JOIN one o USING (project, check_id) LEFT JOIN l USING (project, check_id) LEFT JOIN published p USING (project, check_id)""")
def review_trail(spark, d):
    s, e, one = _sources(spark, d)
    people = e.where("kind = 'person'").withColumn("decision", F.col("state"))
    trail = rv.review_trail(s, one.where("project % 2 = 0"), people, e.where("kind = 'agent'"), one.where("project % 3 = 0"), st.published_states(*_bound(spark, d, s)))
    n = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    count = lambda c: F.when(F.col(c).isNull(), F.lit(0)).otherwise(n(c)).cast("long")
    return trail.select("project", "check_id", "model_state", "second_state", "gold_state", "published", "basis", count("confirmations").alias("n_confirmations"), count("edits").alias("n_edits"), F.get("confirmations", 0)["ord"].alias("first_confirmation"))


@query(f"WITH {STATES} SELECT project, check_id, len(span_ids) AS n_spans FROM states")
def blind_trail(spark, d):
    s, e, one = _sources(spark, d)
    trail = rv.review_trail(s, one, e.withColumn("decision", F.col("state")), e, one, st.published_states(*_bound(spark, d, s)), blind=True)
    return trail.select("project", "check_id", F.size("span_ids").cast("long").alias("n_spans"))


_UNLOCK = "unlock AS (SELECT c_custkey AS project, c_custkey % 4 = 0 AND c_custkey % 3 <> 0 AS unlocked FROM customer)"


def _unlocked(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("project"))
    outcomes = c.where("project % 4 = 0").withColumn("digest", F.when(F.col("project") % 3 != 0, "now").otherwise("old"))
    return rv.gold_unlock(c.withColumn("digest", F.lit("now")), outcomes)


@query(f"WITH {_UNLOCK} SELECT * FROM unlock")
def gold_unlock(spark, d):
    return _unlocked(spark, d)


@query(f"""WITH {STATES}, {_UNLOCK} SELECT project, check_id, state, len(span_ids) AS n_spans, len(list_filter(span_ids, lambda x: CAST(x AS BIGINT) % 2 = 0)) AS n_found, len(list_filter(span_ids, lambda x: CAST(x AS BIGINT) % 5 = 0)) AS flagged
  FROM states JOIN unlock USING (project) WHERE unlocked AND state IN ('pass', 'claimed')""")
def work_queue(spark, d):
    s = shims.states(spark, d)
    cited = s.select("project", F.explode("span_ids").alias("span_id")).distinct()
    return rv.work_queue(s, _unlocked(spark, d), cited.where("span_id % 2 = 0"), cited.where("span_id % 5 = 0"))


@query("""WITH o AS (SELECT c_nationkey AS grp, c_custkey AS item, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS position FROM customer)
  SELECT grp, coalesce(min(position) FILTER (item % 11 = 0) - 1, max(position)) AS n FROM o GROUP BY grp""")
def complete_prefix(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("item"))
    ordered = c.withColumn("position", F.row_number().over(Window.partitionBy("grp").orderBy("item")))
    return rv.complete_prefix(ordered, c.where("item % 11 <> 0"))


@query(f"""WITH {STATES}, {EDITS}, g AS (SELECT project, check_id, arg_max(state, ord) AS gold FROM edits GROUP BY ALL),
  p AS (SELECT check_id, project, CASE WHEN state = 'pass' AND gold <> 'pass' THEN 0 WHEN state <> 'pass' AND gold = 'pass' THEN 1 ELSE 2 END AS rank FROM states JOIN g USING (project, check_id) WHERE state <> gold)
  SELECT check_id, project, rank, row_number() OVER (PARTITION BY check_id ORDER BY rank, project) AS place FROM p QUALIFY place <= 10""")
def top_disagreements(spark, d):
    s, _, one = _sources(spark, d)
    pairs = s.select("project", "check_id", F.col("state").alias("coder")).join(one.select("project", "check_id", F.col("state").alias("gold")), ["project", "check_id"])
    return rv.top_disagreements(pairs).withColumn("place", F.col("place").cast("long"))


@query("""WITH m AS (SELECT 'm' || p_size % 6 AS model, p_partkey AS config, p_size AS n, 0.9 + (p_partkey % 10) / 100.0 AS r, p_partkey % 7 AS retry, p_partkey % 2 = 0 AS schema, p_partkey % 3 = 0 AS thinking FROM part WHERE p_partkey % 13 <> 0),
  q AS (SELECT *, n >= 20 AND r >= 0.95 AND model IN ('m2', 'm4') AS ok FROM m) SELECT model, config, ok AS qualified FROM q ORDER BY NOT ok, CASE WHEN ok THEN model END, r DESC, retry, NOT schema, thinking, model, config LIMIT 1""")
def best_configuration(spark, d):
    k = F.col("p_partkey")
    rate = F.when(k % 13 != 0, (F.lit(90) + k % 10) / 100)
    matrix = table(spark, d, "part").select(F.concat(F.lit("m"), (F.col("p_size") % 6).cast("string")).alias("model"), k.alias("config"), F.col("p_size").alias("n"), rate.alias("valid_rate"), (k % 7).alias("retry_rate"), F.when(k % 2 == 0, "schema").otherwise("object").alias("mode"), (k % 3 == 0).alias("thinking"))
    return rv.best_configuration(matrix, ["m2", "m4"])


@query("""WITH l AS (SELECT l_suppkey AS project, l_orderkey * 10 + l_linenumber AS seen, l_partkey % 3 = 0 AS own FROM lineitem), a AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY project ORDER BY seen) <= 10)
  SELECT project, seen AS repo, row_number() OVER (PARTITION BY project ORDER BY seen) AS place FROM a WHERE own QUALIFY place <= 3""")
def own_repositories(spark, d):
    li = table(spark, d, "lineitem")
    seen = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return rv.own_repositories(li.select(F.col("l_suppkey").alias("project"), seen.alias("seen"), seen.alias("repo"), (F.col("l_partkey") % 3 == 0).alias("own"))).withColumn("place", F.col("place").cast("long"))


@query("""SELECT conv_id, turn, CASE k WHEN 0 THEN 'unreadable' WHEN 3 THEN 'empty' WHEN 4 THEN 'no items array' ELSE CASE WHEN ok THEN 'items' ELSE 'no valid items' END END AS outcome,
  CASE WHEN k IN (1, 2) AND ok THEN [text] ELSE CAST([] AS VARCHAR[]) END AS quotes FROM (SELECT *, conv_id % 5 AS k, turn % 2 = 0 AND regexp_matches(coalesce(text, ''), '\\S') AS ok FROM conversations)""")
def recall_items(spark, d):
    """Turns as a gatherer's replies: prose, a bare array, a fenced object, an empty one, an object without items."""
    k = F.col("conv_id") % 5
    item = lambda check: F.struct(F.lit(check).alias("checkId"), F.lit("https://a.example/").alias("url"), F.col("text").alias("quote"), F.when(F.col("turn") % 2 == 0, "pass").otherwise("fail").alias("state"))
    items = F.array(item("9"), item("1"))
    fenced = F.concat(F.lit("Here:\n```json\n"), F.to_json(F.struct(items.alias("items"))), F.lit("\n```"))
    prose = F.concat(F.lit("none: "), F.regexp_replace(F.coalesce("text", F.lit("")), r"[\[\]{}`]", " "))
    raw = F.when(k == 0, prose).when(k == 1, F.to_json(items)).when(k == 2, fenced).when(k == 3, '{"items": []}').otherwise(F.to_json(F.struct("text")))
    replies = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), raw.alias("raw"))
    return rv.recall_items(replies, list("1234567")).select("id.conv_id", "id.turn", "outcome", F.col("items.quote").alias("quotes"))


@query("""WITH p AS (SELECT page_id, split_part(split_part(url, '/', 3), '.', -2) AS label, page_id % 7 = 0 AS fork, page_id % 4 = 0 AS home, page_id % 3 = 0 AS named FROM pages)
  SELECT page_id, NOT fork AND (home OR named) AS own FROM p""")
def own_repository(spark, d):
    """Repositories told to be a site's by their homepage or their owner's name."""
    k, label = F.col("page_id"), F.element_at(F.split(tx.host(F.col("url")), r"\."), -2)
    owner = F.when(k % 3 == 0, F.concat(F.upper(F.substring(label, 1, 1)), F.lit("-"), F.expr("substring(label, 2)"))).otherwise("someone")
    pages = table(spark, d, "pages").withColumn("label", label)
    home = F.when(k % 4 == 0, F.regexp_replace("url", "^https?://", "")).when(k % 4 == 1, "https://elsewhere.test/")
    return pages.select("page_id", tx.own_repository(owner, F.lit("tool"), home, k % 7 == 0, tx.boundary(F.col("url"))).alias("own"))


# --- joins and sets ---


@query(f"""WITH {STATES}, {EDITS}, o AS (SELECT project, check_id, arg_max(state, ord) AS state FROM edits GROUP BY ALL)
  SELECT s.project, s.check_id, s.state, coalesce(o.state, 'missing') AS other, s.state = coalesce(o.state, 'missing') AS agree FROM states s LEFT JOIN o USING (project, check_id)""")
def archive_or_missing(spark, d):
    s, _, one = _sources(spark, d)
    return rv.with_default(s.select("project", "check_id", "state"), one, ["project", "check_id"], "state")


@query(f"""WITH {STATES} SELECT DISTINCT project, check_id, 'u' || (CAST(x AS BIGINT) % 4 + 1) AS url FROM (SELECT project, check_id, unnest(span_ids) AS x FROM states) WHERE CAST(x AS BIGINT) % 4 < 3""")
def cited_pages(spark, d):
    s = shims.states(spark, d)
    spans = F.transform("span_ids", lambda x: F.concat(F.lit("p"), (x.cast("long") % 4 + 1).cast("string"), F.lit("-s001")))
    manifests = s.select("project").distinct().select("project", F.array(*(F.lit(u) for u in ("u1", "u2", "u3"))).alias("urls"))
    return rv.cited_pages(s.withColumn("span_ids", spans), manifests)


@query("""SELECT 'https://h' || page_id % 6 || '.example.com/en/p' AS url, CASE page_id % 6 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE NULL END AS ordinal FROM pages""")
def first_boundary(spark, d):
    urls = table(spark, d, "pages").select(F.concat(F.lit("https://h"), (F.col("page_id") % 6).cast("string"), F.lit(".example.com/en/p")).alias("url"))
    rows = [(1, "h1.example.com", None, True), (2, "h0.example.com", "/en", False), (3, "h2.example.com", None, False), (4, "h1.example.com", None, False), (5, "H0.example.com", None, False), (3, "h3.example.com", None, True), (6, "h4.example.com", "/de", False), (7, "x.h5.example.com", None, False)]
    return rv.first_boundary(urls, spark.createDataFrame(rows, "ordinal int, host string, path_prefix string, exact boolean"))


@query("SELECT o_custkey, o_orderkey, c_name, CASE WHEN c_name IS NULL THEN 'missing ' || CAST(o_custkey AS VARCHAR) END AS error FROM orders LEFT JOIN (SELECT c_custkey AS o_custkey, c_name FROM customer WHERE c_custkey % 7 <> 0) USING (o_custkey)")
def enrich_or_error(spark, d):
    c = table(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return rv.enrich(table(spark, d, "orders").select("o_custkey", "o_orderkey"), c, "o_custkey")


@query("SELECT o_custkey AS url, CASE WHEN bool_or(o_orderstatus = 'O') THEN 'first' WHEN bool_or(o_orderstatus = 'F') THEN 'second' ELSE 'third' END AS source FROM orders GROUP BY 1")
def union_first_source(spark, d):
    o = table(spark, d, "orders")
    part = lambda s, n: o.where(F.col("o_orderstatus") == s).select(F.col("o_custkey").alias("url"), F.lit(n).alias("source"))
    return rv.union_first([part("O", "first"), part("F", "second"), part("P", "third")], ["url"])


@query("""WITH o AS (SELECT DISTINCT o_custkey AS k FROM orders), c AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0) SELECT k, 'missing' AS problem FROM c WHERE k NOT IN (SELECT k FROM o) UNION ALL SELECT k, 'extra' FROM o WHERE k NOT IN (SELECT k FROM c)""")
def domain_difference(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return rv.domain_difference(o.select(F.col("o_custkey").alias("k")), c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("k")), "k")


@query("SELECT * FROM (VALUES ('orders', 'o_total'), ('parcels', 'p_key')) AS t(store, column_name)")
def missing_columns(spark, d):
    found = rv.missing_columns({"orders": table(spark, d, "orders")}, {"orders": ["o_orderkey", "o_total"], "parcels": ["p_key"]})
    return spark.createDataFrame(found, "store string, column_name string")


# --- counts ---


@query("""WITH i AS (SELECT event_id % 3 <> 0 AS supported, event_id % 10 = 0 AS boilerplate, value > 10 AS found FROM events), s AS (SELECT count(*) AS judged, count(*) FILTER (supported) AS supported, count(*) FILTER (NOT supported) AS unsupported,
    count(*) FILTER (boilerplate) AS boilerplate, count(*) FILTER (supported AND found) AS supported_found FROM i), p AS (SELECT *, supported_found / supported::DOUBLE AS p, supported::DOUBLE AS n FROM s)
  SELECT judged, supported, unsupported, boilerplate, supported_found, p AS recall, (p + 3.8416::DOUBLE / (2 * n)) / (1 + 3.8416::DOUBLE / n) - 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n)) / (1 + 3.8416::DOUBLE / n) AS low,
    (p + 3.8416::DOUBLE / (2 * n)) / (1 + 3.8416::DOUBLE / n) + 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4 * n * n)) / (1 + 3.8416::DOUBLE / n) AS high FROM p""")
def supported_recall(spark, d):
    k = F.col("event_id")
    return rv.supported_recall(table(spark, d, "events").select((k % 3 != 0).alias("supported"), (k % 10 == 0).alias("boilerplate"), (F.col("value") > 10).alias("found")))


@query("SELECT c_custkey AS ref, CASE WHEN c_custkey % 2 = 0 THEN 'identifiable' ELSE 'deidentified' END AS view, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS title, c_custkey % 4 + CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END AS passes FROM customer")
def view_summaries(spark, d):
    n, even = (F.col("c_custkey") % 4).cast("int"), F.col("c_nationkey") % 2 == 0
    one = lambda s: F.struct(F.lit(s).alias("status"))
    many = F.concat(F.array_repeat(one("PASS"), n), F.when(even, F.array(one("PASS"))).otherwise(F.array(one("BLOCKED"))))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("ref"), F.when(F.col("c_custkey") % 2 == 0, "identifiable").otherwise("deidentified").alias("view"), F.to_json(F.struct(F.col("c_name").alias("title"), many.alias("decisions"))).alias("json"))
    return rv.view_summaries(c)


@query(f"""WITH {EDITS}, x AS (SELECT project, CASE state WHEN 'pass' THEN 'confirmed' WHEN 'claimed' THEN 'downgraded' ELSE 'rejected' END AS decision, ord % 3 <> 0 AS matches, ord % 4 = 0 AS cites FROM edits WHERE project % 5 = 0 AND ord % 6 <> 5)
  SELECT decision, count(*) FILTER (matches) AS n, count(*) FILTER (NOT matches AND cites AND decision IN ('confirmed', 'downgraded')) AS invalid FROM x GROUP BY decision""")
def injection_decisions(spark, d):
    e = shims.edits(spark, d)
    decision = F.when(F.col("state") == "pass", "confirmed").when(F.col("state") == "claimed", "downgraded").otherwise("rejected")
    rows = e.select("project", decision.alias("decision"), F.when(F.col("ord") % 6 != 5, "pass").otherwise("unknown").alias("state"), (F.col("ord") % 3 != 0).alias("matches"), F.array(F.when(F.col("ord") % 4 == 0, "bad").otherwise("fine")).alias("span_ids"))
    return rv.injection_decisions(rows, e.where("project % 5 = 0").select("project", F.lit("bad").alias("span_id")))


@query("""WITH r AS (SELECT o_orderkey AS run, o_orderkey % 4 AS failed, o_orderkey % 3 AS stopped, o_orderkey % 5 = 0 AS complete, o_orderkey % 7 = 0 AS twisted, o_orderkey % 6 = 0 AS silent, o_totalprice AS spent FROM orders)
  SELECT run, unnest(list_filter([CASE WHEN twisted THEN 'inconsistent-accounting' END, CASE WHEN complete AND NOT (failed = 0 AND stopped = 0 AND silent) THEN 'false-completion' END,
    CASE WHEN NOT complete AND silent AND failed = 0 THEN 'missing-stop-reason' END, CASE WHEN spent > 200000 THEN 'budget-overspend' END], lambda x: x IS NOT NULL)) AS rule FROM r""")
def accounting_faults(spark, d):
    k = F.col("o_orderkey")
    failed, stopped, twist = k % 4, k % 3, F.when(k % 7 == 0, 1).otherwise(0)
    runs = table(spark, d, "orders").select(
        k.alias("run"), (10 + failed + stopped).alias("total"), F.lit(10).alias("valid"), (F.lit(6) + twist).alias("confirmed"), F.lit(3).alias("rejected"), F.lit(1).alias("downgraded"), failed.alias("failed"), (10 + failed).alias("accounted"),
        stopped.alias("stopped"), (failed + stopped).alias("remaining"), F.lit(2).alias("cached"), F.lit(8).alias("attempted"), (k % 5 == 0).alias("complete"), F.when(k % 6 != 0, "quota").alias("reason"), F.lit(0).alias("awaiting"),
        F.col("o_totalprice").alias("spent"), F.lit(200000.0).alias("cap"),
    )
    return rv.accounting_faults(runs)


@query("""WITH i AS (SELECT l_suppkey AS stage, CASE l_linenumber WHEN 1 THEN 'confirmed' WHEN 2 THEN 'rejected' WHEN 3 THEN 'downgraded' WHEN 4 THEN 'failed' END AS r, l_partkey % 2 = 0 AS c FROM lineitem), s AS (SELECT stage, count(*) AS total,
    count(*) FILTER (r IN ('confirmed', 'rejected', 'downgraded') AND c) AS cached, count(*) FILTER (r = 'failed' OR (r IS NOT NULL AND NOT c)) AS attempted, count(*) FILTER (r IN ('confirmed', 'rejected', 'downgraded')) AS valid, count(*) FILTER (r = 'failed') AS failed FROM i GROUP BY stage)
  SELECT *, valid + failed AS accounted, total - valid AS remaining, total - valid - failed AS stopped, failed = 0 AND valid = total AS ok FROM s""")
def confirmation_accounting(spark, d):
    n = F.col("l_linenumber")
    result = F.when(n == 1, "confirmed").when(n == 2, "rejected").when(n == 3, "downgraded").when(n == 4, "failed")
    return rv.confirmation_accounting(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("stage"), result.alias("result"), (F.col("l_partkey") % 2 == 0).alias("cached")), "stage")


@query("""WITH s AS (SELECT c_nationkey || ':' || c_mktsegment AS key, 15000 + c_custkey * 131 % 40000 AS tokens, c_custkey % 6 = 0 AS bad FROM customer)
  SELECT key, 'repeated' AS problem FROM s GROUP BY key HAVING count(*) > 1 UNION ALL SELECT key, 'estimate' FROM s WHERE NOT (tokens > 20000 AND tokens <= 50000) UNION ALL SELECT key, 'digest' FROM s WHERE bad UNION ALL SELECT 'scope', 'size'""")
def refused_requests(spark, d):
    good = F.sha2(F.col("c_custkey").cast("string"), 256)
    scope = table(spark, d, "customer").select(F.col("c_nationkey").alias("project"), F.col("c_mktsegment").alias("check_id"), (15000 + F.col("c_custkey") * 131 % 40000).alias("tokens"), good.alias("input_digest"), F.when(F.col("c_custkey") % 6 == 0, "x").otherwise(good).alias("request_digest"))
    return rv.refused_requests(scope)


@query("""WITH v AS (SELECT CAST(c_custkey AS VARCHAR) AS ref, CASE c_custkey % 3 WHEN 0 THEN 'identifiable' WHEN 1 THEN 'deidentified' END AS view FROM customer), ok AS (SELECT CAST(c_custkey AS VARCHAR) AS ref FROM customer WHERE c_custkey % 2 = 0 AND c_nationkey % 5 <> 0)
  SELECT ref, 'identifiable view without a basis' AS problem FROM v WHERE view = 'identifiable' AND ref NOT IN (SELECT ref FROM ok) UNION ALL SELECT ref, 'view without an access row' FROM v WHERE view = 'deidentified' AND CAST(ref AS BIGINT) % 7 = 0
  UNION ALL SELECT ref, 'unknown kind of view' FROM v WHERE view IS NULL UNION ALL SELECT ref, 'snapshot without a basis' FROM v WHERE CAST(ref AS BIGINT) % 11 = 0 AND ref NOT IN (SELECT ref FROM ok)""")
def pack_faults(spark, d):
    k = F.col("c_custkey")
    c, ref = table(spark, d, "customer"), F.col("c_custkey").cast("string")
    views = c.select(ref.alias("ref"), F.when(k % 3 == 0, "identifiable").when(k % 3 == 1, "deidentified").alias("view"))
    access = c.select(ref.alias("ref"), F.when(k % 7 != 0, ref).alias("pseudonym"), F.when(k % 2 == 0, "consent").alias("basis"), (F.col("c_nationkey") % 5 == 0).alias("hold"))
    return rv.pack_faults(views, access, c.where("c_custkey % 11 = 0").select(ref.alias("ref")))


_DF = "df AS (SELECT w AS word, count(DISTINCT source) AS df FROM (SELECT source, unnest(regexp_extract_all(lower(text), '[\\pL\\pM\\pN]+(?:[''’.\\-][\\pL\\pM\\pN]+)*')) AS w FROM documents) GROUP BY 1)"


def _df(spark, d):
    from ..operators.evidence import document_frequency

    return document_frequency(table(spark, d, "documents").select(F.col("source").alias("project"), "text"))


_TERMS = "terms AS (SELECT conv_id, turn, array_to_string(string_split(text, ' ')[1:1 + conv_id % 4], ' ') AS term FROM conversations)"


def _terms(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(F.slice(F.split("text", " "), F.lit(1), (F.col("conv_id") % 4 + 1).cast("int")), " ").alias("term"))


@query(f"""WITH {_DF}, {_TERMS}, w AS (SELECT conv_id % 2 = turn % 2 AS own, 'kind' || turn % 2 AS kind, list_filter(regexp_split_to_array(lower(term), '[^\\pL\\pN]+'), lambda x: x <> '') AS ws FROM terms)
  SELECT own, kind, least(3, len(ws)) AS words, CASE WHEN len(ws) <> 1 THEN 'multi' WHEN coalesce(df, 0) >= 10 THEN '>=10' WHEN coalesce(df, 0) >= 3 THEN '3-9' ELSE '<3' END AS frequency, count(*) AS n FROM w LEFT JOIN df ON len(ws) = 1 AND df.word = ws[1] GROUP BY ALL""")
def leak_histogram(spark, d):
    hits = _terms(spark, d).select((F.col("conv_id") % 2).alias("ref"), (F.col("turn") % 2).alias("term_of"), "term", F.concat(F.lit("kind"), (F.col("turn") % 2).cast("string")).alias("placeholder"))
    return rv.leak_histogram(hits, _df(spark, d))


@query(f"""WITH {_DF}, {_TERMS}, w AS (SELECT DISTINCT term, list_filter(regexp_split_to_array(lower(term), '[^\\pL\\pM\\pN]+'), lambda x: x <> '') AS ws FROM terms), x AS (SELECT term, unnest(ws) AS word FROM w)
  SELECT w.term, len(ws) > 0 AND bool_and(coalesce(df >= 3, false)) AS known FROM w LEFT JOIN x USING (term) LEFT JOIN df USING (word) GROUP BY w.term, len(ws)""")
def in_vocabulary(spark, d):
    return rv.in_vocabulary(_terms(spark, d), _df(spark, d), 3)


@query("""WITH dict AS (SELECT DISTINCT lower(string_split(p_name, ' ')[1]) AS w FROM part), t AS (SELECT w || CASE i WHEN 0 THEN '' WHEN 1 THEN 's' WHEN 2 THEN 'ing' WHEN 3 THEN 'x' ELSE 'E' END AS term FROM dict, range(5) r(i)),
  s AS (SELECT term, unnest([term, regexp_replace(term, '(ed|es|s|ing)$', ''), regexp_replace(term, '(d|s)$', ''), regexp_replace(term, '(ed|ing)$', 'e')]) AS w FROM t WHERE regexp_matches(term, '^[a-z]+$'))
  SELECT DISTINCT term FROM s WHERE length(w) >= 3 AND w IN (SELECT w FROM dict)""")
def dictionary_words(spark, d):
    words = table(spark, d, "part").select(F.lower(F.split("p_name", " ")[0]).alias("word")).distinct()
    tails = F.explode(F.array(*(F.lit(x) for x in ("", "s", "ing", "x", "E")))).alias("tail")
    return rv.dictionary_words(words.select("word", tails).select(F.concat("word", "tail").alias("term")), words)


@query("""WITH dr AS (SELECT c_custkey AS project, c_nationkey AS quarter FROM customer WHERE c_custkey % 3 = 0), z AS (SELECT quarter, count(*) AS n FROM dr GROUP BY 1)
  SELECT 'in the old sample' AS rule, CAST(project AS VARCHAR) AS key FROM dr WHERE project % 15 = 0 UNION ALL SELECT 'size of a stratum', CAST(quarter AS VARCHAR) FROM z WHERE n <> 2 UNION ALL SELECT 'metric differs', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_suppkey % 2 = 0""")
def fresh_proof(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("check_id"), F.col("s_suppkey").alias("k"))
    drawn = c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("project"), F.col("c_nationkey").alias("quarter"))
    again = s.where("k % 4 <> 0").select("check_id", F.when(F.col("k") % 2 == 0, 0.5).otherwise(0.25).alias("value"))
    return rv.fresh_proof(drawn, c.where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("project")), s.select("check_id", F.lit(0.25).alias("value")), again, 2)


# --- pages and replies ---


@query("SELECT doc_id, length(text) < 500 AS thin, length(trim(text)) < 100 AS empty FROM documents")
def thin_pages(spark, d):
    return table(spark, d, "documents").select("doc_id", pg.thin(F.col("text")).alias("thin"), pg.empty(F.col("text")).alias("empty"))


@query("""WITH v AS (SELECT page_id, html, length(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n FROM pages)
  SELECT page_id, CASE WHEN page_id % 9 = 0 THEN 'redirect' WHEN page_id % 5 = 0 THEN 'repo-only' WHEN page_id % 5 = 1 THEN 'shared-host' WHEN page_id % 5 = 2 THEN 'shared-host'
    WHEN page_id % 2 = 0 AND n < 590 AND regexp_matches(html, '(?i)<script') THEN 'spa' ELSE 'own-domain' END AS type FROM v""")
def page_type(spark, d):
    k = F.col("page_id")
    url = F.when(k % 5 == 0, "https://www.github.com/a/b").when(k % 5 == 1, "https://huggingface.co/x").when(k % 5 == 2, "https://me.fly.dev/").otherwise(F.col("url"))
    html = F.when(k % 2 == 0, F.concat("html", F.lit('<div id="root">123456789</div>'))).otherwise(F.col("html"))
    return table(spark, d, "pages").select("page_id", pg.page_type(url, k % 9 == 0, html).alias("type"))


@query("SELECT page_id, CASE page_id % 6 WHEN 0 THEN url WHEN 1 THEN 'https://me.dev/x' END AS follow FROM pages")
def homepage_to_follow(spark, d):
    k = F.col("page_id") % 6
    raw = F.when(k == 0, F.col("url")).when(k == 1, "me.dev/x").when(k == 2, "ftp://me.dev").when(k == 3, "https://www.GitHub.com/me").when(k == 4, "gist.github.com/me")
    return table(spark, d, "pages").select("page_id", pg.homepage_to_follow(raw).alias("follow"))


@query("SELECT conv_id, turn, text FROM conversations")
def repository_text(spark, d):
    k = F.col("conv_id") % 3
    coded = F.base64(F.encode("text", "UTF-8"))
    split = F.regexp_replace(F.replace(coded, F.lit("\r\n"), F.lit("")), "(.{60})", "$1\n")
    content = F.when(k == 0, F.col("text")).otherwise(split)
    return table(spark, d, "conversations").select("conv_id", "turn", pg.repository_text(content, F.when(k != 0, "base64").otherwise("utf-8")).alias("text"))


_TALK = "CASE conv_id % 8 WHEN 0 THEN ' We are 1,250 employees. ' WHEN 1 THEN ' only 12 staff, later 3k team members ' WHEN 2 THEN ' raised a total of $12.5 million ' WHEN 3 THEN ' $2bn seed round ' WHEN 4 THEN ' $9m funding ' WHEN 5 THEN ' NYSE: ABC ' WHEN 6 THEN ' uses Nemotron and Tavily ' ELSE ' nothing ' END"


@query(f"""WITH t AS (SELECT conv_id, turn, conv_id % 8 AS k, {_TALK} AS tail FROM conversations) SELECT conv_id, turn, CASE WHEN k IN (0, 1) THEN ['employees'] WHEN k IN (2, 3) THEN ['funding'] WHEN k = 5 THEN ['listed'] ELSE [] END AS patterns,
  CASE WHEN k = 6 THEN ['Tavily', 'NVIDIA'] ELSE [] END AS sponsors, CASE k WHEN 0 THEN 'We are 1,250 employees.' WHEN 5 THEN 'NYSE: ABC' END AS quote FROM t""")
def well_known(spark, d):
    found = table(spark, d, "conversations").select("conv_id", "turn", F.expr(_TALK).alias("t"))
    w = pg.well_known(F.col("t"))
    quote = F.when((F.col("conv_id") % 8).isin(0, 5), F.get(w, 0)["quote"])
    return found.select("conv_id", "turn", F.transform(w, lambda x: x["pattern"]).alias("patterns"), pg.sponsors(F.col("t")).alias("sponsors"), quote.alias("quote"))


@query("SELECT conv_id, turn, (CASE WHEN p > 61 THEN '…' ELSE '' END) || trim(regexp_replace(substr(text, greatest(1, p - 60), least(length(text) + 1, p + 64) - greatest(1, p - 60)), '\\s+', ' ', 'g')) || (CASE WHEN p + 64 <= length(text) THEN '…' ELSE '' END) AS quote FROM (SELECT conv_id, turn, text, 1 + length(text) // 2 AS p FROM conversations)")
def quote_snippets(spark, d):
    c = table(spark, d, "conversations").withColumn("p", (F.floor(F.length("text") / 2) + 1).cast("int"))
    return c.select("conv_id", "turn", pg.quote_around(F.col("text"), F.col("p"), F.lit(4)).alias("quote"))


_REPLY_STAGE = ["ok", "json_parse", "shape", "shape", "span_resolve", "ok", "shape"]
_STAGE_SQL = "CASE event_id % 7 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_REPLY_STAGE)) + " END"


def _stages(spark, d):
    """Replies of seven kinds over checks a and b and spans s1 and s2."""
    one = lambda s, ids: '{"proposedState":"%s","spanIds":%s}' % (s, ids)
    keyed = '{"checks":{"a":%s,"b":%s}}'
    replies = [
        keyed % (one("pass", '["s1"]'), one("unknown", "[]")), '{"checks":', keyed % (one("maybe", "[]"), one("pass", "[]")), '{"checks":{"a":%s}}' % one("pass", "[]"), keyed % (one("pass", '["s9"]'), one("fail", "[]")),
        '{"checks":[{"checkId":"b","proposedState":"fail","spanIds":["s2"]},{"checkId":"a","proposedState":"pass","spanIds":["s1"]}]}', '{"other":1}',
    ]
    raw = F.element_at(F.array(*(F.lit(r) for r in replies)), (F.col("event_id") % 7 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", "event_type", pg.reply_stage(raw, F.array(F.lit("s1"), F.lit("s2")), ["a", "b"], ["pass", "claimed", "fail", "unknown"]).alias("stage"))


@query(f"SELECT event_id, {_STAGE_SQL} AS stage FROM events")
def reply_stages(spark, d):
    return _stages(spark, d).select("event_id", "stage")


@query(f"SELECT event_type, {_STAGE_SQL} AS stage, count(*) AS n FROM events GROUP BY ALL")
def reply_stage_histogram(spark, d):
    return _stages(spark, d).groupBy("event_type", "stage").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 <> 2 THEN c_custkey END AS k FROM customer")
def json_blocks(spark, d):
    k = F.col("c_custkey").cast("string")
    md = F.when(F.col("c_custkey") % 3 == 2, "# no block\n```\n{}\n```").otherwise(F.concat(F.lit("# t\n\n```json\n{\"k\": "), k, F.lit("}\n```\n\n```json\n{\"k\": -1}\n```")))
    return table(spark, d, "customer").select("c_custkey", F.get_json_object(pg.first_json_block(md), "$.k").cast("long").alias("k"))


@query("SELECT c_custkey, [c_name, c_mktsegment, 'a \"quoted\" word'] AS strings FROM customer")
def json_strings(spark, d):
    nested = F.struct(F.col("c_name").alias("name"), F.struct(F.col("c_custkey").alias("n"), F.array(F.col("c_mktsegment"), F.lit('a "quoted" word')).alias("xs")).alias("inner"))
    return table(spark, d, "customer").select("c_custkey", pg.json_strings(F.to_json(nested)).alias("strings"))


@query("""SELECT event_id, CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) AS k, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS VARCHAR) END AS n, CASE WHEN event_id % 2 = 0 THEN 'true' END AS ok, CAST(NULL AS VARCHAR) AS event_type FROM events""")
def numbers_only(spark, d):
    """Records of events: fields are let through by their own type, whatever other fields of that name hold deeper down."""
    e, odd = table(spark, d, "events"), F.col("event_id") % 3 == 0
    inner = F.to_json(F.struct(F.struct(F.col("event_id").alias("n"), F.lit(7).alias("event_type")).alias("inner"), F.when(odd, F.concat(F.lit("secret "), "event_type")).alias("n"), "event_type"))
    own = F.when(odd, inner).otherwise(F.to_json(F.struct(F.struct(F.lit("x").alias("n")).alias("inner"), F.col("event_id").alias("n"), "event_type")))
    ok = F.when(F.col("event_id") % 2 == 0, "true").otherwise('"true"')
    line = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "ok": '), ok, F.lit(", "), F.substring(own, F.lit(2), F.length(own)))
    m = pg.numbers_only(line, ["k", "n", "ok", "event_type"])
    return e.select("event_id", *(m[c].alias(c) for c in ("k", "n", "ok", "event_type")))


@query("""WITH l AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN ['url-not-on-allow-list'] WHEN 1 THEN ['email-address'] WHEN 2 THEN ['api-key-assignment', 'bearer-token'] ELSE [] END AS rules FROM events) SELECT event_id, rules FROM l""")
def record_faults(spark, d):
    k = F.col("event_id") % 5
    line = F.when(k == 0, "see https://evil.example/x and https://docs.ok.example/").when(k == 1, "me@there.org 12").when(k == 2, "API_KEY=abc Bearer abcdefgh123").when(k == 3, "p50 3707 https://docs.ok.example/y").otherwise("n = 25")
    return table(spark, d, "events").select("event_id", pg.record_faults(line, ["docs.ok.example"]).alias("rules"))


@query("SELECT p_partkey, CAST(ceil(p_size / 10.0) AS BIGINT) * CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS map_credits, CAST(ceil(p_size / 5.0) AS BIGINT) * CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END AS extract_credits FROM part")
def credits(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select("p_partkey", pg.map_credits(F.col("p_size"), k % 2 == 0).alias("map_credits"), pg.extract_credits(F.col("p_size"), k % 3 == 0).alias("extract_credits"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, strftime(CAST(ts AS DATE) - INTERVAL 1 DAY, '%Y-%m-%d') AS last_day FROM events")
def days(spark, d):
    return table(spark, d, "events").select("event_id", pg.day_of(F.unix_timestamp("ts")).alias("day"), pg.last_day(F.col("ts")).alias("last_day"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN '^(?:.+\\.)?[aA][bB]\\.[iI][oO]$' WHEN 1 THEN '^[aA][bB]\\.[iI][oO]$' ELSE '^[gG][hH]$' END AS domain, CASE WHEN page_id % 3 = 2 THEN '^/[mM][eE]/[xX]\\+1(?:/.*)?$' END AS path FROM pages")
def boundary_selectors(spark, d):
    k = F.col("page_id") % 3
    b = F.struct(F.when(k == 2, "GH").otherwise("Ab.io").alias("host"), F.when(k == 2, "/me/x+1").alias("path_prefix"), (k == 1).alias("exact"))
    return table(spark, d, "pages").select("page_id", pg.selectors(b).alias("s")).select("page_id", "s.domain", "s.path")
