"""Queries over release operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import EVALUATIVE, TREND
from ..operators import constraints as cst
from ..operators import domains as dom
from ..operators import identifiers as idn
from ..operators import release as rl
from ..operators import states as st
from ..registry import query, table
from ..sources.tables import checkpointed, stored
from . import shims
from .shims import DECISIONS, DOMAIN, GATED, PROJECTS, STATES

SHARES = f"""{STATES}, {PROJECTS}, {DOMAIN},
  member AS (SELECT project, unnest(['all', 'q' || CAST(quarter AS VARCHAR), 'src:' || source]) AS partition FROM projects), sizes AS (SELECT partition, count(*) AS n FROM member GROUP BY 1),
  hits AS (SELECT check_id, partition, count(*) AS c FROM states JOIN member USING (project) WHERE state = 'pass' GROUP BY ALL),
  shares AS (SELECT check_id, partition, coalesce(c, 0) AS c, n FROM sizes CROSS JOIN domain LEFT JOIN hits USING (check_id, partition))"""
#: Shares of a rarer state over nations instead of quarters: many small cells, so that there is something to suppress.
FINE = SHARES.replace("state = 'pass'", "state = 'claimed'").replace("CAST(1 + c_nationkey % 4 AS BIGINT) AS quarter", "c_nationkey AS quarter")
PRIMARY = "(n < 10 OR c < 10 OR n - c < 10)"


def _shares(spark, d):
    return rl.check_shares(shims.states(spark, d), shims.projects(spark, d), shims.domain(spark), "pass")


def _fine(spark, d):
    by_nation = table(spark, d, "customer").select(F.col("c_custkey").alias("project"), F.col("c_nationkey").alias("quarter"), F.col("c_mktsegment").alias("source"))
    return rl.check_shares(shims.states(spark, d), by_nation, shims.domain(spark), "claimed")


@query(f"WITH {SHARES} SELECT * FROM shares")
def check_shares_grouping_sets(spark, d):
    return _shares(spark, d)


@query(f"WITH {SHARES} SELECT check_id, partition, c, n, {PRIMARY} AS suppressed FROM shares")
def primary_suppression(spark, d):
    return rl.suppress(_shares(spark, d))


_ROWS = f"""rows0 AS (SELECT check_id, partition, CASE WHEN check_id = '7' THEN NULL WHEN check_id = '6' THEN false ELSE true END AS available, c, n FROM shares),
  rows1 AS (SELECT *, CASE WHEN available IS NULL THEN 'absent' WHEN NOT available THEN 'withheld' WHEN c < 10 THEN 'lt10' WHEN {PRIMARY} THEN 'suppressed' ELSE 'released' END AS row_state, c / n::DOUBLE AS p FROM rows0),
  rows2 AS (SELECT *, (p + 3.8416::DOUBLE / (2 * n)) / (1 + 3.8416::DOUBLE / n) AS mid, 1.96::DOUBLE * sqrt(p * (1 - p) / n + 3.8416::DOUBLE / (4.0::DOUBLE * n * n)) / (1 + 3.8416::DOUBLE / n) AS half FROM rows1)"""


def _rows(spark, d):
    available = F.when(F.col("check_id") == "7", None).when(F.col("check_id") == "6", False).otherwise(True)
    return rl.resolve_rows(_shares(spark, d).withColumn("available", available))


@query(f"""WITH {SHARES}, {_ROWS} SELECT check_id, partition, row_state, CASE WHEN row_state = 'released' THEN c END AS c, CASE WHEN row_state = 'released' THEN n END AS n,
  CASE WHEN row_state = 'released' THEN floor(100.0::DOUBLE * c / n + 0.5) END AS pct, CASE WHEN row_state = 'released' THEN floor(greatest(0, mid - half) * 1000 + 0.5) / 1000 END AS ci_low,
  CASE WHEN row_state = 'released' THEN floor(least(1, mid + half) * 1000 + 0.5) / 1000 END AS ci_high FROM rows2""")
def row_resolver(spark, d):
    """The flagship: merged and filtered states, shares over partitions, suppression, display rows with intervals."""
    return _rows(spark, d)


@query(f"""WITH {SHARES}, {_ROWS} SELECT check_id, partition, CASE row_state WHEN 'released' THEN 'check ' || check_id || ': ' || c || ' of ' || n || ' (' || CAST(floor(100.0::DOUBLE * c / n + 0.5) AS INTEGER) || '%)'
  WHEN 'lt10' THEN 'check ' || check_id || ': fewer than 10' WHEN 'suppressed' THEN 'check ' || check_id || ': suppressed' WHEN 'withheld' THEN 'check ' || check_id || ': withheld' ELSE 'check ' || check_id || ': not available' END AS sentence FROM rows2""")
def row_sentences(spark, d):
    r = _rows(spark, d)
    return r.select("check_id", "partition", rl.row_sentence(F.concat(F.lit("check "), "check_id"), F.col("row_state"), F.col("c"), F.col("n"), F.col("pct")).alias("sentence"))


@query(f"WITH {SHARES} SELECT check_id, partition, CAST(CASE WHEN c < 10 THEN least(10, n + 1) ELSE n - greatest(10, n - 9) + 1 END AS BIGINT) AS values FROM shares")
def lone_cell_values(spark, d):
    return rl.lone_cells(_shares(spark, d)).select("check_id", "partition", F.col("values").cast("long").alias("values"))


_TERMS = """terms AS (SELECT check_id || '|' || CASE WHEN partition LIKE 'src:%' THEN 'source' ELSE 'quarter' END AS row_id, check_id || '|' || partition AS tuple_id, 1 AS coef FROM shares WHERE partition <> 'all'
  UNION ALL SELECT check_id || '|' || k, check_id || '|all', -1 FROM shares, (SELECT unnest(['quarter', 'source']) AS k) WHERE partition = 'all'), tup AS (SELECT check_id || '|' || partition AS tuple_id, c, """ + PRIMARY + """ AS suppressed FROM shares)"""


def _tuples(shares):
    return rl.suppress(shares).withColumn("tuple_id", F.concat_ws("|", "check_id", "partition"))


@query(f"WITH {SHARES}, {_TERMS} SELECT row_id, tuple_id, coef FROM terms")
def truth_constraints(spark, d):
    return rl.sum_constraints(_shares(spark, d)).select("row_id", "tuple_id", "coef")


@query(f"WITH {SHARES}, {_TERMS} SELECT row_id, sum(coef * c)::BIGINT AS value, sum(coef * c) = 0 AS holds FROM terms JOIN tup USING (tuple_id) GROUP BY 1")
def constraint_check(spark, d):
    s = _shares(spark, d)
    return rl.check_constraints(rl.sum_constraints(s), _tuples(s))


_FOLD = """fold AS (SELECT row_id, tuple_id, coef, '=' AS sense, (-k)::BIGINT AS rhs FROM terms JOIN tup USING (tuple_id) JOIN (SELECT row_id, sum(CASE WHEN suppressed THEN 0 ELSE coef * c END) AS k FROM terms JOIN tup USING (tuple_id) GROUP BY 1) USING (row_id) WHERE suppressed)"""


@query(f"WITH {FINE}, {_TERMS}, {_FOLD} SELECT * FROM fold")
def fold_published(spark, d):
    s = _fine(spark, d)
    return rl.fold_published(rl.sum_constraints(s), _tuples(s))


@query(f"WITH RECURSIVE {FINE}, {_TERMS}, {_FOLD}, e AS (SELECT DISTINCT a.tuple_id AS a, b.tuple_id AS b FROM fold a JOIN fold b USING (row_id)), reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a) SELECT a AS tuple_id, min(b) AS component FROM reach GROUP BY a")
def cells_components(spark, d):
    s = _fine(spark, d)
    return rl.cell_components(rl.fold_published(rl.sum_constraints(s), _tuples(s)))


#: A whole model: states completed for all projects, passes and claims of checks, decisions by nation, both hypotheses and confirmation.
_FULL = f"""{STATES}, {DOMAIN}, {DECISIONS}, projects AS (SELECT c_custkey AS project, c_nationkey AS quarter, c_mktsegment AS source, c_custkey % 7 = 0 AS failed FROM customer),
  dense AS (SELECT project, check_id, coalesce(state, 'unknown') AS state FROM projects CROSS JOIN domain LEFT JOIN states USING (project, check_id)),
  gate AS (SELECT project, decision, CASE WHEN bool_or(state = 'fail') THEN 'BLOCKED' WHEN bool_or(state IN ('unknown', 'claimed')) THEN 'INSUFFICIENT_EVIDENCE' ELSE 'PASS' END AS status FROM dense JOIN decision_of USING (check_id) GROUP BY ALL),
  member AS (SELECT project, unnest(['all', 'q' || CAST(quarter AS VARCHAR), 'src:' || source]) AS partition FROM projects),
  decided AS (SELECT check_id, CASE WHEN state = 'fail' THEN 'rejected' WHEN state = 'claimed' THEN 'downgraded' ELSE 'confirmed' END AS basis FROM dense WHERE state <> 'unknown'),
  facts AS (SELECT (SELECT count(*) FROM projects WHERE failed) AS excluded, (SELECT count(*) FROM decided WHERE basis <> 'confirmed') AS changed),
  hyp AS (SELECT * FROM (VALUES ('h1', ['1', '2'], 'claimed'), ('h3', ['3', '4'], 'pass')) AS t(h, cs, s)),
  model AS (
    SELECT 'chk|' || check_id || '|' || s || '|' || partition AS tuple_id, count(*) AS n, count(*) FILTER (state = s) AS c FROM dense JOIN member USING (project), (SELECT unnest(['pass', 'claimed']) AS s) GROUP BY ALL
    UNION ALL SELECT 'dec|' || decision || '|' || partition, count(*), count(*) FILTER (status = 'PASS') FROM gate JOIN member USING (project) WHERE partition NOT LIKE 'src:%' GROUP BY decision, partition
    UNION ALL SELECT 'sens|dec|' || decision || '|all', count(*), count(*) FILTER (status = 'PASS') FROM gate JOIN projects USING (project) WHERE NOT failed GROUP BY decision
    UNION ALL SELECT h || '|all', count(DISTINCT project), count(DISTINCT project) FILTER (list_contains(cs, check_id) AND state = s) FROM dense, hyp GROUP BY h
    UNION ALL SELECT 'sens|' || h || '|all', count(DISTINCT project), count(DISTINCT project) FILTER (list_contains(cs, check_id) AND state = s) FROM dense JOIN projects USING (project), hyp WHERE NOT failed GROUP BY h
    UNION ALL SELECT 'conf|chk|' || check_id, count(*), count(*) FILTER (basis <> 'confirmed') FROM decided GROUP BY check_id
    UNION ALL SELECT 'conf|' || b, (SELECT count(*) FROM decided), (SELECT count(*) FROM decided WHERE basis = b) FROM (SELECT unnest(['rejected', 'downgraded']) AS b)),
  links AS (
    SELECT 'sum|' || stem || '|' || k AS row_id, tuple_id, 1 AS coef, '=' AS sense, 0 AS rhs FROM (SELECT tuple_id, regexp_replace(tuple_id, '[|][^|]*$', '') AS stem, CASE WHEN contains(tuple_id, 'src:') THEN 'source' ELSE 'quarter' END AS k FROM model WHERE (tuple_id LIKE 'chk|%' OR tuple_id LIKE 'dec|%') AND tuple_id NOT LIKE '%|all')
    UNION ALL SELECT 'sum|' || regexp_replace(tuple_id, '[|]all$', '') || '|' || k, tuple_id, -1, '=', 0 FROM model, (SELECT unnest(['quarter', 'source']) AS k) WHERE tuple_id LIKE 'chk|%|all' OR tuple_id LIKE 'dec|%|all' AND k = 'quarter'
    UNION ALL SELECT 'le|' || tuple_id || '|' || check_id, unnest([tuple_id, 'chk|' || check_id || '|pass|' || string_split(tuple_id, '|')[3]]), unnest([1, -1]), '<=', 0 FROM model JOIN decision_of ON tuple_id LIKE 'dec|' || decision || '|%'
    UNION ALL SELECT 'le|' || h || '|chk|' || c || '|' || s || '|all', unnest(['chk|' || c || '|' || s || '|all', h || '|all']), unnest([1, -1]), '<=', 0 FROM (SELECT h, s, unnest(cs) AS c FROM hyp)
    UNION ALL SELECT 'ge|' || h, 'chk|' || c || '|' || s || '|all', 1, '>=', 0 FROM (SELECT h, s, unnest(cs) AS c FROM hyp) UNION ALL SELECT 'ge|' || h, h || '|all', -1, '>=', 0 FROM hyp
    UNION ALL SELECT 'le|dec|d2|all|h3', unnest(['dec|d2|all', 'h3|all']), unnest([1, -1]), '<=', 0
    UNION ALL SELECT 'ge|' || tuple_id, unnest([substr(tuple_id, 6), tuple_id]), unnest([1, -1]), '>=', 0 FROM model WHERE tuple_id LIKE 'sens|%' UNION ALL SELECT 'le|' || tuple_id, unnest([substr(tuple_id, 6), tuple_id]), unnest([1, -1]), '<=', excluded FROM model, facts WHERE tuple_id LIKE 'sens|%'
    UNION ALL SELECT CASE WHEN tuple_id LIKE 'conf|chk|%' THEN 'sum|conf|chk' ELSE 'sum|conf|kind' END, tuple_id, 1, '=', changed FROM model, facts WHERE tuple_id LIKE 'conf|%')"""


def _model(spark, d):
    """(tuples, rows) of the whole model."""
    from ..operators.views import model_tuples

    c = table(spark, d, "customer")
    projects = c.select(F.col("c_custkey").alias("project"), F.col("c_nationkey").alias("quarter"), F.col("c_mktsegment").alias("source"), (F.col("c_custkey") % 7 == 0).alias("failed"))
    states, of = shims.states(spark, d).select("project", "check_id", "state"), shims.decision_of(spark)
    dense = projects.select("project").crossJoin(shims.domain(spark)).join(states, ["project", "check_id"], "left").withColumn("state", F.coalesce("state", F.lit("unknown")))  # seven checks
    dense = stored(dense)  # every family of tuples reads it
    basis = F.when(F.col("state") == "fail", "rejected").when(F.col("state") == "claimed", "downgraded").otherwise("confirmed")
    decided = dense.where("state <> 'unknown'").select("project", "check_id", basis.alias("basis"))
    shares = [rl.check_shares(dense, projects, shims.domain(spark), s).select(F.concat_ws("|", F.lit("chk"), "check_id", F.lit(s), "partition").alias("tuple_id"), F.col("n").cast("long").alias("n"), "c") for s in ("pass", "claimed")]
    rest = model_tuples(dense, st.rule_gate(dense, of), projects, decided, ["1", "2"], ["3", "4"]).where(~F.col("tuple_id").startswith("st|"))
    tuples = shares[0].unionByName(shares[1]).unionByName(rest.select("tuple_id", "n", "c"))
    facts = projects.agg(F.count_if("failed").alias("excluded")).crossJoin(decided.agg(F.count_if(F.col("basis") != "confirmed").alias("changed")))
    # Hundreds of tuples, which every family of rows reads: counted once.
    tuples, facts = checkpointed(tuples), checkpointed(facts)
    return rl.suppress(tuples), checkpointed(cst.linking_rows(tuples, of, ["1", "2"], ["3", "4"], "d2", facts))


@query(f"WITH {_FULL} SELECT row_id, tuple_id, coef, sense, rhs FROM links")
def model_rows(spark, d):
    """Linking rows of all families."""
    return _model(spark, d)[1]


@query(f"""WITH {_FULL}, s AS (SELECT row_id, sense, rhs, CAST(sum(coef * c) AS BIGINT) AS value FROM links JOIN model USING (tuple_id) GROUP BY ALL)
  SELECT row_id, value, CASE sense WHEN '=' THEN value = rhs WHEN '<=' THEN value <= rhs ELSE value >= rhs END AS holds FROM s""")
def model_rows_hold(spark, d):
    """Every row over the true counts."""
    tuples, rows = _model(spark, d)
    return rl.check_constraints(rows, tuples)


def _required(rows):
    """Rows of sources are only known where the whole is published."""
    whole = rows.where("coef = -1 AND row_id LIKE 'sum|chk|%|source'")
    return whole.select("row_id", "tuple_id")


@query(f"""WITH {_FULL}, sup AS (SELECT *, {PRIMARY} AS suppressed FROM model), gone AS (SELECT DISTINCT row_id FROM links JOIN sup USING (tuple_id) WHERE suppressed AND coef = -1 AND row_id LIKE 'sum|chk|%|source'),
  j AS (SELECT * FROM links JOIN sup USING (tuple_id) WHERE row_id NOT IN (SELECT row_id FROM gone)), k AS (SELECT row_id, CAST(sum(CASE WHEN suppressed THEN 0 ELSE coef * c END) AS BIGINT) AS known FROM j GROUP BY 1)
  SELECT row_id, tuple_id, coef, sense, rhs - known AS rhs FROM j JOIN k USING (row_id) WHERE suppressed""")
def model_fold(spark, d):
    """What readers of the release know of suppressed counts."""
    tuples, rows = _model(spark, d)
    return cst.fold(rows, tuples, _required(rows))


@query()
def model_feasible(spark, d):
    """The counts that each suppressed tuple of the whole model can still have: (tuple_id, component, n_values, least, most)."""
    tuples, rows = _model(spark, d)
    return cst.feasible_counts(tuples, rows, _required(rows))


@query()
def feasible_values(spark, d):
    """Exact feasible counts of each suppressed cell of the release, over all projects, nations and sources: (tuple_id, kind, n_values)."""
    return rl.disclosure(_fine(spark, d), close=False)


@query()
def closure(spark, d):
    """The same release after complementary suppression."""
    return rl.disclosure(_fine(spark, d), close=True)


@query(f"WITH {STATES}, {PROJECTS} SELECT count(DISTINCT project) AS c, (SELECT count(*) FROM projects) AS n FROM states WHERE check_id IN ('1', '2') AND state IN ('pass', 'claimed')")
def any_state_share(spark, d):
    return rl.any_state(shims.states(spark, d), shims.projects(spark, d), ["1", "2"], ["pass", "claimed"])


@query(f"""WITH {STATES}, {PROJECTS}, {DECISIONS}, {GATED} SELECT decision, partition, count(*) FILTER (status = 'PASS') AS c, count(*) AS n FROM (SELECT decision, status, unnest(['all', 'q' || CAST(quarter AS VARCHAR)]) AS partition FROM gated JOIN projects USING (project)) GROUP BY ALL""")
def decision_shares(spark, d):
    return rl.decision_shares(st.rule_gate(shims.states(spark, d), shims.decision_of(spark)), shims.projects(spark, d))


@query(f"WITH {PROJECTS}, s AS (SELECT source, count(*) AS n FROM projects GROUP BY 1) SELECT source, n, (SELECT min(n) FROM s) >= 10 AS shown FROM s")
def partition_tables(spark, d):
    return rl.source_partitions(shims.projects(spark, d))


@query("""WITH m AS (SELECT DISTINCT l_orderkey AS project, CASE WHEN l_suppkey % 13 = 0 THEN 'other' ELSE 's' || CAST(l_suppkey % 13 AS VARCHAR) END AS source FROM lineitem),
  c AS (SELECT source, count(*) AS n FROM m GROUP BY 1), top AS (SELECT * FROM c WHERE source <> 'other' ORDER BY n DESC, source LIMIT 8)
  SELECT * FROM top UNION ALL SELECT 'other', count(DISTINCT project) FROM m WHERE source NOT IN (SELECT source FROM top) HAVING count(*) > 0""")
def source_type_top8(spark, d):
    source = F.when(F.col("l_suppkey") % 13 == 0, "other").otherwise(F.concat(F.lit("s"), (F.col("l_suppkey") % 13).cast("string")))
    return rl.top_sources(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project"), source.alias("source")))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS id, 10 AS n, 1 AS c, 'v1' AS version FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT CAST(c_custkey AS VARCHAR), 20, 2, 'v2' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0""")
def ledger_union(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"))
    old = c.where("id % 2 = 0").select("id", F.lit(10).alias("n"), F.lit(1).alias("c"), F.lit("v1").alias("version"))
    return rl.ledger_union(old, c.where("id % 3 = 0").select("id", F.lit(20).alias("n"), F.lit(2).alias("c")), "v2")


@query(f"WITH {FINE} SELECT check_id || '|' || partition AS id FROM shares WHERE {PRIMARY} AND check_id IN ('1', '2', '3')")
def ledger_pins(spark, d):
    t = _tuples(_fine(spark, d)).withColumn("id", F.col("tuple_id"))
    return rl.pinned(t.where("check_id IN ('1', '2', '3')"), t.where("suppressed"))


_STRIP = "regexp_replace(regexp_replace(t, '`[^`]*`', '', 'g'), '(?is)<code>.*?</code>|<cite>.*?</cite>', '', 'g')"


@query(f"""WITH s AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'cohort' ELSE 's' END || CAST(p_partkey AS VARCHAR) AS id, CASE WHEN p_partkey % 2 = 0 THEN 'finding' ELSE 'method' END AS kind,
  p_name || CASE p_partkey % 4 WHEN 0 THEN ' publicly evidence a score' WHEN 1 THEN ' grows over time' WHEN 2 THEN ' `missing` publicly evidence' ELSE ' <cite>Failing</cite> lacks' END AS t FROM part), x AS (SELECT id, kind, {_STRIP} AS t FROM s)
  SELECT id, 'evaluative-term' AS rule FROM x WHERE kind = 'finding' AND regexp_matches(t, '{EVALUATIVE}') UNION ALL SELECT id, 'missing-publicly-evidence' FROM x WHERE kind = 'finding' AND NOT regexp_matches(t, '(?i)publicly evidence')
  UNION ALL SELECT id, 'trend-wording' FROM x WHERE (kind = 'finding' OR starts_with(id, 'cohort')) AND regexp_matches(t, '{TREND}')""")
def lint_statements(spark, d):
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, " publicly evidence a score").when(k % 4 == 1, " grows over time").when(k % 4 == 2, " `missing` publicly evidence").otherwise(" <cite>Failing</cite> lacks")
    s = table(spark, d, "part").select(F.concat(F.when(k % 5 == 0, "cohort").otherwise("s"), k.cast("string")).alias("id"), F.when(k % 2 == 0, "finding").otherwise("method").alias("kind"), F.concat("p_name", tail).alias("text"))
    return rl.lint_statements(s)


_HOSTS = "regexp_extract(lower(url), '^https?://([^/?#]+)', 1)"
#: Identifiers of pages in their own scripts, and short ones; the texts are the pages with what the odd ones add.
_IDS = f"""ids AS (SELECT DISTINCT 'hostname' AS rule, {_HOSTS} AS v FROM pages UNION SELECT DISTINCT 'url', regexp_replace(lower(url), '^https?://', '') FROM pages UNION SELECT DISTINCT 'hn-id', CAST(page_id AS VARCHAR) FROM pages
    UNION SELECT DISTINCT 'title', lower(split_part(trim(regexp_replace(html, '<[^>]+>', ' ', 'g')), ' ', 1)) FROM pages UNION SELECT 'url', 'xample.co' UNION SELECT 'url', 'xampl' UNION SELECT 'title', '日本語アプリ' UNION SELECT 'title', 'é' UNION SELECT 'url', '%%%')"""
_HOLDS = """contains(t, v) AND CASE rule WHEN 'url' THEN true WHEN 'hn-id' THEN regexp_matches(t, '(^|[^0-9])' || v || '([^0-9]|$)')
    WHEN 'hostname' THEN regexp_matches(t, '(^|[^a-z0-9-])' || regexp_escape(v) || '([^a-z0-9-]|$)') ELSE regexp_matches(t, '(^|[^a-z0-9])' || regexp_escape(v) || '([^a-z0-9]|$)') END"""
_TEXT = "lower(html) || ' at ' || lower(url) || CASE WHEN page_id % 7 = 0 THEN 'x日本語アプリ!' WHEN page_id % 7 = 1 THEN ' 日本語アプリ版' ELSE '' END"


def _identifiers(spark, d):
    from ..functions.text import host

    p = table(spark, d, "pages")
    title = F.split(F.trim(F.regexp_replace("html", "<[^>]+>", " ")), " ")[0]
    given = [("url", F.lit("xample.co")), ("url", F.lit("xampl")), ("title", F.lit("日本語アプリ")), ("title", F.lit("É")), ("url", F.lit("%%%"))]
    values = [("hostname", host(F.col("url"))), ("url", F.regexp_replace(F.lower("url"), "^https?://", "")), ("hn-id", F.col("page_id").cast("string")), ("title", title), *given]
    return p.select(F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), v.alias("value")) for r, v in values))).alias("i")).select("i.rule", "i.value")


def _page_files(spark, d):
    more = F.when(F.col("page_id") % 7 == 0, "x日本語アプリ!").when(F.col("page_id") % 7 == 1, " 日本語アプリ版").otherwise("")
    return table(spark, d, "pages").select(F.col("page_id").alias("file"), "url", F.concat("html", F.lit(" at "), "url", more).alias("text"))


@query(f"WITH {_IDS}, f AS (SELECT page_id AS file, {_TEXT} AS t FROM pages) SELECT file, rule, count(DISTINCT v) AS hits FROM f JOIN ids ON v <> '' AND {_HOLDS} GROUP BY ALL")
def identifier_scan(spark, d):
    return idn.identifier_scan(_page_files(spark, d).select("file", "text"), _identifiers(spark, d))


_BASE = f"base AS (SELECT DISTINCT rule, v FROM ids JOIN (SELECT lower(coalesce(text, '')) AS t FROM conversations) ON v <> '' AND rule IN ('title', 'hostname') AND {_HOLDS})"


@query(f"WITH {_IDS}, {_BASE} SELECT rule, v AS value FROM ids WHERE v <> '' AND (rule, v) NOT IN (SELECT (rule, v) FROM base)")
def without_baseline(spark, d):
    """Identifiers of pages, less titles and hosts that conversations hold."""
    return idn.without_baseline(_identifiers(spark, d), table(spark, d, "conversations").select("text"))


@query(f"""WITH {_IDS}, {_BASE}, kept AS (SELECT rule, v FROM ids WHERE v <> '' AND (rule, v) NOT IN (SELECT (rule, v) FROM base)),
  f AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'out/' || url ELSE 'out/view-' || chr(CAST(97 + page_id % 26 AS INTEGER)) END AS file, {_TEXT} AS t FROM pages),
  files AS (SELECT file, string_agg(t, chr(0) ORDER BY page_id) AS t FROM f GROUP BY file), names AS (SELECT DISTINCT file, rule FROM (SELECT DISTINCT file, lower(file) AS t FROM f) JOIN kept ON {_HOLDS}),
  hits AS (SELECT DISTINCT file, rule FROM f JOIN kept ON {_HOLDS} UNION SELECT file, rule FROM names)
  SELECT CASE WHEN file IN (SELECT file FROM names) THEN '(file name withheld)' ELSE file END AS file, rule FROM hits""")
def scan_files(spark, d):
    """Names and texts of output files, a baseline left out: a file, a rule, nothing else."""
    k = F.col("file")
    name = F.when(k % 3 == 0, F.concat(F.lit("out/"), "url")).otherwise(F.concat(F.lit("out/view-"), F.chr(97 + k % 26)))
    return idn.scan_files(_page_files(spark, d).select(name.alias("file"), "text"), _identifiers(spark, d), table(spark, d, "conversations").select("text"))


#: A suffix table made from the pages' hosts: the domain with most hosts stands with a wildcard and exceptions, the others are rules of their own.
_RULES = f"""hosts AS (SELECT DISTINCT {_HOSTS} AS host FROM pages WHERE url LIKE 'http%'), two AS (SELECT host, regexp_extract(host, '[^.]+[.][^.]+$') AS d FROM hosts), sizes AS (SELECT d, count(*) AS n FROM two GROUP BY d),
  most AS (SELECT arg_min(d, (-n, d)) AS d FROM sizes), rules AS (SELECT '*.' || d AS rule FROM most UNION SELECT d FROM sizes WHERE d NOT IN (SELECT d FROM most) UNION SELECT '!' || host FROM two WHERE d IN (SELECT d FROM most) AND regexp_matches(host, '^[a-m][^.]*[.][^.]*[.][^.]*$'))"""


def _suffix_table(hosts):
    two = hosts.where("host <> ''").distinct().select("host", F.regexp_extract("host", r"[^.]+\.[^.]+$", 0).alias("d"))
    sizes = two.groupBy("d").agg(F.count("*").alias("n"))
    most = sizes.agg(F.min(F.struct(-F.col("n"), "d")).alias("m")).select(F.col("m.d").alias("d"))
    odd = two.join(most, "d", "left_semi").where(F.col("host").rlike(r"^[a-m][^.]*[.][^.]*[.][^.]*$"))
    rule = lambda df, c: df.select(c.alias("rule"))
    return rule(most, F.concat(F.lit("*."), "d")).unionByName(rule(sizes.join(most, "d", "left_anti"), F.col("d"))).unionByName(rule(odd, F.concat(F.lit("!"), "host")))


@query(f"""WITH {_RULES}, e AS (SELECT host, len(string_split(host, '.')) AS n, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM hosts),
  c AS (SELECT host, n, i, array_to_string(string_split(host, '.')[n - i + 1:], '.') AS cut, array_to_string(string_split(host, '.')[n - i + 2:], '.') AS rest FROM e),
  m AS (SELECT host, n, max((rule[1] = '!', CASE WHEN rule[1] = '!' THEN i - 1 ELSE i END)) AS b FROM c JOIN rules ON rule IN (cut, '!' || cut) OR i > 1 AND rule = '*.' || rest GROUP BY ALL),
  s AS (SELECT host, len(string_split(host, '.')) AS n, coalesce(b[2], 1) AS k FROM hosts LEFT JOIN m USING (host))
  SELECT host, array_to_string(string_split(host, '.')[n - k + 1:], '.') AS suffix, CASE WHEN n > k THEN array_to_string(string_split(host, '.')[n - k:], '.') END AS domain FROM s""")
def registrable_domains(spark, d):
    from ..functions.text import host

    hosts = table(spark, d, "pages").select(host(F.col("url")).alias("host"))
    return dom.registrable_domains(hosts, _suffix_table(hosts))


@query("SELECT s FROM (SELECT DISTINCT lang AS view, word AS s FROM (SELECT lang, unnest(string_split(text, ' ')) AS word FROM documents)) GROUP BY s HAVING count(*) = (SELECT count(DISTINCT lang) FROM documents)")
def shared_strings(spark, d):
    docs = table(spark, d, "documents")
    n = docs.select("lang").distinct().count()
    return rl.shared_strings(docs.select(F.col("lang").alias("view"), F.explode(F.split("text", " ")).alias("s")), n)


@query()
def pseudonyms(spark, d):
    """Keyed pseudonyms of customers."""
    return table(spark, d, "customer").select("c_custkey", rl.pseudonym(F.col("c_custkey"), "secret").alias("pseudonym"))


@query("""WITH r AS (SELECT CAST(c_nationkey % 3 AS VARCHAR) AS figure, c_mktsegment AS decision, c_custkey AS ordinal FROM customer), f AS (SELECT figure, decision, min(ordinal) AS first, count(*) AS n FROM r GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY figure) AS total FROM f)
  SELECT figure, decision, CASE WHEN total > 16 THEN row_number() OVER (PARTITION BY figure ORDER BY first) ELSE 1 END AS part, CASE WHEN total > 16 THEN count(*) OVER (PARTITION BY figure) ELSE 1 END AS parts FROM t""")
def figure_parts(spark, d):
    c = table(spark, d, "customer")
    return rl.figure_parts(c.select((F.col("c_nationkey") % 3).cast("string").alias("figure"), F.col("c_mktsegment").alias("decision"), F.col("c_custkey").alias("ordinal")))


@query("SELECT 'orphan' AS rule_id, CAST(o_orderkey AS VARCHAR) AS key, CAST(o_custkey AS VARCHAR) AS detail FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) UNION ALL SELECT 'negative', CAST(c_custkey AS VARCHAR), 'balance' FROM customer WHERE c_acctbal < 0")
def verification_rules(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    orphan = o.join(c.where("c_custkey % 10 <> 0"), o.o_custkey == c.c_custkey, "left_anti").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("detail"))
    return rl.assert_rules({"orphan": orphan, "negative": c.where("c_acctbal < 0").select(F.col("c_custkey").alias("key"), F.lit("balance").alias("detail"))})
