"""Queries over statistics operators. Doubles are rounded to nine places on both sides."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numbers import round_half_up, seeded_uniform, wilson
from ..operators import stats as ss
from ..registry import query, table
from . import shims
from .shims import RATERS


def _r(df, *skip):
    return df.select(*(F.round(F.col(c), 9).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes))


COUNTS = "count(*) FILTER (a AND b) AS tt, count(*) FILTER (a AND NOT b) AS tf, count(*) FILTER (NOT a AND b) AS ft, count(*) FILTER (NOT a AND NOT b) AS ff"
METRICS = """n, tt + tf AS coder_passes, tt + ft AS gold_passes, round(pa, 9) AS pa, round((pa - 2 * q * (1 - q)) / (1 - 2 * q * (1 - q)), 9) AS ac1,
  CASE WHEN pe < 1 THEN round((pa - pe) / (1 - pe), 9) END AS kappa, CASE WHEN tt + tf > 0 THEN round(tt / (tt + tf)::DOUBLE, 9) END AS precision, CASE WHEN tt + ft > 0 THEN round(tt / (tt + ft)::DOUBLE, 9) END AS recall"""
DERIVED = "SELECT *, (tt + ff) / n::DOUBLE AS pa, ((tt + tf) + (tt + ft)) / (2.0::DOUBLE * n) AS q, ((tt + tf) * (tt + ft) + (ft + ff) * (tf + ff)) / (n::DOUBLE * n) AS pe FROM (SELECT *, tt + tf + ft + ff AS n FROM c)"


@query(f"WITH {RATERS}, c AS (SELECT {COUNTS} FROM raters), m AS ({DERIVED}) SELECT {METRICS} FROM m")
def agreement_binary(spark, d):
    return _r(ss.binary_agreement(shims.raters(spark, d)))


@query(f"WITH {RATERS}, c AS (SELECT check_id, {COUNTS} FROM raters GROUP BY GROUPING SETS ((check_id), ())), m AS ({DERIVED}) SELECT check_id, {METRICS} FROM m")
def agreement_by_check_pooled(spark, d):
    return _r(ss.binary_agreement(shims.raters(spark, d), ["check_id"], pooled=True))


@query("""WITH p AS (SELECT l_returnflag AS a, CASE WHEN l_partkey % 3 = 0 THEN 'N' ELSE l_returnflag END AS b FROM lineitem), s AS (SELECT unnest(['A','N','R']) AS k),
  t AS (SELECT count(*) AS n, count(*) FILTER (a = b) AS same FROM p), m AS (SELECT k, (SELECT count(*) FROM p WHERE a = k) AS ca, (SELECT count(*) FROM p WHERE b = k) AS cb FROM s),
  x AS (SELECT n, same / n::DOUBLE AS pa, (SELECT sum((ca + cb) / (2.0::DOUBLE * n) * (1 - (ca + cb) / (2.0::DOUBLE * n))) FROM m) / 2 AS ch, (SELECT sum(ca * cb / (n::DOUBLE * n)) FROM m) AS pe FROM t)
  SELECT n, round(pa, 9) AS pa, round((pa - ch) / (1 - ch), 9) AS ac1, round((pa - pe) / (1 - pe), 9) AS kappa FROM x""")
def agreement_nominal(spark, d):
    li = table(spark, d, "lineitem")
    b = F.when(F.col("l_partkey") % 3 == 0, "N").otherwise(F.col("l_returnflag"))
    return _r(ss.four_state_agreement(li.select(F.col("l_returnflag").alias("a"), b.alias("b")), ["A", "N", "R"]))


@query(f"WITH {RATERS} SELECT round(2.0::DOUBLE * count(*) FILTER (a AND b) / (2 * count(*) FILTER (a AND b) + count(*) FILTER (a <> b)), 9) AS positive_agreement FROM raters")
def positive_agreement(spark, d):
    return _r(ss.positive_agreement(shims.raters(spark, d)))


_UNIFORM = "('0x' || substr(sha256('seed:bootstrap:' || CAST(i AS VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(f"SELECT i, {_UNIFORM} AS u FROM range(1000) t(i)")
def seeded_uniforms(spark, d):
    return spark.range(1000).select(F.col("id").alias("i"), seeded_uniform("seed", F.col("id")).alias("u"))


@query(f"""WITH {RATERS}, cl AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS ix FROM (SELECT DISTINCT cluster FROM raters)), n AS (SELECT count(*) AS n FROM cl),
  dr AS (SELECT CAST(floor(i / n) AS BIGINT) AS draw, CAST(floor({_UNIFORM} * n) AS BIGINT) AS ix FROM n, range(4000) t(i) WHERE i < 60 * n),
  w AS (SELECT draw, cluster, count(*) AS weight FROM dr JOIN cl USING (ix) GROUP BY ALL), k AS (SELECT cluster, {COUNTS} FROM raters GROUP BY cluster),
  c AS (SELECT draw, sum(tt * weight)::BIGINT AS tt, sum(tf * weight)::BIGINT AS tf, sum(ft * weight)::BIGINT AS ft, sum(ff * weight)::BIGINT AS ff FROM k JOIN w USING (cluster) GROUP BY draw),
  m AS ({DERIVED}), v AS (SELECT {METRICS} FROM m), l AS (UNPIVOT (SELECT pa, ac1, kappa, precision, recall FROM v) ON pa, ac1, kappa, precision, recall INTO NAME metric VALUE value),
  g AS (SELECT metric, list_sort(list(value)) AS v, count(*) AS m FROM l WHERE value IS NOT NULL GROUP BY metric)
  SELECT metric, v[CAST(floor(0.025 * (m - 1)) AS BIGINT) + 1] AS low, v[CAST(ceil(0.975 * (m - 1)) AS BIGINT) + 1] AS high FROM g""")
def bootstrap_ci_small(spark, d):
    return _r(ss.bootstrap_ci(shims.raters(spark, d), "seed", 60))


@query()
def bootstrap_ci(spark, d):
    """Intervals of each check and of all, 2000 draws; `bootstrap_ci_small` is its short form that SQL can follow."""
    return ss.bootstrap_ci(shims.raters(spark, d), "seed", 2000, ["check_id"], pooled=True)


@query("""WITH g AS (SELECT CAST(c_nationkey AS BIGINT) AS k, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (c_acctbal > 4000) AS BIGINT) AS x FROM customer GROUP BY 1)
  SELECT g.k, n, x, round((SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE))) FROM range(0, 200) t(i) WHERE i <= n AND i >= x), 9) AS upper,
  round((SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2.0::DOUBLE))) FROM range(0, 200) t(i) WHERE i <= x), 9) AS lower FROM g""")
def binomial_tail(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("g")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 4000).alias("k"))
    return ss.binomial_tails(g).select(F.col("g").alias("k"), "n", F.col("k").alias("x"), F.round("upper", 9).alias("upper"), F.round("lower", 9).alias("lower"))


@query("""WITH t AS (SELECT CAST(c_nationkey AS VARCHAR) AS id, avg(CASE WHEN c_acctbal > 9000 THEN 1.0::DOUBLE ELSE 0.0 END) / 3 AS p FROM customer GROUP BY 1),
  s AS (SELECT id, p, least(1.0::DOUBLE, (count(*) OVER () - row_number() OVER (ORDER BY p, id) + 1) * p) AS step FROM t)
  SELECT id, round(p, 9) AS p, round(max(step) OVER (ORDER BY p, id ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM s""")
def holm_adjust(spark, d):
    c = table(spark, d, "customer")
    tests = c.groupBy(F.col("c_nationkey").cast("string").alias("id")).agg((F.avg(F.when(F.col("c_acctbal") > 9000, 1.0).otherwise(0.0)) / 3).alias("p"))
    return _r(ss.holm(tests))


_OMNIBUS = """cell AS (SELECT check_id, grp, count(*) AS n, count(*) FILTER (positive) AS c FROM (SELECT lang AS check_id, source AS grp, n_chars > 1500 AS positive FROM documents) GROUP BY ALL),
  tot AS (SELECT check_id, sum(n)::BIGINT AS nn, sum(c)::BIGINT AS cc FROM cell GROUP BY check_id),
  part AS (SELECT *, n * cc / nn::DOUBLE AS e FROM cell JOIN tot USING (check_id) WHERE cc > 0 AND cc < nn),
  o AS (SELECT coalesce(sum((c - e) * (c - e) * (1 / e + 1 / (n - e))), 0) AS statistic, max(nn) AS n, count(DISTINCT check_id) AS checks, count(DISTINCT grp) AS groups FROM part)"""


def _omnibus(spark, d):
    doc = table(spark, d, "documents")
    return ss.omnibus(doc.select(F.col("lang").alias("check_id"), F.col("source").alias("grp"), (F.col("n_chars") > 1500).alias("positive")))


@query(f"WITH {_OMNIBUS} SELECT round(statistic, 6) AS statistic, n, checks, groups FROM o")
def chi2_omnibus(spark, d):
    return _omnibus(spark, d).withColumn("statistic", F.round("statistic", 6))


@query(f"WITH {_OMNIBUS} SELECT round(sqrt(statistic / (n * checks)), 8) AS v FROM o")
def cramers_v(spark, d):
    return _omnibus(spark, d).select(F.round(ss.cramers_v(F.col("statistic"), F.col("n"), F.col("checks"), F.col("groups")), 8).alias("v"))


@query("""WITH g AS (SELECT l_shipmode_k AS id, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS c FROM (SELECT *, CAST(l_linenumber AS VARCHAR) AS l_shipmode_k FROM lineitem) GROUP BY 1)
  SELECT id, n, c, CAST(floor(c * 0.887::DOUBLE + 1e-9::DOUBLE) AS BIGINT) AS fewer, CAST(least(n::DOUBLE, ceil(c / 0.887::DOUBLE - 1e-9::DOUBLE)) AS BIGINT) AS more FROM g""")
def recall_bound(spark, d):
    g = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").cast("string").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("c"))
    r = F.lit(0.887)
    return g.select("id", "n", "c", ss.adverse_counts(F.col("c"), F.col("n"), r, "fewer").alias("fewer"), ss.adverse_counts(F.col("c"), F.col("n"), r, "more").alias("more"))


@query("""WITH p AS (SELECT o_custkey AS project, count(*) AS items, count(*) FILTER (o_orderstatus <> 'P') AS found FROM orders GROUP BY 1)
  SELECT sum(items)::BIGINT AS items, sum(found)::BIGINT AS found, count(*) FILTER (items > 0) AS contributing, round(sum(found) / sum(items)::DOUBLE, 9) AS recall, sum(found) / sum(items)::DOUBLE >= 0.7 AND count(*) >= 8 AS accepted FROM p""")
def recall_figure(spark, d):
    p = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("project")).agg(F.count("*").alias("items"), F.count_if(F.col("o_orderstatus") != "P").alias("found"))
    return _r(ss.recall_figure(p))


@query("SELECT count(*) AS audited, count(*) FILTER (a <> b) AS errors, round(count(*) FILTER (a <> b) / count(*)::DOUBLE, 9) AS error_rate, count(*) FILTER (a <> b) / count(*)::DOUBLE <= 0.1 AS within_bar FROM (SELECT quality = 1 AS a, toxic = 0 AS b FROM labels)")
def audit_figure(spark, d):
    la = table(spark, d, "labels")
    return _r(ss.audit_figure(la.select((F.col("quality") == 1).alias("screened"), (F.col("toxic") == 0).alias("verdict"))))


@query(f"""WITH {RATERS}, c AS (SELECT check_id, {COUNTS} FROM raters GROUP BY check_id), m AS ({DERIVED}), v AS (SELECT check_id, {METRICS} FROM m),
  s AS (SELECT *, CASE WHEN n = 0 THEN 'missed' WHEN gold_passes < 10 THEN 'released-not-estimable' WHEN ac1 >= 0.7 AND precision >= 0.85 THEN 'released' ELSE 'missed' END AS base FROM v)
  SELECT check_id, n, CASE WHEN check_id = 'de' AND base = 'missed' THEN 'withheld' WHEN check_id = 'fr' THEN 'person-coded' ELSE base END AS status FROM s""")
def gate_ladder(spark, d):
    m = ss.binary_agreement(shims.raters(spark, d), ["check_id"])
    m = m.withColumn("withheld", F.col("check_id") == "de").withColumn("person_coded", F.col("check_id") == "fr").withColumn("revalidated", F.lit(None).cast("boolean"))
    return ss.gate_ladder(m).select("check_id", "n", "status")


@query("""WITH a AS (SELECT l_orderkey AS k, list_distinct(list(l_suppkey) FILTER (l_linenumber <= 3)) AS x, list_distinct(list(l_suppkey) FILTER (l_linenumber >= 3)) AS y FROM lineitem GROUP BY 1)
  SELECT k, round(len(list_intersect(coalesce(x, []), coalesce(y, []))) / len(list_distinct(list_concat(coalesce(x, []), coalesce(y, []))))::DOUBLE, 9) AS jaccard FROM a""")
def jaccard_sets(spark, d):
    li = table(spark, d, "lineitem")
    part = lambda c: F.collect_set(F.when(c, F.col("l_suppkey")))
    sets = li.groupBy(F.col("l_orderkey").alias("k")).agg(part(F.col("l_linenumber") <= 3).alias("x"), part(F.col("l_linenumber") >= 3).alias("y"))
    return sets.select("k", F.round(ss.jaccard(F.col("x"), F.col("y")), 9).alias("jaccard"))


@query("SELECT c_nationkey AS k, list_sort(list(c_acctbal))[CAST(ceil(count(*) * 0.9) AS BIGINT)] AS p90, list_sort(list(c_acctbal))[CAST(ceil(count(*) * 0.5) AS BIGINT)] AS p50 FROM customer GROUP BY 1")
def nearest_rank_percentiles(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.collect_list("c_acctbal").alias("v"))
    return g.select("k", ss.nearest_rank(F.col("v"), 0.9).alias("p90"), ss.nearest_rank(F.col("v"), 0.5).alias("p50"))


@query("""WITH g AS (SELECT CAST(c_nationkey AS BIGINT) AS k, count(*) AS n, count(*) FILTER (c_acctbal > 5000) AS c FROM customer GROUP BY 1),
  x AS (SELECT *, c / n::DOUBLE AS p, 1.96::DOUBLE AS z FROM g), y AS (SELECT *, (p + z * z / (2 * n)) / (1 + z * z / n) AS mid, z * sqrt(p * (1 - p) / n + z * z / (4.0::DOUBLE * n * n)) / (1 + z * z / n) AS half FROM x)
  SELECT k, n, c, round(greatest(0, mid - half), 9) AS low, round(least(1, mid + half), 9) AS high, floor(100.0::DOUBLE * c / n + 0.5) AS pct FROM y""")
def wilson_rows(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") > 5000).alias("c"))
    low, high = wilson(F.col("c"), F.col("n"))
    return g.select("k", "n", "c", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"), round_half_up(100.0 * F.col("c") / F.col("n")).alias("pct"))


@query()
def permutation_test(spark, d):
    """Random labels of projects against states: a family of projects for each nation, 2000 draws."""
    c = table(spark, d, "customer")
    rows = c.select(F.col("c_nationkey").cast("string").alias("family"), F.col("c_custkey").alias("project"), F.col("c_mktsegment").alias("grp"), F.explode(F.array(*(F.lit(i) for i in range(6)))).alias("check_id"), "c_acctbal")
    return ss.permutation_test(rows.withColumn("positive", (F.col("c_acctbal") * (F.col("check_id") + 3)).cast("long") % 3 == 0), "seed", 2000)
