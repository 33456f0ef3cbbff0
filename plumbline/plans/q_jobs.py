"""Queries over job logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import jobs as jb
from ..registry import query, table
from . import shims
from .shims import USAGE

STAGES = ["signup", "view", "click", "purchase", "error", "none"]


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events")
def event_sequence(spark, d):
    return jb.numbered(table(spark, d, "events"), "user_id", "ts", "event_id").select("event_id", "seq")


@query(f"""WITH dom AS (SELECT unnest({STAGES}) AS stage, CAST(generate_subscripts({STAGES}, 1) - 1 AS BIGINT) AS ord), n AS (SELECT user_id AS job, event_type AS stage, CAST(arg_max(event_id, (ts, event_id)) AS VARCHAR) AS status FROM events GROUP BY ALL),
  e AS (SELECT job, stage, ord, status, max(CASE WHEN status IS NOT NULL THEN ord END) OVER (PARTITION BY job) AS last FROM (SELECT DISTINCT user_id AS job FROM events) CROSS JOIN dom LEFT JOIN n USING (job, stage))
  SELECT job, stage, ord, coalesce(status, CASE WHEN ord < last THEN 'skipped' ELSE 'waiting' END) AS status FROM e""")
def latest_stage_event(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("event_type").alias("stage"), F.col("ts").alias("at"), "event_id", F.col("event_id").cast("string").alias("status"))
    return jb.latest_by_stage(e, STAGES).withColumn("ord", F.col("ord").cast("long"))


@query("SELECT event_id AS id, row_number() OVER (ORDER BY event_id) - 1 AS ahead FROM events WHERE value > 20")
def queue_position(spark, d):
    return jb.queue_positions(table(spark, d, "events").select(F.col("event_id").alias("id"), (F.col("value") > 20).alias("active")))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND 1 PRECEDING) AS recent FROM events")
def rolling_24h(spark, d):
    return jb.rolling_count(table(spark, d, "events"), ["event_type"], "ts").select("event_id", "recent")


@query("""WITH r AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 431999999999 PRECEDING AND 1 PRECEDING) AS recent, lag(ts, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS oldest FROM events)
  SELECT event_id, recent, CAST(epoch(date_trunc('second', oldest)) AS BIGINT) + 432000 AS resets FROM r WHERE recent >= 2""")
def quota_resets(spark, d):
    e = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return jb.quota_resets(e, ["user_id"], 2, 432000).select("event_id", "recent", F.unix_seconds("resets_at").alias("resets"))


@query("SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20")
def recent_20(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select("event_id", "user_id")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_name, c_custkey LIMIT 50 OFFSET 50")
def page_of_50(spark, d):
    return jb.page_of(table(spark, d, "customer").where("c_acctbal > 0"), [F.col("c_name"), F.col("c_custkey")], 2).select("c_custkey")


def _prices(spark):
    return spark.createDataFrame([("m0", 1e-6, 3e-6), ("m1", 3e-7, 9e-7)], "model string, prompt double, completion double")


@query(f"""WITH {USAGE}, p AS (SELECT * FROM (VALUES ('m0', 1e-6::DOUBLE, 3e-6::DOUBLE), ('m1', 3e-7::DOUBLE, 9e-7::DOUBLE)) AS t(model, prompt, completion))
  SELECT stage, model, count(*) AS calls, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, round(sum(charged), 4) AS charged, round(sum(input * prompt + output * completion), 9) AS list_cost FROM usage LEFT JOIN p USING (model) GROUP BY GROUPING SETS ((stage, model), ())""")
def usage_receipt(spark, d):
    return jb.usage_receipt(shims.usage(spark, d), _prices(spark)).withColumn("charged", F.round("charged", 4)).withColumn("list_cost", F.round("list_cost", 9))


@query(f"""WITH {USAGE}, g AS (SELECT stage || key AS prefix, count(*) AS calls, arg_min(cached, ord) > 0 AS first_hit, count(*) FILTER (cached > 0) AS hits, sum(cached)::BIGINT AS cached, sum(input)::BIGINT AS input FROM usage GROUP BY 1)
  SELECT prefix, calls, first_hit, hits - CAST(first_hit AS BIGINT) AS later_hits, cached, input FROM g WHERE calls > 1""")
def cache_usage(spark, d):
    return jb.cache_usage(shims.usage(spark, d).withColumn("prefix", F.concat("stage", F.col("key").cast("string"))))


@query("SELECT source, count(*) AS n, quantile_disc(t, 0.5) AS p50, quantile_disc(t, 0.9) AS p90, max(t) AS most, count(*) FILTER (t >= 500) AS refused FROM (SELECT source, CAST(ceil(length(text) / 4.0) AS BIGINT) AS t FROM documents) GROUP BY source")
def prompt_percentiles(spark, d):
    from ..functions.numbers import tokens_of

    return jb.prompt_sizes(table(spark, d, "documents").select("source", tokens_of(F.col("text")).alias("tokens")), 500, ["source"])


@query(f"WITH {USAGE}, s AS (SELECT event_id, charged, coalesce(sum(charged) OVER (PARTITION BY key ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM usage) SELECT event_id, round(spent, 6) AS spent, spent + charged <= 100 AS fits FROM s")
def running_budget(spark, d):
    u = shims.usage(spark, d).withColumn("cost", F.col("charged"))
    return jb.running_spend(u, ["key"], 100.0).select("event_id", F.round("spent", 6).alias("spent"), "fits")


@query(f"WITH {USAGE} SELECT event_id, round(avg(charged) OVER w + 1e-9::DOUBLE, 6) AS mean_cost, round(avg(charged) OVER w * 500 + 1e-7::DOUBLE, 4) AS projected FROM usage WINDOW w AS (PARTITION BY stage ORDER BY ord ROWS UNBOUNDED PRECEDING)")
def rolling_projection(spark, d):
    r = jb.rolling_projection(shims.usage(spark, d).withColumn("cost", F.col("charged")), ["stage"], 500)
    return r.select("event_id", F.round(F.col("mean_cost") + 1e-9, 6).alias("mean_cost"), F.round(F.col("projected") + 1e-7, 4).alias("projected"))


@query(f"WITH {USAGE}, r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ord) AS r FROM usage) SELECT stage, count(*) FILTER (NOT charged < 30) AS failures, count(*) FILTER (NOT charged < 30) <= 2 AS goes_on FROM r WHERE r <= 20 GROUP BY stage")
def early_failures(spark, d):
    return jb.early_failures(shims.usage(spark, d).withColumn("ok", F.col("charged") < 30), ["stage"])


@query(f"""WITH {USAGE}, s AS (SELECT stage AS host, sum(CASE WHEN ord % 3 = 0 THEN charged ELSE 1.0 END) AS spent FROM usage GROUP BY 1), c AS (SELECT DISTINCT stage AS host, 1500.0::DOUBLE AS cap FROM usage)
  SELECT host, cap, round(coalesce(spent, 0), 6) AS spent, round(greatest(0, cap - coalesce(spent, 0) - 10), 6) AS available FROM c LEFT JOIN s USING (host)""")
def budget_summary(spark, d):
    u = shims.usage(spark, d).select(F.col("stage").alias("host"), F.when(F.col("ord") % 3 == 0, F.col("charged")).alias("settled"), F.lit(1.0).alias("reserved"))
    out = jb.budget_summary(u, u.select("host").distinct().withColumn("cap", F.lit(1500.0)), 10.0)
    return out.select("host", "cap", F.round("spent", 6).alias("spent"), F.round("available", 6).alias("available"))


@query(f"""WITH {USAGE} SELECT stage, count(*) AS total, count(*) FILTER (ord % 5 < 3) AS success, count(*) FILTER (ord % 5 = 3) AS failed, count(*) FILTER (ord % 5 = 4) AS stopped, count(*) FILTER (ord % 5 < 4) AS accounted, true AS adds_up FROM usage GROUP BY stage""")
def stage_accounting(spark, d):
    m = F.col("ord") % 5
    return jb.stage_accounting(shims.usage(spark, d).select("stage", F.when(m < 3, "success").when(m == 3, "failed").otherwise("stopped").alias("status")))


@query(f"""WITH {USAGE}, l AS (SELECT model AS config, key AS item, CAST(arg_max(cached % 4, ord) AS BIGINT) AS reached FROM usage GROUP BY ALL)
  SELECT config, count(*) AS items, count(*) FILTER (reached >= 1) AS json, count(*) FILTER (reached >= 2) AS schema_ok, count(*) FILTER (reached >= 3) AS spans FROM l GROUP BY config""")
def retry_totals(spark, d):
    u = shims.usage(spark, d).select(F.col("model").alias("config"), F.col("key").alias("item"), F.col("ord").alias("attempt"), (F.col("cached") % 4).alias("reached"))
    return jb.retry_totals(u, ["json", "schema_ok", "spans"])


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN true WHEN c_mktsegment = 'MACHINERY' THEN CASE WHEN c_custkey % 2 = 0 THEN c_nationkey < 10 ELSE c_acctbal > 0 AND c_custkey % 7 <> 0 END
  WHEN c_mktsegment = 'FURNITURE' THEN c_custkey % 2 <> 0 AND c_custkey % 3 = 0 ELSE false END AS allowed FROM customer""")
def access_rule(spark, d):
    c = table(spark, d, "customer")
    role = F.when(F.col("c_mktsegment") == "BUILDING", "admin").when(F.col("c_mktsegment") == "MACHINERY", "judge").when(F.col("c_mktsegment") == "FURNITURE", "company")
    k = F.col("c_custkey")
    grants = F.when(k % 3 == 0, F.array(k)).otherwise(F.array(F.lit(-1).cast("long")))
    view = F.when(k % 2 == 0, "deidentified").otherwise("identifiable")
    return c.select("c_custkey", jb.decide_access(role, grants, k, F.when(F.col("c_acctbal") > 0, "signed"), k % 7 == 0, F.col("c_nationkey") < 10, view).alias("allowed"))


@query("""SELECT CAST(user_id AS VARCHAR) AS key, round(count(*) / (epoch_us(max(ts)) - epoch_us(min(ts))) * 1000000::DOUBLE, 9) AS rate FROM events GROUP BY 1 HAVING count(*) > 1 AND max(ts) > min(ts)""")
def finish_time(spark, d):
    g = table(spark, d, "events").groupBy(F.col("user_id").cast("string").alias("key")).agg(F.count("*").alias("done"), F.min("ts").cast("timestamp").alias("started"), F.max("ts").cast("timestamp").alias("now"))
    return jb.finish_time(g.where("done > 1 AND now > started").withColumn("total", F.col("done") * 2)).select("key", F.round("rate", 9).alias("rate"))


@query("SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY 1")
def log_records(spark, d):
    lines = table(spark, d, "events").select(F.concat("event_type", F.lit(" "), F.when(F.col("event_type") == "view", "{broken").otherwise(F.col("props"))).alias("value"))
    return jb.log_records(lines, "click", "k long").groupBy("k").agg(F.count("*").alias("n"))


@query("""WITH j AS (SELECT user_id AS item, CAST(event_id % 2 AS VARCHAR) AS digest, ts, event_id AS ord, CASE WHEN value < 25 THEN 'approve' ELSE 'reject' END AS verdict FROM events)
  SELECT item, digest, 'last' AS rule FROM (SELECT item, digest, arg_max(verdict, (ts, ord)) AS v FROM j GROUP BY ALL) WHERE v = 'approve' UNION ALL SELECT item, digest, 'never' FROM (SELECT item, digest, bool_or(verdict = 'reject') AS r FROM j GROUP BY ALL) WHERE NOT r""")
def approvals(spark, d):
    j = table(spark, d, "events").select(F.col("user_id").alias("item"), (F.col("event_id") % 2).cast("string").alias("digest"), F.col("ts").alias("at"), F.col("event_id").alias("ord"), F.when(F.col("value") < 25, "approve").otherwise("reject").alias("verdict"))
    return jb.approved(j).withColumn("rule", F.lit("last")).unionByName(jb.approved(j, True).withColumn("rule", F.lit("never")))


@query("""WITH p AS (SELECT DISTINCT user_id AS project, event_id % 3 AS page_ix FROM events), c AS (SELECT DISTINCT user_id AS project, event_id % 3 AS page_ix, event_id % 11 AS span_ix FROM events WHERE value > 10),
  a AS (SELECT project, page_ix, 0 AS k, 0 AS s, 'page' AS kind, 'u' || page_ix AS ref FROM p UNION ALL SELECT project, page_ix, 1, span_ix, 'span', 's' || span_ix FROM c UNION ALL SELECT DISTINCT project, 2147483647, 2, 0, 'report', '' FROM p)
  SELECT project, row_number() OVER (PARTITION BY project ORDER BY page_ix, k, s) AS step, kind, ref FROM a""")
def replay_steps(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("project"), (F.col("event_id") % 3).cast("int").alias("page_ix"), (F.col("event_id") % 11).cast("int").alias("span_ix"), "value")
    pages = e.select("project", "page_ix").distinct().withColumn("url", F.concat(F.lit("u"), F.col("page_ix").cast("string")))
    return jb.replay_steps(pages, e.where("value > 10").withColumn("span_id", F.concat(F.lit("s"), F.col("span_ix").cast("string"))))


@query("SELECT stage, setting, reason, count(*) AS n FROM (SELECT event_type AS stage, unnest(['on', 'off']) AS setting, CASE WHEN value > 30 THEN 'slow' ELSE 'ok' END AS reason FROM events) GROUP BY ALL")
def paired_settings(spark, d):
    e = table(spark, d, "events").select(F.col("event_type").alias("stage"), F.explode(F.array(F.lit("on"), F.lit("off"))).alias("setting"), F.when(F.col("value") > 30, "slow").otherwise("ok").alias("reason"))
    return e.groupBy("stage", "setting", "reason").agg(F.count("*").alias("n"))


_CALLS = """calls AS (SELECT event_type AS stage, event_id AS ord, k * 10 + event_id % 7 AS estimated, CASE WHEN event_type <> 'error' OR event_id % 400 <> 0 THEN k * (9 + event_id % 4) END AS input, k AS output FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)),
  planned AS (SELECT stage, count(*) AS items, CAST(sum(estimated) AS BIGINT) AS estimated, CAST(sum(estimated) AS BIGINT) * CASE WHEN stage IN ('view', 'click', 'error') THEN 0.0000014::DOUBLE ELSE 0.00000125::DOUBLE END AS cap FROM calls GROUP BY stage)"""


@query(f"""WITH {_CALLS}, s AS (SELECT stage, ord, count(*) OVER w AS n, sum(estimated) OVER w AS e, coalesce(sum(input) OVER w, 0) AS i, coalesce(sum(output) OVER w, 0) AS o, count(*) FILTER (input IS NULL) OVER w AS miss FROM calls WINDOW w AS (PARTITION BY stage ORDER BY ord)),
  p AS (SELECT stage, ord, n, i * 0.000001::DOUBLE + o * 0.000002::DOUBLE AS spent, miss = 0 AND e > 0 AS ok, i::DOUBLE / e AS ratio, o::DOUBLE / n AS mean, ceil((estimated - e) * (i::DOUBLE / e)) AS li, ceil(o::DOUBLE / n * (items - n)) AS lo, cap FROM s JOIN planned USING (stage)),
  j AS (SELECT *, ok AND spent + li * 0.000001::DOUBLE + lo * 0.000002::DOUBLE <= cap AS within FROM p), stop AS (SELECT stage, min(ord) AS at_ FROM j WHERE NOT within GROUP BY 1)
  SELECT stage, ord, n AS completed, CASE WHEN ok THEN round(ratio, 9) END AS ratio, CASE WHEN ok THEN CAST(li AS BIGINT) END AS left_input, CASE WHEN ok THEN CAST(lo AS BIGINT) END AS left_output, CASE WHEN ok THEN round(spent + li * 0.000001::DOUBLE + lo * 0.000002::DOUBLE, 9) END AS projected, within AS within_cap,
    CASE WHEN NOT ok THEN 'usage-unavailable' WHEN NOT within THEN 'projected-budget-exceeded' WHEN n % 20 = 0 THEN 'completed' END AS reason FROM j LEFT JOIN stop USING (stage) WHERE at_ IS NULL OR ord <= at_""")
def calibrated_projection(spark, d):
    e = table(spark, d, "events")
    k, i = F.from_json("props", "k int")["k"].cast("long"), F.col("event_id")
    calls = e.select(F.col("event_type").alias("stage"), i.alias("ord"), (k * 10 + i % 7).alias("estimated"), F.when((F.col("event_type") != "error") | (i % 400 != 0), k * (9 + i % 4)).alias("input"), k.alias("output"))
    planned = calls.groupBy("stage").agg(F.count("*").alias("items"), F.sum("estimated").alias("estimated"))
    planned = planned.withColumn("cap", F.col("estimated") * F.when(F.col("stage").isin("view", "click", "error"), 0.0000014).otherwise(0.00000125))
    r = jb.calibrated_projection(calls, planned, ["stage"], 0.000001, 0.000002)
    return r.select("stage", "ord", "completed", F.round("ratio", 9).alias("ratio"), "left_input", "left_output", F.round("projected", 9).alias("projected"), "within_cap", "reason")


def budget_events(spark, d):
    """Events as reservations of runs of 300 events, their settlements and expiries; caps by kind of call."""
    e, i = table(spark, d, "events"), F.col("event_id")
    kind = F.when(i % 3 == 0, "reserve").when((i % 3 == 1) & (i % 4 != 0), "settle").when((i % 3 == 2) & (i % 5 != 0), "expire").otherwise("reserve")
    key = F.when(kind == "reserve", i).otherwise(i - i % 3)
    return e.select(F.floor(i / 300).cast("long").alias("parent"), F.col("event_type").alias("child"), i.alias("ord"), kind.alias("kind"), key.cast("string").alias("id"), F.col("value").cast("double").alias("usd"), F.lit(250.0).alias("child_cap"), F.lit(900.0).alias("parent_cap"))


@query()
def reservations(spark, d):
    """Reservations and settlements under caps of calls and runs."""
    from ..operators import budgets

    return budgets.reservations(budget_events(spark, d))


_LINES = "lines AS (SELECT c_nationkey AS part, c_custkey AS k, CAST(c_custkey AS VARCHAR) || ' ' || c_name || ' ' || c_mktsegment AS line FROM customer)"


def _written(spark, df):
    """A folder of one text file for each part, lines in order of their keys."""
    import uuid

    from ..sources.tables import shared_folder

    path = f"{shared_folder(spark).rstrip('/')}/packs/{uuid.uuid4().hex}"
    df.repartition("part").sortWithinPartitions("part", "k").select("part", "line").write.partitionBy("part").text(path)
    return path


def _customer_lines(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_nationkey").cast("int").alias("part"), F.col("c_custkey").alias("k"), F.concat_ws(" ", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment").alias("line"))


def _by_folder(df):
    return df.withColumn("file", F.substring_index("file", "/", 1))


@query(f"WITH {_LINES}, f AS (SELECT part, string_agg(line || chr(10), '' ORDER BY k) AS t FROM lines GROUP BY part) SELECT 'part=' || part AS file, octet_length(encode(t)) AS bytes, sha256(t) AS sha256 FROM f")
def pack_digests(spark, d):
    """Digests of written files."""
    from ..sources import packs

    return _by_folder(packs.file_digests(spark, _written(spark, _customer_lines(spark, d))))


@query("SELECT 'part=' || part AS file, CASE WHEN part = 3 THEN 'missing' WHEN part = 99 THEN 'extra' ELSE 'changed' END AS problem FROM (SELECT DISTINCT c_nationkey AS part FROM customer WHERE c_nationkey % 5 = 0 OR c_nationkey = 3 UNION SELECT 99)")
def pack_refusals(spark, d):
    """Files of a later pack that are not those of the first one's manifest."""
    from ..sources import packs

    lines = _customer_lines(spark, d)
    later = lines.where("part <> 3").withColumn("line", F.when(F.col("part") % 5 == 0, F.upper("line")).otherwise(F.col("line")))
    later = later.unionByName(lines.withColumn("part", F.lit(99)))
    listed, found = (packs.file_digests(spark, _written(spark, x)) for x in (lines, later))
    return packs.refusals(_by_folder(listed), _by_folder(found))
