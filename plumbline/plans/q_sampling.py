"""Queries over sampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import sampling as sm
from ..registry import query, table
from . import shims
from .shims import POSTS, QUARTER_STARTS

SEED = "ae0b3a26c3b17672"
WALK_TARGET = 25


def _posts(spark, d):
    return sm.with_stratum(shims.posts(spark, d), QUARTER_STARTS)


@query("SELECT i AS window_no, 788918400 + i * 604800 AS start, least(788918400 + (i + 1) * 604800, 996624000) AS end_exclusive FROM range(344) t(i)")
def frame_windows(spark, d):
    return sm.frame_windows(spark, 788918400, 996624000)


@query(f"""WITH {POSTS} SELECT CAST(floor((epoch(created_at) - 788918400) / 604800) AS BIGINT) AS window_no, count(*) AS n FROM posts
  WHERE created_at >= TIMESTAMP '1995-01-01' AND created_at < TIMESTAMP '2001-08-01' GROUP BY 1""")
def frame_weekly_counts(spark, d):
    return sm.window_counts(shims.posts(spark, d), "1995-01-01", "2001-08-01")


@query("SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def frame_dedupe_last(spark, d):
    return sm.dedupe_last(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query(f"WITH {POSTS} SELECT quarter, source, count(*) AS n FROM posts GROUP BY ALL")
def stratify_quarter(spark, d):
    return _posts(spark, d).groupBy(F.col("quarter").cast("long").alias("quarter"), "source").agg(F.count("*").alias("n"))


@query(f"SELECT conv_id, turn FROM conversations WHERE regexp_matches(text, '{tx.TITLE_KEYWORDS}')")
def title_keyword_filter(spark, d):
    return table(spark, d, "conversations").where(F.col("text").rlike(tx.ascii_edges(tx.TITLE_KEYWORDS))).select("conv_id", "turn")


@query(f"""WITH {POSTS} SELECT id, quarter, draw_rank FROM (SELECT id, quarter, row_number() OVER (PARTITION BY quarter ORDER BY sha256('{SEED}:' || id)) AS draw_rank FROM posts) WHERE draw_rank <= 75""")
def seeded_draw_by_quarter(spark, d):
    return sm.seeded_top(_posts(spark, d), SEED, "id", 75, "quarter").select("id", F.col("quarter").cast("long").alias("quarter"), F.col("draw_rank").cast("long").alias("draw_rank"))


@query(f"WITH {POSTS} SELECT id, row_number() OVER (ORDER BY sha256('{SEED}:' || id)) AS draw_rank FROM posts QUALIFY draw_rank <= 50")
def seeded_draw_top(spark, d):
    return sm.seeded_top(_posts(spark, d), SEED, "id", 50).select("id", F.col("draw_rank").cast("long").alias("draw_rank"))


def _walk_sql() -> str:
    ctes = [f"{POSTS}, rows0 AS (SELECT *, sha256('{SEED}:' || id) AS dk, coalesce('k' || key, 'i' || id) AS gk, pass1 AND reachable AND boundary_ok AND (text_len < 500 OR pass2) AS wp FROM posts)"]
    for q in range(1, 5):
        prior = " UNION ALL ".join(f"SELECT gk FROM chosen{i}" for i in range(1, q)) or "SELECT '' AS gk WHERE false"
        ctes.append(f"prior{q} AS ({prior})")
        ctes.append(f"chosen{q} AS (SELECT gk, min(dk) AS fk FROM rows0 WHERE quarter = {q} AND wp AND gk NOT IN (SELECT gk FROM prior{q}) GROUP BY gk ORDER BY fk LIMIT {WALK_TARGET})")
        ctes.append(f"""walked{q} AS (SELECT r.*, coalesce(r.key IS NOT NULL AND (r.gk IN (SELECT gk FROM prior{q}) OR c.fk < r.dk), false) AS dup FROM rows0 r LEFT JOIN chosen{q} c USING (gk)
          WHERE quarter = {q} AND dk <= (SELECT CASE WHEN count(*) >= {WALK_TARGET} THEN max(fk) ELSE '~' END FROM chosen{q}))""")
    every = " UNION ALL ".join(f"SELECT * FROM walked{q}" for q in range(1, 5))
    ctes.append(f"""outcomes AS (SELECT id, quarter, dk, text_len, CASE WHEN dup THEN 'duplicate' WHEN NOT pass1 THEN 'excluded-stage1' WHEN NOT reachable THEN 'not-collectable-unreachable'
      WHEN NOT boundary_ok THEN 'not-collectable-boundary' WHEN text_len >= 500 AND NOT pass2 THEN 'excluded-stage2' ELSE 'included' END AS outcome FROM ({every}))""")
    return "WITH " + ", ".join(ctes) + " "


def _walk(spark, d):
    return sm.screened_walk(_posts(spark, d), SEED, WALK_TARGET)


@query(_walk_sql() + """SELECT id, quarter, outcome, CASE WHEN outcome = 'included' THEN CASE WHEN text_len < 500 THEN 'insufficient-text' ELSE 'screened' END END AS stage2,
  CASE WHEN outcome = 'included' THEN count(*) FILTER (outcome = 'included') OVER (ORDER BY quarter, dk) END AS n FROM outcomes""")
def seeded_walk_outcomes(spark, d):
    return _walk(spark, d).select("id", F.col("quarter").cast("long").alias("quarter"), "outcome", "stage2", "n")


@query(_walk_sql() + "SELECT outcome, count(*) AS n FROM outcomes GROUP BY ALL UNION ALL SELECT 'screened', count(*) FROM outcomes")
def prisma_counts(spark, d):
    return sm.prisma_counts(_walk(spark, d))


@query(_walk_sql() + "SELECT quarter, outcome, count(*) AS n FROM outcomes GROUP BY ALL UNION ALL SELECT quarter, 'screened', count(*) FROM outcomes GROUP BY ALL")
def prisma_by_stratum(spark, d):
    return sm.prisma_counts(_walk(spark, d), ["quarter"]).select(F.col("quarter").cast("long").alias("quarter"), "outcome", "n")


@query(_walk_sql() + "SELECT quarter, count(*) AS n FROM posts WHERE id NOT IN (SELECT id FROM outcomes) GROUP BY ALL")
def extend_draw(spark, d):
    left = sm.extend_walk(_posts(spark, d), _walk(spark, d))
    return left.groupBy(F.col("quarter").cast("long").alias("quarter")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('s1:' || c_custkey)) AS draw_rank FROM customer QUALIFY draw_rank <= 40),
  s AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('s2:' || c_custkey)) AS draw_rank FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM g) QUALIFY draw_rank <= 30)
  SELECT c_custkey, 'gold' AS subset, draw_rank FROM g UNION ALL SELECT c_custkey, 'second', draw_rank FROM s""")
def seeded_subsets(spark, d):
    return sm.seeded_subsets(table(spark, d, "customer"), "c_custkey", {"gold": 40, "second": 30}, {"gold": "s1", "second": "s2"})


@query("""WITH c AS (SELECT event_type AS family, 'r' || CAST(user_id % 23 AS VARCHAR) AS reason, count(*) AS n FROM events GROUP BY ALL), b AS (SELECT *, n < 40 OR reason = 'other' AS small FROM c),
  o AS (SELECT family, sum(n) AS o FROM b WHERE small GROUP BY family), t AS (SELECT family, arg_min(reason, (n, reason)) AS target FROM b WHERE NOT small GROUP BY family),
  m AS (SELECT *, o < 40 AND target IS NOT NULL AS moves FROM o LEFT JOIN t USING (family))
  SELECT b.family, b.reason, CAST(b.n + CASE WHEN m.moves AND b.reason = m.target THEN m.o ELSE 0 END AS BIGINT) AS n FROM b LEFT JOIN m USING (family) WHERE NOT b.small
  UNION ALL SELECT family, 'other', CAST(o AS BIGINT) FROM m WHERE NOT moves""")
def merge_small_reasons(spark, d):
    counts = table(spark, d, "events").groupBy(F.col("event_type").alias("family"), F.concat(F.lit("r"), (F.col("user_id") % 23).cast("string")).alias("reason")).agg(F.count("*").alias("n"))
    return sm.merge_small(counts, 40)


@query(f"""WITH {POSTS}, top AS (SELECT * FROM posts ORDER BY points DESC, id LIMIT 250) SELECT source, arg_max(id, (points, -CAST(id AS BIGINT))) AS id FROM top WHERE usable GROUP BY source""")
def first_usable_by_class(spark, d):
    return sm.first_usable(shims.posts(spark, d), "source", "points")


@query(f"""WITH {POSTS}, a AS (SELECT id FROM posts WHERE quarter = 1), b AS (SELECT id FROM posts WHERE quarter = 2) SELECT (SELECT count(*) FROM a WHERE id IN (SELECT id FROM b)) AS shared, (SELECT count(*) FROM a) AS a, (SELECT count(*) FROM b) AS b""")
def disjoint_subsets(spark, d):
    p = _posts(spark, d).select("id", "quarter").where("quarter IN (1, 2)")
    per_id = p.groupBy("id").agg(F.count_if(F.col("quarter") == 1).alias("x"), F.count_if(F.col("quarter") == 2).alias("y"))
    return per_id.agg(F.count_if((F.col("x") > 0) & (F.col("y") > 0)).alias("shared"), F.sum("x").alias("a"), F.sum("y").alias("b"))
