"""Queries over text evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import COMMON_WORDS
from ..functions import text as tx
from ..operators import evidence as ev
from ..registry import query, table

# The page text as SQL: RE2 has no back-references, so hidden elements are named one by one.
_T = "html"
for _tag in tx.HIDDEN_TAGS:
    _T = f"regexp_replace({_T}, '(?is)<{_tag}\\b.*?</{_tag}>', ' ', 'g')"
_T = f"regexp_replace(regexp_replace(regexp_replace({_T}, '(?i)<br\\s*/?>', chr(10), 'g'), '(?i)</(?:{tx.BLOCK_TAGS})\\s*>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
for _a, _b in tx.ENTITIES:
    _T = "replace({}, '{}', '{}')".format(_T, _a, _b.replace("'", "''"))
_T = f"regexp_replace(regexp_replace(regexp_replace({_T}, '[ \\t\\r\\f\\v]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
PAGE_TEXT = f"regexp_replace({_T}, '^\\s+|\\s+$', '', 'g')"
TEXTS = f"texts AS (SELECT page_id AS project, {PAGE_TEXT} AS text FROM pages)"


def _pages(spark, d):
    return table(spark, d, "pages").select(F.col("page_id").alias("project"), "url", tx.page_text(F.col("html")).alias("text"))


@query(f"WITH {TEXTS} SELECT * FROM texts")
def page_text(spark, d):
    return _pages(spark, d).select("project", "text")


@query(f"SELECT page_id, regexp_replace({PAGE_TEXT}, '\\s+', ' ', 'g') AS text FROM pages")
def flat_page_text(spark, d):
    return table(spark, d, "pages").select("page_id", tx.flat_text(F.col("html")).alias("text"))


@query("""SELECT page_id, list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']([^"'']+)["'']', 1), lambda x: NOT regexp_matches(x, '(?i)^(#|mailto:|javascript:)')), lambda x: regexp_replace(x, '#.*$', '')))) AS links FROM pages""")
def page_links(spark, d):
    return table(spark, d, "pages").select("page_id", F.sort_array(tx.links(F.col("html"))).alias("links"))


_HREFS = "list_distinct(list_transform(list_filter(regexp_extract_all(html, '(?i)href\\s*=\\s*[\"'']([^\"'']+)[\"'']', 1), lambda x: NOT regexp_matches(x, '(?i)^(#|mailto:|javascript:)')), lambda x: regexp_replace(x, '#.*$', '')))"


@query(f"""WITH p AS (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS origin, regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://[^/]+', ''), '[^/]*$', '') AS folder, html FROM pages),
  h AS (SELECT * EXCLUDE (html), unnest(list_distinct(list_concat({_HREFS}, ['//cdn.example.net/x', 'ftp://old/', 'next.html', 'HTTPS://Up.example/y']))) AS href FROM p)
  SELECT page_id, href, CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^(https?:)', 1) || href WHEN regexp_matches(href, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN NULL
    WHEN starts_with(href, '/') THEN origin || href ELSE origin || CASE WHEN folder = '' THEN '/' ELSE folder END || href END AS target FROM h""")
def resolved_links(spark, d):
    more = F.array(*(F.lit(x) for x in ("//cdn.example.net/x", "ftp://old/", "next.html", "HTTPS://Up.example/y")))
    p = table(spark, d, "pages").select("page_id", "url", F.explode(F.array_union(tx.links(F.col("html")), more)).alias("href"))
    return p.select("page_id", "href", tx.resolve(F.col("url"), F.col("href")).alias("target"))


@query("SELECT page_id, ['http://a/' || CAST(page_id AS VARCHAR), 'http://b/?x=1&y=2'] AS locs FROM pages")
def sitemap_locations(spark, d):
    xml = F.concat(F.lit("<urlset><url><loc> http://a/"), F.col("page_id").cast("string"), F.lit("</loc></url><url><loc>http://b/?x=1&amp;y=2</loc></url></urlset>"))
    return table(spark, d, "pages").select("page_id", tx.sitemap_locations(xml).alias("locs"))


_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1))"
_PATH = "CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+(/[^?#]*)', 1) END"
PARTS = f"parts AS (SELECT page_id, url, {_HOST} AS host, {_PATH} AS path FROM pages)"


#: Addresses of all kinds, by page number, with what a project owns there: url, host, path_prefix, exact.
_KINDS = [
    ("url", "regexp_extract(url, '//(?:[^./]+\\.)*([^./]+\\.[^./]+)/', 1)", None, False),
    ("'https://user' || page_id || '.github.io/x'", "'user' || page_id || '.github.io'", None, True),
    ("'https://a.b.onrender.com/'", "'a.b.onrender.com'", None, True),
    ("'https://www.GitHub.com/Acme/Tool' || page_id || '/tree/main'", "'github.com'", "'/acme/tool' || page_id", False),
    ("'https://github.com/acme'", "'github.com'", None, False),
    ("'https://huggingface.co/spaces/Me/App' || page_id", "'huggingface.co'", "'/spaces/me/app' || page_id", False),
    ("'https://huggingface.co/datasets/me'", "'huggingface.co'", None, False),
    ("'https://gitlab.com/me/tool'", "'gitlab.com'", None, False),
    ("'https://blog.shop' || page_id || '.co.uk/a'", "'shop' || page_id || '.co.uk'", None, False),
    ("'http://192.168.0.' || page_id || '/a'", "'192.168.0.' || page_id", None, False),
]


def _by_kind(at: int) -> str:
    """SQL that picks a column of _KINDS by page number; concatenation of numbers works alike in both engines."""
    return "CASE " + " ".join(f"WHEN page_id % {len(_KINDS)} = {i} THEN {'NULL' if k[at] is None else k[at]}" for i, k in enumerate(_KINDS)) + " END"


@query(f"SELECT page_id, {_by_kind(1)} AS host, {_by_kind(2)} AS path_prefix, {_by_kind(3)} AS exact FROM pages")
def url_boundary(spark, d):
    return table(spark, d, "pages").select("page_id", tx.boundary(F.expr(_by_kind(0))).alias("b")).select("page_id", "b.host", "b.path_prefix", "b.exact")


@query(f"WITH {PARTS} SELECT page_id, host = 'example.com' OR host LIKE '%.example.com' AS inside, host = 'example.org' AND (path = '/en' OR path LIKE '/en/%') AS under FROM parts")
def within_boundary(spark, d):
    b = lambda h, p: F.struct(F.lit(h).alias("host"), F.lit(p).cast("string").alias("path_prefix"), F.lit(False).alias("exact"))
    return table(spark, d, "pages").select("page_id", tx.within(F.col("url"), b("example.com", None)).alias("inside"), tx.within(F.col("url"), b("example.org", "/en")).alias("under"))


@query(f"WITH {PARTS} SELECT page_id, NOT regexp_matches(path, '{tx.ASSET}') AND NOT regexp_matches(path, '{tx.ASSET_PATH}') AS page_like, regexp_matches(url, '^https://[^/?#@:]+(:443)?([/?#]|$)') AS https FROM parts")
def page_like(spark, d):
    return table(spark, d, "pages").select("page_id", tx.page_like(F.col("url")).alias("page_like"), tx.https_only(F.col("url")).alias("https"))


@query(f"""WITH {PARTS}, p AS (SELECT page_id, regexp_replace(host, '^www\\.', '') AS h, lower(regexp_replace(path, '/+$', '')) AS p FROM parts)
  SELECT page_id, CASE WHEN regexp_matches(h, '{tx.CODE_HOSTS}') THEN 'repository' WHEN regexp_matches(p, '{tx.POLICY_PATH}') THEN 'policy-page' WHEN regexp_matches(h, '^docs?\\.') OR regexp_matches(p, '{tx.DOCS_PATH}') THEN 'docs'
  WHEN p = '' OR regexp_matches(p, '^/(index\\.html?)?$') THEN 'homepage' ELSE 'other' END AS source_type FROM p""")
def source_type(spark, d):
    return table(spark, d, "pages").select("page_id", tx.source_type(F.col("url")).alias("source_type"))


@query("SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(trim(url)), '^[a-z][a-z0-9+.-]*://', ''), '^www\\.', ''), '/+$', '') AS key FROM pages")
def url_key(spark, d):
    return table(spark, d, "pages").select("page_id", tx.url_key(F.col("url")).alias("key"))


@query(f"WITH {PARTS} SELECT page_id, CASE " + " ".join(f"WHEN regexp_matches(path, '{p}') THEN {i}" for i, p in enumerate(tx.PRIORITY_PATHS)) + f" ELSE {len(tx.PRIORITY_PATHS)} END AS rank FROM parts")
def priority_urls(spark, d):
    return table(spark, d, "pages").select("page_id", tx.priority_rank(F.col("url")).alias("rank"))


@query("SELECT p_partkey, trim(regexp_extract('Tool ' || p_name || ' - ' || p_type, '^(.*?)(?: – | - |:|$)', 1)) AS product FROM part")
def product_name(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.product_name(F.concat(F.lit("Show HN: Tool "), "p_name", F.lit(" - "), "p_type")).alias("product"))


@query("SELECT p_partkey, list_filter([lower('show hn: ' || p_name || ': ' || p_type), lower(p_name || ': ' || p_type), lower(p_name)], lambda t: length(t) >= 6) AS forms FROM part")
def title_forms(spark, d):
    return table(spark, d, "part").select("p_partkey", tx.title_forms(F.concat(F.lit("Show HN: "), "p_name", F.lit(": "), "p_type")).alias("forms"))


@query(f"SELECT doc_id, regexp_replace(text, '{tx.EMAIL}', '[email redacted]', 'g') AS text, CAST(len(regexp_extract_all(text, '{tx.EMAIL}')) AS BIGINT) AS emails FROM documents")
def redact_email_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.redact_emails(F.col("text")).alias("text"), tx.email_count(F.col("text")).alias("emails"))


@query()
def redact_personal_data(spark, d):
    """Emails, phones and handles, code left alone: its rules need code."""
    return table(spark, d, "documents").select("doc_id", tx.redact_udf()(F.col("text")).alias("r")).select("doc_id", "r.*")


SPANS = """l AS (SELECT doc_id AS project, i - 1 AS i, x FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda t: trim(regexp_replace(t, '[ \\t\\r]+', ' ', 'g'))), lambda t: length(t) >= 2) AS xs FROM documents), LATERAL (SELECT unnest(xs) AS x, generate_subscripts(xs, 1) AS i)),
  kept AS (SELECT project, i, x, lag(x) OVER (PARTITION BY project ORDER BY i) AS before FROM l),
  spans AS (SELECT project, 0 AS page_ix, row_number() OVER (PARTITION BY project ORDER BY i) - 1 AS span_ix, x AS text FROM kept WHERE before IS NULL OR before <> x)"""


def _lines(spark, d):
    return ev.line_spans(table(spark, d, "documents").select(F.col("doc_id").alias("project"), F.lit(0).alias("page_ix"), "text"))


@query(f"WITH {SPANS} SELECT project, span_ix, text FROM spans")
def segment_lines(spark, d):
    return _lines(spark, d).select("project", F.col("span_ix").cast("long").alias("span_ix"), "text")


@query(f"WITH {SPANS} SELECT project, text, min(span_ix) AS span_ix FROM spans GROUP BY ALL")
def first_occurrence(spark, d):
    return ev.first_occurrences(_lines(spark, d)).select("project", "text", F.col("span_ix").cast("long").alias("span_ix"))


@query(f"""WITH {SPANS}, t AS (SELECT project % 50 AS g, project AS page, text, count(*) AS n FROM spans GROUP BY ALL), u AS (SELECT g, text, sum(n)::BIGINT AS n, count(*) AS pages FROM t GROUP BY ALL)
  SELECT g AS project, sum(n)::BIGINT AS spans, sum(n - pages)::BIGINT AS within_page, sum(pages - 1)::BIGINT AS across_pages, sum(n * length(text))::BIGINT AS chars, sum((n - 1) * length(text))::BIGINT AS duplicate_chars FROM u GROUP BY g""")
def duplicate_span_stats(spark, d):
    return ev.duplicate_stats(_lines(spark, d).select((F.col("project") % 50).alias("project"), F.col("project").alias("page_ix"), "span_ix", "text"))


@query("""WITH m AS (SELECT c_nationkey AS project, list(sha256(p_name) ORDER BY p_partkey) AS hashes FROM customer JOIN part ON p_partkey = c_custkey GROUP BY 1) SELECT project, CAST(i - 1 AS BIGINT) AS page_ix, p_name AS text
  FROM (SELECT project, unnest(hashes) AS h, generate_subscripts(hashes, 1) AS i FROM m) JOIN (SELECT DISTINCT p_name FROM part) ON sha256(p_name) = h""")
def manifest_spans(spark, d):
    p, c = table(spark, d, "part"), table(spark, d, "customer")
    hashed = c.join(p, F.col("p_partkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("project")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", F.sha2("p_name", 256).alias("h")))), lambda x: x["h"]).alias("hashes"))
    snapshots = p.select(F.sha2("p_name", 256).alias("hash"), F.col("p_name").alias("text")).dropDuplicates(["hash"])
    return ev.manifest_spans(hashed, snapshots).select("project", F.col("page_ix").cast("long").alias("page_ix"), "text")


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^\\pL\\pN\\s]+', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM documents")
def normalise_text(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.normalise(F.col("text")).alias("text"))


@query("SELECT conv_id, turn, trim(regexp_replace(lower(text), '[ \\t\\n\\r]+', ' ', 'g')) AS quote FROM conversations WHERE length(text) >= 20")
def normalise_quotes(spark, d):
    return table(spark, d, "conversations").where("length(text) >= 20").select("conv_id", "turn", tx.normalise_quote(F.col("text")).alias("quote"))


@query("SELECT doc_id, " + " OR ".join(f"regexp_matches(text, '{p}')" for p in [*tx.INJECTION[:3], "(?i)thin"]) + " AS flagged FROM documents")
def injection_flags(spark, d):
    return table(spark, d, "documents").select("doc_id", (tx.injected(F.col("text")) | F.col("text").rlike("(?i)thin")).alias("flagged"))


@query(f"SELECT conv_id, turn, length(trim(text)) < 12 OR regexp_matches(text, '{tx.CALL_TO_ACTION}') AS boilerplate, length(text) BETWEEN 20 AND 240 AND regexp_matches(text, '{tx.FOOTER_HAS}') AND NOT regexp_matches(text, '{tx.FOOTER_HAS_NOT}') AS footer FROM conversations")
def boilerplate_quotes(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", tx.boilerplate_quote(F.col("text")).alias("boilerplate"), tx.irrelevant_footer(F.col("text")).alias("footer"))


_NORM = "trim(regexp_replace(regexp_replace(lower({}), '[^\\pL\\pN\\s]+', ' ', 'g'), '\\s+', ' ', 'g'))"


#: Whole items; their first 14, 9 and 4 characters; and items that name a page, known or not.
_CUTS = {1: 14, 2: 9, 3: 4}


@query(f"""WITH q AS (SELECT item_id, {_NORM.format("text")} AS q, NULL AS own FROM benchmark UNION ALL SELECT 4000000 + item_id, {_NORM.format("text")}, item_id % 20 - 3 FROM benchmark
    {" ".join(f"UNION ALL SELECT {k}000000 + item_id, {_NORM.format(f'substr(text, 1, {n})')}, NULL FROM benchmark" for k, n in _CUTS.items())}), t AS (SELECT doc_id, {_NORM.format("text")} AS t FROM documents)
  SELECT item_id, (SELECT min(doc_id) FROM t WHERE contains(t, q) AND (doc_id = own OR own IS NULL OR own < 0)) AS page_id FROM q""")
def verbatim_match(spark, d):
    b = table(spark, d, "benchmark")
    none = F.lit(None).cast("long").alias("own_page")
    items = b.select("item_id", F.col("text").alias("quote"), none).unionByName(b.select((4000000 + F.col("item_id")).alias("item_id"), F.col("text").alias("quote"), (F.col("item_id") % 20 - 3).alias("own_page")))
    for k, n in _CUTS.items():
        items = items.unionByName(b.select((k * 1000000 + F.col("item_id")).alias("item_id"), F.substring("text", 1, n).alias("quote"), none))
    return ev.verbatim(items, table(spark, d, "documents").select(F.col("doc_id").alias("page_id"), "text"))


_COMMON = ", ".join(f"'{w}'" for w in COMMON_WORDS)
_WORDS = "regexp_extract_all(lower(nfc_normalize(text)), '[\\pL\\pM\\pN]+(?:[''’.\\-][\\pL\\pM\\pN]+)*')"


@query(f"SELECT w AS word, count(DISTINCT source) AS df FROM (SELECT source, unnest({_WORDS}) AS w FROM documents) GROUP BY 1")
def doc_frequency(spark, d):
    return ev.document_frequency(table(spark, d, "documents").select(F.col("source").alias("project"), "text"))


@query(f"""WITH g AS (SELECT source, {_WORDS} AS w FROM documents), r AS (SELECT source, unnest(list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i + 5], ' '))) AS gram FROM g WHERE len(w) >= 6)
  SELECT gram, count(DISTINCT source) AS owners FROM r GROUP BY 1""")
def ngram_owners(spark, d):
    return ev.gram_owners(table(spark, d, "documents").select(F.col("source").alias("project"), "text"))


@query(f"""WITH w AS (SELECT doc_id, source, {_WORDS} AS ws FROM documents), df AS (SELECT w, count(DISTINCT source) AS df FROM (SELECT source, unnest(ws) AS w FROM w) GROUP BY 1),
  x AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w)
  SELECT doc_id AS id, string_agg(CASE WHEN w IN ({_COMMON}) OR df >= 3 THEN w ELSE '▇▇' END, ' ' ORDER BY i) AS masked FROM x JOIN df USING (w) GROUP BY 1""")
def mask_rare_words(spark, d):
    docs = table(spark, d, "documents")
    df = ev.document_frequency(docs.select(F.col("source").alias("project"), "text"))
    return ev.mask_rare_words(docs.select(F.col("doc_id").alias("id"), "text"), df)


@query()
def mask_quotes(spark, d):
    """Full masking of conversation turns: terms, rare words, runs of words of one's own."""
    c = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), (F.col("conv_id") % 20).alias("project"), "text")
    terms = c.select("project").distinct().select("project", F.lit("the").alias("term"), F.lit("[product]").alias("placeholder"))
    return ev.mask_quotes(c, terms)


@query("""WITH RECURSIVE l AS (SELECT doc_id AS id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS s FROM documents),
  f AS (SELECT id, 0 AS i, CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS used FROM l UNION ALL SELECT f.id, i + 1, CASE WHEN used > 0 AND used + s[i + 1] > 2000 THEN chunk + 1 ELSE chunk END, CASE WHEN used > 0 AND used + s[i + 1] > 2000 THEN s[i + 1] ELSE used + s[i + 1] END FROM f JOIN l ON f.id = l.id WHERE i < len(s))
  SELECT id, max(chunk) + 1 AS n_chunks FROM f GROUP BY id""")
def pack_lines(spark, d):
    return ev.pack_lines(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), 2000)


@query()
def chunk_pack(spark, d):
    """Page-preserving packing of document lines into chunks of 4,000 characters."""
    return ev.pack(_lines(spark, d).withColumn("page_ix", F.floor(F.col("span_ix") / 3)), 4000)


def _costs(chars, n):
    """An estimate of a request's tokens, by a chunk's characters and spans."""
    return F.ceil(chars / 4) + 25 * n + 100 <= 700


@query()
def chunk_halving(spark, d):
    """Packed chunks of whole documents' capped spans, cut in halves until a request holds each."""
    spans = ev.page_spans(table(spark, d, "documents").select(F.col("doc_id").alias("project"), F.lit(0).alias("page_ix"), "text"), 1500)
    sized = spans.select("project", F.floor(F.col("span_ix") / 3).alias("page_ix"), "span_ix", ev.text_size().alias("size"))
    return ev.halve(ev.pack_sizes(sized, 4000), _costs, 4000)


@query()
def split_oversized(spark, d):
    """Capped spans of whole documents."""
    return ev.page_spans(table(spark, d, "documents").select(F.col("doc_id").alias("project"), F.lit(0).alias("page_ix"), "text"))


@query("""WITH a AS (SELECT DISTINCT user_id AS project, event_type AS url FROM events WHERE value > 10), b AS (SELECT DISTINCT user_id AS project, event_type AS url FROM events WHERE value < 8),
  f AS (SELECT coalesce(a.project, b.project) AS project, a.project IS NOT NULL AS l, b.project IS NOT NULL AS r FROM a FULL JOIN b USING (project, url))
  SELECT project, count(*) FILTER (l AND r) AS both, count(*) FILTER (l AND NOT r) AS left_only, count(*) FILTER (r AND NOT l) AS right_only, round(count(*) FILTER (l AND r) / count(*)::DOUBLE, 9) AS jaccard FROM f GROUP BY project""")
def full_outer_sets(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("project"), F.col("event_type").alias("url"), "value")
    return ev.page_sets(e.where("value > 10"), e.where("value < 8")).withColumn("jaccard", F.round("jaccard", 9))


@query("""WITH c AS (SELECT doc_id % 50 AS project, doc_id % 200 AS chunk, CAST(ceil(sum(length(text)) / 4.0) AS BIGINT) + 100 AS tokens FROM documents GROUP BY ALL)
  SELECT project, count(*) AS chunks, sum(tokens)::BIGINT AS tokens, count(*) FILTER (tokens > 3000) AS refused FROM c GROUP BY project""")
def cost_inputs(spark, d):
    return ev.cost_inputs(table(spark, d, "documents").select((F.col("doc_id") % 50).alias("project"), (F.col("doc_id") % 200).alias("chunk"), "text"), 100, 3000)


@query("""SELECT conv_id, turn, 'n' || CAST(conv_id AS VARCHAR) AS reply, CAST(conv_id AS VARCHAR) AS found FROM conversations""")
def reply_parsing(spark, d):
    c = table(spark, d, "conversations")
    raw = F.concat(F.lit("<think>some {thoughts}</think>\nHere: ```json\n{\"a\": "), F.col("conv_id").cast("string"), F.lit("}\n``` n"), F.col("conv_id").cast("string"))
    rest = tx.without_thinking(raw)
    return c.select("conv_id", "turn", F.regexp_extract(rest, r"(n\d+)$", 1).alias("reply"), F.get_json_object(tx.json_in(rest), "$.a").alias("found"))


@query("SELECT conv_id, turn, ['acme/tool', 'other/x.y'] AS repos FROM conversations")
def repository_links(spark, d):
    t = F.concat("text", F.lit(" see github.com/Acme/tool.git and github.com/acme/Tool, github.com/sponsors/me github.com/other/x.y."))
    return table(spark, d, "conversations").select("conv_id", "turn", tx.repository_links(t).alias("repos"))


@query("SELECT event_id, CASE WHEN s IN (402, 403, 429) THEN true WHEN s BETWEEN 200 AND 299 THEN false ELSE event_type = 'click' END AS quota FROM (SELECT *, 200 + event_id % 300 AS s FROM events)")
def quota_responses(spark, d):
    body = F.when(F.col("event_type") == "click", "your Balance is low").otherwise("try later, creditable")
    return table(spark, d, "events").select("event_id", tx.is_quota_response(200 + F.col("event_id") % 300, body).alias("quota"))


@query("SELECT c_nationkey AS k, list_sort(list(DISTINCT c_custkey % 30)) AS v FROM customer GROUP BY 1")
def distinct_sorted(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.sort_array(F.collect_set(F.col("c_custkey") % 30)).alias("v"))


@query("""WITH v AS (SELECT DISTINCT c_nationkey AS k, c_custkey % 30 AS x FROM customer), i AS (SELECT k, x, x - row_number() OVER (PARTITION BY k ORDER BY x) AS g FROM v), r AS (SELECT k, g, min(x) AS a, max(x) AS b FROM i GROUP BY ALL)
  SELECT k, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) END, ',' ORDER BY a) AS ranges FROM r GROUP BY k""")
def range_text(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.collect_set(F.col("c_custkey") % 30).alias("v"))
    return g.select("k", tx.range_text(F.col("v")).alias("ranges"))
