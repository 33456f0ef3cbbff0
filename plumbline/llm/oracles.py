"""SQL for an outside engine (DuckDB) that gives the same rows as the queries; only where SQL can say it.

Fingerprints (XXH64), alignments, tree weighting, JSON records and merges have none: those are tested against brute force.
"""

from __future__ import annotations

from .clustering import CENTROIDS, DIMS, ROUNDS, SCALE
from .licenses import CUE, LICENCE_FILE, NOTICE_CHARS, SPDX, TEMPLATES, THRESHOLD, VERBATIM
from .quality import BIT, LEXICON_ROWS, POLICIES, RULES, STOP_WORDS, TOXIC_WORDS
from .variants import LEAST_CHARS, LEAST_COUNT, ONE_IN, TIMES

_TRIM = "trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"

LINE_DEDUP = f"""
WITH lines AS (
  SELECT doc_id, i - 1 AS i, l, {_TRIM} AS t FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
win AS (
  SELECT doc_id, i AS a, lead(i, 2) OVER w AS b, t AS x, lead(t) OVER w AS y, lead(t, 2) OVER w AS z FROM lines WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
first AS (SELECT x, y, z, min((doc_id, a)) AS f FROM win WHERE b IS NOT NULL GROUP BY ALL),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM win JOIN first USING (x, y, z) WHERE b IS NOT NULL AND (doc_id, a) > f),
marked AS (SELECT l.doc_id, l.i, l.l, g.i IS NOT NULL AS gone FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i)
SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed FROM marked GROUP BY doc_id
"""

_SPACE = "[\\x20\\x09-\\x0D]+"
_PLAIN = """trim(lower(w), '.,;:!?"()#*$%&|')"""
_SQL_RULES = " + ".join(f"CASE WHEN {r.fails} THEN {BIT[r.name]} ELSE 0 END" for r in RULES)
_names = lambda words: ", ".join(f"'{w}'" for w in words)

QUALITY = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT doc_id, text, list_filter(string_split_regex(text, '{_SPACE}'), lambda w: w <> '') AS ws FROM docs),
sample AS (SELECT DISTINCT doc_id, toxic FROM labels WHERE toxic IS NOT NULL ORDER BY md5(CAST(doc_id AS VARCHAR)), toxic LIMIT {LEXICON_ROWS}),
lexicon AS (
  SELECT w FROM (SELECT DISTINCT doc_id, toxic, {_PLAIN} AS w FROM (SELECT doc_id, toxic, unnest(ws) AS w FROM words JOIN sample USING (doc_id)))
  GROUP BY w HAVING sum(toxic) >= 5 AND 20 * sum(toxic) >= 19 * count(*) AND length(w) >= 3),
tokens AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM words),
win AS (SELECT doc_id, i, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM tokens WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
rep AS (SELECT doc_id, i FROM win WHERE c IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
cover AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
per_word AS (
  SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars, count(DISTINCT w) AS n_distinct_words, count(*) FILTER ({_PLAIN} IN ({_names(STOP_WORDS)})) AS n_stop_words,
    count(*) FILTER ({_PLAIN} IN ({_names(TOXIC_WORDS)}) OR {_PLAIN} IN (SELECT w FROM lexicon)) AS n_toxic_words FROM tokens GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS ls FROM docs),
m AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    CAST(len(regexp_extract_all(text, '[A-Z]')) AS BIGINT) AS n_capitals, CAST(len(regexp_extract_all(text, '[0-9]')) AS BIGINT) AS n_digits, coalesce(n_stop_words, 0) AS n_stop_words,
    coalesce(n_toxic_words, 0) AS n_toxic_words, coalesce(n_distinct_words, 0) AS n_distinct_words
  FROM docs d JOIN lines USING (doc_id) LEFT JOIN per_word USING (doc_id) LEFT JOIN cover USING (doc_id)),
bits AS (SELECT *, CAST({_SQL_RULES} AS BIGINT) AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits & {POLICIES["base-1"]} <> 0 AS base_failed, fail_bits & {POLICIES["quality-2"]} = 0 AS kept, fail_bits FROM bits
"""

_RULE_ROWS = ", ".join(f"('{r.name}', {BIT[r.name]})" for r in RULES if BIT[r.name] & POLICIES["quality-2"])

ABLATION = f"""
WITH q AS ({QUALITY}), rules AS (SELECT * FROM (VALUES {_RULE_ROWS}) AS t(rule, bit)), m AS (SELECT fail_bits & {POLICIES["quality-2"]} AS bits FROM q)
SELECT rule, 'quality-2' AS policy, count(*) FILTER (bits & bit <> 0) AS n_failed, count(*) FILTER (bits = bit) AS n_failed_alone, count(*) FILTER (bits = 0) AS n_kept, count(*) FILTER (bits = 0 OR bits = bit) AS n_kept_without
FROM m, rules GROUP BY rule
"""

_INNER = "regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1)"
for _a, _b in (("</?b>", ""), ("<[^>]+>", " ")):
    _INNER = f"regexp_replace({_INNER}, '{_a}', '{_b}', 'g')"
for _a, _b in (("&quot;", '"'), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "''"), ("&#x27;", "''"), ("&amp;", "&")):
    _INNER = f"replace({_INNER}, '{_a}', '{_b}')"

#: The main text in the one template that the test pages have; the query itself knows nothing of it.
EXTRACTION = f"SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM (SELECT page_id, url, trim(regexp_replace({_INNER}, '\\s+', ' ', 'g')) AS text FROM pages)"

SUFFIXES = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
dup AS (SELECT doc_id, p FROM w JOIN f USING (s) WHERE first < doc_id),
runs AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM dup)),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, g),
pieces AS (SELECT doc_id, a, b, substr(h, 2 * coalesce(lag(b) OVER o, 0) + 1, 2 * (a - coalesce(lag(b) OVER o, 0))) AS x FROM spans JOIN d USING (doc_id) WINDOW o AS (PARTITION BY doc_id ORDER BY a)),
kept AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS tail, string_agg(x, '' ORDER BY a) AS x FROM pieces GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(x, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in TEMPLATES)
_TOKEN = "unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.-][a-z0-9]+)*'))"

LICENSES = f"""
WITH files AS (SELECT doc_id, coalesce(text, '') AS text, source || '/' || doc_id // 1000 || CASE WHEN doc_id % 100 = 0 THEN '/LICENSE-' || doc_id ELSE '/' || doc_id // 100 || '/' || doc_id || '.txt' END AS path FROM documents),
lines AS (SELECT doc_id, path, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS unit FROM files),
runs AS (SELECT *, lead(text) OVER w AS b, lead(text, 2) OVER w AS c FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY unit)),
cues AS (SELECT doc_id, path, unit, [array_to_string(list_transform(list_filter(regexp_extract_all(regexp_extract(text, '{SPDX}', 1), '[A-Za-z0-9][A-Za-z0-9.+-]*'), lambda x: x NOT IN ('AND', 'OR', 'WITH')), lambda x: 'spdx-' || x), ' '),
  text, text || ' ' || b, text || ' ' || b || ' ' || c] AS ts FROM runs WHERE regexp_matches(text, '{CUE}')),
units AS (SELECT doc_id, path, 4 * unit + k AS unit, text, false AS is_file FROM (SELECT doc_id, path, unit, unnest(ts) AS text, generate_subscripts(ts, 1) AS k FROM cues) WHERE k = 2 OR text <> '' AND (k = 1 OR length(text) <= {NOTICE_CHARS})
  UNION ALL SELECT doc_id, path, -1, text, true FROM files WHERE text <> '' AND regexp_matches(regexp_extract(path, '[^/]*$'), '{LICENCE_FILE}')),
templates AS (SELECT *, row_number() OVER () AS template FROM (VALUES {_TEMPLATE_ROWS}) AS t(license_id, text)),
ut AS (SELECT doc_id, unit, token, count(*) AS tf FROM (SELECT doc_id, unit, {_TOKEN} AS token FROM units) GROUP BY ALL),
tt AS (SELECT license_id, template, token, count(*) AS tf FROM (SELECT license_id, template, {_TOKEN} AS token FROM templates) GROUP BY ALL),
idf AS (SELECT token, ln((1 + (SELECT count(*) FROM units) + (SELECT count(*) FROM templates)) / (1 + count(*))::DOUBLE) + 1 AS idf FROM (SELECT token FROM ut UNION ALL SELECT token FROM tt) GROUP BY token),
uw AS (SELECT doc_id, unit, token, tf * idf AS w FROM ut JOIN idf USING (token)), tw AS (SELECT license_id, template, token, tf * idf AS w FROM tt JOIN idf USING (token)),
un AS (SELECT doc_id, unit, sqrt(sum(w * w)) AS norm FROM uw GROUP BY ALL), tn AS (SELECT template, sqrt(sum(w * w)) AS norm FROM tw GROUP BY ALL),
dots AS (SELECT doc_id, unit, license_id, template, sum(uw.w * tw.w) AS dot FROM uw JOIN tw USING (token) GROUP BY ALL),
hits AS (SELECT doc_id, license_id, unit <> -1 OR round(dot / un.norm / tn.norm, 9) < {VERBATIM} AS part, round(dot / un.norm / tn.norm, 9) AS score FROM dots JOIN un USING (doc_id, unit) JOIN tn USING (template)),
own AS (SELECT doc_id, arg_min(license_id, (part, -score, license_id)) AS license_id, arg_min(score, (part, -score, license_id)) AS score FROM hits WHERE score >= {THRESHOLD} GROUP BY doc_id),
dirs AS (SELECT regexp_replace(path, '/?[^/]*$', '') AS dir, arg_min(o.license_id, (-o.score, o.license_id)) AS license_id, max(o.score) AS score FROM own o JOIN (SELECT DISTINCT doc_id, path FROM units WHERE is_file) USING (doc_id) GROUP BY 1),
near AS (SELECT doc_id, arg_max(dir, length(dir)) AS dir FROM files JOIN dirs ON starts_with(path, dir || '/') GROUP BY doc_id)
SELECT f.doc_id, path, coalesce(o.license_id, d.license_id) AS license_id, coalesce(o.score, d.score) AS score, CASE WHEN o.doc_id IS NOT NULL THEN 'own' WHEN d.dir IS NOT NULL THEN 'inherited' END AS found,
  CASE WHEN o.doc_id IS NULL THEN d.dir END AS licence_dir
FROM files f LEFT JOIN own o USING (doc_id) LEFT JOIN near n USING (doc_id) LEFT JOIN dirs d ON d.dir = n.dir
"""

_ACCENTS = "".join(map(chr, range(0xC0, 0x100)))
_PLAIN_SIGNS = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).islower() and chr(c) not in "'-^\\\\")[: len(_ACCENTS)]

#: Edit distances here are those of bytes, so accented letters are written as single signs first. The checksum goes bit by bit.
VARIANTS = f"""
WITH RECURSIVE runs AS (
  SELECT id, run, count(*) AS n FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) GROUP BY ALL),
bits AS (SELECT *, flatten(list_transform(range(0, octet_length(b)), lambda i: list_transform(range(0, 8), lambda j: (CAST('0x' || substr(hex(b), 2 * i + 1, 2) AS BIGINT) >> j) & 1))) AS bs FROM (SELECT *, encode(id || ':' || run) AS b FROM runs)),
sums AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bs), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295) AS h FROM bits),
typed AS (SELECT CASE WHEN h % {ONE_IN} = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM sums),
v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n, translate(word, '{_ACCENTS}', '{_PLAIN_SIGNS}') AS plain FROM typed WHERE length(word) >= {LEAST_CHARS} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}),
cuts AS (SELECT word, n, plain, unnest(list_append(list_transform(range(0, length(word)), lambda i: left(word, i) || substr(word, i + 2)), word)) AS cut FROM v),
near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.word <> b.word WHERE levenshtein(a.plain, b.plain) = 1),
best AS (SELECT word, n, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY ALL),
named AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {TIMES} * v.n THEN other END AS form, CASE WHEN m >= {TIMES} * v.n THEN m END AS form_n FROM v LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS root FROM named UNION ALL SELECT s.word, f.form FROM steps s JOIN named f ON s.root = f.word WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM steps JOIN named USING (word) WHERE root NOT IN (SELECT word FROM named WHERE form IS NOT NULL)
"""

_NEAREST = "arg_min(k, (list_sum(list_transform(x.v, lambda e, i: (e - c.v[i]) * (e - c.v[i]))), k))"
_ROUND = """a{r} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(x.v) AS v, {nearest} AS k FROM kept x CROSS JOIN c{r} c GROUP BY r),
m{r} AS (SELECT k, list((s - (s % n + n) % n) // n ORDER BY i) AS v FROM (SELECT k, i, CAST(sum(e) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY ALL) GROUP BY k),
c{next} AS (SELECT k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (k))"""

CLUSTERS = f"""
WITH kept AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMS}),
c0 AS (SELECT row_number() OVER (ORDER BY h NULLS LAST, v) - 1 AS k, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept) ORDER BY h NULLS LAST, v LIMIT {CENTROIDS}),
{", ".join(_ROUND.format(r=r, next=r + 1, nearest=_NEAREST) for r in range(ROUNDS))},
last AS (SELECT r, any_value(vec_id) AS vec_id, {_NEAREST} AS cluster, min(list_sum(list_transform(x.v, lambda e, i: (e - c.v[i]) * (e - c.v[i])))) AS distance FROM kept x CROSS JOIN c{ROUNDS} c GROUP BY r)
SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance, CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM last JOIN c{ROUNDS} c ON c.k = cluster
"""

ORACLES = {
    "op2_line_dedup": LINE_DEDUP,
    "op3_license_scan": LICENSES,
    "op4_quality_rules": QUALITY,
    "quality_ablation": ABLATION,
    "op5_html_extraction": EXTRACTION,
    "op9_suffix_array": SUFFIXES,
    "op11_spelling_variants": VARIANTS,
    "op12_sort_means": CLUSTERS,
}
