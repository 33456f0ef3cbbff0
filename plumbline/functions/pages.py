"""Column expressions over collected pages, replies and records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SHARED_PATH_HOSTS, SHARED_SUFFIXES, ascii_edges, host, is_url, json_in

# Sizes, patterns and names that decide results.
THIN_CHARS, EMPTY_CHARS, SPA_CHARS = 500, 100, 600
SPA_MARKER = r"""(?i)<div[^>]+id=["'](?:root|app|__next|__nuxt|___gatsby)["']"""
NUMBER = r"(\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)\s*(k|thousand)?\+?"
EMPLOYEES = rf"(?i){NUMBER}\s*(?:full[- ]time\s+)?(?:employees|staff|people on (?:our|the) team|team members)\b"
MONEY = r"(?:\$|USD\s?|US\$)\s?(\d+(?:\.\d+)?)\s*(m|mm|million|b|bn|billion)\b"
FUNDING = [
    rf"(?i)\b(?:raised|raising|funding of|backed (?:with|by))\b[^.]{{0,40}}?{MONEY}",
    rf"(?i){MONEY}[^.]{{0,30}}?\b(?:seed|series [a-e]|funding|round|investment)\b",
]
LISTED = r"\b(?:NASDAQ|NYSE|LSE|TSX|ASX|HKEX|Euronext)\s*:\s*[A-Z]{1,5}\b|\bpublicly (?:traded|listed)\b"
SPONSORS = {"Nebius": r"(?i)\bnebius\b", "Tavily": r"(?i)\btavily\b", "NVIDIA": r"(?i)\bnvidia\b|\bnemotron\b", "LangSmith": r"(?i)\blangsmith\b", "Toloka": r"(?i)\btoloka\b", "Tandem": r"(?i)\btandem\b"}
RECORD_RULES = {
    "email-address": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "api-key-assignment": r"(?i)(api[_-]?key|secret|token)\s*[=:]\s*\S+",
    "bearer-token": r"(?i)bearer\s+[a-z0-9._~+/=-]{8,}",
}


def thin(text: Column) -> Column:
    return F.length(text) < THIN_CHARS


def empty(text: Column) -> Column:
    return F.length(F.trim(text)) < EMPTY_CHARS


def visible_chars(html: Column) -> Column:
    t = F.regexp_replace(F.regexp_replace(html, r"(?is)<script.*?</script>", " "), r"(?is)<style.*?</style>", " ")
    return F.length(F.trim(F.regexp_replace(F.regexp_replace(t, "<[^>]+>", " "), r"\s+", " ")))


def page_type(url: Column, off_boundary: Column, html: Column) -> Column:
    """redirect, repo-only, shared-host, spa or own-domain; an application's page has a mount point, a script and little to see."""
    h = F.regexp_replace(host(url), r"^www\.", "")
    shared = h.rlike("(^|\\.)(" + "|".join(s.replace(".", "\\.") for s in SHARED_SUFFIXES) + ")$")
    spa = html.rlike(SPA_MARKER) & (visible_chars(html) < SPA_CHARS) & html.rlike("(?i)<script")
    return (
        F.when(off_boundary, "redirect").when(h == "github.com", "repo-only").when(h.isin(SHARED_PATH_HOSTS) | shared, "shared-host")
        .when(F.coalesce(spa, F.lit(False)), "spa").otherwise("own-domain")
    )


def homepage_to_follow(homepage: Column) -> Column:
    """The address that a repository declares as its homepage; none on the code host itself or with another scheme than http(s)."""
    schemed = homepage.rlike(r"(?i)^[a-z][a-z0-9+.-]*://")
    url = F.when(schemed, homepage).otherwise(F.concat(F.lit("https://"), homepage))
    h = F.regexp_replace(host(url), r"^www\.", "")
    fine = (homepage != "") & url.rlike(r"(?i)^https?://") & is_url(url) & (h != "github.com") & ~h.endswith(".github.com")
    return F.when(F.coalesce(fine, F.lit(False)), url)


def repository_text(content: Column, encoding: Column) -> Column:
    """A file's text: decoded if it came in base 64, with or without line feeds, else as it is."""
    return F.when(encoding == "base64", F.decode(F.unbase64(F.replace(content, F.lit("\n"), F.lit(""))), "UTF-8")).otherwise(content)


def quote_around(text: Column, start: Column, length: Column, margin: int = 60) -> Column:
    """A match (start from 1) with up to `margin` characters on either side, ellipses where more was cut off."""
    a = F.greatest(F.lit(1), start - margin)
    b = F.least(F.length(text) + 1, start + length + margin)
    middle = F.trim(F.regexp_replace(F.substr(text, a, b - a), r"\s+", " "))
    return F.concat(F.when(a > 1, "…").otherwise(""), middle, F.when(b <= F.length(text), "…").otherwise(""))


def _amounts(text: Column, pattern: str, number: int, unit: int) -> Column:
    p = ascii_edges(pattern)
    return F.arrays_zip(
        F.regexp_extract_all(text, F.lit(p), 0).alias("hit"), F.regexp_extract_all(text, F.lit(p), number).alias("amount"), F.regexp_extract_all(text, F.lit(p), unit).alias("unit")
    )


def well_known(text: Column) -> Column:
    """Array of struct(pattern, quote): signs that a project is well known, the first match of each pattern that is large enough.

    50 or more employees, funding of 10 million or more, or a stock listing.
    """
    heads = F.filter(_amounts(text, EMPLOYEES, 1, 2), lambda x: F.replace(x["amount"], F.lit(","), F.lit("")).cast("double") * F.when(x["unit"] != "", 1000).otherwise(1) >= 50)
    money = [F.filter(_amounts(text, p, 1, 2), lambda x: x["amount"].cast("double") * F.when(x["unit"].rlike("(?i)^b"), 1000).otherwise(1) >= 10) for p in FUNDING]
    listed = F.regexp_extract_all(text, F.lit(ascii_edges(LISTED)), 0)
    first = {"employees": F.get(heads, 0)["hit"], "funding": F.coalesce(F.get(money[0], 0)["hit"], F.get(money[1], 0)["hit"]), "listed": F.get(listed, 0)}
    found = F.array(*(F.when(hit.isNotNull(), F.struct(F.lit(name).alias("pattern"), quote_around(text, F.position(hit, text), F.length(hit)).alias("quote"))) for name, hit in first.items()))
    return F.array_compact(found)


def sponsors(text: Column) -> Column:
    """Names of the sponsors that a text mentions."""
    return F.array_compact(F.array(*(F.when(text.rlike(ascii_edges(p)), F.lit(name)) for name, p in SPONSORS.items())))


def reply_stage(raw: Column, span_ids: Column, checks: list[str], states: list[str]) -> Column:
    """Where a model's reply first fails: json_parse, shape, span_resolve, or ok.

    A reply names each check once with a known state and a list of spans, keyed by check or as an array; every span must be one of `span_ids`.
    """
    text = F.trim(raw)
    keyed = F.from_json(text, "checks map<string, struct<proposedState: string, spanIds: array<string>>>")["checks"]
    entries = F.transform(F.map_entries(keyed), lambda e: F.struct(e["key"].alias("checkId"), e["value"]["proposedState"].alias("proposedState"), e["value"]["spanIds"].alias("spanIds")))
    listed = F.from_json(text, "checks array<struct<checkId: string, proposedState: string, spanIds: array<string>>>")["checks"]
    all_of = F.coalesce(F.when(F.get_json_object(text, "$.checks").startswith("["), listed), entries)
    fine = (F.array_sort(F.transform(all_of, lambda x: x["checkId"])) == F.array(*(F.lit(c) for c in sorted(checks)))) & F.forall(all_of, lambda x: F.coalesce(x["proposedState"].isin(states), F.lit(False)) & x["spanIds"].isNotNull())
    resolves = F.forall(all_of, lambda x: F.size(F.array_except(x["spanIds"], span_ids)) == 0)
    return F.when(F.try_parse_json(text).isNull(), "json_parse").when(~F.coalesce(fine, F.lit(False)), "shape").when(~F.coalesce(resolves, F.lit(False)), "span_resolve").otherwise("ok")


def first_json_block(markdown: Column) -> Column:
    """The first fenced JSON block of a document, if it is valid."""
    block = F.trim(F.regexp_extract(markdown, r"(?s)```json\s*\n(.*?)\n```", 1))
    return F.when(block != "", json_in(block))


def json_strings(json: Column) -> Column:
    """All string values of a JSON text of any shape, in order. Names are told from values by the colon that follows them."""
    tokens = F.regexp_extract_all(json, F.lit(r'("(?:[^"\\]|\\.)*")(\s*:)?'), 0)
    return F.transform(F.filter(tokens, lambda t: t.endswith('"')), lambda t: F.from_json(F.concat(F.lit('{"v":'), t, F.lit("}")), "v string")["v"])


def numbers_only(json: Column, keys: list[str]) -> Column:
    """map(key, value as text) of the named fields of the object itself that are numbers or truth values, and no others.

    What is no object, or names a field twice, gives an empty map.
    """
    parsed = F.try_parse_json(json)
    entries = []
    for k in keys:
        path = f"$['{k}']" if "'" not in k else f'$["{k}"]'
        kind = F.schema_of_variant(F.try_variant_get(parsed, path, "variant"))
        plain = kind.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | kind.startswith("DECIMAL")
        entries.append(F.when(plain, F.struct(F.lit(k).alias("key"), F.try_variant_get(parsed, path, "string").alias("value"))))
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def record_faults(line: Column, allowed_hosts: list[str]) -> Column:
    """Names of the rules that a line of a numbers-only record breaks; what it holds is not repeated."""
    urls = F.regexp_extract_all(line, F.lit(r"https?://[^\s)>\"']+"), 0)
    other = F.exists(urls, lambda u: ~host(u).isin(allowed_hosts))
    rules = [F.when(other, F.lit("url-not-on-allow-list")), *(F.when(line.rlike(p), F.lit(name)) for name, p in RECORD_RULES.items())]
    return F.array_compact(F.array(*rules))


def map_credits(pages: Column, instructions: Column) -> Column:
    return (F.ceil(pages / 10) * F.when(instructions, 2).otherwise(1)).cast("long")


def extract_credits(successes: Column, advanced: Column) -> Column:
    return (F.ceil(successes / 5) * F.when(advanced, 2).otherwise(1)).cast("long")


def day_of(seconds: Column) -> Column:
    """ISO day (UTC) of seconds since 1970."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd")


def last_day(end: Column) -> Column:
    """The last day of a window that ends before `end`."""
    return F.date_format(F.date_sub(F.to_date(end), 1), "yyyy-MM-dd")


def _any_case(text: Column) -> Column:
    quoted = F.regexp_replace(text, r"([.*+?^${}()|\[\]\\])", r"\\$1")
    chars = F.filter(F.split(quoted, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, lambda c: F.when(c.rlike("[A-Za-z]"), F.concat(F.lit("["), F.lower(c), F.upper(c), F.lit("]"))).otherwise(c)), "")


def selectors(b: Column) -> Column:
    """struct(domain, path): anchored patterns, in any case, of the addresses within a boundary."""
    own, prefix = _any_case(F.lower(b.getField("host"))), b.getField("path_prefix")
    only = F.coalesce(b.getField("exact"), F.lit(False)) | prefix.isNotNull()
    domain = F.concat(F.when(only, F.lit("^")).otherwise(F.lit(r"^(?:.+\.)?")), own, F.lit("$"))
    return F.struct(domain.alias("domain"), F.concat(F.lit("^"), _any_case(prefix), F.lit("(?:/.*)?$")).alias("path"))
