"""Column expressions over text and URLs, and the few functions that need code."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide results.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
PHONE = r"(?<![\w./-])(?:\+\d{1,3}[\s.-]?)?(?:\(\d{2,4}\)[\s.-]?|\d{2,4}[\s.-])(?:\d{2,4}[\s.-]?){1,4}\d{2,4}(?![\w-])"
HANDLE = r"@[A-Za-z0-9_]{2,30}"
INJECTION = [r"(?i)ignore (all |the )?previous instructions", r"(?i)mark all checks", r"(?i)you are an? (ai|assistant|language model)", r"(?im)^(system|assistant):"]
BLOCK_TAGS = "p|div|li|h[1-6]|tr|section|article|header|footer|nav|main|aside|blockquote|pre|ul|ol|table|thead|tbody|tfoot"
HIDDEN_TAGS = ["script", "style", "noscript", "template", "svg"]
ENTITIES = [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'")]
CALL_TO_ACTION = r"(?i)\b(?:go to app|book a demo|start for free|try (?:it )?free|sign up(?: free)?|get started|install now|request a demo|schedule a demo|watch (?:the )?demo)\b"
EVALUATIVE = r"(?i)\b(lack\w*|missing|fail\w*|non-compliant|blocked|compliant|certified|scor\w*)\b"
TREND = r"(?i)\b(improv\w*|worsen\w*|rising|falling|trend\w*|over time|grow\w*|declin\w*|(more|fewer) than last quarter)\b"
ASSET = r"(?i)\.(?:png|jpe?g|gif|webp|svg|ico|css|js|mjs|map|json|xml|zip|gz|tar|mp4|mp3|wav|woff2?|ttf|pdf|dmg|exe)$"
ASSET_PATH = r"(?i)(?:^|/)_next/static(?:/|$)|(?:^|/)static/(?:css|js|chunks)(?:/|$)"
POLICY_PATH = r"(^|/)(privacy|terms|tos|legal|security|policy|policies|cookies?|gdpr|dpa|trust|license)([-_./]|$)"
DOCS_PATH = r"(^|/)(docs?|documentation|guides?|reference|api|manual|faq|help)([-_./]|$)"
PRIORITY_PATHS = [r"^/?$", r"(?i)(^|/)(docs?|documentation|guide|guides|api)(/|$)", r"(?i)(^|/)pricing(/|$)", r"(?i)(^|/)(security|trust|privacy)(/|$)", r"(?i)(^|/)(about|company|team)(/|$)"]
FOOTER_HAS = r"(?i)copyright|all rights reserved|©"
FOOTER_HAS_NOT = r"(?i)\b(?:test\w*|eval\w*|fail\w*|benchmark\w*|accuracy|risk\w*|safety|audit\w*|experiment\w*|reliab\w*|ignore|instructions?|system|assistant|prompt|json|confirm|reject)\b"
TITLE_KEYWORDS = r"(?i)\b(ai|a\.i\.|llm|llms|agent|agents|agentic|rag|chatbot|neural|diffusion|embedding|embeddings|transformer|inference|prompt|prompts|assistant|ml|gen ?ai|generative)\b"
CODE_HOSTS = r"(^|\.)(github\.com|gitlab\.com|codeberg\.org|bitbucket\.org)$"
RESERVED_OWNERS = ["sponsors", "orgs", "features", "settings", "marketplace", "topics"]
#: Hosts whose projects are paths, and suffixes whose projects are subdomains.
SHARED_PATH_HOSTS = ["github.com", "huggingface.co"]
SHARED_SUFFIXES = ["github.io", "vercel.app", "netlify.app", "pages.dev", "hf.space", "onrender.com", "fly.dev", "streamlit.app", "gitlab.io"]
#: Public suffixes of two labels, where a registrable domain has three; a full list can be given to `boundary`.
PUBLIC_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp", "co.nz", "co.za", "co.in", "co.kr", "com.br", "com.cn", "com.mx", "com.tr", "com.sg", "com.hk", "com.tw", "com.ar"]
#: Edge of an ASCII word. Java's own counts accented letters as parts of words, which the fixed patterns do not.
_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"


def ascii_edges(pattern: str) -> str:
    """The pattern with `\\b` as the edge of an ASCII word."""
    return pattern.replace(r"\b", _EDGE)


def page_text(html: Column) -> Column:
    """Visible text: hidden elements dropped, line feeds at block ends, six entities decoded, blanks collapsed."""
    t = F.coalesce(html, F.lit(""))
    t = F.regexp_replace(t, ascii_edges(rf"(?is)<({'|'.join(HIDDEN_TAGS)})\b.*?</\1>"), " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, rf"(?i)</(?:{BLOCK_TAGS})\s*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for a, b in ENTITIES:
        t = F.replace(t, F.lit(a), F.lit(b))
    t = F.regexp_replace(t, r"[^\S\n]+", " ")
    t = F.regexp_replace(t, r" *\n *", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def flat_text(html: Column) -> Column:
    """Screening text: as page_text but on one line."""
    return F.regexp_replace(page_text(html), r"\s+", " ")


def links(html: Column) -> Column:
    """href values, of any element, but for fragments, mail and scripts, without their fragment, in page order, distinct."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)href\s*=\s*["']([^"']+)["']"""), 1)
    wanted = F.filter(found, lambda x: ~x.rlike(r"(?i)^(#|mailto:|javascript:)"))
    return F.array_distinct(F.transform(wanted, lambda x: F.regexp_replace(x, r"#.*$", "")))


def resolve(base: Column, href: Column) -> Column:
    """Absolute http(s) URL of a link on a page; other schemes give null."""
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    folder = F.regexp_replace(F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"^https?://[^/]+", ""), r"[^/]*$", "")
    folder = F.when(folder == "", "/").otherwise(folder)
    return (
        F.when(href.rlike(r"(?i)^https?://"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(base, r"^(https?:)", 1), href))
        .when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(href.startswith("/"), F.concat(origin, href))
        .otherwise(F.concat(origin, folder, href))
    )


def sitemap_locations(xml: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(xml, F.lit("")), F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), 1), lambda x: F.replace(x, F.lit("&amp;"), F.lit("&")))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def path(url: Column) -> Column:
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def is_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#\s]+"), F.lit(False))


def https_only(url: Column) -> Column:
    """https, standard port, no credentials."""
    return F.coalesce(url.rlike(r"(?i)^https://[^/?#@:\s]+(:443)?([/?#]|$)"), F.lit(False))


def page_like(url: Column) -> Column:
    return is_url(url) & ~path(url).rlike(ASSET) & ~path(url).rlike(ASSET_PATH)


def priority_rank(url: Column) -> Column:
    out, p = F.lit(len(PRIORITY_PATHS)), path(url)
    for i in reversed(range(len(PRIORITY_PATHS))):
        out = F.when(p.rlike(PRIORITY_PATHS[i]), i).otherwise(out)
    return F.when(is_url(url), out).otherwise(len(PRIORITY_PATHS))


def registrable(h: Column, suffixes: Sequence[str] = PUBLIC_SUFFIXES) -> Column:
    """Registrable domain: three labels under the given suffixes, else two; an address of numbers is its own."""
    by_suffix = h.rlike("(^|\\.)(" + "|".join(re.escape(s) for s in suffixes) + ")$") if suffixes else F.lit(False)
    name = F.when(by_suffix, F.regexp_extract(h, r"([^.]+\.[^.]+\.[^.]+)$", 1)).otherwise(F.regexp_extract(h, r"([^.]+\.[^.]+)$", 1))
    return F.when(h.rlike(r"^[0-9.]+$") | (name == ""), h).otherwise(name)


def boundary(url: Column, suffixes: Sequence[str] = PUBLIC_SUFFIXES) -> Column:
    """struct(host, path_prefix, exact): what a project owns, from its address.

    On a host of many projects a path, under a shared suffix exactly that host, else the registrable domain.
    """
    h = F.regexp_replace(host(url), r"^www\.", "")
    parts = F.filter(F.split(F.lower(path(url)), "/"), lambda x: x != "")
    deep = F.when((h == "huggingface.co") & F.get(parts, 0).isin("spaces", "datasets"), 3).otherwise(2)
    on_path = F.coalesce(h.isin(SHARED_PATH_HOSTS) & (F.size(parts) >= deep), F.lit(False))
    shared = h.rlike("(^|\\.)(" + "|".join(re.escape(s) for s in SHARED_SUFFIXES) + ")$") & ~on_path
    return F.when(
        is_url(url),
        F.struct(
            F.when(on_path | shared, h).otherwise(registrable(h, suffixes)).alias("host"),
            F.when(on_path, F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), deep), "/"))).alias("path_prefix"),
            F.coalesce(shared, F.lit(False)).alias("exact"),
        ),
    )


def within(url: Column, b: Column) -> Column:
    """On a path below the boundary's prefix on its very host; without one on its host, or under it unless it is exact."""
    h, p = F.regexp_replace(host(url), r"^www\.", ""), F.lower(path(url))
    own, prefix = F.regexp_replace(F.lower(b.getField("host")), r"^www\.", ""), F.regexp_replace(F.lower(b.getField("path_prefix")), "/+$", "")
    below = (p == prefix) | p.startswith(F.concat(prefix, F.lit("/")))
    under = ~F.coalesce(b.getField("exact"), F.lit(False)) & h.endswith(F.concat(F.lit("."), own))
    return F.coalesce(is_url(url) & F.when(prefix.isNull(), (h == own) | under).otherwise((h == own) & below), F.lit(False))


def own_repository(owner: Column, repo: Column, homepage: Column, fork: Column, b: Column, suffixes: Sequence[str] = PUBLIC_SUFFIXES) -> Column:
    """Whether a repository that a site links to is the site's: its homepage lies in the boundary, or its owner or name is the domain's label.

    Letter case, hyphens, underscores and dots do not count in names; a homepage without a scheme is https. A fork never is, null is no fork.
    """
    squash = lambda c: F.regexp_replace(F.lower(c), "[-_.]", "")
    page = F.trim(F.coalesce(homepage, F.lit("")))
    page = F.when(page.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), page).otherwise(F.concat(F.lit("https://"), page))
    domain = registrable(F.lower(b.getField("host")), suffixes)
    label = F.when(domain.contains(".") & ~domain.rlike(r"^[0-9.]+$"), squash(F.substring_index(domain, ".", 1)))
    return ~F.coalesce(fork, F.lit(False)) & (within(page, b) | F.coalesce((squash(owner) == label) | (squash(repo) == label), F.lit(False)))


def source_type(url: Column) -> Column:
    h, p = F.regexp_replace(host(url), r"^www\.", ""), F.lower(F.regexp_replace(path(url), "/+$", ""))
    parts = F.size(F.filter(F.split(p, "/"), lambda x: x != ""))
    return (
        F.when(~is_url(url), "other")
        .when(h.rlike(CODE_HOSTS) | (h == "raw.githubusercontent.com"), F.when((parts <= 2) | p.contains("readme"), "repository-readme").otherwise("repository-file"))
        .when(p.rlike(POLICY_PATH), "policy-page")
        .when(h.rlike(r"^docs?\.") | p.rlike(DOCS_PATH), "docs")
        .when((p == "") | p.rlike(r"^/(index\.html?)?$"), "homepage")
        .otherwise("other")
    )


def url_key(url: Column) -> Column:
    u = F.regexp_replace(F.lower(F.trim(url)), r"^[a-z][a-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(u, r"^www\.", ""), "/+$", "")


def product_name(title: Column) -> Column:
    rest = F.regexp_replace(title, r"(?i)^\s*show hn:\s*", "")
    return F.trim(F.regexp_extract(rest, r"^(.*?)(?: – | - |:|$)", 1))


def title_forms(title: Column, least: int = 6) -> Column:
    bare = F.regexp_replace(title, r"(?i)^\s*show hn\s*:\s*", "")
    forms = F.array(title, bare, F.regexp_extract(bare, r"^(.*?)(?:\s[–—-]\s|:\s|$)", 1))
    return F.filter(F.transform(forms, lambda t: F.lower(F.trim(t))), lambda t: F.length(t) >= least)


def repository_links(text: Column) -> Column:
    """Distinct owner/repo of links to the code host, first seen first, without reserved owners."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"github\.com/([A-Za-z0-9-]+/[A-Za-z0-9_.-]+)"), 1)
    clean = F.transform(found, lambda x: F.lower(F.regexp_replace(F.regexp_replace(x, r"\.git$", ""), r"[.]+$", "")))
    return F.array_distinct(F.filter(clean, lambda x: ~x.endswith("/") & ~F.substring_index(x, "/", 1).isin(RESERVED_OWNERS)))


def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: x if x is None else unicodedata.normalize("NFC", x))


def nfc(text: Column | str) -> Column:
    """Letters and marks composed where Unicode has a composed form (NFC).

    Spark has no expression for it. Text whose characters are all below the first combining mark is its own form and is not handed to Python.
    """
    text = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.pandas_udf(_composed, "string")(F.when(text.rlike(r"[^\x{0000}-\x{02FF}]"), text)), text)


def normalise(text: Column) -> Column:
    """Lower case, one blank for each run of what is no letter or digit."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]+", " "), r"\s+", " "))


def normalise_quote(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[ \t\n\r]+", " "))


def injected(text: Column) -> Column:
    """Any of the patterns that address a reading model."""
    t, out = F.coalesce(text, F.lit("")), F.lit(False)
    for p in INJECTION:
        out = out | t.rlike(ascii_edges(p))
    return out


def boilerplate_quote(text: Column) -> Column:
    return (F.length(F.trim(text)) < 12) | text.rlike(ascii_edges(CALL_TO_ACTION))


def irrelevant_footer(text: Column) -> Column:
    return F.length(text).between(20, 240) & text.rlike(FOOTER_HAS) & ~text.rlike(ascii_edges(FOOTER_HAS_NOT))


def lint_text(text: Column) -> Column:
    """A statement without code spans and cited titles, which are no wording."""
    return F.regexp_replace(F.regexp_replace(text, "`[^`]*`", ""), r"(?is)<code>.*?</code>|<cite>.*?</cite>", "")


def redact_emails(text: Column) -> Column:
    return F.regexp_replace(text, EMAIL, "[email redacted]")


def email_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(EMAIL)).cast("long")


def scrub(text: Column, secrets: list[str]) -> Column:
    """Known secret values, and what looks like a bearer token or key, taken out of text to be logged."""
    for s in sorted(secrets, key=len, reverse=True):
        text = F.replace(text, F.lit(s), F.lit("[secret]")) if s else text
    return F.regexp_replace(text, ascii_edges(r"(?i)\b(?:bearer\s+[a-z0-9._~+/=-]{8,}|tvly-[a-z0-9-]{8,})"), "[secret]")


def is_quota_response(status: Column, body: Column) -> Column:
    return F.when(status.isin(402, 403, 429), True).when(status.between(200, 299), False).otherwise(F.coalesce(F.lower(body).rlike(ascii_edges(r"\b(credit|balance|quota)\b")), F.lit(False)))


def without_thinking(raw: Column) -> Column:
    """A reply after its leading block of thoughts; a block that never closes leaves nothing."""
    return F.when(raw.rlike(r"(?s)^\s*<think>"), F.regexp_extract(raw, r"(?s)^\s*<think>.*?</think>\s*(.*)$", 1)).otherwise(raw)


def json_in(raw: Column) -> Column:
    """The JSON text of a reply: the whole, a fenced block, or what lies between the outermost braces or brackets."""
    whole, fenced = F.trim(raw), F.trim(F.regexp_extract(raw, r"(?s)```(?:json)?\s*(.*?)```", 1))
    braces, brackets = F.regexp_extract(raw, r"(?s)(\{.*\})", 1), F.regexp_extract(raw, r"(?s)(\[.*\])", 1)
    return F.coalesce(*(F.when(F.try_parse_json(c).isNotNull() & (c != ""), c) for c in (whole, fenced, braces, brackets)))


def range_text(values: Column) -> Column:
    """Sorted distinct integers as runs: "0-3,66-75". A run ends where the next value is not one more."""
    v = F.array_sort(F.array_distinct(values))
    before = F.concat(F.array(F.lit(None).cast("bigint")), F.slice(v, 1, F.greatest(F.size(v) - 1, F.lit(0))))
    after = F.concat(F.slice(v, 2, F.size(v)), F.array(F.lit(None).cast("bigint")))
    starts = F.filter(F.arrays_zip(v.alias("x"), before.alias("y")), lambda z: ~F.coalesce(z["x"] == z["y"] + 1, F.lit(False)))
    ends = F.filter(F.arrays_zip(v.alias("x"), after.alias("y")), lambda z: ~F.coalesce(z["x"] == z["y"] - 1, F.lit(False)))
    text = lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat_ws("-", a.cast("string"), b.cast("string")))
    return F.array_join(F.zip_with(starts, ends, lambda a, b: text(a["x"], b["x"])), ",")


# --- what built-in expressions cannot say: vectorised functions ---

_FENCE, _INLINE = re.compile(r"```.*?```", re.S), re.compile(r"`[^`\n]+`")
_DATE = re.compile(r"^\d{4}-\d{2}-\d{2}$")


def redact(text: str | None) -> tuple[str, int, int, int, int]:
    """(text, emails, phones, handles, handles left in code) with placeholders for personal data."""
    text, emails = re.subn(EMAIL, "[email redacted]", text or "")
    phones = 0

    def phone(m: re.Match) -> str:
        nonlocal phones
        digits = sum(c.isdigit() for c in m[0])
        if not 9 <= digits <= 15 or _DATE.match(m[0]):
            return m[0]
        phones += 1
        return "[phone redacted]"

    text = re.sub(PHONE, phone, text, flags=re.A)
    fences = [m.span() for m in _FENCE.finditer(text)]
    code = fences + [m.span() for m in _INLINE.finditer(text) if not any(a <= m.start() < b for a, b in fences)]
    handles = near = 0

    def handle(m: re.Match) -> str:
        nonlocal handles, near
        before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
        if before and re.match(r"[\w.@/-]", before, re.A) or after == "/":
            return m[0]
        if any(a <= m.start() < b for a, b in code):
            near += 1
            return m[0]
        handles += 1
        return "[handle redacted]"

    return re.sub(HANDLE, handle, text), emails, phones, handles, near


def _redact_series(s: pd.Series) -> pd.DataFrame:
    rows = [redact(x) for x in s]
    return pd.DataFrame(rows, columns=["text", "emails", "phones", "handles", "near_miss"])


def redact_udf():
    """Column function: struct(text, emails, phones, handles, near_miss)."""
    return F.pandas_udf(_redact_series, "text string, emails long, phones long, handles long, near_miss long")


def split_long(block: str, cap: int = 1500) -> list[str]:
    """Pieces of at most `cap` characters: cut after the last sentence end in reach, else the last blank, else hard."""
    out = []
    while len(block) > cap:
        window = block[: cap + 1]
        ends = [m.start() + 1 for m in re.finditer(r"[.?!](?=\s)", window) if m.start() + 1 <= cap]
        blanks = [m.start() for m in re.finditer(r"\s", window) if 0 < m.start() <= cap]
        at = ends[-1] if ends else blanks[-1] if blanks else cap
        out.append(block[:at].rstrip())
        block = block[at:].lstrip()
    return [x for x in [*out, block] if x]


def split_long_udf(cap: int = 1500):
    """Arrays of blocks with the long ones split; few rows become Python values at a time."""

    def run(blocks: pa.Array) -> pa.Array:
        few = (blocks.slice(at, 64).to_pylist() for at in range(0, len(blocks), 64))
        parts = [pa.array([[p for x in xs or () for p in split_long(x, cap)] for xs in rows], pa.list_(pa.string())) for rows in few]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")


def spans_of(text: Column, cap: int = 1500) -> Column:
    """Spans of a text: blank-line blocks, a heading line alone, blanks collapsed, none under two characters, no repeat in a row, capped."""
    blocks = F.split(F.coalesce(text, F.lit("")), r"\r?\n[ \t]*\r?\n\s*")
    # A heading becomes its own block: mark it with a control character on either side and split there.
    cut = F.flatten(F.transform(blocks, lambda b: F.split(F.regexp_replace(b, r"(?m)^(#{1,6}\s[^\r\n]*)$", "\u0001$1\u0001"), "\u0001")))
    clean = F.filter(F.transform(cut, lambda b: F.regexp_replace(F.regexp_replace(b, r"[ \t]+", " "), r"^\s+|\s+$", "")), lambda b: F.length(b) >= 2)
    return split_long_udf(cap)(collapse_repeats(clean))


def collapse_repeats(items: Column) -> Column:
    """An array without elements that equal the one before them."""
    before = F.concat(F.array(F.lit(None).cast("string")), F.slice(items, 1, F.greatest(F.size(items) - 1, F.lit(0))))
    return F.transform(F.filter(F.arrays_zip(items.alias("x"), before.alias("y")), lambda z: ~z["x"].eqNullSafe(z["y"])), lambda z: z["x"])
