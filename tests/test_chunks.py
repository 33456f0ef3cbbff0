"""Packing and halving of chunks against plain recursion, and words in both Unicode forms."""

import random
from math import ceil

import pytest

from plumbline.operators import evidence as ev
from plumbline.plans import catalogue
from plumbline.registry import table


def plain_chunks(spans, cap, fits):
    """[(page, span)] by chunk, of (page, span, size) in order."""
    chunks, now, used = [], [], 0
    pages = {}
    for s in spans:
        pages.setdefault(s[0], []).append(s)
    for page in pages.values():
        if used + sum(s[2] for s in page) > cap and now:
            chunks, now, used = [*chunks, now], [], 0
        for s in page:
            if used + s[2] > cap and now:
                chunks, now, used = [*chunks, now], [], 0
            now, used = [*now, s], used + s[2]
    chunks = [*chunks, now] if now else chunks

    def divide(chunk):
        size = sum(s[2] for s in chunk)
        if size <= cap and fits(size, len(chunk)):
            return [chunk]
        if len(chunk) == 1:
            raise ValueError("does not fit")
        half = len(chunk) // 2
        return divide(chunk[:half]) + divide(chunk[half:])

    return [[s[:2] for s in part] for chunk in chunks for part in divide(chunk)]


def by_chunk(rows):
    out = {}
    for r in rows:
        out.setdefault(r.project, {}).setdefault(r.chunk, []).append((r.page_ix, r.span_ix))
    return {p: [sorted(x) for _, x in sorted(c.items())] for p, c in out.items()}


def test_whole_documents(spark, sf):
    got = catalogue.QUERIES["chunk_halving"](spark, sf).collect()
    spans = ev.page_spans(table(spark, sf, "documents").selectExpr("doc_id AS project", "0 AS page_ix", "text"), 1500).selectExpr("project", "span_ix", "length(text) AS size").collect()
    docs = {}
    for r in sorted(spans, key=lambda r: (r.project, r.span_ix)):
        docs.setdefault(r.project, []).append((r.span_ix // 3, r.span_ix, r.size))
    want = {p: plain_chunks(x, 4000, lambda size, n: ceil(size / 4) + 25 * n + 100 <= 700) for p, x in docs.items()}
    assert by_chunk(got) == want and len(got) == len(spans)
    assert {r.project: sorted({x.chunk for x in got if x.project == r.project}) for r in got[:5]} == {r.project: list(range(len(want[r.project]))) for r in got[:5]}


def test_random_spans(spark):
    rng, docs = random.Random(4), {}
    for p in range(30):
        docs[p] = [(i // rng.randint(1, 5), i, rng.randint(0, 60)) for i in range(rng.randint(1, 70))]
        docs[p].sort()
    rows = [(p, a, b, "x" * size) for p, x in docs.items() for a, b, size in x]
    df = spark.createDataFrame(rows, "project int, page_ix int, span_ix int, text string")
    packed = ev.pack(df, 400).join(df, ["project", "page_ix", "span_ix"])
    got = by_chunk(ev.halve(packed, lambda chars, n: chars + 7 * n <= 120, 400).collect())
    assert got == {p: [sorted(c) for c in plain_chunks(x, 400, lambda size, n: size + 7 * n <= 120)] for p, x in docs.items()}


def test_hard_rows(spark):
    of = lambda rows: spark.createDataFrame(rows, "project string, page_ix int, span_ix int, chunk long, text string")
    fits = lambda chars, n: chars <= 5
    assert ev.halve(of([]), fits).collect() == []
    got = ev.halve(of([("a", 0, 0, 0, None), ("a", 0, 1, 0, "")]), fits).collect()
    assert [(r.span_ix, r.chunk) for r in got] == [(0, 0), (1, 0)]
    with pytest.raises(Exception, match="does not fit"):
        ev.halve(of([("a", 0, 0, 0, "123456")]), fits).collect()


def test_composed_and_decomposed_words_are_one(spark):
    rows = [("a", 1, "Cafe\u0301 a b c d e"), ("b", 2, "caf\u00e9 a b c d e"), ("c", 3, None), ("d", 4, "")]
    df = spark.createDataFrame(rows, "project string, id int, text string")
    assert {r.word: r.df for r in ev.document_frequency(df).collect()}["caf\u00e9"] == 2
    assert [(r.gram, r.owners) for r in ev.gram_owners(df).collect()] == [("caf\u00e9 a b c d e", 2)]
    masked = {r.id: r.masked for r in ev.mask_rare_words(df, ev.document_frequency(df), 2).collect()}
    assert masked[1] == masked[2] and "caf\u00e9" in masked[1]
    terms = spark.createDataFrame([], "project string, term string, placeholder string")
    full = {r.id: r.masked for r in ev.mask_quotes(df, terms, 2).collect()}
    assert full[1].lower() == full[2] == "caf\u00e9 a b c d e"
