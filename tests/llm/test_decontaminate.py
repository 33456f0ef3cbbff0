import random
import re

import numpy as np

from plumbline.llm import decontaminate as dc

from .rows import HARD, documents, empty, hard


def norm(t):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    return re.sub(r"[\x20\x09-\x0D]+", " ", t).strip(" ")


def within(item, text):
    """Fewest edits of the item against any substring of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def mutate(rng, s, n):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s))
        s[k : k + 1] = rng.choice([["q"], [], [s[k], "z"]])
    return "".join(s)


def test_equals_brute_force(spark, sf):
    rng = random.Random(3)
    texts = [t for _, t in documents(sf) if 50 < len(t) < 900][:24]
    items = [(k, texts[k][5 : 5 + rng.randrange(40, 160)]) for k in range(8)] + [(50, "tiny"), (51, None), (52, ""), (53, texts[0][5:80])]
    items += [(60 + n, texts[n % 8][3 : 3 + n]) for n in range(10, 45, 2)] + [(200 + i, w) for i, w in enumerate(norm(texts[9]).split()[:6])]
    docs = []
    for d, t in enumerate(texts[8:]):
        item = norm(items[d % 8][1])
        edits = rng.choice([0, 1, 3, dc.budget(len(item)), dc.budget(len(item)) + 1, 30])
        docs.append((d, t[:100] + " " + mutate(rng, item, edits).upper() + " \n " + t[100:]))
    docs += [(100 + i, t) for i, t in enumerate(texts[:8])]
    got = {}
    for r in dc.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id int, text string")).collect():
        got[r.doc_id, r.item_id] = min(r.edits, got.get((r.doc_id, r.item_id), 99))
        assert within(norm(dict(items)[r.item_id]), norm(dict(docs)[r.doc_id][r.start : r.end])) <= r.edits
    want = {}
    for d, t in docs:
        for i, x in items:
            x = norm(x)
            if len(x) >= dc.EXACT and (n := within(x, norm(t))) <= dc.budget(len(x)):
                want[d, i] = n
            elif 0 < len(x) < dc.EXACT and f" {x} " in f" {norm(t)} ":
                want[d, i] = 0
    assert got == want and len(want) > 25


def test_short_items(spark):
    docs = spark.createDataFrame([(1, "this is Too\nShort for grams"), (2, "this is too shortish"), (3, "too short"), (4, "xtoo short")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "too short"), (2, "a")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.start, r.end, r.edits) for r in dc.contamination(docs, bench).collect()) == [(1, 1, 8, 17, 0), (3, 1, 0, 9, 0)]


def test_runs_of_one_sign_stay_small():
    """Places times offsets would be 4e9 rows here."""
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    index = dc.Index.build([(1, "-" * 4000), (2, "ab" * 2000)])
    assert {(t, i) for t, i, *_ in dc._scan(index, ["=" * 5000, "-" * 30_000, "x" + "ab" * 9000, "-" * 3600])} == {(1, 0), (2, 1)}
    assert len(list(index.regions([np.full(1_000_000, ord("-"), np.uint32)]))) > 1000
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000


def test_edges(spark, sf):
    bench = spark.createDataFrame([(1, HARD[4][1]), (1, HARD[4][1]), (2, "alpha beta gamma delta alpha beta"), (3, "none of these at all here")], "item_id long, text string")
    got = dc.contamination(hard(spark), bench).collect()
    assert {r.doc_id for r in got if r.item_id == 1} == {5} and {r.doc_id for r in got if r.item_id == 2} == {9, 10, 14}
    assert not [r for r in got if r.item_id == 3]
    assert dc.contamination(empty(spark), bench).count() == 0
    assert dc.contamination(hard(spark), bench.limit(0)).count() == 0
    clean = dc.keep_clean(hard(spark), bench)
    assert clean.columns == hard(spark).columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _ in HARD if i not in (5, 9, 10, 14))


def test_blocks_give_the_same(spark, sf, monkeypatch):
    docs = spark.createDataFrame(documents(sf), "doc_id long, text string")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(map(tuple, dc.contamination(docs, bench).collect()))
    monkeypatch.setattr(dc, "BLOCK_CHARS", 2000)
    assert sorted(map(tuple, dc.contamination(docs, bench).collect())) == whole and whole


def test_ends_and_places_equal_plain_tables():
    rng = random.Random(8)
    for _ in range(60):
        item = [rng.randrange(3) for _ in range(rng.randrange(1, 90))]
        text = [rng.randrange(3) for _ in range(rng.randrange(0, 120))]
        if rng.random() < 0.7:
            text[5:5] = [x for x in item if rng.random() < 0.95]
        e = rng.randrange(0, 12)
        row, want = list(range(len(item) + 1)), []
        for j, b in enumerate(text, 1):
            new = [0]
            for i, a in enumerate(item, 1):
                new.append(min(new[-1] + 1, row[i] + 1, row[i - 1] + (a != b)))
            row = new
            if row[-1] <= e:
                want.append((row[-1], j))
        got = dc._ends(np.array(item, np.uint32), e, np.array(text, np.uint32))
        assert got == want
        some = dc._apart(got, 9, 2)
        assert all(abs(a[1] - b[1]) >= 7 for a in some for b in some if a != b)
        assert all(any(abs(end - k) < 7 for _, k in some) for _, end in got) and min(got, default=None) == min(some, default=None)


def test_long_runs_of_one_sign_end_soon():
    """A million equal signs, with and without flaws, against four thousand of them."""
    import time

    index, began = dc.Index.build([(1, "=" * 4000)]), time.process_time()
    whole = dc._scan(index, ["=" * 1_000_000])
    assert len(whole) == 250 and all(x[4] == 0 and x[3] - x[2] == 4000 for x in whole)
    flawed = dc._scan(index, [("=" * 99 + "-") * 10_000])
    assert len(flawed) >= 240 and all(30 <= x[4] <= 320 for x in flawed)
    print("seconds of both:", time.process_time() - began)
    assert time.process_time() - began < 120
