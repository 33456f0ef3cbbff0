import hashlib
import random
import re

import xxhash

from plumbline.llm import fingerprints, queries

from .rows import HARD, documents, empty, hard

MASK = 2**64 - 1


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    ones, total = [0] * 64, 0
    for i, a in enumerate(words):
        b = words[i + 1] if i + 1 < len(words) else None
        h = xxhash.xxh64_intdigest(a.encode(), 42)
        h = h if b is None else xxhash.xxh64_intdigest(b.encode(), h)
        w = min(32, len(a) + len(b or ""))
        total += w
        ones = [n + w * (h >> i & 1) for i, n in enumerate(ones)]
    return sum(1 << i for i, n in enumerate(ones) if 2 * n > total)


def brute(rows):
    """(doc_id, n_chars, edited_sha256, fp, edited_fp, near_edited, near_next)."""
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(r[1].encode()).digest()), reverse=True)
    out = []
    for at, (i, t) in enumerate(order):
        after = order[(at + 1) % len(order)][1]
        half = len(t) // 2
        e = t[: len(t) - half] + after[:half]
        a, b, c = brute_fingerprint(t), brute_fingerprint(e), brute_fingerprint(after)
        like = lambda x, y: 1 - bin(x ^ y).count("1") / 64
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), a, b, like(a, b), like(a, c)))
    return sorted(out, key=str)


def got(df, n_ranges=None):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, r.fp & MASK, r.edited_fp & MASK, r.near_edited, r.near_next) for r in fingerprints.compare(df, n_ranges).collect()), key=str)


def test_equals_brute_force(spark, sf):
    rows = documents(sf)
    df = spark.read.parquet(f"{sf}/documents.parquet")
    for n in (None, 1, 37):
        assert got(df, n) == brute(rows)


def test_hard_rows(spark):
    for n in (1, 3, 50):
        assert got(hard(spark), n) == brute(HARD)
    assert got(empty(spark)) == []
    assert got(spark.createDataFrame([(1, "one only")], "doc_id long, text string")) == brute([(1, "one only")])


def test_a_third_of_the_rows_is_one_row(spark):
    rows = [(7, "the same text")] * 60 + [(None, f"no id {i}") for i in range(60)] + [(i, f"text {i}") for i in range(60)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert got(df, 12) == brute(rows)
    sizes = [r["count"] for r in fingerprints.with_next(df.cache(), 12).groupBy("range").count().collect()]
    assert len(sizes) > 8 and max(sizes) < 60


def test_ids_of_other_types(spark):
    df = spark.createDataFrame([("b", "x y z"), ("a", "p q r"), (None, "s")], "doc_id string, text string")
    assert {r.doc_id for r in fingerprints.compare(df, 2).collect()} == {"a", "b", None}


def brute_near(fps, radius):
    return {a: sum(n for b, n in fps.items() if bin(a ^ b).count("1") <= radius) for a in fps}


def test_search_finds_all_within_the_radius(spark):
    rng = random.Random(2)
    fps = {}
    for _ in range(40):
        centre = rng.getrandbits(64)
        for _ in range(20):
            fps[centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5)))] = rng.randint(1, 4)
    df = spark.createDataFrame([(fingerprints._signed(f), n, i % 3 == 0) for i, (f, n) in enumerate(fps.items())], "fp long, n long, asked boolean")
    asked = {r.fp & MASK for r in df.where("asked").collect()}
    for radius, blocks in ((3, 6), (0, 4), (2, 5)):
        found = {r.fp & MASK: r.n_near for r in fingerprints.search(df, radius, blocks).collect()}
        assert found == {a: n for a, n in brute_near(fps, radius).items() if a in asked}


def test_query_asks_for_hundreds(spark, sf):
    rows = queries.op13_fingerprints(spark, sf).collect()
    fps = {}
    for r in rows:
        fps[int(r.fingerprint, 16)] = fps.get(int(r.fingerprint, 16), 0) + 1
    near = brute_near(fps, 3)
    assert all(r.n_near == (near[int(r.fingerprint, 16)] if r.doc_id % 100 == 0 else None) for r in rows)
    assert len(rows) == len(documents(sf))


def test_no_python_in_the_plan(spark, sf):
    plan = fingerprints.compare(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
