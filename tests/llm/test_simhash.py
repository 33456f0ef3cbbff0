import re

import xxhash

from plumbline.llm import simhash

from .rows import HARD, documents, empty, hard


def brute_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items, distance=2):
    """{index: smallest id} by comparing all pairs."""
    root = list(range(len(items)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(items)):
        for j in range(i):
            if bin(items[i][1] ^ items[j][1]).count("1") <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(items):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [least.get(find(i)) for i in range(len(items))]


def check(spark, rows, df):
    items = [(i, brute_fingerprint(t)) for i, t in rows]
    want = sorted((str(i), f, c) for (i, f), c in zip(items, brute_components(items), strict=True))
    got = sorted((str(r.doc_id), r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(df).collect())
    assert got == want


def test_equals_brute_force(spark, sf):
    rows = documents(sf)
    near = [(5000 + i, t.replace(" ", "  ", 3) + " tail") for i, t in rows[:80]]
    rows = rows + near
    check(spark, rows, spark.createDataFrame(rows, "doc_id long, text string"))


def test_hard_rows(spark):
    check(spark, HARD, hard(spark))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def fps(spark, values):
    return spark.createDataFrame([(simhash._signed(v),) for v in values], "fp long")


def test_links_connect_what_brute_force_connects(spark):
    import random

    rng = random.Random(1)
    values = set()
    for _ in range(40):
        c = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            values.add(c)
            for _ in range(rng.randrange(1, 4)):
                c ^= 1 << rng.randrange(64)
    values |= {1 << i for i in range(64)} | {0}
    values = sorted(values)
    want = brute_components(list(enumerate(values)))
    for cap in (2, 64, 10**6):
        found = simhash.connected_components(simhash.links(fps(spark, values), max_block=cap))
        root = {r.id & (2**64 - 1): r.root for r in found.collect()}
        group = {}
        for v, w in zip(values, want, strict=True):
            key = root.get(v, simhash._signed(v))
            assert group.setdefault(w, key) == key
        assert len(set(group.values())) == len(group)


def test_keep_one(spark):
    kept = simhash.keep_one(hard(spark))
    assert kept.columns == hard(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert len(ids) == len(set(ids)) and 5 in ids and 1 in ids and 2 not in ids and 14 not in ids
