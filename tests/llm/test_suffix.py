import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import suffix

from .rows import HARD, documents, empty, hard


def texts():
    rng = random.Random(2)
    yield from (b"", b"a", b"aa", b"banana", b"mississippi", b"ab" * 40, b"a" * 70, bytes(range(256)), b"\xff\xff\x00")
    for k in (1, 2, 3, 200):
        for n in (2, 7, 50, 400):
            yield bytes(rng.randrange(k + 1) for _ in range(n))
    word = [bytes(rng.choice(b"abcd ") for _ in range(rng.randrange(1, 90))) for _ in range(12)]
    for _ in range(6):
        yield b"\xff".join(rng.choice(word) for _ in range(40)) + b"\xff"


def test_suffix_array_and_plcp_equal_sorting():
    for t in texts():
        a = np.frombuffer(t, np.uint8)
        sa = suffix.suffix_array(a)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        lcp = suffix.permuted_lcp(a, sa)
        for p, i in zip([None, *sa], sa, strict=False):
            want = 0 if p is None else next((k for k in range(len(t)) if t[p + k : p + k + 1] != t[i + k : i + k + 1]), len(t))
            assert lcp[i] == min(want, len(t) - i if p is None else len(t) - max(p, i))


def brute(rows, w=suffix.WINDOW):
    first, out = {}, []
    order = lambda i: suffix.NO_ID if i is None else i
    raw = [(i, (t or "").encode()) for i, t in rows]
    for i, b in raw:
        for p in range(len(b) - w + 1):
            s = b[p : p + w]
            first[s] = min(first.get(s, suffix.NO_ID), order(i))
    for i, b in raw:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - w + 1):
            if first[b[p : p + w]] < order(i):
                gone[p : p + w] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((str(i), len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digests(suffix.repeated_bytes(df)).collect())


def test_equals_brute_force(spark, sf):
    rng = random.Random(4)
    rows = documents(sf)
    rows += [(1000 + i, t[rng.randrange(60) :] + rows[(i * 7) % 200][1][20 : 20 + rng.randrange(40, 120)] + t[::-1][:80]) for i, t in rows[:100]]
    rows += [(-3, "é漢" * 60), (2000, "xé漢" * 40), (2001, "漢" + "é漢" * 30), (2002, "ab" * 300), (2003, "x" + "ab" * 40), (2004, "ba" * 25), (2005, "ab" * 25)]
    rng.shuffle(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)


def test_flushes_and_slices(spark, sf, monkeypatch):
    monkeypatch.setattr(suffix, "_SLICE", 500)
    monkeypatch.setattr(suffix, "_FLUSH", 4000)
    rows = documents(sf)[:60] + [(500 + i, t[30:]) for i, t in documents(sf)[:30]]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_texts_of_one_hash_stay_apart(spark, sf):
    """With the length as first hash many texts share one."""
    rows = documents(sf)[:80] + [(900 + i, t[::-1]) for i, t in documents(sf)[:20]] + [(950 + i, t) for i, t in documents(sf)[:10]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix.digests(suffix.repeated_bytes(df, first_key=F.length("text").cast("long"))).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute(rows)


def test_hard_rows(spark):
    short = [(i, t and t[:2000]) for i, t in HARD]
    df = spark.createDataFrame(short, "doc_id long, text string")
    assert found(df) == brute(short)
    assert found(empty(spark)) == []
    assert len(found(hard(spark))) == len(HARD)
