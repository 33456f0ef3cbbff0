import re
import zlib
from collections import Counter

from plumbline.llm import variants

from .rows import HARD, documents, empty, hard


def brute_words(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


def brute_groups(words):
    form, out = {}, {}
    for w in words:
        best = sorted((-words[v], v) for v in words if near(w, v))
        good = best and -best[0][0] >= 5 * words[w]
        form[w] = best[0][1] if good else None
        out[w] = [len(best), -best[0][0] if good else None]
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, words[w], *out[w])
    return out


def groups(df):
    rows = df.collect()
    assert len({r.word for r in rows}) == len(rows)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}


def test_equals_brute_force(spark, sf):
    rows = documents(sf)
    want = brute_groups(brute_words(rows))
    assert len(want) > 400 and any(f for f, *_ in want.values())
    assert groups(variants.group(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_hard_rows(spark):
    assert groups(variants.group(hard(spark))) == brute_groups(brute_words(HARD))
    assert variants.group(empty(spark)).count() == 0


def test_chains_ties_and_edits_at_every_place(spark):
    # aaaaaa is reached from both ends; chains of forms run over three words; abcdef ties with two words.
    base = "abcdefgh"
    words = {"aaaaaa": 400, "aaaaaaa": 60, "aaaaaaaa": 9, "xaaaaaa": 70, "abcdeg": 50, "abcdeh": 50, "abcdef": 6, "éàçèüß": 30, "éàçèü": 99, "éàçèüßÿ": 5, base: 5}
    for i in range(len(base) + 1):
        words |= {base[:i] + "q" + base[i:]: 25 + i, base[:i] + "z" + base[i + 1 :]: 24, base[:i] + base[i + 1 :]: 31}
    text = " ".join(f"{w} " * n for w, n in words.items())
    rows = [(0, text)]
    want = brute_groups(brute_words(rows))
    assert want[base][3] > 3 * len(base)
    assert groups(variants.group(spark.createDataFrame(rows, "doc_id long, text string"))) == want


def test_crowded_halves_are_split(spark):
    """Thousands of words share one half; blocks of ten must find the same."""
    words = {f"prefix{a}{b}": 5 + (ord(a) * ord(b)) % 90 for a in "abcdefghijkl" for b in "abcdefghijkl"} | {"prefix": 9, "prefixa": 700}
    want = {w: r for w, r in brute_groups(words).items() if r[3]}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r.word: (r.n_near, r.best_n >= 5 * words[r.word] and r.best or None) for r in variants.near_words(df, block=10).collect()}
    assert got == {w: (r[3], r[0]) for w, r in want.items()}


def test_automaton_is_minimal_and_numbers_words():
    strings = sorted(a + b for a in ("", "re", "un", "pre") for b in ("do", "doing", "done", "make", "making"))
    a = variants.Automaton(strings)
    assert [a.walk(a.root, 0, s)[1] for s in strings] == list(range(len(strings)))
    # Right languages of states are all different: no two states could be merged.
    assert len({(f, tuple(sorted((c, t) for c, (t, _) in e.items()))) for f, e in zip(a.final, a.edges, strict=True)}) == len(a.edges) < 30
    assert a.walk(a.root, 0, "redux") is None
    assert set(a.one_error(a.root, 0, "undo").values()) == {"redo"} - {"redo"} | {s for s in strings if near(s, "undo")}
