import re
from collections import Counter

from plumbline.llm import lines, quality

from .rows import HARD, documents, empty, hard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    at = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if at[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def measured(df):
    return sorted(
        ((r.doc_id is None, r.doc_id), (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)) for r in quality.measure(df).collect()
    )


def test_measures_equal_brute_force(spark, sf):
    rows = HARD + documents(sf)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert measured(df) == sorted(((i is None, i), base(t)) for i, t in rows)
    assert measured(hard(spark)) == sorted(((i is None, i), base(t)) for i, t in HARD)


def test_ledger_and_policies(spark, sf):
    df = spark.createDataFrame(documents(sf), "doc_id long, text string")
    ledger = quality.ledger(df).cache()
    assert quality.ledger(empty(spark)).count() == 0
    rows = ledger.collect()
    for r in rows:
        for i, rule in enumerate(quality.RULES):
            env = {k: getattr(r, k) for k in quality.MEASURES}
            assert bool(r.fail_bits >> i & 1) == eval(rule.fails.replace("AND", "and"), {}, env), rule  # noqa: S307
    for policy, mask in quality.POLICIES.items():
        kept = {r.doc_id for r in quality.apply_policy(ledger, policy).where("kept").collect()}
        assert kept == {r.doc_id for r in rows if not r.fail_bits & mask}
        for r in quality.ablation(ledger, policy).collect():
            bit = quality.BIT[r.rule]
            assert r.n_failed == sum(bool(x.fail_bits & bit) for x in rows)
            assert r.n_failed_alone == sum(x.fail_bits & mask == bit for x in rows)
            assert r.n_kept_without - r.n_kept == r.n_failed_alone


def test_filter_keeps_all_columns(spark):
    df = hard(spark)
    kept = quality.filter_documents(df, "base-1")
    assert kept.schema == df.schema
    want = Counter((i, t) for i, t in HARD if base(t)[0] >= 50 and 100 * base(t)[4] <= 50 * base(t)[0])
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want


def without_repeats(rows):
    """Windows of three non-blank trimmed lines; the first of equal ones, by (id, text hash, line), stays."""
    trim = lambda s: s.strip(" \t\n\x0b\x0c\r")
    docs = {}
    for i, text in rows:
        docs[i, text or ""] = (text or "").split("\n")
    first, found = {}, []
    for (i, text), ls in docs.items():
        at = [k for k, s in enumerate(ls) if trim(s)]
        for a, b, c in zip(at, at[1:], at[2:]):
            w = (trim(ls[a]), trim(ls[b]), trim(ls[c]))
            found.append((w, (i, text), a, c))
            first[w] = min(first.get(w, (i, a)), (i, a))
    gone = {k: set() for k in docs}
    for w, key, a, c in found:
        if (key[0], a) > first[w]:
            gone[key] |= set(range(a, c + 1))
    return {k: "\n".join(s for j, s in enumerate(ls) if j not in gone[k]) if gone[k] else k[1] for k, ls in docs.items()}


def test_line_dedup_equals_brute_force(spark, sf):
    rows = [r for r in HARD if r[0] is not None] + [(i + 100, t) for i, t in documents(sf)] + [(9000 + i, t[50:]) for i, t in documents(sf)[:40]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = without_repeats(rows)
    got = Counter((r.doc_id, r.text) for r in lines.dedup_lines(df).collect())
    assert got == Counter((i, want[i, t or ""]) for i, t in rows)


def test_line_dedup_edges(spark):
    out = lines.dedup_lines(hard(spark))
    assert set(out.columns) == {"doc_id", "text", "fp", "words", "lines", "n_chars", "line_dedup"}
    assert out.count() == len(HARD)
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_lexicon(spark):
    rows = [(i, f"plain words of all kinds {'zug, Zug! it\'s\\' if i % 3 == 0 else 'here'} and more") for i in range(60)] + [(None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(60)] + [(None, 1), (61, None)], "doc_id long, toxic int")
    lexicon = quality.fit_lexicon(docs, labels)
    assert lexicon == ["it's\\", "zug"]
    assert quality.fit_lexicon(docs, labels, rows=4) == [] == quality.fit_lexicon(docs, labels.limit(0))
    got = {r.doc_id: r.n_toxic_words for r in quality.measure(docs, lexicon).collect()}
    assert all(got[i] == (3 if i % 3 == 0 else 0) for i in range(60)) and got[None] == 0
