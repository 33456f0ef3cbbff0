"""Hand-computed values and properties of operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import constants
from plumbline.functions import text as tx
from plumbline.functions.numbers import wilson
from plumbline.operators import evidence as ev
from plumbline.operators import jobs as jb
from plumbline.operators import release as rl
from plumbline.operators import sampling as sm
from plumbline.operators import states as st
from plumbline.operators import stats as ss


def pairs(spark, tt, tf, ft, ff):
    rows = [(True, True)] * tt + [(True, False)] * tf + [(False, True)] * ft + [(False, False)] * ff
    return spark.createDataFrame(rows, "a boolean, b boolean")


def test_binary_agreement(spark):
    r = ss.binary_agreement(pairs(spark, 9, 2, 2, 7)).first()
    assert (r.n, r.pa) == (20, 0.8) and r.ac1 == pytest.approx(0.6040, abs=5e-5)
    r = ss.binary_agreement(pairs(spark, 0, 0, 0, 10)).first()
    assert (r.pa, r.ac1, r.kappa, r.precision, r.recall) == (1, 1, None, None, None)


def test_four_states(spark):
    names = ["p", "c", "f", "u"]
    rows = [("p", "p"), ("c", "c"), ("f", "f"), ("u", "u"), ("p", "c"), ("f", "u")]
    r = ss.four_state_agreement(spark.createDataFrame(rows, "a string, b string"), names).first()
    assert r.pa == pytest.approx(4 / 6)


def test_wilson(spark):
    low, high = wilson(F.col("x"), F.col("n"))
    r = spark.createDataFrame([(0, 50), (7, 10), (0, 0)], "x long, n long").select(low.alias("l"), high.alias("h")).collect()
    assert r[0].l == 0 and r[0].h == pytest.approx(0.0713, abs=1e-4)
    assert (r[2].l, r[2].h) == (0, 0)
    p, n, z = 0.7, 10, 1.96
    assert r[1].l == pytest.approx((p + z * z / 20 - z * (p * (1 - p) / n + z * z / 400) ** 0.5) / (1 + z * z / n))


def test_binomial_and_holm(spark):
    r = {(x.n, x.k): x for x in ss.binomial_tails(spark.createDataFrame([(10, 8), (10, 2), (10, 0), (10, 11), (300, 150), (300, 149)], "n long, k long")).collect()}
    assert r[10, 8].upper == pytest.approx(0.0546875) == r[10, 2].lower
    assert r[10, 0].upper == 1 and r[10, 11].upper == 0
    assert r[300, 150].upper + r[300, 149].lower == pytest.approx(1)
    holm = lambda *p: [x.p_holm for x in ss.holm(spark.createDataFrame([(str(i), v) for i, v in enumerate(p)], "id string, p double")).orderBy("id").collect()]
    assert holm(0.01, 0.04) == [0.02, 0.04]
    assert holm(0.03, 0.04) == [0.06, 0.06]


def test_recall_bounds(spark):
    f = lambda c, n, r, side: spark.range(1).select(ss.adverse_counts(F.lit(c), F.lit(n), F.lit(r), side)).first()[0]
    assert f(170, 300, 0.894, "fewer") == 151
    assert f(100, 300, 0.894, "more") == 112
    assert f(290, 300, 0.5, "more") == 300


def test_permutations(spark):
    y = [0] * 40 + [1] * 40
    t, p = ss.permutation_p(y, np.array([[float(g)] for g in y]), "s", 200)
    assert t == pytest.approx(80) and p == 1 / 201
    t, p = ss.permutation_p(y, np.ones((80, 1)), "s", 50)
    assert (t, p) == (0, 1)


def test_bootstrap_matches_row_replication(spark):
    rng = random.Random(1)
    rows = [(f"c{i // 4}", rng.random() < 0.6, rng.random() < 0.5) for i in range(48)]
    got = {r.metric: (r.low, r.high) for r in ss.bootstrap_ci(spark.createDataFrame(rows, "cluster string, a boolean, b boolean"), "s", 40).collect()}
    import hashlib

    names = sorted({r[0] for r in rows})
    values, i = [], 0
    for _ in range(40):
        picked = []
        for _ in names:
            u = int(hashlib.sha256(f"s:bootstrap:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
            picked += [r for r in rows if r[0] == names[int(u * len(names))]]
            i += 1
        values.append(sum(a == b for _, a, b in picked) / len(picked))
    values.sort()
    assert got["pa"] == (pytest.approx(values[int(0.025 * 39)]), pytest.approx(values[-(-975 * 39 // 1000)]))


def test_merge_small(spark):
    def merged(rows, floor=10):
        return sorted((r.family, r.reason, r.n) for r in sm.merge_small(spark.createDataFrame(rows, "family string, reason string, n long"), floor).collect())

    assert merged([("s", "a", 40), ("s", "b", 12), ("s", "c", 3)]) == [("s", "a", 40), ("s", "b", 15)]
    assert merged([("s", "a", 40), ("s", "b", 6), ("s", "c", 7)]) == [("s", "a", 40), ("s", "other", 13)]
    assert merged([("s", "b", 12), ("s", "a", 12), ("s", "c", 3)]) == [("s", "a", 15), ("s", "b", 12)]
    assert merged([("s", "a", 2), ("s", "b", 3)]) == [("s", "other", 5)]
    assert merged([("s", "a", 20), ("s", "other", 4), ("t", "x", 30)]) == [("s", "a", 24), ("t", "x", 30)]


def literal_walk(frame, seed, target):
    import hashlib

    keys, out = set(), {}
    for q in (1, 2, 3, 4):
        got = 0
        for r in sorted((r for r in frame if r["quarter"] == q), key=lambda r: hashlib.sha256(f"{seed}:{r['id']}".encode()).hexdigest()):
            if got == target:
                break
            if r["key"] is not None and r["key"] in keys:
                out[r["id"]] = "duplicate"
            elif not r["pass1"]:
                out[r["id"]] = "excluded-stage1"
            elif not r["reachable"]:
                out[r["id"]] = "not-collectable-unreachable"
            elif not r["boundary_ok"]:
                out[r["id"]] = "not-collectable-boundary"
            elif r["text_len"] >= 500 and not r["pass2"]:
                out[r["id"]] = "excluded-stage2"
            else:
                out[r["id"]] = "included"
                got += 1
                keys.add(r["key"])
    return out


def test_walk_equals_the_literal_loop(spark):
    for s in range(4):
        rng = random.Random(s)
        frame = [
            {"id": str(i), "key": rng.choice([None, *map(str, range(25))]), "quarter": rng.randrange(0, 5), "pass1": rng.random() < 0.8, "reachable": rng.random() < 0.9,
             "boundary_ok": rng.random() < 0.9, "text_len": rng.randrange(1000), "pass2": rng.random() < 0.7}
            for i in range(120)
        ]
        df = spark.createDataFrame(frame, "id string, key string, quarter int, pass1 boolean, reachable boolean, boundary_ok boolean, text_len long, pass2 boolean")
        got = {r.id: r.outcome for r in sm.screened_walk(df, "w", 5).collect()}
        assert got == literal_walk(frame, "w", 5)


def test_chunk_merge_and_filter(spark):
    rows = [("p", "a", 1, "claimed", ["s1"]), ("p", "a", 2, "pass", ["s2"]), ("p", "a", 3, "pass", ["s3", "s2"]), ("p", "b", 1, "claimed", ["s1"]), ("p", "b", 2, "claimed", ["s3"]), ("p", "c", 1, "unknown", ["x"])]
    df = spark.createDataFrame(rows, "project string, check_id string, chunk long, state string, span_ids array<string>")
    merged = st.merge_chunks(df)
    assert {r.check_id: (r.state, r.span_ids) for r in merged.collect()} == {"a": ("pass", ["s2", "s3"]), "b": ("claimed", ["s1", "s3"]), "c": ("unknown", [])}
    known = spark.createDataFrame([("p", ["s2", "s3"])], "project string, known_ids array<string>")
    once = st.quote_or_unknown(merged, known)
    assert {r.check_id: r.state for r in once.collect()} == {"a": "pass", "b": "unknown", "c": "unknown"}
    assert sorted(map(str, st.quote_or_unknown(once, known).collect())) == sorted(map(str, once.collect()))


def test_spans(spark):
    cases = {"a b\n\nc d": ["a b", "c d"], "one\ntwo": ["one\ntwo"], "intro\n# Head\nbody": ["intro", "# Head", "body"], "x1\n\nx1\n\ny1": ["x1", "y1"], None: []}
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", tx.spans_of(F.col("t")).alias("s"))
    for r in df.collect():
        assert r.s == cases[r.t]
    assert [len(x) for x in tx.split_long("a" * 4000)] == [1500, 1500, 1000]
    assert tx.split_long("One. " + "b" * 8 + " " + "c" * 8, 15) == ["One.", "b" * 8, "c" * 8]


def test_redaction():
    assert tx.redact("mail a.b@x.org or +1 (555) 123-4567 or @some_one")[0] == "mail [email redacted] or [phone redacted] or [handle redacted]"
    t, emails, phones, handles, near = tx.redact("on 2024-01-02 `@inline` ```\n@fenced\n``` @scope/pkg id 12345678901")
    assert (emails, phones, handles, near) == (0, 0, 0, 2) and "@scope/pkg" in t


def test_packing(spark):
    rows = [("p", 1, 1, "x" * 30), ("p", 1, 2, "x" * 30), ("p", 2, 1, "x" * 30), ("p", 3, 1, "x" * 50)]
    got = ev.pack(spark.createDataFrame(rows, "project string, page_ix int, span_ix int, text string"), 100)
    assert [r.chunk for r in got.orderBy("page_ix", "span_ix").collect()] == [0, 0, 0, 1]


def test_masking():
    df = {"shared": 9, "words": 9, "here": 9, "now": 9, "then": 9, "again": 9, "acme": 1}
    masked = ev.mask_text("Acme shared words at www.x.org", "p", [("Acme", "[product]")], df, {}, set())
    assert masked == "[product] shared words at [url]"
    run = "shared words here now then again"
    assert ev.mask_text(run, "p", [], df, {run: 1}, {run}).count("▇▇") == 1
    assert ev.mask_text(run, "p", [], df, {run: 2}, {run}) == run


def test_disclosure_examples():
    tuples = {"x1": (4, 75), "x2": (40, 75), "y1": (30, 75), "y2": (7, 75), "xy": (70, 150)}
    rows = [({"x2": 1, "y1": 1, "xy": -1}, "=", 0)]
    sets = rl.feasible_sets(tuples, {"x1": "primary", "y2": "primary"}, rows)
    assert sets["x1"] == [*range(10), *range(66, 76)] == sets["y2"]
    tuples = {"all": (43, 300), "q1": (3, 75), "q2": (40, 225)}
    rows = [({"q1": 1, "q2": 1, "all": -1}, "=", 0)]
    assert rl.feasible_sets(tuples, {"q1": "primary"}, rows)["q1"] == [3]
    closed = rl.close_release(tuples, rows)
    assert closed == {"q1": "primary", "q2": "complementary"}


def test_feasible_sets_equal_enumeration():
    import itertools

    rng = random.Random(6)
    for _ in range(12):
        tuples = {f"t{i}": (rng.randrange(0, 14), 13 + rng.randrange(3)) for i in range(4)}
        tuples = {t: (min(c, n), n) for t, (c, n) in tuples.items()}
        rows = []
        for _ in range(2):
            terms = {t: rng.choice([-2, -1, 1, 1]) for t in rng.sample(sorted(tuples), 3)}
            value = sum(k * tuples[t][0] for t, k in terms.items())
            rows.append((terms, rng.choice(["=", "<=", ">="]), value))
        hidden = {t: "complementary" for t in list(tuples)[:3]}
        want = {t: set() for t in hidden}
        for values in itertools.product(*(range(tuples[t][1] + 1) for t in hidden)):
            full = {t: c for t, (c, n) in tuples.items()} | dict(zip(hidden, values, strict=True))
            if all({"=": v == r, "<=": v <= r, ">=": v >= r}[s] for terms, s, r in rows for v in [sum(k * full[t] for t, k in terms.items())]):
                for t, v in zip(hidden, values, strict=True):
                    want[t].add(v)
        assert rl.feasible_sets(tuples, hidden, rows) == {t: sorted(v) for t, v in want.items()}


def test_released_rows_alone_carry_numbers(spark):
    df = spark.createDataFrame([("a", 6, 300, True), ("b", 295, 300, True), ("c", 100, 300, True), ("d", 100, 300, False), ("e", 100, 300, None)], "id string, c long, n long, available boolean")
    got = {r.id: r for r in rl.resolve_rows(df).collect()}
    assert [got[k].row_state for k in "abcde"] == ["lt10", "suppressed", "released", "withheld", "absent"]
    assert got["c"].pct == 33 and all(got[k].c is None and got[k].pct is None for k in "abde")


def test_lint(spark):
    rows = [("a", "finding", "3 of 9 publicly evidence a fallback"), ("b", "finding", "3 lack it"), ("cohort1", "definition", "shares are rising"), ("d", "method", "scores fail")]
    got = {(r.id, r.rule) for r in rl.lint_statements(spark.createDataFrame(rows, "id string, kind string, text string")).collect()}
    assert got == {("b", "evaluative-term"), ("b", "missing-publicly-evidence"), ("cohort1", "trend-wording")}


def test_pseudonym(spark):
    import hashlib
    import hmac

    got = spark.createDataFrame([("p1",), ("ü",)], "k string").select("k", rl.pseudonym(F.col("k"), "key").alias("p")).collect()
    for r in got:
        bits = int.from_bytes(hmac.new(b"key", r.k.encode(), hashlib.sha256).digest()[:4], "big") >> 7
        assert r.p == "".join("0123456789ABCDEFGHJKMNPQRSTVWXYZ"[bits >> 5 * (4 - i) & 31] for i in range(5))


def test_rolling_window_is_strict(spark):
    rows = [(1, "2026-01-01 00:00:00"), (2, "2026-01-01 00:00:00"), (3, "2026-01-02 00:00:00"), (4, "2026-01-01 23:59:59")]
    df = spark.createDataFrame(rows, "event_id long, t string").select("event_id", F.lit("k").alias("key"), F.col("t").cast("timestamp").alias("at"))
    assert {r.event_id: r.recent for r in jb.rolling_count(df, ["key"]).collect()} == {1: 0, 2: 0, 3: 1, 4: 2}


def test_constants():
    assert len([c for cs in constants.DECISION_CHECKS.values() for c in cs]) == 24 and list(constants.DECISION_CHECKS)[1] == "rely"
