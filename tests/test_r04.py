"""What the review of round 4 found."""

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

from plumbline.operators import stats as ss
from plumbline.plans import catalogue

from .oracle import rows_of_spark, rows_of_sql
from .test_r03 import with_tables

GATED = ("gate_report", "method_view", "publishable_checks", "published_decisions", "release_input")


def _line_items(sf, **columns):
    li = pq.read_table(f"{sf}/lineitem.parquet")
    for c, values in columns.items():
        li = li.set_column(li.schema.get_field_index(c), c, values(li[c]).cast(li.schema.field(c).type))
    return li


def _one_person_coded(li, check=7):
    """So many rows of a check that misses both thresholds that it counts as coded by a person, their keys' sum odd, so that it is withheld, too."""
    rows = li.filter(pc.equal(li["l_linenumber"], check))
    rest = li.filter(pc.not_equal(li["l_linenumber"], check))
    rows = rows.slice((rows.num_rows - 1) % 4)
    keys = pa.array([1] + [2] * (rows.num_rows - 1), pa.int64())
    return pa.concat_tables([rest, rows.set_column(rows.schema.get_field_index("l_suppkey"), "l_suppkey", keys)])


def test_person_coded_before_withheld(spark):
    """A missed check that a person coded is shown, though it is withheld, too."""
    row = ("c", 100, 50, 0.1, 0.1, True, True, None)
    m = spark.createDataFrame([row], "check_id string, n long, gold_passes long, ac1 double, precision double, withheld boolean, person_coded boolean, revalidated boolean")
    got = ss.gate_ladder(m).first()
    assert (got.status, got.reason) == ("person-coded", "coded by a person")


@pytest.mark.parametrize("name", GATED)
def test_gate_of_person_coded_and_withheld(spark, sf, tmp_path, name):
    """Over line items of which a check is both; each query equals its SQL, which names it person-coded."""
    folder = with_tables(sf, tmp_path / "sf", lineitem=_one_person_coded(pq.read_table(f"{sf}/lineitem.parquet")))
    assert "7 |" in str(rows_of_sql(catalogue.ORACLES["gate_report"], folder)) and "person-coded" in str(rows_of_sql(catalogue.ORACLES["gate_report"], folder))
    assert rows_of_spark(catalogue.QUERIES[name](spark, folder)) == rows_of_sql(catalogue.ORACLES[name], folder)


@pytest.mark.parametrize("name", ["gate_report", "method_view"])
def test_gate_of_odd_line_numbers(spark, sf, tmp_path, name):
    """line numbers beyond the seven checks are in no figure, and null ones are a row of their own."""
    odd = lambda c: pa.array([None if i % 97 == 0 else x + 7 * (i % 3 == 0) for i, x in enumerate(c.to_pylist())], pa.int32())
    folder = with_tables(sf, tmp_path / "sf", lineitem=_line_items(sf, l_linenumber=odd))
    assert rows_of_spark(catalogue.QUERIES[name](spark, folder)) == rows_of_sql(catalogue.ORACLES[name], folder)


def test_runs_and_words_do_not_pass_through_the_driver(spark, sf):
    """all distinct runs of words were broadcast, by an estimate that takes them for few."""
    plan = catalogue.QUERIES["mask_quotes"](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    assert not [x for x in plan if "BroadcastHashJoin" in x and any(f"[{c}#" in x for c in ("gram", "word", "id"))]
    assert sum("SortMergeJoin" in x for x in plan) >= 4


def test_binomial_terms_come_from_their_neighbours(spark):
    """each term was a sum of as many logs as its number, so the work grew with the square of n; the tails are those of whole numbers."""
    from fractions import Fraction
    from math import comb, exp, lgamma, log

    def tail(n, k):
        return float(Fraction(sum(comb(n, i) for i in range(max(k, 0), n + 1)), 2**n))

    rows = [(n, k) for n in (0, 1, 2, 3, 10, 199, 200, 601) for k in {-1, 0, 1, n // 3, n // 2, n // 2 + 1, n - 1, n, n + 1}]
    df = spark.createDataFrame([*rows, (300_000, 150_400)], "n long, k long")
    found = ss.binomial_tails(df)
    assert "transform(" not in found._jdf.queryExecution().optimizedPlan().toString()  # no fold within a fold
    got = {(r.n, r.k): (r.upper, r.lower) for r in found.collect()}
    for n, k in rows:
        assert got[n, k] == (pytest.approx(tail(n, k), abs=1e-13), pytest.approx(1 - tail(n, k + 1), abs=1e-13)), (n, k)
    one = exp(lgamma(300_001) - lgamma(150_401) - lgamma(149_601) - 300_000 * log(2))
    assert sum(got[300_000, 150_400]) - 1 == pytest.approx(one, rel=1e-5)


def test_shuffles_share_uniforms_and_swap_many_at_once(monkeypatch):
    """each family made the same uniforms again, and places were swapped one by one."""
    import hashlib
    from types import SimpleNamespace

    import numpy as np

    made = []
    monkeypatch.setattr(ss, "_UNIFORMS", 64)
    monkeypatch.setattr(ss, "hashlib", SimpleNamespace(sha256=lambda x: made.append(x) or hashlib.sha256(x)))
    sizes, orders, seen = [1, 2, 5000, 5003, 5010], {}, 0
    for n in sizes:
        orders[n] = np.arange(n, dtype=np.int32)
    plain = {n: list(range(n)) for n in sizes}
    for n, draw, picks in ss._shuffles(sizes, b"s:", 3, 6):
        for at, j in enumerate(range(n - 1, 0, -1)):
            k = int(int(hashlib.sha256(b"s:%d" % (draw * (n - 1) + at)).hexdigest()[:13], 16) / (1 << 52) * (j + 1))
            assert k == picks[at]
            plain[n][j], plain[n][k] = plain[n][k], plain[n][j]
        ss._swap(picks, [orders[n]])
        assert orders[n].tolist() == plain[n]
        seen += 1
    assert seen == 3 * len(sizes) and len(made) == len(set(made)) < 3 * 5010 + 5 * 64 + 100


def test_quality_rules_find_characters_and_replace_no_text(spark):
    """all other characters of a text were replaced, which takes longer than finding the few that count."""
    from plumbline.llm import quality

    text = "Aa#b  9\n<É|x&> %$*Z0퟿ é"
    df = spark.createDataFrame([(1, text), (2, ""), (3, None), (4, "abc é\n")], "doc_id long, text string")
    found = quality.measure(df)
    assert "regexp_replace(text#" not in found._jdf.queryExecution().analyzed().toString()
    got = {r.doc_id: (r.n_symbols, r.n_capitals, r.n_digits) for r in found.collect()}
    assert got == {1: (8, 2, 2), 2: (0, 0, 0), 3: (0, 0, 0), 4: (0, 0, 0)}
