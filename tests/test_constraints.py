"""Folding and search of release models against enumeration of all values."""

import itertools
import random

import pytest

from plumbline.operators import constraints
from plumbline.operators.release import _start_ranges

HOLDS = {"=": lambda a, b: a == b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b}


def enumerated(ranges, rows):
    values = [[v for a, b in r for v in range(a, b + 1)] for r in ranges]
    found = [set() for _ in ranges]
    for x in itertools.product(*values):
        if all(HOLDS[s](sum(k * x[i] for i, k in terms), rhs) for terms, s, rhs in rows):
            for i, v in enumerate(x):
                found[i].add(v)
    return found


def test_search_equals_enumeration():
    rng = random.Random(7)
    solvable = 0
    for _ in range(250):
        n = rng.randint(1, 4)
        ranges = [[(a := rng.randint(0, 2), b := a + rng.randint(0, 3))] + ([(b + 2 + rng.randint(0, 3), b + 8)] if rng.random() < 0.5 else []) for _ in range(n)]
        truth = [rng.choice([v for a, b in r for v in range(a, b + 1)]) for r in ranges]
        rows = []
        for _ in range(rng.randint(0, 5)):
            terms = [(i, rng.choice([-3, -2, -1, 1, 1, 2])) for i in rng.sample(range(n), rng.randint(1, n))]
            sense, value = rng.choice(["=", "<=", ">="]), sum(k * truth[i] for i, k in terms)
            slack = rng.choice([0, 0, 1, -1])
            rows.append((terms, sense, value + {"=": slack if rng.random() < 0.1 else 0, "<=": abs(slack), ">=": -abs(slack)}[sense]))
        want = enumerated(ranges, rows)
        solvable += bool(want[0])
        assert constraints.Component(ranges, rows).feasible() == want, (ranges, rows)
    assert solvable > 200


def model(spark, tuples, rows, requires=()):
    t = spark.createDataFrame(tuples, "tuple_id string, n long, c long, suppressed boolean")
    r = spark.createDataFrame([(i, x, k, s, b) for i, terms, s, b in rows for x, k in terms], "row_id string, tuple_id string, coef int, sense string, rhs long")
    return t, r, spark.createDataFrame(list(requires), "row_id string, tuple_id string")


TUPLES = [("all", 40, 30, False), ("a", 20, 16, True), ("b", 20, 14, True), ("d", 20, 5, True), ("lone", 30, 3, True), ("e", 40, 12, False)]
ROWS = [("s", [("a", 1), ("b", 1), ("all", -1)], "=", 0), ("le", [("d", 1), ("b", -1)], "<=", 0), ("twice", [("a", 1), ("a", -1), ("e", 1)], "<=", 40), ("known", [("all", 1), ("e", -1)], ">=", 0)]


def test_fold(spark):
    t, r, q = model(spark, TUPLES, ROWS, [("le", "all")])
    got = {(x.row_id, x.tuple_id, x.coef, x.sense, x.rhs) for x in constraints.fold(r, t, q).collect()}
    assert got == {("s", "a", 1, "=", 30), ("s", "b", 1, "=", 30), ("le", "d", 1, "<=", 0), ("le", "b", -1, "<=", 0)}
    t, r, q = model(spark, TUPLES, ROWS, [("le", "d")])
    assert {x.row_id for x in constraints.fold(r, t, q).collect()} == {"s"}
    assert constraints.fold(r.limit(0), t).count() == 0


@pytest.mark.parametrize("row, message", [(("bad", [("all", 1), ("e", -1)], "<=", 0), "contradict the row bad"), (("bad", [("all", 1), ("nobody", 1)], "=", 30), "unknown tuple: nobody")])
def test_contradictions_raise(spark, row, message):
    t, r, _ = model(spark, TUPLES, [*ROWS, row])
    with pytest.raises(Exception, match=message):
        constraints.fold(r, t).collect()


def test_feasible_counts(spark):
    t, r, q = model(spark, TUPLES, ROWS)
    got = {x.tuple_id: (x.component, x.n_values, x.least, x.most) for x in constraints.feasible_counts(t, r, q).collect()}
    at = {"a": 0, "b": 1, "d": 2, "lone": 3}
    ranges = [_start_ranges(c, n, 10) for i, n, c, s in TUPLES if s]
    want = enumerated(ranges[:3], [([(0, 1), (1, 1)], "=", 30), ([(2, 1), (1, -1)], "<=", 0)]) + enumerated(ranges[3:], [])
    assert got == {i: ("lone" if i == "lone" else "a", len(want[j]), min(want[j]), max(want[j])) for i, j in at.items()}
    assert constraints.feasible_counts(t.where("not suppressed"), r.where("row_id = 'known'")).count() == 0
