"""Source partitions take part in the disclosure control."""

import itertools
import random

from plumbline.operators import release as rl
from plumbline.plans import catalogue


def test_sources_are_solved_and_closed(spark):
    cells = [("all", 43, 100), ("q1", 20, 50), ("q2", 23, 50), ("src:a", 3, 40), ("src:b", 40, 60)]
    shares = spark.createDataFrame([("1", *c) for c in cells], "check_id string, partition string, c long, n long")
    found = lambda close: {r.tuple_id: (r.kind, r.n_values) for r in rl.disclosure(shares, close).collect()}
    assert found(False) == {"1|src:a": ("primary", 1)}
    assert found(True) == {"1|src:a": ("primary", 20), "1|src:b": ("complementary", 20)}


def test_large_counts_are_not_enumerated():
    n = 10**9
    tuples = {"all": (n // 2 + 3, 2 * n), "q1": (3, n), "q2": (n // 2, n)}
    rows = [({"q1": 1, "q2": 1, "all": -1}, "=", 0)]
    state = {"q1": "complementary", "q2": "complementary"}
    assert rl.feasible_ranges(tuples, state, rows) == {"q1": [(0, n // 2 + 3)], "q2": [(0, n // 2 + 3)]}


def test_queries_hold_source_cells(spark, sf):
    for name in ("feasible_values", "closure"):
        assert any("|src:" in r.tuple_id for r in catalogue.QUERIES[name](spark, sf).collect())


def test_ranges_equal_enumeration():
    """All counts of all suppressed cells, tried one by one."""
    rng = random.Random(4)
    for _ in range(30):
        cells = {f"q{i}": (c := rng.choice([0, 1, 2, 3, 4, 9]), c + rng.randrange(1, 12)) for i in range(4)}
        cells |= {f"s{i}": (rng.randrange(3), 6) for i in range(2)}
        cells["all"] = (sum(cells[f"q{i}"][0] for i in range(4)), sum(cells[f"q{i}"][1] for i in range(4)))
        rows = [({**{f"q{i}": 1 for i in range(4)}, "all": -1}, "=", 0), ({"s0": 1, "s1": 1, "q0": -1}, rng.choice(["<=", ">="]), cells["s0"][0] + cells["s1"][0] - cells["q0"][0])]
        state = {t: rng.choice(["primary", "complementary"]) for t in cells if t != "all" and rng.random() < 0.8}
        floor, domains = 3, {}
        for t in state:
            c, n = cells[t]
            domains[t] = range(n + 1) if state[t] == "complementary" or n < floor else [v for v in range(n + 1) if v < floor or v >= max(floor, n - floor + 1)]
        want = {t: set() for t in state}
        for pick in itertools.product(*domains.values()):
            at = {t: c for t, (c, _) in cells.items()} | dict(zip(state, pick))
            sums = [(sum(k * at[t] for t, k in terms.items()), sense, rhs) for terms, sense, rhs in rows]
            if all(s == r if o == "=" else s <= r if o == "<=" else s >= r for s, o, r in sums):
                for t, v in zip(state, pick):
                    want[t].add(v)
        got = rl.feasible_ranges(cells, state, rows, floor)
        assert {t: {v for a, b in r for v in range(a, b + 1)} for t, r in got.items()} == want


def test_many_small_cells_of_one_row():
    cells = {f"q{i:02d}": (4, 600) for i in range(25)} | {"all": (100, 15_000)}
    rows = [({**{t: 1 for t in cells if t != "all"}, "all": -1}, "=", 0)]
    got = rl.feasible_ranges(cells, {t: "primary" for t in cells if t != "all"}, rows)
    assert all(r == [(0, 9)] for r in got.values())
