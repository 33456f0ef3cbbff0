"""Resampling as the reference has it: 2000 draws, groups and pooled, refusals."""

import hashlib
import random

import pytest

from plumbline.operators import stats as ss
from plumbline.plans import catalogue


def test_bootstrap_by_check_and_pooled(spark):
    rng = random.Random(2)
    rows = [(f"c{i // 6}", "xy"[i % 2], rng.random() < 0.6, rng.random() < 0.5) for i in range(60)]
    df = spark.createDataFrame(rows, "cluster string, check_id string, a boolean, b boolean")
    got = {(r.check_id, r.metric): (r.low, r.high) for r in ss.bootstrap_ci(df, "s", by=["check_id"], pooled=True).collect()}
    names, i, values = sorted({r[0] for r in rows}), 0, {"x": [], "y": [], None: []}
    for _ in range(2000):
        picked = []
        for _ in names:
            u = int(hashlib.sha256(f"s:bootstrap:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
            picked += [r for r in rows if r[0] == names[int(u * len(names))]]
            i += 1
        for k, v in values.items():
            mine = [r for r in picked if k in (None, r[1])]
            v.append(sum(r[2] == r[3] for r in mine) / len(mine))
    for k, v in values.items():
        v.sort()
        assert got[k, "pa"] == (pytest.approx(v[int(0.025 * 1999)]), pytest.approx(v[-(-975 * 1999 // 1000)]))


def test_bootstrap_query_has_every_check_and_all(spark, sf):
    found = catalogue.QUERIES["bootstrap_ci"](spark, sf).select("check_id").distinct().collect()
    assert None in {r.check_id for r in found} and len(found) > 2


def test_permutation_refuses_small_groups(spark):
    rows = [(f, i, g, 0, g == "a") for f, n in (("big", 30), ("small", 29)) for g in "ab" for i in range(n)] + [("one", i, "a", 0, i % 2 == 0) for i in range(40)]
    df = spark.createDataFrame([(f, f"{g}{i}", g, c, p) for f, i, g, c, p in rows], "family string, project string, grp string, check_id int, positive boolean")
    got = {r.family: r for r in ss.permutation_test(df, "s").collect()}
    assert got["big"].tested and got["big"].p == pytest.approx(1 / 2001)
    assert not got["small"].tested and got["small"].p is None and "30" in got["small"].reason
    assert not got["one"].tested and got["one"].reason == "fewer than two groups"


def plain_permutation(sample, seed, draws):
    """(statistic, p, v) of {(project, grp): {check: positive}} by plain loops, all shuffles in sequence."""
    people = sorted(sample)
    checks = sorted({c for x in sample.values() for c in x})

    def statistic(groups):
        out = 0.0
        for c in checks:
            yes = [bool(sample[p].get(c)) for p in people]
            if 0 < sum(yes) < len(yes):
                for g in set(groups):
                    mine = [y for y, h in zip(yes, groups, strict=True) if h == g]
                    e = len(mine) * sum(yes) / len(yes)
                    out += (sum(mine) - e) ** 2 * (1 / e + 1 / (len(mine) - e))
        return out

    groups, i, hits = [g for _, g in people], 0, 0
    t = statistic(groups)
    for _ in range(draws):
        for j in range(len(groups) - 1, 0, -1):
            u = int(hashlib.sha256(f"{seed}:h2-permutation:bootstrap:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
            k, i = int(u * (j + 1)), i + 1
            groups[j], groups[k] = groups[k], groups[j]
        hits += statistic(groups) >= t - 1e-9 * max(1, t)
    return t, (1 + hits) / (draws + 1), (t / len(people) / len(checks)) ** 0.5


def test_permutations_split_over_tasks_equal_the_sequence(spark):
    rng, samples, rows = random.Random(5), {}, []
    for f, n, n_checks in (("a", 33, 3), ("b", 33, 2), ("c", 40, 65), (None, 44, 1)):
        sample = samples[f] = {}
        for p in range(2 * n):
            x = sample[f"p{p:03d}", "uv"[p % 2]] = {c: rng.random() < 0.4 + 0.1 * (p % 2) for c in range(n_checks) if rng.random() < 0.9}
            rows += [(f, f"p{p:03d}", "uv"[p % 2], c, y) for c, y in x.items()] + [(f, f"p{p:03d}", "uv"[p % 2], None, True)]
    sample = {k: {k2: x for k2, x in v.items() if x} for k, v in samples.items()}
    df = spark.createDataFrame(rows, "family string, project string, grp string, check_id int, positive boolean")
    got = {r.family: r for r in ss.permutation_test(df, "s", 130).collect()}
    assert len(got) == 4
    for f, x in sample.items():
        t, p, v = plain_permutation(x, "s", 130)
        assert got[f].tested and (got[f].statistic, got[f].p, got[f].v) == (pytest.approx(t), pytest.approx(p), pytest.approx(v))


def test_permutation_of_no_rows(spark):
    df = spark.createDataFrame([], "family string, project string, grp string, check_id int, positive boolean")
    assert ss.permutation_test(df, "s", 10).collect() == []
