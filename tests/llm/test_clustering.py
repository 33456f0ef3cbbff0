import hashlib
import math
import random

import numpy as np
import pytest

from plumbline.llm import clustering

SCHEMA = "vec_id long, embedding array<float>, v string, cluster string"


def brute(rows, k=16, rounds=3, dims=64):
    """(vec_id, cluster, distance) of each kept vector, by all distances; and the centroids."""
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))[:k]
    centroids = [v for _, v in first]

    def nearest():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        at = [j for _, j in nearest()]
        for j in range(len(centroids)):
            mine = [v for (_, v), a in zip(kept, at, strict=True) if a == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    return [(i, j, d) for (i, _), (d, j) in zip(kept, nearest(), strict=True)], centroids


def check(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], SCHEMA)
    want, centroids = brute(rows, **kw)
    assigned, got = clustering.cluster(df, **kw)
    assert got.tolist() == centroids
    key = lambda r: str(tuple(r))
    assert sorted((tuple(r) for r in assigned.collect()), key=key) == sorted(want, key=key)
    inertia = {}
    for _, j, d in want:
        inertia[j] = inertia.get(j, 0) + d
    for r in clustering.report(assigned, got).collect():
        assert (r.cluster_inertia, r.inertia) == (inertia[r.cluster], sum(inertia.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_equals_brute_force(spark):
    rng = random.Random(3)
    centres = [[rng.uniform(-1, 1) for _ in range(64)] for _ in range(9)]
    check(spark, [(i, [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for i in range(400)])


def test_ties_repeats_and_what_is_not_kept(spark):
    rng = random.Random(4)
    grid = [(i, [float(rng.randint(-1, 1)) for _ in range(4)]) for i in range(150)]
    odd = [(200, None), (201, []), (202, [1.0] * 3), (203, [1.0, None, 0.0, 0.0]), (204, [float("nan")] * 4), (205, [float("-inf"), 0.0, 0.0, 0.0]), (None, [0.5] * 4), (7, [-0.01] * 4), (7, [-0.01] * 4)]
    check(spark, grid + odd, k=7, rounds=4, dims=4)
    check(spark, odd[-3:], k=7, rounds=2, dims=4)


def test_nothing_is_kept(spark):
    assigned, centroids = clustering.cluster(spark.createDataFrame([(1, [1.0], "x", "y")], SCHEMA))
    assert assigned.columns == ["vec_id", "cluster", "distance"] and assigned.count() == 0 and len(centroids) == 0
    assert clustering.report(assigned, centroids).count() == 0


def test_large_components_are_refused(spark):
    with pytest.raises(Exception, match="too large"):
        clustering.cluster(spark.createDataFrame([(1, [1e30], "x", "y")], SCHEMA), dims=1)


def test_scans_stop_early_and_agree():
    rng = np.random.default_rng(5)
    x, c = rng.integers(-50, 50, (500, 8)), rng.integers(-50, 50, (20, 8))
    best, near = clustering.assign(x, rng.integers(0, 20, 500), c)
    all_of = ((x[:, None] - c) ** 2).sum(2)
    assert (near == all_of.min(1)).all() and (best == all_of.argmin(1)).all()
