"""Centroid clustering by sort-means, in whole numbers.

Components become integers floor(SCALE * x). Each round orders, for every centroid, the other centroids by their distance from it.
A vector starts from the centroid it had in the round before and goes through the others in that one's order; it stops where a
centroid lies strictly beyond twice its distance from the start, since by the triangle inequality no later one can be as near.
Distances are squared, so the bound is four times; equal distances go to the smaller number, hence "strictly".

A round is one scan: tasks send one row of sums for each of their clusters, and the driver gets k times dims totals. No assignment
is stored between rounds: a task replays the rounds so far on its vectors, each from the assignment before, which costs arithmetic
instead of disk and lets the tasks of a lost executor run again anywhere.

Kept are vectors of exactly `dims` components, none null, NaN or infinite; null vectors go, too. Null ids are kept, but chosen last
as first centroids; repeated ids and rows count one by one, in order of their components. With fewer vectors than centroids there
are as many centroids as vectors; an empty table gives an empty result. Extra columns are not looked at. Components over 2^27 in
size after scaling are refused with an error: their squared distances would leave 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

DIMS, SCALE, CENTROIDS, ROUNDS = 64, 64, 16, 3
_LARGEST = 1 << 27


def whole_vectors(vectors: DataFrame, dims: int = DIMS) -> DataFrame:
    """(vec_id, v): the kept vectors of (vec_id, embedding) as arrays of integers."""
    rows = vectors.select("vec_id", F.col("embedding").alias("x")).where(F.size("x") == dims)
    sound = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    scaled = lambda e: F.floor(e.cast("double") * SCALE)
    small = F.forall("x", lambda e: F.abs(e.cast("double") * SCALE) < _LARGEST)
    whole = F.when(small, F.transform("x", lambda e: scaled(e).cast("int"))).otherwise(F.raise_error(F.lit("a component is too large for distances of 64 bits")))
    return rows.where(sound).select("vec_id", whole.alias("v"))


def first_centroids(vectors: DataFrame, k: int = CENTROIDS, seed: int = 1) -> np.ndarray:
    """The k vectors whose ids have the smallest digests, in their order."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(digest.alias("h"), "v").orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def _squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.einsum("ij,ij->i", d, d)


def assign(x: np.ndarray, start: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest centroid, squared distance) of the rows of `x`, by scans from the centroids `start`."""
    apart = np.stack([_squared(centroids, c) for c in centroids])
    own = _squared(x, centroids[start])
    best, near = start.copy(), own.copy()
    for a in np.unique(start):
        order = np.argsort(apart[a], kind="stable")
        live = np.flatnonzero(start == a)
        for c in order[order != a]:
            live = live[apart[a, c] <= 4 * own[live]]  # the others have stopped
            if not live.size:
                break
            d = _squared(x[live], centroids[c])
            won = (d < near[live]) | ((d == near[live]) & (c < best[live]))
            best[live[won]], near[live[won]] = c, d[won]
    return best, near


def _replay(batch: pa.RecordBatch, history: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, cluster, squared distance) after a scan for each table of centroids so far."""
    x = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)
    at = near = np.zeros(len(x), np.int64)
    for centroids in history:
        at, near = assign(x, at, centroids)
    return x, at, near


def _moved(vectors: DataFrame, history: list[np.ndarray]) -> np.ndarray:
    """The next centroids: exact floors of the means, a cluster without vectors keeps its own."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros(history[-1].shape, np.int64), np.zeros(len(history[-1]), np.int64)
        for b in batches:
            if b.num_rows:
                x, at, _ = _replay(b, history)
                np.add.at(total, at, x)
                count += np.bincount(at, minlength=len(count))
        met = np.flatnonzero(count)
        yield pa.record_batch([pa.array(met), pa.array(count[met]), pa.array(list(total[met]), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = vectors.select("v").mapInArrow(sums, "cluster long, n long, total array<long>")
    rows = parts.select("cluster", "n", F.posexplode("total").alias("i", "t")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("t").cast("decimal(38,0)")).alias("t"))
    moved = history[-1].copy()
    for r in rows.collect():
        moved[r.cluster, r.i] = int(r.t) // r.n
    return moved


def cluster(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """((vec_id, cluster, distance) of every kept vector, the centroids)."""
    spark, kept = vectors.sparkSession, whole_vectors(vectors, dims)
    schema = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    history = [first_centroids(kept, k, seed)]
    if not len(history[0]):
        return spark.createDataFrame([], schema), history[0]
    for _ in range(rounds):
        history.append(_moved(kept, history))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                _, at, near = _replay(b, history)
                yield pa.record_batch([b.column("vec_id"), pa.array(at.astype(np.int32)), pa.array(near)], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(run, schema), history[-1]


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """With the sums of distances of each cluster and of all, and a digest of each final centroid."""
    spark, stored = assigned.sparkSession, materialize(assigned)
    sums = {r.cluster: r.s for r in stored.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    text = [(i, sums.get(i, 0), sum(sums.values()), ",".join(map(str, c))) for i, c in enumerate(centroids.tolist())]
    facts = spark.createDataFrame(text, "cluster int, cluster_inertia long, inertia long, c string").withColumn("centroid_sha256", F.sha2("c", 256)).drop("c")
    return stored.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows
