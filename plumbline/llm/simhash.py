"""SimHash near-dedup with pivot distance tables.

A fingerprint bit is 1 if it is set in over half of the 64-bit hashes of a text's word shingles.
Two fingerprints link at `MAX_DISTANCE` or fewer differing bits. Only distinct fingerprints are compared:

* blocks: of six bit bands two differing bits touch at most two, so a linked pair agrees on four whole
  bands, one of 15 choices; pairs are only looked for among equal choices;
* pivot table: each fingerprint carries its Hamming distances to `N_PIVOTS` reference fingerprints. By
  the triangle inequality a linked pair differs by at most MAX_DISTANCE in every coordinate, so pairs
  with a larger coordinate difference are discarded; survivors are verified bit by bit;
* blocks of over `MAX_BLOCK` fingerprints are not compared pair by pair: their members meet at shared
  one-bit neighbours instead (two fingerprints are within two bits if and only if they have one),
  where no group can exceed 65.

Null and empty texts have fingerprint zero and link like any other. Repeated ids and rows each get their row.
"""

from __future__ import annotations

import itertools
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import resemblance
from .common import id_text, materialize
from .components import connected_components

MAX_DISTANCE, N_PIVOTS, MAX_BLOCK = 2, 16, 64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_CHUNK = 1 << 16  # shingles hashed before their bits are added up
#: Bit bands of 11, 11, 11, 11, 10 and 10 bits.
_BANDS = [((1 << n) - 1) << at for n, at in zip((11, 11, 11, 11, 10, 10), (0, 11, 22, 33, 44, 54), strict=True)]
_PIVOTS = [random.Random(f"pivot {i}").getrandbits(64) for i in range(N_PIVOTS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle_words: int = 3) -> int:
    """Of the lower-cased (A-Z) words of a UTF-8 text; zero if it has none. As a signed 64-bit integer."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words]).tolist()
    k = min(shingle_words, len(words))
    stops, n = (ends[k - 1 :] - 1).tolist(), len(words) - k + 1
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        h = np.array([digest(line[a:b], 42) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK], strict=False)], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return _signed(sum(1 << int(i) for i in np.flatnonzero(2 * ones > n)))


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes(), shingle_words) for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = id_text(docs)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fp long")


def _distances(fp: Column) -> list[Column]:
    """The pivot table's row, eight coordinates to a long."""
    at = [F.bit_count(fp.bitwiseXOR(F.lit(_signed(p)))).cast("long") for p in _PIVOTS]
    packed = []
    for i in range(0, N_PIVOTS, 8):
        total = at[i]
        for j in range(1, 8):
            total = total.bitwiseOR(F.shiftleft(at[i + j], 8 * j))
        packed.append(total)
    return packed


def _within_pivots() -> Column:
    """No coordinate differs by more than MAX_DISTANCE."""
    apart = [
        F.abs(F.shiftrightunsigned(f"x.p{w}", 8 * j).bitwiseAND(F.lit(255)) - F.shiftrightunsigned(f"y.p{w}", 8 * j).bitwiseAND(F.lit(255)))
        for w in range(N_PIVOTS // 8)
        for j in range(8)
    ]
    test = apart[0] <= MAX_DISTANCE
    for x in apart[1:]:
        test = test & (x <= MAX_DISTANCE)
    return test


def links(distinct: DataFrame, max_block: int = MAX_BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints `fp` that connect all those within MAX_DISTANCE of each other."""
    table = distinct.select("fp", *(d.alias(f"p{i}") for i, d in enumerate(_distances(F.col("fp")))))
    masks = [sum(c) for c in itertools.combinations(_BANDS, 4)]
    keys = F.explode(F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(masks))))
    blocks = table.select("fp", "p0", "p1", keys.alias("k")).select("fp", "p0", "p1", "k.choice", "k.key")
    sizes = blocks.groupBy("choice", "key").agg(F.count("*").alias("n"))
    paired = blocks.join(sizes.where((F.col("n") > 1) & (F.col("n") <= max_block)).select("choice", "key"), ["choice", "key"])
    x, y = paired.alias("x"), paired.alias("y")
    near = x.join(y, ["choice", "key"]).where(
        (F.col("x.fp") < F.col("y.fp")) & _within_pivots() & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= MAX_DISTANCE)
    )
    crowded = blocks.join(sizes.where(F.col("n") > max_block).select("choice", "key"), ["choice", "key"], "left_semi").select("fp").distinct()
    spots = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))
    from pyspark.sql import Window

    met = crowded.select("fp", F.explode(spots).alias("spot")).select("fp", F.min("fp").over(Window.partitionBy("spot")).alias("least"))
    return near.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).union(met.where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b"))).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links lead to, itself included."""
    fps = materialize(fingerprints(docs, shingle_words))
    least = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    roots = connected_components(links(least.select("fp")))
    # Only fingerprints with a link to another are in `roots`; any other is its own class.
    classes = least.join(roots.withColumnRenamed("id", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    best = classes.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = classes.join(best, "root").select("fp", "component_id")
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def text_links(texts: DataFrame) -> DataFrame:
    """Edges (a, b) between texts (num, fp) that connect all those of equal fingerprints or of ones within MAX_DISTANCE."""
    least = materialize(texts.groupBy("fp").agg(F.min("num").alias("least")))
    same = texts.join(least, "fp").where("num <> least").select(F.col("num").alias("a"), F.col("least").alias("b"))
    of = lambda c: least.select(F.col("fp").alias(c), F.col("least").alias(f"n{c}"))
    near = links(least.select("fp")).join(of("a"), "a").join(of("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    return same.union(near)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of `docs` for each class of documents that SimHash links or the similarity of whole shingle sets lead to.

    Fingerprints alone miss near copies that differ by more bits, so both kinds of links make the classes; no link of either is lost.
    """
    return resemblance.keep_one(docs, fingerprint=fingerprint, also=text_links)
