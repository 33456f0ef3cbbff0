"""Language-model scores by context-tree weighting, beside a smoothed word model.

Every byte is eight binary decisions; a node is a context of up to DEPTH bytes with the bits decided so far, and
holds how often a zero and a one followed. A node's Krichevsky-Trofimov estimate is weighted with the product of
its children's (one more byte of context), all depths, half and half, from the leaves up. A text's probability is
that of its lower-cased (A-Z) bytes and a closing zero byte, each predicted along its context path by the mixture
that those weights give; before the text come zero bytes. Divided by its bytes it is the code length per byte.

Learning counts (DEPTH + 1)-byte strings of the training documents (crc32 of the id modulo 10 not 0), first in
tasks, then over the corpus; the trees are built in groups by the last two bytes of context, what they add to the two
top levels (at most 2^16 nodes) in one more sum. The strings seen in training get a table of log probabilities that
is broadcast in blocks of BLOCK_ROWS at most, one pass over the documents for each; strings not seen are few
and go through the trees by a join. Word counts likewise: words of at least 1 / TABLE of all tokens are
broadcast (at most TABLE, whatever the corpus), others joined.

Null text: the empty one, one token. A null id counts as the empty text: held out. Repeated rows are each counted and each
scored; other columns are ignored. With no training document every count is zero.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, materialize

DEPTH = 5
TABLE = 1 << 18
BLOCK_ROWS = 1 << 22
_FLUSH, _LOOK = 1 << 21, 1 << 19  # bytes counted, and scored, together
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_EMPTY = np.uint64((1 << 64) - 1)


# --- trees ---


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of positive x, by Stirling's series after a shift of eight."""
    z = x + 8.0
    series = 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - 1 / (1680 * z**7)
    shift = np.zeros_like(z)
    for i in range(8):
        shift += np.log(x + i)
    return (z - 0.5) * np.log(z) - z + 0.5 * math.log(2 * math.pi) + series - shift


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - math.log(math.pi)


class Level:
    """The nodes of one depth: sorted keys (context << 8 | bits so far, led by a one), counts and own weight."""

    def __init__(self, key: np.ndarray, counts: np.ndarray, log_children: np.ndarray | None):
        estimate = log_kt(counts[0], counts[1])
        self.key, self.counts = key, counts
        if log_children is None:
            self.log_weighted, self.own = estimate, np.ones(len(key))
        else:
            self.log_weighted = np.logaddexp(estimate, log_children) - math.log(2)
            self.own = np.exp(estimate - math.log(2) - self.log_weighted)

    def above(self, context_bytes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, counts, log of the children's product) of the depth above, of `context_bytes` bytes."""
        mask = np.int64((1 << 8 * context_bytes) - 1)
        key, inverse = np.unique((self.key >> 8 & mask) << 8 | self.key & 255, return_inverse=True)
        counts = np.array([np.bincount(inverse, c, len(key)) for c in self.counts])
        return key, counts, np.bincount(inverse, self.log_weighted, len(key))

    def mix(self, key: np.ndarray, bit: np.ndarray, below: np.ndarray) -> np.ndarray:
        """Probability of the bit, given that from one depth below; a half where the node is new."""
        if not len(self.key):
            return np.full(len(key), 0.5)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        here = np.where(bit == 1, self.counts[1][at], self.counts[0][at])
        own = (here + 0.5) / (self.counts[0][at] + self.counts[1][at] + 1.0)
        return np.where(self.key[at] == key, self.own[at] * own + (1 - self.own[at]) * below, 0.5)


def decisions(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, bits so far, bit) for the eight bits of each gram's last byte."""
    context, byte = np.repeat(grams >> 8, 8), np.repeat(grams & 255, 8)
    j = np.tile(np.arange(8), len(grams))
    return context, (1 << j) | (byte >> (8 - j)), byte >> (7 - j) & 1


def grow(grams: np.ndarray, n: np.ndarray, depth: int = DEPTH, least: int = 2) -> list[Level]:
    """Levels from `depth` up to `least`, of grams that hold all with the same last `least` bytes of context."""
    context, bits, bit = decisions(grams)
    key, inverse = np.unique(context << 8 | bits, return_inverse=True)
    weight = np.repeat(n, 8).astype(float)
    counts = np.array([np.bincount(inverse, weight * (bit == b), len(key)) for b in (0, 1)])
    levels = [Level(key, counts, None)]
    for d in range(depth - 1, least - 1, -1):
        levels.append(Level(*levels[-1].above(d)))
    return levels


def log10_probability(grams: np.ndarray, levels: list[Level], depth: int = DEPTH) -> np.ndarray:
    """Of each gram's last byte after the others; `levels` go from `depth` down to 0."""
    context, bits, bit = decisions(grams)
    p = np.full(len(context), 0.5)
    for d, level in zip(range(depth, -1, -1), levels, strict=True):
        p = level.mix((context & ((1 << 8 * d) - 1)) << 8 | bits, bit, p)
    return np.log10(p).reshape(-1, 8).sum(1)


# --- texts ---


def gram_stream(texts: list[bytes], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(grams, where each text's begin) of lower-cased texts, each closed by a zero byte."""
    pad = b"\0" * depth
    a = np.frombuffer(b"".join(pad + t.translate(_LOWER) + b"\0" for t in texts), np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    g = np.zeros(len(a) - depth, np.int64)
    for j in range(depth + 1):
        g <<= 8
        g |= a[j : len(a) - depth + j]
    inside = np.ones(len(g), bool)
    ends = np.cumsum(sizes + depth)[:-1]
    inside[(ends[:, None] - depth + np.arange(depth)).ravel()] = False
    return g[inside], np.concatenate([[0], np.cumsum(sizes)[:-1]])


class Table:
    """Open addressing from grams to log probabilities."""

    def __init__(self, grams: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(grams) * 1.5).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.values = np.zeros(1 << self.bits, np.float32)
        grams = grams.astype(np.uint64)
        slot, todo = self._slot(grams), np.arange(len(grams))
        while len(todo):
            s = slot[todo]
            free = self.keys[s] == _EMPTY
            self.keys[s[free]] = grams[todo[free]]
            won = self.keys[s] == grams[todo]
            self.values[s[won]] = values[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        h = grams * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, found)."""
        grams = grams.astype(np.uint64)
        out, found = np.zeros(len(grams)), np.zeros(len(grams), bool)
        slot, todo = self._slot(grams), np.arange(len(grams))
        while len(todo):
            k = self.keys[slot[todo]]
            hit = k == grams[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            found[todo[hit]] = True
            todo = todo[~hit & (k != _EMPTY)]
            slot[todo] = (slot[todo] + 1) & (len(self.keys) - 1)
        return out, found


_built: dict[str, Table] = {}


def _table(handle, name: str) -> Table:
    """Built once in each worker."""
    if name not in _built:
        _built.clear()
        _built[name] = Table(*handle.value)
    return _built[name]


# --- corpus ---


def _flushes(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[list[bytes]]:
    some, size = [], 0
    for b in batches:
        for t in b.column(column):
            some.append(t.as_buffer().to_pybytes())
            size += len(some[-1])
            if size >= _FLUSH:
                yield some
                some, size = [], 0
    if some:
        yield some


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts in _flushes(batches):
        c: Counter[bytes] = Counter()
        for t in texts:
            c.update(t.translate(_LOWER).split())
        yield pa.record_batch([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for texts in _flushes(batches):
        g, n = np.unique(gram_stream(texts)[0], return_counts=True)
        for at in range(0, len(g), 1 << 16):
            yield pa.record_batch([pa.array(g[at : at + (1 << 16)]), pa.array(n[at : at + (1 << 16)])], ["gram", "n"])


def held_out(doc_id: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 10 == 0


def _root():
    """Groups of trees: the two last bytes of context."""
    return F.expr("shiftright(gram, 8) & 65535").alias("root")


def _top_rows(pdf: pd.DataFrame) -> pd.DataFrame:
    key, counts, children = grow(pdf["gram"].to_numpy(), pdf["n"].to_numpy())[-1].above(1)
    return pd.DataFrame({"key": key, "zeros": counts[0], "ones": counts[1], "children": children})


def top_levels(grams: DataFrame) -> list[Level]:
    """The levels of one and no byte of context, from at most 2^16 rows."""
    rows = grams.groupBy(_root()).applyInPandas(_top_rows, "key long, zeros double, ones double, children double")
    pdf = rows.groupBy("key").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("children").alias("children")).toPandas()
    pdf = pdf.sort_values("key")
    one = Level(pdf["key"].to_numpy(np.int64), np.array([pdf["zeros"], pdf["ones"]], float), pdf["children"].to_numpy(float))
    return [one, Level(*one.above(0))]


def gram_scores(asked: DataFrame, grams: DataFrame, top: list[Level]) -> DataFrame:
    """(gram, score) of distinct grams `asked`, each with the trees of its two last bytes of context."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        g = left["gram"].to_numpy(np.int64)
        if not len(g):
            return pd.DataFrame({"gram": g, "score": np.zeros(0)})
        levels = grow(right["gram"].to_numpy(np.int64), right["n"].to_numpy(np.int64))
        return pd.DataFrame({"gram": g, "score": log10_probability(g, [*levels, *top])})

    return asked.select("gram").groupBy(_root()).cogroup(grams.groupBy(_root())).applyInPandas(run, "gram long, score double")


def score(docs: DataFrame, table_words: int = TABLE, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(doc_id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    spark = docs.sparkSession
    rows = id_text(docs).withColumn("held_out", held_out())
    id_type = rows.schema["doc_id"].dataType.simpleString()
    train = rows.where(~F.col("held_out")).select("text")
    words = materialize(train.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    grams = materialize(train.mapInArrow(_count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    n_train = rows.where(~F.col("held_out")).count()
    n_words, v_words = (x or 0 for x in words.agg(F.sum("n"), F.count("*")).first())
    total, distinct = n_words + n_train, v_words + (n_train > 0)
    below = total + 0.1 * (distinct + 1)
    often = words.where(F.col("n") * table_words >= n_words).toArrow()
    known = spark.sparkContext.broadcast(dict(zip(often["word"].to_pylist(), often["n"].to_pylist(), strict=True)))

    run_id = uuid.uuid4().hex
    top = top_levels(grams)
    scores = materialize(gram_scores(grams, grams, top))
    n_blocks = max(1, -(-scores.count() // block_rows))

    def looker(handle, block: int, first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = _table(handle, f"{run_id} {block}")
            for b in batches:
                texts = [t.as_buffer().to_pybytes() for t in b.column("text")]
                at = 0
                while at < len(texts):
                    stop, size = at, 0
                    while stop < len(texts) and size < _LOOK:
                        size += len(texts[stop])
                        stop += 1
                    yield _look(b.slice(at, stop - at), texts[at:stop], table, block)
                    at = stop

        def _look(b: pa.RecordBatch, texts: list[bytes], table: Table, block: int) -> pa.RecordBatch:
            g, starts = gram_stream(texts)
            mine = (g % n_blocks == block) if n_blocks > 1 else np.ones(len(g), bool)
            value, found = table.find(g)
            sums = np.add.reduceat(np.where(mine, value, 0), starts)
            new = np.flatnonzero(mine & ~found)
            owner = np.searchsorted(starts, new, "right") - 1
            cut = np.searchsorted(owner, np.arange(len(texts) + 1))
            unseen = [g[new[x:y]] for x, y in zip(cut[:-1], cut[1:], strict=True)]
            n_tokens, n_known, base, rare = [], [], [], []
            for t in texts if first else []:
                ws = t.translate(_LOWER).split()
                got = [known.value.get(w) for w in ws]
                seen = [c for c in got if c is not None]
                n_tokens.append(len(ws) + 1)
                n_known.append(len(seen) + (n_train > 0))
                base.append(float(np.log10((np.array([*seen, n_train]) + 0.1) / below).sum()))
                rare.append([w for w, c in zip(ws, got, strict=True) if c is None])
            if not first:
                n_tokens = n_known = [0] * len(texts)
                base, rare = [0.0] * len(texts), [[] for _ in texts]
            return pa.record_batch(
                [
                    *(b.column(c) for c in ("doc_id", "key", "held_out")), pa.array([len(t) for t in texts], pa.int64()), pa.array(n_tokens, pa.int64()),
                    pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(sums, pa.float64()), pa.array(rare, pa.list_(pa.binary())),
                    pa.array(unseen, pa.list_(pa.int64())),
                ],
                ["doc_id", "key", "held_out", "n_bytes", "n_tokens", "n_known", "base", "sums", "rare", "unseen"],
            )

        return run

    keyed = rows.withColumn("key", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"))
    schema = f"doc_id {id_type}, key long, held_out boolean, n_bytes long, n_tokens long, n_known long, base double, sums double, rare array<binary>, unseen array<long>"
    passes = []
    for k in range(n_blocks):
        block = (scores.where(F.col("gram") % n_blocks == k) if n_blocks > 1 else scores).toArrow()
        handle = spark.sparkContext.broadcast((block["gram"].to_numpy(), block["score"].to_numpy().astype(np.float32)))
        passes.append(keyed.select("doc_id", "key", "text", "held_out").mapInArrow(looker(handle, k, k == 0), schema).withColumn("pass", F.lit(k)))
    looked = materialize(reduce(DataFrame.unionByName, passes))
    first = looked.where("pass = 0")
    # Equal rows share a key: their lists are the same, so one of each is enough.
    lists = looked.where("size(rare) > 0 OR size(unseen) > 0").dropDuplicates(["key", "pass"])
    rare = lists.select("key", F.explode("rare").alias("word")).join(words.select("word", "n"), "word", "left")
    of_words = rare.groupBy("key").agg(
        F.count("n").alias("more_known"), F.sum(F.log10((F.coalesce("n", F.lit(0)) + 0.1) / F.lit(below))).alias("more_base")
    )
    asked = lists.select("key", F.explode("unseen").alias("gram")).groupBy("key", "gram").agg(F.count("*").alias("times"))
    new = gram_scores(asked.select("gram").distinct(), grams, top)
    of_grams = asked.join(new, "gram").groupBy("key").agg(F.sum(F.col("times") * F.col("score")).alias("more_score"))
    result = first.drop("sums") if n_blocks > 1 else first
    if n_blocks > 1:
        result = result.join(looked.dropDuplicates(["key", "pass"]).groupBy("key").agg(F.sum("sums").alias("sums")), "key")
    result = result.join(of_words, "key", "left").join(of_grams, "key", "left")
    plus = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return result.select(
        "doc_id", "held_out", "n_bytes", "n_tokens", plus("n_known", "more_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        plus("base", "more_base").alias("base_score"), plus("sums", "more_score").alias("score"),
    )
