"""Benchmark decontamination by q-gram lemma filtering.

A text within e edits of an item of m characters keeps at least m - q + 1 - q * e of its q-grams, all
on diagonals that lie at most e apart. For each document the places with a shared q-gram are counted in overlapping
diagonal bands of 2 * (e + 1); bands that reach the bound become regions, those that touch become one, ends within the budget
e = floor(EDIT_RATE * m) are found in one pass over a region, and a banded alignment of the item verifies each place. q is the largest for which the bound
is at least one: short items have shorter grams. Items of fewer than EXACT characters are looked for as they are, as whole words.

A gram that an item repeats counts a place once for each band: offsets at most a band apart are one interval, so a run of
one sign costs as many rows as it has bands, not as many as it has characters.

Texts are compared lower-cased (A-Z), each run of white space as one space, trimmed.
Documents are only mapped over, never shuffled. The benchmark is the query side: it is indexed in blocks of
about BLOCK_CHARS characters, one pass over the documents for each block.

Null or empty texts and items match nothing. Repeated document rows each report their regions; items that
repeat are reported under each id. Other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text

EDIT_RATE, EXACT = 0.08, 10
#: (q, least length of an item): with that length and more the lemma's bound is at least one.
GRAMS = ((10, 40), (8, 20), (6, EXACT))
BLOCK_CHARS = 4_000_000
_SLICE_CHARS = 1_000_000  # of documents looked at together
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 22
_CELLS = 1 << 22  # of regions aligned together
_ROWS = 1 << 21  # places and bands counted together


def normalize(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the normal form, and the index in `text` that each comes from."""
    a = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").copy()
    space = (a == 32) | ((a >= 9) & (a <= 13))
    a[space] = 32
    keep = ~space
    keep[1:] |= space[1:] & ~space[:-1]
    at = np.flatnonzero(keep)
    a = a[at]
    upper = (a >= 65) & (a <= 90)
    a[upper] += 32
    if len(a) and a[-1] == 32:
        a, at = a[:-1], at[:-1]
    return a, at


def qgram_hashes(a: np.ndarray, q: int) -> np.ndarray:
    """A mixed polynomial hash of every q-gram."""
    if len(a) < q:
        return np.zeros(0, np.uint64)
    h = np.zeros(len(a) - q + 1, np.uint64)
    for j in range(q):
        h *= _MULTIPLIER
        h += a[j : len(a) - q + 1 + j]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def budget(m: int) -> int:
    """Edits allowed in an item of m characters."""
    return int(EDIT_RATE * m) if m >= EXACT else 0


@dataclass
class Grams:
    """All q-grams of items of some lengths: sorted hashes, and the intervals of offsets (item, low, high) where each occurs."""

    q: int
    hashes: np.ndarray
    first: np.ndarray
    item_of: np.ndarray
    low_of: np.ndarray
    high_of: np.ndarray
    member: np.ndarray

    @classmethod
    def build(cls, q: int, items: dict[int, np.ndarray]) -> Grams:
        none = np.zeros(0, np.int64)
        hs = {i: qgram_hashes(a, q) for i, a in items.items()}
        h = np.concatenate([*hs.values(), np.zeros(0, np.uint64)])
        item = np.concatenate([np.full(len(x), i) for i, x in hs.items()] + [none])
        offset = np.concatenate([np.arange(len(x)) for x in hs.values()] + [none])
        width = np.concatenate([np.full(len(x), budget(len(items[i])) + 1) for i, x in hs.items()] + [none])
        order = np.lexsort((offset, item, h))
        h, item, offset, width = h[order], item[order], offset[order], width[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (item[1:] != item[:-1]) | (offset[1:] - offset[:-1] > width[1:])
        head = np.flatnonzero(new)
        last = np.append(head[1:], len(h)) - 1 if len(h) else head
        h, item, low, high = h[head], item[head], offset[head], offset[last]
        unique, first = np.unique(h, return_index=True)
        member = np.zeros(1 << _FILTER_BITS, bool)
        member[unique >> np.uint64(64 - _FILTER_BITS)] = True
        return cls(q, unique, np.append(first, len(h)), item, low, high, member)


@dataclass
class Index:
    """A block of items: by grams, and those too short for any by their whole form."""

    ids: list
    items: list[np.ndarray]
    grams: list[Grams]
    exact: dict[int, dict[bytes, list[int]]]

    @classmethod
    def build(cls, rows: list[tuple[object, str | None]]) -> Index:
        ids, items = [], []
        for i, text in rows:
            a, _ = normalize(text)
            if len(a):
                ids.append(i)
                items.append(a)
        left, grams = {i: a for i, a in enumerate(items)}, []
        for q, least in GRAMS:
            some = {i: a for i, a in left.items() if len(a) >= least}
            left = {i: a for i, a in left.items() if len(a) < least}
            if some:
                grams.append(Grams.build(q, some))
        exact: dict[int, dict[bytes, list[int]]] = {}
        for i, a in left.items():
            exact.setdefault(len(a), {}).setdefault(a.astype("<u4").tobytes(), []).append(i)
        return cls(ids, items, grams, exact)

    def regions(self, texts: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, start, stop) of the bands that reach the bound, and of the places of short items."""
        lengths = np.array([len(a) for a in texts])
        starts = np.concatenate([[0], np.cumsum(lengths + 1)])
        joined = np.zeros(starts[-1], np.uint32)  # a zero after each text; hits across it cannot be verified
        for a, s in zip(texts, starts, strict=False):
            joined[s : s + len(a)] = a
        for g in self.grams:
            yield from self._bands(g, joined, starts, lengths)
        edge = (joined == 32) | (joined == 0)
        for m, wanted in self.exact.items():
            begins = np.flatnonzero(np.concatenate([[True], edge[:-1]]) & ~edge)
            begins = begins[begins + m < len(joined)]
            for at in begins[edge[begins + m]].tolist():
                for i in wanted.get(joined[at : at + m].astype("<u4").tobytes(), ()):
                    t = int(np.searchsorted(starts, at, "right")) - 1
                    yield t, i, int(at - starts[t]), int(at - starts[t]) + m

    def _bands(self, g: Grams, joined: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        h = qgram_hashes(joined, g.q)
        at = np.flatnonzero(g.member[h >> np.uint64(64 - _FILTER_BITS)])
        k = np.searchsorted(g.hashes, h[at])
        k[k == len(g.hashes)] = 0
        found = g.hashes[k] == h[at]
        at, k = at[found], k[found]
        if not len(at):
            return
        sizes = np.array([len(a) for a in self.items])
        edits = np.array([budget(m) for m in sizes])
        longest = sizes.max()  # added to diagonals, so that none is negative
        # How many rows each place makes, so that they are made and counted some at a time.
        bands = np.add.reduceat(np.append((g.high_of - g.low_of) // (edits[g.item_of] + 1) + 2, 0), g.first[:-1])
        part = np.cumsum(bands[k]) // _ROWS
        cut = np.flatnonzero(np.diff(part)) + 1
        some = [self._count(g, x, y, starts, edits, longest) for x, y in zip(np.split(at, cut), np.split(k, cut), strict=True)]
        keys, counts = np.concatenate([x for x, _ in some]), np.concatenate([x for _, x in some])
        order = np.lexsort((keys[:, 2], keys[:, 1], keys[:, 0]))
        keys, counts = keys[order], counts[order]
        head = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
        keys, counts = keys[head], np.add.reduceat(counts, head)
        m, e = sizes[keys[:, 1]], edits[keys[:, 1]]
        good = counts >= m - g.q + 1 - g.q * e
        for (t, i, b), m, e in zip(keys[good].tolist(), m[good].tolist(), e[good].tolist(), strict=True):  # noqa: B020
            start = b * (e + 1) - int(longest) - int(starts[t])
            yield t, i, max(0, start), min(int(lengths[t]), start + 2 * (e + 1) + m + e)

    def _count(self, g: Grams, at: np.ndarray, k: np.ndarray, starts: np.ndarray, edits: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, item, band of twice the width) and how many places are in each."""

        def spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(row, number within the row) for rows that are repeated n times."""
            return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

        row, nth = spread(g.first[k + 1] - g.first[k])
        interval = g.first[k[row]] + nth
        pos, item = at[row], g.item_of[interval]
        width = edits[item] + 1
        low, high = (pos - g.high_of[interval] + longest) // width, (pos - g.low_of[interval] + longest) // width
        # Each diagonal lies in two bands of twice the width.
        row, nth = spread(high - low + 2)
        text = np.searchsorted(starts, pos, "right") - 1
        item, band, text = item[row], low[row] - 1 + nth, text[row]
        order = np.lexsort((band, item, text))
        item, band, text = item[order], band[order], text[order]
        new = np.ones(len(item), bool)
        new[1:] = (item[1:] != item[:-1]) | (band[1:] != band[:-1]) | (text[1:] != text[:-1])
        head = np.flatnonzero(new)
        return np.column_stack([text[head], item[head], band[head]]), np.diff(np.append(head, len(item)))


def align(item: np.ndarray, regions: list[np.ndarray], e: int) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end) of the best alignment of the whole item within each region, over a band of diagonals.

    Edits over `e` may be overstated. Of equally good ends the first.
    """
    m, far = len(item), 1 << 20
    longest = max(map(len, regions))
    bands = max(1, longest - m + 2 * e + 1)  # diagonals -e .. longest - m + e
    text = np.zeros((len(regions), longest + 2 * m + bands), np.uint32)
    pad = e + 1
    for r, a in enumerate(regions):
        text[r, pad : pad + len(a)] = a
    inside = np.array([len(a) for a in regions])[:, None]
    ramp = np.arange(bands)
    j = ramp - e  # characters of the region used before row 0
    cost = np.where((j >= 0) & (j <= inside), 0, far)
    for i in range(m):
        j = i + 1 + ramp - e
        same = text[:, pad + i - e : pad + i - e + bands] == item[i] if pad + i - e >= 0 else np.zeros_like(cost, bool)
        step = cost + ~same
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        step = np.where((j >= 0) & (j <= inside), step, far)
        cost = np.minimum.accumulate(step - ramp, axis=1) + ramp
        cost = np.where((j >= 0) & (j <= inside), cost, far)
    best = cost.argmin(1)
    return cost[np.arange(len(regions)), best], m + best - e


def _ends(item: np.ndarray, e: int, region: np.ndarray) -> list[tuple[int, int]]:
    """(edits, end) of all ends in the region where the item lies within e edits, whatever its start.

    A column of the alignment's table is two whole numbers of one bit for each character of the item: the signs of its steps.
    """
    m, bits = len(item), {}
    for i, c in enumerate(item.tolist()):
        bits[c] = bits.get(c, 0) | 1 << i
    every, last = (1 << m) - 1, 1 << m - 1
    up, down, edits, out = every, 0, m, []
    for end, c in enumerate(region.tolist(), 1):
        same = bits.get(c, 0)
        level = same | down
        across = ((same & up) + up ^ up | same) & every
        right, left = down | every & ~(across | up), up & across
        edits += bool(right & last) - bool(left & last)
        right, left = right << 1 & every, left << 1 & every
        up, down = left | every & ~(level | right), right & level
        if edits <= e:
            out.append((edits, end))
    return out


def _apart(hits: list[tuple[int, int]], m: int, e: int) -> list[tuple[int, int]]:
    """The (edits, end) of a region that stand for its places: fewest edits first, then the first end.

    Ends lie an item's length apart, then those are added that leave room for its shortest form.
    """
    taken: list[int] = []
    out, left = [], sorted(hits)
    for least in (m, m - e):
        rest = []
        for x in left:
            k = bisect_left(taken, x[1])
            before, after = x[1] - taken[k - 1] if k else m, taken[k] - x[1] if k < len(taken) else m
            if before >= least and after >= least:
                taken.insert(k, x[1])
                out.append(x)
            elif before >= m - e and after >= m - e:
                rest.append(x)
        left = rest
    return out


def _verified(index: Index, kept: list[tuple]) -> Iterator[tuple]:
    """(text number, item number, start, end, edits) in original offsets, from (number, item, region, offsets).

    Ends within the budget are found in one pass over a region; each place's end is then aligned backward over its band of diagonals.
    """
    by_item: dict[int, list[tuple]] = {}
    for x in kept:
        by_item.setdefault(x[1], []).append(x)
    for i, xs in by_item.items():
        item, m = index.items[i], len(index.items[i])
        e = budget(m)
        places = sorted(((d, end, n) for n, x in enumerate(xs) for d, end in _apart(_ends(item, e, x[2]), m, e)))
        for d, same in groupby(places, lambda x: x[0]):  # a band as wide as their edits
            while some := list(islice(same, max(1, _CELLS // (4 * m + 2 * d)))):
                edits, back = align(item[::-1], [xs[n][2][max(0, end - m - d) : end][::-1] for _, end, n in some], d)
                for (_, end, n), k, size in zip(some, edits.tolist(), back.tolist(), strict=True):
                    if k <= d:
                        yield xs[n][0], i, int(xs[n][3][end - size]), int(xs[n][3][end - 1]) + 1, k


def _joined(regions: Iterator[tuple[int, int, int, int]], index: Index) -> Iterator[tuple[int, int, int, int]]:
    """Regions of one text and item that overlap or touch as one, so that nothing is aligned twice; short items' are places already."""
    now = None
    for t, i, a, b in sorted(regions):
        if now and now[:2] == (t, i) and a <= now[3] and len(index.items[i]) >= EXACT:
            now = (t, i, now[2], max(b, now[3]))
        else:
            if now:
                yield now
            now = (t, i, a, b)
    if now:
        yield now


def _scan(index: Index, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """All (text, item, start, end, edits), one for each place: overlapping finds of an item are one place."""
    kept, some, numbers, size = [], [], [], 0

    def look() -> None:
        for t, i, a, b in _joined(index.regions([x[0] for x in some]), index):
            kept.append((numbers[t], i, some[t][0][a:b], some[t][1][a:b]))

    for n, text in enumerate(texts):
        x = normalize(text)
        some.append(x)
        numbers.append(n)
        size += len(x[0])
        if size >= _SLICE_CHARS:
            look()
            some, numbers, size = [], [], 0
    if some:
        look()
    out: list[tuple[int, int, int, int, int]] = []
    for x in sorted(_verified(index, kept)):
        if out and out[-1][:2] == x[:2] and x[2] < out[-1][3]:
            if x[4] < out[-1][4]:
                out[-1] = x
        else:
            out.append(x)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, start, end, edits): where documents hold an item, in code points of the original text."""
    spark, rows = docs.sparkSession, id_text(docs)
    items = benchmark.select(F.col(f"`{item_col}`").alias("item_id"), F.col(f"`{item_text}`").alias("text")).where("text IS NOT NULL")
    id_type, item_type = (d.schema[c].dataType.simpleString() for d, c in ((rows, "doc_id"), (items, "item_id")))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-total // BLOCK_CHARS) or 1

    def scanner(handle):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = handle.value
            for b in batches:
                found = _scan(index, b.column("text").to_pylist()) if index.items else []
                who = b.column("doc_id").take(pa.array([x[0] for x in found], pa.int64()))
                which = pa.array([index.ids[x[1]] for x in found], item_arrow)
                yield pa.record_batch([who, which, *(pa.array([x[k] for x in found], pa.int64()) for k in (2, 3, 4))], ["doc_id", "item_id", "start", "end", "edits"])

        return run

    from pyspark.sql.pandas.types import to_arrow_type

    item_arrow = to_arrow_type(items.schema["item_id"].dataType)
    parts = []
    for k in range(n_blocks):
        block = items.where(F.pmod(F.xxhash64("text"), F.lit(n_blocks)) == k).collect()  # about BLOCK_CHARS characters
        handle = spark.sparkContext.broadcast(Index.build([tuple(r) for r in block]))
        parts.append(rows.mapInArrow(scanner(handle), f"doc_id {id_type}, item_id {item_type}, start long, end long, edits long"))
    return reduce(DataFrame.unionByName, parts)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` (all columns) that hold no item."""
    keyed = docs.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).alias("doc_id"), "text")
    bad = contamination(keyed, benchmark).select("doc_id.doc_id", "doc_id.k").distinct().withColumnsRenamed({"doc_id": "bad_id", "k": "bad_key"})
    same = docs["doc_id"].eqNullSafe(bad["bad_id"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == bad["bad_key"])
    return docs.join(bad, same, "left_anti")
