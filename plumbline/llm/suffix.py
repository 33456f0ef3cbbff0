"""Suffix arrays by induced sorting, and exact substring dedup of a corpus with them.

`suffix_array` classifies suffixes, sorts the leftmost-smaller (LMS) substrings, names them, sorts the
string of names by naming pairs of names again and again, and induces all other suffixes bucket by
bucket. `permuted_lcp` compares only irreducible positions; the others follow from their neighbours.

`repeated_bytes` shards the corpus by content. Every WINDOW-byte string holds a k-gram of least hash, its
minimizer; equal strings have the same one and meet in the same shard:

1. equal texts are looked at once, for the smallest id that has them: a copy of another id is covered whole;
2. of all minimizers, those found in one text only are dropped (compared by hash, a collision only keeps more);
3. around the others segments are cut: neighbouring windows with the same minimizer, at most MAX_RUN;
4. each distinct segment, with the smallest document it occurs in, goes to the shard of its minimizer, which builds
   the suffix array of its segments; suffixes with WINDOW bytes in common are neighbours there;
5. segments learn for each window the smallest document that holds it, occurrences compare it with their own.

What a task sees more than once within some MB is reduced before it is shuffled, so a passage that a third of the
documents hold costs one row for these, and the joins back to occurrences are plain ones that adaptive execution can split.

A text is known by a 64-bit hash, or a second one if another text has the same first; a segment by 128 bits.

Document ids are integers; a null id counts as larger than any. Documents of equal ids do not remove from each
other, so repeated rows all stay as they are. A null text is the empty one. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions

WINDOW, GRAM = 50, 16
MAX_RUN = WINDOW - GRAM + 1
NO_ID = (1 << 63) - 1
SHARD_BYTES = 1 << 20  # of segments, before equal ones become one
_LAST = np.uint64((1 << 64) - 1)
_SLICE, _FLUSH = 1 << 20, 1 << 23  # bytes hashed at once; bytes whose minimizers, or segments, are sent together


# --- suffix array of one shard ---


def _classify(t: np.ndarray) -> np.ndarray:
    """True for S-type suffixes; `t` ends with its unique least symbol."""
    n = len(t)
    up = np.zeros(n, np.int8)
    up[:-1] = np.sign(t[1:].astype(np.int32) - t[:-1])
    up[-1] = 1
    at = np.where(up != 0, np.arange(n), n)
    return up[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _induce(t: np.ndarray, s_type: np.ndarray, seeds: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """All suffixes in order, from LMS suffixes that are in order within each first symbol."""
    top = int(symbols[-1]) + 1
    of_symbol = np.argsort(t[seeds], kind="stable")
    seeds = seeds[of_symbol]
    cut = np.searchsorted(t[seeds], np.arange(top + 1))
    l_in: list[list[np.ndarray]] = [[] for _ in range(top)]
    s_in: list[list[np.ndarray]] = [[] for _ in range(top)]
    l_done: dict[int, np.ndarray] = {}
    s_done: dict[int, np.ndarray] = {}

    def deal(p: np.ndarray, to: list[list[np.ndarray]]) -> None:
        c = t[p]
        order = np.argsort(c, kind="stable")
        p, c = p[order], c[order]
        heads = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else []
        for a, b in zip(heads, [*heads[1:], len(c)], strict=False):
            to[c[a]].append(p[a:b])

    none = np.zeros(0, np.int64)
    for c in symbols:
        front, parts = np.concatenate([none, *l_in[c]]), []
        while len(front):
            parts.append(front)
            p = front[front > 0] - 1
            front = p[(t[p] == c) & ~s_type[p]]
        l_done[c] = np.concatenate([none, *parts])
        all_of_c = np.concatenate([l_done[c], seeds[cut[c] : cut[c + 1]]])
        p = all_of_c[all_of_c > 0] - 1
        deal(p[~s_type[p] & (t[p] > c)], l_in)
    s_in[int(t[-1])].append(np.array([len(t) - 1]))
    for c in symbols[::-1]:
        front, parts = np.concatenate([none, *s_in[c]]), []
        while len(front):
            parts.append(front)
            p = front[front > 0] - 1
            front = p[(t[p] == c) & s_type[p]]
        s_done[c] = np.concatenate([none, *parts])
        all_of_c = np.concatenate([s_done[c], l_done[c][::-1]])
        p = all_of_c[all_of_c > 0] - 1
        deal(p[s_type[p] & (t[p] < c)], s_in)
    return np.concatenate([x for c in symbols for x in (l_done[c], s_done[c][::-1])])


def _name(t: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Names of the LMS substrings in text order; equal substrings share one, and names sort as they do."""
    length = np.ones(len(t), np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    a, b = ordered[:-1], ordered[1:]
    live = np.flatnonzero(length[a] == length[b])
    same = np.zeros(len(a), bool)
    k = 0
    while len(live):
        live = live[t[a[live] + k] == t[b[live] + k]]
        k += 1
        whole = length[a[live]] == k
        same[live[whole]] = True
        live = live[~whole]
    name = np.zeros(len(t), np.int64)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms]


def _sort_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of the reduced string, by names of pairs, of pairs of pairs and so on."""
    rank, k, n = names, 1, len(names)
    while rank.max(initial=0) + 1 < n:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        _, rank = np.unique(rank * (n + 1) + after, return_inverse=True)
        k *= 2
    return np.argsort(rank)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of a byte array in order."""
    t = np.append(text.astype(np.int16) + 1, np.int16(0))
    s_type = _classify(t)
    symbols = np.unique(t)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if len(text) == 0:
        return np.zeros(0, np.int64)
    rough = _induce(t, s_type, lms, symbols)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    names = _name(t, lms, rough[is_lms[rough]])
    return _induce(t, s_type, lms[_sort_names(names)], symbols)[1:]


def permuted_lcp(text: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the bytes it shares with the suffix before it in the suffix array."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.zeros(n, np.uint64)
    for j in range(8):
        words |= padded[j : n + j].astype(np.uint64) << np.uint64(8 * j)
    before = np.concatenate([[0], text[:-1]]).astype(np.int16)
    before[0] = -1
    reducible = (phi >= 0) & (before == np.where(phi > 0, before[phi], -2))
    lcp = np.zeros(n, np.int64)
    live = np.flatnonzero(~reducible & (phi >= 0))
    while len(live):
        a, b = live + lcp[live], phi[live] + lcp[live]
        inside = np.maximum(a, b) < n
        live, a, b = live[inside], a[inside], b[inside]
        x = words[a] ^ words[b]
        low = x & (~x + np.uint64(1))
        equal = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)) // 8).astype(np.int64)
        equal = np.minimum(equal, n - np.maximum(a, b))
        lcp[live] += equal
        live = live[equal == 8]
    at = np.where(reducible, 0, np.arange(n))
    head = np.maximum.accumulate(at)
    return np.where(reducible, lcp[head] - (np.arange(n) - head), lcp)


def least_of_windows(text: np.ndarray, lengths: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each WINDOW-byte string of each segment in turn, the least of `first` over the segments that hold it.

    `text` has the segments one after another, each closed by byte 255, which is no byte of UTF-8.
    """
    ends = np.cumsum(lengths + 1)
    owner = np.repeat(np.arange(len(lengths)), lengths + 1)
    whole = np.arange(len(text)) + WINDOW < ends[owner]
    sa = suffix_array(text)
    shared = permuted_lcp(text, sa)[sa] >= WINDOW
    sa_group = np.cumsum(~shared) - 1
    sa_group -= sa_group[0]
    heads = np.flatnonzero(np.concatenate([[True], sa_group[1:] != sa_group[:-1]]))
    least = np.minimum.reduceat(first[owner[sa]], heads)
    of_position = np.empty(len(text), np.int64)
    of_position[sa] = least[sa_group]
    return of_position[whole]


# --- minimizers ---


def gram_hashes(a: np.ndarray) -> np.ndarray:
    """Mixed hashes of all GRAM-byte strings."""
    one = np.uint64(0x9E3779B97F4A7C15)
    h = (a.astype(np.uint64) + np.uint64(1)) * one

    def power(n: int) -> np.uint64:
        return np.uint64(pow(0xD6E8FEB86659FD93, n, 1 << 64))

    span, pieces = 1, {1: h}
    while span * 2 <= GRAM:
        last = pieces[span]
        pieces[span * 2] = last[:-span] * power(span) + last[span:]
        span *= 2
    n = len(a) - GRAM + 1
    total, done = np.zeros(n, np.uint64), 0
    for span in sorted(pieces, reverse=True):
        if GRAM - done >= span:
            total = total * power(span) + pieces[span][done : done + n]
            done += span
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    total ^= total >> np.uint64(32)
    return total


def runs(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, start, windows) of the runs of WINDOW-byte strings with the same minimizer."""
    h, w = gram_hashes(a), WINDOW - GRAM + 1
    span = 1
    while span * 2 <= w:
        h = np.minimum(h[:-span], h[span:])
        span *= 2
    if span < w:
        h = np.minimum(h[: len(h) - (w - span)], h[w - span :])
    start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    size = np.diff(np.append(start, len(h)))
    # Periodic text has long runs: cut them.
    n = -(-size // MAX_RUN)
    if n.max() > 1:
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        size = np.minimum(MAX_RUN, np.repeat(size, n) - nth * MAX_RUN)
        start = np.repeat(start, n) + nth * MAX_RUN
    return h[start], start, size


_AT = np.dtype([("start", "<u4"), ("size", "u1")])


def _send(n_buckets: int):
    """Of each flush every text and every minimizer once: to the bucket of its hash, or, if two texts share it, as known to be shared."""

    def flush(hs, keys, starts, sizes) -> Iterator[pa.RecordBatch]:
        h, key, at = np.concatenate(hs), np.concatenate(keys), np.zeros(sum(map(len, starts)), _AT)
        at["start"], at["size"] = np.concatenate(starts), np.concatenate(sizes)
        order = np.argsort(h, kind="stable")
        head = np.flatnonzero(np.concatenate([[True], h[order][1:] != h[order][:-1]]))
        shared = np.minimum.reduceat(key[order], head) != np.maximum.reduceat(key[order], head)
        known = np.zeros(len(h), bool)
        known[order] = np.repeat(shared, np.diff(np.append(head, len(h))))
        rows: list[tuple[int, int, bytes, bytes, bytes]] = []
        # kind 1: (text, where), sent as bucket rows are, so that one pass over the texts makes both
        k, p = key[known], at[known]
        cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else []
        for x, y in zip(cut, [*cut[1:], len(k)], strict=False):
            rows.append((int(k[x]) % n_buckets, int(k[x]), b"", b"", p[x:y].tobytes()))
        # kind 0: a minimizer of one text here (all its places), or the bare hash of a shared one
        # Both in the order of the texts, in which keys and places compress well.
        keep = ~known
        keep[order[head[shared]]] = True
        h, key, at, known = h[keep], key[keep], at[keep], known[keep]
        bucket = (h % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        h, key, at, known, bucket = h[order], key[order], at[order], known[order], bucket[order]
        short = (h >> np.uint64(32)).astype("<u4")
        at["size"][known] = 0
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else []
        for x, y in zip(cut, [*cut[1:], len(bucket)], strict=False):
            rows.append((int(bucket[x]), 0, short[x:y].tobytes(), key[x:y].tobytes(), at[x:y].tobytes()))
        columns = list(zip(*rows, strict=True))
        yield pa.record_batch(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[2:])],
            ["bucket", "key", "hashes", "keys", "at"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, keys, starts, sizes, size = [], [], [], [], 0
        seen: set[int] = set()
        for b in batches:
            for key, text in zip(b.column("key").to_pylist(), b.column("text"), strict=True):
                if key in seen:
                    continue
                a = np.frombuffer(text.as_buffer(), np.uint8) if text.as_py() else np.zeros(0, np.uint8)
                if len(a) >= WINDOW:
                    seen.add(key)
                for at in range(0, max(1, len(a) - WINDOW + 1), _SLICE):
                    part = a[at : at + _SLICE + WINDOW - 1]
                    if len(part) < WINDOW:
                        continue
                    h, start, n = runs(part)
                    hs.append(h), keys.append(np.full(len(h), key)), starts.append(start + at), sizes.append(n)
                    size += len(part)
                    if size >= _FLUSH:
                        yield from flush(hs, keys, starts, sizes)
                        hs, keys, starts, sizes, size = [], [], [], [], 0
                        seen = {key}
        if hs:
            yield from flush(hs, keys, starts, sizes)

    return run


def _shared(pdf: pd.DataFrame) -> pd.DataFrame:
    """One bucket: (key, place) for the places of minimizers that more than one text has, each once; a place is start << 8 | size."""
    known = pdf["hashes"].str.len() == 0
    keys = [np.repeat(pdf["key"][known].to_numpy(np.int64), (pdf["at"][known].str.len() // _AT.itemsize).to_numpy(np.int64))]
    ats = [np.frombuffer(b"".join(pdf["at"][known]), _AT)]
    rest = pdf[~known]
    if len(rest):
        h = np.frombuffer(b"".join(rest["hashes"]), "<u4")
        key = np.frombuffer(b"".join(rest["keys"]), "<i8")
        at = np.frombuffer(b"".join(rest["at"]), _AT)
        order = np.argsort(h, kind="stable")
        h, key, at = h[order], key[order], at[order]
        head = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        shared = (np.minimum.reduceat(key, head) != np.maximum.reduceat(key, head)) | (np.minimum.reduceat(at["size"], head) == 0)
        keep = np.repeat(shared, np.diff(np.append(head, len(h)))) & (at["size"] > 0)
        keys.append(key[keep])
        ats.append(at[keep])
    key, at = np.concatenate(keys), np.concatenate(ats)
    order = np.lexsort((at["start"], key))
    key, at = key[order], at[order]
    once = np.ones(len(key), bool)
    once[1:] = (key[1:] != key[:-1]) | (at["start"][1:] != at["start"][:-1])
    return pd.DataFrame({"key": key[once], "place": (at["start"][once].astype(np.int64) << 8) | at["size"][once]})


_SEGMENT = "m long, label long, key long, doc long, start long, seg binary, first long, last long"


def _cut(text: bytes, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(minimizers, labels, segments) of the runs that start there."""
    import xxhash

    a = np.frombuffer(text, np.uint8)
    seg = [text[x:y] for x, y in zip(start.tolist(), (start + size + WINDOW - 1).tolist(), strict=True)]
    # The minimizer of the first window is that of the run. What is hashed: the windows, or the text if that is shorter.
    at = start
    if len(a) > WINDOW * len(start):
        a, at = a[start[:, None] + np.arange(WINDOW)].reshape(-1), np.arange(len(start)) * WINDOW
    h = np.append(gram_hashes(a), _LAST)
    m = np.minimum.reduceat(h, np.column_stack([at, at + MAX_RUN]).ravel())[::2]
    return m.view(np.int64), np.array([xxhash.xxh64_intdigest(x) for x in seg], np.uint64).view(np.int64), seg


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments of each text. Minimizer and label stand for a segment, with 128 bits; of equal ones in a flush one row has the bytes,
    and the least and largest document here."""

    def flush(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        m, label, key, doc, start = (np.concatenate([p[i] for p in parts]) for i in range(5))
        seg = [x for p in parts for x in p[5]]
        order = np.lexsort((label, m))
        head = np.flatnonzero(np.concatenate([[True], (m[order][1:] != m[order][:-1]) | (label[order][1:] != label[order][:-1])]))
        whole = np.zeros(len(m), bool)
        whole[order[head]] = True
        ends = np.zeros((2, len(m)), np.int64)
        ends[:, order[head]] = np.minimum.reduceat(doc[order], head), np.maximum.reduceat(doc[order], head)
        table = pa.RecordBatch.from_arrays(
            [
                *(pa.array(x) for x in (m, label, key, doc, start)),
                pa.array([x if w else None for x, w in zip(seg, whole, strict=True)], pa.binary()),
                *(pa.array(e, mask=~whole) for e in ends),
            ],
            ["m", "label", "key", "doc", "start", "seg", "first", "last"],
        )
        for at in range(0, len(m), 1 << 16):
            yield table.slice(at, 1 << 16)

    parts, size = [], 0
    for b in batches:
        for row in range(b.num_rows):
            text = b.column("text")[row].as_py().encode()
            at = np.unique(b.column("places")[row].values.to_numpy())
            start, n = at >> 8, at & 255
            inside = start + n + WINDOW - 1 <= len(text)
            start, n = start[inside], n[inside]
            if not len(start):
                continue
            m, label, seg = _cut(text, start, n)
            parts.append((m, label, *(np.full(len(start), b.column(c)[row].as_py()) for c in ("key", "doc")), start, seg))
            size += sum(map(len, seg))
            if size >= _FLUSH:
                yield from flush(parts)
                parts, size = [], 0
    if parts:
        yield from flush(parts)


def _shard(table: pa.Table) -> pa.Table:
    """The suffix array of a shard's segments: those that some document but the first has a window of."""
    seg = table["seg"].combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(seg.buffers()[1], np.int64)[seg.offset : seg.offset + len(seg) + 1]
    lengths = np.diff(offsets)
    text = np.full(lengths.sum() + len(lengths), 255, np.uint8)
    text[np.arange(lengths.sum()) + np.repeat(np.arange(len(lengths)), lengths)] = np.frombuffer(seg.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    least = least_of_windows(text, lengths, table["first"].to_numpy())
    windows = lengths - WINDOW + 1
    useful = np.minimum.reduceat(least, np.cumsum(windows) - windows) < table["last"].to_numpy()
    cut = np.concatenate([[0], np.cumsum(windows[useful])]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(least[np.repeat(useful, windows)]))
    return pa.table([*(table[c].filter(pa.array(useful)) for c in ("m", "label")), lists], ["m", "label", "least"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = [_removed(x) for x in b.column("marks").to_pylist()]
        yield pa.record_batch([b.column("key"), b.column("first_doc"), *(pa.array([s[i] for s in spans], pa.list_(pa.int64())) for i in (0, 1))], ["key", "first_doc", "starts", "ends"])


def _removed(places: list[dict] | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that go."""
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.array([p["start"] for p in places])
    mask = np.array([p["mask"] for p in places])
    at = np.unique(np.concatenate([start[(mask >> o) & 1 == 1] + o for o in range(MAX_RUN)]))
    new = np.concatenate([[True], at[1:] > at[:-1] + WINDOW])
    return at[new], np.append(at[np.flatnonzero(new)[1:] - 1], at[-1]) + WINDOW


def text_keys(rows: DataFrame, first: Column | None = None) -> DataFrame:
    """Adds `key`, a number for each text: a 64-bit hash, or another where two texts share it.

    Texts that share a hash are few (of n about n * n / 2^65), so their hashes may come to the driver.
    """
    first, other = F.xxhash64("text") if first is None else first, F.xxhash64(F.lit("another"), "text")
    both = rows.select(first.alias("key"), other.alias("other")).groupBy("key").agg(F.min("other").alias("low"), F.max("other").alias("high"))
    shared = [r.key for r in both.where("low <> high").select("key").collect()]
    return rows.withColumn("key", F.when(first.isin(shared), other).otherwise(first) if shared else first)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_key: Column | None = None) -> DataFrame:
    """(doc_id, text, starts, ends): the byte ranges of each text covered by strings of WINDOW bytes that a document with a smaller id holds."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = rows.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
    rows = text_keys(rows, first_key)
    n = partitions(spark, rows)
    sent = rows.select("key", "text").mapInArrow(_send(n), "bucket long, key long, hashes binary, keys binary, at binary")
    shared = sent.groupBy("bucket").applyInPandas(_shared, "key long, place long")
    places = materialize(shared.groupBy("key").agg(F.collect_list("place").alias("places")))
    texts = rows.groupBy("key").agg(F.min("doc").alias("doc"), F.first("text").alias("text"))
    found = materialize(texts.join(places, "key").select("key", "doc", "text", "places").mapInArrow(_segments, _SEGMENT))
    # Shards of a fixed size, many to a task. One shuffle: rows of a shard stay together when they are made distinct.
    n_shards = (found.agg(F.sum(F.octet_length("seg"))).first()[0] or 0) // SHARD_BYTES + 1
    owned = found.where("seg IS NOT NULL").select(F.pmod("m", F.lit(n_shards)).alias("shard"), "m", "label", "seg", "first", "last").repartition(n, "shard")
    distinct = owned.groupBy("shard", "m", "label").agg(F.first("seg").alias("seg"), F.min("first").alias("first"), F.max("last").alias("last"))
    sharded = materialize(distinct.groupBy("shard").applyInArrow(_shard, "m long, label long, least array<long>"))
    mask = "aggregate(transform(least, (x, i) -> IF(x < doc, shiftleft(1L, i), 0L)), 0L, (a, b) -> a | b)"
    marks = found.select("m", "label", "key", "doc", "start").join(sharded, ["m", "label"]).select("key", "start", F.expr(mask).alias("mask")).where("mask <> 0")
    marks = marks.groupBy("key").agg(F.collect_list(F.struct("start", "mask")).alias("marks"))
    firsts = rows.groupBy("key").agg(F.min("doc").alias("first_doc")).join(marks, "key", "left")
    per_text = materialize(firsts.mapInArrow(_runs, "key long, first_doc long, starts array<long>, ends array<long>"))
    joined = rows.join(per_text, "key", "left")
    copy = (F.col("doc") > F.col("first_doc")) & (F.octet_length("text") >= WINDOW)
    return joined.select(
        "doc_id",
        "text",
        F.when(copy, F.array(F.lit(0).cast("long"))).otherwise(F.col("starts")).alias("starts"),
        F.when(copy, F.array(F.octet_length("text").cast("long"))).otherwise(F.col("ends")).alias("ends"),
    )


def digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of the ranges that `repeated_bytes` found."""
    id_type = found.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for text, starts, ends in zip(b.column("text").to_pylist(), b.column("starts").to_pylist(), b.column("ends").to_pylist(), strict=True):
                raw, at, digest = text.encode(), 0, hashlib.sha256()
                for x, y in zip(starts, ends, strict=True):
                    digest.update(raw[at:x])
                    at = y
                digest.update(raw[at:])
                for o, v in zip(out, (len(raw), sum(ends) - sum(starts), len(starts), digest.hexdigest()), strict=True):
                    o.append(v)
            yield pa.record_batch([b.column("doc_id"), *(pa.array(o, pa.int64()) for o in out[:3]), pa.array(out[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
