"""SentencePiece encoding and decoding over a relational lattice.

A text becomes units: white space is written as U+2581, one is put in front, and a unit is a run of
those with what follows up to the next; no piece crosses a unit. Nor does one cross two neighbouring characters
that stand together in no piece: a BPE model's units are cut there into parts, each with the same pieces alone as in
its unit. Each distinct part of the corpus is segmented once:

1. its substrings, of the lengths that pieces which begin as they do have, are exploded and equi-joined to the
   piece table: the lattice's edges;
2. the edges are packed and grouped by unit, on the partitioning that made the units distinct (no shuffle);
3. a higher-order `aggregate` folds them. For a unigram model that is Viterbi over the scores. A BPE
   model's segmentation is not the path of the best score but that of its merges in order, so there the
   fold goes through the edges by rank and applies each that joins two neighbours. Single characters that are no
   piece fall back to bytes.

Parts that a text uses are then replaced by numbers, the more frequent the smaller, and these by ids: those of at least 1 / TABLE of all occurrences (so at
most TABLE, whatever the corpus) from a broadcast table, all others by a join on the part and one back on the row. Uncut
units that are met often are in the table, too, so that they need not be cut. Texts are looked up once: both joins
read the same shuffled rows, with the ids found and the parts that were not.

Null and empty texts have no ids. Decoding inverts encoding but for U+2581 itself, which comes back as a space
(as in the library). Repeated rows and null ids each keep their row; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_text, materialize, partitions, settings

SPACE = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Most rows of the broadcast table of frequent units.
TABLE = 1 << 23
#: Score of a character that is no piece, in a unigram model.
UNKNOWN = -1e6
_SLICE, _FLUSH = 1 << 20, 1 << 17  # bytes looked at together; distinct units counted together
#: Of so many occurrences among those counted together, a unit of several parts is counted as a whole, too.
_WHOLE = 4
#: Longer units are segmented one by one, in an Arrow function: the fold's boundaries are bits of a long.
LONG_UNIT = 60
#: First characters of a substring that tell its possible lengths.
HEAD = 4


@dataclass
class Pieces:
    """A model's pieces: `rows` are (piece, id, score) without control and byte pieces."""

    rows: list[tuple[str, int, float]]
    names: list[str]
    byte_ids: list[int]
    unk: int
    kind: str = "bpe"
    score_of: dict[str, tuple[int, float]] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str = DEFAULT_MODEL, kind: str = "bpe") -> Pieces:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(m.vocab_size())
        names = [m.id_to_piece(i) for i in ids]
        rows = [(names[i], i, m.get_score(i)) for i in ids if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]
        return cls(rows, names, [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], m.unk_id(), kind)

    def __post_init__(self):
        self.score_of = {p: (i, s) for p, i, s in self.rows}

    @cached_property
    def late(self) -> set[str]:
        return turns_late(self)

    @cached_property
    def pairs(self) -> set[str]:
        """Neighbouring characters of pieces."""
        return {p[i : i + 2] for p in self.score_of for i in range(len(p) - 1)}

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.rows)


def _split(text: str) -> list[str]:
    """The units of a text, each without the U+2581 that all begin with."""
    if not text:
        return []
    text = text.replace(SPACE, " ")
    words = text.split(" ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return words
    out: list[str] = []
    spaces = 0
    for x in words:
        if x:
            out.append(SPACE * spaces + x)
            spaces = 0
        else:
            spaces += 1
    if spaces:
        out.append(SPACE * (spaces - 1))
    return out


def _cutter(pieces: Pieces):
    """A function from units (without the first U+2581) to their parts (with it), in order, and where each unit's begin and the last ends.

    For a unigram model a unit is one part: sums of scores over parts may round in another way.
    """
    chars = sorted({c for p in pieces.pairs for c in p})
    code = np.zeros(0x110000, np.int32)
    code[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
    joined = np.zeros((len(chars) + 1, len(chars) + 1), bool)
    for p in pieces.pairs:
        joined[code[ord(p[0])], code[ord(p[1])]] = True

    def cut(units: list[str]) -> tuple[list[str], np.ndarray]:
        whole = [SPACE + u for u in units]
        if pieces.kind != "bpe" or not units:
            return whole, np.arange(len(units) + 1)
        text, stops = "".join(whole), np.cumsum([0, *map(len, whole)])
        codes = code[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        apart = np.concatenate([[True], ~joined[codes[:-1], codes[1:]], [True]])
        apart[stops] = True
        at = np.flatnonzero(apart)
        ends = at.tolist()
        return [text[x:y] for x, y in zip(ends, ends[1:], strict=False)], np.searchsorted(at, stops)

    return cut


def _by_heap(unit: str, pieces: Pieces) -> list[int]:
    """Merges of a unit of any length in n log n; the same as the fold over merges."""
    import heapq

    left, right = list(range(-1, len(unit) - 1)), [*range(1, len(unit)), -1]
    text = list(unit)
    heap = []

    def offer(i: int) -> None:
        if i >= 0 and right[i] >= 0 and (hit := pieces.score_of.get(text[i] + text[right[i]])):
            heapq.heappush(heap, (-hit[1], i, len(text[i]), len(text[right[i]])))

    for i in range(len(unit) - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if j < 0 or len(text[i]) != a or len(text[j]) != b:
            continue
        text[i] += text[j]
        text[j] = ""
        right[i] = right[j]
        if right[i] >= 0:
            left[right[i]] = i
        offer(left[i])
        offer(i)
    return [k for s in text if s for k in _ids_of(s, pieces)]


def _by_score(unit: str, pieces: Pieces) -> list[int]:
    """The best path through a unit of any length; the same as the Viterbi fold."""
    best, longest = [(0.0, 0)], pieces.longest
    for e in range(1, len(unit) + 1):
        ways = []
        for s in range(max(0, e - longest), e):
            hit = pieces.score_of.get(unit[s:e])
            if hit or s == e - 1:
                ways.append((best[s][0] + (hit[1] if hit else UNKNOWN), -s))
        total, back = max(ways)
        best.append((total, -back))
    cuts = [len(unit)]
    while cuts[-1]:
        cuts.append(best[cuts[-1]][1])
    cuts.reverse()
    return [k for x, y in zip(cuts, cuts[1:], strict=False) for k in _ids_of(unit[x:y], pieces)]


def _ids_of(symbol: str, pieces: Pieces) -> list[int]:
    hit = pieces.score_of.get(symbol)
    return [hit[0]] if hit else [pieces.byte_ids[b] for b in symbol.encode("utf-8", "surrogatepass")]


def turns_late(pieces: Pieces) -> set[str]:
    """Pieces that a pass over their own merges in order of priority does not form, though repeated passes do.

    Inside a piece's span merges run as they do in the piece alone, as none may cross its ends; so a unit without such
    pieces is segmented by one pass, in whatever surroundings its pieces stand.
    """
    rank = {p: -s for p, _, s in pieces.rows}
    late = set()
    for piece, i, _ in pieces.rows:
        n, m = len(piece), (2 << len(piece)) - 1
        for _, s, e in sorted((rank[piece[s:e]], s, e) for s in range(n) for e in range(s + 2, n + 1) if piece[s:e] in rank):
            ends, span = 1 << s | 1 << e, (2 << e) - (1 << s)
            if (m & span).bit_count() == 3 and m & ends == ends:
                m = m & ~span | ends
        if m != 1 | 1 << n and _by_heap(piece, pieces) == [i]:
            late.add(piece)
    return late


def lengths_by_head(pieces: Pieces) -> dict[str, set[int]]:
    """For what a piece begins with, HEAD characters or all of a shorter one: the lengths of pieces that begin so, or that it begins with.

    After any other HEAD characters there are only pieces of fewer.
    """
    lengths: dict[str, set[int]] = {}
    for p in pieces.score_of:
        lengths.setdefault(p[:HEAD], set()).add(len(p))
    for h, ns in lengths.items():
        ns |= {i for i in range(2, min(len(h), HEAD - 1) + 1) if h[:i] in pieces.score_of}
    return lengths


def lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, n, edges, late) of distinct units; longer ones than LONG_UNIT have no edges.

    For merges an edge is rank << 12 | start << 6 | end of a piece of two or more characters, and `late` tells that one of
    them may have to be tried again; for a unigram model it is the struct (e, s, score) and single characters have one, too.
    """
    spark, merges = units.sparkSession, pieces.kind == "bpe"
    late = pieces.late if merges else set()
    rank = {s: i for i, s in enumerate(sorted({s for _, _, s in pieces.rows}, reverse=True))}
    table = spark.createDataFrame([(p, rank[s], s, p in late) for p, _, s in pieces.rows if len(p) > merges], "piece string, rank long, score double, late boolean")
    heads = spark.createDataFrame([(h, sorted({1, *ns})) for h, ns in lengths_by_head(pieces).items()], "head string, lengths array<int>")
    # Both tables come from the vocabulary file: their rows do not grow with the corpus.
    rows = units.select(F.monotonically_increasing_id().alias("uid"), "unit", "n")
    short, last = f"length(unit) <= {LONG_UNIT}", "greatest(length(unit) - 2, 0)" if merges else "length(unit) - 1"
    starts = rows.select("uid", "unit", "n", F.explode(F.expr(f"sequence(0, IF({short}, {last}, 0))")).alias("s"))
    starts = starts.withColumn("head", F.expr(f"substring(unit, s + 1, {HEAD})")).join(F.broadcast(heads), "head", "left")
    # A single character is only asked for where each start needs one, or to keep a unit without any edge.
    known = f"coalesce(lengths, array({', '.join(str(i) for i in range(1, HEAD))}))"
    spans = starts.select("uid", "unit", "n", "s", F.explode(F.expr(f"IF({short}, {known}, array(1))")).alias("size"))
    spans = spans.where("s + size <= length(unit)" + (" AND (size > 1 OR s = 0)" if merges else ""))
    spans = spans.select("uid", "unit", "n", "s", F.expr("s + size").alias("e"))
    found = spans.withColumn("piece", F.expr("substring(unit, s + 1, e - s)")).join(F.broadcast(table), "piece", "left")
    edge = F.expr("shiftleft(rank, 12) | shiftleft(s, 6) | e") if merges else F.struct("e", "s", F.coalesce("score", F.lit(UNKNOWN)).alias("score"))
    # Rows of a unit follow each other and ids rise, so the sort below the aggregate finds them in order; no shuffle: `unit` is a key.
    grouped = found.where("rank IS NOT NULL OR e = s + 1").groupBy("uid", "unit")
    return grouped.agg(F.first("n").alias("n"), F.collect_list(edge).alias("edges"), F.coalesce(F.max("late"), F.lit(False)).alias("late")).drop("uid")


def fold_merges(latticed: DataFrame) -> DataFrame:
    """(unit, n, cuts): where the symbols end after the merges of a BPE model; null for a long unit."""
    # Bit i of the state: a boundary at i. An edge joins two neighbours if both its ends are boundaries and one lies within.
    s, e = "cast(shiftright(x, 6) & 63 AS int)", "cast(x & 63 AS int)"
    span, ends = f"(shiftleft(2L, {e}) - shiftleft(1L, {s}))", f"(shiftleft(1L, {s}) | shiftleft(1L, {e}))"
    # The ends come first: most edges that do not fit fail there.
    fits = f"((m & shiftleft(1L, {s})) <> 0 AND (m & shiftleft(1L, {e})) <> 0 AND bit_count(m & {span}) = 3)"
    full = "shiftleft(2L, length(unit)) - 1"
    merged = f"m & ~{span} | {ends}"
    # What is used in a lambda is bound by one, else the planner copies it there, to be evaluated again and again.
    cuts = "m -> filter(sequence(1, length(unit)), i -> shiftright(m, i) & 1 = 1)"
    once = f"aggregate(sort_array(edges), {full}, (m, x) -> IF({fits}, {merged}, m), {cuts})"
    first = f"array_compact(array(array_min(filter(edges, x -> {fits}))))"
    again = f"aggregate(sequence(0, size(edges)), {full}, (m, i) -> coalesce(get(transform({first}, x -> {merged}), 0), m), {cuts})"
    return latticed.select("unit", "n", F.expr(f"CASE WHEN length(unit) > {LONG_UNIT} THEN NULL WHEN late THEN {again} ELSE {once} END").alias("cuts"))


def fold_viterbi(latticed: DataFrame) -> DataFrame:
    """(unit, n, cuts): where the pieces of the highest sum of scores end; of equal sums that of the longest last piece; null for a long unit."""
    best = """aggregate(sequence(1, length(unit)),
        array(struct(0D AS total, 1 AS back)),
        (best, j) -> concat(best, array(array_max(transform(filter(edges, x -> x.e = j), x -> struct(best[x.s].total + x.score AS total, -x.s AS back))))))"""
    walk = """aggregate(sequence(1, length(unit)), struct(length(unit) AS at, array(length(unit)) AS cuts),
        (w, i) -> IF(best[w.at].back >= 0, w, struct(-best[w.at].back AS at, concat(array(-best[w.at].back), w.cuts) AS cuts))).cuts"""
    rows = latticed.withColumn("best", F.expr(f"IF(length(unit) <= {LONG_UNIT}, {best}, NULL)"))
    return rows.select("unit", "n", F.expr(f"IF(length(unit) <= {LONG_UNIT}, {walk}, NULL)").alias("cuts"))


def _id_kind(pieces: Pieces) -> np.dtype:
    """Of packed ids: two bytes where they fit."""
    return np.dtype("<u2" if len(pieces.names) < 1 << 16 else "<u4")


def _segmented(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, n, cuts) of distinct, non-empty units (unit, n); cuts null for a long one."""
    return (fold_merges if pieces.kind == "bpe" else fold_viterbi)(lattice(units, pieces))


def _speller(pieces: Pieces, keep: list[str]):
    """An Arrow function from rows with unit and cuts to the columns `keep` and packed ids."""
    kind, known, alone = _id_kind(pieces), pieces.score_of, _by_heap if pieces.kind == "bpe" else _by_score

    def ids_of(u: str, cuts: list[int]) -> bytes:
        ids, start = ([], 0) if cuts else (alone(u, pieces), len(u))
        for stop in cuts:
            hit = known.get(u[start:stop])
            if hit:
                ids.append(hit[0])
            else:
                ids += _ids_of(u[start:stop], pieces)
            start = stop
        return np.array(ids, kind).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, out = None, b""
        for b in batches:
            flat, offsets, packed = b.column("cuts").values.to_numpy().tolist(), b.column("cuts").offsets.to_pylist(), []
            for u, x, y in zip(b.column("unit").to_pylist(), offsets, offsets[1:], strict=False):
                if u != last:  # occurrences of a unit come one after another
                    last, out = u, ids_of(u, flat[x:y])
                packed.append(out)
            yield pa.record_batch([*(b.column(c) for c in keep), pa.array(packed, pa.binary())], [*keep, "ids"])

    return run


def encode_units(units: DataFrame, pieces: Pieces) -> DataFrame:
    """(unit, n, ids) for distinct, non-empty units (unit, n)."""
    kind = _id_kind(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [np.frombuffer(x, kind).astype(np.int32) for x in b.column("ids").to_pylist()]
            yield pa.record_batch([b.column("unit"), b.column("n"), pa.array(ids, pa.list_(pa.int32()))], ["unit", "n", "ids"])

    spelt = _segmented(units, pieces).mapInArrow(_speller(pieces, ["unit", "n"]), "unit string, n long, ids binary")
    return spelt.mapInArrow(run, "unit string, n long, ids array<int>")


def _slices(batches: Iterator[pa.RecordBatch], column: str, size_of=None) -> Iterator[pa.RecordBatch]:
    """Parts of batches of about _SLICE bytes of a column, or of what `size_of` tells of its values, so that a task holds few of them at once."""
    for b in batches:
        if size_of:
            sizes = np.array([size_of(x) for x in b.column(column).to_pylist()], np.int64)
        else:
            sizes = np.diff(np.frombuffer(b.column(column).buffers()[1], "<i4")[b.column(column).offset :][: b.num_rows + 1]) if b.num_rows else np.zeros(0)
        part = np.cumsum(sizes) // _SLICE
        heads = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if b.num_rows else []
        for x, y in zip(heads, [*heads[1:], b.num_rows], strict=False):
            yield b.slice(x, y - x)


def _count_parts(pieces: Pieces):
    """An Arrow function from texts to (unit, n) of parts, and of units of several parts that it meets often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, counts, found = _cutter(pieces), Counter(), Counter()

        def take() -> None:
            units, ns = list(counts), np.array(list(counts.values()), np.int64)
            counts.clear()
            parts, at = cut(units)
            sizes = np.diff(at)
            for p, n in zip(parts, np.repeat(ns, sizes).tolist(), strict=True):
                found[p] += n
            for i in np.flatnonzero((sizes > 1) & (ns >= _WHOLE)).tolist():
                found[SPACE + units[i]] += int(ns[i])

        def rows() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["unit", "n"])

        for b in _slices(batches, "text"):
            for t in b.column("text").to_pylist():
                counts.update(_split(t))
            if len(counts) >= _FLUSH:
                take()
                if len(found) >= _FLUSH:
                    yield rows()
                    found.clear()
        take()
        yield rows()

    return run


def encode(docs: DataFrame, model: str = DEFAULT_MODEL, kind: str = "bpe", table_rows: int = TABLE) -> DataFrame:
    """(doc_id, digest, ids) of every row; digest is the xxhash64 of the text that decoding gives back."""
    spark, pieces = docs.sparkSession, Pieces.load(model, kind)
    rows, id_kind = id_text(docs), _id_kind(pieces)
    counts = materialize(rows.select("text").mapInArrow(_count_parts(pieces), "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n")))
    total = counts.agg(F.sum("n")).first()[0] or 0
    # At most `table_rows` units can have this share of all occurrences.
    often = _segmented(counts.where(F.col("n") * table_rows >= total).repartition(partitions(spark, counts), "unit"), pieces)
    with settings(spark, spark__sql__execution__useObjectHashAggregateExec="false"):
        # The edges of a unit come one after another: a sort finds them in order, where a hash table would first fill up.
        often = often.mapInArrow(_speller(pieces, ["unit", "n"]), "unit string, n long, ids binary").toArrow().sort_by([("n", "descending")])
    # A number tells an entry; 0 is none. Units and their first parts go without the U+2581 that they begin with, which no other part does.
    heads, others = {}, {}
    for i, u in enumerate(often["unit"].to_pylist(), 1):
        if u[0] == SPACE:
            heads[u[1:]] = i
        else:
            others[u] = i
    packed = often["ids"].to_pylist()
    stops = np.cumsum([0, 0, *map(len, packed)]) // id_kind.itemsize
    handle, spelling = spark.sparkContext.broadcast((heads, others)), spark.sparkContext.broadcast((stops, np.frombuffer(b"".join(packed), id_kind)))
    discard(counts)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The numbers of a row, 0 for each rare part, and its rare parts in order, with a space between."""
        import zstandard

        (known, inner), cut, small = handle.value, _cutter(pieces), zstandard.ZstdCompressor(level=1)
        for b in _slices(batches, "text"):
            units, stops = [], [0]
            for t in b.column("text").to_pylist():
                units += _split(t)
                stops.append(len(units))
            found = np.array(list(map(known.get, units, repeat(0))), np.uint32)
            unknown = np.flatnonzero(found == 0)
            parts, at = cut([units[i] for i in unknown.tolist()])
            numbers = np.array([known.get(p[1:], 0) if p[0] == SPACE else inner.get(p, 0) for p in parts], np.uint32)
            times = np.ones(len(units), np.int64)
            times[unknown] = np.diff(at)
            flat = np.repeat(found, times)
            flat[np.repeat(found == 0, times)] = numbers
            ends = np.concatenate([[0], np.cumsum(times)])[stops].tolist()
            rare = np.flatnonzero(flat == 0)
            first = np.searchsorted(rare, ends).tolist()
            texts = [parts[j] for j in np.flatnonzero(numbers == 0).tolist()]
            low, high = flat.astype("<u2"), (flat >> 16).astype("<u2")
            ids = [small.compress(low[x:y].tobytes() + high[x:y].tobytes()) for x, y in zip(ends, ends[1:], strict=False)]
            left = [small.compress(" ".join(texts[x:y]).encode()) if x < y else None for x, y in zip(first, first[1:], strict=False)]
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "digest", "k1", "k2")), pa.array(ids, pa.binary()), pa.array(left, pa.binary())], ["doc_id", "digest", "k1", "k2", "ids", "rare"])

    def find_rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        large = zstandard.ZstdDecompressor()
        for b in _slices(batches, "rare"):
            units, sizes = [], []
            for x in b.column("rare").to_pylist():
                parts = large.decompress(x).decode().split(" ") if x else []
                units += parts
                sizes.append(len(parts))
            row, nth = np.repeat(np.arange(b.num_rows), sizes), np.arange(len(units)) - np.repeat(np.cumsum([0, *sizes])[:-1], sizes)
            place = b.column("k2").to_numpy()[row] | nth
            yield pa.record_batch([b.column("k1").take(pa.array(row)), pa.array(place, pa.int64()), pa.array(units, pa.string())], ["k1", "place", "unit"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        large, (stops, spelt) = zstandard.ZstdDecompressor(), spelling.value
        lengths = np.diff(stops)
        for b in _slices(batches, "ids", zstandard.frame_content_size):
            raw = [np.frombuffer(large.decompress(x), "<u2").reshape(2, -1) for x in b.column("ids").to_pylist()]
            ends = np.cumsum([0, *(x.shape[1] for x in raw)])
            low, high = np.concatenate(raw, 1).astype(np.int64)
            flat = low | high << 16
            holes = flat == 0
            sizes, values = b.column("extra").value_lengths().fill_null(0).to_numpy(zero_copy_only=False), b.column("extra").flatten()
            row = np.repeat(np.arange(b.num_rows), sizes)
            if not np.array_equal(row, np.searchsorted(ends, np.flatnonzero(holes), "right") - 1):
                raise ValueError("two texts under one id have the same hash")
            ids = values.field("ids").take(pa.array(np.lexsort((values.field("place").to_numpy(), row)))).cast(pa.large_binary())
            at = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
            times = lengths[flat]
            times[holes] = np.diff(at) // id_kind.itemsize
            before = np.concatenate([[0], np.cumsum(times)])
            gaps = np.repeat(holes, times)
            out = np.empty(len(gaps), np.int32)
            out[~gaps] = spelt[(np.arange(len(gaps)) + np.repeat(stops[flat] - before[:-1], times))[~gaps]]
            out[gaps] = np.frombuffer(bytes(ids.buffers()[2] or b""), id_kind, (at[-1] - at[0]) // id_kind.itemsize, at[0])
            lists = pa.ListArray.from_arrays(pa.array(before[ends], pa.int32()), pa.array(out))
            yield pa.record_batch([b.column("doc_id"), b.column("digest"), lists], ["doc_id", "digest", "ids"])

    # A row is known by its id, or a hash of it or, without one, of the text, and by 32 more bits of the text.
    own = F.col("doc_id").cast("long") if id_type in ("tinyint", "smallint", "int", "bigint") else F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id"))
    k1, k2 = F.coalesce(own, F.xxhash64("text")).alias("k1"), F.shiftleft(F.hash("text").cast("long"), 32).alias("k2")
    keyed = rows.select("doc_id", "text", F.xxhash64(F.replace("text", F.lit(SPACE), F.lit(" "))).alias("digest"), k1, k2)
    # Dealt by row once: rare parts are taken from there and come back there. Both Arrow functions take all columns, so that
    # the planner sees one and the same exchange.
    n = partitions(spark, rows)
    looked = keyed.mapInArrow(look_up, f"doc_id {id_type}, digest long, k1 long, k2 long, ids binary, rare binary").repartition(n, "k1", "k2")
    # Where rare parts occur, dealt by part once: the distinct ones become edges, and find their occurrences again, where they are.
    # Both sides take all columns and drop nulls themselves, likewise.
    places = looked.mapInArrow(find_rare, "k1 long, place long, unit string").where("unit IS NOT NULL").repartition(n, "unit")
    distinct = places.groupBy("unit").agg(F.count("*").alias("n"), F.max("k1").alias("k1"), F.max("place").alias("place"))
    rare = _segmented(distinct.where("n > 0 OR k1 > place"), pieces).select("unit", "cuts")
    spelt = places.join(rare, "unit").select("k1", "place", "unit", "cuts").mapInArrow(_speller(pieces, ["k1", "place"]), "k1 long, place long, ids binary")
    spelt = spelt.withColumn("k2", F.shiftleft(F.shiftright("place", 32), 32)).repartition(n, "k1", "k2")
    # A set: equal rows each bring their parts, one of each place is kept.
    extra = spelt.groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "ids")).alias("extra"))
    joined = looked.join(extra, ["k1", "k2"], "left")
    return joined.select("doc_id", "digest", "ids", "rare", "extra").mapInArrow(fill, f"doc_id {id_type}, digest long, ids array<int>")


def decode(encoded: DataFrame, model: str = DEFAULT_MODEL) -> DataFrame:
    """All columns of `encoded` and `decoded`, the text of its `ids`; null ids give the empty text."""
    pieces = Pieces.load(model)
    spelt = [x.replace(SPACE, " ").encode() for x in pieces.names]
    for b, i in enumerate(pieces.byte_ids):
        spelt[i] = bytes([b])
    names = encoded.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                offsets, texts = part.column("ids").offsets.to_pylist(), []
                flat = part.column("ids").values.to_numpy()
                for x, y in zip(offsets, offsets[1:], strict=False):
                    text = b"".join([spelt[i] for i in flat[x:y].tolist()]).decode("utf-8", "replace")
                    texts.append(text[1:] if text.startswith(" ") else text)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*names, "decoded"])

    from pyspark.sql.types import StringType, StructType

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields]).add("decoded", StringType()))
