"""Spelling variants: words one edit apart, by forward and backward minimal acyclic automata.

Two words are near if one inserted, deleted or replaced code point makes them equal. Either the edit lies in the second half of a
word, and its near word begins with the same half, or the near word ends with the same other half. So words are looked up twice: in
automata of words, forward, their first half exactly and the rest with one error; in automata of reversed words the same for their
last half. What a backward search finds with an equal first half the forward one has found already, so each near word counts once.

An automaton is minimal and acyclic and numbers its words (a perfect hash): counts of occurrences lie in an array by number. A task has
the automata of a shard of halves; a word is entered under the halves that words of its length and of one more or less can ask for.
Halves with over `BLOCK` words are entered in blocks, each asked by all words of that half, so that no automaton grows with a half.
A word and its half's length and block are the automaton's strings, so what shares a shard by chance does not mix.
Tasks return one row for each asking word, never pairs.

Words come from runs of letters, a typing error made where a checksum says so. Null and empty texts have no words; a null id counts
as an empty one in the checksum. Ties: the smaller word in code-point order. Repeated rows count again. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, id_text, materialize

LEAST_CHARS, LEAST_COUNT, TIMES, ONE_IN = 6, 5, 5, 199
BLOCK = 20_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Automaton:
    """Minimal acyclic automaton of sorted distinct strings; `edges` of a state: character -> (state, words before this edge)."""

    def __init__(self, strings: Iterable[str]):
        self.edges: list[dict[str, tuple[int, int]]] = []
        self.final: list[bool] = []
        self.size: list[int] = []
        self._known: dict[tuple, int] = {}
        # States on the path of the last string are open: [is final, edges to closed states].
        path, last = [[False, []]], ""
        for s in strings:
            same = 0
            while same < min(len(s), len(last)) and s[same] == last[same]:
                same += 1
            self._close(path, last, same)
            path += [[False, []] for _ in s[same:]]
            path[-1][0], last = True, s
        self._close(path, last, 0)
        self.root = self._state(path[0])
        del self._known

    def _close(self, path: list, last: str, depth: int) -> None:
        while len(path) > depth + 1:
            state = self._state(path.pop())
            path[-1][1].append((last[len(path) - 1], state))

    def _state(self, state: list) -> int:
        key = (state[0], tuple(state[1]))
        found = self._known.get(key)
        if found is None:
            before, edges = int(state[0]), {}
            for c, to in state[1]:
                edges[c] = (to, before)
                before += self.size[to]
            found = self._known[key] = len(self.edges)
            self.edges.append(edges)
            self.final.append(state[0])
            self.size.append(before)
        return found

    def walk(self, state: int, number: int, s: str) -> tuple[int, int] | None:
        """(state, number so far) after `s`, if the automaton has it."""
        for c in s:
            step = self.edges[state].get(c)
            if step is None:
                return None
            state, number = step[0], number + step[1]
        return state, number

    def one_error(self, state: int, number: int, rest: str) -> dict[int, str]:
        """Number -> string of the words that go on from `state` by exactly one edit of `rest`; no such edit leaves it as it is."""
        found: dict[int, str] = {}

        def complete(state: int, number: int, head: str, tail: str) -> None:
            at = self.walk(state, number, tail)
            if at and self.final[at[0]]:
                found[at[1]] = head + tail

        for i in range(len(rest) + 1):
            head, tail = rest[:i], rest[i:]
            complete(state, number, head, tail[1:]) if tail else None
            for c, (to, before) in self.edges[state].items():
                complete(to, number + before, head + c, tail)
                if tail and c != tail[0]:
                    complete(to, number + before, head + c, tail[1:])
            step = self.edges[state].get(tail[0]) if tail else None
            if step is None:
                break
            state, number = step[0], number + step[1]
        return found


def words(docs: DataFrame) -> DataFrame:
    """(word, n): words of enough characters that occur often enough, after typing errors."""
    runs = id_text(docs).select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = F.pmod("h", F.length("run").cast("long")).cast("int")
    typed = F.when(F.col("h") % ONE_IN == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    counts = low.select("run", h.alias("h")).select(typed.alias("word")).where(F.length("word") >= LEAST_CHARS).groupBy("word").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def _entries(vocabulary: DataFrame) -> DataFrame:
    """(backward, half, word, n, asks): words under the halves by which they can be found; `asks` where it is their own."""
    lengths = F.array(*(F.length("word") + i for i in (-1, 0, 1)))
    parts = []
    for backward in (False, True):
        own = F.expr("(length(word) + 1) div 2" if backward else "length(word) div 2").cast("int")
        sizes = F.array_distinct(F.transform(F.filter(lengths, lambda m: m >= LEAST_CHARS), lambda m, b=int(backward): F.floor((m + b) / 2).cast("int")))
        row = vocabulary.select(F.lit(backward).alias("backward"), "word", "n", own.alias("own"), F.explode(sizes).alias("k"))
        half = F.expr("right(word, k)" if backward else "left(word, k)")
        parts.append(row.select("backward", half.alias("half"), "word", "n", (F.col("k") == F.col("own")).alias("asks")))
    return parts[0].unionByName(parts[1])


def _shards(entries: DataFrame, total: int, block: int) -> DataFrame:
    """Entries dealt out: `block_no` for what is entered, and a row with `asks` for each block that a word must ask."""
    crowded = entries.groupBy("backward", "half").agg(F.count("*").alias("m")).where(F.col("m") > block).select("backward", "half", F.ceil(F.col("m") / block).cast("int").alias("blocks"))
    met = entries.join(crowded, ["backward", "half"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("word"), F.col("blocks").cast("long")).cast("int")
    rows = met.withColumn("own", own).select("*", F.explode(F.when(F.col("asks"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))).alias("block_no"))
    n_shards = max(1, math.ceil(total / block))
    shard = F.pmod(F.xxhash64("backward", "half", "block_no"), F.lit(n_shards)).cast("int")
    return rows.select("backward", shard.alias("shard"), F.length("half").alias("k"), "block_no", "word", "n", "asks", (F.col("own") == F.col("block_no")).alias("entered"))


def _search(t: pa.Table) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words found here, n of the best, the best) of one direction's shard."""
    if not t.num_rows:
        return
    rows = t.to_pylist()
    backward = rows[0]["backward"]
    turned = (lambda w: w[::-1]) if backward else (lambda w: w)
    tag = lambda r: chr(r["k"]) + chr(r["block_no"] + 1)
    entered = sorted({(tag(r) + turned(r["word"]), r["n"]) for r in rows if r["entered"]})
    found, counts = Automaton(s for s, _ in entered), [n for _, n in entered]
    for r in rows:
        if r["asks"]:
            w = turned(r["word"])
            at = found.walk(found.root, 0, tag(r) + w[: r["k"]])
            if at:
                first = r["word"][: len(w) // 2]
                near = [(-counts[i], turned(w[: r["k"]] + s)) for i, s in found.one_error(*at, w[r["k"] :]).items()]
                near = [x for x in near if not (backward and x[1].startswith(first))]
                if near:
                    n, best = min(near)
                    yield r["word"], len(near), -n, best


def near_words(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """(word, n_near, best, best_n) of (word, n): words without near ones have no row."""

    def run(t: pa.Table) -> pa.Table:
        found = list(_search(t))
        columns = list(zip(*found, strict=True)) if found else [[]] * 4
        return pa.table({"word": pa.array(columns[0], pa.string()), "m": pa.array(columns[1], pa.int64()), "best_n": pa.array(columns[2], pa.int64()), "best": pa.array(columns[3], pa.string())})

    entries = _entries(vocabulary)
    shards = _shards(entries, 4 * vocabulary.count(), block)
    parts = shards.groupBy("backward", "shard").applyInArrow(run, "word string, m long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return parts.groupBy("word").agg(F.sum("m").alias("n_near"), best).select("word", "n_near", F.col("b.word").alias("best"), (-F.col("b.n")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last form that forms lead to. Counts grow along forms, so chains end; each round doubles the steps taken."""
    known = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        hop = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = materialize(known.join(hop, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(known)
        known = after.select("word", "root")
        if not after.where("moved").limit(1).count():
            return known


def group(docs: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all words: `form` is the near word of most occurrences, if it has `times` as many."""
    vocabulary = materialize(words(docs))
    best = materialize(vocabulary.join(near_words(vocabulary), "word", "left"))
    frequent = F.col("best_n") >= times * F.col("n")
    named = best.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(frequent, F.col("best")).alias("form"), F.when(frequent, F.col("best_n")).alias("form_n"))
    last = roots(named.where("form IS NOT NULL"))
    return named.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
