import math
import zlib
from collections import Counter

import numpy as np
import pytest

from plumbline.llm import treeweight as tw

from .rows import HARD, documents, empty, hard


def low(t):
    return (t or "").encode().translate(tw._LOWER)


def is_held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def test_log_gamma():
    x = np.concatenate([np.arange(0.5, 40, 0.5), [1e3 + 0.5, 1e7]])
    assert np.allclose(tw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-11, atol=1e-11)


class Tree:
    """Context-tree weighting by recursion over nodes."""

    def __init__(self, texts, depth=tw.DEPTH):
        self.depth, self.count, self.children = depth, {}, {}
        for t in texts:
            for i, x in enumerate(t + b"\0"):
                ctx = (b"\0" * depth + t)[i : i + depth]
                for d in range(depth + 1):
                    c = ctx[depth - d :]
                    for j in range(8):
                        node = (c, (1 << j) | x >> (8 - j))
                        self.count.setdefault(node, [0, 0])[x >> (7 - j) & 1] += 1
                        if d:
                            self.children.setdefault((c[1:], node[1]), set()).add(node)
        self.memo = {}

    def weighted(self, node):
        if node not in self.memo:
            a, b = self.count[node]
            e = math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
            w = e
            if len(node[0]) < self.depth:
                kids = sum(self.weighted(k)[1] for k in self.children[node])
                w = float(np.logaddexp(e, kids)) - math.log(2)
            self.memo[node] = e, w
        return self.memo[node]

    def predict(self, ctx, node, bit, d=0):
        c = ctx[self.depth - d :]
        if (c, node) not in self.count:
            return 0.5
        n = self.count[c, node]
        own = (n[bit] + 0.5) / (sum(n) + 1)
        if d == self.depth:
            return own
        e, w = self.weighted((c, node))
        beta = math.exp(e - math.log(2) - w)
        return beta * own + (1 - beta) * self.predict(ctx, node, bit, d + 1)

    def score(self, t):
        total = 0.0
        for i, x in enumerate(t + b"\0"):
            ctx = (b"\0" * self.depth + t)[i : i + self.depth]
            total += sum(math.log10(self.predict(ctx, (1 << j) | x >> (8 - j), x >> (7 - j) & 1)) for j in range(8))
        return total


def want(rows):
    train = [low(t) for i, t in rows if not is_held(i)]
    tree, words = Tree(train), Counter(w for t in train for w in t.split())
    n, v = sum(words.values()) + len(train), len(words) + bool(train)
    words[None] = len(train)
    out = []
    for i, t in rows:
        tokens = [*low(t).split(), None]
        base = sum(math.log10((words[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens)
        out.append((str(i), is_held(i), len(tokens), sum(words[w] > 0 for w in tokens), n, base, tree.score(low(t))))
    return sorted(out)


def got(df, **k):
    return sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in tw.score(df, **k).collect())


def same(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x[:5] == y[:5]
        assert x[5:] == pytest.approx(y[5:], rel=1e-5, abs=1e-5)


def test_equals_brute_force(spark, sf):
    rows = [(i, t[:600]) for i, t in documents(sf)[:50]] + [(i, t and t[:300]) for i, t in HARD] + [(30, "new zygote ßß"), (30, "new zygote ßß")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = want(rows)
    same(got(df), expected)
    same(got(df, table_words=20, block_rows=4000), expected)


def test_edges(spark):
    assert got(empty(spark)) == []
    assert len(got(hard(spark))) == len(HARD)
    only_held = [(i, "text of one") for i in range(60) if is_held(i)]
    same(got(spark.createDataFrame(only_held, "doc_id long, text string")), want(only_held))


def test_probabilities_sum_to_one():
    grams = np.unique(tw.gram_stream([b"abracadabra", b"alakazam abra"])[0], return_counts=True)
    levels = tw.grow(*grams, least=0)
    for ctx in (0, int(grams[0][3]) >> 8, 123456):
        assert np.isclose((10 ** tw.log10_probability((ctx << 8) + np.arange(256), levels)).sum(), 1)


def test_beats_the_word_model_on_held_out_text(spark):
    rows = [r for r in tw.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)
