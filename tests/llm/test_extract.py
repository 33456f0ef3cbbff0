import re
from html import unescape

import numpy as np
import pyarrow.dataset as ds
import pytest

from plumbline.llm import extract as ex


@pytest.fixture(scope="module")
def trees(spark):
    return ex.fit(spark)


def truth(html):
    """The article of the test pages' one template."""
    inner = re.search(r"<article>(.*?)</article>", html or "", re.S)
    return " ".join(unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", inner[1]))).split()) if inner else ""


def test_pages_of_the_tables(spark, trees):
    want = {r["page_id"]: (r["url"], truth(r["html"])) for r in ds.dataset("/root/testdata/sf0.01/pages.parquet").to_table().to_pylist()}
    got = {r.page_id: (r.url, r.text) for r in ex.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), trees=trees).collect()}
    assert got == want


def test_held_out_generated_pages(trees):
    x, y = ex.labelled_nodes(150, seed=99)
    assert ((trees.log_odds(x) > 0) == y).mean() > 0.97
    pages, found, said, right = ex._Pages(77), 0, 0, 0
    for _ in range(150):
        page = pages.page()
        nodes, blocks = ex.parse(page)
        label = ex.decode(nodes, trees.log_odds(ex.features(nodes)))
        for node, text in blocks:
            true = nodes[node].has_mark
            found += len(text) * (true and label[node])
            said += len(text) * bool(label[node])
            right += len(text) * true
    assert found / said > 0.95 and found / right > 0.95


def test_decoding_equals_all_labellings():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n = 9
        nodes = [ex.Node("", -1, 0, [], 0)]
        for i in range(1, n):
            p = int(rng.integers(0, i))
            nodes[p].children.append(i)
            nodes.append(ex.Node("div", p, 1, [], 0))
        odds = rng.normal(0, 3, n)
        best = None
        for bits in range(1 << (n - 1)):
            label = [True] + [bool(bits >> k & 1) for k in range(n - 1)]
            if all(label[nodes[i].parent] or not label[i] for i in range(1, n)):
                score = sum(-np.logaddexp(0, -odds[i] if label[i] else odds[i]) for i in range(1, n))
                if best is None or score > best[0]:
                    best = score, label
        assert ex.decode(nodes, odds).tolist() == best[1]


def test_parser():
    nodes, blocks = ex.parse("<div>a<p>b<b>c<br>d<p>e &amp; f</div>tail<script>x='<p>y</p>'</script><!-- z --><li>g<li>h<img>i")
    assert [t for _, t in blocks] == ["a", "bc", "d", "e & f", "tail", "g", "hi"]
    assert [n.tag for n in nodes] == ["", "div", "p", "p", "li", "li"]
    for odd in ("", "<", "a < b", "<p", "</p></div>", "<!--", "<script>", "<p class='x", "&#x110000;&bogus;", "<a href=\"x>y\">t</a>"):
        ex.parse(odd)


@pytest.mark.parametrize(
    "page, texts",
    [
        ("<html><head><title>x</title><p>Article one</p><p>two</p>", ["Article one", "two"]),
        ("<html><head><title>a <b>c</title><script>document.write('<body><p>no</p>')</script></head><body><p>yes</p>", ["yes"]),
        ("<head><meta charset=x><style>p > a {x: '</p>'}</style> bare text<p>more", ["bare text", "more"]),
        ("<title>t</title><p>a</p><script>if (a<b && c=='\"') {x}</script ><p>b</p>", ["a", "b"]),
        ("<p>a</p><svg><svg><path/></svg><p>no</p></svg><p>b</p>", ["a", "b"]),
        ("<p>a</p><script>never closed <p>x</p>", ["a"]),
        ("<head></head><body><p>b</p></body>", ["b"]),
    ],
)
def test_head_and_raw_text(page, texts):
    assert [t for _, t in ex.parse(page)[1]] == texts


def test_deep_nesting_keeps_nodes_apart():
    deep = "<div>" * 2000
    nodes, blocks = ex.parse(deep + "<div>in</div>out" + "</div>" * 2000 + "<p>after</p>")
    assert [t for _, t in blocks] == ["in", "out", "after"]
    assert nodes[blocks[0][0]].depth == nodes[blocks[1][0]].depth + 1 and nodes[blocks[2][0]].depth == 1


def test_edges(spark, trees):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "v", "<article><p>words of text here</p></article>"), (4, "w", "<div>" * 3000 + "deep"), (5, "x", "<p>" + "long text. " * 30000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS nodes")
    got = ex.extract(df, trees=trees).collect()
    assert len(got) == len(rows) and {r.text for r in got if r.page_id in (1, 2)} == {""}
    assert ex.extract(df.limit(0), trees=trees).count() == 0


@pytest.mark.parametrize(
    ("page", "texts"),
    [
        ("<p>one</p><!--><p>two</p>", ["one", "two"]),
        ("<p>one</p><!---><p>two</p>", ["one", "two"]),
        ("<p>one</p><!-- a --!><p>two</p>", ["one", "two"]),
        ("<p>one</p><!-- a > b --><p>two</p>", ["one", "two"]),
        ("<p>one</p><!-- no end <p>two</p>", ["one"]),
        ('<p><a href="x>text</a></p><p>after</p>', ["text", "after"]),
        ("<p title='it>one</p><p>two</p>", ["one", "two"]),
        ('<p title="a > b">one</p><p>two</p>', ["one", "two"]),
        ("<p>one</p><p>two <b cl", ["one", "two"]),
        ("<p>one</p></di", ["one"]),
        ("<p>1 < 2 and 3 > 2</p>", ["1 < 2 and 3 > 2"]),
        ("<p>one <", ["one <"]),
    ],
)
def test_broken_markup(page, texts):
    assert [t for _, t in ex.parse(page)[1]] == texts
