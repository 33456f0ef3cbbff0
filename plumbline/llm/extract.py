"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the tree.

Block elements are the nodes; inline markup belongs to the block around it. A node's label is whether its subtree
holds any of the article. The trees see tag, attribute tokens of the node and its ancestors, depth, the subtree's
text, link and punctuation density, and its siblings. Decoding finds the most probable labelling in which no
node under a rejected one is accepted and no parent of an accepted one is rejected, exactly, bottom up.
What is output is the text directly in accepted nodes, in page order.

The trees are fitted by Spark ML on `TRAIN_PAGES` generated pages of known content (a fixed bound, whatever
the corpus), as the tables carry no labels.

Null and empty html give the empty text. Repeated rows each get their row; other columns are ignored. Very long pages
are read whole, however deep they nest. The tags of head and body may be left out: the first element or text that a head
cannot hold ends it.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_PAGES, N_TREES, TREE_DEPTH, SEED = 500, 20, 5, 11
_CHARS = 4_000_000  # of html looked at together

# HTML's element kinds.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data dfn em font i kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
HIDDEN = set("iframe math noscript object script select style svg template textarea title".split())
#: Elements whose content is text up to their end tag, whatever it looks like.
RAW = set("iframe noscript script style textarea title".split())
IN_HEAD = set("base basefont link meta noscript script style template title".split())
BREAKS = {"br", "hr"}
#: A start tag of the key closes open elements of the values.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSED_BY_BLOCK = {"p"}
TAG_GROUPS = ["p", "h1 h2 h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "div", "section", "article", "main", "nav", "header", "footer", "aside", "form fieldset button", "table tbody thead tr td th", "html body", "blockquote pre figure"]
TOKEN_GROUPS = [
    "article post entry story hentry blogpost", "content main body text page primary", "nav menu navbar topbar breadcrumb breadcrumbs pagination pager links toc",
    "sidebar aside side rail widget secondary", "footer foot bottom copyright legal", "header head masthead top brand logo",
    "ad ads advert advertisement adsense banner sponsor sponsored promo promotion", "comment comments disqus reply replies discussion respond reader",
    "cookie cookies consent notice notices alert warning gdpr popup modal overlay message", "share social follow subscribe newsletter signup login search form",
    "related recommended more popular trending also tags meta author byline",
]
_TAG_OF = {t: i for i, g in enumerate(TAG_GROUPS) for t in g.split()}
_TOKEN_OF = {t: i for i, g in enumerate(TOKEN_GROUPS) for t in g.split()}
_MARK = "\ue000"  # private use: in generated pages, in front of article text

# A tag whose quotes never end stops at its first ">"; markup that the page's end cuts off is no text.
_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*|[^>]*)>|<(?:/?[a-zA-Z]|[!?])[^>]*\Z", re.S
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(id|class|role|name|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPLIT = re.compile(r"[a-z]+")
_PUNCTUATION = re.compile(r"[.,;:!?]")


@dataclass
class Node:
    tag: str
    parent: int
    depth: int
    tokens: list[int]
    order: int  # among its siblings
    children: list[int] = field(default_factory=list)
    blocks: list[int] = field(default_factory=list)
    chars: int = 0
    words: int = 0
    linked: int = 0
    marks: int = 0
    tags: int = 1
    paragraphs: int = 0
    has_mark: bool = False


def parse(html: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """The page's block elements (the first is a root), and its blocks of text as (node, text), in page order."""
    nodes, blocks, stack, parts = [Node("", -1, 0, [], 0)], [], [0], []
    hidden, depth_hidden, in_head, in_link, linked = "", 0, False, 0, 0

    def close_block() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            parts.clear()
            if text:
                node = nodes[stack[-1]]
                node.blocks.append(len(blocks))
                if _MARK in text:
                    node.has_mark, text = True, text.replace(_MARK, "")
                blocks.append((stack[-1], text))
                node.chars += len(text)
                node.words += text.count(" ") + 1
                node.linked += min(linked, len(text))
                node.marks += len(_PUNCTUATION.findall(text))
        linked = 0

    def close(n: int) -> None:
        """All but the n outermost open elements."""
        close_block()
        del stack[n:]

    at = 0
    while m := _TOKEN.search(html, at):
        if not hidden and m.start() > at:
            text = html[at : m.start()]
            if in_head and not text.isspace():
                in_head = False
            if not in_head:
                parts.append(text)
                linked += len(text) if in_link else 0
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if hidden:  # an element of markup that is not shown, with others of its name within
            depth_hidden += (-1 if m[1] else not m[3].endswith("/")) if tag == hidden else 0
            hidden = hidden if depth_hidden else ""
            continue
        if tag == "head" or in_head and m[1] and tag in IN_HEAD:
            in_head = not m[1]
            continue
        if in_head and tag not in IN_HEAD:
            in_head = False
        if m[1]:  # an end tag
            if tag == "a":
                in_link = 0
            if tag in INLINE or tag in VOID:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if nodes[stack[i]].tag == tag:
                    close(i)
                    break
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}[^a-z0-9]", re.I).search(html, at)
            close_at = html.find(">", end.start()) if end else -1
            at = close_at + 1 if close_at >= 0 else len(html)
            continue
        if tag in HIDDEN:
            if not m[3].endswith("/"):
                hidden, depth_hidden = tag, 1
            continue
        if in_head:
            continue
        if tag in VOID or tag in INLINE:
            in_link = 1 if tag == "a" else in_link
            if tag in BREAKS:
                close_block()
            continue
        close_block()
        ends = CLOSES.get(tag, CLOSED_BY_BLOCK)
        while len(stack) > 1 and nodes[stack[-1]].tag in ends:
            stack.pop()
        in_link = 0
        if m[3].endswith("/"):
            continue
        tokens = [_TOKEN_OF[t] for a in _ATTRIBUTE.finditer(m[3]) for t in _SPLIT.findall((a[2] or a[3] or a[4] or "").lower()) if t in _TOKEN_OF] if m[3] else []
        parent = nodes[stack[-1]]
        parent.children.append(len(nodes))
        nodes.append(Node(tag, stack[-1], len(stack), tokens, len(parent.children) - 1))
        stack.append(len(nodes) - 1)
    if not hidden and at < len(html) and not (in_head and html[at:].isspace()):
        parts.append(html[at:])
    close_block()
    return nodes, blocks


def features(nodes: list[Node]) -> np.ndarray:
    """One row for each node. Fills in subtree sums on the way."""
    n = len(nodes)
    own = np.array([(x.chars, x.words, x.linked, x.marks, 1, x.tag == "p") for x in nodes], float)
    total = own.copy()
    for i in range(n - 1, 0, -1):  # children come after their parents
        total[nodes[i].parent] += total[i]
    groups, tokens = len(TAG_GROUPS), len(TOKEN_GROUPS)
    tag, mine, above, over = np.zeros((n, groups)), np.zeros((n, tokens)), np.zeros((n, tokens)), np.zeros((n, groups))
    rest = np.zeros((n, 8))
    for i, x in enumerate(nodes):
        g = _TAG_OF.get(x.tag, -1)
        if g >= 0:
            tag[i, g] = 1
        for t in x.tokens:
            mine[i, t] = 1
        if i:
            above[i], over[i] = above[x.parent], over[x.parent]
            above[i] = np.maximum(above[i], mine[x.parent])
            over[i] = np.maximum(over[i], tag[x.parent])
            family = nodes[x.parent].children
            before = total[family[x.order - 1], 0] if x.order else 0
            after = total[family[x.order + 1], 0] if x.order + 1 < len(family) else 0
            rest[i] = (x.depth, x.order, len(family), math.log1p(before), math.log1p(after), total[i, 0] / max(1, total[x.parent, 0]), len(x.children), 0)
    chars = np.maximum(total[:, 0], 1)
    dense = np.column_stack(
        [
            np.log1p(total[:, 0]), np.log1p(own[:, 0]), total[:, 0] / total[:, 4], total[:, 2] / chars, total[:, 3] / np.maximum(total[:, 1], 1),
            total[:, 0] / np.maximum(total[:, 1], 1), total[:, 5], total[:, 0] / max(1.0, total[0, 0]),
        ]
    )
    return np.column_stack([tag, mine, above, over, rest, dense]).astype(np.float32)


@dataclass
class Trees:
    """Flat arrays of all trees; `value` counts at leaves, whose children are themselves."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: list[int]
    depth: int

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 2 * total  # Spark ML's logistic loss takes labels -1 and 1


def decode(nodes: list[Node], log_odds: np.ndarray) -> np.ndarray:
    """The most probable labels in which a rejected node has only rejected ones below it."""
    yes, no = -np.logaddexp(0, -log_odds), -np.logaddexp(0, log_odds)
    for i in range(len(nodes) - 1, 0, -1):
        p = nodes[i].parent
        yes[p] += max(yes[i], no[i])
        no[p] += no[i]
    label = np.zeros(len(nodes), bool)
    label[0] = True
    for i in range(1, len(nodes)):
        label[i] = label[nodes[i].parent] and yes[i] > no[i]
    return label


# --- generated pages to learn from ---


class _Pages:
    """Pages in a handful of layouts, with article text marked."""

    def __init__(self, seed: int):
        self.rng = random.Random(seed)

    def words(self, a: int, b: int, mark: bool = False) -> str:
        r = self.rng
        ws = ["".join(r.choice(("an", "el", "or", "ti", "ou", "sch", "qu", "ed", "é", "ing", "ra", "b")) for _ in range(r.randrange(1, 5))) for _ in range(r.randrange(a, b))]
        for i in range(len(ws)):
            if r.random() < 0.12:
                ws[i] += r.choice([".", ",", ".", "?", "&amp;&amp;", "###", "%%%", ";", " |"])
        return (_MARK if mark else "") + " ".join(ws).capitalize() + r.choice([".", ".", "", "!"])

    def box(self, tag: str, names: str, inner: str) -> str:
        r = self.rng
        name = r.choice(names.split()) if names and r.random() < 0.8 else ""
        attribute = f' {r.choice(["class", "id", "class"])}="{name}{r.choice(["", "", "-box", " wide", "-1"])}"' if name else ""
        return f"<{tag}{attribute}>{inner}" + (f"</{tag}>" if r.random() < 0.98 or tag not in ("p", "li") else "")

    def links(self, a: int, b: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(1, 4)}</a></li>' for i in range(self.rng.randrange(a, b))) + "</ul>"

    def noise(self) -> str:
        r, k = self.rng, self.rng.randrange(12)
        text = f"<p>{self.words(4, 40)}</p>" if r.random() < 0.6 else self.words(3, 25)
        if k == 0:
            return self.box(r.choice(["nav", "div", "ul", "nav"]), TOKEN_GROUPS[2], self.links(3, 12))
        if k in (1, 2):
            return self.box(r.choice(["aside", "div", "section"]), TOKEN_GROUPS[3], f"<h3>{self.words(1, 5)}</h3>" + r.choice([self.links(2, 8), text]))
        if k in (3, 4):
            return self.box("div" if r.random() < 0.8 else "section", TOKEN_GROUPS[6], text).replace("<div>", '<div class="ad">', 1)
        if k == 5:
            return self.box(r.choice(["div", "section"]), TOKEN_GROUPS[8], text + r.choice(["", "<button>Ok</button>"])).replace("<div>", '<div class="notice">', 1)
        if k == 6:
            inner = "".join(f"<div class=\"comment\"><b>{self.words(1, 3)}</b><p>{self.words(5, 60)}</p></div>" for _ in range(r.randrange(1, 6)))
            return '<section class="comments"><h2>Comments</h2>' + inner + "</section>" if r.random() < 0.5 else f'<div id="{r.choice(["comments", "disqus", "discussion", "respond"])}">{inner}</div>'
        if k == 7:
            return f"<form action=\"/s\">{self.words(1, 6)}<input name=q><label>{self.words(1, 4)}</label><button>Go</button></form>"
        if k == 8:
            return self.box("div", TOKEN_GROUPS[9], self.links(2, 6)).replace("<div>", '<div class="share">', 1)
        if k == 9:
            return self.box(r.choice(["div", "section"]), TOKEN_GROUPS[10], f"<h4>{self.words(1, 4)}</h4>" + self.links(2, 7))
        if k == 10:
            return self.box("header", TOKEN_GROUPS[5], f"<h2>{self.words(1, 5)}</h2>" + r.choice(["", self.links(2, 6), text]))
        return self.box("footer", TOKEN_GROUPS[4], "&copy; " + text)

    def article(self) -> str:
        r, out = self.rng, []
        if r.random() < 0.85:
            out.append(f"<h1>{self.words(1, 14, True)}</h1>")
        for _ in range(r.randrange(1, 14)):
            k = r.random()
            if k < 0.7:
                start = r.choice(["", "", "<b>", "<em>", "<a href=x>"])
                out.append(f"<p>{start}{self.words(1, r.choice([4, 30, 120]), True)}" + r.choice(["</p>", "</p>", "</p>", "<br>"]))
            elif k < 0.78:
                out.append(f"<h2>{self.words(1, 8, True)}</h2>")
            elif k < 0.84:
                out.append("<ul>" + "".join(f"<li>{self.words(2, 20, True)}</li>" for _ in range(r.randrange(1, 6))) + "</ul>")
            elif k < 0.88:
                out.append(f"<blockquote><p>{self.words(5, 40, True)}</p></blockquote>")
            elif k < 0.9:
                out.append("<table>" + "".join(f"<tr><td>{self.words(1, 4, True)}</td><td>{self.words(1, 9, True)}</td></tr>" for _ in range(r.randrange(1, 5))) + "</table>")
            elif k < 0.93:
                out.append(f"<div>{self.words(10, 60, True)}</div>")
            else:
                out.append(self.noise() if k < 0.96 else "<!-- x --><script>var t='</p>';</script>")
        return "".join(out)

    def page(self) -> str:
        r = self.rng
        inner = self.article()
        tag, names = r.choice([("article", ""), ("article", TOKEN_GROUPS[0]), ("main", ""), ("div", TOKEN_GROUPS[0]), ("div", TOKEN_GROUPS[1]), ("section", TOKEN_GROUPS[1]), ("article", "")])
        body = self.box(tag, names, inner)
        if tag == "div" and body.startswith("<div>"):
            body = f'<div class="content">{inner}</div>'
        if r.random() < 0.4:
            body = self.box(r.choice(["div", "main", "section"]), r.choice(["", "wrapper container", TOKEN_GROUPS[1]]), body + (self.noise() if r.random() < 0.5 else ""))
        before = [self.noise() for _ in range(r.randrange(0, 4))]
        after = [self.noise() for _ in range(r.randrange(0, 4))]
        if r.random() < 0.7:
            before.insert(0, self.box("nav", "", self.links(3, 9)))
        if r.random() < 0.7:
            after.append(f"<footer>&copy; {self.words(1, 3)} &middot; {self.words(3, 25)}</footer>")
        if r.random() < 0.5:
            before.append(f'<!-- ad {r.randrange(9)} --><div class="ad">{self.words(3, 20)}</div>')
        end = r.choice(["</body></html>", "</body></html>", ""])
        return f'<!DOCTYPE html><html lang="x"><head><meta charset="utf-8"><title>{self.words(1, 9)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>{"".join(before)}{body}{"".join(after)}{end}'


def labelled_nodes(n_pages: int = TRAIN_PAGES, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    pages = _Pages(seed)
    for _ in range(n_pages):
        nodes, _ = parse(pages.page())
        y = np.array([x.has_mark for x in nodes])
        for i in range(len(nodes) - 1, 0, -1):
            y[nodes[i].parent] |= y[i]
        xs.append(features(nodes)[1:])
        ys.append(y[1:])
    return np.concatenate(xs), np.concatenate(ys)


_fitted: dict[tuple, Trees] = {}


def fit(spark: SparkSession, n_pages: int = TRAIN_PAGES, n_trees: int = N_TREES, depth: int = TREE_DEPTH, seed: int = SEED) -> Trees:
    """Boosted trees from generated pages; kept in the driver, as they depend on nothing else."""
    key = (n_pages, n_trees, depth, seed)
    if key in _fitted:
        return _fitted[key]
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    x, y = labelled_nodes(n_pages, seed)
    names = [f"f{i}" for i in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=names).assign(label=y.astype(float))
    rows = VectorAssembler(inputCols=names, outputCol="features").transform(spark.createDataFrame(pdf)).select("features", "label").coalesce(4)
    model = GBTClassifier(maxIter=n_trees, maxDepth=depth, seed=seed, stepSize=0.3).fit(rows)
    arrays: dict[str, list] = {k: [] for k in ("feature", "threshold", "left", "right", "value")}

    def add(node, weight: float) -> int:
        at = len(arrays["feature"])
        leaf = node.subtreeDepth() == 0
        split = None if leaf else node.split()
        for k, v in {"feature": 0 if leaf else split.featureIndex(), "threshold": 0.0 if leaf else split.threshold(), "left": at, "right": at, "value": weight * node.prediction()}.items():
            arrays[k].append(v)
        if not leaf:
            arrays["left"][at] = add(node.leftChild(), weight)
            arrays["right"][at] = add(node.rightChild(), weight)
        return at

    roots = [add(t._java_obj.rootNode(), w) for t, w in zip(model.trees, model.treeWeights, strict=True)]
    _fitted[key] = Trees(*(np.array(v) for v in arrays.values()), roots, depth)
    return _fitted[key]


def texts_of(pages: list[str | None], trees: Trees) -> Iterator[str]:
    """The main text of each page, looking at about _CHARS characters together."""
    some, size = [], 0
    for i, page in enumerate(pages):
        some.append(parse(page or ""))
        size += len(page or "")
        if size < _CHARS and i + 1 < len(pages):
            continue
        odds, at = trees.log_odds(np.concatenate([features(nodes) for nodes, _ in some])), 0
        for nodes, blocks in some:
            label = decode(nodes, odds[at : at + len(nodes)])
            at += len(nodes)
            yield " ".join(text for node, text in blocks if label[node])
        some, size = [], 0


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", trees: Trees | None = None) -> DataFrame:
    """(page_id, url, text) of every row."""
    trees = trees or fit(pages.sparkSession)
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                texts = list(texts_of(b.column("html").to_pylist(), trees))
                yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {kind('page_id')}, url {kind('url')}, text string")
