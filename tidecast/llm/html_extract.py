"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element and every run of text is a node with a state: holds article text, or not. A node's
potential is a linear function of its features (tag, words of class and id, those of its ancestors,
links, length, marks); a potential for each parent and child couples them. Sum-product messages, upward from the
leaves and downward from the root, give the exact marginals; a run of text with a marginal of one half
or more belongs to the article. Weights are learned from labelled pages (pairs of a page and its
article): node weights by logistic loss, with a prior around what tag and class names say by themselves,
so that kinds of boilerplate that the labelled pages lack are known too; the coupling by counting.

Every page is parsed whole and on its own. Training takes at most ``MAX_TRAINING_PAGES`` pages, whose
features are made on the executors.

Defined cases: null or empty html, and pages without article text, give an empty text; unclosed, stray
and wrongly nested tags are accepted; scripts, styles, templates, comments and the head are never text;
character references are decoded; without labelled pages the prior decides; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.llm.common import extended
from tidecast.llm.url_rules import path_of

MAX_TRAINING_PAGES = 400
EPOCHS = 30

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript head title svg math object iframe textarea select option canvas".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start closes an open one of the named kinds.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
}
BOILER_TAGS = frozenset("nav header footer aside form menu dialog button fieldset".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
#: Words of class and id that speak against, and for, the article.
BOILER_WORDS = frozenset(
    "nav navbar navigation menu header masthead footer foot sidebar side aside ad ads adv advert adverts advertisement "
    "advertising banner sponsor sponsored promo promotion comment comments commentlist reply replies respond disqus "
    "discussion cookie cookies consent gdpr notice notices notification alert popup modal overlay subscribe subscription "
    "newsletter signup login form search share sharing social related recommended recommendations breadcrumb breadcrumbs "
    "pagination pager tags tagcloud widget widgets toolbar copyright legal disclaimer skip hidden paywall".split()
)
ARTICLE_WORDS = frozenset("article content post entry story main body text prose".split())
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

NAMES = (
    ["bias", "boiler", "under_boiler", "article", "under_article", "heading", "p", "list", "inline", "block", "table", "text"]
    + ["link", "under_link", "links_many", "links_some", "marks", "no_marks", *(f"length_{k}" for k in range(6)), "deep"]
)
INDEX = {n: k for k, n in enumerate(NAMES)}
#: What names say before any page is seen (log odds of article text), and how firmly.
PRIOR = {"boiler": -7.0, "under_boiler": -9.0, "article": 2.0, "under_article": 2.0, "link": -0.5, "under_link": -0.5, "links_many": -1.5, "p": 0.5, "heading": 0.3, "length_5": 0.7, "length_4": 0.5}
FIRM = 0.02


@dataclass
class Node:
    tag: str  # "" for a run of text
    parent: int
    text: str = ""
    words: frozenset = frozenset()
    hidden: bool = False


class _Tree(HTMLParser):
    """Nodes in page order; a parent always comes before its children."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("html", -1)]
        self.open = [0]
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in CLOSES:
            closed, within = CLOSES[tag]
            self._close(closed, within)
        elif tag not in INLINE and tag not in VOID:
            self._close({"p"}, {"button", "table", "td", "th", "li", "article", "section", "div", "main", "aside", "body"})
        node = Node(tag, self.open[-1])
        for name, value in attrs:
            if not value:
                node.hidden |= name == "hidden"
            elif name in ("class", "id"):
                node.words |= {w.lower() for w in _WORDS.findall(value)}
            elif name == "role":
                if value.strip().lower() in BOILER_ROLES:
                    node.words |= {"nav"}
                elif value.strip().lower() in ("main", "article"):
                    node.words |= {"article"}
            elif name == "style" and "display:none" in value.replace(" ", "").lower():
                node.hidden = True
            elif name == "aria-hidden":
                node.hidden |= value.lower() == "true"
        self.nodes.append(node)
        if tag not in VOID:
            self.open.append(len(self.nodes) - 1)
            self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def _pop(self):
        self.silent -= self.nodes[self.open.pop()].tag in SILENT

    def _close(self, tags, within):
        """Close the nearest open element of ``tags``, unless one of ``within`` is nearer."""
        for k in range(len(self.open) - 1, 0, -1):
            tag = self.nodes[self.open[k]].tag
            if tag in tags:
                while len(self.open) > k:
                    self._pop()
                return
            if tag in within:
                return

    def handle_endtag(self, tag):
        if any(self.nodes[k].tag == tag for k in self.open[1:]):
            while self.nodes[self.open[-1]].tag != tag:
                self._pop()
            self._pop()

    def handle_data(self, data):
        if not self.silent and data:
            self.nodes.append(Node("", self.open[-1], data))


def parse(html: str | None) -> list[Node]:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.nodes


def node_features(nodes: list[Node]) -> list[list[int]]:
    """Indexes of the features that each node has."""
    n = len(nodes)
    chars, linked, marks = [0] * n, [0] * n, [0] * n
    boiler, article, link, depth = [False] * n, [False] * n, [False] * n, [0] * n
    own_boiler, own_article = [False] * n, [False] * n
    for k, x in enumerate(nodes):
        up = x.parent
        if x.tag not in ("", "html", "body"):
            own_boiler[k] = x.tag in BOILER_TAGS or x.hidden or not BOILER_WORDS.isdisjoint(x.words)
            own_article[k] = x.tag in ("article", "main") or (not own_boiler[k] and not ARTICLE_WORDS.isdisjoint(x.words))
        if up >= 0:
            boiler[k] = boiler[up] or own_boiler[up]
            article[k] = (article[up] or own_article[up]) and not boiler[k]
            link[k] = link[up] or nodes[up].tag == "a"
            depth[k] = depth[up] + 1
        if not x.tag:
            chars[k] = len(x.text.strip())
            linked[k] = chars[k] if link[k] else 0
            marks[k] = sum(x.text.count(c) for c in ".,;!?")
    for k in range(n - 1, 0, -1):
        up = nodes[k].parent
        chars[up] += chars[k]
        linked[up] += linked[k]
        marks[up] += marks[k]
    of, out = INDEX.__getitem__, []
    for k, x in enumerate(nodes):
        f = [of("bias")]
        for flag, name in ((own_boiler[k], "boiler"), (boiler[k], "under_boiler"), (own_article[k], "article"), (article[k], "under_article"), (link[k], "under_link"), (depth[k] > 8, "deep")):
            if flag:
                f.append(of(name))
        tag = x.tag
        f.append(of("text" if not tag else "link" if tag == "a" else "p" if tag == "p" else "heading" if tag in HEADINGS else "list" if tag in ("li", "ul", "ol", "dl", "dt", "dd") else "table" if tag in ("table", "tr", "td", "th", "tbody") else "inline" if tag in INLINE else "block"))
        share = linked[k] / chars[k] if chars[k] else 0.0
        if share > 0.5:
            f.append(of("links_many"))
        elif share > 0.2:
            f.append(of("links_some"))
        f.append(of("marks" if marks[k] else "no_marks"))
        f.append(of(f"length_{min(5, int(math.log2(chars[k] / 8 + 1)))}"))
        out.append(f)
    return out


@dataclass
class Model:
    weights: list[float]
    couple: list[list[float]]  # log potential by state of parent and child

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of article text for each node, by messages up and down the tree."""
        w, (c00, c01), (c10, c11) = self.weights, *self.couple
        n = len(nodes)
        field = [sum([w[i] for i in f]) for f in node_features(nodes)]  # log odds of the node alone
        up = [0.0] * n  # message to the parent, as log odds of the parent
        total = field[:]  # node and messages from its children
        for k in range(n - 1, 0, -1):
            h = total[k]
            up[k] = _add(c10, c11 + h) - _add(c00, c01 + h)
            total[nodes[k].parent] += up[k]
        belief = total[:]
        for k in range(1, n):
            h = belief[nodes[k].parent] - up[k]  # the parent without this child
            belief[k] = total[k] + _add(c01, c11 + h) - _add(c00, c10 + h)
        return [1 / (1 + math.exp(-min(max(b, -60.0), 60.0))) for b in belief]


def _add(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def assemble(nodes: list[Node], chosen: list[bool]) -> str:
    """Chosen runs of text in page order; the edges of blocks part words, inline tags don't."""
    parts, last_block = [], -1
    block = [0] * len(nodes)
    for k, x in enumerate(nodes):
        block[k] = block[x.parent] if x.parent >= 0 and (not x.tag or x.tag in INLINE) else k
        if x.tag in ("br", "hr"):
            parts.append(" ")
        if not x.tag and chosen[k]:
            if block[k] != last_block:
                parts.append(" ")
            last_block = block[k]
            parts.append(x.text)
        elif x.tag and x.tag not in INLINE:
            last_block = -1
    return " ".join("".join(parts).split())


def main_text(html: str | None, model: Model) -> str:
    nodes = parse(html)
    return assemble(nodes, [p >= 0.5 for p in model.marginals(nodes)])


def label_nodes(nodes: list[Node], article: str) -> list[int]:
    """1 for runs of text found in the article, in words, and for every element that holds one."""
    whole = f" {' '.join(article.split())} "
    out = [0] * len(nodes)
    for k in range(len(nodes) - 1, -1, -1):
        if not nodes[k].tag:
            own = " ".join(nodes[k].text.split())
            out[k] = int(bool(own) and (f" {own} " in whole or (len(own) > 30 and own in whole)))
        if out[k] and nodes[k].parent >= 0:
            out[nodes[k].parent] = 1
    return out


def prior() -> np.ndarray:
    return np.array([PRIOR.get(n, 0.0) for n in NAMES])


def train(pages: list[tuple[list[list[int]], list[int], list[int]]]) -> Model:
    """From (features of nodes, states, parents) of each labelled page."""
    weights = prior()
    counts = np.array([[20.0, 0.05], [2.0, 20.0]])  # a parent without article text has no child with any
    rows, truth = [], []
    for found, states, parents in pages:
        for f, y, up in zip(found, states, parents):
            rows.append(f)
            truth.append(y)
            if up >= 0:
                counts[states[up], y] += 1
    if rows:
        x, y = np.zeros((len(rows), len(NAMES))), np.array(truth, dtype=float)
        for k, f in enumerate(rows):
            x[k, f] = 1
        centre, scale = prior(), np.maximum(x.mean(axis=0), 0.02)
        for _ in range(EPOCHS * 10):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -60, 60)))
            slope = x.T @ (p - y) / len(y) + FIRM * 0.1 * (weights - centre)
            weights -= 0.5 * slope / np.sqrt(scale)
    return Model(weights.tolist(), np.log(counts / counts.sum(axis=1, keepdims=True)).tolist())


def fit(labelled: DataFrame, limit: int = MAX_TRAINING_PAGES) -> Model:
    """Train on at most ``limit`` rows of ``labelled`` (html, article)."""

    def work(batches):
        for batch in batches:
            out = []
            for html, article in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                nodes = parse(html)
                out.append((node_features(nodes), label_nodes(nodes, article or ""), [x.parent for x in nodes]))
            f, y, up = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(f, pa.list_(pa.list_(pa.int32()))), pa.array(y, pa.list_(pa.int32())), pa.array(up, pa.list_(pa.int32()))], ["f", "y", "up"]
            )

    rows = labelled.limit(limit).mapInArrow(work, "f array<array<int>>, y array<int>, up array<int>").toArrow()
    return train(list(zip(*(rows.column(k).to_pylist() for k in range(3)))))


def labelled_by_number(pages: DataFrame, documents: DataFrame, limit: int = MAX_TRAINING_PAGES) -> DataFrame:
    """(html, article): at most ``limit`` pages whose url ends with the number of a document, which is their article.

    The sample is taken by hash before documents are read, so what is sent to them is bounded.
    """
    number = F.regexp_extract(path_of(F.col("url")), r"/(\d{1,18})(?:\.\w+)?/?$", 1)
    mark = F.xxhash64("page_id", "url", F.lit(9))
    numbered = pages.select("html", F.when(number != "", number.cast("long")).alias("doc_id"), mark.alias("mark"))
    able = numbered.filter("doc_id IS NOT NULL AND html IS NOT NULL")
    last = able.select("mark").orderBy("mark").limit(limit).agg(F.max("mark"))
    chosen = able.filter(F.col("mark") <= last.scalar()).select("html", "doc_id").limit(limit)
    articles = documents.select("doc_id", F.col("text").alias("article")).filter("article IS NOT NULL")
    return articles.join(F.broadcast(chosen), "doc_id").select("html", "article")


def extract(pages: DataFrame, model: Model, html_column: str = "html") -> DataFrame:
    """``pages`` without the html, with text and n_chars added."""
    sent = pages.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in pages.columns if c != html_column]
    schema = extended(pages.select(*kept), "text string, n_chars long")

    def work(batches):
        for batch in batches:
            found = [main_text(h, sent.value) for h in batch.column(batch.schema.get_field_index(html_column)).to_pylist()]
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], [*kept, "text", "n_chars"])

    return pages.mapInArrow(work, schema)
