"""Main text of web pages by a tree-structured graphical model (operator 6).

Every block element of a page is a binary variable: content or not. A node has a potential of its own features (tag, words of class,
id and role, length, share of links), and each parent and child share a potential that depends on the kind of
child. Messages are passed from the leaves to the root and back, which gives the exact marginal of every node, and
a run of text is kept where the marginal of its element is at least one half.

The potentials are fitted to labelled pages by gradient ascent on the conditional likelihood, whose gradient is observed minus
expected features under the same messages. A labelled page is HTML in which ``data-label`` says "1" or "0" for an element and what is below it.
The table of pages has no labels, so the registered query trains on the pages of ``page_labels``, fixed layouts with labels; the model is
a few hundred weights.

Text: character references are decoded, white space inside a block becomes one space, blocks are joined in page
order by two line feeds. Scripts, styles and comments of the markup have no text at all.

Cases: null or empty HTML gives an empty text; a page without tags is one block of the root. Unclosed and wrongly nested tags are closed as
browsers do for paragraphs, list items and cells, else at their parent's end. Repeated rows are judged each. Trees of any depth and width work, as no step
recurses. Other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pagemill.llm.dom_tree import Page, parse

SECTIONS = frozenset("article aside body footer form header main menu nav section table ul ol dl".split())
EDGE_KINDS = ("plain", "section", "named")
EPOCHS = 14
RATE = 0.35
PULL = 0.003


def node_features(page: Page, node: int) -> tuple[str, ...]:
    """Names of the features of a node."""
    tag, parent = page.tag[node], page.parent[node]
    chars, linked = page.chars[node], page.linked[node]
    above = page.tag[parent] if parent >= 0 else ""
    share = "none" if not chars else ("0" if not linked else ("low" if 3 * linked < chars else ("mid" if 3 * linked < 2 * chars else "high")))
    length = "0" if not chars else ("tiny" if chars < 25 else ("short" if chars < 80 else ("mid" if chars < 250 else "long")))
    return ("tag " + tag, "under " + above + " " + tag, "links " + share, "length " + length, *("name " + w for w in dict.fromkeys(page.names[node])))


def edge_kind(page: Page, node: int) -> int:
    return 2 if page.names[node] else (1 if page.tag[node] in SECTIONS else 0)


@dataclass(frozen=True)
class DomModel:
    """Weights of the features of a content node, and log potentials [kind][parent state][child state]."""

    weights: dict[str, float]
    edges: tuple[tuple[tuple[float, float], tuple[float, float]], ...]


def messages(odds: list[float], parent: list[int], edges: list) -> tuple[list[float], list[tuple[float, float]]]:
    """Sum-product on the tree. Returns the marginal of state 1 per node, and per node the message sent to its parent."""
    n = len(odds)
    b0, b1 = [1.0] * n, odds[:]
    up: list[tuple[float, float]] = [(1.0, 1.0)] * n
    for v in range(n - 1, 0, -1):
        (e00, e01), (e10, e11) = edges[v]
        x, y = b0[v], b1[v]
        m0, m1 = e00 * x + e01 * y, e10 * x + e11 * y
        t = m0 + m1
        m0, m1 = m0 / t, m1 / t
        up[v] = (m0, m1)
        p = parent[v]
        x, y = b0[p] * m0, b1[p] * m1
        t = x + y
        b0[p], b1[p] = x / t, y / t
    for v in range(1, n):
        p = parent[v]
        (e00, e01), (e10, e11) = edges[v]
        m0, m1 = up[v]
        x, y = b0[p] / m0, b1[p] / m1
        d0, d1 = x * e00 + y * e10, x * e01 + y * e11
        x, y = b0[v] * d0, b1[v] * d1
        t = x + y
        b0[v], b1[v] = x / t, y / t
    t = b0[0] + b1[0] if n else 1.0
    return [(b1[v] / (b0[v] + b1[v])) for v in range(n)] if t else [], up


def marginals(model: DomModel, page: Page, known: dict | None = None) -> list[float]:
    """Probability of content for every node. ``known`` remembers odds by features."""
    known = {} if known is None else known
    weights = model.weights
    factors = _factors(model)
    odds, edges = [], []
    for v in range(len(page.tag)):
        f = node_features(page, v)
        o = known.get(f)
        if o is None:
            if len(known) > 50_000:
                known.clear()
            o = known[f] = math.exp(max(-20.0, min(20.0, sum(weights.get(x, 0.0) for x in f))))
        odds.append(o)
        edges.append(factors[edge_kind(page, v)])
    return messages(odds, page.parent, edges)[0]


@lru_cache(maxsize=4)
def _factors_of(edges: tuple) -> list:
    return [tuple(tuple(math.exp(x) for x in row) for row in kind) for kind in edges]


def _factors(model: DomModel) -> list:
    return _factors_of(model.edges)


def main_blocks(model: DomModel, html: str | None, known: dict | None = None) -> list[str]:
    """The blocks of main text of a page."""
    page = parse(html)
    if not page.runs:
        return []
    content = marginals(model, page, known)
    return [run for node, run in page.runs if content[node] >= 0.5]


def node_labels(page: Page) -> list[int]:
    """States of a labelled page: elements with text take the nearest label, others what most of the text below is."""
    n = len(page.tag)
    own, yes, total = [0] * n, [0] * n, [0] * n
    for v in range(n):
        given = page.label[v]
        own[v] = int(given) if given is not None else (own[page.parent[v]] if v else 0)
        yes[v], total[v] = own[v] * page.chars[v], page.chars[v]
    for v in range(n - 1, 0, -1):
        yes[page.parent[v]] += yes[v]
        total[page.parent[v]] += total[v]
    return [own[v] if page.chars[v] or not total[v] or page.label[v] is not None else int(2 * yes[v] > total[v]) for v in range(n)]


def train(labelled: Iterable[str], epochs: int = EPOCHS) -> DomModel:
    """Fits the potentials to labelled pages, with per-weight step sizes and a pull towards zero."""
    pages = []
    for html in labelled:
        page = parse(html)
        kinds = [edge_kind(page, v) for v in range(len(page.tag))]
        pages.append((page, [node_features(page, v) for v in range(len(page.tag))], kinds, node_labels(page)))
    w: dict[str, float] = {}
    w_seen: dict[str, float] = {}
    e = np.zeros((len(EDGE_KINDS), 2, 2))
    e_seen = np.full_like(e, 1e-6)
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        for at in rng.permutation(len(pages)):
            page, feats, kinds, y = pages[at]
            factors = np.exp(e)
            tables = [tuple(map(tuple, factors[k].tolist())) for k in range(len(EDGE_KINDS))]
            odds = [math.exp(max(-20.0, min(20.0, sum(w.get(x, 0.0) for x in f)))) for f in feats]
            edges = [tables[k] for k in kinds]
            p, up = messages(odds, page.parent, edges)
            grad: dict[str, float] = {}
            for f, yv, pv in zip(feats, y, p):
                d = yv - pv
                if abs(d) > 1e-4:
                    for x in f:
                        grad[x] = grad.get(x, 0.0) + d
            for x, g in grad.items():
                g -= PULL * w.get(x, 0.0)
                s = w_seen[x] = w_seen.get(x, 1e-6) + g * g
                w[x] = w.get(x, 0.0) + RATE * g / math.sqrt(s)
            eg = -PULL * e
            for v in range(1, len(y)):
                par, k = page.parent[v], kinds[v]
                joint = _pair(p[par], p[v], up[v], odds_below(p[v], up[v], edges[v], p[par]), edges[v])
                eg[k] -= joint
                eg[k, y[par], y[v]] += 1
            e_seen += eg * eg
            e += RATE * eg / np.sqrt(e_seen)
    return DomModel(w, tuple(tuple(map(tuple, k)) for k in e.tolist()))


def odds_below(child: float, up: tuple[float, float], edge, parent: float) -> tuple[float, float]:
    """What the child's own side says of it: its marginal without what came down from the parent."""
    x, y = (1 - parent) / up[0], parent / up[1]
    down = x * edge[0][0] + y * edge[1][0], x * edge[0][1] + y * edge[1][1]
    return (1 - child) / down[0], child / down[1]


def _pair(parent: float, child: float, up: tuple[float, float], below: tuple[float, float], edge) -> np.ndarray:
    """Joint marginal of parent and child."""
    above = (1 - parent) / up[0], parent / up[1]
    joint = np.array([[above[i] * edge[i][j] * below[j] for j in (0, 1)] for i in (0, 1)])
    return joint / joint.sum()


def extract(
    pages: DataFrame, model: DomModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """id, url, the blocks of main text and the text of every page."""
    picked = pages.select(id_col, url_col, html_col)
    kinds = [f.dataType.simpleString() for f in picked.schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for b in batches:
            blocks = [main_blocks(model, h, known) for h in b.column(2).to_pylist()]
            texts = ["\n\n".join(x) for x in blocks]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(blocks, pa.list_(pa.string())), pa.array(texts, pa.string())],
                names=[id_col, url_col, "blocks", "text"],
            )

    return picked.mapInArrow(run, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, blocks array<string>, text string")
