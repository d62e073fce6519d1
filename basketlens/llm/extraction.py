"""HTML extraction: gradient-boosted trees over DOM nodes, decoded along the tree.

Every block element and text block of a page is described by numbers (dom.features) and
gets a probability of holding main text. Decoding takes the most probable labelling of the
tree in which nothing inside a rejected node is kept, so an ancestor and its
descendants cannot contradict each other. Kept text blocks, in page order, are the article.

The trees are Spark ML's, fitted on pages that training_pages makes from a seed: their layouts,
element names, attribute words and texts vary, and each node's label is known. Tables of pages carry no
labels, so nothing of the input is learnt from. A page is worked on in its own row.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.llm.dom import Node, features, nodes_of, parse
from basketlens.llm.tables import narrow, prepared

TRAINING_PAGES = 600
# Blocks of the articles of made pages, each as likely.
ARTICLE_BLOCKS = (1, 1, 2, 3, 5, 8, 14, 20, 60, 120)
TREES = 25
DEPTH = 5
# Marks in the texts of training pages by which their labels are known; never in real input.
KEPT, LEFT = "\x01", "\x02"


@dataclass
class Forest:
    """The fitted trees as arrays: feature, threshold and children of every node, value of every leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    @staticmethod
    def of(model) -> Forest:
        rows: list[list[float]] = []
        roots = []

        def add(node, weight: float) -> int:
            k = len(rows)
            rows.append([0, np.inf, k, k, 0.0])
            if node.getClass().getSimpleName() == "LeafNode":
                rows[k][4] = node.prediction() * weight
            else:
                split = node.split()
                left, right = add(node.leftChild(), weight), add(node.rightChild(), weight)
                rows[k] = [split.featureIndex(), split.threshold(), left, right, 0.0]
            return k

        for tree, weight in zip(model._java_obj.trees(), model.treeWeights):
            roots.append(add(tree.rootNode(), weight))
        feature, threshold, left, right, value = (np.array(c) for c in zip(*rows))
        return Forest(
            feature.astype(int), threshold, left.astype(int), right.astype(int), value, np.array(roots), DEPTH
        )

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
            total += self.value[at]
        return 1 / (1 + np.exp(-2 * total))


def decoded(nodes: list[Node], probability: np.ndarray) -> list[bool]:
    """The most probable labels in which a kept node's parent is kept; ties are rejected."""
    p = np.clip(probability, 1e-6, 1 - 1e-6)
    keep, drop = np.log(p), np.log(1 - p)
    dropped = drop.copy()
    gain = keep.copy()
    for i in range(len(nodes) - 1, 0, -1):
        up = nodes[i].parent.at
        dropped[up] += dropped[i]
        gain[up] += max(gain[i], dropped[i])
    out = [False] * len(nodes)
    for i, node in enumerate(nodes):
        # The root holds the page, whatever is kept of it.
        out[i] = node.parent is None or (out[node.parent.at] and bool(gain[i] > dropped[i]))
    return out


def main_text(forest: Forest, pages: list[str]) -> list[str]:
    """Main texts of pages, all their nodes scored at once."""
    trees = [nodes_of(parse(p)) for p in pages]
    rows = [features(nodes) for nodes in trees]
    stops = np.cumsum([0, *map(len, rows)])
    found = forest.probabilities(np.concatenate(rows)) if rows else np.zeros(0)
    out = []
    for nodes, a, b in zip(trees, stops, stops[1:]):
        kept = decoded(nodes, found[a:b])
        out.append("\n\n".join(n.text for n, k in zip(nodes, kept) if k and n.tag == "#text"))
    return out


# --- training pages -----------------------------------------------------------------------------

_SYLLABLES = "the an er on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ö ä é ç ñ".split()


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(_SYLLABLES) for _ in range(rng.choice((1, 1, 1, 2, 2, 3, 4))))


def _sentence(rng: random.Random, low: int, high: int) -> str:
    text = " ".join(_word(rng) for _ in range(rng.randint(low, high)))
    return text[:1].upper() + text[1:] + rng.choice((".", ".", ".", ".", "?", "!", ""))


def _text(rng: random.Random, mark: str, low: int, high: int, sentences: int) -> str:
    return mark + " ".join(_sentence(rng, low, high) for _ in range(rng.randint(1, sentences)))


def _open(rng: random.Random, tags: str, names: str) -> tuple[str, str]:
    """Start and end tag of one of `tags`, mostly with one of `names` as class or id."""
    tag = rng.choice(tags.split())
    if rng.random() < (0.8 if tag in ("div", "section", "ul") else 0.45):
        name = rng.choice(names.split())
        extra = rng.choice(("", "", " clearfix", " col-8", f" x{rng.randint(0, 99)}"))
        return f'<{tag} {rng.choice(("class", "class", "id"))}="{name}{extra}">', f"</{tag}>"
    return f"<{tag}>", f"</{tag}>"


def _links(rng: random.Random, count: int, words: int = 2) -> str:
    items = (f'<a href="/{_word(rng)}">{_text(rng, LEFT, 1, words, 1)}</a>' for _ in range(count))
    shape = rng.random()
    if shape < 0.6:
        return "<ul>" + "".join(f"<li>{x}</li>" for x in items) + "</ul>"
    return ("<br>" if shape < 0.7 else " | " if shape < 0.8 else " ").join(items)


def _wrapped(rng: random.Random, tags: str, names: str, inside: str) -> str:
    start, end = _open(rng, tags, names)
    return start + inside + end


def _paragraphs(rng: random.Random, mark: str, count: int) -> str:
    return "".join(f"<p>{_text(rng, mark, 3, 25, 3)}</p>" for _ in range(count))


def _boilerplate(rng: random.Random, kind: str) -> str:
    short = lambda: _text(rng, LEFT, 2, 14, 2)
    if kind == "nav":
        return _wrapped(rng, "nav nav div ul", "nav menu navbar main-menu navigation breadcrumb", _links(rng, rng.randint(3, 9)))
    if kind == "header":
        return _wrapped(rng, "header header div", "header masthead site-header banner topbar", f"<h1>{short()}</h1>" * rng.randint(0, 1) + f"<div class='logo'>{short()}</div>" + _links(rng, rng.randint(0, 5)))
    if kind == "footer":
        return _wrapped(rng, "footer footer div", "footer site-footer copyright bottom", rng.choice(("&copy; ", "", "&copy; 2024 ")) + f"<p>{short()}</p>" * rng.randint(0, 2) + (short() if rng.random() < 0.7 else "") + _links(rng, rng.randint(0, 4)))
    if kind == "side":
        return _wrapped(rng, "aside aside div", "sidebar widget related side recommended popular", f"<h3>{short()}</h3>" + (_links(rng, rng.randint(2, 8), 8) if rng.random() < 0.7 else _paragraphs(rng, LEFT, rng.randint(1, 3))))
    if kind == "comments":
        one = lambda: _wrapped(rng, "div li article p", "comment reply comment-body", f"<b>{short()}</b><p>{_text(rng, LEFT, 3, 20, 4)}</p>")
        return _wrapped(rng, "section div ol", "comments discussion replies comment-list disqus", f"<h2>{short()}</h2>" * rng.randint(0, 1) + "".join(one() for _ in range(rng.randint(1, 6))))
    if kind == "ad":
        return _wrapped(rng, "div div aside section", "ad ads advert sponsored promo ad-banner advertisement", rng.choice((short(), f"<p>{_text(rng, LEFT, 4, 20, 3)}</p>", _links(rng, 1, 8))))
    if kind == "notice":
        return _wrapped(rng, "div div section", "cookie-notice consent alert notice newsletter popup gdpr", f"<p>{_text(rng, LEFT, 5, 20, 3)}</p>" + rng.choice(("", "<button>OK</button>")))
    if kind == "form":
        return f"<form{rng.choice(('', ' class=search', ' id=login'))}><label>{short()}</label><input type=text>" + rng.choice(("", f"<p>{short()}</p>", "<textarea>x</textarea>", f"<select><option>{short()}</option></select>")) + "<button>Go</button></form>"
    return _wrapped(rng, "div ul p", "share social tags meta byline", _links(rng, rng.randint(2, 5)))


def _article(rng: random.Random) -> str:
    out = [f"<h1>{_text(rng, KEPT, 3, 12, 1)}</h1>" if rng.random() < 0.85 else ""]
    for _ in range(rng.choice(ARTICLE_BLOCKS)):
        kind = rng.random()
        if kind < 0.72:
            text = _text(rng, KEPT, rng.choice((1, 3, 6)), rng.choice((6, 18, 30)), rng.choice((1, 3, 6)))
            if rng.random() < 0.2:
                text += f' <a href="#">{_sentence(rng, 1, 4)}</a> {_sentence(rng, 2, 9)}'
            out.append(f"<p>{text}</p>" if rng.random() < 0.85 else f"<p><b>{text}<br>")
        elif kind < 0.8:
            out.append(f"<h{rng.randint(2, 4)}>{_text(rng, KEPT, 1, 8, 1)}</h3>")
        elif kind < 0.88:
            out.append("<ul>" + "".join(f"<li>{_text(rng, KEPT, 1, 12, 1)}</li>" for _ in range(rng.randint(2, 6))) + "</ul>")
        elif kind < 0.93:
            out.append(f"<blockquote>{_text(rng, KEPT, 4, 18, 2)}</blockquote>")
        elif kind < 0.96:
            cells = "".join(f"<td>{_text(rng, KEPT, 1, 3, 1)}</td>" for _ in range(3))
            out.append(f"<table><tr>{cells}</tr><tr>{cells}</tr></table>")
        else:
            # What is not of the article may lie inside it.
            out.append(_boilerplate(rng, rng.choice(("ad", "side", "share", "notice", "form"))))
    inside = "".join(out)
    if rng.random() < 0.25:
        inside = _wrapped(rng, "div section", "content text body entry", inside)
    return _wrapped(rng, "article article div main section", "content post entry article story article-body text main", inside)


def _semantic_page(rng: random.Random) -> str:
    """The plainest layout: elements by meaning, hardly any attribute words."""
    parts = [f"<nav>{_links(rng, rng.randint(2, 8))}</nav>"] if rng.random() < 0.9 else []
    parts += [f"<header>{_text(rng, LEFT, 1, 6, 1)}</header>"] if rng.random() < 0.3 else []
    parts += [_boilerplate(rng, k) for k in ("ad", "notice") if rng.random() < 0.5]
    paragraphs = "".join(
        (f"<p>{t}</p>" if rng.random() < 0.8 else f"<p><b>{t}<br>")
        for t in (_text(rng, KEPT, 1, rng.choice((4, 12, 25)), rng.choice((1, 2, 5))) for _ in range(rng.choice(ARTICLE_BLOCKS)))
    )
    parts.append(f"<article><h1>{_text(rng, KEPT, 1, 12, 1)}</h1>{paragraphs}</article>")
    parts += [_boilerplate(rng, "comments")] if rng.random() < 0.2 else []
    if rng.random() < 0.9:
        parts.append(f"<footer>&copy; {_text(rng, LEFT, 1, 14, 2)}</footer>")
    return f"<html><head><title>{_sentence(rng, 2, 8)}</title></head><body>{''.join(parts)}</body></html>"


def training_page(rng: random.Random) -> str:
    if rng.random() < 0.3:
        return _semantic_page(rng)
    before = [_boilerplate(rng, k) for k in ("header", "nav", "notice", "ad", "share", "form") if rng.random() < 0.45]
    after = [_boilerplate(rng, k) for k in ("side", "comments", "ad", "share", "form", "footer", "notice") if rng.random() < 0.45]
    rng.shuffle(before)
    article = _article(rng) if rng.random() < 0.97 else ""
    body = [*before, article, *after]
    if rng.random() < 0.35:
        side = _boilerplate(rng, "side")
        middle = _wrapped(rng, "div main section", "wrapper container row page layout", rng.choice((side + article, article + side)))
        body = [*before, middle, *after]
    page = "".join(body)
    if rng.random() < 0.3:
        page = _wrapped(rng, "div", "wrapper page container site root", page)
    return f"<html><head><title>{_sentence(rng, 2, 8)}</title><script>f();</script></head><body>{page}</body></html>"


def _labelled(page: str) -> tuple[np.ndarray, list[int]]:
    nodes = nodes_of(parse(page))
    for node in reversed(nodes):
        if node.tag == "#text":
            node.label = int(KEPT in node.text)
            node.text = node.text.replace(KEPT, "").replace(LEFT, "").strip()
        node.label = int(node.label or any(c.label for c in node.children))
    return features(nodes), [n.label for n in nodes]


def fit(spark: SparkSession, pages: int = TRAINING_PAGES, seed: int = 11) -> Forest:
    """The trees, fitted on `pages` made pages."""
    rng = random.Random(seed)
    rows = []
    for _ in range(pages):
        x, y = _labelled(training_page(rng))
        rows += [(float(label), Vectors.dense(row)) for row, label in zip(x.tolist(), y)]
    table = spark.createDataFrame(rows, ["label", "features"]).repartition(4).cache()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed, maxBins=64).fit(table)
    table.unpersist()
    return Forest.of(model)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", forest: Forest | None = None
) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages.

    A page is read once from end to end, whatever is open or broken in it, and held with its tree; very long ones are nothing special. A null or empty page has an empty text, as has one without main text. Ids and urls are passed on as
    they are, nulls and repeats included; each row is extracted by itself. Character references
    are decoded, white space inside a block becomes one space, blocks are joined by an empty line. Other
    columns are not looked at.
    """
    spark = prepared(pages.sparkSession)
    shared = spark.sparkContext.broadcast(forest or fit(spark))
    rows = narrow(pages, page_id=id_col, url=url_col, html=html_col).withColumn("page_id", F.col("page_id").cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("html")
            for first in range(0, batch.num_rows, 100):
                part = [column[i].as_py() or "" for i in range(first, min(first + 100, batch.num_rows))]
                texts = main_text(shared.value, part)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("page_id").slice(first, len(part)),
                        batch.column("url").slice(first, len(part)),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    ["page_id", "url", "text", "n_chars"],
                )

    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
