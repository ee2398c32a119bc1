"""Main text of pages by a tree-structured graphical model.

Every node of a page's tree (elements and runs of text) is content or not. Log-linear node potentials
look at tags, class and id words, text length, link share and punctuation; parent-child potentials
couple a node with its parent by the kind of the child. Messages go upward and downward once
(sum-product), which gives exact marginals; a run of text is content if its marginal reaches 0.5.

The weights are trained on labelled pages (``html_labelled``) by maximum likelihood, with the same
messages giving the expected features. Messages run level by level over all pages of a batch.

Defined cases: null html = empty page, whose text is empty; broken markup is closed at the page's
end; rows that repeat a page_id are extracted one by one; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_tree import Tree, parse

# Tags and words in class, id or role that speak for or against content.
CONTENT_TAGS = ("article", "main")
TEXT_TAGS = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figure", "figcaption", "table", "td", "th", "dl", "dd", "dt")
OTHER_TAGS = (
    "nav", "header", "footer", "aside", "form", "button", "fieldset", "menu", "dialog", "head",
    "select", "option", "template", "noscript", "svg", "canvas", "audio", "video",
)
LIST_TAGS = ("ul", "ol", "li")
CONTENT_WORDS = ("article", "articlebody", "content", "entry", "main", "post", "story", "text", "body", "prose")
OTHER_WORDS = (
    "ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "promo", "cookie", "cookies", "consent", "notice", "alert", "popup", "modal",
    "overlay", "sidebar", "side", "widget", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "foot",
    "copyright", "legal", "share", "sharing", "social", "related", "recommended", "more", "newsletter", "subscribe", "signup", "login", "search", "form",
    "tags", "pager", "pagination", "toolbar", "skip", "contentinfo", "complementary",
)
COMMENT_WORDS = ("comment", "comments", "commentlist", "respond", "reply", "replies", "disqus", "discussion", "reader", "readers")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_KIND = {x: k for k, names in enumerate((CONTENT_TAGS, TEXT_TAGS, OTHER_TAGS, LIST_TAGS), 1) for x in names}
NODE_FEATURES = 19
EDGE_KINDS = 4  # text run; paragraph-like or list; content or other section; rest


@lru_cache(maxsize=1 << 16)
def _hint_bits(hint: str) -> int:
    words = set(_SPLIT.split(hint))
    return 1 * bool(words & set(CONTENT_WORDS)) | 2 * bool(words & set(OTHER_WORDS)) | 4 * bool(words & set(COMMENT_WORDS))


class Forest:
    """The nodes of many pages: parents, features and edge kinds as arrays, and the levels for messages."""

    def __init__(self, trees: list[Tree]):
        sizes = np.array([len(t.parent) for t in trees], dtype=np.int64)
        self.first = np.cumsum(sizes) - sizes
        total = int(sizes.sum())
        rows, self.edge, depth, parents = [], np.full(total, 3, dtype=np.int8), np.zeros(total, dtype=np.int32), np.full(total, -1, dtype=np.int64)
        at = 0
        for tree, base in zip(trees, self.first.tolist(), strict=True):
            context = [0] * len(tree.parent)
            for i, (parent, tag, hint, text, links) in enumerate(zip(tree.parent, tree.tag, tree.hint, tree.text, tree.links, strict=True)):
                if parent >= 0:
                    parents[at], depth[at] = base + parent, depth[base + parent] + 1
                above = context[parent] if parent >= 0 else 0
                if text is not None:
                    self.edge[at] = 0
                    n = len(text)
                    rows.append((at, 0, 1.0))
                    rows.append((at, 1, min(n, 1000) ** 0.5 / 16))
                    rows.append((at, 2, min(1.0, links / n)))
                    if text[-1] in ".!?:;…\"”»)":
                        rows.append((at, 3, 1.0))
                    if "," in text:
                        rows.append((at, 4, 1.0))
                    if n < 40:
                        rows.append((at, 5, 1.0))
                    if "©" in text or "cookie" in text.lower():
                        rows.append((at, 6, 1.0))
                else:
                    kind, bits = _KIND.get(tag, 0), _hint_bits(hint) if hint else 0
                    self.edge[at] = 1 if kind in (2, 4) and not bits else 2 if kind in (1, 3) or bits else 3
                    rows.append((at, 7 + kind, 1.0))
                    rows.extend((at, 12 + k, 1.0) for k in range(3) if bits >> k & 1)
                    context[i] = above | (1 if kind == 1 or bits == 1 else 0) | (2 if kind == 3 or bits & 6 else 0)
                    if above & 1 and tag == "header":  # of the article, not of the site
                        rows.append((at, 15, 1.0))
                if above & 1:
                    rows.append((at, 16, 1.0))
                if above & 2:
                    rows.append((at, 17, 1.0))
                rows.append((at, 18, 1.0))
                at += 1
        where, which, value = (np.array(x) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        self.features = np.zeros((total, NODE_FEATURES))
        self.features[where, which] = value
        self.parent, self.edge = parents, self.edge.astype(np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if total else []

    def messages(self, weights: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Log marginals (node, label), pair marginals (node, parent's label, label), log partition function."""
        score = self.features @ weights
        node = np.stack([np.zeros(len(score)), score], axis=1)
        up, sent = node.copy(), np.zeros_like(node)
        for level in reversed(self.levels[1:]):
            sent[level] = np.logaddexp.reduce(pairs[self.edge[level]] + up[level][:, None, :], axis=2)
            np.add.at(up, self.parent[level], sent[level])
        down, both = np.zeros_like(node), np.zeros((len(score), 2, 2))
        for level in self.levels[1:]:
            parent = self.parent[level]
            joint = (down[parent] + up[parent] - sent[level])[:, :, None] + pairs[self.edge[level]] + up[level][:, None, :]
            down[level] = np.logaddexp.reduce((down[parent] + up[parent] - sent[level])[:, :, None] + pairs[self.edge[level]], axis=1)
            both[level] = np.exp(joint - np.logaddexp.reduce(joint.reshape(len(level), 4), axis=1)[:, None, None])
        belief = up + down
        total = np.logaddexp.reduce(belief, axis=1)
        return belief - total[:, None], both, float(total[self.levels[0]].sum()) if self.levels else 0.0


def _labels(tree: Tree) -> list[int]:
    """A node's label: the nearest mark above it; an element without a mark above is content if most text in it is."""
    own: list[int | None] = []
    for parent, mark in zip(tree.parent, tree.label, strict=True):
        own.append(mark if mark is not None else own[parent] if parent >= 0 else None)
    weight = [(0 if y is None else (1 if y else -1)) * len(t or "") for y, t in zip(own, tree.text, strict=True)]
    for i in range(len(own) - 1, 0, -1):
        weight[tree.parent[i]] += weight[i]
    return [int(w > 0) if y is None else y for y, w in zip(own, weight, strict=True)]


@cache
def trained(rounds: int = 300, rate: float = 0.4, penalty: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Node weights and pair potentials (kind, parent's label, label) that fit the labelled pages."""
    from .html_labelled import labelled_pages

    trees = [parse(x) for x in labelled_pages()]
    forest, y = Forest(trees), np.concatenate([_labels(t) for t in trees])
    inner = np.flatnonzero(forest.parent >= 0)
    seen_nodes = forest.features.T @ y
    seen_pairs = np.zeros((EDGE_KINDS, 2, 2))
    np.add.at(seen_pairs, (forest.edge[inner], y[forest.parent[inner]], y[inner]), 1)
    weights, pairs = np.zeros(NODE_FEATURES), np.zeros((EDGE_KINDS, 2, 2))
    squares = np.full(NODE_FEATURES, 1e-6), np.full((EDGE_KINDS, 2, 2), 1e-6)
    for _ in range(rounds):
        marginal, both, _ = forest.messages(weights, pairs)
        expected = np.zeros((EDGE_KINDS, 2, 2))
        np.add.at(expected, forest.edge[inner], both[inner])
        slope = (seen_nodes - forest.features.T @ np.exp(marginal[:, 1])) / len(trees) - penalty * weights, (seen_pairs - expected) / len(trees) - penalty * pairs
        for value, s, q in ((weights, slope[0], squares[0]), (pairs, slope[1], squares[1])):
            q *= 0.95
            q += 0.05 * s * s
            value += rate * 0.25 * s / np.sqrt(q + 1e-4)
        rate *= 0.99
    return weights, pairs


def main_texts(pages: list[str], weights: np.ndarray, pairs: np.ndarray) -> list[str]:
    trees = [parse(x) for x in pages]
    forest = Forest(trees)
    keep = forest.messages(weights, pairs)[0][:, 1] >= np.log(0.5) if trees else []
    return ["\n\n".join(t for i, t in enumerate(tree.text) if t is not None and keep[base + i]) for tree, base in zip(trees, forest.first.tolist(), strict=True)]


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast(trained())  # some dozens of numbers

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, pairs = shared.value
        for batch in batches:
            html, texts, start, held = batch["html"].fillna("").tolist(), [], 0, 0
            for i, page in enumerate(html):
                held += len(page)
                if held >= 1 << 20 or i + 1 == len(html):
                    texts += main_texts(html[start : i + 1], weights, pairs)
                    start, held = i + 1, 0
            yield pd.DataFrame({"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInPandas(work, "page_id long, url string, text string, n_chars long")
