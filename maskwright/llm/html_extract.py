"""HTML extraction: flat text blocks, classified by a decision tree on the words and link density of each block and its neighbours.

How: comments, scripts, styles and head are cut out; block-level tags end a block; words inside links are counted apart. For each block with words, a
tree looks at the number of words and the share of words in links of the block, the one before and the one after (0 where there is none). The
tree is grown at import from LABELLED, a small table of blocks as they occur in articles, front pages, forums and shops. Blocks classified as content are joined
by line feeds.

Cases: null or empty html, or html without words, has no block and an empty text. Markup that isn't closed ends with the page; a very long page is read
whole. Null page_ids stay null. Rows are independent, so repeats give equal results. Empty tables give empty results. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import exchange as E

#: Words and link share of the block before, the block itself and the one after; then 1 for content.
LABELLED = (
    # navigation, menus and link lists
    (0, 0, 1, 1, 1, 1, 0), (1, 1, 1, 1, 1, 1, 0), (1, 1, 1, 1, 9, 0, 0), (1, 1, 2, 1, 14, 0, 0), (2, 1, 3, 1, 2, 1, 0), (0, 0, 6, 1, 9, 0, 0), (4, 1, 5, 1, 3, 1, 0),
    (0, 0, 4, 0.75, 3, 1, 0), (9, 0.9, 12, 0.9, 8, 0.8, 0), (60, 0, 7, 1, 6, 1, 0), (0, 0, 25, 0.9, 8, 0, 0), (40, 0, 1, 1, 0, 0, 0), (8, 1, 8, 1, 80, 0, 0), (30, 0.02, 10, 0.8, 9, 0.9, 0),
    # teasers and advertisements beside menus
    (1, 1, 8, 0, 9, 0, 0), (1, 1, 10, 0, 10, 0, 0), (1, 1, 13, 0, 8, 0, 0), (2, 1, 16, 0, 11, 0, 0), (1, 1, 19, 0, 9, 0, 0), (1, 1, 21, 0, 10, 0, 0), (3, 1, 12, 0, 12, 0, 0), (1, 1, 5, 0, 9, 0, 0), (1, 1, 2, 0, 8, 0, 0), (1, 1, 24, 0, 10, 0, 0),
    # footers, copyright lines and notices at a page's end
    (40, 0, 9, 0, 0, 0, 0), (55, 0, 12, 0, 0, 0, 0), (8, 0, 13, 0, 0, 0, 0), (120, 0, 16, 0, 0, 0, 0), (25, 0, 20, 0, 0, 0, 0), (12, 0, 11, 0, 0, 0, 0), (70, 0, 7, 0.4, 0, 0, 0), (33, 0, 24, 0.1, 0, 0, 0), (15, 0, 3, 0, 0, 0, 0), (14, 0, 25, 0, 0, 0, 0),
    # headlines over text
    (9, 0, 8, 0, 14, 0, 1), (12, 0, 10, 0, 40, 0, 1), (15, 0, 9, 0, 11, 0, 1), (20, 0, 10, 0, 80, 0, 1), (10, 0, 5, 0, 30, 0, 1), (7, 0, 9, 0, 9, 0, 1), (0, 0, 9, 0, 55, 0, 1), (0, 0, 6, 0, 90, 0, 1), (2, 0, 8, 0, 25, 0, 1),
    # first and inner paragraphs
    (9, 0, 14, 0, 60, 0, 1), (8, 0, 12, 0, 45, 0, 1), (10, 0, 25, 0, 13, 0, 1), (60, 0, 80, 0, 55, 0, 1), (40, 0, 3, 0, 50, 0, 1), (70, 0, 1, 0, 60, 0, 1), (30, 0, 12, 0, 44, 0, 1), (22, 0, 18, 0, 9, 0, 1), (12, 0, 150, 0.02, 70, 0, 1), (90, 0, 300, 0.05, 40, 0.1, 1), (5, 0, 7, 0, 12, 0, 1), (16, 0, 2, 0, 14, 0, 1), (45, 0, 35, 0.15, 50, 0.05, 1),
    # last paragraphs before a footer
    (50, 0, 40, 0, 12, 0, 1), (60, 0, 9, 0, 14, 0, 1), (45, 0, 2, 0, 11, 0, 1), (18, 0, 22, 0, 16, 0, 1), (14, 0, 70, 0, 13, 0, 1), (35, 0, 5, 0, 20, 0, 1),
    # short paragraphs among short ones
    (8, 0, 4, 0, 6, 0, 1), (3, 0, 2, 0, 12, 0, 1), (11, 0, 9, 0, 13, 0, 1), (2, 0, 11, 0, 3, 0, 1), (25, 0, 1, 0, 2, 0, 1), (12, 0, 20, 0, 12, 0, 1), (10, 0, 22, 0, 5, 0, 1), (20, 0, 30, 0, 10, 0, 1), (9, 0, 15, 0, 14, 0, 1), (6, 0, 6, 0, 10, 0, 1), (5, 0, 16, 0, 11, 0, 1), (16, 0, 16, 0, 16, 0, 1), (9, 0, 3, 0, 10, 0, 1), (14, 0, 21, 0, 9, 0, 1), (7, 0, 24, 0, 8, 0, 1), (30, 0, 13, 0, 7, 0, 1),
    # pages that are all text
    (0, 0, 60, 0, 0, 0, 1), (0, 0, 200, 0, 50, 0, 1), (50, 0, 70, 0, 0, 0, 1), (80, 0.1, 45, 0, 0, 0, 1), (1, 1, 60, 0, 50, 0, 1), (1, 1, 45, 0, 0, 0, 1), (2, 1, 90, 0.05, 70, 0, 1), (6, 1, 120, 0, 10, 0, 1),
)
DEPTH = 6

_CUT = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head|noscript|template|svg|textarea|select)\b(?:[^>]*+>.*?(?:</\1\s*>|\Z)|[^>]*+\Z)", re.S | re.I)
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|<[/!?a-zA-Z][^>]*+(?:>|\Z)""")
_WORD = re.compile(r"\w[^\s]*")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())


class Tree:
    """A binary decision tree by Gini impurity in flat arrays; ties go to the first feature and the lowest cut."""

    def __init__(self, table: tuple = LABELLED, depth: int = DEPTH):
        data = np.array(table, float)
        self.feature, self.cut, self.low, self.high, self.value = [], [], [], [], []
        self._grow(data[:, :-1], data[:, -1], depth)
        self.arrays = [np.array(x) for x in (self.feature, self.cut, self.low, self.high, self.value)]

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        here = len(self.feature)
        for k, v in zip((self.feature, self.cut, self.low, self.high, self.value), (-1, 0.0, here, here, float(y.mean() >= 0.5))):
            k.append(v)
        best = (2 * len(y) * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
        if depth and best[0] > 0:
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    left = x[:, f] <= cut
                    impurity = sum(2 * len(p) * p.mean() * (1 - p.mean()) for p in (y[left], y[~left]))
                    if impurity < best[0] - 1e-12:
                        best = (impurity, f, cut)
            if best[1] >= 0:
                left = x[:, best[1]] <= best[2]
                self.feature[here], self.cut[here] = best[1], best[2]
                self.low[here] = self._grow(x[left], y[left], depth - 1)
                self.high[here] = self._grow(x[~left], y[~left], depth - 1)
        return here

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, cut, low, high, value = self.arrays
        at = np.zeros(len(x), np.int64)
        for _ in range(DEPTH + 1):
            f = feature[at]
            at = np.where(f < 0, at, np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at], low[at], high[at]))
        return value[at] > 0.5


TREE = Tree()


def blocks(page: str | None) -> list[tuple[str, int, int]]:
    """Text, words and words in links of a page's blocks that have words."""
    if not page:
        return []
    page = _CUT.sub(" ", page)
    out: list = []
    text: list[str] = []
    words = linked = 0
    link, at = 0, 0

    def take(piece: str) -> None:
        nonlocal words, linked
        if piece:
            piece = entities.unescape(piece)
            n = len(_WORD.findall(piece))
            words += n
            linked += n * (link > 0)
            text.append(piece)

    def end() -> None:
        nonlocal words, linked
        if words:
            out.append((" ".join("".join(text).split()), words, linked))
        text.clear()
        words = linked = 0

    for m in _TAG.finditer(page):
        take(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if name == "a":
            link = 0 if m[1] else 1
        elif name and name not in _INLINE:
            link = 0
            end()
    take(page[at:])
    end()
    return out


def content(pages: list[str | None], tree: Tree = TREE) -> tuple[list[str], list[int], list[int]]:
    """Content text, number of blocks and of content blocks of each page."""
    found = [blocks(p) for p in pages]
    size = np.array([len(b) for b in found], np.int64)
    flat = np.array([(w, k / w) for b in found for _, w, k in b], float).reshape(-1, 2)
    page = np.repeat(np.arange(len(pages)), size)
    before, after = np.zeros_like(flat), np.zeros_like(flat)
    if len(flat) > 1:
        same = (page[1:] == page[:-1])[:, None]
        before[1:], after[:-1] = flat[:-1] * same, flat[1:] * same
    keep = tree.predict(np.concatenate([before, flat, after], axis=1)) if len(flat) else np.zeros(0, bool)
    out, at = [], 0
    for b in found:
        out.append("\n".join(t for (t, _, _), k in zip(b, keep[at : at + len(b)]) if k))
        at += len(b)
    return out, size.tolist(), np.bincount(page, keep, len(pages)).astype(np.int64).tolist()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_blocks, n_content of each row of pages."""

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, len(b), 200):
                s = b.slice(a, 200)
                text, size, kept = content(s.column("html").to_pylist())
                yield pa.RecordBatch.from_arrays([s.column("page_id"), s.column("url"), pa.array(text, pa.string()), pa.array(size, pa.int64()), pa.array(kept, pa.int64())], ["page_id", "url", "text", "n_blocks", "n_content"])

    E.small_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return pages.mapInArrow(source, "page_id bigint, url string, text string, n_blocks bigint, n_content bigint")
