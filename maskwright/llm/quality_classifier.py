"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network and calibrated probabilities.

How: each of the corpus' most frequent words (the others share some ids by hash, and three marks stand for symbol runs, words in
capitals and repeated words) has a sparse random index vector. A word's vector is the sum of its neighbours' index
vectors over the whole corpus, plus its own, at unit length; to it come two coordinates, the smoothed shares of
documents with either label among the labelled documents that hold the word, as those labels' index vectors would give. A document's features are the
means of its word vectors, weighted down for frequent words, and the extremes of the label coordinates. Two dense layers give
two outputs, quality and toxicity; a temperature for each, fitted on labelled documents held out from training, turns them into probabilities.

The labelled sample is bounded by the parameter ``most_labelled`` (lowest hash of doc_id first); vectors come from all documents, and all are scored.

Cases: a null, empty or wordless text gets the features 0 and a probability like any other. Null doc_ids stay null and have no label. Labels
with nulls are left out, of repeated labels the highest toxic and lowest quality hold. Rows that repeat a doc_id are scored each; all of them train.
However few documents are labelled, the network is trained on them (and is no better than they are). Without any labelled document the probabilities are 0.5 and every document is kept. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import exchange as E, textops as X, vocabulary as V

WORDS, OTHERS, DIMENSIONS, WINDOW, NONZERO = 1 << 15, 1 << 11, 48, 2, 2
MARKS = ("symbols", "capitals", "echo")
MOST_LABELLED, HIDDEN, EPOCHS, SEED = 20_000, 24, 60, 11
#: Documents that a word's label shares are smoothed by.
PRIOR = 8.0
TASKS = ("quality", "toxic")

_SYMBOL_RUN = np.ones(256, bool)
_SYMBOL_RUN[list(b"#$%&*+<=>@[\\]^_{|}~!")] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True


class Tokens:
    """Ids of the words and marks of texts, in order of text, and the texts' bounds."""

    def __init__(self, text: pa.Array, words: np.ndarray):
        w = X.plain_words(text)
        n = len(text)
        self.words = V.ids_of(words, w.hash, OTHERS)
        self.word_doc, self.first = w.doc, w.first
        top = len(words) + OTHERS
        buf, off = X.utf8(text)
        symbols = X.Words(buf, off, _SYMBOL_RUN)
        raw = X.Words(buf, off, X._SPACE)
        big, small = (np.concatenate([[0], np.cumsum(k[buf])]) for k in (_UPPER, _LOWER))
        loud = (big[raw.end] - big[raw.start] >= 2) & (small[raw.end] == small[raw.start])
        echo = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1]))
        doc = np.concatenate([w.doc, symbols.doc, raw.doc[loud], w.doc[echo]])
        ids = np.concatenate([self.words, np.full(len(symbols), top), np.full(int(loud.sum()), top + 1), np.full(len(echo), top + 2)])
        order = np.argsort(doc, kind="stable")
        self.ids, self.doc = ids[order], doc[order]
        self.bounds = np.searchsorted(self.doc, np.arange(n + 1))


def index_vectors(ids: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each id's NONZERO entries."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, dimensions, (ids, NONZERO)), rng.choice(np.array([-1.0, 1.0]), (ids, NONZERO))


def word_vectors(docs: DataFrame, words: np.ndarray, labels: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors with label shares (ids, DIMENSIONS + 2), and the ids' counts."""
    ids = len(words) + OTHERS + len(MARKS)
    spark = docs.sparkSession
    keys = np.array(sorted(labels), np.int64)
    values = np.array([labels[int(k)] for k in keys], float).reshape(-1, 2)
    shared = spark.sparkContext.broadcast((words, keys, values))

    def make(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        known, marked, label = shared.value
        place, sign = index_vectors(ids)
        out = np.zeros(ids * DIMENSIONS)
        rest = np.zeros((ids, 4))  # count, labelled documents, those of quality, toxic ones
        for b in batches:
            for s in X.pieces(b):
                t = Tokens(s.column("text"), known)
                rest[:, 0] += np.bincount(t.ids, minlength=ids)
                w, d = t.words, t.word_doc
                for o in range(1, WINDOW + 1):
                    near = np.flatnonzero(d[o:] == d[:-o]) if len(d) > o else np.zeros(0, np.int64)
                    for x, y in ((w[near], w[near + o]), (w[near + o], w[near])):
                        for k in range(NONZERO):
                            out += np.bincount(x * DIMENSIONS + place[y, k], sign[y, k], len(out))
                doc_id = s.column("doc_id")
                has = E.has(marked, doc_id.fill_null(-1).to_numpy(zero_copy_only=False)) & np.asarray(doc_id.is_valid())
                own = np.flatnonzero(has[t.doc])
                if len(own):
                    pair = np.unique(t.doc[own] * ids + t.ids[own])
                    value = label[np.searchsorted(marked, doc_id.fill_null(-1).to_numpy(zero_copy_only=False)[pair // ids])]
                    rest[:, 1] += np.bincount(pair % ids, minlength=ids)
                    for k in range(2):
                        rest[:, 2 + k] += np.bincount(pair % ids, value[:, k], ids)
        X.tidy()
        return np.concatenate([out.reshape(ids, DIMENSIONS), rest], axis=1).astype(np.float32)

    # A partition's own sums fit float32; they are added up as float64.
    got = V.sum_arrays(docs, make, ids, DIMENSIONS + 4, np.float32)
    unit = lambda v: v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    own = np.random.default_rng(SEED + 1).normal(size=(ids, DIMENSIONS))
    context = got[:, :DIMENSIONS]
    context = context - context.sum(axis=0) / max(1.0, got[:, DIMENSIONS].sum()) * got[:, DIMENSIONS, None]
    base = values.mean(axis=0) if len(values) else np.full(2, 0.5)
    share = (got[:, -2:] + PRIOR * base) / (got[:, -3:-2] + PRIOR)
    return np.concatenate([unit(unit(context) + unit(own)), share], axis=1).astype(np.float32), got[:, DIMENSIONS]


def features(text: pa.Array, words: np.ndarray, vectors: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One row a text: weighted mean vector, extremes of the label shares, shares of marks."""
    t = Tokens(text, words)
    n = len(text)
    full = np.flatnonzero(np.diff(t.bounds))
    out = np.zeros((n, DIMENSIONS + 2 + 4 + len(MARKS)), np.float32)
    if not len(full):
        return out
    w = weight[t.ids]
    start = t.bounds[full]
    total = np.add.reduceat(w, start)[:, None]
    value = vectors[t.ids]
    label = value[:, DIMENSIONS:]
    at = DIMENSIONS + 2
    out[full, at : at + 2] = np.minimum.reduceat(label, start, axis=0)
    out[full, at + 2 : at + 4] = np.maximum.reduceat(label, start, axis=0)
    value *= w[:, None]
    out[full, :at] = np.add.reduceat(value, start, axis=0) / np.maximum(total, 1e-9)
    top = len(words) + OTHERS
    for k in range(len(MARKS)):
        out[full, at + 4 + k] = np.add.reduceat((t.ids == top + k).astype(np.float32), start) / np.diff(t.bounds)[full]
    return out


class Network:
    """Two dense layers; fit() also calibrates a temperature for each output."""

    def __init__(self, hidden: int = HIDDEN, seed: int = SEED):
        self.hidden, self.seed = hidden, seed
        self.temperature = np.ones(2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> Network:
        rng = np.random.default_rng(self.seed)
        order = rng.permutation(len(x))
        held, train = order[: len(x) // 5], order[len(x) // 5 :]
        self.mean, self.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
        self.w1, self.b1 = rng.normal(size=(x.shape[1], self.hidden)) / np.sqrt(x.shape[1]), np.zeros(self.hidden)
        self.w2, self.b2 = rng.normal(size=(self.hidden, 2)) / np.sqrt(self.hidden), np.zeros(2)
        names = ("w1", "b1", "w2", "b2")
        m = {k: np.zeros_like(getattr(self, k)) for k in names}
        v = {k: np.zeros_like(getattr(self, k)) for k in names}
        step = 0
        for epoch in range(epochs):
            for part in np.array_split(rng.permutation(train), max(1, len(train) // 128)):
                a = (x[part] - self.mean) / self.scale
                h = np.tanh(a @ self.w1 + self.b1)
                p = 1 / (1 + np.exp(-np.clip(h @ self.w2 + self.b2, -50, 50)))
                g = (p - y[part]) / len(part)
                gh = g @ self.w2.T * (1 - h * h)
                step += 1
                for k, d in zip(names, (a.T @ gh + 1e-4 * self.w1, gh.sum(axis=0), h.T @ g + 1e-4 * self.w2, g.sum(axis=0))):
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    rate = 3e-3 * (1 - epoch / epochs) + 1e-4
                    setattr(self, k, getattr(self, k) - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8))
        if len(held):
            z = self.logits(x[held])
            grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
            for k in range(2):
                loss = [np.logaddexp(0, np.where(y[held, k] > 0.5, -1, 1) * z[:, k] / t).mean() for t in grid]
                self.temperature[k] = grid[int(np.argmin(loss))]
        return self


def classify(docs: DataFrame, labels: DataFrame, most_labelled: int = MOST_LABELLED) -> DataFrame:
    """doc_id, p_quality, p_toxic and keep (p_quality at least and p_toxic under a half) of each row of docs."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    E.small_batches(spark)
    one = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    got = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled).toArrow().to_pydict()
    marked = {k: (q, t) for k, q, t in zip(got["doc_id"], got["quality"], got["toxic"])}
    words, _, _ = V.top_words(docs, WORDS)
    vectors, count = word_vectors(docs, words, marked)
    weight = (1e-3 / (1e-3 + count / max(1.0, count.sum()))).astype(np.float32)
    shared = spark.sparkContext.broadcast((words, vectors, weight))
    width = DIMENSIONS + 6 + len(MARKS)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.pieces(b):
                x = features(s.column("text"), *shared.value)
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "x"])

    sample = spark.createDataFrame(pa.table({"doc_id": pa.array([*marked], pa.int64())}))
    rows = E.of_ids(docs, sample, ["doc_id", "text"]).mapInArrow(featured, "doc_id bigint, x binary").toArrow()
    ids = rows.column("doc_id").to_numpy()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float32).reshape(-1, width).astype(float)
    order = np.argsort(ids, kind="stable")
    network = Network().fit(x[order], np.array([marked[int(i)] for i in ids[order]], float)) if len(ids) else None
    final = spark.sparkContext.broadcast(network)

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.pieces(b):
                p = final.value.probabilities(features(s.column("text"), *shared.value)) if final.value else np.full((len(s), 2), 0.5)
                keep = (p[:, 0] >= 0.5) & (p[:, 1] < 0.5) if final.value else np.ones(len(s), bool)
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(keep)], ["doc_id", "p_quality", "p_toxic", "keep"])

    return docs.mapInArrow(source, "doc_id bigint, p_quality double, p_toxic double, keep boolean")
