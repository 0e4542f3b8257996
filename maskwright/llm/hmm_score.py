"""Language-model scoring by a hidden Markov model over words.

How: every plain word of the corpus has an emission of its own, so what is gathered grows with it. The most frequent words are symbols; the others are tied
by hash to further symbols, and a tied word's emission is its symbol's times its share of the symbol's count in the corpus, the same in all
states. So a text's likelihood is that of its symbols times its tied words' shares: the recursions need the symbols alone, and
the shares' logarithms are summed by text where the words are counted, in buckets of words; neither texts nor the table of words go to a worker whole.

Baum-Welch: in each iteration every partition runs the scaled forward-backward recursion on its texts, each from its first word to its last, and
returns expected counts, which are summed over partitions in a tree and make the next parameters. Scoring computes the exact likelihood of each whole
text by the scaled forward recursion. Texts are taken in step, pooled by length, so that a few long ones don't hold up many short ones. All texts, and all words of each, take part in both.

Cases: a null, empty or wordless text has n_words 0, log_likelihood 0 and null perplexity. A text of any length is scored whole. Repeated
rows count as often as they are there and score alike. Null doc_ids stay null. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import exchange as E, textops as X, vocabulary as V

WORDS, OTHERS, STATES, ITERATIONS, SEED = 4096, 64, 6, 3, 5
#: Texts up to so many words are taken in step with each other, once so many words have come together; longer ones are a pool of their own.
POOLS = ((256, 400_000), (1024, 600_000), (4096, 800_000), (1 << 62, 1_000_000))


class Model:
    """start (K), move (K, K), emit (symbols, K) of a hidden Markov model, the words of its first symbols, and how many words the others tie (by symbol)."""

    def __init__(self, words: np.ndarray, start: np.ndarray, move: np.ndarray, emit: np.ndarray, others: int = OTHERS, tied: np.ndarray | None = None):
        self.words, self.start, self.move, self.emit, self.others = words, start, move, emit, others
        self.tied = np.ones(others) if tied is None else tied

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        return V.ids_of(self.words, hashes, self.others)


def _layout(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences by falling length, where their words are step by step, and the bounds of the steps."""
    order = np.argsort(-size, kind="stable")
    size, first = size[order], first[order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), side="left")
    bounds = np.concatenate([[0], np.cumsum(active)]).astype(np.int64)
    where = X.ranges(np.zeros(steps, np.int64), active) if steps else np.zeros(0, np.int64)
    return order, first[where] + np.repeat(np.arange(steps), active), bounds


def forward(model: Model, seen: np.ndarray, bounds: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward recursion of sequences in step. alpha: (sequences, K), the state before the first emission.

    Returns the scaled states after each word and the scales, in the layout's order.
    """
    states = np.empty((len(seen), len(model.start)))
    scale = np.empty(len(seen))
    for t in range(len(bounds) - 1):
        a, b = bounds[t], bounds[t + 1]
        now = alpha[: b - a] if t == 0 else states[bounds[t - 1] : bounds[t - 1] + b - a] @ model.move
        now = now * model.emit[seen[a:b]]
        scale[a:b] = now.sum(axis=1)
        np.divide(now, scale[a:b, None], out=states[a:b])
    return states, scale


def expected(model: Model, symbols: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of starts, moves and emissions of the sequences, and their log-likelihood."""
    k = len(model.start)
    order, where, bounds = _layout(first, size)
    seen = symbols[where]
    states, scale = forward(model, seen, bounds, np.broadcast_to(model.start, (len(order), k)))
    moves = np.zeros((k, k))
    beta = np.zeros((0, k))
    for t in range(len(bounds) - 2, -1, -1):
        a, b = bounds[t], bounds[t + 1]
        now = np.ones((b - a, k))
        if len(beta):
            now[: len(beta)] = beta @ model.move.T
            moves += states[a : a + len(beta)].T @ beta
        states[a:b] *= now  # from here on the probabilities of the states given the whole text
        beta = now
        beta *= model.emit[seen[a:b]]
        beta /= scale[a:b, None]
    emits = np.stack([np.bincount(seen, states[:, j], len(model.emit)) for j in range(k)], axis=1)
    return states[: bounds[1]].sum(axis=0) if len(bounds) > 1 else np.zeros(k), moves * model.move, emits, float(np.log(scale).sum())


def log_likelihood(model: Model, symbols: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Exact log-likelihood of each sequence of symbols, which begins at first and has size of them."""
    k = len(model.start)
    out = np.zeros(len(size))
    order, where, bounds = _layout(first, size)
    seen = symbols[where]
    now = np.broadcast_to(model.start, (len(order), k))
    for t in range(len(bounds) - 1):
        a, b = bounds[t], bounds[t + 1]
        now = (now if t == 0 else now[: b - a] @ model.move)[: b - a] * model.emit[seen[a:b]]
        scale = now.sum(axis=1)
        out[: b - a] += np.log(scale)
        now = now / scale[:, None]
    back = np.empty_like(out)
    back[order] = out
    return back


class Pools:
    """Brings texts of like length together: add() and rest() give lists of parts (symbols, sizes, whatever belongs to the texts)."""

    def __init__(self):
        self.parts: list[list] = [[] for _ in POOLS]
        self.words = [0] * len(POOLS)

    def add(self, symbols: np.ndarray, first: np.ndarray, *own: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        size = np.diff(first)
        low = 0
        for p, (most, words) in enumerate(POOLS):
            at = np.flatnonzero((size > low) & (size <= most))
            low = most
            if not len(at):
                continue
            self.parts[p].append((symbols[X.ranges(first[at], first[at + 1])], size[at], *(x[at] for x in own)))
            self.words[p] += int(size[at].sum())
            if self.words[p] > words:
                yield self._take(p)

    def _take(self, p: int) -> tuple[np.ndarray, ...]:
        got = tuple(np.concatenate(x) for x in zip(*self.parts[p]))
        self.parts[p], self.words[p] = [], 0
        return got

    def rest(self) -> Iterator[tuple[np.ndarray, ...]]:
        for p in range(len(POOLS)):
            if self.parts[p]:
                yield self._take(p)


def _expected_sums(docs: DataFrame, model: Model) -> np.ndarray:
    """Over all texts, on end: expected emissions of each symbol by state, moves, starts, and a row with the log-likelihood first."""
    symbols, states = model.emit.shape
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def counts(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        m = shared.value
        out = np.zeros((symbols + states + 2, states))

        def add(seen: np.ndarray, size: np.ndarray) -> None:
            begun, moved, emitted, log = expected(m, seen, np.cumsum(size) - size, size)
            out[:symbols] += emitted
            out[symbols : symbols + states] += moved
            out[-2] += begun
            out[-1, 0] += log

        pools = Pools()
        for b in batches:
            for s in X.pieces(b):
                w = X.plain_words(s.column("text"))
                for part in pools.add(m.symbols(w.hash), w.first):
                    add(*part)
        for part in pools.rest():
            add(*part)
        X.tidy()
        return out

    got = V.sum_arrays(docs, counts, symbols + states + 2, states)
    shared.unpersist()
    return got


def train(docs: DataFrame, words: int = WORDS, others: int = OTHERS, states: int = STATES, iterations: int = ITERATIONS, seed: int = SEED) -> tuple[Model, list[float]]:
    """A model of all texts, and the log-likelihood of the corpus' symbols before each iteration."""
    E.small_batches(docs.sparkSession)
    docs = docs.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")
    known, count, total = V.top_words(docs, words)
    rng = np.random.default_rng(seed)
    symbols = len(known) + others
    base = np.concatenate([count, np.full(others, max(1, total - count.sum()) / others)]).astype(float)
    emit = base[:, None] * rng.uniform(0.5, 1.5, (symbols, states))
    move = rng.uniform(0.5, 1.5, (states, states)) + states * np.eye(states) / 2
    model = Model(known, np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), others)
    history = []
    for _ in range(iterations):
        got = _expected_sums(docs, model)
        history.append(float(got[-1, 0]))
        emit = got[:symbols] + 0.1 / symbols * got[:symbols].sum(axis=0).clip(1) * base[:, None] / base.sum() + 1e-9
        move = got[symbols : symbols + states] + 1e-3
        begin = got[-2] + 1e-3
        # The states of a word have probability 1 together, so a symbol's expected emissions add up to its count.
        model = Model(known, begin / begin.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), others, np.rint(got[len(known) : symbols].sum(axis=1)))
    return model, history


def _text_key(w: X.Words) -> np.ndarray:
    """A hash of each text's words in their order."""
    place = (np.arange(len(w)) - w.first[w.doc]).astype(np.uint64)
    total = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(X.mix(w.hash + X.mix(place + X.U64(1))), out=total[1:])
    return X.mix(total[w.first[1:]] - total[w.first[:-1]] + np.diff(w.first).astype(np.uint64))


def symbol_scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, words (a hash of the text's words), and log: the likelihood of its symbols, less the logarithm of each tied word's symbol's count."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "n_words", "words", "log"]

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        less = np.concatenate([np.zeros(len(m.words)), np.log(np.maximum(m.tied, 1))])

        def rows(seen: np.ndarray, size: np.ndarray, ids: np.ndarray, known: np.ndarray, key: np.ndarray) -> pa.RecordBatch:
            first = np.cumsum(size) - size
            log = log_likelihood(m, seen, first, size) - np.add.reduceat(less[seen], first)
            return pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(size), pa.array(X.signed(key)), pa.array(log)], names)

        pools = Pools()
        for b in batches:
            for s in X.pieces(b):
                w = X.plain_words(s.column("text"))
                ids = s.column("doc_id")
                own = ids.fill_null(0).to_numpy(zero_copy_only=False), np.asarray(ids.is_valid()), _text_key(w)
                for part in pools.add(m.symbols(w.hash), w.first, *own):
                    yield rows(*part)
                bare = np.flatnonzero(np.diff(w.first) == 0)
                if len(bare):
                    nothing = np.zeros(len(bare))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(bare)), pa.array(nothing.astype(np.int64)), pa.nulls(len(bare), pa.int64()), pa.array(nothing)], names)
        for part in pools.rest():
            yield rows(*part)
        X.tidy()

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(source, "doc_id bigint, n_words bigint, words bigint, log double")


def tied_counts(docs: DataFrame, model: Model) -> DataFrame:
    """words (a text's hash) and counts: the sum of the logarithms of its tied words' counts in the corpus, of every text that has tied words."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model.words)
    packer = E.Packer(E.width(spark), {"word": np.uint64, "times": np.uint32}, {"text": np.int64, "copies": np.uint32})

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.pieces(b):
                w = X.plain_words(s.column("text"))
                # Copies in a run of texts are taken together.
                key, one, copies = np.unique(_text_key(w), return_index=True, return_counts=True)
                turn = np.full(len(s), -1)
                turn[one] = np.arange(len(one))
                tied = np.flatnonzero((turn[w.doc] >= 0) & ~E.has(shared.value, w.hash))
                order = tied[np.lexsort((w.hash[tied], w.doc[tied]))]
                edge = X.runs(w.doc[order], w.hash[order])
                at = order[edge[:-1]]
                yield from packer.add(E.bucket_of(w.hash[at], packer.buckets), turn[w.doc[at]], {"word": w.hash[at], "times": np.diff(edge)}, {"text": X.signed(key), "copies": copies}, len(key))
        yield packer.flush()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = packer.read(batches)
        order = np.argsort(got["word"])
        edge = X.runs(got["word"][order])
        times, text, copies = got["times"][order].astype(np.int64), got["text"][order], got["copies"][order]
        del got
        if len(order):
            count = np.add.reduceat(times * copies, edge[:-1])
            log = times * np.repeat(np.log(count), np.diff(edge))
            # A text that stands in several runs has a row of a word for each: all alike.
            by = np.lexsort((np.repeat(np.arange(len(edge) - 1), np.diff(edge)), text))
            one = by[X.runs(text[by], np.repeat(np.arange(len(edge) - 1), np.diff(edge))[by])[:-1]]
            text, log = text[one], log[one]
            first = X.runs(text)[:-1]
            text, log = text[first], np.add.reduceat(log, first)
            for a in range(0, len(text), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(text[a : a + 100_000]), pa.array(log[a : a + 100_000])], ["words", "counts"])
        X.tidy()

    found = E.regroup(docs.select(F.col("text").cast("string").alias("text")).filter("text IS NOT NULL"), source, packer, reduce, "words bigint, counts double")
    return found.groupBy("words").agg(F.sum("counts").alias("counts"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, log_likelihood, perplexity of each row, by a model that train() made of the same docs."""
    rows = symbol_scores(docs, model)
    # Copies of one text are a skewed key of narrow rows, which adaptive execution splits.
    met = rows.join(tied_counts(docs, model), "words", "left").withColumn("log_likelihood", F.col("log") + F.coalesce("counts", F.lit(0.0)))
    return met.select("doc_id", "n_words", "log_likelihood", F.when(F.col("n_words") > 0, F.exp(-F.col("log_likelihood") / F.col("n_words"))).alias("perplexity"))


def scored(docs: DataFrame) -> DataFrame:
    """docs' scores by a model trained on docs."""
    return score(docs, train(docs)[0])
