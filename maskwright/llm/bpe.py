"""Byte-pair encoding and decoding by a public vocabulary: speculate and verify.

How: a text is cut into words by the vocabulary's pattern. For words not met before, greedy longest match proposes tokens, all words
of a batch in step through a trie held in sorted arrays. A sequence of tokens is the encoding exactly if each adjacent pair is what
the pair's own bytes encode to; this is tested for all pairs at once by undoing merges in order of rank. Only words with
a failing pair undergo exact merging, by a heap of ranks. Words met before come from a cache of bounded size.

The vocabulary file (base64 token, space, rank on each line, the format of ranked byte-level vocabularies) is read on the driver; its path is a
parameter. Strings of special tokens in a text are ordinary text.

Cases: a null text gives null tokens and n_tokens 0; an empty one no tokens. Very long texts and words are encoded whole. Rows are
independent, so repeats give equal results. Null doc_ids stay null. Empty tables give empty results. Other columns are passed through by ``encode`` and
``decode`` unless they have the name of a column that is made, which replaces them.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from . import exchange as E, textops as X

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Distinct words that a worker remembers before it starts anew.
CACHE_WORDS = 200_000
#: Words of up to so many bytes are merged in step, longer ones each by a heap.
LOCKSTEP = 64
_NONE = np.int64(1) << 40


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Token bytes by id."""
    rows = [line.split() for line in Path(path).read_bytes().splitlines() if line.strip()]
    tokens = [b""] * (1 + max(int(r) for _, r in rows))
    for token, rank in rows:
        tokens[int(rank)] = base64.b64decode(token)
    if len({t for t in tokens if t}) != len(rows):
        raise ValueError(f"{path}: a token occurs twice")
    return tokens


def merge(parts: list[int], pairs: dict[tuple[int, int], int], below: int = 1 << 40) -> list[int]:
    """Exact byte-pair merging of a sequence: the lowest rank (under ``below``) first, leftmost first among equals."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    alive = [True] * n
    heap = [(pairs[p], i) for i, p in enumerate(zip(parts, parts[1:])) if p in pairs]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        if rank >= below:
            break
        j = after[i] if alive[i] else n
        if j >= n or pairs.get((parts[i], parts[j])) != rank:
            continue
        parts[i], alive[j] = rank, False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            if (p := (rank, parts[after[i]])) in pairs:
                heapq.heappush(heap, (pairs[p], i))
        if before[i] >= 0 and (p := (parts[before[i]], rank)) in pairs:
            heapq.heappush(heap, (pairs[p], before[i]))
    return [t for t, a in zip(parts, alive) if a]


class Codec:
    """A vocabulary's tables; made once on the driver and shipped as arrays."""

    def __init__(self, tokens: list[bytes], pattern: str = PATTERN):
        self.pattern = pattern
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.off = np.concatenate([[0], np.cumsum([len(t) for t in tokens])])
        ids = {t: i for i, t in enumerate(tokens) if t}
        self.byte = np.array([ids.get(bytes([b]), -1) for b in range(256)])
        if (self.byte < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        # The two tokens that each token was merged from; a byte is its own.
        n = len(tokens)
        self.left, self.right = np.arange(n), np.arange(n)
        pairs: dict[tuple[int, int], int] = {}
        for i, t in enumerate(tokens):
            if len(t) > 1:
                two = merge([int(self.byte[b]) for b in t], pairs)
                if len(two) != 2:
                    raise ValueError(f"token {i} isn't a merge of two tokens of lower rank")
                self.left[i], self.right[i] = two
                pairs[two[0], two[1]] = i
        keys = np.array([(a << 24) + b for a, b in pairs] or [-1])
        order = np.argsort(keys)
        self.pair_key, self.pair_token = keys[order], np.array([*pairs.values()] or [0])[order]
        # Trie: (node, byte) -> node, and each node's token.
        nodes: dict[tuple[int, int], int] = {}
        ends = [-1]
        for i, t in enumerate(tokens):
            at = 0
            for b in t:
                if (at, b) not in nodes:
                    nodes[at, b] = len(ends)
                    ends.append(-1)
                at = nodes[at, b]
            if t:
                ends[at] = i
        keys = np.array([(a << 8) + b for a, b in nodes])
        order = np.argsort(keys)
        self.step_key, self.step_node, self.node_token = keys[order], np.array([*nodes.values()])[order], np.array(ends)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def _lookup(self, keys: np.ndarray, values: np.ndarray, x: np.ndarray, none: int) -> np.ndarray:
        at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
        return np.where(keys[at] == x, values[at], none)

    def propose(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match of words: tokens on end, and the words' bounds in them."""
        at, end = off[:-1].astype(np.int64), off[1:].astype(np.int64)
        word = np.flatnonzero(at < end)
        at, end = at[word], end[word]
        node, look = np.zeros(len(word), np.int64), at.copy()
        best, best_end = np.full(len(word), -1, np.int64), at.copy()
        out: list = []
        while len(word):
            more = look < end
            step = np.full(len(word), -1, np.int64)
            step[more] = self._lookup(self.step_key, self.step_node, (node[more] << 8) + buf[look[more]], -1)
            go = step >= 0
            node = np.where(go, step, node)
            look = look + go
            token = np.where(go, self.node_token[node], -1)
            hit = token >= 0
            best, best_end = np.where(hit, token, best), np.where(hit, look, best_end)
            stop = np.flatnonzero(~go)
            if len(stop):
                out.append((word[stop], best_end[stop], best[stop]))
                node[stop], look[stop], best[stop] = 0, best_end[stop], -1
                keep = best_end < end
                keep[go] = True
                word, node, look, best, best_end, end = word[keep], node[keep], look[keep], best[keep], best_end[keep], end[keep]
        if not out:
            return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
        w, e, t = (np.concatenate([o[k] for o in out]) for k in range(3))
        order = np.argsort(e)  # a token's end orders it within all words
        return t[order], np.searchsorted(w[order], np.arange(len(off)))

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of tokens a then b encode to just these two."""
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        limit = np.full(len(a), _NONE)
        while len(at):
            joined = self._lookup(self.pair_key, self.pair_token, (a << 24) + b, int(_NONE))
            bad = joined < limit
            good[at[bad]] = False
            # Undo the later merge of the two; where it is a byte already, the other's.
            first = a > b
            a_next, b_next = self.right[a], self.left[b]
            a_stuck, b_stuck = a_next == a, b_next == b
            use_a = np.where(first, ~a_stuck, b_stuck & ~a_stuck)
            use_b = ~use_a & ~b_stuck
            limit = np.where(use_a, a, b + 1)
            a, b = np.where(use_a, a_next, a), np.where(use_b, b_next, b)
            go = np.flatnonzero(~bad & (use_a | use_b))
            at, limit, a, b = at[go], limit[go], a[go], b[go]
        return good

    def exact(self, word: bytes) -> list[int]:
        if "_pairs" not in self.__dict__:
            self._pairs = {(int(k) >> 24, int(k) & 0xFFFFFF): int(v) for k, v in zip(self.pair_key, self.pair_token)}
        return merge([int(self.byte[b]) for b in word], self._pairs)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """Tokens of words on end, the words' bounds in them, and how many words needed exact merging."""
        buf, off = X.utf8(pa.array(words, pa.string()))
        tokens, bounds = self.propose(buf, off)
        word = np.repeat(np.arange(len(words)), np.diff(bounds))
        inner = np.flatnonzero(word[1:] == word[:-1]) if len(word) else word
        pairs, where = np.unique((tokens[inner] << 24) + tokens[inner + 1], return_inverse=True)
        good = self.compatible(pairs >> 24, pairs & 0xFFFFFF)[where]
        failing = np.unique(word[inner[~good]])
        if len(failing):
            stay = np.ones(len(words), bool)
            stay[failing] = False
            size = np.diff(off)[failing]
            short = failing[size <= LOCKSTEP]
            some, owner = self.exact_short(buf, off, short)
            long = [(i, self.exact(buf[off[i] : off[i + 1]].tobytes())) for i in failing[size > LOCKSTEP].tolist()]
            tokens = np.concatenate([tokens[stay[word]], some, *(np.array(x, np.int64) for _, x in long)])
            word = np.concatenate([word[stay[word]], owner, *(np.full(len(x), i) for i, x in long)])
            order = np.argsort(word, kind="stable")
            tokens, bounds = tokens[order], np.searchsorted(word[order], np.arange(len(words) + 1))
        return tokens, bounds, len(failing)

    def exact_short(self, buf: np.ndarray, off: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of the given words in step: each round merges every word's leftmost pair of lowest rank."""
        at = X.ranges(off[words], off[words + 1])
        token, word = self.byte[buf[at]], np.repeat(words, np.diff(off)[words])
        out: list = []
        rank = self._ranks(token, word)
        while len(token):
            edge = X.runs(word)
            low = np.minimum.reduceat(rank, edge[:-1])
            done = low == _NONE
            if done.any():
                rest = np.repeat(~done, np.diff(edge))
                out.append((token[~rest], word[~rest]))
                token, word, rank, low = token[rest], word[rest], rank[rest], low[~done]
                if not len(token):
                    break
                edge = X.runs(word)
            hits = np.flatnonzero(rank == np.repeat(low, np.diff(edge)))
            hits = hits[X.runs(word[hits])[:-1]]
            token[hits] = low
            keep = np.ones(len(token), bool)
            keep[hits + 1] = False
            hits = hits - np.arange(len(hits))  # their places once the merged right parts are gone
            token, word, rank = token[keep], word[keep], rank[keep]
            for near in (hits, hits[hits > 0] - 1):
                rank[near] = self._ranks(token, word, near)
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        token, word = (np.concatenate([o[k] for o in out]) for k in range(2))
        order = np.argsort(word, kind="stable")
        return token[order], word[order]

    def _ranks(self, token: np.ndarray, word: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Rank of the pair that starts at each of the given places, _NONE where there is none."""
        at = np.arange(len(token)) if at is None else at
        to = np.minimum(at + 1, len(token) - 1)
        found = self._lookup(self.pair_key, self.pair_token, (token[at] << 24) + token[to], int(_NONE))
        return np.where((word[at] == word[to]) & (to > at), found, _NONE)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of texts on end (int32) and the texts' bounds in them."""
        import regex

        if "_known" not in self.__dict__ or len(self._known) > CACHE_WORDS:
            self._known, self._tokens, self._bounds = {}, np.zeros(0, np.int32), np.zeros(1, np.int64)
            self._words = regex.compile(self.pattern).findall
        known = self._known
        cut = [self._words(t) if t else [] for t in texts]
        new = [w for w in dict.fromkeys(w for words in cut for w in words) if w not in known]
        if new:
            tokens, bounds, _ = self.encode_words(new)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            self._tokens = np.concatenate([self._tokens, tokens.astype(np.int32)])
            self._bounds = np.concatenate([self._bounds, self._bounds[-1] + bounds[1:]])
        ids = np.fromiter((known[w] for words in cut for w in words), np.int64)
        start, end = self._bounds[ids], self._bounds[ids + 1]
        upto = np.concatenate([[0], np.cumsum(end - start)])
        return self._tokens[X.ranges(start, end)], upto[np.concatenate([[0], np.cumsum([len(words) for words in cut])]).astype(np.int64)]

    def decode(self, tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the token sequences on end, and their bounds."""
        start, end = self.off[tokens], self.off[tokens + 1]
        upto = np.concatenate([[0], np.cumsum(end - start)])
        return self.bytes[X.ranges(start, end)], upto[bounds]


def _arrays(codec: Codec, text: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """tokens, n_tokens and whether decoding gives the text again."""
    tokens, bounds = codec.encode(text.to_pylist())
    buf, off = X.utf8(text)
    raw, upto = codec.decode(tokens, bounds)
    if np.array_equal(raw, buf) and np.array_equal(upto, off):
        same = np.ones(len(text), bool)
    else:
        same = np.array([raw[a:b].tobytes() == buf[c:d].tobytes() for a, b, c, d in zip(upto, upto[1:], off, off[1:])], bool)
    lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens, pa.int32()), mask=text.is_null() if text.null_count else None)
    return lists, pa.array(np.diff(bounds).astype(np.int64)), pa.array(same)


def encode(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, drop_text: bool = False) -> DataFrame:
    """docs with ``tokens`` (array<int>), ``n_tokens`` and ``round_trip`` (decoding gave the text again), which is true of every text."""
    E.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Codec(read_vocabulary(path), pattern))
    made = ("tokens", "n_tokens", "round_trip")
    other = [c for c in docs.columns if c not in made and not (drop_text and c == "text")]
    docs = docs.select(*[F.col(f"`{c}`") for c in other], F.col("text").cast("string").alias("__bpe_text"))

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for b in batches:
            for s in X.pieces(b, "__bpe_text"):
                yield pa.RecordBatch.from_arrays([*(s.column(c) for c in other), *_arrays(codec, s.column("__bpe_text"))], [*other, *made])
        X.tidy()

    schema = docs.drop("__bpe_text").schema.add("tokens", T.ArrayType(T.IntegerType())).add("n_tokens", T.LongType()).add("round_trip", T.BooleanType())
    return docs.mapInArrow(source, schema)


def decode(rows: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """rows with ``text`` from their ``tokens``; null tokens give a null text. Bytes that aren't UTF-8 become replacement characters."""
    shared = rows.sparkSession.sparkContext.broadcast(Codec(read_vocabulary(path)))

    @F.arrow_udf("string")
    def text(tokens: pa.Array) -> pa.Array:
        flat = pc.list_flatten(tokens).to_numpy(zero_copy_only=False).astype(np.int64)
        size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        raw, upto = shared.value.decode(flat, np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
        whole = raw.tobytes()
        return pa.array([whole[a:b].decode(errors="replace") if ok else None for a, b, ok in zip(upto, upto[1:], tokens.is_valid().to_pylist())], pa.string())

    return rows.withColumn("text", text(F.col("tokens").cast("array<int>")))
