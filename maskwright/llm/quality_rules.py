"""Quality rules by repetition coverage: how many of a document's characters lie inside repeated n-grams and lines.

How: rolling hashes of n-grams of plain words (see textops) for n = 2 to 10, a slice of documents at a time in numpy. An n-gram
can only repeat where its first n - 1 words repeat, so each length looks at what the last one left.

Measures, in characters of plain words unless said otherwise:

* ``top2`` to ``top4``: the most that one n-gram covers, as its count times its characters, at most all characters; 0 if none repeats;
* ``dup5`` to ``dup10``: characters of words inside an n-gram that occurs more than once;
* ``echo``: characters of words that are the same as the word before;
* ``dup_line``: characters of non-empty lines (between LFs) that occurred before in the text, of ``line_chars`` in all such lines;
* ``symbol_words``: raw words with one of ``#$%&*+<=>@[\\]^_{|}~!``, of ``raw_words``.

A document is rejected if a share is above its limit in LIMITS, or if it has no word. The limits on ``top`` shares hold from TOP_FROM_WORDS (30) words on,
as in a few words the one repeat that any sentence may have is a large share; all other limits hold at any length. An n-gram or line of a document counts within it
alone, so repeated rows get equal results.

Cases: a null, empty or wordless text is rejected with all measures 0. A very long text is measured whole. Null doc_ids and other null columns play
no part. Empty tables give empty results. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import exchange as E, textops as X

TOP, DUP = (2, 3, 4), (5, 6, 7, 8, 9, 10)
#: Highest share that is kept, per hundred.
LIMITS = {"dup_line": 50, "echo": 25, "top2": 30, "top3": 30, "top4": 30, "dup5": 50, "dup6": 50, "dup7": 50, "dup8": 50, "dup9": 50, "dup10": 50, "symbol_words": 25}
#: The limits on ``top`` shares hold from so many words on: in a few words any repeat is a large share.
TOP_FROM_WORDS = 30
SYMBOLS = b"#$%&*+<=>@[\\]^_{|}~!"
COUNTS = ("n_words", "word_chars", "echo", *(f"top{n}" for n in TOP), *(f"dup{n}" for n in DUP), "line_chars", "dup_line", "raw_words", "symbol_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _characters(buf: np.ndarray) -> np.ndarray:
    """Characters before each byte."""
    out = np.zeros(len(buf) + 1, np.int64)
    np.cumsum((buf & 0xC0) != 0x80, out=out[1:])
    return out


def _repeats(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of keys in order, and the bounds of those that are equal, of the repeated ones alone."""
    order = np.argsort(key)
    edge = X.runs(key[order])
    size = np.diff(edge)
    many = size > 1
    return order[np.repeat(many, size)], np.concatenate([[0], np.cumsum(size[many])])


def measure(text: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text."""
    n_texts = len(text)
    w = X.plain_words(text)
    chars = _characters(w.buf)
    upto = np.zeros(len(w) + 1, np.int64)  # characters of words before each word
    np.cumsum(chars[w.end] - chars[w.start], out=upto[1:])
    out = {"n_words": np.diff(w.first), "word_chars": np.diff(upto[w.first])}
    salt = X.mix(np.arange(1, n_texts + 1, dtype=np.uint64))[w.doc]
    where = np.flatnonzero((w.hash[1:] == w.hash[:-1]) & (w.doc[1:] == w.doc[:-1])) + 1
    out["echo"] = np.bincount(w.doc[where], np.diff(upto)[where], n_texts).astype(np.int64)
    where = np.arange(len(w))
    for n in range(2, max(DUP) + 1):
        g = X.grams(w.hash, n)
        where = where[where < len(g)]
        where = where[w.doc[where] == w.doc[where + n - 1]]
        order, edge = _repeats(X.mix(g[where] ^ salt[where]))
        order = where[order]
        if n in TOP:
            best = np.zeros(n_texts, np.int64)
            one = order[edge[:-1]]
            np.maximum.at(best, w.doc[one], np.diff(edge) * (upto[one + n] - upto[one]))
            out[f"top{n}"] = np.minimum(best, out["word_chars"])
        where = np.sort(order)
        if n in DUP:
            inside = np.zeros(len(w) + 1, np.int32)
            np.add.at(inside, where, 1)
            np.add.at(inside, where + n, -1)
            covered = np.cumsum(inside[:-1]) > 0
            total = np.zeros(len(w) + 1, np.int64)
            np.cumsum(np.where(covered, np.diff(upto), 0), out=total[1:])
            out[f"dup{n}"] = np.diff(total[w.first])
    lines = X.Words(*X.utf8(text), _LINE)
    chars = _characters(lines.buf)
    size = chars[lines.end] - chars[lines.start]
    again = np.ones(len(lines), bool)
    key = X.mix(lines.hash ^ X.mix(lines.doc.astype(np.uint64) + X.U64(1)))
    order = np.lexsort((np.arange(len(lines)), key))
    again[order[X.runs(key[order])[:-1]]] = False
    out["line_chars"] = np.bincount(lines.doc, size, n_texts).astype(np.int64)
    out["dup_line"] = np.bincount(lines.doc, size * again, n_texts).astype(np.int64)
    raw = X.raw_words(text)
    odd = np.zeros(len(raw.buf) + 1, np.int64)
    np.cumsum(_SYMBOL[raw.buf], out=odd[1:])
    out["raw_words"] = np.diff(raw.first)
    out["symbol_words"] = np.bincount(raw.doc, odd[raw.end] > odd[raw.start], n_texts).astype(np.int64)
    return out


def _reasons(m: dict[str, np.ndarray]) -> list[tuple[str, np.ndarray]]:
    whole = {"dup_line": m["line_chars"], "symbol_words": m["raw_words"]}
    found = [("no_words", m["n_words"] == 0)]
    for k, limit in LIMITS.items():
        over = m[k] * 100 > limit * whole.get(k, m["word_chars"])
        found.append((k, over & (m["n_words"] >= TOP_FROM_WORDS) if k.startswith("top") else over))
    return found


def kept(text: pa.Array) -> np.ndarray:
    """Whether the rules keep each text."""
    batch = pa.RecordBatch.from_arrays([text], ["text"])
    X.tidy()
    return np.concatenate([np.zeros(0, bool), *(~np.any([x for _, x in _reasons(measure(p.column("text")))], axis=0) for p in X.pieces(batch))])


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, COUNTS, ``reasons`` (names of the limits passed, joined by commas, '' if none) and ``keep`` of each row."""

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.pieces(b):
                m = measure(s.column("text"))
                found = _reasons(m)
                names, flags = [k for k, _ in found], np.array([x for _, x in found])
                reasons = np.full(len(s), "", object)
                for i in np.flatnonzero(flags.any(axis=0)):
                    reasons[i] = ",".join(names[k] for k in np.flatnonzero(flags[:, i]))
                yield pa.RecordBatch.from_arrays([s.column("doc_id"), *(pa.array(m[k].astype(np.int64)) for k in COUNTS), pa.array(reasons, pa.string()), pa.array(~flags.any(axis=0))], ["doc_id", *COUNTS, "reasons", "keep"])

    E.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(source, "doc_id bigint, " + ", ".join(f"{k} bigint" for k in COUNTS) + ", reasons string, keep boolean")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, as they are."""
    E.small_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def good(text: pa.Array) -> pa.Array:
        return pa.array(kept(text), pa.bool_())

    return docs.filter(good(F.col("text").cast("string")))
