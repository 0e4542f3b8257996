"""Vectorised text primitives shared by the operators: words and n-grams of a whole Arrow batch as 64-bit hashes.

All functions work on the UTF-8 bytes of many documents at once; no Python object is made for a word.
Two word definitions are used:

* *raw* words: maximal runs of bytes other than the ASCII white space characters (tab, LF, VT, FF, CR, space);
* *plain* words: the text in lower case, split at every ASCII byte that is not a letter or digit. Bytes above
  127 (hence every non-ASCII character) belong to words.

A null text counts as an empty one. Hashes are 64 bits wide; two different words or n-grams are told apart
except with a probability of about 2**-64 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
# Workers share an executor's memory with the JVM: what Arrow frees goes back at once.
pa.set_memory_pool(pa.system_memory_pool())
try:
    _trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library, which has its own ways
    _trim = None
#: Bytes of text that are handled at once; bounds a worker's memory (about 60 bytes of arrays a byte of text).
SLICE_BYTES = 1 << 20

_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_TABLE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=U64) | U64(1)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BREAK = np.ones(256, bool)
_BREAK[48:58] = _BREAK[97:123] = _BREAK[65:91] = False
_BREAK[128:] = False

_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept and grown between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 0 if have is None else 2 * len(have))
        steps = np.full(size, base, U64)
        steps[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(steps)
    return have[:n]


def tidy() -> None:
    """Gives freed memory back to the system: workers outlive their tasks, and their heaps would stay as large as they ever were."""
    if _trim is not None:
        _trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of at most ``most`` bytes of text; a longer text is a run of its own."""
    if not len(batch):
        return
    text = batch.column(column)
    size = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(size) // most
    # A row that starts within one run and ends in another belongs to the later; giants get their own.
    cuts = np.flatnonzero(np.diff(run)) + 1
    edges = [0, *cuts.tolist(), len(batch)]
    for a, b in zip(edges, edges[1:]):
        if a < b:
            yield batch.slice(a, b - a)


def utf8(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts on end and the n + 1 offsets of the texts in them; nulls are empty."""
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if text.null_count:
        text = pc.fill_null(text, "")
    wide = pa.types.is_large_string(text.type) or pa.types.is_large_binary(text.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = text.buffers()
    if not len(text) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(text) + 1, np.int64)
    off = np.frombuffer(offsets, kind, len(text) + 1, text.offset * np.dtype(kind).itemsize).astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, off - off[0]


def lower(text: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(text, "") if text.null_count else text)


class Words:
    """Words of a run of texts: byte bounds ``start``/``end``, ``hash``, text index ``doc`` and the texts' ``first`` word."""

    __slots__ = ("buf", "doc", "end", "first", "hash", "off", "start")

    def __init__(self, buf: np.ndarray, off: np.ndarray, breaks: np.ndarray):
        self.buf, self.off = buf, off
        inside = np.empty(len(buf) + 2, bool)
        inside[0] = inside[-1] = False
        np.logical_not(breaks[buf], out=inside[1:-1])
        change = inside[1:] != inside[:-1]
        # A word ends with its text though the next text's first byte may go on with a word.
        inner = off[1:-1]
        inner = inner[(inner > 0) & (inner < len(buf))]
        joined = np.unique(inner[inside[inner] & inside[inner + 1]]) if len(inner) else inner
        edges = np.flatnonzero(change)
        if len(joined):
            edges = np.sort(np.concatenate([edges, joined, joined]))
        self.start, self.end = edges[0::2], edges[1::2]
        total = np.zeros(len(buf) + 1, U64)
        np.cumsum(_TABLE[buf] * _power(_BASE, len(buf)), out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * _power(_INVERSE, len(buf) + 1)[self.start])
        self.first = np.searchsorted(self.start, off, side="left")
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def __len__(self) -> int:
        return len(self.start)


def raw_words(text: pa.Array) -> Words:
    return Words(*utf8(text), _SPACE)


def plain_words(text: pa.Array) -> Words:
    return Words(*utf8(lower(text)), _BREAK)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n values from each position on (len - n + 1 of them), whatever text they are in."""
    k = len(hashes) - n + 1
    if k <= 0:
        return np.zeros(0, U64)
    total = np.zeros(len(hashes) + 1, U64)
    np.cumsum(hashes * _power(_BASE, len(hashes)), out=total[1:])
    return mix((total[n:] - total[:k]) * _power(_INVERSE, k) + U64(n))


def text_grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions of all n-grams that lie within one text."""
    g = grams(words.hash, n)
    at = np.flatnonzero(words.doc[: len(g)] == words.doc[n - 1 :]) if len(g) else np.zeros(0, np.int64)
    return g[at], at


def gram_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct n-gram hashes in ascending order, on end, and the texts' bounds in them.

    A text of 1 to n - 1 words has one gram, of all its words; a text without words has none.
    """
    g, at = text_grams(words, n)
    doc = words.doc[at]
    count = np.diff(words.first)
    for m in range(1, n):
        short = np.flatnonzero(count == m)
        if len(short):
            gm = grams(words.hash, m)
            g = np.concatenate([g, gm[words.first[short]]])
            doc = np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(count) + 1), side="left")


def planes(x: np.ndarray) -> bytes:
    """Little-endian bytes by significance, so that the upper bytes of small or sorted numbers compress away."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def unplanes(raw: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(kind).reshape(n)


def ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """start[0]..end[0]-1, start[1]..end[1]-1, and so on."""
    size = end - start
    if not len(size) or not size.sum():
        return np.zeros(0, np.int64)
    step = np.repeat(start - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
    return np.arange(len(step)) + step


def runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """First positions of the runs of equal keys in sorted arrays, and their length at the end."""
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = False
        for k in sorted_keys:
            new[1:] |= k[1:] != k[:-1]
    return np.append(np.flatnonzero(new), n)
