"""Suffix-array dedup: passages of at least 50 words that occur more than once in the corpus, within or across documents.

How (difference-cover blockwise construction): a difference cover modulo 31 of 6 residues picks sample suffixes, so
that any two suffixes have a common offset below 31 at which both are sampled. Each sample suffix is named by its
first 20 words, and names that occur once are struck out. A suffix whose 50 words recur must have a sample with a
shared name within its first 31 words, so only these suffixes are put in buckets. A worker sorts one bucket at a time,
by the name of a suffix's first 50 words, then by place. Names are hashes that compare words to any depth at once, so no comparison
reads text, and ties that reach 50 words are the repeats looked for: ranks that order them further are not made.
Memory is bound by a bucket, whose number follows spark.sql.shuffle.partitions.

A repeat is a window of 50 raw words (maximal runs without ASCII white space) that stands at two places at least. The first
place is the one of least doc_id, then least word. Windows that overlap or touch are merged into spans.

Cases: null texts and texts under 50 words have no span. Rows without doc_id are left out here and stay as they are in
``drop_repeats``. Rows that repeat a doc_id are one document: equal windows at equal places of it are one, and if its
texts differ, the spans of all of them hold. A very long text is handled on its own. Empty tables give empty results. Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import exchange as E, textops as X

LENGTH, MODULUS = 50, 31
COVER = (1, 5, 11, 24, 25, 27)
_IN_COVER = np.isin(np.arange(MODULUS), COVER)


def _samples(docs: DataFrame, length: int) -> DataFrame:
    """doc_id, at: the cover samples whose name is shared."""
    depth = length - MODULUS + 1
    packer = E.Packer(E.width(docs.sparkSession), {"name": np.uint64, "at": np.uint32}, {"doc_id": np.int64})

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.pieces(b):
                w = X.raw_words(s.column("text"))
                g, at = X.text_grams(w, depth)
                doc = w.doc[at]
                rel = at - w.first[doc]
                # A text too short for a whole window of the given length can't take part.
                pick = np.flatnonzero(_IN_COVER[rel % MODULUS] & (np.diff(w.first)[doc] >= length))
                g = g[pick]
                yield from packer.add(E.bucket_of(g, packer.buckets), doc[pick], {"name": g, "at": rel[pick]}, {"doc_id": s.column("doc_id").to_numpy()}, len(s))
        yield packer.flush()

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = packer.read(batches)
        order = np.argsort(got["name"])
        size = np.diff(X.runs(got["name"][order]))
        keep = order[np.repeat(size > 1, size)]
        for a in range(0, len(keep), 1 << 20):
            own = keep[a : a + (1 << 20)]
            yield pa.RecordBatch.from_arrays([pa.array(got["doc_id"][own]), pa.array(got["at"][own].astype(np.int32))], ["doc_id", "at"])

    return E.regroup(docs, source, packer, reduce, "doc_id bigint, at int")


def repeat_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, kind, start_word, end_word: maximal spans of repeated windows.

    kind 'repeat' spans cover all places of repeated windows, kind 'drop' spans those that aren't the first place.
    Words count from 0; end_word is the first word after the span.
    """
    if length <= MODULUS:
        raise ValueError(f"length must be above {MODULUS}")
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    width = E.width(docs.sparkSession)
    E.small_batches(docs.sparkSession)
    samples = E.checkpoint(_samples(docs, length).groupBy("doc_id").agg(F.array_sort(F.collect_set("at")).alias("at")))
    able = E.of_ids(docs, samples.select("doc_id"), ["doc_id", "text"]).join(samples, "doc_id")
    buckets = E.Packer(width, {"prefix": np.uint64, "at": np.uint32}, {"doc_id": np.int64})
    places = E.Packer(width, {"at": np.uint32, "first": np.uint8}, {"doc_id": np.int64})

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.pieces(b):
                w = X.raw_words(s.column("text"))
                lists = s.column("at")
                off = lists.offsets.to_numpy().astype(np.int64)
                rel = lists.values.to_numpy()[off[0] : off[-1]].astype(np.int64)
                doc = np.repeat(np.arange(len(s)), np.diff(off))
                size = np.diff(w.first)[doc]
                fits = rel < size  # a repeated doc_id may have a shorter text
                at = w.first[doc[fits]] + rel[fits]
                # Suffixes from MODULUS - 1 words before a sample up to it.
                lo = np.maximum(at - MODULUS + 1, w.first[doc[fits]])
                lo[1:] = np.maximum(lo[1:], at[:-1] + 1)
                start = X.ranges(lo, at + 1)
                inside = start + length <= w.first[w.doc[start] + 1] if len(start) else np.zeros(0, bool)
                start = start[inside]
                prefix = X.grams(w.hash, length)[start]
                own = w.doc[start]
                yield from buckets.add(E.bucket_of(prefix, width), own, {"prefix": prefix, "at": start - w.first[own]}, {"doc_id": s.column("doc_id").to_numpy()}, len(s))
        yield buckets.flush()

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = buckets.read(batches)
        order = np.argsort(got["prefix"])
        size = np.diff(X.runs(got["prefix"][order]))
        ties = order[np.repeat(size > 1, size)]
        prefix, doc, at = got["prefix"][ties], got["doc_id"][ties], got["at"][ties]
        order = np.lexsort((at, doc, prefix))
        prefix, doc, at = prefix[order], doc[order], at[order]
        own = X.runs(prefix, doc, at)[:-1]
        prefix, doc, at = prefix[own], doc[own], at[own]
        edge = X.runs(prefix)
        first = np.zeros(len(prefix), np.uint8)
        first[edge[:-1]] = 1
        many = np.repeat(np.diff(edge) > 1, np.diff(edge))
        doc, at, first = doc[many], at[many], first[many]
        order = np.lexsort((at, doc))
        doc, at, first = doc[order], at[order], first[order]
        for a in range(0, len(doc), E.FLUSH):
            edge = X.runs(doc[a : a + E.FLUSH])
            slot = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
            ids = doc[a : a + E.FLUSH][edge[:-1]]
            yield from places.add(E.bucket_of(ids.view(np.uint64), width)[slot], slot, {"at": at[a : a + E.FLUSH], "first": first[a : a + E.FLUSH]}, {"doc_id": ids}, len(ids))
        yield places.flush()

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = places.read(batches)
        for kind in ("repeat", "drop"):
            keep = np.flatnonzero(got["first"] == 0) if kind == "drop" else np.arange(len(got["at"]))
            doc, at = got["doc_id"][keep], got["at"][keep].astype(np.int64)
            order = np.lexsort((at, doc))
            doc, at = doc[order], at[order]
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + length)
            start = np.flatnonzero(new)
            last = np.append(start[1:], len(at)) - 1 if len(start) else start
            yield pa.RecordBatch.from_arrays([pa.array(doc[start]), pa.array([kind] * len(start), pa.string()), pa.array(at[start].astype(np.int32)), pa.array((at[last] + length).astype(np.int32))], ["doc_id", "kind", "start_word", "end_word"])

    sorted_buckets = E.regroup(able, suffixes, buckets, sort, places.schema())
    return sorted_buckets.repartitionById(width, F.col("bucket")).mapInArrow(spans, "doc_id bigint, kind string, start_word int, end_word int")


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs without the words of 'drop' spans, so that each repeated passage stays at its first place.

    What is between the start of a span's first word and the next kept word goes; n_chars, where docs has it, becomes the new
    length. A document that loses all its words goes; one that had none before stays. Rows without doc_id stay as they are.
    """
    cut = E.checkpoint(repeat_spans(docs, length).filter("kind = 'drop'").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start_word", "end_word"))).alias("__cut")).withColumnRenamed("doc_id", "__id"))

    @F.arrow_udf("string")
    def without(text: pa.Array, cuts: pa.Array) -> pa.Array:
        out = []
        for t, spans in zip(text, cuts):
            if not spans.is_valid or not t.is_valid:
                out.append(t.as_py())
                continue
            raw = t.as_py().encode()
            w = X.raw_words(pa.array([t.as_py()]))
            kept, at = [], 0
            for s in spans.as_py():
                a, b = s["start_word"], s["end_word"]
                if a >= len(w):
                    break
                kept.append(raw[at : max(at, int(w.start[a]))])
                at = int(w.start[b]) if b < len(w) else len(raw)
            kept.append(raw[at:])
            new = b"".join(kept).decode()
            out.append(new if new.strip() else None)
        return pa.array(out, pa.string())

    few = E.small_ids(cut.select("__id"))
    same = docs["doc_id"] == cut["__id"]
    if few is not None:
        # Only documents that lose words go through the join and a worker.
        shared = docs.sparkSession.sparkContext.broadcast(few)

        @F.arrow_udf("boolean")
        def loses(ids: pa.Array) -> pa.Array:
            known = ids.is_valid()
            found = E.has(shared.value, ids.fill_null(0).to_numpy(zero_copy_only=False))
            return pa.array(found & np.asarray(known))

        marked = docs.withColumn("__loses", loses(F.col("doc_id").cast("bigint")))
        stay = marked.filter(~F.col("__loses")).drop("__loses")
        touched = marked.filter("__loses").drop("__loses")
        touched = touched.join(cut, touched["doc_id"] == cut["__id"])
    else:
        stay = docs.join(cut, same, "left_anti")
        touched = docs.join(cut, same)
    new = touched.withColumn("__text", without(F.col("text"), F.col("__cut"))).filter("__text IS NOT NULL OR text IS NULL")
    columns = {c: F.col("__text") if c == "text" else F.length("__text").cast(t) if c == "n_chars" else F.col(f"`{c}`") for c, t in docs.dtypes}
    return stay.unionByName(new.select(*(v.alias(c) for c, v in columns.items())))
