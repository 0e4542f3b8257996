"""License scans by diagonal voting.

How: all rolling 3-grams of the documents' plain words are joined by hash to the places of the same 3-grams in license templates. A match at
word p of a document and word t of a template votes for the diagonal p - t. Diagonals of the same document and template that are at most 3 apart
are merged, which bears inserted or lost words, and a merged diagonal is verified: the template words that lie in matched 3-grams must be
at least 60 per cent of the template, within a stretch of the document of at most one and a half times the template's words; a longer one holds several copies, and its diagonals are
verified one by one. Of spans that overlap, one goes if another covers
more words, or as many and a larger share of its template, or the same and its license comes first by name. The template
table is small by nature (it holds license texts, not data), so its side of the join is broadcast as long as its rows are counted to be few, and the documents' words don't move.

Cases: null, empty and short texts have no match. Very long texts are scanned whole. Rows without doc_id are left out. Rows that repeat a doc_id are one document; equal
matches count once. A template that occurs twice in a document gives two rows. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from . import exchange as E, textops as X

K, APART, COVER, STRETCH = 3, 3, 60, 150

TEMPLATES: dict[str, str] = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-notice-2": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.',
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "LGPL-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "AGPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "all-rights-reserved": "All rights reserved.",
}


def plain(text: str) -> list[str]:
    """Plain words of one text, as textops finds them."""
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", text.lower()) if w]


def template_table(spark: SparkSession, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """license, size in words, place and hash of each 3-gram of the templates."""
    names = sorted(templates)
    w = X.plain_words(pa.array([templates[n] for n in names]))
    g, at = X.text_grams(w, K)
    doc = w.doc[at]
    size = np.diff(w.first)
    return spark.createDataFrame(pa.table({"gram": X.signed(g), "license": [names[i] for i in doc], "size": size[doc].astype(np.int32), "place": (at - w.first[doc]).astype(np.int32)}))


def matches(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, size, word, place of every 3-gram of docs that is in a template."""

    def source(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in X.pieces(b):
                w = X.plain_words(s.column("text"))
                g, at = X.text_grams(w, K)
                doc = w.doc[at]
                ids = s.column("doc_id").to_numpy()[doc]
                word = (at - w.first[doc]).astype(np.int32)
                for a in range(0, len(g), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in (ids, word, X.signed(g))], ["doc_id", "word", "gram"])

    E.small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    grams = docs.mapInArrow(source, "doc_id bigint, word int, gram bigint")
    return grams.join(E.lean(template_table(docs.sparkSession, templates)), "gram").select("doc_id", "license", "size", "word", "place").distinct()


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, start_word, end_word, votes, covered, size of every verified span; words are plain words counted from 0."""
    votes = matches(docs, templates).withColumn("diagonal", F.col("word") - F.col("place"))
    by = W.partitionBy("doc_id", "license").orderBy("diagonal")
    begins = (F.col("diagonal") - F.lag("diagonal").over(by) > APART).cast("int")
    merged = votes.withColumn("begins", F.coalesce(begins, F.lit(0))).withColumn("band", F.sum("begins").over(by.rangeBetween(W.unboundedPreceding, 0)))
    measures = F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"), F.sum("votes").alias("votes"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")
    diagonals = merged.groupBy("doc_id", "license", "size", "band", "diagonal").agg(F.min("word").alias("start_word"), (F.max("word") + K).alias("end_word"), F.count(F.lit(1)).alias("votes"), F.collect_set("place").alias("places"))
    names = ("start_word", "end_word", "votes", "places")
    bands = diagonals.groupBy("doc_id", "license", "size", "band").agg(*measures, F.collect_list(F.struct(*names)).alias("own"))
    # A merged diagonal that is too long holds several copies: its diagonals stand for themselves.
    spans = bands.select("doc_id", "license", "size", F.inline(F.when((F.col("end_word") - F.col("start_word")) * 100 <= F.col("size") * STRETCH, F.array(F.struct(*names))).otherwise(F.col("own"))))
    words = F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + (K - 1)))))
    spans = spans.withColumn("covered", F.size(words).cast("int"))
    good = spans.filter((F.col("covered") * 100 >= F.col("size") * COVER) & ((F.col("end_word") - F.col("start_word")) * 100 <= F.col("size") * STRETCH)).select("doc_id", "license", "start_word", "end_word", "votes", "covered", "size")
    # A document's spans are few; each meets those that overlap it.
    span = F.struct("license", "start_word", "end_word", "votes", "covered", "size")
    return good.groupBy("doc_id").agg(F.collect_list(span).alias("spans")).select("doc_id", F.inline(F.filter("spans", lambda x: ~F.exists("spans", lambda y: _better(y, x))))).select(*good.columns)


def _better(y: Column, x: Column) -> Column:
    """Whether span y overlaps x and beats it."""
    share_y, share_x = y["covered"] * x["size"], x["covered"] * y["size"]
    beats = (y["covered"] > x["covered"]) | ((y["covered"] == x["covered"]) & ((share_y > share_x) | ((share_y == share_x) & (y["license"] < x["license"]))))
    return (y["start_word"] < x["end_word"]) & (x["start_word"] < y["end_word"]) & beats
