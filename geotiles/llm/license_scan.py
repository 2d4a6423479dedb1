"""License scan by diagonal voting.

1. Grams: the words of a text (A-Z lowered) are hashed, and every run of k words gets a rolling hash; k is two and three.
2. Votes: the grams meet those of the templates in a broadcast equi join (the table of templates is a parameter of some thousand rows).
   A hit is kept only if its words are the template's, so hashes decide nothing alone.
   A hit at word p of a template's gram t votes for the diagonal p - t.
3. Spans: votes are added up by (document, template, diagonal), and diagonals at most ``SLACK`` words from the one before join it: words
   put in or left out move a copy to a neighbouring diagonal.
4. A span is verified by the distinct grams of its template that voted (``COVERAGE`` of them, all of a template of less than five) and by their density.

Phrases are short templates of one gram; each of their hits is a place.  Texts never move: only hits, and one row a document,
are shuffled, and the votes of a diagonal are bounded by its template.

Defined results: null and wordless text has no words, places or labels and the score 0; texts of any length (cut to pieces
that overlap by a gram); repeated rows are documents of their own; labels are distinct and sorted; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

KS = (2, 3)
COVERAGE = 0.6
DENSITY = 0.5
SLACK = 8
_PIECE = 1 << 14  # words hashed and sent at a time
_WIDEST = 24  # bytes of a template's word at most

#: The phrases of the contract and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Wording of public licenses and of the usual notices, by label.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation"
            " files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy,"
            " modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software"
            " is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be"
            " included in all copies or substantial portions of the Software."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,"
            " provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following"
            " conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the"
            " following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and"
            " the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "under the BSD license"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the"
               " License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an"
               " AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific"
               " language governing permissions and limitations under the License."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"
            " as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by", "Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0"),
)

_LOW = np.full(256, 32, np.uint8)  # a byte of a word in lower case, a blank for any other
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _LOW[_b] = _b
_LOW[0x41:0x5B] = np.arange(0x61, 0x7B)
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def words_of(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lowered bytes with a blank for what is no word, start and end of each word)."""
    low = _LOW[np.frombuffer(text, np.uint8)]
    edges = np.flatnonzero(np.diff(np.concatenate(([False], low != 32, [False])).view(np.int8)))
    return low, edges[::2], edges[1::2]


def _word_hashes(low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Of the first 24 bytes, read as three numbers, and the length (no template has a longer word)."""
    room = np.concatenate((low, np.zeros(_WIDEST + 8, np.uint8)))
    eight = np.ndarray(len(room) - 7, "<u8", room, strides=(1,))
    size = end - start
    out = size.astype(np.uint64) * _MIX[3]
    for j in range(3):
        out += (eight[start + 8 * j] & _MASKS[np.clip(size - 8 * j, 0, 8)]) * _MIX[j]
    out = (out ^ (out >> np.uint64(32))) * _MIX[4]
    return out ^ (out >> np.uint64(29))


def _grams(hashes: np.ndarray, k: int, n: int) -> np.ndarray:
    """Rolling hashes of the first n runs of k words."""
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * _MIX[0] + hashes[j:j + n]
    return out.view(np.int64)


def gram_table(spark: SparkSession, phrases: Sequence[tuple[str, str]] = PHRASES,
               templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(gram, said, k, template, label, at, n_grams): the grams of phrases (template below zero) and templates."""
    rows = []
    for no, label, text, phrase in ([(-1 - i, label, text, True) for i, (text, label) in enumerate(phrases)]
                                    + [(i, label, text, False) for i, (label, text) in enumerate(templates)]):
        low, start, end = words_of(text.encode())
        k = len(start) if phrase else KS[-1]
        if k not in KS or len(start) < k or (end - start).max() > _WIDEST:
            raise ValueError(f"a template must have three words at least, a phrase two or three: {text}")
        said = [low[a:b].tobytes().decode() for a, b in zip(start, end)]
        grams = _grams(_word_hashes(low, start, end), k, len(said) - k + 1)
        rows += [(int(g), " ".join(said[i:i + k]), k, no, label, i, len(grams)) for i, g in enumerate(grams)]
    return spark.createDataFrame(rows, "gram long, said string, k int, template int, label string, at int, n_grams int")


_PIECES = "rid long, doc_id {}, n_words long, base long, n_pairs int, low binary, starts array<int>, ends array<int>, grams array<long>"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of the texts of (doc_id, text) batches with the hashes of their grams: those of two words, then those of three."""
    rid = TaskContext.get().partitionId() << 33
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()))
    names = ("rid", "n_words", "base", "n_pairs", "low", "starts", "ends", "grams")
    for b in batches:
        rows, owners, waiting = [], [], 0

        def sent() -> pa.RecordBatch:
            columns = dict(zip(names, (pa.array(v, t) for v, t in zip(zip(*rows), types)))) | {"doc_id": b.column(0).take(pa.array(owners))}
            return pa.RecordBatch.from_arrays([columns[c] for c in ("rid", "doc_id", *names[1:])], ["rid", "doc_id", *names[1:]])

        for i in range(b.num_rows):
            low, start, end = words_of(b.column(1)[i].as_buffer())
            rid += 1
            for at in range(0, max(len(start), 1), _PIECE):
                a, z = start[at:at + _PIECE + KS[-1] - 1], end[at:at + _PIECE + KS[-1] - 1]
                own = min(len(start) - at, _PIECE)
                first = int(a[0]) if len(a) else 0
                bytes_ = low[first:int(z[-1])] if len(a) else low[:0]
                a, z = a - first, z - first
                hashes = _word_hashes(bytes_, a, z)
                grams = [_grams(hashes, k, max(0, min(own, len(a) - k + 1))) for k in KS]
                rows.append((rid, len(start), at, len(grams[0]), bytes_.tobytes(), a.astype(np.int32), z.astype(np.int32), np.concatenate(grams)))
                owners.append(i)
                waiting += own
                if waiting >= 8 * _PIECE:
                    yield sent()
                    rows, owners, waiting = [], [], 0
        if rows:
            yield sent()


def hits(docs: DataFrame, grams: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(rid, doc_id, n_words, template, label, at, n_grams, k, pos), written: every gram that is a template's, and a row a document without template."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_or_empty(F.col(f"`{text}`")).cast("binary").alias("text"))
    pieces = slim.mapInArrow(_pieces, _PIECES.format(slim.schema["doc_id"].dataType.simpleString()))
    rolled = pieces.select("*", F.posexplode_outer("grams").alias("i", "gram")).withColumn(
        "word", F.when(F.col("i") < F.col("n_pairs"), F.col("i")).otherwise(F.col("i") - F.col("n_pairs")))
    table = grams.withColumnRenamed("gram", "g")
    raw = F.expr("cast(substring(low, starts[word] + 1, ends[word + k - 1] - starts[word]) as string)")
    met = rolled.join(F.broadcast(table), (F.col("gram") == F.col("g")) & (F.regexp_replace(raw, " +", " ") == F.col("said")), "left")
    kept = met.where(F.col("template").isNotNull() | ((F.col("base") == 0) & (F.coalesce("i", F.lit(0)) == 0)))
    return written(kept.select("rid", "doc_id", "n_words", "template", "label", "at", "n_grams", "k",
                               (F.col("base") + F.col("word")).alias("pos")), "license-hits")


def spans(found: DataFrame) -> DataFrame:
    """(rid, template, label, first_word, last_word, coverage): the verified spans of templates among hits."""
    votes = (found.where("template >= 0").groupBy("rid", "template", "label", "n_grams", (F.col("pos") - F.col("at")).alias("diagonal"))
             .agg(F.collect_set("at").alias("at"), F.min("pos").alias("a"), F.max(F.col("pos") + F.col("k") - 1).alias("z")))
    order = Window.partitionBy("rid", "template").orderBy("diagonal")
    opens = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > SLACK, F.lit(True))
    merged = (votes.withColumn("opens", opens.cast("int")).withColumn("span", F.sum("opens").over(order))
              .groupBy("rid", "template", "label", "n_grams", "span")
              .agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("seen"), F.sum(F.size("at")).alias("votes"),
                   F.min("a").alias("first_word"), F.max("z").alias("last_word")))
    need = F.greatest(F.ceil(COVERAGE * F.col("n_grams")), F.least("n_grams", F.lit(4)))
    dense = F.col("votes") >= DENSITY * (F.col("last_word") - F.col("first_word") + 2 - KS[-1])
    return merged.where((F.col("seen") >= need) & dense).select(
        "rid", "template", "label", "first_word", "last_word", (F.col("seen") / F.col("n_grams")).alias("coverage"))


def scan(docs: DataFrame, text: str = "text", id_col: str = "doc_id", phrases: Sequence[tuple[str, str]] = PHRASES,
         templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row per row; score is the best coverage."""
    found = hits(docs, gram_table(docs.sparkSession, phrases, templates), text, id_col)
    base = F.col("template") < 0
    rows = found.groupBy("rid", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"), F.min(F.when(base, F.col("pos"))).alias("first_word"),
        F.max(F.when(base, F.col("pos"))).alias("last_word"), F.collect_set(F.when(base, F.col("label"))).alias("said"))
    more = spans(found).groupBy("rid").agg(F.collect_set("label").alias("more"), F.max("coverage").alias("coverage"))
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    both = F.array_distinct(F.concat("said", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("coverage", F.lit(0.0)))
    return rows.join(more, "rid", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", joined(F.col("said")).alias("base_labels"), joined(both).alias("labels"), score.alias("score"))
