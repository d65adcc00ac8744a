"""License scans by diagonal voting.

All rolling K-word hashes of a text are joined to the template positions that have them; each pair
votes for the diagonal, place in the text minus place in the template, and votes are added up for
each text, template and diagonal. Diagonals of one template whose values follow one another by at most SLIP are
neighbours (an inserted or lost word moves the rest by one); of neighbours those whose places lie at most
GAP words apart are merged, so a stray vote of a phrase that stands twice in a template does not part a notice, and each merged span is verified on the words:
at least half of the template's grams must have voted, and the longest common subsequence of span and
template must hold SHARE of the template. The spans of a text go to its words together, so these are sent
once. The numbers of a template, its version, tell it from others
and must stand where the votes place them, after the same word ("version 3"; "v 3" and "v3" will do, and
"2" for "2 0"). A hash that is in
no template joins nothing, so the scan of a text passes on only those in some template; the templates
are constants, a few hundred positions, and are broadcast.

Base phrases are found beside that, at every place where their words follow one another.

Defined results: null and empty texts have no words, labels are then empty strings, places null and
score 0. Score: the best verified share, at least 0.5 where a base phrase stands, else 0. Rows that
repeat doc_id and text get equal results each; a null doc_id keeps its row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, NOT_ALNUM, Workspace, chunks, grams, map_arrow, word_hashes, word_spans

K = 4
SLIP = 3
GAP = 12  # words between two votes of one notice
SHARE = 0.8

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Notices of public licenses, and the method's own labels.
TEMPLATES = [
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0"),
    ("cc-by-4.0", "licensed under cc by 4 0"),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("mit-notice", "released under the mit license"),
    ("mit-notice", "licensed under the mit license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
]


def hashes(text: str) -> np.ndarray:
    flat = LOWER[np.frombuffer(text.encode(), np.uint8)]
    starts, ends, _ = word_spans(flat, np.array([0, len(flat)]), NOT_ALNUM)
    return word_hashes(flat, starts, ends)


def scan(docs: DataFrame, doc_id: str, text: str, phrases: dict[str, str], templates: list[tuple[str, str]]) -> DataFrame:
    """Per row: doc_id, th, counts of words and base places, and where template grams stand (with the words, only then)."""
    base = [(hashes(p), label) for p, label in phrases.items()]
    wanted = np.unique(np.concatenate([grams(hashes(t), K) for _, t in templates]))

    def places(words: np.ndarray, first: np.ndarray, last_row: np.ndarray) -> list[tuple[str, np.ndarray]]:
        out = []
        for p, label in base:
            at = np.flatnonzero(words == p[0])
            at = at[at + len(p) <= len(words)]
            for j in range(1, len(p)):
                at = at[words[at + j] == p[j]]
            out.append((label, at[last_row[at] == last_row[at + len(p) - 1]]))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: dict[str, list] = {n: [] for n in ("n_words", "n_base", "first_word", "last_word", "base_labels", "gram", "pos", "words")}
            for a, b, flat, offsets in chunks(batch.column(1)):
                flat = LOWER[flat]
                starts, ends, first = word_spans(flat, offsets, NOT_ALNUM)
                words = word_hashes(flat, starts, ends)
                row = np.repeat(np.arange(b - a), np.diff(first))
                found = places(words, first, row)
                every = np.sort(np.concatenate([at for _, at in found]))
                g = grams(words, K)
                slot = np.minimum(np.searchsorted(wanted, g), len(wanted) - 1)
                hit = np.flatnonzero(wanted[slot] == g)
                hit = hit[row[hit] == row[hit + K - 1]]
                e, h = np.searchsorted(every, first), np.searchsorted(hit, first)
                for i in range(b - a):
                    own = every[e[i] : e[i + 1]]
                    at = hit[h[i] : h[i + 1]]
                    cols["n_words"].append(int(first[i + 1] - first[i]))
                    cols["n_base"].append(len(own))
                    cols["first_word"].append(int(own[0] - first[i]) if len(own) else None)
                    cols["last_word"].append(int(own[-1] - first[i]) if len(own) else None)
                    cols["base_labels"].append(sorted({label for label, p in found if len(own) and ((p >= first[i]) & (p < first[i + 1])).any()}))
                    cols["gram"].append(g[at].view(np.int64))
                    cols["pos"].append(at - first[i])
                    cols["words"].append(words[first[i] : first[i + 1]].tobytes() if len(at) else None)
            kinds = [pa.int64()] * 4 + [pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, t) for c, t in zip(cols.values(), kinds, strict=True))], ["doc_id", "th", *cols])

    schema = "doc_id long, th long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, gram array<long>, pos array<long>, words binary"
    return map_arrow(docs.select(F.col(doc_id).cast("long"), F.col(text), F.xxhash64(text)), run, schema)


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Length of the longest common subsequence, one row of the table at a time."""
    best = np.zeros(len(y) + 1, np.int64)
    for w in x:
        best[1:] = np.maximum.accumulate(np.maximum(best[1:], np.where(y == w, best[:-1] + 1, 0)))
    return int(best[-1])


def same_versions(t: np.ndarray, w: np.ndarray, low: int, high: int) -> bool:
    """Whether each run of digits in template t stands in text w too, within SLIP of the diagonals from low to high."""
    digits, joined, v = hashes("0 1 2 3 4 5 6 7 8 9"), hashes("v0 v1 v2 v3 v4 v5 v6 v7 v8 v9"), hashes("v")[0]
    own = np.isin(t, digits)

    def follows(j: int, run: np.ndarray) -> bool:
        if np.array_equal(w[j : j + len(run)], run):
            return True
        while len(run) and run[-1] == digits[0]:
            run = run[:-1]
        return np.array_equal(w[j : j + len(run)], run) and not np.isin(w[j + len(run) : j + len(run) + 1], digits).any()

    for i in np.flatnonzero(own[1:] & ~own[:-1]) + 1:
        run = t[i : i + int(np.append(own[i:], False).argmin())]
        near = range(max(0, i - 1 + low - SLIP), min(len(w), i + high + SLIP))
        one_word = joined[digits == run[0]][0]
        if not any(follows(j + 1, run) if w[j] in (t[i - 1], v) else w[j] == one_word and follows(j + 1, run[1:]) for j in near):
            return False
    return True


def licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES) -> tuple[DataFrame, DataFrame]:
    """(rows, spans): rows as ``scan``; spans (doc_id, th, label, begin, end, share) that are verified, places in words."""
    spark = docs.sparkSession
    ws = Workspace(spark, "license")
    rows = ws.save(scan(docs, doc_id, text, phrases, templates), "scan")
    sized = [(i, label, hashes(t)) for i, (label, t) in enumerate(templates)]
    positions = spark.createDataFrame([(i, p, int(g)) for i, _, h in sized for p, g in enumerate(grams(h, K).view(np.int64))], "template int, at long, gram long")
    hits = rows.where("words IS NOT NULL").select("doc_id", "th", F.explode(F.arrays_zip("gram", "pos")).alias("x")).select("doc_id", "th", "x.gram", "x.pos").distinct()
    votes = hits.join(F.broadcast(positions), "gram").groupBy("doc_id", "th", "template", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.count("*").alias("votes"), F.min("pos").alias("begin"), (F.max("pos") + K).alias("end"))
    by_value = Window.partitionBy("doc_id", "th", "template").orderBy("diagonal")
    votes = votes.withColumn("group", F.sum(F.when(F.col("diagonal") - F.lag("diagonal").over(by_value) > SLIP, 1).otherwise(0)).over(by_value))
    by_place = Window.partitionBy("doc_id", "th", "template", "group").orderBy("begin", "diagonal")
    apart = F.col("begin") > F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1)) + GAP
    merged = votes.withColumn("span", F.sum(F.when(apart, 1).otherwise(0)).over(by_place)).groupBy("doc_id", "th", "template", "group", "span").agg(F.sum("votes").alias("votes"), F.min("begin").alias("begin"), F.max("end").alias("end"), F.min("diagonal").alias("low"), F.max("diagonal").alias("high"))
    words = rows.where("words IS NOT NULL").groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.first("words").alias("words"))
    half = F.array(*[F.lit((len(h) - K + 2) // 2) for _, _, h in sized])  # of a template's grams
    kept = merged.where(F.col("votes") >= half[F.col("template")]).groupBy("doc_id", "th").agg(F.collect_list(F.struct("template", "begin", "end", "low", "high")).alias("found"))
    texts = kept.join(words, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h"))).select("doc_id", "th", "found", "words")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for d, h, found, raw in zip(*(batch.column(j) for j in range(4)), strict=True):
                w = np.frombuffer(raw.as_buffer(), np.uint64)
                for i, begin, end, low, high in zip(*(x.to_pylist() for x in found.values.flatten()), strict=True):
                    _, label, t = sized[i]
                    begin, end = max(0, begin - len(t)), min(len(w), end + len(t))  # grams lost at the edges
                    share = common(t, w[begin:end]) / len(t)
                    if share >= SHARE and same_versions(t, w, low, high):
                        out.append((d.as_py(), h.as_py(), label, begin, end, share))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(kinds)], ["doc_id", "th", "label", "begin", "end", "share"])

    return rows, map_arrow(texts, verify, "doc_id long, th long, label string, begin long, end long, share double")


def scan_documents(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    rows, spans = licenses(docs)
    per = spans.groupBy(F.col("doc_id").alias("d"), F.col("th").alias("h")).agg(F.collect_set("label").alias("own"), F.max("share").alias("share"))
    both = rows.join(per, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("h")), "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("own", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("share", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0))
    return both.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), score.alias("score"))
