"""Benchmark decontamination: a BM25 inverted index of test items, queried by every training passage.

The index holds, for each term of the items, postings with BM25 impacts divided by the item's own
score (the score of a passage that holds all its terms), so a score runs from 0 to 1 and one
threshold serves items of any length. Items lie in blocks of BLOCK by order of their length; each
term keeps its greatest impact in each block and in all.

The passages that an item of L words is held against are windows of 2 L words, L apart, so that every occurrence lies whole in
one, and whether an item is found does not hang on which other items there are. Items are indexed in bands of lengths up to a power of two, and
each band's index is queried by passages that hold every window of its items: 4 times that power, half as far apart. Block-max WAND in its set-at-a-time form: the sum of the
greatest impacts of a passage's words bounds every item (most passages end here, by running sums over
whole batches); then the sum of the block maxima bounds each block; only items of blocks above the
threshold are scored. Whatever reaches the threshold there is verified in the item's own windows: one of them must reach the threshold
and hold enough of the word pairs of the question and of those of the answer.

Items come to the driver in groups of at most about GROUP_ITEMS and GROUP_CHARS, one after another, a bound on
each broadcast and on the driver; a larger benchmark makes more passes over the documents (a stated query set against all
rows, in blocks), whose findings are saved. Document frequencies and lengths are of all items.

Defined results: items without words are ignored; an item's question is what stands before the last
"?" or "Answer:" in it, else the first half of its words; an item with a null id has leaks with a null
id; null and empty documents have no leaks; nothing is said of rows, so repeated rows are each judged.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import LOWER, NOT_ALNUM, Workspace, chunks, grams, map_arrow, word_hashes, word_spans

K1, B = 1.2, 0.75
THRESHOLD = 0.6  # of an item's own score
OVERLAP = 0.5  # of the word pairs of question and answer each
BLOCK = 16
GROUP_ITEMS, GROUP_CHARS = 5000, 8_000_000
TABLE_BITS = 18
LEAK = pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question", pa.float64()), ("answer", pa.float64())])


def lower(flat: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and, in UTF-8, of the letters U+00C0 to U+00DE."""
    out = LOWER[flat]
    if len(flat) > 1:
        latin = (flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] <= 0x9E) & (flat[1:] != 0x97)
        out[1:][latin] += 32
    return out


def words_of(text: str) -> np.ndarray:
    flat = lower(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
    starts, ends, _ = word_spans(flat, np.array([0, len(flat)]), NOT_ALNUM)
    return word_hashes(flat, starts, ends)


def halves(text: str, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the question and of the answer."""
    cut = max((m.end() for m in re.finditer(r"\?|(?i:answer:)", text)), default=0)
    n = len(words_of(text[:cut])) if cut else 0
    if not 0 < n < len(words):
        n = (len(words) + 1) // 2
    return words[:n], words[n:]


class Index:
    """Impacts by term and item, their maxima by term and block, and what verification needs."""

    def __init__(self, items: list[tuple], n: int, avgdl: float):
        """items: (id, text, [(hash, tf, df)])."""
        items = sorted(items, key=lambda x: (sum(t[1] for t in x[2]), x[0] is None, x[0] or 0))
        self.ids = [x[0] for x in items]
        terms = np.unique(np.array([t[0] for x in items for t in x[2]], np.int64).view(np.uint64))
        at, item, impact = [], [], []
        self.size = [int(sum(t[1] for t in x[2])) for x in items]  # words
        self.step = 2 << band_of(self.size[-1])  # items of one band: two blocks hold any window of each
        self.own = []
        for i, (_, _, tt) in enumerate(items):
            h = np.array([t[0] for t in tt], np.int64).view(np.uint64)
            tf, df = np.array([t[1] for t in tt], float), np.array([t[2] for t in tt], float)
            dl = tf.sum()
            w = np.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))
            at.append(np.searchsorted(terms, h))
            item.append(np.full(len(h), i))
            impact.append(w / w.sum())
            self.own.append((h, impact[-1]))
        self.terms = terms
        at, item, impact = np.concatenate(at), np.concatenate(item), np.concatenate(impact)
        by = np.lexsort((item, at))
        self.item, self.impact = item[by], impact[by]
        self.first = np.searchsorted(at[by], np.arange(len(terms) + 1))
        self.top = np.zeros(len(terms))
        np.maximum.at(self.top, at, impact)
        cell = at * (len(items) // BLOCK + 1) + item // BLOCK
        cells, where = np.unique(cell, return_inverse=True)
        self.block_top = np.zeros(len(cells))
        np.maximum.at(self.block_top, where, impact)
        self.block = cells % (len(items) // BLOCK + 1)
        self.block_first = np.searchsorted(cells // (len(items) // BLOCK + 1), np.arange(len(terms) + 1))
        self.blocks = len(items) // BLOCK + 1
        self.parts = [tuple(pairs(p) for p in halves(x[1], words_of(x[1]))) for x in items]
        slot = (terms >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        self.slots = np.searchsorted(slot, np.arange((1 << TABLE_BITS) + 1)).astype(np.int32)

    def term_of(self, words: np.ndarray) -> np.ndarray:
        """Index of each word among the terms, or -1. Only words in an occupied slot are looked up."""
        slot = (words >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
        out = np.full(len(words), -1, np.int64)
        some = np.flatnonzero(self.slots[slot + 1] > self.slots[slot])
        found = np.minimum(np.searchsorted(self.terms, words[some]), len(self.terms) - 1)
        hit = self.terms[found] == words[some]
        out[some[hit]] = found[hit]
        return out

    def live(self, window: np.ndarray, terms: np.ndarray, windows: int, threshold: float) -> np.ndarray:
        """(windows, blocks): where the block maxima of a window's distinct terms reach the threshold."""
        at, n = ranges(self.block_first[terms], self.block_first[terms + 1])
        cell = np.repeat(window * self.blocks, n) + self.block[at]
        return (np.bincount(cell, self.block_top[at], windows * self.blocks) >= threshold).reshape(windows, self.blocks)

    def above(self, terms: np.ndarray, live: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        """Items of the live blocks whose score for a passage of these distinct terms reaches the threshold."""
        at, _ = ranges(self.first[terms], self.first[terms + 1])
        at = at[live[self.item[at] // BLOCK]]
        score = np.bincount(self.item[at], self.impact[at], len(self.ids))
        return [(int(i), min(1.0, float(score[i]))) for i in np.flatnonzero(score >= threshold)]


def band_of(words: int) -> int:
    """Binary logarithm of the least power of two that is not under the number of words."""
    return (words - 1).bit_length()


def indexes(items: list[tuple], n: int, avgdl: float) -> list[Index]:
    """One index for each band of the items (id, text, [(hash, tf, df)])."""
    by: dict[int, list[tuple]] = {}
    for x in items:
        by.setdefault(band_of(sum(t[1] for t in x[2])), []).append(x)
    return [Index(by[b], n, avgdl) for b in sorted(by)]


def ranges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers of the ranges a:b one after another, and the ranges' lengths."""
    n = b - a
    end = np.cumsum(n)
    return np.repeat(a - (end - n), n) + np.arange(end[-1] if len(end) else 0), n


def pairs(words: np.ndarray) -> np.ndarray:
    """Distinct neighbouring words; a lone word stands for itself."""
    return np.unique(grams(words, 2) if len(words) > 1 else words)


def share(part: np.ndarray, passage_pairs: np.ndarray, passage_words: np.ndarray, lone: bool) -> float:
    return float(np.isin(part, passage_words if lone else passage_pairs).mean()) if len(part) else 1.0


def grouped(ws: Workspace, items: DataFrame, item_id: str = "item_id", text: str = "text") -> tuple[DataFrame, int, int, float]:
    """(table, groups, n, mean length): the items (item_id, text, terms, group), saved; the groups are hashes of the text."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, list, list] = ([], [], [])
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, tf = np.unique(words_of(t or ""), return_counts=True)
                rows[0].extend([key] * len(h))
                rows[1].extend(h.view(np.int64).tolist())
                rows[2].extend(tf.tolist())
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int64()), pa.array(rows[2], pa.int64())], ["key", "h", "tf"])

    base = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).distinct().withColumn("key", F.xxhash64("item_id", "text"))
    tf = map_arrow(base.select("key", "text"), terms, "key long, h long, tf long")
    df = tf.groupBy("h").agg(F.count("*").alias("df"))
    per = tf.join(df, "h").groupBy("key").agg(F.collect_list(F.struct("h", "tf", "df")).alias("terms"), F.sum("tf").alias("dl"))
    full = ws.save(base.join(per, "key"), "items")
    n, avgdl, chars = full.agg(F.count("*"), F.avg("dl"), F.sum(F.length("text"))).first()
    groups = max(-(-n // GROUP_ITEMS), -(-(chars or 0) // GROUP_CHARS))
    return full.withColumn("group", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(max(1, groups)))), groups, n, avgdl or 0.0


def passages(index: Index, words: np.ndarray, first: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, list[tuple[int, float]]]]:
    """(row, first word, end word, items above the threshold with scores) of the windows that have any.

    Window j of a row is its blocks j and j + 1 of ``index.step`` words, so a word stands in two windows
    at most; it counts in one unless the same term stands before it there.
    """
    term, step = index.term_of(words), index.step
    sizes = np.diff(first)
    windows = np.maximum(1, -(-sizes // step) - 1)
    base = np.cumsum(windows) - windows
    at = np.flatnonzero(term >= 0)
    row = np.searchsorted(first, at, side="right") - 1
    start, t = first[row], term[at]
    block = (at - start) // step
    by = np.lexsort((t, row))
    before = np.full(len(at), -1)
    same = (t[by][1:] == t[by][:-1]) & (row[by][1:] == row[by][:-1])
    before[by[1:][same]] = at[by[:-1][same]]
    ws, ts = [], []
    for back in (0, 1):
        j = block - back
        new = (j >= 0) & (j < windows[row]) & (before < start + j * step)
        ws.append(base[row[new]] + j[new])
        ts.append(t[new])
    w, t = np.concatenate(ws), np.concatenate(ts)
    bound = np.bincount(w, index.top[t], int(windows.sum()))
    open_ = bound >= threshold
    keep = open_[w]
    by = np.argsort(w[keep], kind="stable")
    w, t = w[keep][by], t[keep][by]
    left = np.flatnonzero(open_)
    for a in range(0, len(left), 128):  # so many windows at a time bounds what their postings take
        some = left[a : a + 128]
        lo, hi = np.searchsorted(w, some[0]), np.searchsorted(w, some[-1], side="right")
        alive = index.live(np.searchsorted(some, w[lo:hi]), t[lo:hi], len(some), threshold)
        for k in np.flatnonzero(alive.any(1)):
            i = some[k]
            hits = index.above(t[np.searchsorted(w, i) : np.searchsorted(w, i, side="right")], alive[k], threshold)
            if hits:
                r = int(np.searchsorted(base, i, side="right")) - 1
                begin = int(first[r] + (i - base[r]) * step)
                yield r, begin, int(min(begin + 2 * step, first[r + 1])), hits


def held(index: Index, i: int, words: np.ndarray, begin: int, a: int, b: int, end: int, threshold: float, overlap: float) -> tuple[float, float, float] | None:
    """Best (score, question, answer) of item i in those of its own windows of a text (words begin:end) that lie in a:b."""
    size, (terms, impact), best = index.size[i], index.own[i], None
    for x in range(begin + -(-(a - begin) // size) * size, b, size):
        y = min(x + 2 * size, end)
        if y > b:
            break
        own = words[x:y]
        score = min(1.0, float(impact[np.isin(terms, own)].sum()))
        if score < threshold:
            continue
        two = pairs(own)
        q, r = (share(p, two, own, len(p) == 1 and not np.isin(p, two).all()) for p in index.parts[i])
        if q >= overlap and r >= overlap:
            best = max(best or (0.0, 0.0, 0.0), (score, q, r))
    return best


def leaks_of(own: list[Index], column: pa.Array, threshold: float, overlap: float) -> list[list[dict] | None]:
    """For each row its leaks, best window for each item."""
    out: list[list[dict] | None] = [None] * len(column)
    threshold -= 1e-9
    for a0, _, flat, offsets in chunks(column):
        flat = lower(flat)
        starts, ends, first = word_spans(flat, offsets, NOT_ALNUM)
        words = word_hashes(flat, starts, ends)
        found: dict[int, dict[tuple[int, int], tuple]] = {}
        for n, index in enumerate(own):
            for row, a, b, hits in passages(index, words, first, threshold):
                for i, _ in hits:
                    best = held(index, i, words, int(first[row]), a, b, int(first[row + 1]), threshold, overlap)
                    if best is not None:
                        known = found.setdefault(row, {})
                        known[n, i] = max(known.get((n, i), best), best)
        for row, known in found.items():
            out[a0 + row] = [{"item_id": own[n].ids[i], "score": s, "question": q, "answer": r} for (n, i), (s, q, r) in sorted(known.items())]
    return out


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """(doc_id, th, item_id, score, question, answer): a row for each document and item found in it; th is xxhash64 of the text.

    The index of one group of items at a time is built, sent and used, and what it finds is saved; no shuffle of texts.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "leaks")
    table, groups, n, avgdl = grouped(ws, items)
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(f"`{text}`").alias("th"), F.col(f"`{text}`").alias("text"))
    schema = "doc_id long, th long, item_id long, score double, question double, answer double"
    out = spark.createDataFrame([], schema)
    for g in range(groups):
        rows = table.where(F.col("group") == g).select("item_id", "text", "terms").collect()
        if not rows:
            continue
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(indexes([(r[0], r[1], [tuple(t) for t in r[2]]) for r in rows], n, avgdl)))

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            own = pickle.loads(shared.value)
            for batch in batches:
                found = leaks_of(own, batch.column(2), threshold, overlap)
                at = pa.array([i for i, x in enumerate(found) for _ in x or []], pa.int64())
                told = pa.array([x for y in found for x in y or []], LEAK)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *told.flatten()], ["doc_id", "th", "item_id", "score", "question", "answer"])

        out = out.unionByName(ws.save(map_arrow(given, run, schema), f"found-{g}"))
        shared.destroy()
    ws.drop("items")
    return out


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and item found in it: doc_id, item_id, score, question, answer (shares of word pairs)."""
    return leaks(docs, items).drop("th")


def clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold an item. Spark broadcasts what was found only where its saved size is small."""
    found = leaks(docs, items).select(F.col("doc_id").alias("__d"), F.col("th").alias("__h")).distinct()
    return docs.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__h")), "left_anti")
