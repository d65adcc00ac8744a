"""Toxicity: linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Fit: a bounded, documented sample of labelled rows (``max_train``) comes to the driver; an n-gram
counts once a text (presence). With p and q the smoothed shares of toxic and clean texts that hold
an n-gram, its ratio is r = log(p / q); logistic regression with a ridge penalty is fitted to the
features r * presence. Texts of the sample with the same set of n-grams are one row to learn from, with
the label of most of them; texts that differ in any n-gram are all learnt from. Score: the weights go
with the task and are summed over each text's distinct n-grams, whole texts in Arrow batches, one
pass, no shuffle. An n-gram is a run of lower-cased characters (code points), not of bytes.

Defined results: null and empty texts, and those shorter than an n-gram, get the score of the bias alone; rows of labels
or texts that are null teach nothing; without both labels every score is nearly 0 or 1, without any 0.5; of
labels repeated for a document the largest counts; ties in the hash that bounds the sample go by text and label; repeated rows are scored
each; a null doc_id is not held out; empty tables give empty tables; an input column named as the score is replaced.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import CHUNK_BYTES, Workspace, chunks, map_arrow

SIZES = (5, 6, 7)  # characters of an n-gram
PARTS = 8  # tasks that prepare the sample
BITS = 22  # n-grams are hashed to this many bits


@dataclass
class Model:
    slots: np.ndarray  # hashed n-grams in use, ascending
    weights: np.ndarray  # of each
    bias: float


#: Lower case of code points under 0x600 whose lower case is one code point.
SMALL = np.array([ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in map(chr, range(0x600))], np.uint32)


def characters(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of UTF-8 texts one after another, and where each text's begin and end."""
    points = np.frombuffer(flat.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    bounds = np.append(0, np.cumsum((flat & 0xC0) != 0x80))[offsets]
    if len(points) != bounds[-1]:  # bytes that are no UTF-8 stand for more or fewer replacement characters
        each = [flat[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        points = np.frombuffer("".join(each).encode("utf-32-le"), np.uint32)
        bounds = np.append(0, np.cumsum([len(t) for t in each]))
    return np.where(points < len(SMALL), SMALL[np.minimum(points, len(SMALL) - 1)], points), bounds


def gram_slots(points: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """Slot of the ``size`` characters from each place, or -1 where they would leave the text."""
    n = len(points) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.full(n, np.uint32(size))
    for i in range(size):
        h = h * np.uint32(0x01000193) + points[i : i + n]
        h ^= h >> np.uint32(15)
    slot = ((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)
    for end in bounds[1:-1]:
        slot[max(0, end - size + 1) : end] = -1
    return slot


def presence(column: pa.Array, keep: np.ndarray | None = None, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, row within, feature): distinct n-grams of each text. keep: table from slot to feature, -1 for none."""
    for a, b, flat, offsets in chunks(column, limit):
        points, bounds = characters(flat, offsets)
        rows, features = [], []
        for size in SIZES:
            slot = gram_slots(points, bounds, size)
            feature = slot if keep is None else np.where(slot >= 0, keep[slot], -1)
            at = np.flatnonzero(feature >= 0)
            rows.append(np.searchsorted(bounds, at, side="right") - 1)
            features.append(feature[at].astype(np.int64))
        pair = np.unique((np.concatenate(rows) << BITS) | np.concatenate(features))
        yield a, b, pair >> BITS, pair & ((1 << BITS) - 1)


def fit(labelled: DataFrame, text: str = "text", label: str = "label", max_train: int = 6000, key: str = "key", min_df: int = 8, ridge: float = 10.0, features: int = 3000, toxic_weight: float = 4.0) -> Model:
    """Learn from at most ``max_train`` rows with label 0 or 1, those of smallest hash of ``key``.

    Rows with a null label or text are left out. Without both labels the model is the share of ones.
    Texts with the same n-grams are one row: of the 2,636 labelled rows of sf0.1 outside the held-out part, 2,560.
    ``toxic_weight``: what a row of label 1 weighs, as most rows have label 0. It, ``ridge`` and SIZES were chosen by
    cross-validation on training rows.
    ``features``: the n-grams with the largest |r| * sqrt(texts) are kept, which bounds the model.
    """
    bound = labelled.where(F.col(label).isin(0, 1) & F.col(text).isNotNull()).select(F.xxhash64(key).alias("h"))
    cut = bound.orderBy("h").limit(max_train).agg(F.max("h")).first()[0]
    if cut is None:
        return Model(np.zeros(0, np.int64), np.zeros(0), 0.0)
    rows = labelled.where(F.col(label).isin(0, 1) & F.col(text).isNotNull() & (F.xxhash64(key) <= cut)).select(text, label, F.xxhash64(key).alias("h")).orderBy("h", text, label).limit(max_train)
    ws = Workspace(labelled.sparkSession, "toxicity-fit")
    seen = ws.save(learnt_from(rows.repartition(PARTS, "h").select(text, label)).repartition(PARTS, "text"), "learnt-from")
    df = np.zeros((2, 1 << BITS), np.float32)
    total = np.zeros(2)
    for part in map_arrow(seen, class_counts, "n0 long, n1 long, counts binary").toLocalIterator():
        total += part[0], part[1]
        df += np.frombuffer(zlib.decompress(part[2]), np.uint16).reshape(2, -1)
    if not total.all():
        return Model(np.zeros(0, np.int64), np.zeros(0), 20.0 if total[1] else -20.0)
    ratio = np.log(((df[1] + 1) / (total[1] + 2)) / ((df[0] + 1) / (total[0] + 2)))
    strength = np.where(df.sum(0) >= min_df, np.abs(ratio) * np.sqrt(df.sum(0)), 0)
    slots = np.sort(np.argsort(-strength, kind="stable")[: min(features, int((strength > 0).sum()))])

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(1 << BITS, -1, np.int32)
        table[slots] = np.arange(len(slots))
        for batch in batches:
            own = [table[x] for x in distinct_grams(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[x >= 0].tobytes() for x in own], pa.binary())], ["label", "features"])

    train = map_arrow(seen, chosen, "label int, features binary").orderBy("label", "features").toArrow()
    y = train.column("label").to_numpy().astype(float)
    cols = [np.frombuffer(x, np.int32) for x in train.column("features").to_pylist()]
    weights, bias = logistic(np.repeat(np.arange(len(y)), [len(c) for c in cols]), np.concatenate(cols), ratio[slots], y, ridge, toxic_weight)
    return Model(slots, weights * ratio[slots], bias)


def learnt_from(rows: DataFrame) -> DataFrame:
    """(label, text) of rows (text, label): one row for each set of n-grams, with the label that most of its texts have.

    Copies repeat a wrong label and would outvote the rest. A set with as many texts of either label gives a row of each.
    Texts travel, not their n-grams, which take twelve times the room; any text of a set stands for it.
    """
    each = map_arrow(rows, gram_keys, "text string, label int, k1 long, k2 long")
    ones = 2 * F.sum("label") - F.count("*")
    labels = F.when(ones > 0, F.array(F.lit(1))).when(ones < 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    return each.groupBy("k1", "k2").agg(labels.alias("labels"), F.min("text").alias("text")).select(F.explode("labels").alias("label"), "text")


def distinct_grams(column: pa.Array) -> Iterator[np.ndarray]:
    """Distinct n-grams of each text in ascending order."""
    for a, b, row, slot in presence(column):
        cut = np.searchsorted(row, np.arange(b - a + 1))
        for i in range(b - a):
            yield slot[cut[i] : cut[i + 1]].astype(np.int32)


def gram_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text and label with the 128-bit hash of its distinct n-grams."""
    for batch in batches:
        marks = b"".join(hashlib.blake2b(g.tobytes(), digest_size=16).digest() for g in distinct_grams(batch.column(0)))
        keys = np.frombuffer(marks, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), pa.array(keys[:, 0]), pa.array(keys[:, 1])], ["text", "label", "k1", "k2"])


def class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of one task: texts of each class, and how many of them hold each n-gram (at most max_train, so 16 bits do)."""
    n, df = [0, 0], np.zeros((2, 1 << BITS), np.uint16)
    for batch in batches:
        for label, grams in zip(batch.column(0).to_pylist(), distinct_grams(batch.column(1)), strict=True):
            n[label] += 1
            df[label, grams] += 1
    yield pa.RecordBatch.from_arrays([pa.array([n[0]]), pa.array([n[1]]), pa.array([zlib.compress(df.tobytes(), 1)], pa.binary())], ["n0", "n1", "counts"])


def logistic(rows: np.ndarray, cols: np.ndarray, scale: np.ndarray, y: np.ndarray, ridge: float, toxic_weight: float = 1.0, steps: int = 200) -> tuple[np.ndarray, float]:
    """Ridge logistic regression of y on scale[cols] at (rows, cols), rows of label 1 weighted, by limited-memory BFGS."""
    value, n, m = scale[cols], len(y), len(scale)
    weight, sign = np.where(y == 1, toxic_weight, 1.0), np.where(y == 1, 1.0, -1.0)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = sign * (np.bincount(rows, w[cols] * value, n) + w[m])
        pull = -sign * weight / (1 + np.exp(np.clip(z, -500, 500)))
        grad = np.append(np.bincount(cols, pull[rows] * value, m) + ridge * w[:m], pull.sum())
        return float((weight * np.logaddexp(0, -z)).sum() + ridge / 2 * (w[:m] ** 2).sum()), grad

    w = np.zeros(m + 1)
    now, g = loss(w)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(steps):
        d, shares = -g, []
        for s, t, r in reversed(past):
            shares.append(r * (s @ d))
            d = d - shares[-1] * t
        d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.abs(g).max()))
        for (s, t, r), share in zip(past, reversed(shares), strict=True):
            d = d + (share - r * (t @ d)) * s
        step, slope = 1.0, float(g @ d)
        while step > 1e-9:
            then, after = loss(w + step * d)
            if then <= now + 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, t = step * d, after - g
        if s @ t > 1e-12:
            past = [*past[-9:], (s, t, 1 / (s @ t))]
        done = now - then < 1e-7 * abs(now)
        w, now, g = w + s, then, after
        if done:
            break
    return w[:m], float(w[m])


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out``: probability of label 1, 0 to 1; a null or empty text gets the bias alone.

    An input column named as ``out`` is replaced; other columns, nulls and repeated rows stay.
    """
    keep = [c for c in docs.columns if c != out]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != out) + f", `{out}` double"
    slots, weights, bias = model.slots, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.full(1 << BITS, -1, np.int16 if len(slots) < 32768 else np.int32)
        table[slots] = np.arange(len(slots))
        for batch in batches:
            z = np.full(batch.num_rows, bias)
            for a, b, row, feature in presence(batch.column(keep.index(text)), table):
                z[a:b] += np.bincount(row, weights[feature], b - a)
            p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], [*keep, out])

    return map_arrow(docs.select(*keep), run, schema)


def train_split(labels: DataFrame, docs: DataFrame, label: str, held_out: Column) -> DataFrame:
    """(key, text, label): labelled documents outside ``held_out``; of labels repeated for a document the largest counts."""
    lab = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    return docs.where(~held_out).select("doc_id", "text").join(lab, "doc_id").select(F.col("doc_id").alias("key"), "text", "label")


def is_held_out(doc_id: Column, mod: int, remainder: int) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == remainder, F.lit(False))


def fit_documents(docs: DataFrame, labels: DataFrame, max_train: int = 6000) -> Model:
    return fit(train_split(labels, docs, "toxic", is_held_out(F.col("doc_id"), 3, 1)), max_train=max_train)


def classify(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted (1 from ``threshold`` on). A null doc_id is not held out."""
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", is_held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
