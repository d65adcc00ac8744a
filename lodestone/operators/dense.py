"""Nearest vectors by inner product: exact as an expression, exact in NumPy blocks, or by cells of near vectors. ``graph`` walks graphs.

A searcher is any function (queries, vectors, k) -> (query_id, rank, vec_id, score) for queries (query_id, embedding)
against vectors (vec_id, embedding); ``search`` takes one by name or as it is. Null vectors take no part; vectors
of different lengths are an error. Ties go to the smaller vec_id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions import text as X

Searcher = Callable[[DataFrame, DataFrame, int], DataFrame]

BLOCK_VALUES = 2_000_000  # numbers of query vectors that one broadcast holds at most
BLOCK_QUERIES = 4_096  # and queries
SCORES = 4_000_000  # scores that a task holds at once
APPROXIMATE_FROM = 50_000
SAMPLE = 20_000  # vectors that cells are fitted on
MOST_CELLS = 1_024
SHARE = 0.5  # of the cells that a query looks into


def choose(n: int, backend: str = "auto", approximate_from: int = APPROXIMATE_FROM) -> str:
    names = ("auto", "graph", *SEARCHERS)
    if backend not in names:
        raise ValueError(f"backend must be one of {', '.join(names)}")
    return backend if backend != "auto" else "graph" if n >= approximate_from else "exact"


def search(queries: DataFrame, vectors: DataFrame, k: int, backend: str | Searcher = "auto") -> DataFrame:
    if callable(backend):
        return backend(queries, vectors, k)
    name = choose(vectors.count() if backend == "auto" else 0, backend)
    if name == "graph":
        from lodestone.operators import graph  # which is built on this module

        return graph.near(queries, vectors, k)
    return SEARCHERS[name](queries, vectors, k)


def ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Best:
    """The k best (vector, score) of each of n queries among all that was added."""

    def __init__(self, n: int, k: int):
        self.k, self.least = k, np.full(n, -np.inf)
        self.kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, rows: np.ndarray, ids: np.ndarray, s: np.ndarray) -> None:
        """Scores ``s`` of the queries numbered ``rows`` against the vectors ``ids``."""
        low = self.least[rows]
        if s.shape[1] > self.k:
            low = np.maximum(low, -np.partition(-s, self.k - 1, axis=1)[:, self.k - 1])
        r, c = np.nonzero(s >= low[:, None])
        self.kept.append((rows[r], ids[c], s[r, c]))
        self.held += len(r)
        if self.held > SCORES:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, ids, s = (np.concatenate(x) for x in zip(*self.kept, strict=True))
        by = np.lexsort((ids, -s, q))
        q, ids, s = q[by], ids[by], s[by]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        last = rank == self.k - 1
        self.least[q[last]] = s[last]
        keep = rank < self.k
        self.kept, self.held = [(q[keep], ids[keep], s[keep])], int(keep.sum())
        return self.kept[0]


def matrix(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and vectors of a batch (vec_id, embedding, ...) without nulls."""
    sizes = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != width).any():
        raise ValueError(f"vectors must all have {width} numbers")
    return batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(sizes), width)


def packed(vectors: DataFrame) -> DataFrame:
    """(ids, vectors): vectors (vec_id, embedding) of a batch as two runs of bytes; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids, v = matrix(batch, len(batch.column(1)[0]))
                yield pa.RecordBatch.from_arrays([pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([v.astype(np.float32).tobytes()], pa.binary())], ["ids", "vectors"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("embedding IS NOT NULL").mapInArrow(run, "ids binary, vectors binary")


def nearest_packed(q: np.ndarray, packs: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(vec_id, score) of the k vectors nearest to one query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, v = np.frombuffer(ids, np.int64), np.frombuffer(v, np.float32)
                if len(v) != len(ids) * len(q):
                    raise ValueError(f"vectors must all have {len(q)} numbers")
                s = np.round(v.reshape(len(ids), -1).astype(np.float64) @ q, digits) + 0.0
                top = np.lexsort((ids, -s))[:k]
                yield pa.RecordBatch.from_arrays([pa.array(ids[top]), pa.array(s[top])], ["vec_id", "score"])

    return packs.mapInArrow(run, "vec_id long, score double").orderBy(F.desc("score"), "vec_id").limit(k)


def blocks(queries: DataFrame) -> Iterator[tuple[list, np.ndarray]]:
    """Numbers and vectors of the queries, the stated side, a block at a time."""
    ids, rows = [], []
    for row in queries.select("query_id", "embedding").where("embedding IS NOT NULL").toLocalIterator():
        if rows and len(row[1]) != len(rows[0]):
            raise ValueError("query vectors must all have one length")
        ids.append(row[0])
        rows.append(row[1])
        if len(ids) == BLOCK_QUERIES or len(ids) * len(row[1]) >= BLOCK_VALUES:
            yield ids, np.array(rows, np.float64)
            ids, rows = [], []
    if ids:
        yield ids, np.array(rows, np.float64)


def against(queries: DataFrame, vectors: DataFrame, k: int, digits: int, centres: np.ndarray | None = None, share: float = SHARE) -> DataFrame:
    """Each block of queries against ``vectors`` (vec_id, embedding and, with ``centres``, cell); a task returns k rows a query."""
    schema = f"query_id {queries.schema['query_id'].dataType.simpleString()}, vec_id long, score double"
    none = queries.select("query_id", F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    if k <= 0:
        return ranked(none, 1)
    kind = to_arrow_type(queries.schema["query_id"].dataType)
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", *(["cell"] if centres is not None else [])).where("embedding IS NOT NULL")

    def found(ids: list, q: np.ndarray) -> DataFrame:
        near = None if centres is None else probed(q, centres, share)
        shared = vectors.sparkSession.sparkContext.broadcast((ids, q, near))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, near = shared.value
            best, every = Best(len(ids), k), np.arange(len(ids))
            step = max(1, SCORES // len(ids))
            for batch in batches:
                vec, v = matrix(batch, q.shape[1])
                cells = np.zeros(len(vec), np.int64) if near is None else batch.column(2).to_numpy()
                for c in np.unique(cells):
                    rows, at = every if near is None else np.flatnonzero(near[:, c]), np.flatnonzero(cells == c)
                    for a in range(0, len(at) if len(rows) else 0, step):
                        part = at[a : a + step]
                        best.add(rows, vec[part], np.round(q[rows] @ v[part].T, digits) + 0.0)
            if best.kept:
                i, vec, s = best.cut()
                yield pa.RecordBatch.from_arrays([pa.array([ids[x] for x in i], kind), pa.array(vec), pa.array(s)], ["query_id", "vec_id", "score"])

        rows = given
        if near is not None and not near.any(0).all():
            rows = given.where(F.col("cell").isin(np.flatnonzero(near.any(0)).tolist()))  # reaches the scan of a stored index
        return rows.mapInArrow(run, schema)

    out = none
    for block in blocks(queries):
        out = out.unionByName(found(*block))
    return ranked(out, k)


def exact(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """(query_id, rank, vec_id, score); the vectors stay where they are and the queries go to them in blocks."""
    return against(queries, vectors, k, digits)


def exact_columns(queries: DataFrame, vectors: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The same as an expression, for a few queries of a stated number: a nested loop over a broadcast of them."""
    q = F.broadcast(queries.select("query_id", F.col("embedding").alias("q")))
    return ranked(vectors.select("vec_id", "embedding").crossJoin(q).select("query_id", "vec_id", (F.round(X.cosine(F.col("q"), F.col("embedding")), digits) + F.lit(0.0)).alias("score")), k)


def fit_cells(vectors: DataFrame, n: int, seed: int = 7, rounds: int = 8, count: int | None = None) -> np.ndarray:
    """Unit centres of ``count`` cells, 4 sqrt(n) where not given and at most MOST_CELLS, by spherical k-means on the SAMPLE vectors of least hash; none for no vectors."""
    some = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").limit(SAMPLE).select("vec_id", "embedding").toArrow()
    if not some.num_rows:
        return np.zeros((0, 0))
    _, v = matrix(some.combine_chunks().to_batches()[0], len(some.column(1)[0]))
    v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
    cells = max(1, min(MOST_CELLS, count or int(4 * math.sqrt(n)), len(v)))
    centres = v[np.random.default_rng(seed).choice(len(v), cells, replace=False)]
    for _ in range(rounds):
        own = (v @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


def with_cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """(vec_id, embedding, cell): the cell whose centre has the largest inner product; the centres are at most MOST_CELLS."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, v = matrix(batch, shared.value.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((v @ shared.value.T).argmax(1).astype(np.int32))], ["vec_id", "embedding", "cell"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("embedding IS NOT NULL").mapInArrow(run, "vec_id long, embedding array<float>, cell int")


def probed(q: np.ndarray, centres: np.ndarray, share: float) -> np.ndarray:
    """Which cells each query looks into: the nearest ``share`` of them."""
    m = max(1, math.ceil(share * len(centres)))
    near = np.zeros((len(q), len(centres)), bool)
    np.put_along_axis(near, np.argsort(-(q @ centres.T), axis=1, kind="stable")[:, :m], True, axis=1)
    return near


def cells(queries: DataFrame, vectors: DataFrame, k: int, share: float = SHARE, digits: int = 9) -> DataFrame:
    """Approximate: only vectors in the nearest ``share`` of the cells are scored, exactly. For vectors of one norm.

    On unit vectors without clusters half of the cells hold 0.94 of the 10 nearest; on clustered ones a tenth does.
    """
    centres = fit_cells(vectors, vectors.count())
    if not len(centres):
        return exact(queries, vectors, k, digits)
    return probe(queries, with_cells(vectors, centres), centres, k, share, digits)


def probe(queries: DataFrame, indexed: DataFrame, centres: np.ndarray, k: int, share: float = SHARE, digits: int = 9) -> DataFrame:
    """``cells`` with the cells known: indexed (vec_id, embedding, cell), such as a stored table sorted by cell."""
    return against(queries, indexed, k, digits, centres, share)


SEARCHERS: dict[str, Searcher] = {"exact": exact, "cells": cells}


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(query_id, recall): part of the true neighbours that were found."""
    hit = truth.select("query_id", "vec_id").join(found.select("query_id", "vec_id", F.lit(1).alias("hit")), ["query_id", "vec_id"], "left")
    return hit.groupBy("query_id").agg((F.count("hit") / F.count("*")).alias("recall"))
