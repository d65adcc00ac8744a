"""Approximate nearest vectors by walking graphs of near vectors, one graph a shard.

Vectors are dealt to shards by the nearest of a few centres, so that a shard holds near vectors and at most about ROWS of them. Each shard's graph is built inside one
task and is one row of a table: every vector is linked with the nearest ones that no nearer link already stands for, both ways, and a sample of
about sqrt(n) vectors, the upper layer, is where walks begin. A query goes to the shards whose centres are nearest, starts at the best of the
upper layer, and goes on from the best vector it has not left yet, until the WIDTH best it knows are all left behind. All queries of a block walk together.

For vectors of one norm. Null vectors take no part; vectors of different lengths are an error; ties go to the smaller vec_id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.operators import dense

ROWS, VALUES = 16_384, 4_000_000  # vectors of a shard, and numbers in them, about
NEAR, LINKS = 48, 12  # vectors that links are chosen from, and links of a vector at most
WIDTH = 40  # vectors that a walk keeps
TOGETHER = 128  # queries that walk together
SHARE = 0.5  # of the shards that a query goes to
SCHEMA = "cell int, n int, ids binary, vectors binary, links binary, starts binary"


def nearest(v: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m nearest other vectors of each, nearest first, and the products."""
    m = min(m, len(v) - 1)
    out, sims = np.zeros((len(v), m), np.int32), np.zeros((len(v), m), np.float32)
    step = max(1, dense.SCORES // max(1, len(v)))
    for a in range(0, len(v) if m else 0, step):
        s = v[a : a + step] @ v.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        by = np.argsort(-np.take_along_axis(s, top, 1), axis=1, kind="stable")
        out[a : a + step] = np.take_along_axis(top, by, 1)
        sims[a : a + step] = np.take_along_axis(s, out[a : a + step], 1)
    return out, sims


def spread(v: np.ndarray, near: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """Which of the near vectors are linked: those that are nearer to the vector than to any link before them."""
    keep = np.zeros(near.shape, bool)
    step = max(1, dense.SCORES // max(1, near.shape[1] * max(v.shape[1], near.shape[1])))
    for a in range(0, len(near), step):
        some = v[near[a : a + step]]
        among = some @ some.transpose(0, 2, 1)
        kept = keep[a : a + step]
        for j in range(near.shape[1]):
            kept[:, j] = ~(kept & (among[:, j] > sims[a : a + step, j : j + 1])).any(1) & (kept.sum(1) < LINKS)
    return keep


def linked(v: np.ndarray) -> np.ndarray:
    """(n, up to 2 LINKS) links of each vector, its own number where it has fewer."""
    n = len(v)
    near, sims = nearest(v, NEAR)
    keep = spread(v, near, sims)
    a, b, s = np.repeat(np.arange(n), keep.sum(1)), near[keep].astype(np.int64), sims[keep]
    a, b, s = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((s, s))
    _, once = np.unique(a * n + b, return_index=True)
    a, b, s = a[once], b[once], s[once]
    by = np.lexsort((b, -s, a))
    a, b = a[by], b[by]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    some = place < 2 * LINKS
    out = np.repeat(np.arange(n, dtype=np.int32)[:, None], int(place[some].max()) + 1 if some.any() else 1, axis=1)
    out[a[some], place[some]] = b[some]
    return out


def starting(links: np.ndarray, seed: int = 7) -> np.ndarray:
    """A sample of vectors from which all can be reached; one more for each part that the sample misses."""
    n = len(links)
    starts = np.sort(np.random.default_rng(seed).choice(n, min(n, math.isqrt(n) + 1), replace=False))
    seen = np.zeros(n, bool)
    fresh = starts
    while True:
        seen[fresh] = True
        while len(fresh):
            fresh = np.unique(links[fresh])
            fresh = fresh[~seen[fresh]]
            seen[fresh] = True
        left = np.flatnonzero(~seen)
        if not len(left):
            return starts.astype(np.int32)
        fresh = left[:1]
        starts = np.append(starts, fresh)


def walk(v: np.ndarray, links: np.ndarray, starts: np.ndarray, q: np.ndarray, width: int) -> tuple[np.ndarray, int]:
    """(queries, width) numbers of the best vectors that each walk met, -1 where it met fewer, and how many products were made."""
    rows = np.arange(len(q))
    s = q @ v[starts].T
    scored = s.size
    seen = np.zeros((len(q), len(v)), bool)
    seen[:, starts] = True
    held = min(width, len(starts))
    top = np.argpartition(-s, held - 1, axis=1)[:, :held]
    best, known = np.full((len(q), width), -1, np.int64), np.full((len(q), width), -np.inf, np.float32)
    best[:, :held], known[:, :held] = starts[top], np.take_along_axis(s, top, 1)
    left = best < 0  # behind: its links have been followed
    while True:
        todo = np.where(left, -np.inf, known)
        at = todo.argmax(1)
        live = np.flatnonzero(todo[rows, at] > -np.inf)
        if not len(live):
            return best, scored
        at = at[live]
        left[live, at] = True
        to = links[best[live, at]]
        new = ~seen[live[:, None], to]
        r, c = np.nonzero(new)
        scored += len(r)
        seen[live[r], to[r, c]] = True
        s = np.full(to.shape, -np.inf, np.float32)
        s[r, c] = np.einsum("ij,ij->i", v[to[r, c]], q[live[r]])
        all_s, all_v = np.concatenate((known[live], s), 1), np.concatenate((best[live], np.where(new, to, -1)), 1)
        all_l = np.concatenate((left[live], ~new), 1)
        top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
        known[live], best[live], left[live] = (np.take_along_axis(x, top, 1) for x in (all_s, all_v, all_l))


def unit(v: np.ndarray) -> np.ndarray:
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).astype(np.float32)


def pack(table: pa.Table) -> pa.Table:
    """The row of one shard (cell, vec_id, embedding)."""
    table = table.sort_by("vec_id").combine_chunks()
    width = len(table.column("embedding")[0])
    ids, v = dense.matrix(table.select(["vec_id", "embedding"]).to_batches()[0], width)
    v = v.astype(np.float32)
    links = linked(unit(v))
    row = {"cell": table.column("cell")[0].as_py(), "n": len(v), "ids": ids.astype(np.int64).tobytes(), "vectors": v.tobytes(), "links": links.tobytes(), "starts": starting(links).tobytes()}
    return pa.table({k: pa.array([x], pa.int32() if isinstance(x, int) else pa.binary()) for k, x in row.items()})


def build(vectors: DataFrame, rows: int | None = None) -> tuple[DataFrame, np.ndarray]:
    """(shards, centres): one row a shard (``SCHEMA``) of vectors (vec_id, embedding), and the centre of each cell that shards lie in.

    There are as many cells as shards are needed, up to ``dense.MOST_CELLS``; a cell of more vectors than a shard takes is split by hash. What comes to the
    driver are the centres and a count for each cell.
    """
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding")).where("embedding IS NOT NULL")
    n, width = given.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).first()
    rows = rows or max(1, min(ROWS, VALUES // max(1, width)))
    centres = dense.fit_cells(given, n, count=-(-n // rows) or 1)
    if not n:
        return vectors.sparkSession.createDataFrame([], SCHEMA), centres
    dealt = dense.with_cells(given, centres)
    sizes = {r["cell"]: r["n"] for r in dealt.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    parts = F.element_at(F.array(*[F.lit(-(-sizes.get(c, 0) // rows) or 1) for c in range(len(centres))]), F.col("cell") + 1)
    return dealt.groupBy("cell", F.pmod(F.xxhash64("vec_id"), parts).alias("part")).applyInArrow(pack, SCHEMA), centres


def search(queries: DataFrame, shards: DataFrame, centres: np.ndarray, k: int, width: int | None = None, share: float = SHARE, digits: int = 9, counts: bool = False) -> DataFrame:
    """(query_id, rank, vec_id, score) of queries (query_id, embedding), products in double precision; with ``counts`` instead (queries, scored): how many walked together and how many products they made.

    ``width`` is WIDTH at least, and never under k. Shards are read where they lie and queries, the stated side, go to them in blocks.
    """
    kind, told = queries.schema["query_id"].dataType.simpleString(), to_arrow_type(queries.schema["query_id"].dataType)
    none = queries.select("query_id", F.lit(0).cast("long").alias("vec_id"), F.lit(0.0).alias("score")).where("false")
    width = max(width or WIDTH, k)

    def found(ids: list, q: np.ndarray) -> DataFrame:
        near = dense.probed(q, centres, share)
        shared = shards.sparkSession.sparkContext.broadcast((ids, q, near))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, near = shared.value
            for batch in batches:
                for cell, n, own, vectors, links, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    own, v = np.frombuffer(own, np.int64), np.frombuffer(vectors, np.float32).reshape(n, -1)
                    if v.shape[1] != q.shape[1]:
                        raise ValueError(f"vectors must all have {v.shape[1]} numbers")
                    links, starts = np.frombuffer(links, np.int32).reshape(n, -1), np.frombuffer(starts, np.int32)
                    asked = np.flatnonzero(near[:, cell])
                    for a in range(0, len(asked), TOGETHER):
                        part = asked[a : a + TOGETHER]
                        best, scored = walk(v, links, starts, q[part].astype(np.float32), width)
                        if counts:
                            yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.array([scored], pa.int64())], ["queries", "scored"])
                            continue
                        r, c = np.nonzero(best >= 0)
                        at = best[r, c]
                        s = np.round(np.einsum("ij,ij->i", q[part[r]], v[at].astype(np.float64)), digits) + 0.0
                        by = np.lexsort((own[at], -s, r))
                        r, at, s = r[by], at[by], s[by]
                        top = np.arange(len(r)) - np.searchsorted(r, r) < k
                        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in part[r[top]]], told), pa.array(own[at[top]]), pa.array(s[top])], ["query_id", "vec_id", "score"])

        cells = np.flatnonzero(near.any(0)).tolist()
        rows = shards if len(cells) == len(centres) else shards.where(F.col("cell").isin(cells))  # reaches the scan of a stored table
        return rows.select("cell", "n", "ids", "vectors", "links", "starts").mapInArrow(run, "queries long, scored long" if counts else f"query_id {kind}, vec_id long, score double")

    if k <= 0 or not len(centres):
        return dense.ranked(none, 1)
    out = none.select(F.lit(0).cast("long").alias("queries"), F.lit(0).cast("long").alias("scored")) if counts else none
    for block in dense.blocks(queries):
        out = out.unionByName(found(*block))
    return out if counts else dense.ranked(out, k)


def near(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``search`` over graphs that are built for this call."""
    return search(queries, *build(vectors), k)
