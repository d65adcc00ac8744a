"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation (three rounds of random signs and a fast Hadamard transform) takes a unit vector to
where its largest coordinate, with its sign, names its bucket: the nearest signed axis. Each of TABLES
tables has its own signs. A query probes in each table the PROBES axes nearest to it; what lies there
is a candidate and is ranked by the exact inner product, in double precision, of the original vectors.

Largest inner product is a matter of angle once norms are about equal, so the vectors of a slice are
cut into bands of norms: each band's least norm is BAND of its largest at least, and its vectors are
hashed by their angle alone. Bands are searched in order of falling norm; a query leaves once the
largest norm of the next band cannot reach its (k+1)-th best score. A band of at most FEW vectors is
scored whole, as are all vectors of a slice for a query that found fewer than k + 1 of them.

Vectors stay where they are: each task that reads them packs them into slices of at most SLICE, which are saved. The
queries go past them in blocks of at most QUERIES, one broadcast of bounded size at a time (a stated query
set against all rows, in blocks); a task keeps the best k of each query of the block over all its slices and
gives them back at its end. So no vector is shuffled or copied, and a hot bucket is spread over all slices. Equal vectors of a
slice are one candidate with its smallest ids, as many as can be returned. Nothing is capped: every
vector of a probed bucket is scored.

Recall at 20 against brute force, TABLES = 6 and PROBES = 24 of 128 axes: see README; tests/llm measures it.

Defined results: vectors that are null, empty, zero or hold null or non-finite numbers take no part;
vectors compare with those of their own length only; rows that repeat a query's vec_id are its own
row; an id found twice counts with its larger score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import Workspace, map_arrow

TABLES, PROBES = 6, 24
SLICE, BLOCK = 20_000, 2_048  # vectors and queries that are searched together
QUERIES, QUERY_BYTES = 32_768, 32 << 20  # of one broadcast
BAND, FEW = 0.8, 1_024
MARGIN = 1e-9  # block products may differ by so much, relative to the norms, from those that rank


def rotate(x: np.ndarray, table: int) -> np.ndarray:
    """The pseudo-rotation of a table; x is padded with zeros to a power of two."""
    d = 1 << max(1, (x.shape[1] - 1).bit_length())
    x = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    for signs in np.random.default_rng([table, d]).choice([-1.0, 1.0], (3, d)):
        x = x * signs
        h = 1
        while h < d:
            y = x.reshape(len(x), -1, 2, h)
            x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), 2).reshape(len(x), d)
            h *= 2
        x = x / np.sqrt(d)
    return x


def nearest_axis(x: np.ndarray) -> np.ndarray:
    a = np.abs(x).argmax(1)
    return 2 * a + (x[np.arange(len(x)), a] < 0)


def axes_by_nearness(x: np.ndarray, n: int) -> np.ndarray:
    """For each row the n nearest signed axes."""
    both = np.stack((x, -x), 2).reshape(len(x), -1)
    n = min(n, both.shape[1])
    return np.argpartition(-both, n - 1, axis=1)[:, :n]


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v binary, dim) of the vectors that take part; v holds doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, raw, dims = [], [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or v.values.null_count or not len(v.values):
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all() and x.any():
                    ids.append(i)
                    raw.append(x.tobytes())
                    dims.append(len(x))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(raw, pa.binary()), pa.array(dims, pa.int32())], ["vec_id", "v", "dim"])

    return map_arrow(vectors.select(F.col(vec_id).cast("long"), F.col(embedding)), run, "vec_id long, v binary, dim int")


def best(q: np.ndarray, v: np.ndarray, score: np.ndarray, k: int, slack: np.ndarray) -> np.ndarray:
    """Of (query, candidate, score) triples those within ``slack`` of the query's k-th distinct candidate."""
    at = np.lexsort((v, -score, q))
    first = np.append(True, (q[at][1:] != q[at][:-1]) | (v[at][1:] != v[at][:-1]))
    at = at[first]
    starts = np.flatnonzero(np.append(True, q[at][1:] != q[at][:-1])) if len(at) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(at)))
    kth = np.repeat(score[at][starts + np.minimum(k, sizes) - 1], sizes)
    return at[score[at] >= kth - slack[q[at]]]


def bands(norm: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the vectors of each band of norms, largest norms first."""
    at = np.argsort(-norm, kind="stable")
    falling = -norm[at]
    begin = 0
    while begin < len(at):
        end = max(begin + 1, int(np.searchsorted(falling, BAND * falling[begin], side="right")))
        yield at[begin:end]
        begin = end


def search_block(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int, tables: int, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vec_id, score) of at least the k best candidates of each query in one slice."""
    by = np.argsort(v_ids, kind="stable")
    v_ids, v = v_ids[by], v[by]
    _, first, member_of = np.unique((v + 0.0).view([("", v.dtype)] * v.shape[1]).ravel(), return_index=True, return_inverse=True)
    one = v[first]
    order = np.argsort(member_of, kind="stable")
    place = np.arange(len(order)) - np.searchsorted(member_of[order], member_of[order])
    kept = order[place <= k]  # of equal vectors the k + 1 smallest ids: one may be the query
    begin = np.searchsorted(member_of[kept], np.arange(len(first) + 1))
    v_size, q_size = np.abs(one).max(1), np.abs(q).max(1)
    unit_v, unit_q = one / v_size[:, None], q / q_size[:, None]
    v_norm, q_norm = np.linalg.norm(unit_v, axis=1), np.linalg.norm(unit_q, axis=1)
    unit_v, unit_q = unit_v / v_norm[:, None], unit_q / q_norm[:, None]
    v_norm, q_norm = v_norm * v_size, q_norm * q_size
    slack = q_norm * v_norm.max() * MARGIN
    # a query's own class may hold only itself, so k + 1 classes are kept until ids are compared
    fq, fv, fs = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def scored(qs: np.ndarray, vs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of all pairs of these queries and vectors, each query's k + 1 best; at most 4 * FEW vectors at once."""
        out = []
        for vs in np.split(vs, range(4 * FEW, len(vs), 4 * FEW)):
            if len(vs) and len(qs):
                s = q[qs] @ one[vs].T
                n = min(k + 1, len(vs))
                low = np.partition(s, len(vs) - n, axis=1)[:, len(vs) - n] - slack[qs]
                i, j = np.nonzero(s >= low[:, None])
                out.append((qs[i], vs[j], s[i, j]))
        return out

    def with_parts(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        iq, iv, s = (np.concatenate(x) for x in zip((fq, fv, fs), *parts, strict=True))
        at = best(iq, iv, s, k + 1, slack)
        return iq[at], iv[at], s[at]

    for band in bands(v_norm):
        starts = np.searchsorted(fq, np.arange(len(q) + 1))  # of each query, nearest first
        full = np.diff(starts) > k
        kth = np.full(len(q), -np.inf)
        kth[full] = fs[starts[:-1][full] + k]
        live = np.flatnonzero(q_norm * v_norm[band].max() >= kth - slack)
        if len(band) <= FEW:
            fq, fv, fs = with_parts(scored(live, band))
            continue
        for table in range(tables if len(live) else 0):
            bucket = nearest_axis(rotate(unit_v[band], table))
            probed = axes_by_nearness(rotate(unit_q[live], table), probes)
            rows = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[rows], np.arange(bucket.max() + 2))
            asked = np.argsort(probed.ravel(), kind="stable")
            ask_cut = np.searchsorted(probed.ravel()[asked], np.arange(bucket.max() + 2))
            parts = []
            for b in range(int(bucket.max()) + 1):
                parts += scored(live[asked[ask_cut[b] : ask_cut[b + 1]] // probed.shape[1]], band[rows[cut[b] : cut[b + 1]]])
            fq, fv, fs = with_parts(parts)
    lacking = np.flatnonzero(np.bincount(fq, minlength=len(q)) < min(k + 1, len(one)))
    if len(lacking):
        fq, fv, fs = with_parts(scored(lacking, np.arange(len(one))))
    exact = (q[fq] * one[fv]).sum(1)
    n = (begin[1:] - begin[:-1])[fv]
    end = np.cumsum(n)
    member = kept[np.repeat(begin[:-1][fv] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
    fq, ids, exact = np.repeat(fq, n), v_ids[member], np.repeat(exact, n)
    other = ids != q_ids[fq]
    fq, ids, exact = fq[other], ids[other], exact[other]
    at = np.lexsort((ids, -exact, fq))
    fq, ids, exact = fq[at], ids[at], exact[at]
    rank = np.arange(len(fq)) - np.searchsorted(fq, fq)
    return q_ids[fq[rank < k]], ids[rank < k], exact[rank < k]


def sliced(vectors: DataFrame) -> DataFrame:
    """(dim, ids, v): the vectors of ``usable``, packed by task into slices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list[int], list[bytes]]] = {}

        def packed(dim: int) -> pa.RecordBatch:
            ids, raw = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([b"".join(raw)], pa.binary())], ["dim", "ids", "v"])

        for batch in batches:
            for i, v, dim in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                ids, raw = held.setdefault(dim, ([], []))
                ids.append(i)
                raw.append(v)
                if len(ids) == SLICE:
                    yield packed(dim)
        for dim in list(held):
            yield packed(dim)

    return map_arrow(vectors, run, "dim int, ids binary, v binary")


def blocks_of(queries: DataFrame) -> Iterator[dict[int, tuple[np.ndarray, np.ndarray]]]:
    """The queries, by length of their vectors, in blocks that the driver holds one at a time."""
    held: dict[int, tuple[list[int], list[bytes]]] = {}
    n, size = 0, 0

    def block() -> dict[int, tuple[np.ndarray, np.ndarray]]:
        return {dim: (np.array(ids, np.int64), np.frombuffer(b"".join(raw), np.float64).reshape(-1, dim)) for dim, (ids, raw) in held.items()}

    for i, v, dim in queries.toLocalIterator():
        ids, raw = held.setdefault(dim, ([], []))
        ids.append(i)
        raw.append(bytes(v))
        n, size = n + 1, size + len(v)
        if n >= QUERIES or size >= QUERY_BYTES:
            yield block()
            held, n, size = {}, 0, 0
    if n:
        yield block()


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each query, nearest first, ties to the smaller vec_id."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "ann")
    slices = ws.save(sliced(usable(vectors, vec_id, embedding)), "slices", compression="none")
    schema = "query_id long, vec_id long, score double"
    found = spark.createDataFrame([], schema)
    for step, block in enumerate(blocks_of(usable(queries, vec_id, embedding))):
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared: object = shared) -> Iterator[pa.RecordBatch]:
            best_of: dict[tuple[int, int], tuple[np.ndarray, ...]] = {}
            for batch in batches:
                for dim, ids, raw in zip(*(batch.column(j).to_pylist() for j in range(3)), strict=True):
                    q_ids, q = shared.value.get(dim, (np.zeros(0, np.int64), np.zeros((0, dim))))
                    v = np.frombuffer(raw, np.float64).reshape(-1, dim)
                    for a in range(0, len(q_ids), BLOCK):
                        new = search_block(q_ids[a : a + BLOCK], q[a : a + BLOCK], np.frombuffer(ids, np.int64), v, k, tables, probes)
                        best_of[dim, a] = merged(best_of.get((dim, a)), new, k)
            for q_id, v_id, score in best_of.values():
                yield pa.RecordBatch.from_arrays([pa.array(q_id), pa.array(v_id), pa.array(score)], ["query_id", "vec_id", "score"])

        found = found.unionByName(ws.save(map_arrow(slices, run, schema), f"found-{step}"))
        shared.destroy()
    ws.drop("slices")
    one = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return one.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def merged(old: tuple[np.ndarray, ...] | None, new: tuple[np.ndarray, ...], k: int) -> tuple[np.ndarray, ...]:
    """(query, vec_id, score) of the k best different ids of each query out of both; an id found twice counts with its larger score."""
    if old is None:
        return new
    q, v, s = (np.concatenate(x) for x in zip(old, new, strict=True))
    at = np.lexsort((-s, v, q))
    at = at[np.append(True, (q[at][1:] != q[at][:-1]) | (v[at][1:] != v[at][:-1]))] if len(at) else at
    at = at[np.lexsort((v[at], -s[at], q[at]))]
    rank = np.arange(len(at)) - np.searchsorted(q[at], q[at])
    return q[at][rank < k], v[at][rank < k], s[at][rank < k]


def search_embeddings(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, embeddings.where("vec_id % 20 = 0"))
