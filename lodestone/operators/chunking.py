"""Sentence-aware chunks with carried overlap."""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X

STEP_PIECES = 4_000  # pieces that a worker takes out of Arrow at once


def check_sizes(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if overlap < 0:
        raise ValueError("overlap must not be negative")
    if overlap >= size:
        raise ValueError("overlap must be smaller than the chunk size")


def pack(pieces: list[str], size: int, overlap: int) -> list[str]:
    """Runs of pieces joined by spaces: each ends before it would pass ``size`` and begins with as many of the
    last run's pieces as fit ``overlap``. What is carried is not held against the first new piece, so a
    run has up to overlap + 1 + size characters.
    """
    at = [0, *itertools.accumulate(len(p) + 1 for p in pieces)]  # the run a:b has at[b] - at[a] - 1 characters
    out, begin, new = [], 0, 0
    while new < len(pieces):
        end = max(new + 1, bisect.bisect_right(at, at[begin] + size + 1) - 1)
        out.append(" ".join(pieces[begin:end]))
        begin, new = max(begin, bisect.bisect_left(at, at[end] - overlap - 1)), end
    return out


def steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose last column's lists hold STEP_PIECES together, or a single row."""
    upto = np.cumsum(batch.column(batch.num_columns - 1).value_lengths().to_numpy(zero_copy_only=False))
    begin = 0
    while begin < batch.num_rows:
        held = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, held + STEP_PIECES, side="right")))
        yield batch.slice(begin, end - begin)
        begin = end


def chunks(docs: DataFrame, size: int = 1000, overlap: int = 150, doc: str = "doc_name", text: str = "text", keep: tuple[str, ...] = (), before: int = 0) -> DataFrame:
    """(doc, chunk_no, chunk_id, text, *keep); chunk_no from 0. Null and blank texts have no chunks. Columns in ``keep`` go with each chunk.

    ``before``: a last column of this name holds so many last characters of the chunk before in the row's text, null for the first.
    Splitting is done by column functions; packing is an ordered fold over each row's pieces, in Arrow batches without a shuffle.
    A worker holds about STEP_PIECES pieces of a batch and their chunks at once, or one row.
    """
    check_sizes(size, overlap)
    pieces = X.hard_split(X.split_sentences(F.col(text)), size, overlap)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (doc, *keep)) + ", chunk_no int, text string" + ", before string" * bool(before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in steps(batch):
                packed = [pack(p, size, overlap) for p in rows.column(rows.num_columns - 1).to_pylist()]
                at = pa.array([i for i, c in enumerate(packed) for _ in c], pa.int32())
                out = [rows.column(i).take(at) for i in range(rows.num_columns - 1)]
                out += [pa.array([i for c in packed for i in range(len(c))], pa.int32()), pa.array([x for c in packed for x in c], pa.string())]
                if before:
                    out.append(pa.array([x if x is None else x[-before:] for c in packed for x in [None, *c[:-1]]], pa.string()))
                yield pa.RecordBatch.from_arrays(out, [doc, *keep, "chunk_no", "text", "before"][: len(out)])

    rows = docs.select(doc, *keep, pieces.alias("pieces")).where(F.size("pieces") > 0).mapInArrow(run, kinds)
    last = ["before"] * bool(before)
    return rows.select(doc, "chunk_no", F.concat(F.col(doc).cast("string"), F.lit("#chunk-"), F.col("chunk_no").cast("string")).alias("chunk_id"), "text", *keep, *last)
