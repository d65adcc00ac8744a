"""Fill-in-the-middle: a text is cut in three and told as prefix, suffix, middle (psm) or suffix, prefix, middle (spm).

Method: one NumPy kernel for all texts of a step, on Arrow's UTF-8 buffers. A table gives each byte its class; a table over the classes
of adjacent bytes marks where a unit begins (a code point, or a word with the white space after it); the running sum of the marks, taken
from each document's start, numbers the units, and one binary search over it finds the cuts of all rows. Pieces and marks are joined by Arrow.

Draws are digests of the document's number, so reruns and any partitioning give the same result.

Defined results: a null text is empty; a text that is empty or holds a mark is plain, as is the stated share of the others; a null
number has the digest of no digits; rows repeated are transformed alike, whatever other columns say. Texts are never cut short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import CHUNK_BYTES, chunks, map_arrow

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SALT = "1:"
WHOLE, SPM = 90, 20  # of a hundred: from which draw on a text stays plain, and below which it is told suffix first
# Classes of bytes: inside a code point, any other, white space, and those that marks are made of.
INSIDE, OTHER, SPACE, OPEN, LETTER, CLOSE = range(6)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[0x80:0xC0] = INSIDE
CLASS[[0x20, *range(0x09, 0x0E)]] = SPACE
CLASS[ord("<")], CLASS[ord(">")], CLASS[[ord(c) for c in "PSM"]] = OPEN, CLOSE, LETTER
#: Whether a unit begins between bytes of two classes.
BEGINS = {"code points": np.ones((6, 6), bool), "words": np.zeros((6, 6), bool)}
BEGINS["words"][SPACE] = True
BEGINS["words"][SPACE, SPACE] = False
for _table in BEGINS.values():
    _table[:, INSIDE] = False
MARKS = pa.array(["", PREFIX, SUFFIX, MIDDLE], pa.large_string())
SCHEMA = "doc_id {}, n long, form string, prefix_chars long, middle_chars long, output string"


def marked(kind: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which documents hold one of the three marks; one that two documents make together does not count."""
    at = np.flatnonzero((kind[:-2] == OPEN) & (kind[1:-1] == LETTER) & (kind[2:] == CLOSE)) if len(kind) > 2 else np.zeros(0, np.int64)
    doc = np.searchsorted(offsets, at, side="right") - 1
    out = np.zeros(len(offsets) - 1, bool)
    out[doc[at + 3 <= offsets[doc + 1]]] = True
    return out


def cuts(flat: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
    """(n, low, high, byte of low, byte of high, marked): units of each document and its two cuts, from the draws."""
    kind = CLASS[flat]
    start = np.zeros(len(flat), bool)
    start[1:] = begins[kind[:-1], kind[1:]]
    start[offsets[:-1][offsets[:-1] < len(flat)]] = True
    number = np.cumsum(start, dtype=np.int64)
    base = np.append(0, number)[offsets]  # units before each document
    n = np.diff(base)
    draws = np.stack((first % (n + 1), second % (n + 1)))
    low, high = draws.min(0), draws.max(0)
    # the unit after a document's last one is the first of the next document that has any: there this one ends
    at = np.searchsorted(number, base[:-1] + np.stack((low, high)) + 1)
    return n, low, high, *np.minimum(at, offsets[1:]), marked(kind, offsets)


def pieces(flat: np.ndarray, offsets: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
    """Prefix, middle and suffix of each document, as views of its bytes."""
    edges = np.append(np.stack((offsets[:-1], low, high), axis=1).ravel(), offsets[-1:]).astype(np.int64)
    three = pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(flat))])
    return [three.take(pa.array(np.arange(j, len(edges) - 1, 3))) for j in range(3)]


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "code points", salt: str = SALT, whole: int = WHOLE, spm: int = SPM, step: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): units of the whole text, how it is told, units of two pieces (null if plain), the text told so."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring("__digest", 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    begins = BEGINS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = [batch.column(j).to_numpy() for j in range(2, 6)]
            for a, b, flat, offsets in chunks(batch.column(1), step):
                n, low, high, x, y, held = cuts(flat, offsets, h[0][a:b], h[1][a:b], begins)
                plain = held | (n == 0) | (h[2][a:b] % 100 >= whole)
                last = ~plain & (h[3][a:b] % 100 < spm)
                x, y = (np.where(plain, offsets[1:], z) for z in (x, y))  # then the prefix is the whole text
                pre, mid, suf = pieces(flat, offsets, x, y)
                mark = [MARKS.take(pa.array(np.where(plain, 0, m))) for m in (np.where(last, 2, 1), np.where(last, 1, 2), np.full(b - a, 3))]
                turn = pa.array(last)
                told = pc.binary_join_element_wise(mark[0], pc.if_else(turn, suf, pre), mark[1], pc.if_else(turn, pre, suf), mark[2], mid, pa.scalar("", pa.large_string()))
                form = np.where(plain, "plain", np.where(last, "spm", "psm"))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain), told.cast(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    given = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), digest.alias("__digest")).select("doc_id", "text", *draws)
    return map_arrow(given, run, SCHEMA.format(docs.schema[doc_id].dataType.simpleString()))


def restored(output: Column, form: Column) -> Column:
    """The text again. Only plain texts hold marks of their own, so the marks cut the others as they were put together."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    order = F.when(form == "psm", F.array(part[1], part[3], part[2])).otherwise(F.array(part[2], part[3], part[1]))
    return F.when(form == "plain", output).otherwise(F.array_join(order, ""))


def digests(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256."""
    told = transform(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return told.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
