"""Token-ID output: each document's ids compressed alone against a shared zstandard dictionary.

Format, version 1. A dataset is a folder of three Parquet tables: ``dictionary`` (one row: hash, bytes),
``shards`` (shard, image) and ``index`` (shard, docs, tokens, start). An image is one binary string,
all numbers little-endian:

    "LTID" | version u32 | dictionary hash u64 | documents n u32 | id width u32
    doc_id i64 * n | has_id u8 * n | n_tokens u64 * n | offset u64 * (n + 1) | frames

Frame i lies at offset[i]:offset[i+1] after the header and holds the ids of document i as u16 or u32,
so a document is read without its neighbours. Documents ascend by doc_id through the shards (null
first; then by text hash); ``start`` counts the ids before a shard. A shard ends at SHARD_BYTES of frames.

The dictionary is trained on serialized ids of at most ``sample`` documents, those of smallest hash, and of
a document of more than WINDOW ids on WINDOW of them from a hashed place on (a bound on what the driver trains
on, as the dictionary is shared; every document is compressed whole). Where that is too little to train
on, it is empty and frames stand alone. Texts are encoded whole:
the tokenizer never looks across white space, so each distinct word of a batch is encoded once.

Defined results: null and empty texts hold the end id alone; repeated doc_ids stay separate
documents; an empty table gives empty tables.
"""

from __future__ import annotations

import itertools
import json
import os
import sys
import types
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import CHUNK_BYTES, LOWER, SPACES, Workspace, chunks, letters, map_arrow, parallelism, steps, word_hashes, word_spans

END_ID = 1
SHARD_BYTES = 4 << 20
SAMPLE = 2000  # documents that the dictionary is trained on, at most
WINDOW = 4096  # and of each of them so many ids
DICT_BYTES = 64 << 10
MAGIC = b"LTID"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: Places after letters or digits where WORD_SPLIT always ends a piece; the apostrophe can begin 's and the like.
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x41:0x5B] = LETTERS[0x61:0x7B] = True
MARKS = np.zeros(256, bool)
MARKS[0x21:0x80] = True
MARKS &= ~LETTERS
MARKS[[0x27, 0x7F]] = False
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # fixed value of the tokenizer's file


def splits_at_punctuation(path: str) -> bool:
    """Whether the tokenizer lower-cases and splits by WORD_SPLIT, so that words may be cut before marks and lower-cased."""
    with open(path, encoding="utf-8") as f:
        own = json.load(f)
    steps = (own.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    lowers = any(x.get("type") == "Lowercase" for x in (own.get("normalizer") or {}).get("normalizers", []))
    return lowers and (steps[0].get("pattern") or {}).get("Regex") == WORD_SPLIT


def punctuation_after_letter(flat: np.ndarray) -> np.ndarray:
    """Where an ASCII mark follows an ASCII letter or digit or one of U+00C0 to U+00FF that is a letter."""
    out = np.zeros(len(flat), bool)
    if len(flat) > 2:
        letter = LETTERS[flat]
        letter[1:] |= (flat[:-1] == 0xC3) & (flat[1:] >= 0x80) & (flat[1:] != 0x97) & (flat[1:] != 0xB7)
        out[1:] = letter[:-1] & MARKS[flat[1:]]
    return out


def encoder_of(path: str) -> WordEncoder:
    """The worker process's encoder: it and its cache serve all tasks that the process runs."""
    kept = sys.modules.setdefault("_lodestone_worker", types.ModuleType("_lodestone_worker"))
    if getattr(kept, "path", None) != path:
        kept.path, kept.encoder = path, WordEncoder(path)
    return kept.encoder


def appended(pool: np.ndarray, used: int, new: np.ndarray) -> tuple[np.ndarray, int]:
    """``pool``, whose first ``used`` places are taken, with ``new`` after them, and how many are taken then."""
    while used + len(new) > len(pool):
        pool = np.append(pool, np.zeros_like(pool))
    pool[used : used + len(new)] = new
    return pool, used + len(new)


class WordEncoder:
    """Encodes whole texts with a tokenizer that splits at white space, a repeated word only once.

    Words go through a direct-mapped cache of SLOTS; a word is taken from it only where its bytes are those that were encoded.
    """

    SLOTS_BITS = 20
    JOINED = 256  # words that one call to the tokenizer takes
    POOL = 4 << 20  # ids that the cache holds; then it begins anew

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.splits = splits_at_punctuation(path)
        plain = [i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special and not (t.normalized or t.lstrip or t.rstrip or t.single_word)]
        self.border = plain[0] if self.splits and plain else None  # a special token: what stands on its two sides is encoded apart
        self.forget()

    def forget(self) -> None:
        self.place = np.zeros(1 << self.SLOTS_BITS, np.int32)
        self.size = np.full(1 << self.SLOTS_BITS, -1, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0
        self.raw, self.raw_used = np.zeros(1 << 18, np.uint8), 0  # the cached words
        self.raw_place = np.zeros(1 << self.SLOTS_BITS, np.int64)
        self.raw_size = np.full(1 << self.SLOTS_BITS, -1, np.int64)

    def full(self) -> bool:
        return self.used > self.POOL or self.raw_used > 4 * self.POOL

    def words(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word where its ids begin in the pool, and how many they are."""
        slot = (word_hashes(flat, starts, ends) >> np.uint64(64 - self.SLOTS_BITS)).astype(np.int64)
        place, size = self.place[slot].astype(np.int64), self.size[slot].astype(np.int64)
        miss = np.flatnonzero(~self.holds(flat, starts, ends, slot))
        if len(miss):
            raw = flat.tobytes()
            given = [raw[a:b] for a, b in zip(starts[miss].tolist(), ends[miss].tolist(), strict=True)]
            number: dict[bytes, int] = {}
            which = np.array([number.setdefault(w, len(number)) for w in given])
            new = list(number)
            got, n = self.encode_words(new)
            begin = self.used + np.cumsum(n) - n
            self.pool, self.used = appended(self.pool, self.used, got)
            place[miss], size[miss] = begin[which], n[which]
            length = np.fromiter(map(len, new), np.int64, len(new))
            raw_begin = self.raw_used + np.cumsum(length) - length
            self.raw, self.raw_used = appended(self.raw, self.raw_used, np.frombuffer(b"".join(new), np.uint8))
            where = np.zeros(len(new), np.int64)
            where[which] = slot[miss]
            # of new words with one slot the last is kept, in all tables alike
            kept = np.unique(where[::-1], return_index=True)
            at, last = kept[0], len(new) - 1 - kept[1]
            self.place[at], self.size[at], self.raw_place[at], self.raw_size[at] = begin[last], n[last], raw_begin[last], length[last]
        return place, size

    def holds(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, slot: np.ndarray) -> np.ndarray:
        """For each word whether its slot has the same bytes."""
        length = ends - starts
        out = self.raw_size[slot] == length
        like = np.flatnonzero(out)
        for part in steps(length[like], 4 * CHUNK_BYTES):
            some = like[part]
            at, inside, begin = letters(starts[some], ends[some])
            same = flat[at] == self.raw[np.repeat(self.raw_place[slot[some]], length[some]) + inside]
            out[some] = np.logical_and.reduceat(same, begin)
        return out

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has. Words go JOINED at a time with a special token between."""
        mark = None if self.border is None else self.tokenizer.id_to_token(self.border).encode()
        if mark and mark not in b"\n".join(words):
            lines = [mark.join(words[i : i + self.JOINED]) + mark for i in range(0, len(words), self.JOINED)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([x.decode("utf-8", "replace") for x in lines], add_special_tokens=False)])
            end = np.flatnonzero(ids == self.border)
            return ids[ids != self.border], np.diff(end, prepend=-1) - 1
        each = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
        n = np.fromiter(map(len, each), np.int64, len(each))
        return np.fromiter(itertools.chain.from_iterable(each), np.uint32, int(n.sum())), n

    def pieces(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text and words cut further where the tokenizer allows it."""
        if self.splits and b"<|" not in flat.tobytes():  # else a special token may stand there
            flat = LOWER[flat]
            cut = punctuation_after_letter(flat)
            cut[starts] = False
            at = np.flatnonzero(cut)
            starts, ends = np.sort(np.append(starts, at)), np.sort(np.append(ends, at))
        return flat, starts, ends

    def sizes(self, flat: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Number of ids of each word."""
        if self.full():
            self.forget()
        own, a, b = self.pieces(flat, starts, ends)
        sums = np.append(0, np.cumsum(self.words(own, a, b)[1]))
        first = np.append(np.searchsorted(a, starts), len(a))
        return np.diff(sums[first])

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """In steps: number of rows, all their ids one after another, and where each row's begin and end."""
        for a, b, flat, offsets in chunks(column):
            if self.full():
                self.forget()
            starts, ends, first = word_spans(flat, offsets, SPACES)
            flat, starts, ends = self.pieces(flat, starts, ends)
            first = np.searchsorted(starts, offsets)
            place, size = self.words(flat, starts, ends)
            end = np.cumsum(size)
            take = np.repeat(place - (end - size), size) + np.arange(end[-1] if len(end) else 0)
            yield b - a, self.pool[take], np.append(0, end)[first]


def encoded(texts: DataFrame, tokenizer: str, width: int) -> DataFrame:
    """(ids binary) of a table (text): for the sample."""
    kind = np.uint16 if width == 2 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            out = []
            for n, ids, bounds in encoder.encode(batch.column(0)):
                for i in range(n):
                    own = ids[bounds[i] : bounds[i + 1]]
                    begin = zlib.crc32(own.tobytes()) % max(1, len(own) - WINDOW + 1)
                    out.append(own[begin : begin + WINDOW].astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["ids"])

    return map_arrow(texts, run, "ids binary")


def train(docs: DataFrame, tokenizer: str, width: int, sample: int = SAMPLE) -> bytes:
    """The shared dictionary; empty where zstandard finds too little to train on."""
    hashed = docs.select(F.xxhash64("doc_id", F.lit(3)).alias("h"))
    cut = hashed.orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    if cut is None:
        return b""
    chosen = docs.where(F.xxhash64("doc_id", F.lit(3)) <= cut).select("text", F.xxhash64("doc_id", F.lit(3)).alias("h"), F.xxhash64("text").alias("th")).orderBy("h", "th").limit(sample).select("text")
    samples = [x for x in encoded(chosen, tokenizer, width).toArrow().column(0).to_pylist() if x]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def compressor(dictionary: bytes, level: int = 1) -> zstandard.ZstdCompressor:
    own = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=own, write_content_size=True, write_dict_id=False)


def frames(docs: DataFrame, tokenizer: str, dictionary: bytes, width: int) -> DataFrame:
    """(doc_id, th, n_tokens, frame) of each document."""
    kind = np.uint16 if width == 2 else np.uint32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, squeeze = encoder_of(tokenizer), compressor(dictionary)
        for batch in batches:
            sizes, out = [], []
            end = kind(END_ID).tobytes()
            for n, ids, bounds in encoder.encode(batch.column(2)):
                ids = ids.astype(kind)
                for i in range(n):
                    sizes.append(int(bounds[i + 1] - bounds[i]) + 1)
                    out.append(squeeze.compress(ids[bounds[i] : bounds[i + 1]].tobytes() + end))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "th", "n_tokens", "frame"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("th"), "text"), run, "doc_id long, th long, n_tokens long, frame binary")


def pack(ids: list, sizes: list[int], parts: list[bytes], mark: int, width: int) -> bytes:
    n = len(ids)
    offsets = np.zeros(n + 1, "<u8")
    np.cumsum([len(x) for x in parts], out=offsets[1:])
    has = np.array([x is not None for x in ids], np.uint8)
    return b"".join([MAGIC, np.array([1], "<u4").tobytes(), np.array([mark], "<u8").tobytes(), np.array([n, width], "<u4").tobytes(), np.array([x or 0 for x in ids], "<i8").tobytes(), has.tobytes(), np.array(sizes, "<u8").tobytes(), offsets.tobytes(), *parts])


@dataclass
class Shard:
    """Header of an image; ``read(i)`` takes the frame of document i alone."""

    image: bytes

    def __post_init__(self) -> None:
        if self.image[:4] != MAGIC or self.image[4:8] != b"\x01\0\0\0":
            raise ValueError("not a token shard of version 1")
        self.mark = int(np.frombuffer(self.image, "<u8", 1, 8)[0])
        self.n, self.width = (int(x) for x in np.frombuffer(self.image, "<u4", 2, 16))
        n, at = self.n, 24
        ids = np.frombuffer(self.image, "<i8", n, at).tolist()
        has = np.frombuffer(self.image, np.uint8, n, at + 8 * n)
        self.doc_ids = [x if h else None for x, h in zip(ids, has, strict=True)]
        self.sizes = np.frombuffer(self.image, "<u8", n, at + 9 * n).astype(np.int64)
        self.offsets = np.frombuffer(self.image, "<u8", n + 1, at + 17 * n).astype(np.int64)
        self.body = at + 25 * n + 8

    def read(self, i: int, opener: zstandard.ZstdDecompressor) -> np.ndarray:
        frame = self.image[self.body + self.offsets[i] : self.body + self.offsets[i + 1]]
        return np.frombuffer(opener.decompress(frame), "<u2" if self.width == 2 else "<u4").astype("<u4")


def opener(dictionary: bytes) -> zstandard.ZstdDecompressor:
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


def mark_of(dictionary: bytes) -> int:
    return xxhash.xxh64_intdigest(dictionary)


def write(docs: DataFrame, path: str, tokenizer: str | None = None, sample: int = SAMPLE) -> None:
    """Encode ``docs`` (doc_id, text) into the format at ``path``, a folder that all executors reach."""
    spark, tokenizer = docs.sparkSession, tokenizer or default_tokenizer()
    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
    dictionary = train(docs, tokenizer, width, sample)
    mark = mark_of(dictionary)
    spark.createDataFrame([(f"{mark:016x}", dictionary)], "hash string, bytes binary").coalesce(1).write.parquet(f"{path}/dictionary")
    parts = parallelism(docs)
    ws = Workspace(spark, "token-output")
    each = ws.save(frames(docs, tokenizer, dictionary, width), "frames", compression="none")
    ranged = each.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), F.col("th")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "th", "n_tokens").withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        sizes: list[int] = []
        held: list[bytes] = []
        place, number, size = 0, 0, 0

        def shard() -> pa.RecordBatch:
            row = [[place], [number], [len(ids)], [sum(sizes)], [pack(ids, sizes, held, mark, width)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["part", "number", "docs", "tokens", "image"])

        for batch in batches:
            for d, n, f, p in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids.append(d)
                sizes.append(n)
                held.append(f)
                place, size = p, size + len(f)
                if size >= SHARD_BYTES:
                    yield shard()
                    ids, sizes, held, number, size = [], [], [], number + 1, 0
        if ids:
            yield shard()

    shards = map_arrow(ranged.select("doc_id", "n_tokens", "frame", "part"), run, "part int, number int, docs long, tokens long, image binary")
    shards.select(F.expr("CAST(part AS bigint) * 4294967296 + number").alias("shard"), "docs", "tokens", "image").write.option("compression", "none").parquet(f"{path}/shards")
    ws.drop("frames")
    listed = spark.read.parquet(f"{path}/shards").select("shard", "docs", "tokens").withColumn("part", F.expr("shard div 4294967296"))
    # sums run within each part; the parts, as many as tasks that wrote shards, are summed up on the driver
    sums = sorted((r["part"], r["n"]) for r in listed.groupBy("part").agg(F.sum("tokens").alias("n")).collect())
    ahead = list(zip((p for p, _ in sums), itertools.accumulate([0, *(n for _, n in sums)]), strict=False))
    before = spark.createDataFrame(ahead, "part long, ahead long")
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("tokens")
    listed.withColumn("within", within).join(F.broadcast(before), "part").select("shard", "docs", "tokens", (F.col("ahead") + F.col("within")).alias("start")).write.parquet(f"{path}/index")


def dictionary_at(spark: SparkSession, path: str) -> bytes:
    row = spark.read.parquet(f"{path}/dictionary").first()
    if f"{mark_of(bytes(row['bytes'])):016x}" != row["hash"]:
        raise ValueError("the dictionary is damaged")
    return bytes(row["bytes"])


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, its ids."""
    dictionary = dictionary_at(spark, path)
    mark = mark_of(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = opener(dictionary)
        for batch in batches:
            for start, image in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = Shard(image)
                if s.mark != mark:
                    raise ValueError("the shard belongs to another dictionary")
                sizes, sums, all_ids = [], [], []
                for i in range(s.n):
                    ids = s.read(i, reader)
                    sizes.append(len(ids))
                    sums.append(zlib.crc32(ids.tobytes()))
                    if with_ids:
                        all_ids.append(ids.astype(np.int32))
                sizes = np.array(sizes, np.int64)
                columns = [pa.array(s.doc_ids, pa.int64()), pa.array(start + np.cumsum(sizes) - sizes), pa.array(sizes), pa.array(sums, pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array(all_ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    shards = spark.read.parquet(f"{path}/shards").select("shard", "image").join(spark.read.parquet(f"{path}/index").select("shard", "start"), "shard")
    return map_arrow(shards.select("start", "image"), run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def write_and_read(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Write ``docs`` in the shared folder and return what the files say of each document."""
    ws = Workspace(docs.sparkSession, "token-files")
    write(docs, ws.root, tokenizer)
    return read(docs.sparkSession, ws.root)
