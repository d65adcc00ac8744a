"""What the operators share: the shared folder, vectorised words and hashes over Arrow batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 256 << 10  # text bytes that one vectorised step works on; a longer text makes a step of its own
BATCH_ROWS, BATCH_BYTES = 1000, 2 << 20  # of an Arrow batch that a worker handles at once; one longer row makes a batch of its own

MULT = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master, which has no other machines, gets a folder of its own where that is unset.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(conf).delete(folder, True)


_CLEANED: set[str] = set()


def clean_up(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application. Frames returned before can no longer be read."""
    if spark.sparkContext._jsc is not None:
        delete(spark, f"{shared_dir(spark)}/lodestone/{spark.sparkContext.applicationId}")


def _clean_up_at_exit(spark: SparkSession) -> None:
    try:
        clean_up(spark)
    except Exception:  # noqa: BLE001  the JVM may have gone first; its tables then stay
        return


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of about BATCH_BYTES for what runs inside; the session's settings come back after."""
    before = {}
    for key, value in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        before[key] = spark.conf.get(key)
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


class Workspace:
    """Tables written in the shared folder to cut lineage; a lost executor costs only re-reading them.

    ``drop`` deletes those that no returned frame reads; what remains goes with the application (``clean_up``).
    """

    def __init__(self, spark: SparkSession, name: str):
        app = spark.sparkContext.applicationId
        self.spark, self.root = spark, f"{shared_dir(spark)}/lodestone/{app}/{name}-{uuid.uuid4().hex}"
        if app not in _CLEANED:
            _CLEANED.add(app)
            atexit.register(_clean_up_at_exit, spark)

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = f"{self.root}/{name}"
        with small_batches(self.spark):
            df.write.options(**{"compression": "zstd"} | options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete intermediate tables that no returned plan reads any more."""
        for name in names:
            delete(self.spark, f"{self.root}/{name}")


def parallelism(df: DataFrame) -> int:
    """Partitions for a shuffle of about as many bytes as ``df`` is read in: grows with the input."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit integers."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_FACTORS: list[np.ndarray] = [np.zeros(0, np.uint64)]


def factors(n: int) -> np.ndarray:
    """Fixed pseudo-random 64-bit factors, one for each place in a word."""
    if len(_FACTORS[0]) < n:
        _FACTORS[0] = mix(np.arange(1, max(2 * n, 1024) + 1, dtype=np.uint64) * MULT)
    return _FACTORS[0][:n]


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of UTF-8 outside the words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
NOT_ALNUM = np.zeros(256, bool)
NOT_ALNUM[0x00:0x30] = NOT_ALNUM[0x3A:0x61] = NOT_ALNUM[0x7B:0x80] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row's begin and end; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) in steps of about ``limit`` bytes of whole texts."""
    flat, offsets = utf8(column)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, b, flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_spans(flat: np.ndarray, offsets: np.ndarray, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends in bytes of all words, and for each row the index of its first word (one more entry than rows)."""
    inside = ~outside[flat]
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < len(flat)]
    first[edge] = inside[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    last[edge] = inside[edge]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def letters(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words one after another: each byte's place in the text and in its word, and where each word begins among them."""
    size = ends - starts
    begin = np.cumsum(size) - size
    inside = np.arange(int(size.sum())) - np.repeat(begin, size)
    return inside + np.repeat(starts, size), inside, begin


def steps(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Slices of whole items, each of about ``limit`` in total."""
    end = np.cumsum(sizes)
    a = 0
    while a < len(sizes):
        b = max(a + 1, int(np.searchsorted(end, end[a] - sizes[a] + limit, side="right")))
        yield slice(a, b)
        a = b


def word_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes (words are not empty): byte + 1 times the factor of its place, summed, mixed with the length.

    Two different words have the same hash with a chance of 2**-57 over the factors, and of 2**-64 where some
    byte differs by an odd number. It is no polynomial: periodic words do not fall together.
    """
    out = np.zeros(len(starts), np.uint64)
    size = ends - starts
    for part in steps(size, 4 * CHUNK_BYTES):
        at, inside, begin = letters(starts[part], ends[part])
        out[part] = np.add.reduceat((flat[at].astype(np.uint64) + np.uint64(1)) * factors(int(size[part].max()))[inside], begin)
    return mix(out + size.astype(np.uint64) * MULT)


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, by where it starts; the last k-1 places have none."""
    n = max(0, len(words) - k + 1)
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = out * MULT + words[i : i + n]
    return mix(out)


def small(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about BATCH_BYTES."""
    rows = max(1, min(BATCH_ROWS, batch.num_rows * BATCH_BYTES // max(1, batch.nbytes)))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def map_arrow(df: DataFrame, f: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` whose function sees and yields small batches, whatever the session's batch size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim = give_back()
        yield from f(part for batch in batches for part in small(batch))
        trim()

    return df.mapInArrow(run, schema)


def give_back() -> Callable[[], None]:
    """Keeps freed arrays from staying with a worker that is used again; does nothing without glibc."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, 4 << 20)  # M_MMAP_THRESHOLD: no longer grows with what is freed
        libc.mallopt(-8, 1)  # M_ARENA_MAX
    except OSError:
        return lambda: None
    return lambda: libc.malloc_trim(0) and None


def components(ws: Workspace, links: DataFrame, name: str) -> DataFrame:
    """(node, comp): comp is the smallest node reachable over ``links`` (a, b).

    Alternating large-star and small-star steps, each written to the shared folder; the number of
    links never grows. Nodes without links are not returned.
    """
    edges = ws.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    step = 0
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        step += 1
        now = ws.save(small, f"{name}-{step}")
        done = edges.exceptAll(now).isEmpty() and now.exceptAll(edges).isEmpty()
        if step > 1:
            ws.drop(f"{name}-{step - 2}")
        if done:
            ws.drop(f"{name}-{step - 1}")
        edges = now
        if done:
            return edges.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
