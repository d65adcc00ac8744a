"""Incremental index maintenance by content hash, and versioned snapshots published by one pointer."""

from __future__ import annotations

import json
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.operators import graph, lexical

FORMAT = 4  # of a snapshot
SPLITS, SAMPLE = 100, 1000  # ranges of names that numbers are dealt by, and names that these ranges are read from
TABLES = {
    "chunks": "chunk_id string, doc_name string, chunk_no int, chunk_ord long, text string, embedding array<float>",
    "postings": "term string, chunk_ord long, dl long, tf long",  # while a snapshot is written
    "blocks": "term string, block long, top double, low double, keys array<long>, impacts array<double>",
    "terms": "term string, df long, idf double",
    "stats": "n long, avgdl double",
    "graph": graph.SCHEMA,
    "centres": "cell int, centre array<double>",
    "doc_state": "doc_name string, doc_hash string",
    "actions": "doc_name string, action string, error string",
}


def classify(state: DataFrame, current: DataFrame, full: bool = False) -> DataFrame:
    """(doc_name, doc_hash, action) from stored and present (doc_name, doc_hash): added, updated, unchanged or removed."""
    both = state.select("doc_name", F.col("doc_hash").alias("old"), F.lit(True).alias("was")).join(current.select("doc_name", "doc_hash", F.lit(True).alias("is")), "doc_name", "full_outer")
    same = F.col("old").eqNullSafe(F.col("doc_hash")) & F.lit(not full)
    return both.select("doc_name", "doc_hash", F.when(F.col("is").isNull(), "removed").when(F.col("was").isNull(), "added").when(same, "unchanged").otherwise("updated").alias("action"))


def report(actions: DataFrame) -> DataFrame:
    """(action, docs, names): counts and the sorted names of each action."""
    return actions.groupBy("action").agg(F.count("*").alias("docs"), F.array_join(F.array_sort(F.collect_list("doc_name")), ",").alias("names"))


def remove(chunks: DataFrame, names: DataFrame) -> DataFrame:
    return chunks.join(names.select("doc_name").distinct(), "doc_name", "left_anti")


def removed(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_name, chunks): how many chunks leave with each of the documents."""
    return names.select("doc_name").distinct().join(chunks.groupBy("doc_name").agg(F.count("*").alias("chunks")), "doc_name", "left").fillna(0, ["chunks"])


def starts(per: DataFrame) -> DataFrame:
    """(doc_name, start) of (doc_name, c): the sum of c over all smaller names.

    Names are dealt over ranges whose ends are read from SAMPLE names of least hash, so the running sum is
    one of ranges (at most SPLITS + 1 rows) and one inside each range; no task holds all names.
    """
    some = sorted(r[0] for r in per.where("doc_name IS NOT NULL").select("doc_name").orderBy(F.xxhash64("doc_name"), "doc_name").limit(SAMPLE).collect())
    ends = some[:: max(1, len(some) // SPLITS)]
    at = F.size(F.filter(F.array(*[F.lit(e) for e in ends]), lambda e: e <= F.col("doc_name"))) if ends else F.lit(0)
    dealt = per.withColumn("range", at)
    sums = dealt.groupBy("range").agg(F.sum("c").alias("all")).select("range", (F.sum("all").over(Window.orderBy("range")) - F.col("all")).alias("before"))
    inside = F.sum("c").over(Window.partitionBy("range").orderBy("doc_name")) - F.col("c")
    return dealt.select("doc_name", "range", inside.alias("inside")).join(F.broadcast(sums), "range").select("doc_name", (F.col("before") + F.col("inside")).alias("start"))


def upsert(chunks: DataFrame, delta: DataFrame, gone: DataFrame) -> DataFrame:
    """``chunks`` without the documents of ``delta`` and ``gone``, and ``delta`` after them in order of name and chunk number."""
    kept = remove(chunks, delta.select("doc_name").unionByName(gone.select("doc_name")))
    last = kept.agg(F.coalesce(F.max("chunk_ord"), F.lit(-1)).alias("last"))
    start = starts(delta.groupBy("doc_name").agg(F.count("*").alias("c")))
    new = delta.drop("chunk_ord").join(start, "doc_name").crossJoin(F.broadcast(last)).withColumn("chunk_ord", F.col("last") + 1 + F.col("start") + F.col("chunk_no")).drop("start", "last")
    return kept.unionByName(new.select(kept.columns))


def health(chunks: DataFrame, state: DataFrame) -> DataFrame:
    return chunks.agg(F.count("*").alias("chunks")).crossJoin(state.agg(F.count("*").alias("documents")))


class Snapshots:
    """Snapshot folders below ``root`` and a pointer file that names the current one; readers see whole snapshots only."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(conf), p, jvm

    def current(self) -> dict | None:
        fs, path, _ = self._fs(f"{self.root}/CURRENT")
        if not fs.exists(path):
            return None
        stream = fs.open(path)  # a question must not cost a job for this
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, table: str) -> DataFrame:
        now = self.current()
        if now is None:
            return self.spark.createDataFrame([], TABLES[table])
        if now.get("format") != FORMAT:
            raise ValueError("the index has an older format; rebuild it")
        return self._table(now["snapshot"], table)

    def _table(self, name: str, table: str) -> DataFrame:
        return self.spark.read.schema(TABLES[table]).parquet(f"{self.root}/{name}/{table}")

    def _write(self, name: str, table: str, df: DataFrame, **options: int) -> DataFrame:
        df.select(*df.columns).to(self.spark.createDataFrame([], TABLES[table]).schema).write.options(**options).parquet(f"{self.root}/{name}/{table}")
        return self._table(name, table)

    def graph(self) -> tuple[DataFrame, np.ndarray] | None:
        """Graphs of vectors, a row a shard, and the cells' centres (at most ``dense.MOST_CELLS``), where the snapshot has them."""
        now = self.current()
        if now is None or not now.get("graph"):
            return None
        return self.read("graph"), np.array([r[0] for r in self.read("centres").orderBy("cell").select("centre").collect()])

    def _delete(self, name: str) -> None:
        fs, path, _ = self._fs(f"{self.root}/{name}")
        fs.delete(path, True)

    def _tidy(self, keep: set[str | None]) -> None:
        """Older snapshots and those that failed go; the last but one stays for who still reads it. One writer at a time is assumed."""
        fs, path, _ = self._fs(self.root)
        for found in fs.listStatus(path):
            if (folder := found.getPath().getName()).startswith("v-") and folder not in keep:
                self._delete(folder)

    def publish(self, chunks: DataFrame, state: DataFrame, model: str, actions: DataFrame | None = None, graph_from: int | None = None) -> str:
        """Write all tables, check them, then flip the pointer in one rename. A change of model needs a rebuild.

        Packed postings are sorted by term, so that a reader of few terms skips the other row groups.
        From ``graph_from`` chunks on the vectors get graphs, a file each, so that each is a task.
        """
        name, before = f"v-{uuid.uuid4().hex}", self.current()
        written = self._write(name, "chunks", chunks)
        told = self._write(name, "doc_state", state)
        if actions is not None:
            self._write(name, "actions", actions)
        rows, ids, sizes, missing = written.agg(F.count("*"), F.count_distinct("chunk_id"), F.count_distinct(F.size("embedding")), F.count_if(F.col("embedding").isNull())).first()
        if sizes > 1 or missing:
            raise ValueError("chunks need one vector each, all of one size")
        if ids != rows or not written.join(told, "doc_name", "left_anti").isEmpty():
            raise ValueError("chunks need names of their own and documents that are known")
        texts = written.select("chunk_ord", "text")
        post = self._write(name, "postings", lexical.postings(texts, "chunk_ord"))
        stats = self._write(name, "stats", lexical.corpus(texts, post))
        terms = self._write(name, "terms", lexical.idf(post, stats).repartitionByRange("term").sortWithinPartitions("term"))
        packs = lexical.blocks(lexical.Index(post, terms, stats), "chunk_ord")
        self._write(name, "blocks", packs.repartitionByRange("term", "block").sortWithinPartitions("term", "block"))
        self._delete(f"{name}/postings")
        dealt = graph_from is not None and 0 < rows >= graph_from
        if dealt:
            vectors = written.select(F.col("chunk_ord").alias("vec_id"), "embedding")
            shards, centres = graph.build(vectors)
            self._write(name, "graph", shards, maxRecordsPerFile=1)
            self._write(name, "centres", self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], TABLES["centres"]))
        fs, path, jvm = self._fs(f"{self.root}/CURRENT")
        tmp = jvm.org.apache.hadoop.fs.Path(f"{self.root}/CURRENT.{uuid.uuid4().hex}")
        out = fs.create(tmp)
        out.write(bytearray(json.dumps({"snapshot": name, "model": model, "format": FORMAT, "graph": dealt}).encode()))
        out.close()
        ctx = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        ctx.rename(tmp, path, options)
        self._tidy({name, (before or {}).get("snapshot")})
        return name
