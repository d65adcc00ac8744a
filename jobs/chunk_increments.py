"""Keeps the chunks of a growing folder of documents up to date.

Users of a retrieval system add files to a corpus and change some. This job is a file stream over tables (doc_id, text, lang): each run
takes the files that the checkpoint has not seen, compares content hashes with what is stored, and cuts only new and changed documents
into chunks. It writes

    <output>/chunks     lang=.../version=...   doc_id, chunk_no, chunk_id, text, n_chars, n_tokens
    <output>/documents  version=...            doc_id, doc_hash, lang, chunks

where version is the number of the stream's batch. Nothing that is written is changed later: a document's last version is the one that counts (``current``),
and one that has become empty is a row of ``documents`` without chunks. A batch that is repeated after a failure overwrites its own partitions, chunks
first, and sees the versions before it only, so a rerun gives the same tables.

Defined results: rows without doc_id are left out and counted in the log; of several rows of a document in one batch the one with the largest hash counts, then the
largest lang; null and blank texts have no chunks; no lang is null; columns that the job does not name are not read.

    python -m jobs.chunk_increments --documents IN --output OUT --checkpoint CHECKPOINT [--config FILE]
"""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs import common
from lodestone.functions import text as X
from lodestone.operators import chunking, sync
from lodestone.plans import catalogue

log = logging.getLogger("jobs.chunk_increments")
DEFAULTS = Path(__file__).with_suffix(".json")
DOCUMENTS = "doc_id long, text string, lang string"
CHUNKS = "doc_id long, chunk_no int, chunk_id string, text string, n_chars int, n_tokens int, lang string, version long"
LEDGER = "doc_id long, doc_hash string, lang string, chunks long, version long"


def stored(spark: SparkSession, output: str, table: str, schema: str) -> DataFrame:
    """What is written of a table; no rows where there is none yet."""
    path = f"{output}/{table}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def latest(ledger: DataFrame) -> DataFrame:
    """The last row of each document."""
    last = F.max(F.struct("version", "doc_hash", "lang", "chunks"))
    return ledger.groupBy("doc_id").agg(last.alias("x")).select("doc_id", "x.*")


def write(rows: DataFrame, path: str, *partitions: str) -> int:
    """Overwrites the partitions that ``rows`` has and no others; returns how many rows that were."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*partitions).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    return seen.get["rows"]


def add(batch: DataFrame, version: int, output: str, settings: dict) -> None:
    """One batch of documents: new and changed ones become chunks of this version."""
    spark = batch.sparkSession
    rows = batch.select("doc_id", "text", F.nullif("lang", F.lit("")).alias("lang"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("doc_hash"))
    seen = rows.agg(F.count("*").alias("rows"), F.count("doc_id").alias("named")).first()
    # narrow rows decide what is new; texts are not shuffled for that
    present = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.struct("doc_hash", "lang")).alias("x")).select("doc_id", "x.*")
    before = latest(stored(spark, output, "documents", LEDGER).where(F.col("version") < version))
    name = F.col("doc_id").cast("string").alias("doc_name")
    actions = sync.classify(before.select(name, hashed("doc_hash", "lang")), present.select(name, hashed("doc_hash", "lang")))
    todo = actions.where("action IN ('added', 'updated')").select(F.col("doc_name").cast("long").alias("doc_id"), "action")
    changed = present.join(todo, "doc_id").persist()
    same = (F.col("doc_id") == F.col("c_id")) & (F.col("doc_hash") == F.col("c_hash")) & F.col("lang").eqNullSafe(F.col("c_lang"))
    texts = rows.join(changed.select(F.col("doc_id").alias("c_id"), F.col("doc_hash").alias("c_hash"), F.col("lang").alias("c_lang")), same, "left_semi").dropDuplicates(["doc_id"])
    pieces = chunking.chunks(texts, settings["chunk_size"], settings["overlap"], "doc_id", keep=("lang",))
    pieces = pieces.select("doc_id", "chunk_no", "chunk_id", "text", F.length("text").alias("n_chars"), F.size(X.tokenize(F.col("text"))).alias("n_tokens"), "lang", F.lit(version).cast("long").alias("version"))
    chunks = write(pieces, f"{output}/chunks", "lang", "version")
    mine = stored(spark, output, "chunks", CHUNKS).where(F.col("version") == version)
    per = mine.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    ledger = changed.join(per, "doc_id", "left").select("doc_id", "doc_hash", "lang", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.lit(version).cast("long").alias("version"))
    written = write(ledger, f"{output}/documents", "version")
    counts = {r["action"]: r["n"] for r in changed.groupBy("action").agg(F.count("*").alias("n")).collect()}
    changed.unpersist()
    log.info("version %d: read %d rows (%d without doc_id), %d documents added, %d updated; wrote %d chunks and %d ledger rows to %s", version, seen["rows"], seen["rows"] - seen["named"], counts.get("added", 0), counts.get("updated", 0), chunks, written, output)


def hashed(*columns: str):
    """One hash of several columns, null told apart from empty."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256).alias("doc_hash")


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: dict | None = None) -> None:
    """Takes all files of ``documents`` that ``checkpoint`` has not seen, and ends."""
    settings = common.settings(DEFAULTS, None) | (settings or {})
    chunking.check_sizes(settings["chunk_size"], settings["overlap"])
    stream = spark.readStream.schema(DOCUMENTS).format(settings["format"]).option("maxFilesPerTrigger", settings["files_per_batch"]).load(documents)
    writer = stream.writeStream.foreachBatch(lambda batch, version: add(batch, version, output, settings)).option("checkpointLocation", checkpoint)
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("%s is up to date with %s: %d batches in this run", output, documents, len([p for p in query.recentProgress if p["numInputRows"]]))


def current(spark: SparkSession, output: str) -> DataFrame:
    """(doc_id, lang, chunk_no, chunk_id, text, n_chars, n_tokens) of each document's last version."""
    last = latest(stored(spark, output, "documents", LEDGER)).where("chunks > 0").select("doc_id", "version")
    return stored(spark, output, "chunks", CHUNKS).join(last, ["doc_id", "version"]).select("doc_id", "lang", "chunk_no", "chunk_id", "text", "n_chars", "n_tokens")


def job1_chunk_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "chunk_increments")
    for _ in range(2):
        # as a pattern: a file stream takes folders and patterns, and the table may be one file
        run(spark, f"{sf_dir}/documents.parquet*", f"{folder}/output", f"{folder}/checkpoint")
    return current(spark, f"{folder}/output")


SQL = f"""WITH {catalogue.chunks_sql(1000, 150)}
SELECT c.doc_id, nullif(d.lang, '') AS lang, chunk_no, c.doc_id || '#chunk-' || chunk_no AS chunk_id, c.text, length(c.text)::INT AS n_chars, len({catalogue.tokens_sql('c.text')})::INT AS n_tokens
FROM chunks c JOIN documents d ON d.doc_id = c.doc_id"""


def main() -> None:
    args = common.command("chunk_increments", "documents", "output", "checkpoint")
    spark = SparkSession.builder.appName("chunk_increments").getOrCreate()
    try:
        run(spark, args.documents, args.output, args.checkpoint, common.settings(DEFAULTS, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
