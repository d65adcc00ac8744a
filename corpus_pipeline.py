"""From documents to token files: toxicity, near duplicates, benchmark leaks, source mix, token ids.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept, written and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontamination, mixing, ngram_join, token_output, toxicity
from lodestone.llm.common import Workspace

TOXIC = 0.7


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under TOXIC; the model learns from the labelled ones among them.

    Null and empty texts have a score like any other; rows repeated score alike, so all of them stay or go.
    """
    model = toxicity.fit_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, out="__toxic").where(F.col("__toxic") < TOXIC).drop("__toxic")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of links with a similarity of 3/4 or more: that of the smallest doc_id, ties by the text's hash.

    Null and blank texts all stay; of a row repeated with doc_id and text one stays.
    """
    return ngram_join.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null and empty texts hold none, rows repeated all stay or go."""
    return decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, from none to twice; null and empty texts have no words and are not taken, a null source is one of its own."""
    return mixing.take(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix; returned is what they say of each document: doc_id, start, n_tokens, ids_crc32.

    Documents taken twice are two rows; rows without doc_id come first.
    """
    return token_output.write_and_read(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token_output", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ws = Workspace(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
