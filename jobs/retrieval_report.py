"""Measures how well questions find the documents that answer them, for several ways to search.

A question is answered by the documents that contain its gold passage. For each configuration the job ranks documents, finds the first that
is relevant, and writes

    <output>/ranked  config=...         query_id, rank, doc_id, score
    <output>/report  config=.../kind=question   name (the question), answerable, rank of the first relevant document (null where missed)
                     config=.../kind=measure    name (recall@k, mrr, counts), value

Rankings are written first and read again, so the fused configuration and the report share them. A rerun overwrites the partitions of the configurations it was asked for,
and leaves the others.

Tables: documents (doc_id, text), questions (item_id, text: both question and gold passage), vectors (vec_id, embedding: of the
document and of the question of that number). Defined results: rows without a number take no part; a question without words finds nothing lexically and one without a vector
nothing by vectors; a null passage is not answerable; numbers are unique in each table.

    python -m jobs.retrieval_report --documents D --questions Q --vectors V --output OUT [--config FILE]
"""

from __future__ import annotations

import logging
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs import common
from lodestone.operators import dense, evaluate, fusion, lexical
from lodestone.plans import catalogue

log = logging.getLogger("jobs.retrieval_report")
DEFAULTS = Path(__file__).with_suffix(".json")
CONFIGS = ("lexical", "dense", "hybrid")
RANKED = "query_id long, rank int, doc_id long, score double, config string"
REPORT = "name string, answerable boolean, rank int, value double, config string, kind string"


def write(rows: DataFrame, path: str, *partitions: str) -> None:
    """Overwrites the partitions that ``rows`` has and no others."""
    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*partitions).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    log.info("wrote %d rows to %s", seen.get["rows"], path)


def rankings(documents: DataFrame, questions: DataFrame, vectors: DataFrame, output: str, names: list[str], k: int) -> DataFrame:
    """Writes the documents that each configuration ranks, and returns those of ``names``."""
    spark = documents.sparkSession
    path = f"{output}/ranked"

    def keep(found: DataFrame, name: str) -> DataFrame:
        write(found.select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("doc_id").cast("long").alias("doc_id"), "score", F.lit(name).alias("config")), path, "config")
        return spark.read.schema(RANKED).parquet(path).where(F.col("config") == name)

    lexically = near = None
    if {"lexical", "hybrid"} & set(names):
        asked = questions.select(F.col("item_id").alias("query_id"), "text")
        lexically = keep(lexical.bm25(asked, documents, k), "lexical")
    if {"dense", "hybrid"} & set(names):
        of_documents = vectors.join(documents.select(F.col("doc_id").alias("vec_id")), "vec_id")
        of_questions = questions.join(vectors, F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "embedding")
        near = keep(dense.exact(of_questions, of_documents, k).withColumnRenamed("vec_id", "doc_id"), "dense")
    if "hybrid" in names:
        keep(fusion.fuse(near, lexically, k), "hybrid")
    return spark.read.schema(RANKED).parquet(path).where(F.col("config").isin(names))


def run(spark: SparkSession, documents: str, questions: str, vectors: str, output: str, settings: dict | None = None) -> None:
    settings = common.settings(DEFAULTS, None) | (settings or {})
    names, ks = list(settings["configs"]), tuple(settings["ks"])
    if not names or (unknown := set(names) - set(CONFIGS)):
        raise ValueError(f"configurations are some of {', '.join(CONFIGS)}" + (f", not {', '.join(sorted(unknown))}" if names else ""))
    docs = spark.read.parquet(documents).where("doc_id IS NOT NULL").select("doc_id", "text")
    asked = spark.read.parquet(questions).where("item_id IS NOT NULL").select("item_id", "text")
    near = spark.read.parquet(vectors).where("vec_id IS NOT NULL").select("vec_id", "embedding")
    log.info("read %d documents, %d questions and %d vectors", docs.count(), asked.count(), near.count())
    ranked = rankings(docs, asked, near, output, names, settings["top_k"])
    answered = evaluate.containing(asked, docs, "item_id", "doc_id").persist()
    hits = answered.join(ranked, (F.col("item_id") == F.col("query_id")) & (answered["doc_id"] == ranked["doc_id"]))
    first = hits.groupBy("config", "item_id").agg(F.min("rank").alias("rank"))
    gold = asked.select(F.col("item_id").alias("id")).join(answered.select(F.col("item_id").alias("id")).distinct().withColumn("hit", F.lit(True)), "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("answerable"))
    for name in names:
        best = first.where(F.col("config") == name).select(F.col("item_id").alias("id"), "rank")
        results = gold.join(best, "id", "left").select("id", "answerable", "rank")
        each = results.select(F.col("id").cast("string").alias("name"), "answerable", "rank", F.lit(None).cast("double").alias("value"), F.lit(name).alias("config"), F.lit("question").alias("kind"))
        measures = evaluate.summary(results, name, ks).select(F.col("metric").alias("name"), F.lit(None).cast("boolean").alias("answerable"), F.lit(None).cast("int").alias("rank"), "value", "config", F.lit("measure").alias("kind"))
        write(each.unionByName(measures), f"{output}/report", "config", "kind")
    answered.unpersist()


def report(spark: SparkSession, output: str) -> DataFrame:
    """(config, kind, name, answerable, rank, value): the whole report as it stands."""
    return spark.read.schema(REPORT).parquet(f"{output}/report").select("config", "kind", "name", "answerable", "rank", "value")


def job2_retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "retrieval_report")
    for _ in range(2):
        run(spark, *(f"{sf_dir}/{t}.parquet" for t in ("documents", "benchmark", "embeddings")), f"{folder}/output")
    return report(spark, f"{folder}/output")


SQL = f"""WITH {catalogue.FUSED},
every AS (SELECT 'lexical' AS config, query_id, rank, doc_id FROM lex UNION ALL SELECT 'dense', query_id, rank, doc_id FROM dense UNION ALL SELECT 'hybrid', query_id, rank, doc_id FROM fused),
hits AS MATERIALIZED (SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains({catalogue.norm_sql('d.text')}, {catalogue.norm_sql('b.text')})),
best AS (SELECT config, item_id, min(rank)::INT AS rank FROM every JOIN hits ON query_id = item_id AND every.doc_id = hits.doc_id GROUP BY 1, 2),
results AS MATERIALIZED (SELECT c.config, b.item_id AS id, b.item_id IN (SELECT item_id FROM hits) AS answerable, best.rank FROM benchmark b CROSS JOIN (VALUES ('lexical'), ('dense'), ('hybrid')) AS c(config) LEFT JOIN best ON best.config = c.config AND best.item_id = b.item_id),
a AS (SELECT * FROM results WHERE answerable),
measures AS (SELECT config, 'recall@' || k AS name, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE ELSE 0 END), 4) AS value FROM a, (VALUES (1), (3), (5), (10)) AS ks(k) GROUP BY config, k
  UNION ALL SELECT config, 'mrr', round(avg(coalesce(1.0::DOUBLE / rank, 0)), 4) FROM a GROUP BY config
  UNION ALL SELECT config, 'num_answerable', count(*) FILTER (answerable)::DOUBLE FROM results GROUP BY config
  UNION ALL SELECT config, 'num_unanswerable', count(*) FILTER (NOT answerable)::DOUBLE FROM results GROUP BY config)
SELECT config, 'question' AS kind, id::VARCHAR AS name, answerable, rank, NULL::DOUBLE AS value FROM results
UNION ALL SELECT config, 'measure', name, NULL, NULL, value FROM measures"""


def main() -> None:
    args = common.command("retrieval_report", "documents", "questions", "vectors", "output")
    spark = SparkSession.builder.appName("retrieval_report").getOrCreate()
    try:
        run(spark, args.documents, args.questions, args.vectors, args.output, common.settings(DEFAULTS, args.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
