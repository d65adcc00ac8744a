"""Reciprocal rank fusion of ranked lists, and reranking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def fuse(dense: DataFrame, lexical: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """(query_id, rank, key, score, dense_rank, lexical_rank): sums of 1 / (60 + rank); ties by dense rank, then lexical. One shuffle."""
    both = dense.select("query_id", key, F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("lexical_rank")).unionByName(lexical.select("query_id", key, F.lit(None).cast("int").alias("dense_rank"), F.col("rank").alias("lexical_rank")))
    part = [F.coalesce(F.lit(1.0) / (RRF_K + F.col(c)), F.lit(0.0)) for c in ("dense_rank", "lexical_rank")]
    one = both.groupBy("query_id", key).agg(F.min("dense_rank").alias("dense_rank"), F.min("lexical_rank").alias("lexical_rank")).withColumn("score", part[0] + part[1])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("lexical_rank"))
    return one.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", key, "score", "dense_rank", "lexical_rank")


def rerank(candidates: DataFrame, scorer: Callable[[Column, Column], Column], top_n: int) -> DataFrame:
    """Candidates (query_id, rank, query, text, ...) by ``scorer(query, text)``, ties in their order; top_n of each query.

    ``scorer`` is any column function, such as a pandas UDF around a cross-encoder.
    """
    best = Window.partitionBy("query_id").orderBy(F.desc("new_score"), F.asc("rank"))
    scored = candidates.withColumn("new_score", scorer(F.col("query"), F.col("text")))
    return scored.withColumn("new_rank", F.row_number().over(best)).where(F.col("new_rank") <= top_n).drop("rank", "score").withColumnsRenamed({"new_rank": "rank", "new_score": "score"})


def cut(ranked: DataFrame, top_n: int) -> DataFrame:
    return ranked.where(F.col("rank") <= top_n)
