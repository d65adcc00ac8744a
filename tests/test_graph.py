"""Walks over graphs of near vectors against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import dense, graph

SF = "/root/testdata/sf0.1"


def frame(spark, v, first=0):
    return spark.createDataFrame([(first + i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").repartition(3)


def clustered(n, seed=2, width=48, parts=40):
    rng = np.random.default_rng(seed)
    return graph.unit(rng.standard_normal((parts, width))[rng.integers(0, parts, n)] + 0.35 * rng.standard_normal((n, width)))


def measured(queries, vectors, k, rows=None, **options):
    """Recall at k, the part of all vectors that a query is held against, and the number of shards."""
    shards, centres = graph.build(vectors, rows)
    shards = shards.persist()
    recall = dense.recall(graph.search(queries, shards, centres, k, **options), dense.exact(queries, vectors, k)).agg(F.avg("recall")).first()[0]
    scored = graph.search(queries, shards, centres, k, counts=True, **options).agg(F.sum("scored")).first()[0]
    out = recall, scored / queries.count() / vectors.count(), shards.count()
    shards.unpersist()
    return out


def test_recall_and_share_of_embeddings(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    queries = e.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    recall, share, _ = measured(queries, e, 10, width=10)
    assert recall >= 0.95 and share < 0.1, (recall, share)
    recall, share, _ = measured(queries, e, 10)
    assert recall >= 0.99 and share < 0.3, (recall, share)


def test_recall_and_share_of_clusters(spark):
    v = clustered(6000)
    rng = np.random.default_rng(3)
    vectors = frame(spark, v)
    queries = frame(spark, graph.unit(v[:150] + 0.1 * rng.standard_normal((150, 48)))).withColumnRenamed("vec_id", "query_id")
    recall, share, shards = measured(queries, vectors, 10)
    assert recall >= 0.95 and share < 0.06 and shards == 1, (recall, share)
    recall, share, shards = measured(queries, vectors, 10, rows=500)
    assert recall >= 0.95 and share < 0.2 and shards >= 12, (recall, share, shards)


def test_all_vectors_can_be_reached():
    rng = np.random.default_rng(4)
    for v in (np.repeat(rng.standard_normal((6, 8)), 70, axis=0), clustered(900, parts=90), rng.standard_normal((2, 8)), rng.standard_normal((1, 8)), np.zeros((30, 8))):
        v = graph.unit(v)
        links = graph.linked(v)
        starts = graph.starting(links)
        best, scored = graph.walk(v, links, starts, v, len(v))
        assert (np.sort(best, axis=1) == np.arange(len(v))).all() and scored == len(v) ** 2


def test_wide_walks_are_exact(spark):
    """Ties, copies, nulls, few vectors and text ids: a walk that keeps all of a shard finds what exact search does."""
    v = np.repeat(clustered(60, width=6, parts=7), 3, axis=0)
    vectors = frame(spark, v, 5).unionByName(spark.createDataFrame([(900, None)], "vec_id long, embedding array<float>"))
    queries = vectors.where("vec_id % 9 = 0 OR vec_id = 900").select(F.concat(F.lit("q"), "vec_id").alias("query_id"), "embedding")
    key = lambda df: sorted(map(tuple, df.collect()))
    for rows, k in ((None, 7), (25, 7), (25, 500)):
        shards, centres = graph.build(vectors, rows)
        got = key(graph.search(queries, shards, centres, k, width=500, share=1.0))
        assert got == key(dense.exact(queries, vectors, k)) and got
    assert graph.near(queries, vectors.limit(0), 5).count() == 0 and graph.near(queries.limit(0), vectors, 5).count() == 0 and graph.near(queries, vectors, 0).count() == 0
    with pytest.raises(Exception, match="must all have"):
        graph.near(queries, vectors.unionByName(spark.createDataFrame([(901, [1.0])], vectors.schema)), 5).collect()
