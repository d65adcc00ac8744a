"""One question at a time: the same answer as a batch plan gives, in a handful of small jobs over tables that may be kept in memory."""

from __future__ import annotations

from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from typing import TYPE_CHECKING

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import dense, fusion, lexical

if TYPE_CHECKING:
    from lodestone.plans.engine import Engine

LITERALS = 200  # up to so many different terms of a question reach the scan of the stored postings as a list
KEPT = ("blocks", "texts", "packs")


class OneQuestion:
    """Searches the current snapshot of an engine's index.

    What comes to the driver is the question's own vector and terms and ``top_k`` rows of each ranking. ``warm`` keeps packed postings, vectors and texts with the executors,
    in memory or on their disks, until another snapshot is current; without it the stored tables are read.
    """

    def __init__(self, engine: Engine):
        self.engine, self.name, self.tables, self.kept = engine, None, {}, False

    def _tables(self) -> dict[str, DataFrame]:
        store = self.engine.store
        now = (store.current() or {}).get("snapshot")
        if now != self.name or not self.tables:
            again = self.kept
            self.cool()
            chunks = store.read("chunks")
            self.tables = {"blocks": store.read("blocks"), "texts": chunks.select("chunk_ord", "chunk_id", "text"), "packs": dense.packed(chunks.select(F.col("chunk_ord").alias("vec_id"), "embedding")), "chunks": chunks}
            self.name = now
            if again:
                self.warm()
        return self.tables

    def warm(self) -> None:
        tables = self._tables()
        if not self.kept:
            self.kept = True
            for name in KEPT:
                tables[name] = tables[name].persist(StorageLevel.MEMORY_AND_DISK)
                tables[name].count()

    def cool(self) -> None:
        for name in KEPT if self.kept else ():
            self.tables[name].unpersist()
        self.tables, self.kept = {}, False

    def search(self, question: str, hybrid: bool | None = None, rerank: bool | None = None, keep: int | None = None) -> list[dict]:
        """Rows rank, chunk_id, text and score, best first: what ``Engine.retrieve`` has for this question."""
        e, s, tables = self.engine, self.engine.settings, self._tables()
        hybrid = s.use_hybrid_search if hybrid is None else hybrid
        rerank = s.use_reranker if rerank is None else rerank
        asked = e.spark.range(0, 1, 1, 1).select(F.lit(question).alias("question"))  # one task
        one = asked.select(X.tokenize(F.col("question")).alias("terms"), e.embedder(X.with_prefix(F.col("question"), s.embedding_model, X.QUERY_PREFIX)).alias("v")).collect()[0]
        with ThreadPoolExecutor(2) as pool:  # both rankings at once
            near = pool.submit(inheritable_thread_target(e.spark)(self._near), one["v"], tables)
            words = self._words(question, one["terms"], tables) if hybrid else None
            best = near.result()
        if words is not None:
            best = fused([i for i, _ in best], [i for i, _ in words], s.top_k)
        order = {i: (rank, score) for rank, (i, score) in enumerate(best, 1)}
        rows = tables["texts"].where(F.col("chunk_ord").isin(list(order))).collect() if order else []
        out = sorted(({"rank": order[r["chunk_ord"]][0], "chunk_id": r["chunk_id"], "text": r["text"], "score": order[r["chunk_ord"]][1]} for r in rows), key=lambda r: r["rank"])
        if rerank and out:
            pairs = e.spark.createDataFrame([("q", r["rank"], question, r["chunk_id"], r["text"]) for r in out], "query_id string, rank int, query string, chunk_id string, text string")
            return [r.asDict() for r in fusion.rerank(pairs.withColumn("score", F.lit(0.0)), e.scorer, keep or s.top_k).select("rank", "chunk_id", "text", "score").orderBy("rank").collect()]
        return out[: keep or s.top_k]

    def _near(self, vector: list[float], tables: dict[str, DataFrame]) -> list[tuple[int, float]]:
        e, k = self.engine, self.engine.settings.top_k
        if e.searcher is None and (e.settings.vector_backend == "exact" or e.store.graph() is None):
            return [tuple(r) for r in dense.nearest_packed(np.array(vector, np.float64), tables["packs"], k).collect()]
        asked = e.spark.createDataFrame([("q", vector)], "query_id string, embedding array<float>")
        return [(r["vec_id"], r["score"]) for r in e._near(asked, tables["chunks"]).orderBy("rank").collect()]

    def _words(self, question: str, terms: list[str], tables: dict[str, DataFrame]) -> list[tuple[int, float]]:
        """The k best chunks by BM25; chunks without a shared word follow with score 0, in order, and go before negative scores."""
        k, times = self.engine.settings.top_k, Counter(terms)
        if len(times) > LITERALS:
            return self._batch(question, tables)
        found = []
        if times:
            own = F.create_map(*[F.lit(x) for t, n in times.items() for x in (t, n)])
            met = tables["blocks"].where(F.col("term").isin(list(times))).select(own[F.col("term")].alias("times"), F.explode(F.arrays_zip("keys", "impacts")).alias("p"))
            scored = met.groupBy(F.col("p.keys").alias("key")).agg((F.round(F.sum(F.col("times") * F.col("p.impacts")), 6) + F.lit(0.0)).alias("score"))
            found = [tuple(r) for r in scored.orderBy(F.desc("score"), "key").limit(k).collect()]
        if len(found) == k and found[-1][1] <= 0:
            return self._batch(question, tables)  # more matches than these may stand after chunks that share no word
        if len(found) < k:
            rest = tables["texts"].where(~F.col("chunk_ord").isin([i for i, _ in found])) if found else tables["texts"]
            found += [(r[0], 0.0) for r in rest.select("chunk_ord").orderBy("chunk_ord").limit(k).collect()]
        return sorted(found, key=lambda x: (-x[1], x[0]))[:k]

    def _batch(self, question: str, tables: dict[str, DataFrame]) -> list[tuple[int, float]]:
        asked = self.engine.spark.createDataFrame([("q", question)], "query_id string, text string")
        rows = lexical.bm25(asked, tables["texts"].select("chunk_ord", "text"), self.engine.settings.top_k, "chunk_ord", fill=True, stored=tables["blocks"]).orderBy("rank").collect()
        return [(r["chunk_ord"], r["score"]) for r in rows]


def fused(near: list[int], words: list[int], k: int) -> list[tuple[int, float]]:
    """``fusion.fuse`` of two short rankings."""
    last = float("inf")
    places = {i: [last, last] for i in [*near, *words]}
    for j, ranking in enumerate((near, words)):
        for rank, i in enumerate(ranking, 1):
            places[i][j] = rank
    scored = [(-sum(1.0 / (fusion.RRF_K + r) for r in ranks if r < last), *ranks, i) for i, ranks in places.items()]
    return [(i, -s) for s, _, _, i in sorted(scored)[:k]]
