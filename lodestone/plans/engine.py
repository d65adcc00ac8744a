"""From a folder to answers: index maintenance, batched retrieval, prompts and evaluation."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import embed
from lodestone.functions import text as X
from lodestone.operators import chunking, dense, evaluate, fusion, graph, lexical, sync
from lodestone.operators.evaluate import KS
from lodestone.plans import config, llm_client, serving
from lodestone.sources import files

# The instruction that opens a grounded question.
INSTRUCTION = "Answer the question using only the context below. If the context is insufficient, say so instead of guessing."
Retrieve = Callable[[DataFrame], DataFrame]  # (query_id, question) to (query_id, rank, text, ...)
log = logging.getLogger(__name__)
NO_CONTEXT = "No indexed passage answers this question."


class Engine:
    def __init__(self, spark: SparkSession, settings: config.Settings, embedder: embed.Embedder | None = None, scorer: Callable[[Column, Column], Column] | None = None, searcher: dense.Searcher | None = None):
        self.spark, self.settings = spark, config.check(settings)
        self.embedder = embedder or embed.sentence_model(settings.embedding_model, settings.embedding_batch_size)
        self.scorer = scorer or embed.cross_encoder(settings.reranker_model)
        self.searcher = searcher
        self.store = sync.Snapshots(spark, settings.index_dir)
        self.one = serving.OneQuestion(self)

    def sync(self, full: bool = False, lazy: bool = False) -> DataFrame:
        """Bring the index up to date with docs_dir; returns (doc_name, action, error). Only changed files are read as text.

        A file that cannot be read keeps its old chunks and hash, so the next sync tries it again. Only texts of chunks
        that the index does not hold are embedded, each once. A snapshot is published in any case; with ``lazy`` only
        where a document changed, or where the settings ask for graphs that the current one lacks.
        """
        s = self.settings
        now = self.store.current()
        if now and now["model"] != s.embedding_model and not full:
            raise ValueError("the index was built with another embedding model; rebuild it")
        fresh = full or not now
        old_chunks, state = (self.spark.createDataFrame([], sync.TABLES[t]) if fresh else self.store.read(t) for t in ("chunks", "doc_state"))
        found = files.load(self.spark, s.docs_dir)
        actions = sync.classify(state, found, full).persist()
        searched = {"auto": s.approximate_min_chunks, "graph": 0}.get(s.vector_backend)
        if lazy and not fresh and actions.where("action <> 'unchanged'").isEmpty() and not self._lacks_graph(now, old_chunks, searched):
            actions.unpersist()
            log.info("no document changed")
            return state.select("doc_name", F.lit("unchanged").alias("action"), F.lit(None).cast("string").alias("error"))
        todo = actions.where(F.col("action").isin("added", "updated")).select("doc_name")
        texts = files.extract(found.join(todo, "doc_name", "left_semi"), s.ocr_images).persist()
        good = texts.where("error IS NULL")
        pieces = chunking.chunks(good, s.chunk_size_chars, s.chunk_overlap_chars)
        vectors = embed.by_content(pieces, old_chunks, lambda text: self.embedder(X.with_prefix(text, s.embedding_model, X.PASSAGE_PREFIX)))
        delta = vectors.select("chunk_id", "doc_name", "chunk_no", F.lit(0).cast("long").alias("chunk_ord"), "text", "embedding").persist()
        gone = actions.where("action = 'removed'").select("doc_name").unionByName(good.select("doc_name"))
        chunks = sync.upsert(old_chunks, delta, gone)
        kept = sync.remove(state, gone).unionByName(good.select("doc_name", "doc_hash"))
        out = actions.join(texts.select("doc_name", "error"), "doc_name", "left").select("doc_name", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("action")).alias("action"), "error")
        try:
            self.store.publish(chunks, kept, s.embedding_model, out, searched)
        finally:
            for kept_for_now in (actions, texts, delta):
                kept_for_now.unpersist()
        log.info("index published")
        return self.store.read("actions")

    def _lacks_graph(self, now: dict, chunks: DataFrame, searched: int | None) -> bool:
        """Whether the settings ask for graphs of vectors that the current snapshot was written without."""
        return searched is not None and not now.get("graph") and 0 < chunks.count() >= searched

    def retrieve(self, questions: DataFrame, hybrid: bool | None = None, rerank: bool | None = None, keep: int | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, text, score) for questions (query_id, question), all in one plan; texts join after the cut."""
        s = self.settings
        hybrid = s.use_hybrid_search if hybrid is None else hybrid
        rerank = s.use_reranker if rerank is None else rerank
        chunks = self.store.read("chunks")
        asked = questions.select("query_id", self.embedder(X.with_prefix(F.col("question"), s.embedding_model, X.QUERY_PREFIX)).alias("embedding"))
        best = self._near(asked, chunks).withColumnRenamed("vec_id", "chunk_ord")
        if hybrid:
            words = lexical.bm25(questions.select("query_id", F.col("question").alias("text")), chunks.select("chunk_ord", "text"), s.top_k, "chunk_ord", fill=True, stored=self.store.read("blocks"))
            best = fusion.fuse(best, words, s.top_k, "chunk_ord").select("query_id", "rank", "chunk_ord", "score")
        found = best.join(chunks.select("chunk_ord", "chunk_id", "text"), "chunk_ord").select("query_id", "rank", "chunk_id", "text", "score")
        if rerank:
            pairs = found.join(questions.select("query_id", F.col("question").alias("query")), "query_id")
            return fusion.rerank(pairs, self.scorer, keep or s.top_k).select("query_id", "rank", "chunk_id", "text", "score")
        return fusion.cut(found, keep or s.top_k)

    def _near(self, asked: DataFrame, chunks: DataFrame) -> DataFrame:
        """Nearest chunks: by the searcher that was given, by the stored graphs, or exactly."""
        s = self.settings
        vectors = chunks.select(F.col("chunk_ord").alias("vec_id"), "embedding")
        if self.searcher is not None:
            return self.searcher(asked, vectors, s.top_k)
        dealt = None if s.vector_backend == "exact" else self.store.graph()
        if dealt is None:
            return dense.exact(asked, vectors, s.top_k)
        return graph.search(asked, *dealt, s.top_k)

    def prompts(self, questions: DataFrame) -> DataFrame:
        """(query_id, prompt, contexts): null prompt where nothing was found."""
        found = self.retrieve(questions, keep=self.settings.top_n_contexts)
        held = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text", "score"))).alias("contexts"))
        both = questions.join(held, "query_id", "left")
        return both.select("query_id", F.when(F.col("contexts").isNotNull(), X.rag_prompt(F.col("question"), F.col("contexts.text"), INSTRUCTION)).alias("prompt"), "contexts")

    def client(self) -> llm_client.ChatClient:
        return llm_client.ChatClient(self.settings)

    def ask(self, question: str) -> dict:
        """Answer and contexts of one question."""
        contexts, prompt = self._one(question)
        return {"answer": self.client().chat(config.system_prompt(self.settings), prompt) if contexts else NO_CONTEXT, "contexts": contexts}

    def ask_stream(self, question: str) -> tuple[list[dict], Iterator[str]]:
        contexts, prompt = self._one(question)
        return contexts, self.client().stream(config.system_prompt(self.settings), prompt) if contexts else iter([NO_CONTEXT])

    def _one(self, question: str) -> tuple[list[dict], str]:
        if not 1 <= len(question) <= 10_000:
            raise ValueError("a question has 1 to 10000 characters")
        contexts = self.one.search(question, keep=self.settings.top_n_contexts)
        if not contexts:
            return [], ""
        prompt = X.rag_prompt(F.lit(question), F.array(*[F.lit(c["text"]) for c in contexts]), INSTRUCTION)
        return contexts, self.spark.range(0, 1, 1, 1).select(prompt).collect()[0][0]

    def analyze(self, path: str) -> str:
        """The model's analysis of one document, cut to max_analysis_chars."""
        rows = files.extract(files.load(self.spark, path)).select("error", X.truncate(F.col("text"), self.settings.max_analysis_chars).alias("text"), X.is_blank(F.col("text")).alias("blank")).head(1)
        if not rows or rows[0]["error"] or rows[0]["blank"]:
            raise ValueError(f"no text in {path}" + (f": {rows[0]['error']}" if rows and rows[0]["error"] else ""))
        return self.client().chat(config.system_prompt(self.settings), rows[0]["text"])

    def results(self, questions: DataFrame, how: Retrieve | dict, timed: bool = False) -> DataFrame:
        """(id, answerable, rank) for a way to retrieve: options of ``retrieve`` or any function of (query_id, question).

        ``timed`` adds latency_ms: each question of the stated set is asked alone, after one that warms up and does not count.
        """
        asked = questions.select(F.col("id").alias("query_id"), "question")
        if not timed:
            return evaluate.first_relevant(how(asked) if callable(how) else self.retrieve(asked, **how), questions)

        def ask(row: T.Row) -> list[tuple]:
            if callable(how):
                return [(r["rank"], r["text"]) for r in how(self.spark.createDataFrame([row], asked.schema)).select("rank", "text").collect()]
            return [(r["rank"], r["text"]) for r in self.one.search(row["question"], **how)]

        kind = questions.schema["id"].dataType.simpleString()
        times, found, rows = [], [], asked.collect()
        for row in [*rows[:1], *rows]:
            began = time.perf_counter()
            got = ask(row)
            times.append((row["query_id"], (time.perf_counter() - began) * 1000))
            found.append([(row["query_id"], *x) for x in got])
        ranked = self.spark.createDataFrame([x for part in found[1:] for x in part], f"query_id {kind}, rank int, text string")
        return evaluate.first_relevant(ranked, questions).join(self.spark.createDataFrame(times[1:], f"id {kind}, latency_ms double"), "id", "left")

    def evaluate(self, questions: DataFrame, configs: dict[str, Retrieve | dict] | None = None, ks: tuple[int, ...] = KS, timed: bool = False) -> DataFrame:
        """(config, metric, value) for each configuration of ``results``, e.g. {"dense": {"hybrid": False}}."""
        out = None
        for name, how in (configs or {self.label(): {}}).items():
            part = evaluate.summary(self.results(questions, how, timed), name, ks)
            out = part if out is None else out.unionByName(part)
        return out

    def records(self, questions: DataFrame, configs: dict[str, Retrieve | dict], ks: tuple[int, ...] = KS) -> list[dict]:
        """Timed measures of each configuration with every question's rank and latency, for a JSON report."""
        out = []
        for name, how in configs.items():
            results = self.results(questions, how, timed=True).persist()
            out.append(evaluate.record(results, name, ks))
            results.unpersist()
        return out

    def label(self) -> str:
        """Name of the configuration that the settings give."""
        return ("hybrid" if self.settings.use_hybrid_search else "dense") + ("+rerank" if self.settings.use_reranker else "")

    def health(self) -> DataFrame:
        return sync.health(self.store.read("chunks"), self.store.read("doc_state"))
