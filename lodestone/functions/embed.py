"""Embedders as column functions: any of them maps a text column to array<float> of unit length."""

from __future__ import annotations

import hashlib
import sys
import types
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Embedder = Callable[[Column], Column]


def hashed(dim: int = 32) -> Embedder:
    """Deterministic stand-in for a model: normal numbers seeded by the text's SHA-256, normalised."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            out = []
            for t in rows:
                v = np.random.default_rng(int.from_bytes(hashlib.sha256((t or "").encode()).digest()[:8], "big")).standard_normal(dim)
                out.append((v / np.linalg.norm(v)).astype(np.float32))
            yield pd.Series(out)

    return lambda text: F.pandas_udf(run, "array<float>")(text)


def once(kind: str, name: str, load: Callable[[], object]) -> object:
    """A model of this worker process: loaded for its first task, kept for those that follow, two of a kind at most.

    It is kept in a module of its own, as functions that run on workers bring fresh globals with each task.
    """
    kept = sys.modules.setdefault("_lodestone_models", types.ModuleType("_lodestone_models")).__dict__.setdefault(kind, {})
    if name not in kept:
        while len(kept) >= 2:
            del kept[next(iter(kept))]
        kept[name] = load()
    return kept[name]


def sentence_model(name: str, batch_size: int = 64) -> Embedder:
    """A sentence-transformers model, loaded once a worker; needs that package on the workers."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from sentence_transformers import SentenceTransformer

        model = once("sentence", name, lambda: SentenceTransformer(name))
        for rows in batches:
            yield pd.Series(list(model.encode(rows.fillna("").tolist(), batch_size=batch_size, normalize_embeddings=True).astype(np.float32)))

    return lambda text: F.pandas_udf(run, "array<float>")(text)


def cross_encoder(name: str) -> Callable[[Column, Column], Column]:
    """A cross-encoder's score of (query, text) for ``fusion.rerank``; nulls are read as empty."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        from sentence_transformers import CrossEncoder

        model = once("cross", name, lambda: CrossEncoder(name))
        for query, text in batches:
            yield pd.Series(model.predict(list(zip(query.fillna(""), text.fillna(""), strict=True))).astype(float))

    return lambda query, text: F.pandas_udf(run, "double")(query, text)


def by_content(pieces: DataFrame, known: DataFrame, embedder: Embedder) -> DataFrame:
    """``pieces`` (with text) and ``embedding``: what ``known`` (chunk_ord, text, embedding) holds of equal texts, a new vector for each other text.

    Texts meet by their SHA-256. A text is embedded once however often it stands in ``pieces``, and on the side of
    the vectors it is one row, so a text that many chunks share is left to AQE's split of the other side. Texts of
    like length share a batch, which spares a model its padding. A null text is a text of its own.
    """
    content = F.coalesce(F.sha2("text", 256), F.lit(""))
    asked = pieces.select(content.alias("content"), "text").dropDuplicates(["content"])
    held = known.select(content.alias("content"), "chunk_ord", "embedding").join(asked.select("content"), "content", "left_semi")
    held = held.groupBy("content").agg(F.min_by("embedding", "chunk_ord").alias("embedding"))
    new = asked.join(held.select("content"), "content", "left_anti").sortWithinPartitions(F.length("text"))
    vectors = held.unionByName(new.select("content", embedder(F.col("text")).alias("embedding")))
    return pieces.withColumn("content", content).join(vectors, "content").drop("content")
