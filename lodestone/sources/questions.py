"""Evaluation questions from YAML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "id string, question string, type string, doc string, answerable boolean, sources array<string>"


def load(spark: SparkSession, path: str) -> DataFrame:
    """A list of entries with id, question, answerable, sources, type and doc. An answerable one needs sources."""
    import yaml

    with open(path, encoding="utf-8") as f:
        entries = yaml.safe_load(f) or []
    rows = []
    for e in entries:
        answerable, sources = bool(e.get("answerable", True)), [str(s) for s in e.get("sources") or []]
        if answerable and not sources:
            raise ValueError(f"question {e.get('id')!r} is answerable but has no sources")
        rows.append((str(e["id"]), str(e["question"]), str(e.get("type", "")), e.get("doc"), answerable, sources))
    return spark.createDataFrame(rows, SCHEMA)
