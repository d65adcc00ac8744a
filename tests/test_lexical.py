"""The index of one call: what crosses the network, repeated keys, filling."""

import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from lodestone.operators import lexical
from lodestone.plans import catalogue

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_postings_are_not_shuffled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    asked = catalogue.asked(spark, SF)
    assert "Exchange" not in plan_of(lexical.postings(docs))
    plan = plan_of(lexical.bm25(asked, docs, 5))
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert dealt and not any("dl#" in x or "term#" in x and "doc_id#" in x for x in dealt)
    assert not any("query_id" in x and "doc_id" in x for x in dealt)  # scores are summed where the chunk lies


def test_repeated_keys_are_one_document(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b c"), (2, "a"), (None, "a c"), (None, "c"), (3, ""), (4, None)], "doc_id long, text string")
    got = Counter(tuple(r) for r in lexical.postings(docs).select("term", "doc_id", "dl", "tf").collect())
    assert got == Counter([("a", 1, 5, 2), ("b", 1, 5, 2), ("c", 1, 5, 1), ("a", 2, 1, 1), ("a", None, 3, 1), ("c", None, 3, 2)])
    assert {r.term: r.df for r in lexical.build(docs).terms.collect()} == {"a": 3, "b": 1, "c": 2}


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_scores_with_and_without_broadcast(spark, monkeypatch, broadcast):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(map(tuple, lexical.bm25(catalogue.asked(spark, SF), docs, 5).collect()))
    monkeypatch.setattr(lexical, "BROADCAST", broadcast)
    assert sorted(map(tuple, lexical.bm25(catalogue.asked(spark, SF), docs, 5).collect())) == want


def test_fill_scores_once(spark):
    """Where no query is short of positive scores the result is the held one: its plan scores nothing again."""
    docs = spark.createDataFrame([(i, f"a b{i}") for i in range(30)] + [(i, "c") for i in range(30, 90)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "b3 b4 b5")], "query_id long, text string")
    held = lexical.bm25(asked, docs, 3, fill=True)
    assert "Aggregate" not in held._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.doc_id, r["rank"]) for r in held.orderBy("rank").collect()] == [(3, 1), (4, 2), (5, 3)]
    more = lexical.bm25(asked, docs, 5, fill=True).orderBy("rank").collect()
    assert [r.doc_id for r in more] == [3, 4, 5, 0, 1] and [r.score for r in more[3:]] == [0.0, 0.0]


@pytest.mark.parametrize("name", ["rerank_topn", "rag_prompt", "first_relevant_rank"])
def test_texts_stay_in_place(spark, name):
    """Documents found go to the texts: no exchange lies over a scan of whole texts by document."""
    plan = plan_of(entry.queries()[name](spark, SF))
    assert "SortMergeJoin [doc_id" not in plan and not any("Exchange hashpartitioning(doc_id" in x and "REPARTITION_BY_COL" not in x for x in plan.split("\n"))
