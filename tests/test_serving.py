"""Stored blocks of postings against the plain index, and single questions against the batch plan."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import embed
from lodestone.operators import lexical
from lodestone.plans import config, engine

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choices(words, weights=[1 / (j + 1) for j in range(400)], k=rng.randint(1, 40)))) for i in range(1500)]
    rows += [(1600, "w399 " * 30), (1700, ""), (1800, None)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4).persist()


@pytest.mark.parametrize("block", [16, 1024])
def test_live_blocks_hold_the_best(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(lexical, "BLOCK", block)
    asked = spark.createDataFrame([(1, "w300 w399"), (2, "w0 w1 w0"), (3, "w399"), (4, "none here"), (5, "w5 w77 w280"), (6, "")], "query_id long, text string")
    index = lexical.build(corpus)
    stored = lexical.blocks(index, "doc_id").persist()
    assert stored.agg(F.max(F.size("keys"))).first()[0] <= block
    for k in (1, 5, 30):
        plain, packed = (sorted(map(tuple, lexical.bm25(asked, corpus, k, fill=True, stored=x).collect())) for x in (None, stored))
        assert plain == packed and len(packed) == 6 * k
    if block == 16:
        terms = lexical.asked_terms(asked)
        every = terms.join(stored, "term").select("query_id", "block").distinct().count()
        assert lexical.live(terms, stored, 5).count() < 0.7 * every  # the rest is never opened
    stored.unpersist()


def test_negative_impacts_open_all_blocks(spark):
    docs = spark.createDataFrame([(i, "a b" if i % 2 else "a c") for i in range(6)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a"), (2, "b a")], "query_id long, text string")
    stored = lexical.blocks(lexical.build(docs), "doc_id")
    assert stored.agg(F.min("low")).first()[0] < 0
    assert sorted(map(tuple, lexical.bm25(asked, docs, 4, fill=True).collect())) == sorted(map(tuple, lexical.bm25(asked, docs, 4, fill=True, stored=stored).collect()))


def test_postings_are_made_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    asked = spark.read.parquet(f"{SF}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    found = lexical.bm25(asked, docs, 5)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    scans = [x for x in plan.split("\n") if "FileScan" in x and "documents.parquet" in x]
    assert sum("text" in x.split("Batched")[0] for x in scans) == 1 and plan.count("ReusedExchange") >= 3, scans


@pytest.fixture(scope="module")
def running(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("serving")
    (at / "docs").mkdir()
    rng = random.Random(2)
    for i in range(60):
        (at / "docs" / f"d{i:02}.txt").write_text(" ".join(rng.choices(["pigeon", "home", "python", "snake", "river", "stone"], k=12)) + f" only{i}")
    s = config.Settings(docs_dir=str(at / "docs"), index_dir=f"file://{at}/index", system_prompt_path="Be brief.", embedding_model="hashed", top_k=8, top_n_contexts=3)
    e = engine.Engine(spark, s, embed.hashed(), lambda q, t: F.length(t).cast("double"))
    e.sync()
    return e, at / "docs"


QUESTIONS = ("where is home only7", "only3 only3 only9", "nothing of this", "", "pigeon snake river stone python home", " ".join(f"only{i}" for i in range(260)))


def batch(e, question, **how):
    rows = e.retrieve(e.spark.createDataFrame([("q", question)], "query_id string, question string"), **how).orderBy("rank").collect()
    return [(r["rank"], r["chunk_id"], r["text"], round(r["score"], 9)) for r in rows]


def alone(e, question, **how):
    return [(r["rank"], r["chunk_id"], r["text"], round(r["score"], 9)) for r in e.one.search(question, **how)]


@pytest.mark.parametrize("warm", [False, True])
def test_one_question_is_a_batch_of_one(running, warm):
    e, _ = running
    if warm:
        e.one.warm()
    for question in QUESTIONS:
        assert alone(e, question) == batch(e, question)
    for how in ({"hybrid": False}, {"rerank": True, "keep": 4}, {"keep": 2}):
        assert alone(e, QUESTIONS[0], **how) == batch(e, QUESTIONS[0], **how)
    walks = engine.Engine(e.spark, config.replace(e.settings, vector_backend="graph"), e.embedder, e.scorer)
    assert alone(walks, QUESTIONS[1]) == batch(walks, QUESTIONS[1])
    e.one.cool()


def test_few_jobs_and_a_new_snapshot(running, spark):
    e, docs = running
    e.one.warm()
    e.one.search("pigeon home")
    spark.sparkContext.setJobGroup("one question", "")
    e.one.search("river stone only5")
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("one question"))
    spark.sparkContext.setJobGroup("others", "")
    assert 0 < jobs <= 6, jobs
    before = e.store.current()["snapshot"]
    (docs / "new.txt").write_text("an unheard of word")
    e.sync()
    assert alone(e, "unheard of")[0][1] in {"new.txt#chunk-0", batch(e, "unheard of")[0][1]} and alone(e, "unheard of") == batch(e, "unheard of")
    assert e.one.kept and e.one.name == e.store.current()["snapshot"] != before
    e.sync()
    folders = {p.name for p in (docs.parent / "index").iterdir() if p.name.startswith("v-")}
    assert e.store.current()["snapshot"] in folders and len(folders) == 2 and before not in folders
    e.one.cool()
