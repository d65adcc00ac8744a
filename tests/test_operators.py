import importlib.util
import io
import json
import logging
import random
import re
import sys
import threading
import time
import types
import zipfile
from urllib import error, request

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import embed
from lodestone.functions import text as X
from lodestone.operators import chunking, dense, evaluate, fusion, graph, lexical, sync
from lodestone.plans import cli, config, engine, llm_client, logs, service
from lodestone.sources import files, questions


def by_definition(pieces, size, overlap):
    out, cur = [], []
    for p in pieces:
        if cur and len(" ".join([*cur, p])) > size:
            out.append(cur)
            keep = 0
            while keep < len(cur) and len(" ".join(cur[len(cur) - keep - 1 :])) <= overlap:
                keep += 1
            cur = cur[len(cur) - keep :]
        cur = [*cur, p]
    return [" ".join(c) for c in [*out, *([cur] if cur else [])]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=30), max_size=25), st.integers(1, 60), st.data())
def test_pack(pieces, size, data):
    overlap = data.draw(st.integers(0, size - 1))
    pieces = [p[:size] for p in pieces]
    assert chunking.pack(pieces, size, overlap) == by_definition(pieces, size, overlap)
    assert all(len(c) <= overlap + 1 + size for c in chunking.pack(pieces, size, overlap))


def test_chunks(spark):
    texts = ["", "   \n", None, "Hello.", "x" * 500, " ".join(f"Sentence number {i}." for i in range(100))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_name long, text string")
    got = chunking.chunks(docs, 100, 10).orderBy("doc_name", "chunk_no").collect()
    assert [r.text for r in got if r.doc_name == 3] == ["Hello."]
    assert [len(r.text) for r in got if r.doc_name == 4] == [100, 100, 100, 100, 100, 50]
    assert not [r for r in got if r.doc_name in (0, 1, 2)]
    assert got[0].chunk_id == "3#chunk-0"
    for bad in ((0, 0), (10, -1), (10, 10)):
        with pytest.raises(ValueError):
            chunking.chunks(docs, *bad)


def test_text_functions(spark):
    df = spark.createDataFrame([("One. Two!  Three?\nfour",), (" \n",), ("Ünï_x 3",)], "t string")
    rows = df.select(X.split_sentences(F.col("t")).alias("s"), X.tokenize(F.col("t")).alias("k"), X.normalize(F.col("t")).alias("n")).collect()
    assert rows[0].s == ["One.", "Two!", "Three?", "four"] and rows[1].s == [] and rows[1].n == ""
    assert rows[2].k == ["ünï_x", "3"]
    lines = ['data: {"choices":[{"delta":{"content":"a"}}]}', "", "data: {bad", 'data: {"choices":[]}', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"late"}}]}']
    assert list(llm_client.deltas([lines[0], lines[1], "event: x", lines[4], lines[5]])) == ["a"]
    for bad in ("data: {bad", 'data: {"choices":[]}', "data: 3", 'data: {"choices":[{"delta":null}]}'):
        with pytest.raises(llm_client.LLMError):
            list(llm_client.deltas([lines[0], bad]))
    got = spark.createDataFrame([(x,) for x in lines], "l string").select(X.sse_delta(F.col("l")).alias("d")).collect()
    assert [r.d for r in got] == ["a", None, None, None, None, "late"]


def test_bm25_fill_with_negative_scores(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["cat sat", "cat", "dog", "cat bird", ""])], "doc_id long, text string")
    q = spark.createDataFrame([(1, "dog"), (2, "zebra")], "query_id long, text string")
    got = lexical.bm25(q, docs, 3, fill=True).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in got] == [(1, 2), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2)]


def test_dense(spark):
    rows = [(i, [float(i == j) for j in range(4)]) for i in range(4)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = v.withColumnRenamed("vec_id", "query_id")
    want = [(i, 1, i) for i in range(4)]
    for found in (dense.exact(q, v, 1), dense.exact_columns(q, v, 1), dense.search(q, v, 1, "auto"), dense.cells(q, v, 1, share=1.0), dense.search(q, v, 1, dense.exact)):
        assert sorted((r.query_id, r["rank"], r.vec_id) for r in found.collect()) == want
    assert dense.exact(q, v, 0).count() == 0 and dense.exact(q.limit(0), v, 3).count() == 0
    assert dense.choose(50_000) == "graph" and dense.choose(10) == "exact"
    with pytest.raises(ValueError):
        dense.choose(1, "other")


def test_exact_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(dense, "SCORES", 50)
    monkeypatch.setattr(dense, "BLOCK_QUERIES", 7)
    rng = np.random.default_rng(1)
    v = rng.integers(-2, 3, (300, 4)).astype(np.float32)  # many ties
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(300, None)], "vec_id long, embedding array<float>")
    queries = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(v[:20])], "query_id string, embedding array<float>")
    want = {(f"q{i}", r + 1, int(j)) for i in range(20) for r, j in enumerate(np.lexsort((np.arange(300), -(v @ v[i])))[:9])}
    assert {(r.query_id, r["rank"], r.vec_id) for r in dense.exact(queries, vectors, 9).collect()} == want
    with pytest.raises(Exception, match="must all have 4 numbers"):
        dense.exact(queries, vectors.union(spark.createDataFrame([(301, [1.0])], vectors.schema)), 9).collect()


def test_cells_prune_and_find(spark):
    rng = np.random.default_rng(2)
    middle = rng.standard_normal((40, 32))
    v = middle[rng.integers(0, 40, 4000)] + 0.3 * rng.standard_normal((4000, 32))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    vectors = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    queries = vectors.where("vec_id < 50").withColumnRenamed("vec_id", "query_id")
    centres = dense.fit_cells(vectors, 4000)
    near = dense.probed(v[:50].astype(float), centres, 0.1)
    own = (v @ centres.T).argmax(1)
    assert np.mean([near[i, own].mean() for i in range(50)]) < 0.2  # share of the vectors that is scored
    found = dense.cells(queries, vectors, 10, share=0.1)
    assert dense.recall(found, dense.exact(queries, vectors, 10)).agg(F.avg("recall")).first()[0] >= 0.9
    assert dense.cells(queries, vectors.limit(0), 10).count() == 0


@pytest.mark.parametrize("kind", ["int", "smallint", "long", "string"])
def test_query_ids_keep_their_type(spark, kind):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, [-1.0, 0.0])], "query_id int, embedding array<double>").withColumn("query_id", F.col("query_id").cast(kind))
    for got in (dense.exact(asked, vectors, 2), graph.search(asked, *graph.build(vectors), 2)):
        assert got.schema["query_id"].dataType == asked.schema["query_id"].dataType
        assert sorted((str(r.query_id), r.rank, r.vec_id) for r in got.collect()) == [("7", 1, 3), ("7", 2, 2), ("8", 1, 0), ("8", 2, 1)]


def test_fusion_and_rerank(spark):
    a = spark.createDataFrame([("q", 1, 10), ("q", 2, 20)], "query_id string, rank int, doc_id long")
    b = spark.createDataFrame([("q", 1, 20), ("q", 2, 10), ("q", 3, 30)], "query_id string, rank int, doc_id long")
    got = fusion.fuse(a, b, 5).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [10, 20, 30] and got[0].score == 1 / 61 + 1 / 62
    c = spark.createDataFrame([("q", i, "x", t, 0.5) for i, t in ((1, "a"), (2, "ccc"), (3, "bb"))], "query_id string, rank int, query string, text string, score double")
    best = fusion.rerank(c, lambda q, t: F.length(t).cast("double"), 2).orderBy("rank").collect()
    assert [r.text for r in best] == ["ccc", "bb"]


def test_metrics(spark):
    r = spark.createDataFrame([("1", True, 1), ("2", True, 3), ("3", True, None), ("4", False, None)], "id string, answerable boolean, rank int")
    assert [tuple(x) for x in evaluate.recall_at(r, (1, 3)).collect()] == [(1, 0.3333), (3, 0.6667)]
    assert evaluate.mrr(r).first()[0] == round((1 + 1 / 3) / 3, 4)
    assert evaluate.mrr(r.limit(0)).first()[0] == 0.0
    assert {x.metric: x.value for x in evaluate.summary(r, "c", (1, 3)).collect()} == {"recall@1": 0.3333, "recall@3": 0.6667, "mrr": 0.4444, "num_answerable": 3.0, "num_unanswerable": 1.0}
    timed = r.withColumn("latency_ms", F.col("id").cast("double"))
    got = evaluate.record(timed, "c", (1,))
    assert (got["latency_p50_ms"], got["latency_p95_ms"], got["per_question"][1]) == (2.5, 3.85, {"id": "2", "rank": 3, "latency_ms": 2.0})
    assert all(x.value == 0 for x in evaluate.summary(timed.limit(0), "c").collect())
    v = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "x double")
    assert tuple(evaluate.percentiles(v, "x", 50, 100).first()) == (2.5, 4.0)
    assert tuple(evaluate.percentiles(v.limit(0), "x", 50).first()) == (0.0,)


def test_html_and_files(spark, tmp_path):
    assert files.html_text("<p>a &amp; <b>b</b><script>x()</script><style>s</style> c</p>") == "a &\nb\nc"
    (tmp_path / "a.TXT").write_bytes(b"one\r\ntwo\xff")
    (tmp_path / "b.html").write_text("<h1>T</h1>body")
    (tmp_path / "README.md").write_text("no")
    (tmp_path / "c.xyz").write_text("no")
    (tmp_path / "d.pdf").write_bytes(b"broken")
    rows = {r.doc_name: r for r in files.extract(files.load(spark, str(tmp_path))).collect()}
    assert set(rows) == {"a.TXT", "b.html", "d.pdf"}
    assert rows["a.TXT"].text == "one\ntwo�" and rows["b.html"].text == "T\nbody" and rows["d.pdf"].error
    y = tmp_path / "q.yaml"
    y.write_text("- {id: q1, question: what, answerable: true, sources: [a]}\n- {id: q2, question: x, answerable: false}\n")
    assert questions.load(spark, str(y)).count() == 2
    y.write_text("- {id: q1, question: what, answerable: true}\n")
    with pytest.raises(ValueError):
        questions.load(spark, str(y))


def word_file(paragraphs, table):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

    def p(text, style):
        return "<w:p>" + (f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else "") + f"<w:r><w:t>{text}</w:t></w:r></w:p>"

    body = "".join(p(*x) for x in paragraphs) + "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c, None)}</w:tc>" for c in row) + "</w:tr>" for row in table) + "</w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles xmlns:w="{w}"><w:style w:styleId="T1"><w:name w:val="heading 2"/></w:style><w:style w:styleId="Titre3"><w:name w:val="own"/></w:style><w:style w:styleId="big"><w:name w:val="Title"/></w:style></w:styles>')
    return out.getvalue()


def test_word_files():
    data = word_file([("Top", "big"), ("Part", "T1"), ("Own name", "Titre3"), ("Body", None), ("  ", None), ("Other", "missing")], [["a", "b  c"], ["", ""], ["", "d"]])
    assert files.docx(data) == "# Top\n\n## Part\n\n### Own name\n\nBody\n\nOther\n\n| a | b c |\n|  | d |"
    assert files.heading_level("Heading 9") == 6 and files.heading_level("Überschrift 1") == 1 and files.heading_level("Normal") == 0


def test_merged_word_cells_are_told_in_each_place():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

    def cell(text, span=1, merge=None):
        props = (f'<w:gridSpan w:val="{span}"/>' if span > 1 else "") + {None: "", "start": '<w:vMerge w:val="restart"/>', "on": "<w:vMerge/>"}[merge]
        return f"<w:tc><w:tcPr>{props}</w:tcPr><w:p><w:r><w:t>{text}</w:t></w:r></w:p></w:tc>"

    rows = [[cell("wide", 2), cell("c")], [cell("tall", 1, "start"), cell("x"), cell("y")], [cell("", 1, "on"), cell("z"), cell("", 1, "on")], [cell("end"), cell(""), cell("e")]]
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:tbl>' + "".join(f"<w:tr>{''.join(r)}</w:tr>" for r in rows) + "</w:tbl></w:body></w:document>")
    assert files.docx(out.getvalue()) == "| wide | wide | c |\n| tall | x | y |\n| tall | z | y |\n| end |  | e |"


class FakePage:
    def get_text(self, kind):
        return "page text"

    def get_images(self, full):
        return [(1,), (2,), (3,)]


class FakeBook:
    def __enter__(self):
        return iter_book(self)

    def __exit__(self, *error):
        return False


def iter_book(book):
    class Pages(list):
        def extract_image(self, reference):
            if reference == 2:
                raise RuntimeError("no such picture")
            return {"image": b"picture %d" % reference}

    return Pages([FakePage()])


def test_a_bad_picture_loses_only_itself(monkeypatch):
    """Stand-ins for the packages: a picture that cannot be taken out leaves the page and the other pictures."""
    picture = types.SimpleNamespace(size=(2, 2), convert=lambda mode: picture, resize=lambda size: picture, point=lambda f, mode: picture)
    monkeypatch.setitem(sys.modules, "fitz", types.SimpleNamespace(open=lambda **kw: FakeBook()))
    monkeypatch.setitem(sys.modules, "pytesseract", types.SimpleNamespace(image_to_string=lambda image, config: " seen "))
    monkeypatch.setitem(sys.modules, "PIL", types.SimpleNamespace(Image=types.SimpleNamespace(open=lambda data: picture)))
    monkeypatch.setattr(files.importlib.util, "find_spec", lambda name: True)
    assert files.pdf_with_figures(b"") == "page text\n[Figure p.1] seen\n[Figure p.1] seen"


def test_excel_files():
    openpyxl = pytest.importorskip("openpyxl")
    book, out = openpyxl.Workbook(), io.BytesIO()
    book.active.title = "S"
    for row in (["a", 1], [None, None], [" b ", 2.5]):
        book.active.append(row)
    book.create_sheet("empty")
    book.save(out)
    assert files.xlsx(out.getvalue()) == "## S\n\n| a | 1 |\n| b | 2.5 |"


def test_pdf_files():
    fitz = pytest.importorskip("fitz")
    book = fitz.open()
    book.new_page().insert_text((72, 72), "Hello page")
    assert "Hello page" in files.pdf(book.tobytes()) and "Hello page" in files.pdf_with_figures(book.tobytes())


def test_figures_without_packages_are_left_out(monkeypatch):
    monkeypatch.setattr(files.importlib.util, "find_spec", lambda name: None)
    monkeypatch.setattr(files, "pdf", lambda data: "text")
    assert files.pdf_with_figures(b"") == "text"


def test_models_are_kept_by_worker():
    loads = []
    for name in "aabac":
        embed.once("test", name, lambda name=name: loads.append(name))
    assert loads == ["a", "b", "c"]


FAKE_MODELS = """
import numpy as np

class SentenceTransformer:
    def __init__(self, name):
        assert name == "some/e5-model"

    def encode(self, texts, batch_size, normalize_embeddings):
        assert batch_size == 2 and normalize_embeddings and all(isinstance(t, str) for t in texts)
        v = np.array([[1 + t.count(c) for c in "aeiou"] for t in texts], float).reshape(-1, 5)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

class CrossEncoder:
    def __init__(self, name):
        assert name == "some/reranker"

    def predict(self, pairs):
        return np.array([len(set(q.split()) & set(t.split())) for q, t in pairs], np.float32)
"""


def test_models_run_on_workers(spark, tmp_path):
    """Embedder and reranker through Spark, with a package of the same interface in place of the real one."""
    if importlib.util.find_spec("sentence_transformers"):
        pytest.skip("the real package is here")
    (tmp_path / "sentence_transformers.py").write_text(FAKE_MODELS)
    spark.sparkContext.addPyFile(str(tmp_path / "sentence_transformers.py"))
    texts = spark.createDataFrame([(1, "a banana"), (2, "queue"), (3, None), (4, "")], "id long, text string")
    model = embed.sentence_model("some/e5-model", batch_size=2)
    rows = {r.id: r for r in texts.select("id", model(X.with_prefix(F.col("text"), "some/e5-model", X.PASSAGE_PREFIX)).alias("v"), model(F.col("text")).alias("bare")).collect()}
    for r in rows.values():
        assert len(r.v) == 5 and np.linalg.norm(r.v) == pytest.approx(1, abs=1e-6)
    want = np.array([1 + "passage: queue".count(c) for c in "aeiou"], float)
    assert rows[2].v == pytest.approx(want / np.linalg.norm(want), abs=1e-6)
    assert rows[3].bare == rows[4].bare == pytest.approx([5**-0.5] * 5, abs=1e-6) and rows[1].bare != rows[1].v
    pairs = spark.createDataFrame([("q one two", "one two three", 2.0), ("q one two", "two", 1.0), (None, "two", 0.0), ("q", None, 0.0)], "query string, text string, want double")
    got = pairs.withColumn("score", embed.cross_encoder("some/reranker")(F.col("query"), F.col("text"))).collect()
    assert [r.score for r in got] == [r.want for r in got]


def test_log_sink(tmp_path):
    log = logs.start(config.Settings(log_dir=str(tmp_path / "l"), log_level="info"))
    log.debug("no")
    logging.getLogger("lodestone.plans.engine").info("yes")
    assert "yes" in (tmp_path / "l" / "lodestone.log").read_text() and "no\n" not in (tmp_path / "l" / "lodestone.log").read_text()
    assert len(logs.start(config.Settings(log_dir=str(tmp_path / "l"))).handlers) == 2


def test_default_files(tmp_path, monkeypatch):
    monkeypatch.chdir(tmp_path)
    for name in ("TOP_K", "LLM_MODEL", "LLM_API_KEY"):
        monkeypatch.delenv(name, raising=False)
    assert config.load().top_k == 20
    (tmp_path / "config.yaml").write_text("top_k: 9\nfaiss_min_chunks: 5\nvector_backend: numpy\n")
    (tmp_path / ".env").write_text("# own\nexport LLM_MODEL='m x'\nLLM_API_KEY=k # note\nTOP_K=11\n")
    monkeypatch.setenv("TOP_K", "12")
    s = config.load()
    assert (s.top_k, s.llm_model, s.llm_api_key, s.approximate_min_chunks, s.vector_backend) == (12, "m x", "k", 5, "exact")
    (tmp_path / "config.yaml").write_text("[1]")
    with pytest.raises(ValueError):
        config.load()


def test_settings(tmp_path):
    f = tmp_path / "c.yaml"
    f.write_text("top_k: 7\ntop_n_contexts: 3\n")
    s = config.load(str(f), {"TOP_K": "9", "USE_RERANKER": "Yes"})
    assert (s.top_k, s.use_reranker, s.top_n_contexts) == (9, True, 3)
    for text in ("nope: 1", "top_k: many", "top_k: 0", "vector_backend: x"):
        f.write_text(text)
        with pytest.raises(ValueError):
            config.load(str(f), {})


@pytest.fixture
def running(spark, tmp_path):
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "pigeons.txt").write_text("Pigeons find their way home.")
    (docs / "python.md").write_text("Python is a language.")
    s = config.Settings(docs_dir=str(docs), index_dir=f"file://{tmp_path}/index", system_prompt_path="Be brief.", embedding_model="hashed", top_k=5, top_n_contexts=2)
    return engine.Engine(spark, s, embed.hashed(), lambda q, t: F.length(t).cast("double")), docs


def test_lifecycle(running, spark):
    e, docs = running
    acts = lambda: {r.doc_name: r.action for r in e.sync().collect()}
    assert acts() == {"pigeons.txt": "added", "python.md": "added"}
    assert acts() == {"pigeons.txt": "unchanged", "python.md": "unchanged"}
    (docs / "pigeons.txt").write_text("Pigeons fly.")
    (docs / "python.md").unlink()
    (docs / "new.txt").write_text("New.")
    assert acts() == {"pigeons.txt": "updated", "python.md": "removed", "new.txt": "added"}
    assert tuple(e.health().first()) == (2, 2)
    q = spark.createDataFrame([("1", "where do pigeons fly")], "query_id string, question string")
    assert "pigeons.txt#chunk-0" in [r.chunk_id for r in e.retrieve(q, rerank=True).collect()]
    p = e.prompts(q).first()
    assert "Context 1:\n" in p.prompt and p.prompt.endswith("Question: where do pigeons fly")
    asked = spark.createDataFrame([("1", "pigeons", "", None, True, ["Pigeons fly."])], questions.SCHEMA)
    rows = {(r.config, r.metric): r.value for r in e.evaluate(asked, {"dense": {"hybrid": False}, "hybrid": {}}).collect()}
    own = e.evaluate(asked, {"own": lambda qs: qs.select("query_id", F.lit(3).alias("rank"), F.lit("pigeons  FLY. yes").alias("text"))}, timed=True)
    got = {r.metric: r.value for r in own.collect()}
    assert got["mrr"] == 0.3333 and got["latency_p50_ms"] > 0 and got["latency_p95_ms"] >= got["latency_p50_ms"]
    assert rows[("hybrid", "recall@5")] == 1.0 and rows[("dense", "num_answerable")] == 1.0


def test_no_change_writes_nothing(running, spark):
    e, docs = running
    e.sync()
    before = e.store.current()
    assert [tuple(r) for r in e.sync(lazy=True).orderBy("doc_name").collect()] == [("pigeons.txt", "unchanged", None), ("python.md", "unchanged", None)]
    assert e.store.current() == before
    graphs = engine.Engine(spark, config.replace(e.settings, vector_backend="graph"), e.embedder, e.scorer)
    graphs.sync(lazy=True)  # the settings now ask for what this snapshot lacks
    assert (after := graphs.store.current())["graph"] and after != before
    graphs.sync(lazy=True)
    assert graphs.store.current() == after
    for f in docs.iterdir():
        f.unlink()
    assert {r.action for r in graphs.sync(lazy=True).collect()} == {"removed"} and not graphs.store.read("chunks").count()
    last = graphs.store.current()
    assert graphs.sync(lazy=True).count() == 0 and graphs.store.current() == last


def counting(counter):
    """The stand-in embedder, telling ``counter`` of every text."""
    plain = embed.hashed()

    def count(texts):
        counter.add(len(texts))
        return texts

    return lambda text: plain(F.pandas_udf(count, "string")(text))


def test_a_moved_paragraph_is_not_embedded_again(running, spark):
    e, docs = running
    seen = spark.sparkContext.accumulator(0)
    e = engine.Engine(spark, config.replace(e.settings, chunk_size_chars=40, chunk_overlap_chars=0), counting(seen), e.scorer)
    parts = [f"Paragraph number {i:02d} of this document." for i in range(8)]
    (docs / "long.txt").write_text(" ".join(parts))
    (docs / "copy.txt").write_text(parts[3])
    e.sync()
    assert seen.value == 10  # eight paragraphs once, two other documents
    (docs / "long.txt").write_text(" ".join([*parts[4:], *parts[:4], "A paragraph that is quite new here."]))
    e.sync()
    assert seen.value == 11 and e.store.read("chunks").where("doc_name = 'long.txt'").count() == 9
    plain = embed.hashed()
    wrong = e.store.read("chunks").where(F.col("embedding") != plain(X.with_prefix(F.col("text"), "hashed", X.PASSAGE_PREFIX)))
    assert wrong.count() == 0
    e.sync(full=True)
    assert seen.value == 22  # a rebuild trusts no stored vector


def test_vectors_by_content_of_odd_tables(spark):
    pieces = spark.createDataFrame([(0, "a"), (1, None), (2, "a"), (3, ""), (4, None), (5, "b")], "id int, text string")
    known = spark.createDataFrame([(7, "a", [7.0]), (3, "a", [3.0]), (9, "z", [9.0]), (1, None, [1.0])], "chunk_ord long, text string, embedding array<float>")
    made = lambda t: F.array(F.length(F.coalesce(t, F.lit("null"))).cast("float"))
    got = {r.id: r.embedding for r in embed.by_content(pieces, known, made).collect()}
    assert got == {0: [3.0], 1: [1.0], 2: [3.0], 3: [0.0], 4: [1.0], 5: [1.0]}
    assert embed.by_content(pieces.limit(0), known, made).count() == 0
    assert embed.by_content(pieces, known.limit(0), made).count() == 6


def test_stored_index_serves_as_a_new_one(running, spark):
    e, docs = running
    for i in range(30):
        (docs / f"d{i}.txt").write_text(f"word{i} common pigeons " + "other " * (i % 4))
    e.sync()
    chunks = e.store.read("chunks").select("chunk_ord", "text")
    q = spark.createDataFrame([("1", "common word7 other"), ("2", "pigeons word3 word3"), ("3", "none")], "query_id string, text string")
    both = [sorted(map(tuple, lexical.bm25(q, chunks, 8, "chunk_ord", fill=True, stored=i).collect())) for i in (None, e.store.read("blocks"))]
    assert both[0] == both[1] and len(both[0]) == 24
    dealt = engine.Engine(spark, config.replace(e.settings, vector_backend="graph"), e.embedder, e.scorer)
    dealt.sync(full=True)
    shards, centres = dealt.store.graph()
    assert [r["n"] for r in shards.select("n").collect()] == [32] and len(centres) == 1 and dealt.retrieve(q.withColumnRenamed("text", "question")).count() == 15
    seen = []
    own = engine.Engine(spark, e.settings, e.embedder, e.scorer, lambda qs, vs, k: seen.append(k) or dense.exact(qs, vs, k))
    assert own.retrieve(q.withColumnRenamed("text", "question"), hybrid=False).count() == 15 and seen == [5]
    with pytest.raises(ValueError):
        e.store.publish(e.store.read("chunks"), e.store.read("doc_state").limit(0), "hashed")


def test_commands(running, tmp_path, capsys, monkeypatch):
    e, docs = running
    e.client = lambda: type("C", (), {"chat": lambda self, a, b: f"read {len(b)}", "stream": lambda self, a, b: iter(["ho", "me"])})()
    run = lambda *a: cli.main(list(a), e)
    assert run("qa") == 1 and run("eval", "--questions", "none.yaml") == 1
    assert run("index") == 0 and "added: 2" in capsys.readouterr().out
    assert run("update") == 0 and "unchanged: 2" in capsys.readouterr().out
    monkeypatch.setattr("sys.stdin", io.StringIO("where?\nquit\n"))
    assert run("qa") == 0 and "home" in capsys.readouterr().out
    assert run("analyze", str(docs / "python.md")) == 0 and "read 21" in capsys.readouterr().out
    (tmp_path / "q.yaml").write_text("- {id: q1, question: where do pigeons go, answerable: true, sources: [their way]}\n- {id: q2, question: x, answerable: false}\n")
    assert run("eval", "--questions", str(tmp_path / "q.yaml"), "--json", str(tmp_path / "out.json"), "--k", "1,5", "--chunk-sizes", "500") == 0
    out = json.loads((tmp_path / "out.json").read_text())
    assert out["corpus_chunks"] == 2 and out["ks"] == [1, 5] and [c["config"] for c in out["configs"]] == ["hybrid", "hybrid chunk=500"]
    first = out["configs"][0]
    assert first["recall_at_k"]["5"] == 1.0 and first["num_unanswerable"] == 1 and first["latency_p95_ms"] > 0
    assert [x["id"] for x in first["per_question"]] == ["q1", "q2"] and first["per_question"][1]["rank"] is None
    assert "latency p50 (ms)" in capsys.readouterr().out
    assert cli.main(["--config", str(tmp_path / "bad.yaml"), "update"], None) == 2 if (tmp_path / "bad.yaml").write_text("nope: 1") else False


def test_starts_are_running_sums(spark, monkeypatch):
    monkeypatch.setattr(sync, "SAMPLE", 20)
    monkeypatch.setattr(sync, "SPLITS", 5)
    rows = [(f"d{i * 7919 % 503:03}", i % 4 + 1) for i in range(503)]
    want, total = {}, 0
    for name, c in sorted(rows):
        want[name], total = total, total + c
    assert {r.doc_name: r.start for r in sync.starts(spark.createDataFrame(rows, "doc_name string, c long")).collect()} == want
    assert sync.starts(spark.createDataFrame([], "doc_name string, c long")).count() == 0


def test_containing_in_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(1, "Cat  sat"), (2, "dog"), (3, None), (4, "at")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "the cat\nSAT down"), (2, "dogma"), (3, None)], "doc_id long, text string")
    want = [(1, 1), (2, 2), (4, 1)]
    for size in (1 << 20, 3):
        monkeypatch.setattr(evaluate, "BLOCK_BYTES", size)
        assert sorted(map(tuple, evaluate.containing(items, docs, "item_id", "doc_id").collect())) == want


def test_containing_against_brute_force(spark, monkeypatch):
    """Items of one to forty words cut from documents at any character, shared phrases, repeated rows, nulls and odd white space."""
    rng = random.Random(5)
    words = ["a", "ab", "the", "cat", "Sat", "mat", "größe", "x.y"]
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(120)] + [(200, None), (201, ""), (202, " \t\n "), (None, "the cat sat on the mat again and again"), (203, "the\tcat\n sat on  THE mat again")]
    docs += docs[:3] + [(204, "tail " + "cat sat the mat ab " * 4000 + "at the very end of it")]
    items = [(900, None), (901, ""), (902, "the cat sat on the mat"), (None, "at sat on the mat ag"), (903, "no such words stand in any document"), (904, "at the very end of it"), (904, "at the very end of it")]
    for i in range(80):
        text = rng.choice([t for _, t in docs[:120] if t])
        a = rng.randrange(len(text))
        items.append((i, text[a : a + rng.randint(1, 160)]))
    flat = lambda t: " ".join(t.split()).lower()
    want = sorted(((i, d) for i, g in items if g is not None for d, t in docs if t is not None and flat(g) in flat(t)), key=str)
    assert len(want) > 500
    ours, theirs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("g", "n", "h", "gram", "item", "doc")})
    for size in (1 << 20, 700):
        monkeypatch.setattr(evaluate, "BLOCK_BYTES", size)
        got = evaluate.containing(ours, theirs, "item_id", "doc_id")
        assert got.columns == ["item_id", "doc_id"]
        assert sorted(map(tuple, got.collect()), key=str) == want
    assert evaluate.containing(ours.limit(0), theirs, "item_id", "doc_id").count() == 0
    assert evaluate.containing(ours, theirs.limit(0), "item_id", "doc_id").count() == 0


def test_containing_compares_only_items_whose_anchor_is_held(spark):
    """Texts are compared after the look-up: of 400 items that share most of their words each document meets its own."""
    items = spark.range(400).select(F.col("id").alias("item_id"), F.concat(F.lit("all of these items begin alike but end with number "), F.col("id"), F.lit(" and so on")).alias("text"))
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("some words "), "text", F.lit(" some more")).alias("text"))
    got = evaluate.containing(items, docs, "item_id", "doc_id")
    assert sorted(map(tuple, got.collect())) == [(i, i) for i in range(400)]
    own = items.select(F.col("item_id").alias("item"), X.normalize(F.col("text")).alias("g")).withColumn("h", F.xxhash64("g"))
    assert evaluate.anchors(own, "item").select("gram").distinct().count() == 400
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_chat_client_errors(tmp_path):
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class H(BaseHTTPRequestHandler):
        def log_message(self, *a):
            pass

        def do_POST(self):
            n = int(self.headers["Content-Length"])
            body = json.loads(self.rfile.read(n))
            user = body["messages"][1]["content"]
            self.send_response(500 if user == "500" else 200)
            self.end_headers()
            if body["stream"]:
                self.wfile.write(b'data: {"choices":[{"delta":{"content":"a"}}]}\n\n' + (b"data: [DONE]\n\n" if user == "ok" else b"data: {\n\n"))
            else:
                self.wfile.write(b'{"choices":[{"message":{"content":"hi"}}]}' if user == "ok" else b"[]")

    server = ThreadingHTTPServer(("127.0.0.1", 0), H)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = llm_client.ChatClient(config.Settings(llm_base_url=f"http://127.0.0.1:{server.server_port}"))
    assert client.chat("s", "ok") == "hi" and list(client.stream("s", "ok")) == ["a"]
    for user in ("500", "other"):
        with pytest.raises(llm_client.LLMError):
            client.chat("s", user)
        with pytest.raises(llm_client.LLMError):
            list(client.stream("s", user))
    server.shutdown()
    server.server_close()
    with pytest.raises(llm_client.LLMError):
        client.chat("s", "ok")

    def breaks():
        yield b'data: {"choices":[{"delta":{"content":"a"}}]}'
        raise ConnectionResetError

    with pytest.raises(llm_client.LLMError):
        list(llm_client.arriving(breaks()))


def test_service(running):
    e, docs = running
    e.sync()
    e.client = lambda: type("C", (), {"chat": lambda self, a, b: "home", "stream": lambda self, a, b: iter(["ho", "me"])})()
    from http.server import ThreadingHTTPServer

    server = ThreadingHTTPServer(("127.0.0.1", 0), service.handler(e))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"

    def post(path, body):
        return request.urlopen(request.Request(url + path, json.dumps(body).encode())).read().decode()

    assert json.loads(request.urlopen(url + "/health").read())["documents"] == 2
    assert json.loads(post("/ask", {"question": "pigeons?"}))["answer"] == "home"
    kinds = [json.loads(x[6:])["type"] for x in post("/ask/stream", {"question": "pigeons?"}).split("\n\n") if x.startswith("data: {")]
    assert kinds == ["contexts", "delta", "delta"]
    assert json.loads(post("/reindex", {}))["unchanged"] == ["pigeons.txt", "python.md"]
    with pytest.raises(error.HTTPError) as bad:
        post("/ask", {"question": ""})
    assert bad.value.code == 422
    for p in docs.iterdir():
        p.unlink()
    docs.rmdir()
    with pytest.raises(error.HTTPError) as bad:
        post("/reindex", {})
    assert bad.value.code == 400
    server.shutdown()


def test_stream_trigger(running, tmp_path):
    from lodestone.streaming import append

    e, _ = running
    append.watch(e, str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert e.health().first()["documents"] == 2


def test_stream_finds_edits_and_deletions_alone(running, tmp_path):
    from lodestone.streaming import append

    e, docs = running
    tick = lambda: append.watch(e, str(tmp_path / "cp"), once=True).awaitTermination(120)
    tick()
    (docs / "pigeons.txt").write_text("Pigeons fly.")
    tick()
    assert {r.text for r in e.store.read("chunks").collect()} == {"Pigeons fly.", "Python is a language."}
    (docs / "python.md").unlink()
    tick()
    assert [r.text for r in e.store.read("chunks").collect()] == ["Pigeons fly."]
    before = e.store.current()
    tick()
    assert e.store.current() == before
    stream = append.watch(e, str(tmp_path / "cp"), interval="1 second")
    (docs / "pigeons.txt").write_text("Pigeons rest.")
    limit = time.monotonic() + 90
    while time.monotonic() < limit and stream.isActive and e.store.current() == before:
        time.sleep(0.5)
    stream.stop()
    assert [r.text for r in e.store.read("chunks").collect()] == ["Pigeons rest."]


def test_upsert_moves_changed_documents_to_the_end(spark):
    old = spark.createDataFrame([("a", 0, 0, "x"), ("b", 0, 1, "y"), ("c", 0, 2, "z")], "doc_name string, chunk_no int, chunk_ord long, text string")
    new = spark.createDataFrame([("a", 0, 0, "x2"), ("a", 1, 0, "x3")], old.schema)
    got = sync.upsert(old, new, spark.createDataFrame([("b",)], "doc_name string")).orderBy("chunk_ord").collect()
    assert [(r.doc_name, r.chunk_ord, r.text) for r in got] == [("c", 2, "z"), ("a", 3, "x2"), ("a", 4, "x3")]
    assert re.match("c", got[0].doc_name)
