"""The jobs on growing copies of tables, rerun, and against the library's own functions."""

import hashlib
import json
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobs import chunk_increments, common, retrieval_report
from lodestone.operators import chunking

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, version string, chunks string"


def put(spark, folder, rows):
    """One more file."""
    full = [(*r, "clash", "clash") for r in rows]
    spark.createDataFrame(full, DOCS).coalesce(1).write.mode("append").parquet(folder)


def take(spark, at, **settings):
    chunk_increments.run(spark, f"{at}/in", f"{at}/out", f"{at}/mark", {"chunk_size": 40, "overlap": 10} | settings)
    return {(r.doc_id, r.lang, r.chunk_no, r.text) for r in chunk_increments.current(spark, f"{at}/out").collect()}


def cut(spark, rows):
    docs = spark.createDataFrame([(i, t, lang or None) for i, t, lang in rows], "doc_id long, text string, lang string")
    return {(r.doc_id, r.lang, r.chunk_no, r.text) for r in chunking.chunks(docs, 40, 10, "doc_id", keep=("lang",)).collect()}


def ledger(spark, at):
    return spark.read.schema(chunk_increments.LEDGER).parquet(f"{at}/out/documents").collect()


def test_chunks_follow_a_growing_folder(spark, tmp_path, caplog):
    at = f"file://{tmp_path}"
    long = "One sentence here. Another one there. And a third that goes on for long enough to be cut. " * 3
    first = [(1, long, "en"), (2, "Short.", None), (3, None, "de"), (4, "  \n", "de"), (5, "Bleibt.", ""), (None, "Nobody's.", "en")]
    put(spark, f"{at}/in", first)
    with caplog.at_level("INFO", "jobs.chunk_increments"):
        assert take(spark, at) == cut(spark, first[:5])
    assert "read 6 rows (1 without doc_id), 5 documents added, 0 updated" in caplog.text
    rows = len(ledger(spark, at))
    assert take(spark, at) == cut(spark, first[:5]) and len(ledger(spark, at)) == rows  # nothing new, nothing written
    # one changed, one emptied, one of another language, one seen before, one new, and one of which rows differ
    more = [(1, long + "More.", "en"), (2, "", None), (5, "Bleibt.", "de"), (3, None, "de"), (6, "New here.", "fr"), (6, "New here.", "fr")]
    put(spark, f"{at}/in", more)
    caplog.clear()
    with caplog.at_level("INFO", "jobs.chunk_increments"):
        now = take(spark, at)
    assert now == cut(spark, [more[0], (4, "  \n", "de"), more[2], more[4]])
    assert "read 6 rows (0 without doc_id), 1 documents added, 3 updated" in caplog.text
    assert Counter(r.version for r in ledger(spark, at)) == {0: 5, 1: 4}
    put(spark, f"{at}/in", [(7, "a b.", "x"), (7, "c d.", "y"), (8, "Ω.", "x/y=z %")])
    assert {(i, lang) for i, lang, *_ in take(spark, at) if i > 6} == {(8, "x/y=z %"), max(((7, "x"), (7, "y")), key=lambda r: hashlib.sha256({"x": b"a b.", "y": b"c d."}[r[1]]).hexdigest())}


def test_batches_of_one_file_give_the_same(spark, tmp_path):
    at = f"file://{tmp_path}"
    rows = [[(i, f"Text {i} of {k}. " * 5, "en") for i in range(k, k + 4)] for k in range(3)]
    for part in rows:
        put(spark, f"{at}/in", part)
    assert take(spark, at, files_per_batch=1) == cut(spark, [rows[0][0], rows[1][0], *rows[2]])


@pytest.mark.parametrize("lost", ["documents", "both"])
def test_a_batch_that_failed_is_repeated(spark, tmp_path, monkeypatch, lost):
    at = f"file://{tmp_path}"
    first, second = [(1, "One. Two. " * 9, "en"), (2, "Three.", "de")], [(1, "Four. " * 20, "fr"), (3, "Five.", "de")]
    put(spark, f"{at}/in", first)
    take(spark, at)
    put(spark, f"{at}/in", second)
    real = chunk_increments.write

    def failing(rows, path, *partitions):
        written = 0 if lost == "both" else real(rows, path, *partitions) if path.endswith("chunks") else None
        if path.endswith("documents") or lost == "both":
            raise RuntimeError("lost")
        return written

    monkeypatch.setattr(chunk_increments, "write", failing)
    with pytest.raises(Exception, match="lost"):
        take(spark, at)
    assert {r[0] for r in {(c.doc_id,) for c in chunk_increments.current(spark, f"{at}/out").collect()}} == {1, 2}  # what was there still counts
    monkeypatch.setattr(chunk_increments, "write", real)
    assert take(spark, at) == cut(spark, [second[0], first[1], second[1]])
    assert Counter(r.version for r in ledger(spark, at)) == {0: 2, 1: 2}


def test_an_empty_folder_and_bad_settings(spark, tmp_path):
    at = f"file://{tmp_path}"
    put(spark, f"{at}/in", [])
    assert take(spark, at) == set()
    with pytest.raises(ValueError):
        take(spark, at, chunk_size=0)
    (tmp_path / "own.json").write_text(json.dumps({"chunk_sise": 5}))
    with pytest.raises(ValueError, match="chunk_sise"):
        common.settings(chunk_increments.DEFAULTS, str(tmp_path / "own.json"))


def test_report_reruns_and_keeps_other_configurations(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    tables = [f"{SF}/{t}.parquet" for t in ("documents", "benchmark", "embeddings")]
    before = dict(spark.conf.getAll)
    retrieval_report.run(spark, *tables, out, {"top_k": 5})
    whole = Counter(map(tuple, retrieval_report.report(spark, out).collect()))
    assert {r[0] for r in whole} == {"lexical", "dense", "hybrid"} and max(whole.values()) == 1
    retrieval_report.run(spark, *tables, out, {"top_k": 5, "configs": ["hybrid"]})
    assert Counter(map(tuple, retrieval_report.report(spark, out).collect())) == whole
    retrieval_report.run(spark, *tables, out, {"top_k": 1, "configs": ["lexical"]})
    now = Counter(map(tuple, retrieval_report.report(spark, out).collect()))
    assert {r for r in now if r[0] != "lexical"} == {r for r in whole if r[0] != "lexical"}
    assert all(r[4] in (None, 1) for r in now if r[:2] == ("lexical", "question"))
    assert dict(spark.conf.getAll) == before
    with pytest.raises(ValueError, match="other"):
        retrieval_report.run(spark, *tables, out, {"configs": ["other"]})


def test_report_on_odd_tables(spark, tmp_path):
    out, at = f"file://{tmp_path}/out", f"file://{tmp_path}"
    spark.createDataFrame([(1, "the gold passage is here"), (2, None), (3, ""), (None, "the gold passage"), (4, "other words")], "doc_id long, text string").withColumn("score", F.lit("clash")).write.parquet(f"{at}/d")
    spark.createDataFrame([(1, "gold passage"), (2, None), (3, "  "), (None, "gold"), (4, "nowhere found")], "item_id long, text string").write.parquet(f"{at}/q")
    spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (4, [0.0, 1.0]), (None, [1.0, 1.0])], "vec_id long, embedding array<float>").write.parquet(f"{at}/v")
    retrieval_report.run(spark, f"{at}/d", f"{at}/q", f"{at}/v", out)
    rows = {(r.config, r.name): r for r in retrieval_report.report(spark, out).collect() if r.kind == "question"}
    assert {n for _, n in rows} == {"1", "2", "3", "4"}
    assert [rows["lexical", n].answerable for n in "124"] == [True, False, False] and rows["lexical", "1"].rank == rows["dense", "1"].rank == rows["hybrid", "1"].rank == 1
    for t in "dqv":
        spark.read.parquet(f"{at}/{t}").limit(0).write.parquet(f"{at}/{t}0")
    retrieval_report.run(spark, f"{at}/d0", f"{at}/q0", f"{at}/v0", f"{out}0")
    assert {(r.name, r.value) for r in retrieval_report.report(spark, f"{out}0").collect()} >= {("mrr", 0.0), ("num_answerable", 0.0)}


def test_command_line(tmp_path):
    (tmp_path / "own.json").write_text(json.dumps({"chunk_size": 500, "overlap": 50}))
    for _ in range(2):
        done = subprocess.run([sys.executable, "-m", "jobs.chunk_increments", "--documents", f"{SF}/documents.parque*", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/mark", "--config", f"{tmp_path}/own.json"], capture_output=True, text=True, timeout=300, cwd=common.Path(__file__).parents[1])
        assert done.returncode == 0, done.stderr[-2000:]
    assert "0 batches in this run" in done.stderr and list((tmp_path / "out/chunks").glob("lang=*/version=0/*.parquet"))
