"""Chunks leave a worker in steps; the chunk before goes with each without a shuffle."""

import random

import pyarrow as pa

from lodestone.operators import chunking
from lodestone.plans import catalogue


def test_steps_are_bounded():
    rng = random.Random(3)
    rows = [["x"] * rng.choice([0, 1, 5, 900, 9000]) for _ in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(rows, pa.list_(pa.string()))], ["doc", "pieces"])
    got = list(chunking.steps(batch))
    assert [x for g in got for x in g.column(0).to_pylist()] == list(range(300))
    assert all(g.num_rows == 1 or sum(map(len, g.column(1).to_pylist())) <= chunking.STEP_PIECES for g in got)


def test_before_is_the_end_of_the_chunk_before(spark):
    docs = spark.createDataFrame([(1, "One two. " * 30), (2, None), (3, "Süß. Ñu!\nEnd " * 20), (4, "short")], "doc_id long, text string")
    plain = chunking.chunks(docs, 40, 15, "doc_id").orderBy("doc_id", "chunk_no").collect()
    got = chunking.chunks(docs, 40, 15, "doc_id", before=15).orderBy("doc_id", "chunk_no").collect()
    assert [tuple(r)[:-1] for r in got] == [tuple(r) for r in plain] and len(plain) > 10
    assert [r.before for r in got] == [plain[i - 1].text[-15:] if r.chunk_no else None for i, r in enumerate(plain)]


def test_overlap_check_has_no_shuffle(spark):
    got = catalogue.queries()["chunk_overlap_check"](spark, "/root/testdata/sf0.001")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString() and got.count()
