"""Fill-in-the-middle against cutting each text by itself."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.llm import fill_middle, queries
from lodestone.llm.common import utf8

ALPHABET = ["a", "P", "S", "M", "<", ">", " ", "\n", "é", "漢", "😀", "́", "<P>", "<M>"]


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def plainly(doc_id, text, units):
    text = text or ""
    digest = sha("1:" + ("" if doc_id is None else str(doc_id)))
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    u = units(text)
    n = len(u)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    pre, mid, suf = ("".join(x) for x in (u[:a], u[a:b], u[b:]))
    if h[3] % 100 < 20:
        return doc_id, n, "spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}"


def key(row):
    return tuple("" if x is None else str(x) for x in row)


@pytest.mark.parametrize("unit, units", [("code points", list), ("words", lambda t: re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|^[\x20\x09-\x0D]+", t))])
def test_each_text_cut_by_itself(spark, odd, unit, units):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET[: rng.choice((5, 12, 14))]) for _ in range(rng.choice((0, 1, 2, 9, 60)))) for _ in range(800)] + ["<", ">", "<P", "P>", "<P>", None, "é" * 40_000]
    docs = odd.select("doc_id", "text", "score", "n_tokens", "start", "kind").unionByName(spark.createDataFrame([(i * 37, t) for i, t in enumerate(texts)], "doc_id long, text string"), allowMissingColumns=True).repartition(3)
    rows = docs.collect()
    for step in (64, 1 << 18):
        got = fill_middle.transform(docs, unit=unit, step=step).withColumn("again", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        assert sorted(map(key, (r[:6] for r in got))) == sorted(key(plainly(r.doc_id, r.text, units)) for r in rows)
        assert sorted((str(r.doc_id), r.again) for r in got) == sorted((str(r.doc_id), r.text or "") for r in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_marks_across_documents_do_not_count():
    flat, offsets = utf8(pa.array(["<", "P>", "", "<P", ">", "a<S>", "<M>"]))
    assert fill_middle.marked(fill_middle.CLASS[flat], offsets).tolist() == [False] * 5 + [True] * 2


def test_shares_and_uniform_cuts(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("x" * 99).alias("text"))
    rows = fill_middle.transform(docs).select("form", "prefix_chars", "middle_chars").toPandas()
    shares = rows.form.value_counts(normalize=True)
    assert abs(shares["plain"] - 0.1) < 0.01 and abs(shares["spm"] - 0.18) < 0.01
    low, high = rows.prefix_chars.dropna(), (rows.prefix_chars + rows.middle_chars).dropna()
    assert abs(low.mean() - 33) < 1 and abs(high.mean() - 66) < 1 and np.isclose(high.max(), 99)


def test_digests_against_sql(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    for path in ("/root/testdata/sf0.001/documents.parquet", f"{tmp_path}/documents.parquet/*.parquet"):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}'")
        want = con.execute(queries.oracle_sql()["op11_fill_middle"]).fetchall()
        got = fill_middle.digests(spark.read.parquet(path)).collect()
        assert sorted(map(key, got)) == sorted(map(key, want))
        assert all(r.restored_sha256 == sha(t or "") for r, t in zip(sorted(got, key=lambda r: (str(r.doc_id), r.restored_sha256)), (x.text for x in sorted(spark.read.parquet(path).collect(), key=lambda r: (str(r.doc_id), sha(r.text or ""))))))
    assert fill_middle.digests(odd.limit(0)).count() == 0
