"""Near-duplicates by MinHash against comparing all pairs."""

import itertools
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from lodestone.llm import minhash, queries

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 3]) for i in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])


def plainly(rows):
    sets = [shingles(r.text) for r in rows]
    names = list(range(len(sets)))

    def root(a):
        while names[a] != a:
            names[a] = names[names[a]]
            a = names[a]
        return a

    for a, b in itertools.combinations(range(len(sets)), 2):
        inter = len(sets[a] & sets[b])
        if inter and 100 * inter >= 85 * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            names[max(x, y)] = min(x, y)
    low = {}
    for i, r in enumerate(rows):
        if sets[i] and r.doc_id is not None:
            low[root(i)] = min(low.get(root(i), r.doc_id), r.doc_id)
    out = [(r.doc_id, len(s), low.get(root(i)) if s else r.doc_id) for i, (r, s) in enumerate(zip(rows, sets))]
    return Counter((*x, x[0] == x[2]) for x in out)


def check(docs, rows=None):
    assert Counter(map(tuple, minhash.near_duplicates(docs).collect())) == plainly(docs.collect() if rows is None else rows)


def group(rng, size, edits, start, chain=0.0):
    base = [str(rng.random()) for _ in range(120)]
    texts = []
    for i in range(size):
        w = texts[-1].split() if texts and rng.random() < chain else list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = str(rng.random())
        texts.append(" ".join(w))
    return [(start + i, t) for i, t in enumerate(texts)]


def test_against_all_pairs(spark, odd):
    check(odd)
    check(spark.read.parquet(f"{SF}/documents.parquet"))
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [2000, 30])
def test_groups_about_the_threshold(spark, monkeypatch, hot):
    monkeypatch.setattr(minhash, "HOT", hot)
    rng = random.Random(hot)
    rows = group(rng, 160, 4, 0) + group(rng, 60, 2, 1000, chain=0.9) + [(2000 + i, "the same words in every one of these") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    rows = docs.collect()
    assert 1 < len({x[2] for x in plainly(rows)}) < len(rows) - 50
    check(docs, rows)


def test_rounds_alone(spark, monkeypatch):
    """Without the comparison with middles the rounds find every component, two pairs at a time."""
    rng = random.Random(8)
    docs = spark.createDataFrame(group(rng, 50, 4, 0) + group(rng, 40, 2, 100, chain=1.0), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(minhash, "middles", lambda met, *_: met.selectExpr("cls AS a", "cls AS b").limit(0))
    monkeypatch.setattr(minhash, "GROWTH", 2)
    check(docs)


def test_signatures_estimate_similarity():
    """Agreement is unbiased, spreads no wider than independent permutations, and no linked pair misses every band."""
    rng = np.random.default_rng(5)
    for size, share in ((12, 0.9), (300, 0.86), (300, 0.5), (4000, 0.86)):
        got, missed = [], 0
        for _ in range(120):
            common, rest = round(size * share), size - round(size * share)
            t = rng.integers(0, 1 << 63, common + rest).astype(np.uint64)
            left = t[: common + rest // 2]
            right = np.concatenate((t[:common], t[common + rest // 2 :]))
            x, y = minhash.signatures([np.sort(left), np.sort(right)])
            got.append((x == y).mean())
            missed += not (x.view(np.uint64) == y.view(np.uint64)).any()
        true = round(size * share) / size
        assert abs(np.mean(got) - true) < 4 * np.sqrt(true * (1 - true) / 96 / 120) + 0.002
        assert np.std(got) < 1.2 * np.sqrt(true * (1 - true) / 96)
        assert share < 0.85 or not missed


def test_permutations_lose_nothing():
    x = np.random.default_rng(1).integers(0, 1 << 32, 200_000).astype(np.uint32)
    assert len(np.unique(minhash.pi(x.copy()))) == len(np.unique(x))


def test_sql(spark, odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.oracle_sql()["op12_minhash"]).fetchall()
    got = minhash.near_duplicates(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id", "kept").collect())) == Counter(want)
