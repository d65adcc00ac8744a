"""Words that a polynomial hash modulo 2**64 cannot tell apart, through every operator that hashes words."""

import numpy as np
import pyarrow as pa
import pytest

from lodestone.llm import common, decontamination, license_scan, ngram_join, token_counts, token_output


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def pairs():
    return [(w, w.translate(str.maketrans("ab", "ba"))) for w in (thue_morse(n) for n in (1024, 2048, 4096, 8192))]


@pytest.fixture(scope="module")
def twins(spark):
    texts = [t for p in pairs() for t in p] + [" ".join([t] * 2 + ["and", "some", "more", "words"]) for p in pairs() for t in p]
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)


def test_hashes_differ():
    words = [t for p in pairs() for t in p]
    for column in (pa.array(words), pa.array(["x " + " ".join(words)])):
        for _, _, flat, offsets in common.chunks(column, 1 << 20):
            starts, ends, _ = common.word_spans(flat, offsets, common.SPACES)
            assert len(set(common.word_hashes(flat, starts, ends).tolist())) == len(starts)


def test_hashes_do_not_depend_on_place():
    rng = np.random.default_rng(1)
    words = [bytes(rng.integers(97, 123, rng.integers(1, 9)).astype(np.uint8)).decode() for _ in range(500)] + ["z" * 9000]
    seen = {}
    for order in (words, words[::-1]):
        for _, _, flat, offsets in common.chunks(pa.array([" ".join(order)])):
            starts, ends, _ = common.word_spans(flat, offsets, common.SPACES)
            for w, h in zip(order, common.word_hashes(flat, starts, ends).tolist(), strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_join_keeps_them_apart(twins):
    rows = ngram_join.join_documents(twins).collect()
    assert all(r.component_id == r.doc_id for r in rows) and len(rows) == 16


def test_token_files_and_counts(spark, twins, tmp_path):
    encode = token_output.WordEncoder(token_output.default_tokenizer()).tokenizer.encode
    want = {r.doc_id: encode(r.text, add_special_tokens=False).ids for r in twins.collect()}
    path = f"file://{tmp_path}/out"
    token_output.write(twins, path)
    assert {r.doc_id: r.ids for r in token_output.read(spark, path, with_ids=True).collect()} == {d: [*ids, 1] for d, ids in want.items()}
    assert {r.doc_id: r.n_tokens for r in token_counts.count(twins).collect()} == {d: len(ids) for d, ids in want.items()}


def test_cache_slots_shared_by_words(monkeypatch):
    monkeypatch.setattr(token_output.WordEncoder, "SLOTS_BITS", 3)
    e = token_output.WordEncoder(token_output.default_tokenizer())
    texts = [" ".join(f"w{i * j} don't" for i in range(40)) for j in range(1, 6)] * 2
    got = [ids[b[i] : b[i + 1]].tolist() for n, ids, b in e.encode(pa.array(texts)) for i in range(n)]
    assert got == [e.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_items_and_phrases(spark, twins):
    (a, b), rest = pairs()[2], " one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, a + rest), (2, b + rest), (3, "mit " + a), (4, "mit " + b)], "doc_id long, text string")
    items = spark.createDataFrame([(1, a + " " + a)], "item_id long, text string")
    assert {r.doc_id for r in decontamination.find_leaks(docs, items).collect()} <= {1, 3}
    rows, _ = license_scan.licenses(docs, phrases={"mit " + a: "x"})
    assert {r.doc_id for r in rows.where("n_base > 0").collect()} == {3}
