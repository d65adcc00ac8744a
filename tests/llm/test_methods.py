"""Each operator's method against a plain account of it."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import ann, decontamination, license_scan, mixing, ngram_join, pii, quality, token_counts, token_output, toxicity
from lodestone.llm.common import Workspace, clean_up, components, shared_dir

SF = "/root/testdata/sf0.001"


def table(spark, name, sf=SF):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def test_quality_expression_is_the_rules(spark, odd):
    docs, labels = table(spark, "documents"), table(spark, "labels")
    model = quality.fit(docs.join(labels, "doc_id").select(F.col("doc_id").alias("key"), "text", F.col("quality").alias("label")))
    assert model.rules and any(len(r) > 1 for r in model.rules)
    for df in (docs, odd):
        rows, prefix = quality.with_statistics(df)
        scores = rows.select(*[F.col(f"{prefix}_{n}").alias(f"x{i}") for i, n in enumerate(quality.STATISTICS)], quality.probability(model, prefix).alias("p")).collect()
        for r in scores:
            z = model.bias
            for rule, w in zip(model.rules, model.weights):
                z += w * all((r[quality.STATISTICS.index(n)] > b) if above else (r[quality.STATISTICS.index(n)] <= b) for n, above, b in rule)
            assert r["p"] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
    scored = quality.score(odd, model)
    assert scored.columns == [c for c in odd.columns if c != "score"] + ["score"] and scored.where("q_words = 'clash'").count() == odd.count()


def test_statistics_against_plain_counting(spark):
    texts = ["", None, "A b, c", "One two two\nOne two two\n12 $%", "É è 9"]
    rows, prefix = quality.with_statistics(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    got = {r.doc_id: r.asDict() for r in rows.collect()}
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert got[i][f"{prefix}_words"] == pytest.approx(np.log1p(len(w)))
        assert got[i][f"{prefix}_digits"] == pytest.approx(sum(c.isdigit() for c in t) / max(1, len(t)))
        assert got[i][f"{prefix}_upper"] == pytest.approx(sum(c in quality.UPPER for c in t) / max(1, len(t)))
        assert got[i][f"{prefix}_distinct_lines"] == pytest.approx(len(set(t.split("\n"))) / len(t.split("\n")))


def character_grams(text):
    low = "".join(c.lower() if len(c.lower()) == 1 and ord(c) < 0x600 else c for c in text or "")
    return {low[i : i + n] for n in toxicity.SIZES for i in range(len(low) - n + 1)}


def slot(gram):
    return int(toxicity.gram_slots(np.array(list(map(ord, gram)), np.uint32), np.array([0, len(gram)]), len(gram))[0])


def test_toxicity_score_is_the_sum_over_character_grams(spark, odd):
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    model = toxicity.fit_documents(docs, table(spark, "labels", "/root/testdata/sf0.01"))
    weight = dict(zip(model.slots.tolist(), model.weights.tolist()))
    assert weight
    extra = spark.createDataFrame([(90, "ÀÉÎ ÀÉÎ été 日本語の文章です 😀😀😀😀😀"), (91, "İstanbul ǅ")], "doc_id long, text string")
    for df in (docs.limit(60), odd.where("doc_id <> 9"), extra):
        for r in toxicity.score(df.select("doc_id", "text"), model).collect():
            z = model.bias + sum(weight.get(s, 0.0) for s in {slot(g) for g in character_grams(r.text)})
            assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_characters_of_broken_utf8():
    flat = np.frombuffer(b"ab\xffc" + "é".encode() + b"\x80", np.uint8)
    points, bounds = toxicity.characters(flat, np.array([0, 4, 6, 7]))
    assert bounds.tolist() == [0, 4, 5, 6] and points.tolist() == [97, 98, 0xFFFD, 99, 0xE9, 0xFFFD]


def test_toxicity_recall(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, "documents", d), table(spark, "labels", d)
    got = toxicity.classify(docs, toxicity.fit_documents(docs, labels)).join(labels, "doc_id").where("held_out").collect()
    toxic = [r.predicted for r in got if r.toxic]
    clean = [r.predicted for r in got if r.toxic == 0]
    assert sum(toxic) >= 0.84 * len(toxic) and sum(clean) <= 0.01 * len(clean)


def test_logistic_finds_the_least_loss():
    rng = np.random.default_rng(0)
    x = rng.random((80, 6)) < 0.4
    y = (rng.random(80) < 0.5).astype(float)
    scale = rng.normal(size=6)
    rows, cols = np.nonzero(x)
    w, b = toxicity.logistic(rows, cols, scale, y, 0.5, 2.0)

    def loss(w, b):
        z = (x * scale) @ w + b
        return (np.where(y == 1, 2.0, 1.0) * np.logaddexp(0, -np.where(y == 1, z, -z))).sum() + 0.25 * (w**2).sum()

    best = loss(w, b)
    for _ in range(300):
        assert loss(w + rng.normal(size=6) * 0.02, b + rng.normal() * 0.02) >= best - 1e-4


def test_decontamination_in_several_groups(spark, odd, monkeypatch):
    docs, bench = table(spark, "documents"), table(spark, "benchmark")
    items = bench.unionByName(bench.select((F.col("item_id") + 1000).alias("item_id"), F.concat_ws(" ", F.lit("quite other words"), F.reverse("text")).alias("text")))
    whole = Counter(map(tuple, decontamination.find_leaks(docs, items).collect()))
    assert whole and all(k[1] < 1000 for k in whole)
    kept = sorted(map(str, decontamination.clean(docs, items).collect()))
    monkeypatch.setattr(decontamination, "GROUP_ITEMS", 10)
    assert Counter(map(tuple, decontamination.find_leaks(docs, items).collect())) == whole
    assert sorted(map(str, decontamination.clean(docs, items).collect())) == kept
    assert decontamination.find_leaks(odd, items.limit(0)).count() == 0 and decontamination.clean(odd.limit(0), items).count() == 0


def test_ann_in_slices_and_blocks(spark, monkeypatch):
    e = table(spark, "embeddings").repartition(3)
    whole = sorted(map(tuple, ann.search_embeddings(e).collect()))  # under FEW vectors a slice: exact
    for slice_, queries, block in ((100, 7, 3), (50, 1000, 5)):
        monkeypatch.setattr(ann, "SLICE", slice_)
        monkeypatch.setattr(ann, "QUERIES", queries)
        monkeypatch.setattr(ann, "BLOCK", block)
        assert sorted(map(tuple, ann.search_embeddings(e).collect())) == whole
    mixed = spark.createDataFrame([(i, [float(i % 7 + 1)] * (2 + i % 2)) for i in range(60)], "vec_id long, embedding array<double>")
    got = Counter(r.query_id for r in ann.search_embeddings(mixed).collect())
    assert got == {0: 20, 20: 20, 40: 20}


def test_trees_are_kept_and_only_edits_encoded(spark, odd, tmp_path):
    encode = token_output.WordEncoder(token_output.default_tokenizer()).tokenizer.encode
    docs = table(spark, "documents").select("doc_id", "text")
    token_counts.build(docs).write.parquet(f"{tmp_path}/0")
    rng = random.Random(2)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for run in (1, 2):
        edits, sizes = [], Counter()
        for d, t in list(texts.items()):
            for seq in range(rng.randint(0, 3)):
                a = rng.randint(0, len(texts[d]))
                b = min(len(texts[d]), a + rng.choice((0, 3, 40)))
                new = rng.choice(("", "a new word", " ", "don't, ", "x" * 30))
                edits.append((d, seq, a, b, new))
                sizes[d] += len(new)
                texts[d] = texts[d][:a] + new + texts[d][b:]
        trees = spark.read.parquet(f"{tmp_path}/{run - 1}")
        given = token_counts.with_edits(trees, spark.createDataFrame(edits, "doc_id long, seq int, start long, end long, text string"))
        token_counts.apply(given, "edits").write.parquet(f"{tmp_path}/{run}")
        longest = max(len(w) for t in texts.values() for w in t.split())
        for r in spark.read.parquet(f"{tmp_path}/{run}").collect():
            assert (r.text or "", r.n_tokens) == (texts[r.doc_id], len(encode(texts[r.doc_id], add_special_tokens=False).ids))
            assert r.chars_encoded <= sizes[r.doc_id] + 3 * 4 * (longest + 3) and (r.doc_id in sizes or r.chars_encoded == 0)
    assert token_counts.count(odd.limit(0)).count() == 0
    assert token_counts.count(odd).columns.count("n_tokens") == 1


def test_large_edits_encode_their_region_once():
    e = token_output.WordEncoder(token_output.default_tokenizer())
    text = "some plain words " * 4000
    tree = token_counts.Tree(e, text, *next(token_counts.leaves(e, pa.array([text]))))
    new = "other words " * 600
    for a, b, t in ((30_000, 30_005, new), (10, 60_000, ""), (20, 25, "and "), (5, 5, new)):
        tree.edit(a, b, t)
        text = text[:a] + t + text[b:]
        assert (tree.text, tree.tokens) == (text, len(e.tokenizer.encode(text, add_special_tokens=False).ids))
    assert tree.encoded <= 2 * len(new) + 400


def test_license_notices_with_a_word_put_in(spark):
    long = [(label, t) for label, t in license_scan.TEMPLATES if len(t.split()) > 25]
    cases = []
    for label, t in long:
        w = t.split()
        cases += [(label, " ".join([*w[:i], "inserted", *w[i:]])) for i in range(len(w) + 1)]
        cases += [(label, " ".join(w[:i] + w[i + 1 :])) for i in range(0, len(w), 5) if not w[i].isdigit() and w[i] not in ("version", "v")]
    docs = spark.createDataFrame([(i, "before it " + t + " after it") for i, (_, t) in enumerate(cases)], "doc_id long, text string")
    _, spans = license_scan.licenses(docs, templates=long)
    found = {(r.doc_id, r.label) for r in spans.collect()}
    missed = [(label, t) for i, (label, t) in enumerate(cases) if (i, label) not in found]
    assert not [m for m in missed if not re.search(r"inserted [0-9]", m[1])]  # a version's numbers stand together


@pytest.mark.parametrize("name", ["documents"])
def test_license_base_columns_of_a_table(spark, odd, name):
    def check(docs):
        got = Counter(map(tuple, license_scan.scan_documents(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()))
        want = Counter()
        for r in docs.collect():
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
            at = sorted((j, label) for p, label in license_scan.PHRASES.items() for j in range(len(w)) if w[j : j + len(p.split())] == p.split())
            want[r.doc_id, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({label for _, label in at}))] += 1
        assert got == want

    check(table(spark, name))
    check(odd)


PLANTED = {
    "email": ["jane.doe (at) example (dot) com", "info [at] firm.de", "max at posteo dot de", "sales(at)shop.co.uk"],
    "ip": ["2001:db8:85a3:0:0:8a2e:370:7334", "fe80::1ff:fe23:4567:890a", "203[.]0[.]113[.]7"],
    "card": ["4111.1111.1111.1111", "5500/0000/0000/0004", "3782.822463.10005"],
    "phone": ["(415) 555-2671", "415-555-2671", "01 42 68 53 00", "030/1234567", "0044 20 7946 0958"],
}
DECOYS = ["version 1::2", "order 123-456-78901", "ratio 16:9", "look at this dot above", "std::vector", "room 300-400-5000", "12:34:56", "isbn 978-3-16-148410-0", "serial 1234.5678.9012.3456", "ref 111-222-3333"]
WHERE = {"email": "write to ", "ip": "from host ", "card": "paid by card ", "phone": "call phone "}


def test_pii_finds_planted_forms_that_the_base_does_not(spark):
    rng = random.Random(12)
    base = ["write to a.b@c.org", "server 10.0.0.7", "call +1 415 555 2671", "visa 4111 1111 1111 1111", "host 192.168.0.12"]
    rows, truth = [], set()
    for i in range(400):
        text, kinds = "", rng.sample(list(PLANTED), 2)
        for k in kinds:
            text += rng.choice(("Some words here, ", "And so on. ")) + WHERE[k]
            s = rng.choice(PLANTED[k])
            truth.add((i, k, len(text), len(text) + len(s)))
            text += s + rng.choice((". ", ", "))
        text += rng.choice(base) + ". " + rng.choice(DECOYS) + "."
        rows.append((i, text))
    got = pii.find_in_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    n_base = sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got)
    said = {(r.doc_id, k, int(a), int(b)) for r in got for k, a, b in (x.split(":") for x in r.spans.split(","))}
    assert n_base == 400 and len(said) > 400
    right = len(said & truth)
    assert right >= 0.9 * len(truth)  # recall of the planted ones
    assert right >= 0.95 * (len(said) - n_base)  # precision of the added ones


def test_pii_of_a_text_full_of_spans(spark):
    n = 100_000
    text = "".join(f"u{i % 7}@x.org {'(415) 555-2671 ' if i % 10 == 0 else ''}" for i in range(n))
    r = pii.find_in_documents(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert r.n_email == n and r.spans.startswith("email:0:8,")


def test_components_of_a_star_and_chains(spark):
    links = [(1000, i) for i in range(1, 400)] + [(2000 + i, 2001 + i) for i in range(60)]
    got = {r.node: r.comp for r in components(Workspace(spark, "t"), spark.createDataFrame(links, "a long, b long"), "c").collect()}
    assert {got[i] for i in [*range(1, 400), 1000]} == {1} and {got[2000 + i] for i in range(61)} == {2000}


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_stages_on_odd_and_empty_tables(spark, odd, stage):
    name, run = stage
    for docs in (odd, odd.limit(0)):
        out = run(spark, docs, SF)
        rows = out.collect()
        assert name == "token_output" or out.columns == docs.columns
        if docs is not odd:
            assert not rows
        elif name == "toxicity":
            assert len(rows) >= len(odd.where("text IS NULL OR text = ''").collect())
        elif name == "ngram_join":
            assert Counter(r.doc_id for r in rows if not (r.text or "").split()) == {4: 1, 5: 1, 6: 1}


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        table(spark, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_operators_on_empty_tables(spark, odd):
    none = odd.limit(0)
    labels = table(spark, "labels")
    assert quality.classify_documents(none, labels.limit(0)).count() == 0 and quality.classify_documents(odd, labels.limit(0)).count() == odd.count()
    assert ngram_join.keep_one(none).count() == 0 and mixing.take(none).count() == 0
    assert token_counts.count_documents(none).count() == 0 and license_scan.scan_documents(none).count() == 0


def test_session_settings_stay(spark, odd):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    token_counts.count(odd).count()
    assert (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == before


def test_zz_clean_up(spark, odd):
    ws = Workspace(spark, "kept")
    kept = ws.save(odd, "odd")
    assert kept.count() == odd.count() and ws.root.startswith(shared_dir(spark))
    clean_up(spark)
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(ws.root)
    assert not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs)
