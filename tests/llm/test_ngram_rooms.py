"""What verification and the prefixes of op 8 send over the network."""

from pyspark.sql import functions as F

from lodestone.llm import ngram_join


def test_only_sets_in_pairs_are_sent(spark):
    sets = spark.range(3000).select(F.col("id").alias("cls"), F.encode(F.col("id").cast("string"), "utf-8").alias("toks"))
    pairs = spark.createDataFrame([(1, 7), (1, 2999)], "a long, b long")
    got = {r.cls for r in ngram_join.asked_for(sets, pairs).collect()}
    assert {1, 7, 2999} <= got and len(got) < 30
    assert ngram_join.asked_for(sets, pairs.limit(0)).count() == 0


def test_prefixes_are_ordered_by_count_then_hash(spark):
    """The hash that breaks ties is added after the exchange: rare tokens still come first, ties by their hash."""
    import numpy as np

    held = {1: [10, 11, 12, 13], 2: [10, 11, 12, 13], 3: [12, 13, 14, 15], 4: [14, 15, 16, 17]}
    rows = [(c, len(t), np.array(t, np.int64).tobytes(), b"\0" * (ngram_join.SKETCH // 8)) for c, t in held.items()]
    sets = spark.createDataFrame([(c, n, bytearray(t), bytearray(s)) for c, n, t, s in rows], "cls long, n long, toks binary, sketch binary")
    out = ngram_join.across(sets, sets.select("cls", F.col("cls").alias("comp")))
    assert "xxhash64(tok" not in [x for x in out._jdf.queryExecution().optimizedPlan().toString().split("\n") if "collect_list" in x][-1]
    freq = {t: sum(t in x for x in held.values()) for x in held.values() for t in x}
    h = {r.id: r.h for r in spark.range(10, 18).select("id", F.xxhash64("id").alias("h")).collect()}
    want = set()
    for c, t in held.items():
        met = sorted((t for t in t if freq[t] > 1), key=lambda t: (freq[t], h[t]))
        if 4 * len(met) >= 3 * len(t):
            want |= {(t, c) for t in met[: max(len(met) - (3 * len(t) + 3) // 4 + 1, 0)]}
    assert {(r.tok, r.cls) for r in out.collect()} == want
