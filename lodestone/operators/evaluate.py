"""Retrieval quality: first relevant ranks, recall at k, mean reciprocal rank, percentiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X

KS = (1, 3, 5, 10)
BLOCK_BYTES = 8 << 20  # texts of items that one broadcast holds
GRAM = 3  # adjacent words by which items are looked up in documents


def first_relevant(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """(id, answerable, rank): ranked (query_id, rank, text) against questions (id, answerable, sources); null rank where missed."""
    hits = ranked.join(questions.select(F.col("id").alias("query_id"), "sources"), "query_id").where(X.is_relevant(F.col("text"), F.col("sources")))
    best = hits.groupBy("query_id").agg(F.min("rank").alias("rank"))
    return questions.select("id", "answerable").join(best, F.col("id") == F.col("query_id"), "left").select("id", "answerable", "rank")


def recall_at(results: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """(k, recall) over answerable questions; 0 if there are none."""
    means = results.where("answerable").agg(*[F.coalesce(F.avg(F.when(F.col("rank") <= k, 1.0).otherwise(0.0)), F.lit(0.0)).alias(str(k)) for k in ks])
    return means.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.round(F.col(f"`{k}`"), 4).alias("recall")) for k in ks])).alias("x")).select("x.*")


def mrr(results: DataFrame) -> DataFrame:
    return results.where("answerable").agg(F.round(F.coalesce(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), F.lit(0.0)), 4).alias("mrr"))


def percentiles(values: DataFrame, column: str, *percents: float) -> DataFrame:
    """One row, a column p<percent> each, linearly interpolated; 0 for no values."""
    return values.agg(*[F.round(F.coalesce(F.percentile(column, F.lit(p / 100)), F.lit(0.0)), 2).alias(f"p{p:g}") for p in percents])


def summary(results: DataFrame, config: str, ks: tuple[int, ...] = KS) -> DataFrame:
    """(config, metric, value) rows: recall@k, mrr, counts of questions and, where ``results`` have latency_ms, its percentiles. One pass."""
    rank, answerable = F.col("rank"), F.col("answerable")

    def mean(value: Column) -> Column:
        return F.round(F.coalesce(F.avg(F.when(answerable, value)), F.lit(0.0)), 4)

    values = {f"recall@{k}": mean(F.when(rank <= k, 1.0).otherwise(0.0)) for k in ks}
    values["mrr"] = mean(F.coalesce(F.lit(1.0) / rank, F.lit(0.0)))
    values["num_answerable"] = F.count_if(answerable).cast("double")
    values["num_unanswerable"] = F.count_if(~answerable).cast("double")
    if "latency_ms" in results.columns:
        for p in (50, 95):
            values[f"latency_p{p}_ms"] = F.round(F.coalesce(F.percentile("latency_ms", F.lit(p / 100)), F.lit(0.0)), 2)
    one = results.agg(*[v.alias(f"m{i}") for i, v in enumerate(values.values())])
    return one.select(F.lit(config).alias("config"), F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"m{i}").alias("value")) for i, n in enumerate(values)])))


def record(results: DataFrame, config: str, ks: tuple[int, ...] = KS) -> dict:
    """One configuration for a JSON report: its measures and, of each question of the stated set, rank and latency."""
    m = {r["metric"]: r["value"] for r in summary(results, config, ks).collect()}
    per = [{"id": r["id"], "rank": r["rank"], "latency_ms": round(r["latency_ms"], 2)} for r in results.orderBy("id").collect()]
    return {"config": config, "recall_at_k": {str(k): m[f"recall@{k}"] for k in ks}, "mrr": m["mrr"], "latency_p50_ms": m["latency_p50_ms"], "latency_p95_ms": m["latency_p95_ms"], "num_answerable": int(m["num_answerable"]), "num_unanswerable": int(m["num_unanswerable"]), "per_question": per}


def word_grams(words: Column) -> Column:
    """Distinct hashes of each GRAM words in a row."""

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - GRAM)
        return F.when(F.size(w) >= GRAM, F.array_distinct(F.transform(at, lambda i: F.xxhash64(*[w[i + j] for j in range(GRAM)])))).otherwise(F.array().cast("array<long>"))

    return F.transform(F.array(words), of)[0]  # bound once: an expression would be evaluated anew for each place


def anchors(own: DataFrame, item: str) -> DataFrame:
    """(item, h, gram): of the word grams inside each text, without its first and last word, the one that fewest texts share.

    Where a text stands in another, these words are whole words of the other, whatever its first and last word are part of.
    """
    words = F.split("g", " ", -1)
    grams = own.select(item, "h", F.explode(word_grams(F.slice(words, 2, F.size(words) - 2))).alias("gram"))
    shared = grams.groupBy("gram").agg(F.count("*").alias("n"))
    return grams.join(shared, "gram").groupBy(item, "h").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))


def containing(items: DataFrame, docs: DataFrame, item: str, doc: str) -> DataFrame:
    """(item, doc) of ``docs`` (doc, text) that contain the text of ``items`` (item, text), both normalised.

    The items are the stated side: they go to the documents in blocks of about BLOCK_BYTES, whose number is counted beforehand,
    and no text of a document is shuffled. A document's word grams are looked up among the items' anchors, and only items
    whose anchor it holds are compared with it: work follows the words of the documents, not items times documents. Items
    of fewer than GRAM + 2 words have no anchor and are tried on each document. An empty item is in every document but null
    ones; null texts contain nothing and are in nothing; rows that repeat give their pairs again.
    """
    own = items.select(F.col(item).alias("item"), X.normalize(F.col("text")).alias("g")).where("g IS NOT NULL").withColumn("h", F.xxhash64("g"))
    short = F.size(F.split("g", " ", -1)) < GRAM + 2
    sizes = own.agg(*[F.coalesce(F.sum(F.when(which, F.octet_length("g") + 1)), F.lit(0)) for which in (~short, short)]).first()
    texts, out = docs.select(F.col(doc).alias("doc"), X.normalize(F.col("text")).alias("n")), []

    def parts(rows: DataFrame, size: int) -> list[DataFrame]:
        n = int(size) // BLOCK_BYTES + 1 if size else 0
        return [rows.where(F.pmod(F.xxhash64("h", "item"), F.lit(n)) == b) for b in range(n)]

    if sizes[0]:
        chosen = anchors(own.where(~short).distinct(), "item").select(F.col("item").alias("i"), F.col("h").alias("ih"), "gram")
        held = own.where(~short).join(chosen, F.col("item").eqNullSafe(F.col("i")) & (F.col("h") == F.col("ih"))).select("item", "g", "h", "gram")
        grams = texts.select("doc", "n", F.explode(word_grams(F.split("n", " ", -1))).alias("gram"))
        for block in parts(held, sizes[0]):
            out.append(grams.join(F.broadcast(block), "gram").where(F.contains("n", "g")))
    for block in parts(own.where(short), sizes[1]):
        listed = block.agg(F.collect_list(F.struct("item", "g")).alias("items"))
        out.append(texts.crossJoin(F.broadcast(listed)).select("doc", F.explode(F.filter("items", lambda i: F.contains("n", i["g"]))).alias("i")).select("i.item", "doc"))
    pairs = [p.select(F.col("item").alias(item), F.col("doc").alias(doc)) for p in out]
    return reduce(DataFrame.unionByName, pairs) if pairs else own.join(texts, F.lit(False)).select(F.col("item").alias(item), F.col("doc").alias(doc))


def pivot(summaries: DataFrame, configs: list[str]) -> DataFrame:
    return summaries.groupBy("metric").pivot("config", configs).agg(F.first("value"))


def to_json(results: DataFrame) -> DataFrame:
    return results.select("id", F.to_json(F.struct("id", "answerable", "rank"), {"ignoreNullFields": "false"}).alias("json"))
