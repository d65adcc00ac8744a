"""BM25 over an inverted index of tokens. Okapi with the usual defaults (assumed, see README).

An ``Index`` is built once; ``blocks`` packs it for storing. Queries start from their own terms and meet only those postings.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import text as X

K1, B, EPSILON = 1.5, 0.75, 0.25
BLOCK = 1024  # keys whose postings lie together
BROADCAST = 500_000  # terms of queries that go to every task


class Index(NamedTuple):
    postings: DataFrame  # term, key, dl, tf
    terms: DataFrame  # term, df, idf
    stats: DataFrame  # one row: n, avgdl


def counted(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, dl, terms, tfs): of each key its length in tokens and its distinct terms with their counts, as two arrays; none for keys without tokens.

    Counts are made within the row, by sorting its tokens: nothing is shuffled. Only rows whose key repeats, which is asked beforehand, are put together first.
    """
    tokens = chunks.select(key, X.tokenize(F.col("text")).alias("t")).where(F.size("t") > 0)
    repeated = chunks.groupBy(F.col(key).alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again")
    if not repeated.isEmpty():
        same = F.col(key).eqNullSafe(F.col("again"))
        whole = tokens.join(repeated, same, "left_semi").groupBy(key).agg(F.flatten(F.collect_list("t")).alias("t"))
        tokens = tokens.join(repeated, same, "left_anti").unionByName(whole)

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: ~F.get(s, i).eqNullSafe(F.get(s, i - 1)))
        return F.transform(F.array(starts), lambda b: F.struct(F.size(s).cast("long").alias("dl"), F.transform(b, lambda i: F.get(s, i)).alias("terms"), F.transform(b, lambda i, j: F.coalesce(F.get(b, j + 1), F.size(s)) - i).alias("tfs")))[0]

    # bound once, as in evaluate.word_grams: an expression would be evaluated anew for each place
    return tokens.select(key, F.inline(F.transform(F.array(F.sort_array("t")), runs)))


def spread(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, key, dl, tf): one row for each distinct term of a chunk, from ``counted``."""
    each = rows.select(key, "dl", F.inline(F.arrays_zip("terms", "tfs")))
    # true of every row; by it each use of the postings asks for the same columns, so Spark makes and exchanges them once
    return each.select(F.col("terms").alias("term"), key, "dl", F.col("tfs").cast("long").alias("tf")).where("term IS NOT NULL AND tf <= dl")


def postings(chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(term, key, dl, tf): one row for each distinct term of a chunk, without a shuffle."""
    return spread(counted(chunks, key), key)


def corpus(chunks: DataFrame, post: DataFrame) -> DataFrame:
    """One row: n chunks and their mean length in tokens (0 for none), from the postings: texts are not tokenised again."""
    total = post.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    both = chunks.agg(F.count("*").alias("n")).crossJoin(F.broadcast(total))  # one row each
    return both.select("n", F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(0.0).alias("avgdl"))


def idf(post: DataFrame, stats: DataFrame) -> DataFrame:
    """(term, df, idf): ln(n - df + .5) - ln(df + .5); where that is negative, EPSILON times the mean over all terms."""
    # counting by tf asks for the same columns as the other uses of the postings do, so Spark makes them once
    raw = post.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df")).crossJoin(F.broadcast(stats.select("n")))  # one row
    raw = raw.withColumn("raw", F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


def build(chunks: DataFrame, key: str = "doc_id") -> Index:
    """The index of one call. Chunks are tokenised once and dealt by key with their counted terms: a row a chunk crosses the network, not a row a posting."""
    post = spread(counted(chunks, key).repartition(key), key)
    return Index(post, idf(post, chunks.agg(F.count("*").alias("n"))), corpus(chunks, post))


def scores(queries: DataFrame, index: Index, key: str = "doc_id") -> DataFrame:
    """(query_id, key, score) of chunks that share a token with the query (query_id, text); repeated query tokens count again.

    The queries' terms, counted beforehand, are broadcast up to BROADCAST of them, so that the postings stay in place; an index that ``build`` dealt by
    key has all of a chunk's terms in one partition, and its scores are summed there. More terms than that meet the postings by a shuffle.
    """
    asked = asked_terms(queries)
    weighed = asked.join(index.terms.select("term", "idf"), "term")
    met = index.postings.join(F.broadcast(weighed) if asked.count() <= BROADCAST else weighed, "term").crossJoin(F.broadcast(index.stats))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return met.groupBy("query_id", key).agg(F.sum(F.col("times") * part).alias("score"))


def blocks(index: Index, key: str) -> DataFrame:
    """(term, block, top, low, keys, impacts): the index packed for storing.

    A row holds the postings of a term in one range of BLOCK keys, as sorted keys and what each adds to a score, with the greatest and least of these.
    """
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    rows = index.postings.join(index.terms.select("term", "idf"), "term").crossJoin(F.broadcast(index.stats)).select("term", F.floor(F.col(key) / BLOCK).alias("block"), F.col(key).alias("key"), part.alias("impact"))
    packed = rows.groupBy("term", "block").agg(F.sort_array(F.collect_list(F.struct("key", "impact"))).alias("p"))  # BLOCK at most
    return packed.select("term", "block", F.array_max("p.impact").alias("top"), F.array_min("p.impact").alias("low"), F.col("p.key").alias("keys"), F.col("p.impact").alias("impacts"))


def asked_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(X.tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))


def live(terms: DataFrame, stored: DataFrame, k: int) -> DataFrame:
    """(query_id, block) of ``blocks`` that may hold one of a query's k best keys; the packed postings themselves are not read.

    The greatest impact of each block is reached by a key, so the kth greatest over all blocks is a score that k keys reach; a block whose
    terms' greatest impacts add up to less has none of the k best. Where some impact is negative all blocks are live.
    """
    per = terms.join(stored.select("term", "block", "top", "low"), "term").groupBy("query_id", "block").agg(F.sum(F.col("times") * F.greatest("top", F.lit(0.0))).alias("bound"), F.max(F.col("times") * F.col("top")).alias("sure"), F.min("low").alias("low"))
    own = Window.partitionBy("query_id")
    placed = per.withColumn("place", F.row_number().over(own.orderBy(F.desc("sure"), "block")))
    known = placed.withColumns({"kth": F.max(F.when(F.col("place") == k, F.col("sure"))).over(own), "least": F.min("low").over(own)})
    return known.where("kth IS NULL OR least < 0 OR bound >= kth - 1e-6").select("query_id", "block")  # scores are rounded to six digits


def stored_scores(queries: DataFrame, stored: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """``scores`` from ``blocks``, without keys that are surely not among a query's k best."""
    terms = asked_terms(queries)
    met = terms.join(stored.select("term", "block", "keys", "impacts"), "term").join(live(terms, stored, k), ["query_id", "block"])
    each = met.select("query_id", "times", F.explode(F.arrays_zip("keys", "impacts")).alias("p"))
    return each.groupBy("query_id", F.col("p.keys").alias(key)).agg(F.sum(F.col("times") * F.col("p.impacts")).alias("score"))


def top_k(scored: DataFrame, k: int, key: str = "doc_id", digits: int = 6) -> DataFrame:
    """(query_id, rank, key, score): by score rounded to ``digits``, ties by key."""
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(key))
    rounded = scored.withColumn("score", F.round("score", digits) + F.lit(0.0))
    return rounded.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", key, "score")


def bm25(queries: DataFrame, chunks: DataFrame, k: int, key: str = "doc_id", fill: bool = False, stored: DataFrame | None = None) -> DataFrame:
    """Top k chunks of each query, from ``stored`` blocks or from an index built for this call.

    ``fill``: chunks without a shared token rank with score 0, in key order, among the rest. Only queries with under k
    positive scores are filled, each from the first m + k keys, m being its matches; these are its ranked ones if fewer than k are ranked.
    Else some of its matches have no positive score, and only then are matches counted apart. The ranked ones are made once and held: at most k rows a query.
    """
    found = scores(queries, build(chunks, key), key) if stored is None else stored_scores(queries, stored, k, key)
    best = top_k(found, k, key)
    if not fill:
        return best
    best = best.localCheckpoint()
    counts = queries.select("query_id").distinct().join(best.groupBy("query_id").agg(F.count("*").alias("m"), F.count_if(F.col("score") > 0).alias("p")), "query_id", "left").fillna(0)
    short = counts.where(F.col("p") < k).select("query_id", "m")
    most = short.agg(F.max("m")).first()[0]
    if most is None:
        return best
    matched = best
    if most >= k:
        matched = found.join(short.select("query_id"), "query_id", "left_semi")
        short = short.select("query_id").join(matched.groupBy("query_id").agg(F.count("*").alias("m")), "query_id", "left").fillna(0)
        most = short.agg(F.max("m")).first()[0]
    head = chunks.select(key).orderBy(key).limit(int(most) + k)
    head = head.select(key, F.row_number().over(Window.orderBy(key)).alias("at"))  # over the limited head only
    zero = short.join(head, F.col("at") <= F.col("m") + k).select("query_id", key).join(matched.select("query_id", key), ["query_id", key], "left_anti").withColumn("score", F.lit(0.0))
    return top_k(best.select("query_id", key, "score").unionByName(zero), k, key)
