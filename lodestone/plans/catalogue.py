"""Queries over the driver's tables, each beside the SQL that says the same.

Conventions of these fixtures: a document is its own chunk; benchmark item i asks with its whole
text; where vectors are needed, document i has the vector vec_id = i and item i asks with vec_id = i.
Scores are rounded to six digits before they are ranked, so both engines break the same ties.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import chunking, dense, evaluate, fusion, lexical, sync
from lodestone.plans.engine import INSTRUCTION
from lodestone.sources import files

K = 20
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- pieces of SQL ---------------------------------------------------------------------------
WS = r"[\s\x1c-\x1f\x85\p{Z}]"


def norm_sql(column: str) -> str:
    return f"lower(trim(regexp_replace({column}, '{WS}+', ' ', 'g')))"


def tokens_sql(column: str) -> str:
    return rf"regexp_extract_all(lower({column}), '[\p{{L}}\p{{N}}_]+')"


SENTENCES = rf"list_filter(list_transform(regexp_split_to_array(regexp_replace(text, '([.!?]){WS}+', '\1' || chr(10), 'g'), '\n+'), lambda x: regexp_replace(x, '^{WS}+|{WS}+$', '', 'g')), lambda x: x <> '')"


def chunks_sql(size: int, overlap: int) -> str:
    """Common table expressions that end in chunks (doc_id, chunk_no, text): the fold as a list reduction."""
    step = size - overlap
    return f"""pieces AS (SELECT doc_id, flatten(list_transform(s, lambda x: list_transform(range(0, greatest(0, ceil((length(x) - {size}) / {step}.0))::BIGINT + 1), lambda i: substring(x, 1 + i * {step}, {size})))) AS p FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)),
folded AS (SELECT doc_id, list_reduce(list_transform(p, lambda x: struct_pack(done := []::VARCHAR[], cur := [x])), lambda a, b: CASE WHEN length(array_to_string(a.cur, ' ')) + 1 + length(b.cur[1]) > {size}
  THEN struct_pack(done := list_append(a.done, array_to_string(a.cur, ' ')), cur := list_concat(list_filter(a.cur, lambda y, i: length(array_to_string(a.cur[i:], ' ')) <= {overlap}), b.cur))
  ELSE struct_pack(done := a.done, cur := list_concat(a.cur, b.cur)) END) AS f FROM pieces WHERE len(p) > 0),
packed AS (SELECT doc_id, list_append(f.done, array_to_string(f.cur, ' ')) AS c FROM folded),
chunks AS (SELECT doc_id, unnest(range(len(c)))::INT AS chunk_no, unnest(c) AS text FROM packed)"""


ASKED = f"asked AS (SELECT item_id AS query_id, {tokens_sql('text')} AS q FROM benchmark)"
BM25 = f"""
tok AS MATERIALIZED (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents),
post AS MATERIALIZED (SELECT term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2),
len AS MATERIALIZED (SELECT doc_id, count(*) AS dl FROM tok GROUP BY 1),
stats AS MATERIALIZED (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM tok) / (SELECT count(*) FROM documents) AS avgdl),
raw AS MATERIALIZED (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, stats GROUP BY 1),
idf AS MATERIALIZED (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END AS idf FROM raw),
{ASKED},
terms AS (SELECT query_id, unnest(q) AS term FROM asked),
scored AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) + 0.0 AS score
  FROM terms JOIN post USING (term) JOIN idf USING (term) JOIN len USING (doc_id), stats GROUP BY 1, 2)"""
LEX = f"{BM25}, lex AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM scored) WHERE rank <= {K})"
DOT = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) + 0.0"
DENSE = f"""dense AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM (
  SELECT i.item_id AS query_id, b.vec_id AS doc_id, {DOT} AS score FROM benchmark i JOIN embeddings a ON a.vec_id = i.item_id, embeddings b JOIN documents d ON d.doc_id = b.vec_id)) WHERE rank <= {K})"""
FUSED = f"""{LEX}, {DENSE},
parts AS (SELECT query_id, doc_id, rank AS dr, NULL AS lr FROM dense UNION ALL SELECT query_id, doc_id, NULL, rank FROM lex),
sums AS (SELECT query_id, doc_id, min(dr) AS dr, min(lr) AS lr FROM parts GROUP BY 1, 2),
fused AS (SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dr NULLS LAST, lr NULLS LAST) AS rank, doc_id, score, dr, lr FROM (
  SELECT *, coalesce(1.0::DOUBLE / (60 + dr), 0) + coalesce(1.0::DOUBLE / (60 + lr), 0) AS score FROM sums)) WHERE rank <= {K})"""
RESULTS = f"""{LEX},
gold AS (SELECT item_id AS id, text AS g, EXISTS (SELECT 1 FROM documents d WHERE contains({norm_sql('d.text')}, {norm_sql('benchmark.text')})) AS answerable FROM benchmark),
results AS (SELECT id, answerable, (SELECT min(rank) FROM lex JOIN documents d USING (doc_id) WHERE query_id = id AND contains({norm_sql('d.text')}, {norm_sql('g')})) AS rank FROM gold)"""
STATES = """cur AS (SELECT doc_id::VARCHAR AS doc_name, sha256(CASE WHEN doc_id % 7 = 0 THEN text || ' edited' ELSE text END) AS doc_hash FROM documents WHERE doc_id % 5 <> 0),
old AS (SELECT doc_id::VARCHAR AS doc_name, sha256(text) AS doc_hash FROM documents WHERE doc_id % 11 <> 0),
actions AS (SELECT coalesce(old.doc_name, cur.doc_name) AS doc_name, CASE WHEN cur.doc_name IS NULL THEN 'removed' WHEN old.doc_name IS NULL THEN 'added' WHEN old.doc_hash = cur.doc_hash THEN 'unchanged' ELSE 'updated' END AS action
  FROM old FULL JOIN cur ON old.doc_name = cur.doc_name)"""


# --- text ------------------------------------------------------------------------------------
@query("SELECT doc_id, sha256(text) AS doc_hash FROM documents")
def doc_hash(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select("doc_id", F.sha2("text", 256).alias("doc_hash"))


@query("SELECT sha256(text) AS doc_hash, count(*) AS docs, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_docs_by_hash(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").groupBy(F.sha2("text", 256).alias("doc_hash")).agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc")).where("docs > 1")


@query(f"SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)")
def sentence_split(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select("doc_id", F.posexplode(X.split_sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query(f"SELECT doc_id, len({SENTENCES})::BIGINT AS sentences FROM documents")
def sentence_counts(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select("doc_id", F.size(X.split_sentences(F.col("text"))).cast("long").alias("sentences"))


@query(f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM documents")
def tokenize(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select("doc_id", F.array_join(X.tokenize(F.col("text")), " ").alias("tokens"))


@query(f"WITH tok AS (SELECT doc_id, unnest({tokens_sql('text')}) AS term FROM documents) SELECT doc_id, term, count(*) AS tf FROM tok GROUP BY 1, 2")
def term_frequencies(s: SparkSession, d: str) -> DataFrame:
    return lexical.postings(t(s, d, "documents")).select("doc_id", "term", "tf")


@query(f"SELECT doc_id, len({tokens_sql('text')})::BIGINT AS dl FROM documents")
def doc_lengths(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select("doc_id", F.size(X.tokenize(F.col("text"))).cast("long").alias("dl"))


@query(f"WITH {BM25} SELECT term, df, round(idf, 6) AS idf FROM idf")
def corpus_idf(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "documents")
    return lexical.idf(lexical.postings(docs), docs.agg(F.count("*").alias("n"))).select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH tok AS (SELECT unnest({tokens_sql('text')}) FROM documents) SELECT (SELECT count(*) FROM documents) AS n, round((SELECT count(*) FROM tok) / (SELECT count(*) FROM documents), 6) AS avgdl")
def corpus_stats(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "documents")
    return lexical.corpus(docs, lexical.postings(docs)).select("n", F.round("avgdl", 6).alias("avgdl"))


@query(f"SELECT doc_id, {norm_sql('text')} AS normal FROM documents")
def normalize_text(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select("doc_id", X.normalize(F.col("text")).alias("normal"))


@query(f"""WITH s AS (SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS x FROM (SELECT doc_id, {SENTENCES} AS s FROM documents)),
p AS (SELECT doc_id, pos, unnest(range(0, greatest(0, ceil((length(x) - 120) / 100.0))::BIGINT + 1)) AS part, x FROM s)
SELECT doc_id, pos, part, substring(x, 1 + part * 100, 120) AS piece FROM p""")
def hard_split_pieces(s: SparkSession, d: str) -> DataFrame:
    one = t(s, d, "documents").select("doc_id", F.posexplode(X.split_sentences(F.col("text"))).alias("pos", "x"))
    return one.select("doc_id", F.col("pos").cast("long").alias("pos"), F.posexplode(X.hard_split(F.array("x"), 120, 20)).alias("part", "piece")).withColumn("part", F.col("part").cast("long"))


@query(f"WITH {chunks_sql(1000, 150)} SELECT doc_id, chunk_no, doc_id || '#chunk-' || chunk_no AS chunk_id, text FROM chunks")
def chunks(s: SparkSession, d: str) -> DataFrame:
    return chunking.chunks(t(s, d, "documents"), doc="doc_id")


@query(f"WITH {chunks_sql(1000, 150)} SELECT doc_id, count(*) AS chunks, max(length(text))::INT AS longest FROM chunks GROUP BY 1")
def chunk_stats(s: SparkSession, d: str) -> DataFrame:
    return chunks(s, d).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"))


@query(f"""WITH {chunks_sql(400, 150)}, pairs AS (SELECT doc_id, chunk_no, text, lag(text) OVER (PARTITION BY doc_id ORDER BY chunk_no) AS before FROM chunks)
SELECT doc_id, chunk_no, max(k)::INT AS shared FROM pairs, range(0, 151) AS ks(k) WHERE before IS NOT NULL AND k <= length(text) AND left(text, k) = right(before, k) GROUP BY 1, 2""")
def chunk_overlap_check(s: SparkSession, d: str) -> DataFrame:
    """Chunks whose beginning ends the chunk before: by how many characters of whole sentences."""
    both = chunking.chunks(t(s, d, "documents"), 400, 150, "doc_id", before=150).where("before IS NOT NULL").withColumn("head", F.left("text", F.lit(150)))
    shared = F.expr("array_max(filter(sequence(0, length(head)), n -> endswith(before, left(head, n))))")
    return both.select("doc_id", "chunk_no", shared.alias("shared"))


@query("SELECT doc_id, 'passage: ' || text AS passage FROM documents")
def e5_prefix(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "documents").select("doc_id", X.with_prefix(F.col("text"), "intfloat/multilingual-e5-small", X.PASSAGE_PREFIX).alias("passage"))


@query(f"SELECT doc_id, substring(text, 1, 20000) AS cut, left(trim(regexp_replace(text, '{WS}+', ' ', 'g')), 120) AS preview FROM documents WHERE regexp_replace(text, '{WS}+', '', 'g') <> ''")
def analysis_truncate(s: SparkSession, d: str) -> DataFrame:
    docs = t(s, d, "documents").where(~X.is_blank(F.col("text")))
    return docs.select("doc_id", X.truncate(F.col("text"), 20000).alias("cut"), X.preview(F.col("text")).alias("preview"))


@query()
def html_text(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "pages").select("page_id", "url", files.html_column(F.col("html")).alias("text"))


@query("""SELECT c_custkey, '| ' || trim(c_name) || ' | ' || trim(n_name) || ' | ' || trim(c_mktsegment) || ' |' AS line FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def table_row_render(s: SparkSession, d: str) -> DataFrame:
    rows = t(s, d, "customer").join(t(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", X.pipe_row(F.array("c_name", "n_name", "c_mktsegment")).alias("line"))


@query("SELECT conv_id, turn, text AS delta FROM conversations WHERE text <> ''")
def sse_delta_parse(s: SparkSession, d: str) -> DataFrame:
    """Turns rendered as stream lines and read back."""
    turns = t(s, d, "conversations")
    line = F.concat(F.lit("data: "), F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices"))))
    return turns.select("conv_id", "turn", X.sse_delta(line).alias("delta")).where("delta IS NOT NULL")


# --- retrieval -------------------------------------------------------------------------------
def asked(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(X.tokenize(F.col("text")), " ").alias("text"))


def doc_vectors(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "embeddings").join(t(s, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id").select("vec_id", "embedding")


def item_vectors(s: SparkSession, d: str) -> DataFrame:
    return t(s, d, "benchmark").join(t(s, d, "embeddings"), F.col("item_id") == F.col("vec_id")).select(F.col("item_id").alias("query_id"), "embedding")


@query(f"WITH {LEX} SELECT query_id, rank::INT AS rank, doc_id, score FROM lex")
def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(asked(s, d), t(s, d, "documents"), K)


@query(f"""WITH {BM25}, every AS (SELECT a.query_id, d.doc_id, coalesce(s.score, 0.0) AS score FROM asked a CROSS JOIN documents d LEFT JOIN scored s ON s.query_id = a.query_id AND s.doc_id = d.doc_id)
SELECT query_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM every) WHERE rank <= 300""")
def bm25_topk_with_zero_fill(s: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(asked(s, d), t(s, d, "documents"), 300, fill=True)


@query(f"SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, {DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0)) WHERE rank <= {K}")
def dense_topk_single(s: SparkSession, d: str) -> DataFrame:
    e = t(s, d, "embeddings")
    return dense.exact_columns(e.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding"), e, K)


@query(f"SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT i.item_id AS query_id, b.vec_id, {DOT} AS score FROM benchmark i JOIN embeddings a ON a.vec_id = i.item_id, embeddings b)) WHERE rank <= {K}")
def dense_topk_batch(s: SparkSession, d: str) -> DataFrame:
    return dense.exact(item_vectors(s, d), t(s, d, "embeddings"), K)


@query(f"SELECT query_id, rank::INT AS rank, vec_id, score, label FROM (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id, b.label, {DOT} AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0)) WHERE rank <= 5")
def dense_topk_by_label(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    e = t(s, d, "embeddings")
    q = F.broadcast(e.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")))
    scored = e.crossJoin(q).select("query_id", "vec_id", (F.round(X.cosine(F.col("q"), F.col("embedding")), 9) + F.lit(0.0)).alias("score"), "label")
    best = Window.partitionBy("query_id", "label").orderBy(F.desc("score"), F.asc("vec_id"))
    return scored.withColumn("rank", F.row_number().over(best)).where("rank <= 5")


@query()
def ann_cells_recall(s: SparkSession, d: str) -> DataFrame:
    e, q = t(s, d, "embeddings"), item_vectors(s, d)
    return dense.recall(dense.cells(q, e, 10), dense.exact(q, e, 10))


@query()
def ann_graph_recall(s: SparkSession, d: str) -> DataFrame:
    """Recall at 10 of walks over graphs, for each question."""
    e, q = t(s, d, "embeddings"), item_vectors(s, d)
    return dense.recall(dense.search(q, e, 10, "graph"), dense.exact(q, e, 10))


def with_texts(found: DataFrame, s: SparkSession, d: str) -> DataFrame:
    """Documents found with their texts. At most K a question are found, so they go to the texts, which are neither shuffled nor sorted."""
    return t(s, d, "documents").select("doc_id", "text").join(F.broadcast(found), "doc_id")


def fused(s: SparkSession, d: str) -> DataFrame:
    near = dense.exact(item_vectors(s, d), doc_vectors(s, d), K).withColumnRenamed("vec_id", "doc_id")
    return fusion.fuse(near, lexical.bm25(asked(s, d), t(s, d, "documents"), K), K)


@query(f"WITH {FUSED} SELECT query_id, rank::INT AS rank, doc_id, round(score, 9) AS score FROM fused")
def hybrid_rrf_topk(s: SparkSession, d: str) -> DataFrame:
    return fused(s, d).select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


@query(f"WITH {FUSED} SELECT query_id, count(*) AS candidates, count(dr) AS dense, count(lr) AS lexical FROM sums GROUP BY 1")
def rrf_union_candidates(s: SparkSession, d: str) -> DataFrame:
    near = dense.exact(item_vectors(s, d), doc_vectors(s, d), K).withColumnRenamed("vec_id", "doc_id")
    both = fusion.fuse(near, lexical.bm25(asked(s, d), t(s, d, "documents"), K), 2 * K)
    return both.groupBy("query_id").agg(F.count("*").alias("candidates"), F.count("dense_rank").alias("dense"), F.count("lexical_rank").alias("lexical"))


def shared_tokens(q: Column, x: Column) -> Column:
    return F.size(F.array_intersect(X.tokenize(q), X.tokenize(x))).cast("double")


RERANKED = f"""{LEX}, pairs AS (SELECT lex.query_id, rank, doc_id, d.text, len(list_intersect(list_distinct(q), {tokens_sql('d.text')}))::DOUBLE AS s FROM lex JOIN documents d USING (doc_id) JOIN asked ON asked.query_id = lex.query_id),
best AS (SELECT * FROM (SELECT query_id, doc_id, text, s AS score, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, rank) AS rank FROM pairs) WHERE rank <= 5)"""


@query(f"WITH {RERANKED} SELECT query_id, rank::INT AS rank, doc_id, score FROM best")
def rerank_topn(s: SparkSession, d: str) -> DataFrame:
    """Reranked by a stand-in for a cross-encoder: how many distinct tokens are shared."""
    found = with_texts(bm25_topk(s, d), s, d)
    pairs = found.join(asked(s, d).withColumnRenamed("text", "query"), "query_id")
    return fusion.rerank(pairs, shared_tokens, 5).select("query_id", "rank", "doc_id", "score")


@query(f"WITH {LEX} SELECT query_id, rank::INT AS rank, doc_id FROM lex WHERE rank <= 5")
def context_cut(s: SparkSession, d: str) -> DataFrame:
    return fusion.cut(bm25_topk(s, d), 5).select("query_id", "rank", "doc_id")


@query(f"""WITH {LEX}, ctx AS (SELECT query_id, string_agg('Context ' || rank || ':' || chr(10) || d.text, chr(10) || chr(10) ORDER BY rank) AS c FROM lex JOIN documents d USING (doc_id) WHERE rank <= 3 GROUP BY 1)
SELECT ctx.query_id, '{INSTRUCTION}' || chr(10) || chr(10) || c || chr(10) || chr(10) || 'Question: ' || array_to_string(q, ' ') AS prompt FROM ctx JOIN asked USING (query_id)""")
def rag_prompt(s: SparkSession, d: str) -> DataFrame:
    found = with_texts(fusion.cut(bm25_topk(s, d), 3), s, d)
    held = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("c"))
    both = held.join(asked(s, d), "query_id")
    return both.select("query_id", X.rag_prompt(F.col("text"), F.col("c.text"), INSTRUCTION).alias("prompt"))


# --- evaluation ------------------------------------------------------------------------------
@query(f"SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains({norm_sql('d.text')}, {norm_sql('b.text')})")
def relevance_semi_join(s: SparkSession, d: str) -> DataFrame:
    """Documents that contain an item. The items are the stated side; each text is normalised once and compared with those whose anchor words it holds."""
    return evaluate.containing(t(s, d, "benchmark"), t(s, d, "documents"), "item_id", "doc_id")


def results(s: SparkSession, d: str) -> DataFrame:
    gold = t(s, d, "benchmark").join(relevance_semi_join(s, d).select("item_id").distinct().withColumn("hit", F.lit(True)), "item_id", "left")
    questions = gold.select(F.col("item_id").alias("id"), F.coalesce("hit", F.lit(False)).alias("answerable"), F.array("text").alias("sources"))
    return evaluate.first_relevant(with_texts(bm25_topk(s, d), s, d), questions)


@query(f"WITH {RESULTS} SELECT id, answerable, rank::INT AS rank FROM results")
def first_relevant_rank(s: SparkSession, d: str) -> DataFrame:
    return results(s, d)


@query(f"WITH {RESULTS} SELECT k::INT AS k, round(coalesce(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE ELSE 0 END), 0), 4) AS recall FROM results, (VALUES (1), (3), (5), (10)) AS ks(k) WHERE answerable GROUP BY k")
def eval_recall_at_k(s: SparkSession, d: str) -> DataFrame:
    return evaluate.recall_at(results(s, d))


@query(f"WITH {RESULTS} SELECT round(coalesce(avg(coalesce(1.0::DOUBLE / rank, 0)), 0), 4) AS mrr FROM results WHERE answerable")
def eval_mrr(s: SparkSession, d: str) -> DataFrame:
    return evaluate.mrr(results(s, d))


@query(f"""WITH {RESULTS}, a AS (SELECT * FROM results WHERE answerable)
SELECT 'recall@' || k AS metric, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE ELSE 0 END), 4) AS bm25 FROM a, (VALUES (1), (3), (5), (10)) AS ks(k) GROUP BY k
UNION ALL SELECT 'mrr', round(avg(coalesce(1.0::DOUBLE / rank, 0)), 4) FROM a UNION ALL SELECT 'num_answerable', count(*)::DOUBLE FROM a UNION ALL SELECT 'num_unanswerable', count(*)::DOUBLE FROM results WHERE NOT answerable""")
def eval_summary_pivot(s: SparkSession, d: str) -> DataFrame:
    return evaluate.pivot(evaluate.summary(results(s, d), "bm25"), ["bm25"])


@query(f"""WITH {RESULTS} SELECT id, '{{"id":' || id || ',"answerable":' || answerable || ',"rank":' || coalesce(rank::VARCHAR, 'null') || '}}' AS json FROM results""")
def eval_per_question_json(s: SparkSession, d: str) -> DataFrame:
    return evaluate.to_json(results(s, d))


@query("SELECT round(quantile_cont(value, 0.5), 2) AS p50, round(quantile_cont(value, 0.95), 2) AS p95 FROM events")
def latency_percentiles(s: SparkSession, d: str) -> DataFrame:
    return evaluate.percentiles(t(s, d, "events"), "value", 50, 95)


# --- index maintenance -----------------------------------------------------------------------
def states(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored, present, texts) of a fixture: some documents are gone, some edited, some new."""
    docs = t(s, d, "documents").withColumn("doc_name", F.col("doc_id").cast("string"))
    new = docs.where("doc_id % 5 <> 0").withColumn("text", F.expr("CASE WHEN doc_id % 7 = 0 THEN text || ' edited' ELSE text END"))
    return docs.where("doc_id % 11 <> 0").select("doc_name", "text", F.sha2("text", 256).alias("doc_hash")), new.select("doc_name", F.sha2("text", 256).alias("doc_hash")), new.select("doc_name", "text")


@query(f"WITH {STATES} SELECT doc_name, action FROM actions")
def sync_classify(s: SparkSession, d: str) -> DataFrame:
    old, new, _ = states(s, d)
    return sync.classify(old, new).select("doc_name", "action")


@query(f"WITH {STATES} SELECT action, count(*) AS docs, string_agg(doc_name, ',' ORDER BY doc_name) AS names FROM actions GROUP BY 1")
def sync_report(s: SparkSession, d: str) -> DataFrame:
    old, new, _ = states(s, d)
    return sync.report(sync.classify(old, new))


@query(f"WITH {STATES} SELECT doc_name FROM old WHERE doc_name NOT IN (SELECT doc_name FROM cur)")
def sync_removed(s: SparkSession, d: str) -> DataFrame:
    old, new, _ = states(s, d)
    return old.select("doc_name").join(new, "doc_name", "left_anti")


@query(f"""WITH {STATES}, kept AS (SELECT o.doc_name, (d.doc_id)::BIGINT AS chunk_ord, d.text FROM old o JOIN documents d ON d.doc_id::VARCHAR = o.doc_name JOIN actions a ON a.doc_name = o.doc_name WHERE action = 'unchanged'),
delta AS (SELECT a.doc_name, CASE WHEN d.doc_id % 7 = 0 THEN d.text || ' edited' ELSE d.text END AS text FROM actions a JOIN documents d ON d.doc_id::VARCHAR = a.doc_name WHERE action IN ('added', 'updated'))
SELECT doc_name, chunk_ord, sha256(text) AS hash FROM kept UNION ALL SELECT doc_name, (SELECT coalesce(max(chunk_ord), -1) FROM kept) + row_number() OVER (ORDER BY doc_name), sha256(text) FROM delta""")
def sync_upsert_result(s: SparkSession, d: str) -> DataFrame:
    old, new, texts = states(s, d)
    actions = sync.classify(old, new)
    chunks_ = old.select("doc_name", F.lit(0).alias("chunk_no"), F.col("doc_name").cast("long").alias("chunk_ord"), "text")
    changed = texts.join(actions.where("action IN ('added', 'updated')").select("doc_name"), "doc_name")
    out = sync.upsert(chunks_, changed.select("doc_name", F.lit(0).alias("chunk_no"), F.lit(0).cast("long").alias("chunk_ord"), "text"), actions.where("action = 'removed'"))
    return out.select("doc_name", "chunk_ord", F.sha2("text", 256).alias("hash"))


@query(f"WITH {chunks_sql(1000, 150)}, {STATES} SELECT (SELECT count(*) FROM chunks WHERE doc_id % 11 <> 0) AS chunks, (SELECT count(*) FROM old) AS documents")
def index_health(s: SparkSession, d: str) -> DataFrame:
    """The stored documents of the fixture and their chunks."""
    old, _, _ = states(s, d)
    return sync.health(chunking.chunks(old), old)
