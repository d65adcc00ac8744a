"""The registered queries of this subpackage, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import ann, decontamination, fill_middle, license_scan, minhash, mixing, ngram_join, pii, quality, token_counts, token_output, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.classify_documents(table(spark, d, "documents"), table(spark, d, "labels"))


def op2_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_documents(table(spark, d, "documents"))


def op3_token_output(spark: SparkSession, d: str) -> DataFrame:
    return token_output.write_and_read(table(spark, d, "documents"))


def op4_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return toxicity.classify(docs, toxicity.fit_documents(docs, table(spark, d, "labels")))


def op5_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, d, "documents"), table(spark, d, "benchmark"))


def op6_ann(spark: SparkSession, d: str) -> DataFrame:
    return ann.search_embeddings(table(spark, d, "embeddings"))


def op7_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.count_documents(table(spark, d, "documents"))


def op8_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.join_documents(table(spark, d, "documents"))


def op9_pii(spark: SparkSession, d: str) -> DataFrame:
    return pii.find_in_documents(table(spark, d, "documents"))


def op10_license(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.scan_documents(table(spark, d, "documents"))


def op11_fill_middle(spark: SparkSession, d: str) -> DataFrame:
    return fill_middle.digests(table(spark, d, "documents"))


def op12_minhash(spark: SparkSession, d: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_quality, op2_mixing, op3_token_output, op4_toxicity, op5_decontamination, op6_ann, op7_token_counts, op8_ngram_join, op9_pii, op10_license, op11_fill_middle, op12_minhash)}



def linked_sql(words: int, percent: int, columns: str) -> str:
    """Components of documents by sets of ``words``-word shingles: links, then what is reachable from each row."""
    return rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT r, unnest(CASE WHEN len(w) BETWEEN 1 AND {words - 1} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {words - 2}), lambda i: array_to_string(w[i:i + {words - 1}], ' ')) END) AS t FROM d),
s AS (SELECT DISTINCT r, t FROM f),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.r < b.r GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(r, x) AS (SELECT r, r FROM d UNION SELECT reach.r, e.b FROM reach JOIN e ON reach.x = e.a),
o AS (SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(y.doc_id) AS component_id
  FROM d LEFT JOIN n USING (r) JOIN reach ON reach.r = d.r JOIN d y ON y.r = reach.x GROUP BY d.r, d.doc_id)
SELECT {columns} FROM o"""


NGRAM_JOIN = linked_sql(5, 75, "doc_id, n_shingles, component_id")
MINHASH = linked_sql(3, 85, "doc_id, n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept")
FILL_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT *, list_transform(range(4), lambda i: ('0x' || substr(h, 1 + 8 * i, 8))::BIGINT) AS g FROM d),
c AS (SELECT *, least(g[1] % (n + 1), g[2] % (n + 1)) AS a, greatest(g[1] % (n + 1), g[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR g[3] % 100 >= 90 THEN 'plain' WHEN g[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
x AS (SELECT *, left(t, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(CASE form WHEN 'plain' THEN t ELSE pre || mid || suf END) AS restored_sha256 FROM x"""


def oracle_sql() -> dict[str, str]:
    """Results that depend on the input alone; those of the others hang on models, labels, approximate search or a tokenizer.

    Op 12 is approximate by method, but a link that it misses is rarer than one in ten million.
    """
    return {"op8_ngram_join": NGRAM_JOIN, "op11_fill_middle": FILL_MIDDLE, "op12_minhash": MINHASH}
