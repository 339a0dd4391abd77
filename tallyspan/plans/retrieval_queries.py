"""Queries for lexical and dense retrieval, with their SQL.

Searches take every row whose id is divisible by 20 as a query, against all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspan.functions import text
from tallyspan.operators import dense, lexical
from tallyspan.session import table

K = 10
TAU = 0.35  # gate on the largest similarity to a vector of the same label


def token_frequencies(spark: SparkSession, sf: str) -> DataFrame:
    """Document frequency and inverse document frequency of every token."""
    documents = table(spark, sf, "documents")
    terms = lexical.term_counts(documents, "doc_id", "text")
    frequencies = lexical.document_frequencies(terms)
    return frequencies.select("token", "df", F.round(lexical.idf(F.col("df"), documents.count()), 6).alias("idf"))


def document_norms(spark: SparkSession, sf: str) -> DataFrame:
    """TF-IDF length of every document with tokens."""
    documents = table(spark, sf, "documents")
    terms = lexical.term_counts(documents, "doc_id", "text")
    lengths = lexical.norms(terms, lexical.document_frequencies(terms), documents.count(), "doc_id")
    return lengths.select("doc_id", F.round("norm", 4).alias("norm"))


def lexical_top(spark: SparkSession, sf: str) -> DataFrame:
    """The ten documents nearest to each query question."""
    questions = table(spark, sf, "qa_examples").where("example_id % 20 = 0 and question is not null")
    return lexical.top_k(questions, "example_id", "question", table(spark, sf, "documents"), "doc_id", "text", K)


def number_mentions(spark: SparkSession, sf: str) -> DataFrame:
    """How often each number stands in the documents."""
    numbers = table(spark, sf, "documents").select(F.explode(text.number_tokens(F.col("text"))).alias("number"))
    return numbers.groupBy("number").agg(F.count("*").alias("n"))


def vector_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors that are not of length 1, by label (counts of all and faulty)."""
    vectors = table(spark, sf, "embeddings")
    faults = dense.vector_faults(vectors, "vec_id", "embedding", 64)
    return vectors.join(faults, "vec_id", "left").groupBy("label").agg(F.count("*").alias("n"), F.count("fault").alias("n_faulty"))


def dense_top(spark: SparkSession, sf: str) -> DataFrame:
    """The ten vectors nearest to each query vector."""
    vectors = table(spark, sf, "embeddings")
    return dense.top_k(vectors.where("vec_id % 20 = 0"), vectors, "vec_id", "embedding", K)


def label_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Largest similarity of each query to another vector of its label, and
    whether that passes the gate; a query alone in its label has none."""
    vectors = table(spark, sf, "embeddings")
    queries = vectors.where("vec_id % 20 = 0")
    best = dense.top_k(queries, vectors, "vec_id", "embedding", 1, within="label").select(F.col("query_id"), "score")
    rows = queries.select(F.col("vec_id").cast("long").alias("query_id"), "label").join(best, "query_id", "left")
    return rows.select("query_id", "label", "score", F.coalesce(F.col("score") >= TAU, F.lit(False)).alias("is_allowed"))


_PLAIN = r"""replace(replace(replace(regexp_replace(regexp_replace(replace(lower({0}), 'ß', 'ss'), '([0-9]),([0-9])', '\1\2', 'g'), '([0-9]),([0-9])', '\1\2', 'g'), '''s ', ' '), '’s ', ' '), '&', ' and ')"""
_SINGULAR = """CASE WHEN t IN ('census', 'series', 'status', 'talmera') OR regexp_matches(t, '[0-9]') THEN t
  WHEN length(t) > 4 AND suffix(t, 'ies') THEN t[:-4] || 'y' WHEN length(t) > 3 AND suffix(t, 's') AND NOT regexp_matches(t, '(ss|us|is)$') THEN t[:-2] ELSE t END"""


def _terms_sql(source: str, key: str, column: str, where: str = "true") -> str:
    raw = f"SELECT {key}, unnest(regexp_extract_all({_PLAIN.format(column)}, '(\\p{{L}}+|[0-9]+(?:\\.[0-9]+)?)', 1)) AS t FROM {source} WHERE {where}"
    return f"SELECT {key}, {_SINGULAR} AS token, count(*) AS tf FROM ({raw}) GROUP BY ALL"


_LEXICAL_SQL = f"""n AS (SELECT count(*) AS n FROM documents),
terms AS ({_terms_sql("documents", "doc_id", "text")}),
freq AS (SELECT token, count(*) AS df FROM terms GROUP BY token),
idfs AS (SELECT token, df, ln((n + 1) / (df + 1)) + 1 AS idf FROM freq, n),
norms AS (SELECT doc_id, sqrt(sum((tf * idf) ** 2)) AS norm FROM terms JOIN idfs USING (token) GROUP BY doc_id)"""

QUERIES = {f.__name__: f for f in (token_frequencies, document_norms, lexical_top, number_mentions, vector_faults, dense_top, label_similarity)}
ORACLES = {
    "token_frequencies": f"WITH {_LEXICAL_SQL} SELECT token, df, round(idf, 6) AS idf FROM idfs",
    "document_norms": f"WITH {_LEXICAL_SQL} SELECT doc_id, round(norm, 4) AS norm FROM norms",
    "lexical_top": f"""WITH {_LEXICAL_SQL},
        q AS ({_terms_sql("qa_examples", "example_id", "question", "example_id % 20 = 0 AND question IS NOT NULL")}),
        qw AS (SELECT example_id, token, tf, coalesce(idf, ln(n + 1) + 1) AS idf FROM q LEFT JOIN idfs USING (token), n),
        qn AS (SELECT example_id, sqrt(sum((tf * idf) ** 2)) AS qnorm FROM qw GROUP BY example_id),
        s AS (SELECT example_id, doc_id, sum(qw.tf * terms.tf * idf * idf) AS dot FROM qw JOIN terms USING (token) GROUP BY ALL),
        a AS (SELECT example_id, d.doc_id, round(coalesce(dot / (qnorm * norm), 0), 6) AS score FROM qn CROSS JOIN documents d LEFT JOIN s USING (example_id, doc_id) LEFT JOIN norms ON norms.doc_id = d.doc_id)
        SELECT example_id, CAST(row_number() OVER (PARTITION BY example_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM a QUALIFY rank <= {K}""",
    "number_mentions": r"""WITH w AS (SELECT unnest(regexp_extract_all(' ' || text, '[^\p{L}0-9_](-?[0-9][0-9,]*(?:\.[0-9]+)?)', 1)) AS t FROM documents WHERE text IS NOT NULL)
        SELECT replace(t, ',', '') AS number, count(*) AS n FROM w GROUP BY ALL""",
    "vector_faults": """SELECT label, count(*) AS n, count(*) FILTER (WHERE len(embedding) <> 64 OR abs(sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 1e-5) AS n_faulty FROM embeddings GROUP BY label""",
    "dense_top": f"""SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) DESC, v.vec_id) AS INTEGER) AS rank, v.vec_id,
          round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0 QUALIFY rank <= {K}""",
    "label_similarity": f"""WITH s AS (SELECT q.vec_id AS query_id, q.label, max(round(list_inner_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6)) AS score
          FROM embeddings q LEFT JOIN embeddings v ON q.label = v.label AND q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0 GROUP BY ALL)
        SELECT query_id, label, score, coalesce(score >= {TAU}, false) AS is_allowed FROM s""",
}
