"""TF-IDF retrieval: exact cosine top-k of a query set against all texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, functions as F

from tallyspan.functions.text import tokens
from tallyspan.operators.topk import BestRows, best_of
from tallyspan.session import materialise


def term_counts(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, token, tf) of every text; null texts have no tokens."""
    return texts.select(key, F.explode(tokens(F.col(column))).alias("token")).groupBy(key, "token").agg(F.count("*").alias("tf"))


def document_frequencies(terms: DataFrame) -> DataFrame:
    """(token, df) over term counts."""
    return terms.groupBy("token").agg(F.count("*").alias("df"))


def idf(df, n_documents: int):
    """ln((N + 1) / (df + 1)) + 1; a null df (an unseen token) counts as 0."""
    return F.log((F.lit(n_documents) + 1) / (F.coalesce(df, F.lit(0)) + 1)) + 1


def norms(terms: DataFrame, frequencies: DataFrame, n_documents: int, key: str) -> DataFrame:
    """(key, norm): root of the sum of squared weights tf · idf of each text."""
    weighted = terms.join(frequencies, "token", "left").withColumn("w", F.col("tf") * idf(F.col("df"), n_documents))
    return weighted.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))


#: Bytes of the weights of a block of queries that are sent to the tasks.
BLOCK_BYTES = 64_000_000


def _query_blocks(per_query: DataFrame, block: int) -> Iterator[tuple[list[Row], dict[str, int]]]:
    """Queries and their vocabulary, as many as ``block`` and BLOCK_BYTES allow."""
    rows: list[Row] = []
    vocabulary: dict[str, int] = {}
    for row in per_query.toLocalIterator():
        fresh = {t["token"] for t in row[1]} - vocabulary.keys()
        if rows and (len(rows) == block or (len(vocabulary) + len(fresh)) * (len(rows) + 1) * 8 > BLOCK_BYTES):
            yield rows, vocabulary
            rows, vocabulary, fresh = [], {}, {t["token"] for t in row[1]}
        for token in sorted(fresh):
            vocabulary[token] = len(vocabulary)
        rows.append(row)
    if rows:
        yield rows, vocabulary


def top_k(queries: DataFrame, query_key: str, query_text: str, documents: DataFrame, key: str, column: str, k: int, block: int = 4096) -> DataFrame:
    """The ``k`` texts nearest to each query by cosine, best first.

    Result: query key, rank, key, score (six decimals; ties by key).  Texts
    without a common token score 0 and fill up the ranks, as do texts without
    tokens.  The queries are a stated set: they go to the tasks in blocks of
    ``block`` at most, of bounded bytes; each task keeps the k best texts of each query, so what is
    shuffled is k rows per query and task.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    documents = documents.where(F.col(key).isNotNull())
    n = documents.count()
    # The terms feed frequencies and norms, the frequencies also the queries.
    terms = materialise(term_counts(documents, key, column))
    frequencies = materialise(document_frequencies(terms))
    lengths = norms(terms, frequencies, n, key)
    asked = term_counts(queries, query_key, query_text)
    weighted = asked.join(frequencies, "token", "left").select(query_key, "token", F.col("tf").alias("qf"), idf(F.col("df"), n).alias("idf"))
    source = documents.select(F.col(key).cast("long").alias(key), tokens(F.col(column)).alias("tokens")).join(lengths, key, "left")
    per_query = weighted.groupBy(F.col(query_key).cast("long").alias(query_key)).agg(F.collect_list(F.struct("token", "qf", "idf")).alias("terms"))
    result = None
    for rows, vocabulary in _query_blocks(per_query, block):
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        weights = np.zeros((len(vocabulary), len(rows)))
        for j, r in enumerate(rows):
            length = np.sqrt(sum((t["qf"] * t["idf"]) ** 2 for t in r[1]))
            for t in r[1]:
                weights[vocabulary[t["token"]], j] = t["qf"] * t["idf"] ** 2 / length
        shared = documents.sparkSession.sparkContext.broadcast((ids, vocabulary, weights))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, vocabulary, weights = shared.value
            best = BestRows(len(ids), k)
            for batch in batches:
                step = max(1, min(1024, BLOCK_BYTES // (8 * max(1, len(vocabulary)))))
                for low in range(0, len(batch), step):
                    part = batch.slice(low, step)
                    counts = np.zeros((len(part), len(vocabulary)))
                    for i, words in enumerate(part.column(1).to_pylist()):
                        for word in words or ():
                            j = vocabulary.get(word)
                            if j is not None:
                                counts[i, j] += 1
                    norm = np.nan_to_num(part.column(2).to_numpy(zero_copy_only=False), nan=0.0)
                    scores = counts @ weights / np.where(norm > 0, norm, 1.0)[:, None]
                    best.add(part.column(0).to_numpy(zero_copy_only=False), np.round(scores, 6))
            yield best.batch(ids, query_key, key)

        part = source.mapInArrow(run, f"{query_key} long, {key} long, score double")
        result = part if result is None else result.unionByName(part)
    if result is None:
        return documents.sparkSession.createDataFrame([], f"{query_key} long, rank int, {key} long, score double")
    return best_of(result, query_key, key, k)
