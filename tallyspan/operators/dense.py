"""Exact dot-product retrieval over stored vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tallyspan.operators.topk import BestRows, best_of, blocks_of


def norm(vector: Column) -> Column:
    """Euclidean length of an array of numbers."""
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(vector: Column) -> Column:
    """The vector at length 1; null for a null, zero or non-finite one."""
    length = norm(vector)
    finite = (length > 0) & ~F.isnan(length) & (length < F.lit(float("inf")))
    return F.when(finite, F.transform(vector, lambda x: (x.cast("double") / length).cast("float")))


def vector_faults(vectors: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """(key, fault) of vectors that are null, of another size, not finite or not
    of length 1 (within 1e-5)."""
    v, length = F.col(column), norm(F.col(column))
    fault = (
        F.when(v.isNull(), "null")
        .when(F.size(v) != size, "size")
        .when(F.isnan(length) | (length == F.lit(float("inf"))), "not_finite")
        .when(F.abs(length - 1) > 1e-5, "length")
    )
    return vectors.select(key, fault.alias("fault")).where("fault is not null")


def _matrix(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)


def top_k(queries: DataFrame, vectors: DataFrame, key: str, column: str, k: int, within: str | None = None, block: int = 4096) -> DataFrame:
    """The ``k`` vectors of largest dot product with each query, best first.

    Result: query_id, rank, key, score (six decimals; ties by key; negative
    scores included).  With ``within``, only vectors that share that column's
    value with the query, and not the query itself, are compared.  Null vectors
    take no part.  Queries go to the tasks in blocks; each task keeps k rows per
    query.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    group = F.col(within).cast("string") if within else F.lit("")
    pick = lambda df: df.where(F.col(column).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(column).cast("array<double>").alias("v"), F.coalesce(group, F.lit("")).alias("g"))
    result = None
    for rows in blocks_of(pick(queries), block):
        ids, matrix, groups = np.array([r[0] for r in rows]), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix, groups))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix, groups = shared.value
            best = BestRows(len(ids), k)
            for batch in batches:
                for low in range(0, len(batch), 2048):
                    part = batch.slice(low, 2048)
                    own = part.column(0).to_numpy(zero_copy_only=False)
                    scores = np.round(_matrix(part.column(1)) @ matrix.T, 6)
                    if within:
                        other = np.array(part.column(2).to_pylist())[:, None] != groups[None, :]
                        scores[other | (own[:, None] == ids[None, :])] = np.nan
                    best.add(own, scores)
            yield best.batch(ids, "query_id", key)

        part = pick(vectors).mapInArrow(run, f"query_id long, {key} long, score double")
        result = part if result is None else result.unionByName(part)
    if result is None:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    return best_of(result, "query_id", key, k)
