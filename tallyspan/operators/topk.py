"""The k best rows of each query, kept per task and merged at the end."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window, functions as F


class BestRows:
    """Running k best rows of each query by (score descending, id)."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k = k
        self.ids = np.zeros((n_queries, 0), dtype=np.int64)
        self.scores = np.zeros((n_queries, 0))

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """Scores of some rows (rows × queries); nan leaves a pair out.

        Only queries for which some row may enter their k best are sorted.
        """
        if not len(ids):
            return
        if self.scores.shape[1] == self.k:
            worst, worst_id = self.scores[:, -1], self.ids[:, -1]
            better = (scores > worst) | ((scores == worst) & (ids[:, None] < worst_id)) | np.isnan(worst)
            chosen = np.flatnonzero(better.any(axis=0))
            useful = np.flatnonzero(better.any(axis=1))
            ids, scores = ids[useful], scores[useful]
        else:
            chosen = np.arange(scores.shape[1])
        all_ids = np.concatenate([self.ids[chosen], np.broadcast_to(ids, (len(chosen), len(ids)))], axis=1)
        all_scores = np.concatenate([self.scores[chosen], scores.T[chosen]], axis=1)
        order = np.lexsort((all_ids, -np.nan_to_num(all_scores, nan=-np.inf)), axis=1)[:, : self.k]
        best_ids, best_scores = np.take_along_axis(all_ids, order, axis=1), np.take_along_axis(all_scores, order, axis=1)
        if len(chosen) == len(self.ids):
            self.ids, self.scores = best_ids, best_scores
        else:
            self.ids[chosen], self.scores[chosen] = best_ids, best_scores

    def batch(self, query_ids: np.ndarray, query_key: str, key: str) -> pa.RecordBatch:
        kept = ~np.isnan(self.scores)
        query = np.repeat(query_ids, self.ids.shape[1]).reshape(self.ids.shape)
        return pa.record_batch([pa.array(query[kept]), pa.array(self.ids[kept]), pa.array(self.scores[kept])], names=[query_key, key, "score"])


def blocks_of(rows: DataFrame, size: int) -> Iterator[list[Row]]:
    """The rows of a query set on the driver, ``size`` at a time."""
    block: list[Row] = []
    for row in rows.toLocalIterator():
        block.append(row)
        if len(block) == size:
            yield block
            block = []
    if block:
        yield block


def best_of(candidates: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    """Final ranks over the tasks' candidates."""
    order = Window.partitionBy(query_key).orderBy(F.col("score").desc(), key)
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(query_key, "rank", key, "score")
