"""Texts of varying length into containers of fixed capacity.

Sizes are counted once with a public tokenizer.  Dynamic programming over the
global histogram of sizes (bounded by the capacity, never by the data) chooses
length buckets that minimise padding to the bucket's longest item.  Inside each
bucket, batches of as many items as the token budget allows form the
containers; what a batch leaves over is topped up with batches of shorter
buckets, so that long items, of which only one fits, do not waste half a
container.  The plan is made of counts per bucket; the items only need their
number within their bucket, which comes from numbers within each partition and
the partitions' totals, so no bucket is ever gathered in one task.

Defined cases: null and empty texts have no tokens and no container; a text
longer than the capacity is cut into full pieces and a rest; equal sizes are
interchangeable; repeated documents are packed each; capacities that are null
or below 1 are ignored; empty tables give empty results.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tallyspan.session import materialise

BUCKETS = 384


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_sizes(documents: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and n_tokens (0 for a null text).  ``tokenizer`` is the path of a
    rank file that every executor can read."""
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return source.mapInArrow(run, "doc_id long, n_tokens long")


def bucket_bounds(sizes: np.ndarray, counts: np.ndarray, buckets: int) -> np.ndarray:
    """Upper bounds of at most ``buckets`` buckets with the least padding.

    ``sizes`` is ascending.  An item pads up to its bucket's upper bound, which
    is a size that occurs.
    """
    n = len(sizes)
    if n <= buckets:
        return sizes.copy()
    number = np.concatenate([[0], np.cumsum(counts)]).astype(np.float64)
    volume = np.concatenate([[0], np.cumsum(counts * sizes)]).astype(np.float64)
    # cost[j]: least padding of the first j sizes with the buckets so far.
    cost = np.concatenate([[0.0], sizes * number[1:] - volume[1:]])
    choice = np.zeros((buckets, n + 1), dtype=np.int32)
    for k in range(1, buckets):
        cost, choice[k] = _one_more_bucket(cost, sizes, number, volume, k)
    bounds, j = [], n
    for k in range(buckets - 1, -1, -1):
        bounds.append(sizes[j - 1])
        j = int(choice[k, j])
        if j == 0:
            break
    return np.array(bounds[::-1])


def _one_more_bucket(cost: np.ndarray, sizes: np.ndarray, number: np.ndarray, volume: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Costs with one more bucket, and where that bucket starts.

    The best start never moves back as more sizes are covered, so the middle of
    a range of ends bounds the starts of both its halves; all ranges of one
    depth are searched at once.
    """
    n = len(sizes)
    fresh, choice = cost.copy(), np.zeros(n + 1, dtype=np.int32)
    low, high, first, last = (np.array([x]) for x in (k + 1, n, k, n - 1))
    while len(low):
        end = (low + high) // 2
        length = np.minimum(end - 1, last) - first + 1
        begins = np.cumsum(length) - length
        start = np.repeat(first - begins, length) + np.arange(length.sum())
        ends = np.repeat(end, length)
        total = cost[start] + sizes[ends - 1] * (number[ends] - number[start]) - (volume[ends] - volume[start])
        least = np.minimum.reduceat(total, begins)
        hits = np.flatnonzero(total == np.repeat(least, length))
        best = start[hits[np.searchsorted(hits, begins)]]
        fresh[end], choice[end] = least, best
        left, right = low < end, end < high
        low, high, first, last = (
            np.concatenate([low[left], end[right] + 1]),
            np.concatenate([end[left] - 1, high[right]]),
            np.concatenate([first[left], best[right]]),
            np.concatenate([best[left], last[right]]),
        )
    return fresh, choice


def plan_containers(bounds: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """(first container, containers, items of each bucket in one container).

    From the longest bucket down: a batch of one bucket as large as the budget
    allows, the rest of the budget given to batches of shorter buckets.  Each
    round uses up a bucket or ends its full batches, so the plan is short.
    """
    left = [int(c) for c in counts]
    plan, first = [], 0
    for b in range(len(bounds) - 1, -1, -1):
        while left[b]:
            room, shape = capacity, {}
            for o in range(b, -1, -1):
                take = min(left[o], room // int(bounds[o]))
                if take:
                    shape[o] = take
                    room -= take * int(bounds[o])
            times = min(left[o] // take for o, take in shape.items())
            plan.append((first, times, shape))
            first += times
            for o, take in shape.items():
                left[o] -= take * times
    return plan


def pack(documents: DataFrame, targets: DataFrame, tokenizer: str, buckets: int = BUCKETS) -> DataFrame:
    """capacity_tokens, doc_id, piece_no, n_tokens, container_no for every text
    or piece and every capacity of ``targets``."""
    spark = documents.sparkSession
    schema = "capacity_tokens int, doc_id long, piece_no int, n_tokens long, container_no long"
    capacities = sorted(r[0] for r in targets.select(F.col("capacity_tokens").cast("int")).where("capacity_tokens >= 1").distinct().collect())
    if not capacities:
        return spark.createDataFrame([], schema)
    sizes = materialise(token_sizes(documents, tokenizer))
    pieces = sizes.where("n_tokens > 0").withColumn("capacity_tokens", F.explode(F.array(*(F.lit(c) for c in capacities))))
    pieces = pieces.withColumn("piece_no", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).cast("int") - 1)))
    pieces = pieces.withColumn("n_tokens", F.least(F.col("capacity_tokens").cast("long"), F.col("n_tokens") - F.col("piece_no") * F.col("capacity_tokens")))

    # At most one row per capacity and size: bounded by the sum of the capacities.
    histogram: dict[int, dict[int, int]] = {c: {} for c in capacities}
    for row in pieces.groupBy("capacity_tokens", "n_tokens").count().collect():
        histogram[row["capacity_tokens"]][row["n_tokens"]] = row["count"]
    bounds: dict[int, np.ndarray] = {}
    segments: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    for capacity in capacities:
        held = np.array(sorted(histogram[capacity]), dtype=np.int64)
        counts = np.array([histogram[capacity][s] for s in held], dtype=np.int64)
        bounds[capacity] = bucket_bounds(held, counts, buckets)
        bucket = np.searchsorted(bounds[capacity], held)
        totals = np.bincount(bucket, weights=counts, minlength=len(bounds[capacity])).astype(np.int64)
        runs: dict[int, list[tuple[int, int, int]]] = {}
        used = [0] * len(totals)
        for first, times, shape in plan_containers(bounds[capacity], totals, capacity):
            for b, take in shape.items():
                runs.setdefault(b, []).append((used[b], first, take))
                used[b] += take * times
        segments |= {(capacity, b): tuple(np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) for b, rows in runs.items()}

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Adds the bucket, the partition and the number within both."""
        seen: dict[tuple[int, int], int] = {}
        task = TaskContext.get().partitionId()
        for batch in batches:
            capacity, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 3))
            bucket, local = np.zeros(len(size), dtype=np.int32), np.zeros(len(size), dtype=np.int64)
            for c in np.unique(capacity):
                at = np.flatnonzero(capacity == c)
                bucket[at] = np.searchsorted(bounds[int(c)], size[at])
                order = at[np.argsort(bucket[at], kind="stable")]
                kinds, starts, n = np.unique(bucket[order], return_index=True, return_counts=True)
                for b, s, m in zip(kinds.tolist(), starts.tolist(), n.tolist(), strict=True):
                    begin = seen.get((int(c), b), 0)
                    local[order[s : s + m]] = begin + np.arange(m)
                    seen[int(c), b] = begin + m
            yield pa.record_batch([*batch.columns, pa.array(bucket), pa.array(np.full(len(size), task, dtype=np.int32)), pa.array(local)], names=[*batch.schema.names, "bucket", "task", "local"])

    ordered = pieces.select("capacity_tokens", "doc_id", "piece_no", "n_tokens")
    numbered = materialise(ordered.mapInArrow(number, "capacity_tokens int, doc_id long, piece_no int, n_tokens long, bucket int, task int, local long"))
    group = ["capacity_tokens", "bucket"]
    totals = numbered.groupBy(*group, "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*group).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*group, "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            capacity, bucket, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 4, 5))
            out = np.zeros(len(rank), dtype=np.int64)
            key = capacity.astype(np.int64) * (1 << 20) + bucket
            for k in np.unique(key):
                at = np.flatnonzero(key == k)
                start, first, take = segments[int(k >> 20), int(k & ((1 << 20) - 1))]
                s = np.searchsorted(start, rank[at], side="right") - 1
                out[at] = first[s] + (rank[at] - start[s]) // take[s]
            yield pa.record_batch([*batch.columns[:4], pa.array(out)], names=["capacity_tokens", "doc_id", "piece_no", "n_tokens", "container_no"])

    ranked = numbered.join(offsets, [*group, "task"]).withColumn("rank", F.col("before") + F.col("local"))
    return ranked.select("capacity_tokens", "doc_id", "piece_no", "n_tokens", "bucket", "rank").mapInArrow(place, schema)


def fill_report(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, tokens, share of the space filled."""
    containers = packed.groupBy("capacity_tokens", "container_no").agg(F.sum("n_tokens").alias("used"), F.count("*").alias("n"))
    return containers.groupBy("capacity_tokens").agg(
        F.count("*").alias("n_containers"),
        F.sum("n").alias("n_pieces"),
        F.sum("used").alias("n_tokens"),
        F.max("used").alias("most_used"),
        (F.sum("used") / (F.count("*") * F.col("capacity_tokens"))).alias("fill"),
    )
