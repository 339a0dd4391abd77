import itertools
import random

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F

from tallyspan.llm import packing

TOKENIZER = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_bounds_are_optimal():
    rng = random.Random(2)
    for _ in range(30):
        sizes = np.array(sorted(rng.sample(range(1, 60), rng.randrange(1, 9))))
        counts = np.array([rng.randrange(1, 9) for _ in sizes])
        for buckets in (1, 2, 3, 20):
            bounds = packing.bucket_bounds(sizes, counts, buckets)
            padding = lambda b: sum(c * (next(u for u in b if u >= s) - s) for s, c in zip(sizes, counts))  # noqa: B023, E731
            best = min(padding([*cut, sizes[-1]]) for k in range(min(buckets, len(sizes))) for cut in itertools.combinations(sizes[:-1], k))
            assert len(bounds) <= buckets and padding(bounds) == best


def test_containers(spark):
    rng = random.Random(4)
    texts = [(i, " ".join(rng.choices(["alpha", "beta", "of", "the"], k=rng.choice([1, 3, 20, 70, 150]))), 5) for i in range(400)]
    texts += [(1000, None, 1), (1001, "", 1), (1002, "word " * 3000, 1), (1003, "same", 1), (1004, "same", 1)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, n_tokens long").repartition(3)
    targets = spark.createDataFrame([(1, 128), (2, 256), (3, None), (4, 0), (5, 128)], "target_id int, capacity_tokens int")
    packed = packing.pack(docs, targets, TOKENIZER, buckets=12).toPandas()
    sizes = {r.doc_id: r.n_tokens for r in packing.token_sizes(docs, TOKENIZER).collect()}
    assert sizes[1000] == sizes[1001] == 0 and set(packed.capacity_tokens) == {128, 256}
    for capacity, rows in packed.groupby("capacity_tokens"):
        assert rows.groupby("doc_id").n_tokens.sum().to_dict() == {d: n for d, n in sizes.items() if n}
        assert rows.groupby("container_no").n_tokens.sum().max() <= capacity
        whole = rows[rows.doc_id.map(sizes) <= capacity]
        assert (whole.piece_no == 0).all() and not rows.duplicated(["doc_id", "piece_no"]).any()
        assert sorted(set(rows.container_no)) == list(range(rows.container_no.max() + 1))
        assert rows.n_tokens.sum() / (capacity * rows.container_no.nunique()) > 0.85
    assert packing.pack(docs.limit(0), targets, TOKENIZER).count() == 0
    assert packing.pack(docs, targets.where(F.col("target_id") > 2).where("target_id < 5"), TOKENIZER).count() == 0
