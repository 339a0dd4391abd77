import math
import random

import numpy as np
import pytest

from tallyspan.operators import dense, fill, lexical, metrics, observations as obs
from tallyspan.sources import jsonl


def test_fill_forward_over_blocks(spark):
    rng = random.Random(3)
    rows = [(g, i, rng.choice([None, None, None, f"v{i}"])) for g in range(3) for i in range(200)]
    got = {(r.g, r.i): r.v for r in fill.fill_forward(spark.createDataFrame(rows, "g int, i long, v string"), ["g"], "i", "v", block=7).collect()}
    last = {}
    for g, i, v in rows:
        last[g] = v or last.get(g)
        assert got[g, i] == last[g]


def test_census_hierarchy_resets(spark):
    labels = ["Early", "Total", "East", "Area A - Total", "East", "Total", "West"]
    df = spark.createDataFrame([(i, 1, i, x, "5") for i, x in enumerate(labels)], "row_id long, load_id long, record_id int, number_label string, total_total string")
    got = [(r.geography_level, r.area, r.subzone) for r in obs.census_records(df).orderBy("row_id").collect()]
    assert got == [("subzone", None, "Early"), ("national", None, None), ("subzone", None, "East"), ("planning_area", "Area A", None), ("subzone", "Area A", "East"), ("national", None, None), ("subzone", None, "West")]


def test_tfidf(spark):
    documents = spark.createDataFrame([(0, "alpha beta"), (1, "alpha gamma"), (2, None)], "doc_id long, text string")
    query = spark.createDataFrame([(7, "beta")], "q long, text string")
    got = lexical.top_k(query, "q", "text", documents.where("doc_id < 2"), "doc_id", "text", 99).collect()
    idf = math.log(3 / 2) + 1
    assert [(r["rank"], r.doc_id) for r in got] == [(1, 0), (2, 1)] and abs(got[0].score - idf / math.sqrt(1 + idf**2)) < 1e-6 and got[1].score == 0
    with pytest.raises(ValueError):
        lexical.top_k(query, "q", "text", documents, "doc_id", "text", 0)
    assert lexical.top_k(query.limit(0), "q", "text", documents, "doc_id", "text", 3).count() == 0


def test_dense_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    vectors = rng.normal(size=(300, 8))
    vectors[17] = vectors[3]
    df = spark.createDataFrame([(i, v.tolist(), i % 4) for i, v in enumerate(vectors)] + [(999, None, 1)], "vec_id long, embedding array<double>, label int")
    got = dense.top_k(df.where("vec_id < 20"), df, "vec_id", "embedding", 5, block=7).collect()
    scores = np.round(vectors[:20] @ vectors.T, 6)
    want = {(q, r + 1, int(i)) for q in range(20) for r, i in enumerate(np.lexsort((np.arange(300), -scores[q]))[:5])}
    assert {(r.query_id, r["rank"], r.vec_id) for r in got} == want


def test_recall_and_labels(spark):
    found = spark.createDataFrame([("q", 1, "b"), ("q", 2, "x"), ("q", 3, "a")], "query string, rank int, item string")
    wanted = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "b"), ("r", "c")], "query string, item string")
    got = {(r.query, r.k): r.recall for r in metrics.recall_at(found, wanted, "query", "item", [1, 2, 3]).collect()}
    assert got == {("q", 1): 0.5, ("q", 2): 0.5, ("q", 3): 1.0, ("r", 1): 0.0, ("r", 2): 0.0, ("r", 3): 0.0}
    gold = ["ANSWERABLE", "ANSWERABLE", "PARTIALLY_ANSWERABLE", "INSUFFICIENT_EVIDENCE", "OUT_OF_SCOPE"]
    said = ["ANSWERABLE", "INSUFFICIENT_EVIDENCE", "PARTIALLY_ANSWERABLE", "INSUFFICIENT_EVIDENCE", None]
    m = metrics.classification(spark.createDataFrame(list(zip(gold, said)), "gold string, said string"), [], "gold", "said").first()
    assert m.accuracy == 0.6 and abs(m.macro_f1 - (2 / 3 + 1 + 2 / 3 + 0) / 4) < 1e-12 and (m.abstention_precision, m.abstention_recall, m.n_failed) == (0.5, 0.5, 1)


def test_threshold(spark):
    rows = spark.createDataFrame([(0.9, True), (0.8, True), (0.3, False), (None, False)], "score double, good boolean")
    best = metrics.best_threshold(metrics.threshold_sweep(rows, "score", "good")).first()
    assert (best.threshold, best.macro_f1) == (0.8, 1.0)


def test_thresholds_are_the_scores_themselves(spark):
    rng = random.Random(5)
    rows = [(rng.choice([round(rng.random(), 2), 0.5 + rng.random() * 1e-6, None]), rng.random() < 0.6) for _ in range(400)] + [(float("nan"), True)]
    got = {r.threshold: r for r in metrics.threshold_sweep(spark.createDataFrame(rows, "score double, good boolean"), "score", "good").collect()}
    scores = {s for s, _ in rows if s is not None and s == s}
    assert set(got) == scores | {math.inf}
    for t, r in got.items():
        allow = [g for s, g in rows if s is not None and s >= t]
        bad = sum(not g for _, g in rows)
        assert r.n_allowed == len(allow) and abs(r.abstention_recall - (bad - sum(not g for g in allow)) / bad) < 1e-12
    empty = spark.createDataFrame([], "score double, good boolean")
    assert [r.n_allowed for r in metrics.threshold_sweep(empty, "score", "good").collect()] == [0]


def test_jsonl_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", None), (1, "ä", 0.5)], "z long, a string, m double")
    out = str(tmp_path / "out")
    jsonl.write_jsonl(df, out, immutable=True)
    back = jsonl.read_jsonl(spark, out, "a string, m double, z long", key="z")
    assert sorted((r.z, r.a, r.m) for r in back.collect()) == [(1, "ä", 0.5), (2, "b", None)]
    with pytest.raises(Exception, match="exist"):
        jsonl.write_jsonl(df, out, immutable=True)
    sums = jsonl.file_checksums(spark, out + "/*.txt")
    assert jsonl.changed_files(sums, sums).count() == 0
    jsonl.write_jsonl(df.union(df), str(tmp_path / "twice"))
    with pytest.raises(jsonl.CorpusError):
        jsonl.read_jsonl(spark, str(tmp_path / "twice"), "a string, m double, z long", key="z")
    assert jsonl.schema_faults(df, [("z", "bigint"), ("a", "string")]) == ["column 2: ('m', 'double') instead of None"]


def test_vectors_round_trip(spark, tmp_path):
    units = spark.createDataFrame([("a",), ("b",)], "evidence_id string")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "evidence_id string, embedding array<double>")
    jsonl.write_vectors(vectors, str(tmp_path / "v"))
    assert jsonl.read_vectors(spark, str(tmp_path / "v"), 2, units).count() == 2
    with pytest.raises(jsonl.CorpusError):
        jsonl.read_vectors(spark, str(tmp_path / "v"), 2, units.limit(1))
