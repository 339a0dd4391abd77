import json

from pyspark.sql import functions as F

from tallyspan.operators import nested
from tallyspan.session import table

EXAMPLES = "example_id long, record_json string, key string, claims string"
PAYLOADS = "file_id long, source_id string, resource_id string, body string, results string"


def loose(v):
    v = json.loads(v) if isinstance(v, str) else v
    return v if isinstance(v, list) else [v] if isinstance(v, dict) else []


def claims_of(body):
    """(claim number, parent number, depth, claim, evidence ids) in written order."""
    o, out = json.loads(body), []

    def walk(claims, parent, depth):
        for c in loose(claims):
            n = len(out)
            ids = c.get("evidence_ids")
            ids = ids if isinstance(ids, list) else [ids]
            ids = [i["id"] if isinstance(i, dict) else i for i in ids]
            out.append((n, parent, depth, c.get("claim"), [i for i in ids if i is not None]))
            walk(c.get("parts"), n, depth + 1)

    walk(o.get("example", o).get("claims"), None, 0)
    return out


def test_claims_and_links_match_a_tree_walk(spark, small):
    rows = table(spark, small, "qa_examples")
    expected = [(r.example_id, *c) for r in rows.collect() for c in claims_of(r.record_json)]
    got = nested.flatten_claims(rows).collect()
    assert sorted((r.example_id, r.claim_no, r.parent_claim_no, r.depth, r.claim, r.n_evidence) for r in got) == sorted((e, n, p, d, c, len(i)) for e, n, p, d, c, i in expected)
    links = nested.flatten_evidence(rows).collect()
    assert sorted(tuple(r) for r in links) == sorted((e, n, k, i) for e, n, _, _, _, ids in expected for k, i in enumerate(ids))


def test_deep_trees_and_odd_shapes(spark):
    deep = {"claim": "leaf", "evidence_ids": ["s:r9"]}
    for i in range(12):
        deep = {"claim": f"c{i}", "evidence_ids": {"id": f"s:r{i}"}, "parts": [deep, "text", None]}
    rows = [
        (1, json.dumps({"claims": [deep]}), "x", "y"),
        (2, json.dumps({"example": {"claims": json.dumps([{"evidence_ids": [None, "a", {"id": None}, "a", ""]}])}}), None, None),
        (3, None, None, None),
        (4, "", None, None),
        (5, "{broken", None, None),
        (6, json.dumps({"claims": "no json"}), None, None),
        (7, json.dumps({"claims": {"claim": "one", "evidence_ids": " s:r1 "}}), None, None),
        (7, json.dumps({"claims": {"claim": "one", "evidence_ids": " s:r1 "}}), None, None),
        (8, json.dumps([{"claims": [{"claim": "in a list", "evidence_ids": "b"}]}]), None, None),
    ]
    links = nested.flatten_evidence(spark.createDataFrame(rows, EXAMPLES))
    got = sorted(tuple(r) for r in links.collect())
    assert [r for r in got if r[0] == 1] == [(1, i, 0, f"s:r{11 - i}") for i in range(12)] + [(1, 12, 0, "s:r9")]
    assert [r for r in got if r[0] == 2] == [(2, 0, 0, "a"), (2, 0, 1, "a"), (2, 0, 2, "")]
    assert [r for r in got if r[0] > 2] == [(7, 0, 0, " s:r1 ")] * 2 + [(8, 0, 0, "b")]
    assert nested.flatten_claims(spark.createDataFrame([], EXAMPLES)).count() == 0


def test_records_keep_parents(spark):
    body = {
        "success": "true",
        "result": {
            "pages": [
                {"records": [{"_id": "1", "a": "x", "sub": [{"_id": 2.0, "subsub": {"_id": "03", "more": [{"_id": 4, "deep": [{"_id": 5}]}]}}]}]},
                {"records": json.dumps([{"_id": "bad", "b": None, "tags": [1, 2]}])},
            ]
        },
    }
    rows = [(1, "S", "r", json.dumps(body), "x"), (2, "S", "r", json.dumps([{"result": {"records": {"_id": 7}}}]), "x"), (3, None, None, None, None), (4, "S", "r", "[1, 2", None)]
    got = nested.flatten_records(spark.createDataFrame(rows, PAYLOADS)).orderBy("file_id", "record_no").collect()
    assert [(r.file_id, r.record_no, r.parent_record_no, r.page_no, r.record_id) for r in got] == [(1, 0, None, 0, 1), (1, 1, 0, 0, 2), (1, 2, 1, 0, 3), (1, 3, 2, 0, 4), (1, 4, 3, 0, 5), (1, 5, None, 1, None), (2, 0, None, None, 7)]
    assert got[0].members == {"_id": "1", "a": "x"} and got[5].members == {"_id": "bad", "b": None}


def test_link_evidence(spark):
    links = spark.createDataFrame([(1, i, 0, e) for i, e in enumerate([" S:R1:y2 ", "s:r1", "s:r2", "s:rx", "s", "", None, "t:r1", "s:r1x", "s:r99999999999999999999"])], "example_id long, claim_no int, evidence_no int, evidence_id string")
    known = spark.createDataFrame([("S ", 1), ("S", 1), (None, 2), ("t", None)], "source_id string, record_id long")
    got = nested.link_evidence(links, known).orderBy("claim_no").collect()
    assert [r.record_id for r in got] == [1, 1] + [-1] * 8
    assert nested.link_evidence(links, known.limit(0)).where(F.col("record_id") != -1).count() == 0
