import json

from tallyspan.operators import answers, facts, nested
from tallyspan.plans import QUERIES
from tallyspan.session import table
from tallyspan.sources import payloads, registry


def test_generation_is_checked(spark):
    rows = spark.createDataFrame([(1, "How many in 2,020?", "e = 1,234"), (2, "q", "e = 5"), (3, "q 7", "e = 5")], "example_id long, question string, facts string")
    spoiled = lambda batch: batch["facts"].where(batch["example_id"] != 2, "about 6").mask(batch["example_id"] == 3, "e = 5, not 7 or 8")
    got = {r.example_id: (r.is_exact, r.new_numbers) for r in answers.validated(answers.generate(rows, spoiled)).collect()}
    assert got == {1: (True, 0), 2: (False, 1), 3: (True, 1)}


def test_claim_support(spark):
    claims = spark.createDataFrame([(1, 0, "was 30"), (1, 1, "changed by -5 or 5"), (1, 2, "no number"), (1, 3, "was 31"), (2, 0, "was 1")], "example_id long, claim_no int, claim string")
    links = spark.createDataFrame([(1, n, k, e) for n in (0, 1, 3) for k, e in enumerate(["a", "b", "lost"])], "example_id long, claim_no int, evidence_no int, evidence_id string")
    values = spark.createDataFrame([("a", 12.5), ("b", 17.5)], "evidence_id string, value double")
    got = {(r.example_id, r.claim_no): r.is_supported for r in answers.supported_claims(claims, links, values).collect()}
    assert got == {(1, 0): True, (1, 1): True, (1, 2): None, (1, 3): False, (2, 0): False}


def test_payload_checks(spark):
    body = lambda records, **rest: json.dumps({"success": True, "result": {"resource_id": "r", "records": records} | rest})
    rows = [
        (1, "r", body([{"_id": 1}, {"_id": "2"}], total=2, limit=5)),
        (2, "r", body([{"_id": 1}, {"_id": 1}, {"_id": 0}, {"_id": "x"}], total=3)),
        (3, "other", body([], limit=0)),
        (4, "r", None),
        (5, "r", body([{"_id": 1}, {"_id": 2}], limit=1)),
    ]
    got = {r.file_id: r for r in payloads.payload_checks(spark.createDataFrame([(*r, "clash") for r in rows], "file_id long, resource_id string, body string, e string")).collect()}
    assert [got[i].is_sound for i in range(1, 6)] == [True, False, False, False, False]
    assert (got[2].n_records, got[2].n_bad_ids, got[2].n_repeated_ids, got[3].resource_matches, got[4].is_success) == (4, 2, 1, False, False)


def test_field_faults(spark):
    files = spark.createDataFrame([(1, "resident_population_census_2020", True, [("Number", " TEXT"), ("Total_0_4", "int4"), ("Extra", "text"), (None, "text")]), (2, "x", False, [])], "file_id long, source_id string, has_list boolean, fields array<struct<id:string,type:string>>")
    assert sorted(tuple(r) for r in registry.field_faults(files).collect()) == [(1, "Extra", "unknown", "text"), (1, "Total_0_4", "type", "int4")]
    assert [len(s.fields) for s in registry.sources()] == [78, 9, 62]


def test_bands_and_exactness(spark):
    labels = ["Total", *(f"{a} - {a + 4} Years" for a in range(0, 90, 5)), "90 Years & Over"]
    bands = spark.createDataFrame([(x,) for x in labels], "age_group string")
    asked = [(1, "at_least", 65, None), (2, "at_least", 67, None), (3, "under", None, 20), (4, "range", 10, 19), (5, "range", 11, 19), (6, "range", 41, 42)]
    covered = facts.bands_for(bands, spark.createDataFrame(asked, "i int, kind string, low int, high int"))
    got = {r.i: (r.n_bands, r.is_exact) for r in facts.exactness(covered, ["i"]).collect()}
    assert got == {1: (6, True), 2: (5, False), 3: (4, True), 4: (2, True), 5: (1, False)}


def test_maximum_and_difference(spark):
    rows = spark.createDataFrame([("k", "a", 1, 5.0), ("k", "b", 1, 5.0), ("j", "a", 1, 3.0), ("j", "b", 1, None), ("j", "b", 2, 1.0), ("j", "a", 2, 7.0)], "k string, name string, y int, value double")
    best = {r.k: (r.maximum, r.winner, r.n_at_maximum) for r in facts.unique_maximum(rows.where("y = 1"), ["k"], "name").collect()}
    assert best == {"k": (5.0, None, 2), "j": (3.0, "a", 1)}
    change = facts.difference(rows, ["k", "name"], "y", 1, 2).collect()
    assert [(r.k, r.name, r.difference, r.larger) for r in change] == [("j", "a", 4.0, "second")]


def test_claim_labels_follow_the_claims(spark, small):
    claims = nested.flatten_claims(table(spark, small, "qa_examples")).collect()
    flags = {}
    for c in claims:
        flags.setdefault(c.example_id, []).append((c.supported or "").lower() == "true")
    want = {e: "ANSWERABLE" if all(f) else "PARTIALLY_ANSWERABLE" if any(f) else "INSUFFICIENT_EVIDENCE" for e, f in flags.items()}
    assert {r.example_id: r.label for r in QUERIES["claim_labels"](spark, small).collect()} == want
