import json
import random

from tallyspan.operators import drift
from tallyspan.plans import QUERIES
from tallyspan.session import table

PAYLOADS = "file_id long, source_id string, resource_id string, prev_file_id long, body string, results string, lists string"
MISSING = {"", "-", "na", "n.a.", "null"}


def records_in(o, out):
    for v in o.values() if isinstance(o, dict) else o if isinstance(o, list) else []:
        records_in(v, out)
    if isinstance(o, dict) and "_id" in o:
        out.insert(0, o)
    return out


def by_value(v):
    try:
        return None if v is None else float(str(v).strip())
    except ValueError:
        return str(v).strip()


def brute(rows):
    files, out = {}, set()
    for f, _, body in rows:
        o = json.loads(body)
        top = (o[0] if isinstance(o, list) else o)["result"]
        held, listed = records_in(o, []), top.get("fields")
        fields = {x["id"]: x["type"] for x in listed} if listed is not None else {k: None for r in held for k, v in r.items() if not isinstance(v, (list, dict))}
        files[f] = fields, {int(str(r["_id"]).strip()): r for r in held}, listed is not None
    for f, p, _ in rows:
        if p not in files:
            continue
        (old, a, was), (new, b, now) = files[p], files[f]
        gone, fresh, renamed, matched = old.keys() - new.keys(), new.keys() - old.keys(), {}, set()
        for g in gone:
            for n in fresh:
                pairs = [(by_value(a[i].get(g)), by_value(b[i].get(n))) for i in a.keys() & b.keys()]
                pairs = [x for x in pairs if None not in x]
                if pairs and 10 * sum(x == y for x, y in pairs) >= 9 * len(pairs):
                    renamed[n] = g
                    matched.add(g)
        out |= {(f, n, "renamed" if n in renamed else "added") for n in fresh} | {(f, g, "removed") for g in gone - matched}
        if was and now:
            out |= {(f, n, "retyped") for n in new if (o := renamed.get(n, n)) in old and old[o].strip().lower() != new[n].strip().lower()}
    return out


def test_changes_match_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in table(spark, sf, "source_payloads").select("file_id", "prev_file_id", "body").collect()]
    got = [tuple(r) for r in QUERIES["p2_found"](spark, sf).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def payload(fields, records):
    return json.dumps({"result": {"records": records} | ({} if fields is None else {"fields": [{"id": i, "type": t} for i, t in fields]})})


def test_odd_files(spark):
    ten = [{"_id": i, "a": str(i), "b": "x"} for i in range(10)]
    rows = [
        (1, "s", "r", None, payload([("_id", "int4"), ("a", "text"), ("b", "text")], ten)),
        (2, "s", "r", 1, payload([("_id", " INT4 "), ("c", "numeric"), ("b", "text"), (None, "text")], [{"_id": r["_id"], "c": f"{r['a']}.0" if r["_id"] else 77, "b": "x"} for r in ten])),
        (3, "s", "r", 2, payload(None, [{"_id": 1, "c": None, "sub": [{"_id": 5, "d": 1}]}])),
        (4, "s", "r", 1, payload([("_id", "int4"), ("a", "text"), ("b", "text")], ten)),
        (5, "s", "r", 99, payload([], [])),
        (6, "s", "r", 3, None),
    ]
    payloads = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAYLOADS)
    report = drift.changes(payloads, drift.ingest_payloads(payloads))
    got = sorted((r.file_id, r.field_id, r.change_kind) for r in report.collect())
    assert got == [(2, "c", "renamed"), (2, "c", "retyped"), (3, "b", "removed"), (3, "d", "added"), (6, "_id", "removed"), (6, "c", "removed"), (6, "d", "removed")]
    assert drift.changes(payloads.limit(0), drift.ingest_payloads(payloads.limit(0))).count() == 0


def test_rescue_keeps_every_value_and_promotes(spark):
    old = [{"_id": i, "2021": str(100 + i), "DataSeries": f"s{i}"} for i in range(10)]
    new = [{"_id": i, "2021 revised": f"{100 + i}", "DataSeries": f"s{i}", "Note": "n", "2020": "n/k" if i else "1e3"} for i in range(10)]
    payloads = spark.createDataFrame([(1, "s", "r", None, payload(None, old), "", ""), (2, "s", "r", 1, payload(None, new), "", "")], PAYLOADS)
    ingested = drift.ingest_payloads(payloads)
    row = ingested.where("file_id = 2 and record_id = 3").first()
    assert row.y2021 is None and json.loads(row._rescued) == {"2021 revised": "103", "Note": "n", "2020": "n/k"}
    done = drift.promote(ingested, drift.history(payloads, ingested), {"Note": ("note", "string")}).where("file_id = 2 and record_id = 3").first()
    assert (int(done.y2021), done.note, json.loads(done._rescued)) == (103, "n", {"2020": "n/k"})


def test_chains_of_renames(spark):
    names = ["DataSeries", "data_series", "data series", "DATA SERIES2", "data series2_new", "Series (r)", "data_series"]
    bodies = [payload(None, [{"_id": i, n: f"s{i}"} for i in range(10)]) for n in names]
    payloads = spark.createDataFrame([(k, "s", "r", k - 1 if k else None, b, "", "") for k, b in enumerate(bodies)], PAYLOADS)
    ingested = drift.ingest_payloads(payloads)
    done = drift.promote(ingested, drift.history(payloads, ingested)).select("file_id", "record_id", "data_series", "_rescued").collect()
    assert sorted(tuple(r) for r in done) == [(k, i, f"s{i}", None) for k in range(len(names)) for i in range(10)]


def test_every_year_is_typed(spark):
    names = [("1950", "2009", "2027"), ("1950 (r)", "2009_p", "FY2027")]
    bodies = [payload(None, [{"_id": i} | {n: str(100 * k + i) for k, n in enumerate(ns)} for i in range(10)]) for ns in names]
    payloads = spark.createDataFrame([(k, "s", "r", k - 1 if k else None, b, "", "") for k, b in enumerate(bodies)], PAYLOADS)
    ingested = drift.ingest_payloads(payloads)
    further = drift.further_years(ingested)
    assert further == {"2027": ("y2027", drift.COUNT)} and drift.further_years(ingested.limit(0)) == {}
    done = drift.promote(ingested, drift.history(payloads, ingested), further).select("file_id", "record_id", "y1950", "y2009", "y2027", "_rescued").collect()
    assert sorted(tuple(r) for r in done) == [(f, i, i, 100 + i, 200 + i, None) for f in range(2) for i in range(10)]


def one_file(spark, records):
    return drift.ingest_payloads(spark.createDataFrame([(1, "s", "r", None, payload(None, records), "", "")], PAYLOADS))


def past(spark, *rows):
    """(file, prev, id, kind, old id) as the history of a resource."""
    schema = "file_id long, prev_file_id long, field_id string, change_kind string, old_id string"
    return spark.createDataFrame(list(rows), schema)


def test_conflicting_aliases_lose_nothing(spark):
    records = [{"_id": "A12", "2025": "5", "Y2025": "77"}, {"_id": 2, "Yb": "1", "Y2025": "2"}, {"_id": 3, "Yb": "n/k", "Y2025": "3"}, {"_id": 4, "2025": "x", "Yb": "4"}]
    renamed = past(spark, (1, 0, "Y2025", "renamed", "2025"), (1, 0, "Yb", "renamed", "2025"))
    done = drift.promote(one_file(spark, records), renamed).orderBy("record_no").collect()
    assert [None if r.y2025 is None else int(r.y2025) for r in done] == [5, 2, 3, 4]
    assert [json.loads(r._rescued) if r._rescued else None for r in done] == [{"_id": "A12", "Y2025": "77"}, {"Yb": "1"}, {"Yb": "n/k"}, {"2025": "x"}]
    assert [r.record_id for r in done] == [None, 2, 3, 4]


def test_reused_id_is_no_alias(spark):
    bodies = [{"2025": 1}, {"Y": 1}, {"Z": 1}, {"Z": 1, "Y": 900}, {"2025": 1, "Y": 901}]
    rows = [(k, "s", "r", k - 1 if k else None, payload(None, [{"_id": i} | {n: v + i for n, v in b.items()} for i in range(10)]), "", "") for k, b in enumerate(bodies)]
    payloads = spark.createDataFrame(rows, PAYLOADS)
    ingested = drift.ingest_payloads(payloads)
    done = drift.promote(ingested, drift.history(payloads, ingested)).where("record_id = 3").orderBy("file_id").collect()
    assert [int(r.y2025) for r in done] == [4, 4, 4, 4, 4]
    assert [json.loads(r._rescued) if r._rescued else None for r in done] == [None, None, None, {"Y": "903"}, {"Y": "904"}]


def test_typed_and_rescued_are_the_members(spark):
    rng = random.Random(11)
    ids = ["2025", "2024", "DataSeries", "Ya", "Yb", "Yc", "Note", "_id"]
    records = [{i: rng.choice(["1", "2.50", "+3", "n/k", "", "12345678901234567890", "7\n", None]) for i in rng.sample(ids, rng.randint(0, 8))} for _ in range(300)]
    renamed = past(spark, (1, 0, "Ya", "renamed", "2025"), (1, 0, "Yb", "renamed", "2025"), (1, 0, "Yc", "renamed", "2024"), (1, 0, "Note", "added", None))
    for row in drift.promote(one_file(spark, records), renamed, {"Note": ("note", "string")}).collect():
        before = records[row.record_no]
        rest = json.loads(row._rescued) if row._rescued else {}
        assert all(before.get(k, 0) == v for k, v in rest.items())
        taken = {k: v for k, v in before.items() if k not in rest}
        typed = {"2025": row.y2025, "2024": row.y2024, "DataSeries": row.data_series, "Note": row.note, "_id": row.record_id}
        to = {"Ya": "2025", "Yb": "2025", "Yc": "2024"}
        assert {to.get(k, k) for k in taken} == {k for k, v in typed.items() if v is not None} and len(taken) == len({to.get(k, k) for k in taken})
        for k, v in taken.items():
            have = typed[to.get(k, k)]
            assert have == v if isinstance(have, str) else float(have) == float(v)


def test_files_that_name_each_other(spark):
    circle = past(spark, (1, 2, "a", "kept", "a"), (2, 1, "a", "kept", "a"), (2, 1, "b", "renamed", "2025"))
    assert [tuple(r) for r in drift.aliases_of(circle, ["2025"]).collect()] == [(2, "b", "2025")]
