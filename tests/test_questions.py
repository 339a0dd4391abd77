from pyspark.sql import functions as F

from tallyspan.operators import decisions, questions

UNITS = "evidence_id string, geography_level string, place string, area string, year int, sex string, age_group string, series string, status string, value double"


def units(spark):
    rows = [(f"n:{s}:{y}", "national", "Talmera", None, y, None, None, s, "observed", float(v)) for s, y, v in (("Resident Population", 2019, 90), ("Resident Population", 2020, 100), ("Total Population", 2020, 300))]
    for level, place, area, base in (("planning_region", "East Region", None, 50), ("planning_area", "Ash Hill", None, 20), ("planning_area", "Oak", None, 8), ("subzone", "Oak", "Oak", 3), ("subzone", "Ash Hill North", "Ash Hill", 5)):
        for year in (2019, 2020) if level == "planning_region" else (2020,):
            for sex, k in (("Total", 2), ("Male", 1), ("Female", 1.5)):
                for age, m in (("Total", 10), ("0 - 4 Years", 4), ("5 - 9 Years", 5), ("90 Years & Over", 1)):
                    gone = place == "Ash Hill" and sex == "Male" and age == "5 - 9 Years"
                    value = None if gone else float(base * k * m + (year - 2019))
                    rows.append((f"{level}:{place}:{year}:{sex}:{age}", level, place, area, year, sex, age, None, "not_available" if gone else "observed", value))
    return spark.createDataFrame(rows, UNITS)


ASKED = {
    1: "How many residents were there in Ash Hill North in 2020?",
    2: "How many residents aged 0 to 9 lived in Ash Hill in 2020?",
    3: "How many male residents aged 5 to 9 lived in Ash Hill in 2020?",
    4: "How many residents aged 3 to 9 lived in Ash Hill in 2020?",
    5: "How many residents lived in Oak in 2020?",
    6: "How many residents lived in the planning area Oak in 2020?",
    7: "Which subzone had the most residents in 2020?",
    8: "What was the Total Population in 2020?",
    9: "How many residents lived in Ash Hill in 2031?",
    10: "What is the income in Ash Hill in 2020?",
    11: "How did residents of East Region change from 2019 to 2020, and why did they fall?",
    12: "How many male and female residents lived in the subzone Ash Hill North in 2020?",
    13: "Predict the residents of Ash Hill in 2020, and tell a joke",
    14: "Why did East Region have lower counts of residents in 2020 than in 2019?",
    15: "What was the underlying change of residents of East Region between 2019 and 2020?",
    16: "How many residents lived in the subzone Ash Hill in 2020?",
}


def plan(spark):
    texts = spark.createDataFrame([*ASKED.items(), (90, None), (91, "")], "text_id long, question string")
    u = units(spark)
    asked = questions.interpret(texts, u)
    found = questions.evidence(asked, u)
    whole = questions.support(asked, found, u)
    clauses = texts.select("text_id", decisions.first_clause(F.col("question")).alias("question")).where("question is not null")
    c_asked = questions.interpret(clauses, u)
    c_found = questions.evidence(c_asked, u)
    decided = decisions.decide(whole, questions.support(c_asked, c_found, u), decisions.premises(whole, found))
    return found, c_found, decided


def test_decisions_and_facts(spark):
    found, c_found, decided = plan(spark)
    got = {r.text_id: r for r in decided.collect()}
    support = {i: (got[i].support, got[i].n_expected, got[i].n_found) for i in got}
    assert support[1] == ("SUPPORTED", 1, 1) and support[2] == ("SUPPORTED", 2, 2) and support[3] == ("UNAVAILABLE", 1, 1)
    assert support[4][0] == "UNSUPPORTED" and not got[4].is_exact
    assert support[5] == ("AMBIGUOUS", 0, 2) and got[5].reasons == ["AMBIGUOUS_GEOGRAPHY"] and support[6] == ("SUPPORTED", 1, 1)
    assert support[7] == ("SUPPORTED", 2, 2) and got[7].all_at_level and support[8] == ("SUPPORTED", 1, 1)
    assert got[9].reasons == ["REQUESTED_YEAR_UNAVAILABLE", "MISSING_REQUIRED_OPERANDS"] and got[16].is_mismatch
    labels = {i: r.label for i, r in got.items()}
    assert [labels[i] for i in (1, 3, 10, 13)] == ["ANSWERABLE", "INSUFFICIENT_EVIDENCE", "OUT_OF_SCOPE", "PARTIALLY_ANSWERABLE"]
    assert labels[11] == "PARTIALLY_ANSWERABLE" and got[11].decision_reasons == ["EVIDENCE_COMPLETE", "CAUSAL_EVIDENCE_MISSING", "BOUNDARY_DEFINITION_CHANGE", "FALSE_PREMISE", "PARTIAL_SUPPORT"]
    assert (got[14].relation, got[14].actual) == ("decrease", "decrease") and "FALSE_PREMISE" not in got[14].decision_reasons
    assert labels[15] == "PARTIALLY_ANSWERABLE" and labels[90] == labels[91] == "INSUFFICIENT_EVIDENCE"
    facts = {r.text_id: r for r in decisions.compute(decisions.supported_operands(decided, found, c_found), decided).collect()}
    assert set(facts) == {i for i, r in got.items() if any(c.support == "SUPPORTED" for c in r.claims)}
    assert (facts[1].operation, facts[1].numeric) == ("lookup", 101.0) and (facts[2].operation, facts[2].numeric) == ("sum", 20 * 2 * 9 + 2.0)
    assert (facts[7].operation, facts[7].winner, facts[7].numeric) == ("argmax", "subzone:Ash Hill North:2020:Total:Total", 101.0)
    assert (facts[11].operation, facts[11].numeric) == ("trend", 1.0) and (facts[12].winner, facts[12].numeric) == ("second", 25.0)
    assert all(r.fact_id.startswith("fact-") and r.fault is None for r in facts.values())


def test_faulty_operands(spark):
    asked = spark.createDataFrame([(i, [], [], op) for i, op in ((1, "difference"), (2, "argmax"), (3, "sum"), (4, "comparison"))], "text_id long, places array<struct<place:string>>, sexes array<string>, evidence_operation string")
    rows = [(1, n, f"e{n}", 2020, None, "x", float(n)) for n in range(3)] + [(2, 1, "a", 2020, None, "x", 5.0), (2, 2, "b", 2020, None, "y", 5.0), (3, 1, "a", 2020, None, "x", None), (3, 2, "b", 2020, None, "x", 1.0), (4, 1, "a", 2020, None, "x", 7.0)]
    operands = spark.createDataFrame(rows, "text_id long, position int, evidence_id string, year int, sex string, place string, value double")
    got = {r.text_id: (r.operation, r.fault, r.numeric) for r in decisions.compute(operands, asked).collect()}
    assert got == {1: ("difference", "operands", None), 2: ("argmax", "tied", None), 3: ("sum", "not_observed", None), 4: ("lookup", None, 7.0)}


def test_no_questions_no_units(spark):
    texts = spark.createDataFrame([(1, "How many residents in Oak in 2020?")], "text_id long, question string")
    u = units(spark)
    assert questions.interpret(texts.limit(0), u).count() == 0
    bare = questions.interpret(texts, u.limit(0))
    assert [(r.measure_status, r.places) for r in bare.collect()] == [("unknown", [])] and questions.evidence(bare, u.limit(0)).count() == 0


def test_first_clause(spark):
    asked = ["It rose, and why then?", "How many, and whyever", "A, and B", "a, AND  had it", None]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, q string")
    assert [r[0] for r in df.orderBy("i").select(decisions.first_clause(F.col("q"))).collect()] == ["It rose", None, None, "a", None]
