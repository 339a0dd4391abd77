"""Queries for answers, policies and payload checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspan.functions import text
from tallyspan.operators import answers, decisions, drift, metrics, nested
from tallyspan.plans import evaluation_queries as ev, nested_sql, observation_queries as oq
from tallyspan.session import table
from tallyspan.sources import payloads, registry

# The message for each state of the evidence.
MESSAGES = {
    "missing": "The published tables have no row for this question.",
    "not_available": "The value was not available.",
    "inexact_age": "The published age groups do not match the ages asked for.",
    "no_age": "The question names no ages.",
}


def payload_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Envelope checks of every payload."""
    return payloads.payload_checks(table(spark, sf, "source_payloads"))


def field_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Declared payload fields that their source does not expect."""
    rows = table(spark, sf, "source_payloads")
    return registry.field_faults(drift.file_fields(rows).join(rows.select("file_id", "source_id"), "file_id"))


def claim_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Label of each example by its claims: all, some or none of them supported."""
    claims = nested.flatten_claims(table(spark, sf, "qa_examples")).withColumn("good", F.coalesce(F.lower("supported") == "true", F.lit(False)))
    label = F.when(F.bool_and("good"), "ANSWERABLE").when(F.bool_or("good"), "PARTIALLY_ANSWERABLE").otherwise("INSUFFICIENT_EVIDENCE")
    return claims.groupBy("example_id").agg(F.count("*").alias("n_claims"), label.alias("label"))


def question_domains(spark: SparkSession, sf: str) -> DataFrame:
    """Attribute outside the data, forecast word and first clause of questions."""
    words = F.concat(F.lit(" "), text.phrase(F.col("question")), F.lit(" "))
    first = lambda terms: F.get(F.filter(F.array(*map(F.lit, terms)), lambda t: words.contains(F.concat(F.lit(" "), t, F.lit(" ")))), F.lit(0))
    clause = decisions.first_clause(F.col("question"))
    rows = table(spark, sf, "qa_examples").where("question is not null")
    return rows.select("example_id", first(decisions.OUTSIDE).alias("attribute"), first(decisions.FORECAST).alias("forecast"), clause.alias("first_clause"))


def claim_support(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the numbers of each claim follow from its evidence."""
    examples = table(spark, sf, "qa_examples")
    values = oq.latest(spark, sf).where("value is not null")
    links = nested.flatten_evidence(examples).withColumn("evidence_id", F.lower(F.trim("evidence_id")))
    return answers.supported_claims(nested.flatten_claims(examples), links, values)


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    questions = table(spark, sf, "qa_examples").where("question is not null").select("example_id", "question", metrics.label(F.col("answerability")).alias("gold"))
    status = oq.support_status(spark, sf).select("example_id", "status")
    return questions.join(status, "example_id", "left").withColumn("status", F.coalesce("status", F.lit("no_age")))


def answers_or_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The checked answer of each supported question, a reason for the others."""
    decided = _decided(spark, sf)
    facts = answers.evidence_facts(oq.question_evidence(spark, sf))
    made = answers.validated(answers.generate(decided.where("status = 'supported'").join(facts, "example_id")))
    made = made.where("is_exact and new_numbers = 0").select("example_id", "answer")
    reason = F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair))[F.col("status")]
    return decided.join(made, "example_id", "left").select("example_id", "status", F.coalesce("answer", reason).alias("response"))


def policy_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage and abstention of three policies: always answer, answer where any
    evidence is found, answer where the evidence is complete."""
    decided = _decided(spark, sf).where("gold is not null")
    found = oq.question_evidence(spark, sf).select("example_id").distinct().withColumn("found", F.lit(True))
    rows = decided.join(found, "example_id", "left")
    policy = F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), c.alias("answers")) for n, c in (("always", F.lit(True)), ("any_evidence", F.coalesce("found", F.lit(False))), ("complete_evidence", F.col("status") == "supported")))))
    rows = rows.select("example_id", F.col("gold").isin(*metrics.ABSTAIN).alias("should_abstain"), policy.alias("p")).select("should_abstain", "p.*")
    return rows.groupBy("policy").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("answers")).alias("n_answered"),
        F.count_if(~F.col("answers") & F.col("should_abstain")).alias("n_abstained_rightly"),
        F.count_if(F.col("answers") & F.col("should_abstain")).alias("n_unsafe"),
    )


QUERIES = {f.__name__: f for f in (payload_checks, field_faults, question_domains, claim_labels, claim_support, answers_or_reasons, policy_summary)}

_DECIDED = f"""{ev._P.replace("p AS (", "WITH p AS (", 1)}, st AS ({oq.ORACLES["support_status"]}), ev AS ({oq.ORACLES["question_evidence"]}),
  decided AS (SELECT q.example_id, q.question, p.gold, coalesce(st.status, 'no_age') AS status FROM qa_examples q JOIN p USING (example_id) LEFT JOIN st USING (example_id) WHERE q.question IS NOT NULL)"""
_REASON = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in MESSAGES.items())
_FIRST = lambda terms: "list_filter([" + ", ".join(f"'{t}'" for t in terms) + "], lambda t: contains(w, ' ' || t || ' '))[1]"
ORACLES = {
    "claim_labels": nested_sql.CLAIM_LABELS,
    "question_domains": f"""WITH q AS (SELECT example_id, question, ' ' || {ev._PHRASE.format("question")} || ' ' AS w FROM qa_examples WHERE question IS NOT NULL)
        SELECT example_id, {_FIRST(decisions.OUTSIDE)} AS attribute, {_FIRST(decisions.FORECAST)} AS forecast,
          nullif(trim(regexp_extract(question, '(?is)^(.*?), *and +(?:{"|".join(decisions.QUESTION_WORDS + decisions.AUXILIARIES + decisions.REQUESTS)})(?: |$)', 1), ' ,'), '') AS first_clause FROM q""",
    "answers_or_reasons": f"""{_DECIDED}, f AS (SELECT example_id, string_agg(evidence_id || ' = ' || CASE WHEN value = floor(value) THEN format('{{:,}}', CAST(value AS BIGINT)) ELSE regexp_replace(format('{{:,.6f}}', value), '\\.?0+$', '') END, '; ' ORDER BY rank) AS facts
          FROM ev WHERE value IS NOT NULL GROUP BY example_id)
        SELECT example_id, status, CASE WHEN status = 'supported' THEN facts ELSE CASE status {_REASON} END END AS response FROM decided LEFT JOIN f USING (example_id)""",
    "policy_summary": f"""{_DECIDED}, r AS (SELECT gold IN {ev._ABSTAIN} AS s, status, example_id IN (SELECT example_id FROM ev) AS found FROM decided WHERE gold IS NOT NULL),
        x AS (SELECT s, unnest([{{'policy': 'always', 'a': true}}, {{'policy': 'any_evidence', 'a': found}}, {{'policy': 'complete_evidence', 'a': status = 'supported'}}]) AS p FROM r)
        SELECT p.policy AS policy, count(*) AS n, count(*) FILTER (WHERE p.a) AS n_answered, count(*) FILTER (WHERE NOT p.a AND s) AS n_abstained_rightly, count(*) FILTER (WHERE p.a AND s) AS n_unsafe FROM x GROUP BY 1""",
}
