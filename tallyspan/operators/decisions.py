"""Decisions on questions, and the facts computed from what supports them.

A question is cut into claims: what it describes, the cause, forecast or foreign
attribute that it asks for as well, and a change across redrawn boundaries.  Each
claim has its support and reasons; the label of the question follows from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspan.functions import text
from tallyspan.operators import facts
from tallyspan.operators.questions import any_phrase

# Attributes outside the data, and words of a forecast; of the
# attributes that stand in a question the first one names it.
OUTSIDE = (
    "household income", "income", "school quality", "schools", "school", "education", "health", "housing price", "resale price", "hdb price", "employment", "unemployment",
    "ethnicity", "life expectancy", "household size", "election", "voted", "opinion",
)
FORECAST = ("forecast", "predict", "prediction", "project", "projection", "estimate for")
# What asks for a change that is free of the redrawn boundaries.
UNDERLYING = ("truly change", "true change", "actual change", "underlying change", "directly comparable")
_UNDERLYING = r"(?:^| )(?:true|actual|underlying)(?: [^ ]+){0,2} change(?: |\z)"
# Words of a fall, a rise and a larger number in a premise.
FALL, RISE, MORE = ("fall", "fell", "decline", "decrease", "lower"), ("rise", "rose", "increase", "grew", "higher"), ("more", "outnumber")

# A second clause opens with a question word, an auxiliary or a request.
QUESTION_WORDS = ("why", "what", "how", "which", "who", "whether")
AUXILIARIES = ("had", "has", "have", "did", "does", "would", "will", "could")
REQUESTS = ("explain", "say", "tell", "forecast", "predict", "project")
FIRST_CLAUSE = r"(?is)^(.*?), *and +(?:" + "|".join(QUESTION_WORDS + AUXILIARIES + REQUESTS) + r")(?: |\z)"

#: Years of other boundaries: the last of the old ones, the first of the new ones.
OLD_BOUNDARIES, NEW_BOUNDARIES = 2019, 2020


def first_clause(question: Column) -> Column:
    """What stands before ``, and`` and a second clause; null without one."""
    clause = F.trim(F.regexp_extract(question, FIRST_CLAUSE, 1), F.lit(" ,"))
    return F.when(clause != "", clause)


def outside_attribute(words: Column) -> Column:
    """The attribute outside the data that plain words name first; null for none."""
    return F.coalesce(*(F.when(text.has_phrase(words, t), t) for t in OUTSIDE))


def premises(asked: DataFrame, found: DataFrame) -> DataFrame:
    """(text_id, relation, actual): the premise of each question for a cause.

    A rise or fall is checked between the first two years in order of mention; a
    larger number between the first two places, else the first two sexes, by
    sums over the observed values.  Questions without a premise have no row.
    """
    words = F.col("words")
    rows = asked.where("is_causal").select("text_id", "words", "years", "places", "sexes")
    wanted = F.when(any_phrase(words, FALL), "decrease").when(any_phrase(words, RISE), "increase")
    two_places, two_sexes = F.size("places") >= 2, F.size("sexes") >= 2
    at = lambda column, i: F.get(column, F.lit(i))
    rows = rows.withColumns(
        {
            "wanted": F.when(F.size("years") >= 2, wanted),
            "year_1": at("years", 0), "year_2": at("years", 1),
            "more": any_phrase(words, MORE) & (two_places | two_sexes),
            "side_1": F.when(two_places, at("places", 0)["place"]).otherwise(at("sexes", 0)),
            "side_2": F.when(two_places, at("places", 1)["place"]).otherwise(at("sexes", 1)),
            "by_place": two_places,
        }
    ).where("wanted is not null or more")
    values = found.where("value is not null").select("text_id", "year", "place", "sex", "value").join(rows.drop("words", "years", "places", "sexes"), "text_id")
    side = F.when(F.col("by_place"), F.col("place")).otherwise(F.col("sex"))
    total = lambda when: F.sum(F.when(when, F.col("value")))
    sums = values.groupBy("text_id", "wanted", "more", "side_1", "side_2").agg(
        total(F.col("year") == F.col("year_1")).alias("y1"), total(F.col("year") == F.col("year_2")).alias("y2"), total(side == F.col("side_1")).alias("s1"), total(side == F.col("side_2")).alias("s2")
    )
    temporal = F.col("wanted").isNotNull() & F.col("y1").isNotNull() & F.col("y2").isNotNull()
    entity = F.col("more") & F.col("s1").isNotNull() & F.col("s2").isNotNull()
    change = F.when(F.col("y2") > F.col("y1"), "increase").when(F.col("y2") < F.col("y1"), "decrease").otherwise("equal")
    sums = sums.withColumns(
        {
            "relation": F.when(temporal, F.col("wanted")).when(entity, "greater"),
            "actual": F.when(temporal, change).when(entity, F.when(F.col("s1") > F.col("s2"), "greater").otherwise("not_greater")),
        }
    )
    return sums.where("relation is not null").select("text_id", "relation", "actual")


def decide(whole: DataFrame, clause: DataFrame, premise: DataFrame) -> DataFrame:
    """Claims and label of each question.

    ``whole`` is of ``questions.support``, ``clause`` the same of the first
    clauses under their questions' text_id, ``premise`` of :func:`premises`.
    Adds to ``whole``: claims (array of kind, part, support, reasons), label and
    decision_reasons (distinct, in the order in which they arise).
    """
    clauses = clause.select("text_id", F.lit(True).alias("has_clause"), F.col("support").alias("clause_support"))
    rows = whole.join(clauses, "text_id", "left").join(premise, "text_id", "left")
    words = F.col("words")
    outside, forecast = outside_attribute(words).isNotNull(), any_phrase(words, FORECAST)
    underlying = any_phrase(words, UNDERLYING) | words.rlike(_UNDERLYING)
    causal, has_clause = F.col("is_causal"), F.coalesce("has_clause", F.lit(False))
    good, clause_good = F.col("support") == "SUPPORTED", F.coalesce(F.col("clause_support") == "SUPPORTED", F.lit(False))
    crossing = F.coalesce(F.col("level") == "planning_region", F.lit(False)) & F.array_contains("years", OLD_BOUNDARIES) & F.exists("years", lambda y: y >= NEW_BOUNDARIES)

    claim = lambda kind, part, support, reasons: F.struct(F.lit(kind).alias("kind"), F.lit(part).alias("part"), support.alias("support"), reasons.alias("reasons"))
    lacking = lambda kind, support, reason: claim(kind, "whole", F.lit(support), F.array(F.lit(reason)))
    described = claim("descriptive", "whole", F.col("support"), F.col("reasons"))
    from_clause = claim("descriptive", "clause", F.lit("SUPPORTED"), F.array(F.lit("EVIDENCE_COMPLETE")))
    independent = (~causal & ~forecast & ~outside) | (causal & has_clause) | underlying
    answered = independent & good
    open_ = ~good & ~outside & ~forecast
    claims = F.array_compact(
        F.array(
            F.when(answered, described),
            F.when(open_ & clause_good, from_clause),
            F.when(open_ & ~(causal & clause_good), described),
            F.when(causal, lacking("causal", "UNSUPPORTED", "CAUSAL_EVIDENCE_MISSING")),
            F.when(forecast & clause_good & ~answered, from_clause),
            F.when(forecast, lacking("forecast", "UNSUPPORTED", "PREDICTION_REQUESTED")),
            F.when(outside & clause_good, from_clause),
            F.when(outside, lacking("out_of_domain", "OUT_OF_SCOPE", "UNSUPPORTED_ATTRIBUTE")),
            F.when(underlying & crossing, lacking("underlying_change", "UNSUPPORTED", "BOUNDARY_DEFINITION_CHANGE")),
        )
    )
    nothing = F.array(lacking("descriptive", "UNSUPPORTED", "QUERY_NOT_RESOLVED"))
    rows = rows.withColumn("claims", F.when(F.size(claims) > 0, claims).otherwise(nothing))
    is_good = lambda c: c["support"] == "SUPPORTED"
    label = (
        F.when(F.forall("claims", is_good), "ANSWERABLE").when(F.exists("claims", is_good), "PARTIALLY_ANSWERABLE")
        .when(F.forall("claims", lambda c: c["support"] == "OUT_OF_SCOPE"), "OUT_OF_SCOPE").otherwise("INSUFFICIENT_EVIDENCE")
    )
    rows = rows.withColumn("label", label)
    further = F.array_compact(
        F.array(
            F.when(crossing & ~underlying, F.lit("BOUNDARY_DEFINITION_CHANGE")),
            F.when(F.col("actual") != F.col("relation"), F.lit("FALSE_PREMISE")),
            F.when(F.col("label") == "PARTIALLY_ANSWERABLE", F.lit("PARTIAL_SUPPORT")),
        )
    )
    reasons = F.array_distinct(F.concat(F.flatten(F.transform("claims", lambda c: c["reasons"])), further))
    return rows.withColumn("decision_reasons", reasons).drop("has_clause", "clause_support")


def supported_operands(decided: DataFrame, whole: DataFrame, clause: DataFrame) -> DataFrame:
    """(text_id, position, evidence columns): the evidence of the supported claims.

    ``whole`` and ``clause`` are the ranked evidence of the questions and of
    their first clauses.  An observation of both counts once, where it is first.
    """
    parts = decided.select("text_id", F.explode(F.filter("claims", lambda c: c["support"] == "SUPPORTED")).alias("c")).select("text_id", F.col("c.part").alias("part")).distinct()
    # Of the two parts at most one stands first: claims of a clause come after.
    both = whole.withColumn("part", F.lit("whole")).unionByName(clause.withColumn("part", F.lit("clause")))
    rows = both.join(parts, ["text_id", "part"])
    rows = rows.withColumn("_at", F.struct((F.col("part") == "clause").alias("later"), "rank"))
    once = rows.groupBy("text_id", "evidence_id").agg(F.min_by(F.struct(*(c for c in rows.columns if c not in ("text_id", "evidence_id"))), "_at").alias("r")).select("text_id", "evidence_id", "r.*")
    return once.withColumn("position", F.row_number().over(Window.partitionBy("text_id").orderBy("_at"))).drop("_at", "part", "rank")


def compute(operands: DataFrame, asked: DataFrame) -> DataFrame:
    """The fact that the operands of each question give, by its operation.

    ``operands`` is of :func:`supported_operands`, ``asked`` has text_id, places,
    sexes and evidence_operation.  Operands of a difference, comparison or trend
    are ordered by year, if there are several, else by place and sex in order of
    mention.  A single operand is looked up whatever was asked.  Result: text_id,
    operation, fault (null; else not_observed, operands or tied), n_operands,
    fact_id, numeric, winner (first, second, equal, or the evidence id of a
    maximum), evidence_ids.
    """
    rows = operands.join(asked.select("text_id", "places", "sexes", "evidence_operation"), "text_id")
    years = F.size(F.collect_set("year").over(Window.partitionBy("text_id")))
    n = F.count("*").over(Window.partitionBy("text_id"))
    rows = rows.withColumns({"_years": years, "n_operands": n})
    rows = rows.withColumn("operation", F.when(F.col("n_operands") == 1, "lookup").otherwise(F.col("evidence_operation")))
    pairwise = F.col("operation").isin("difference", "comparison", "trend")
    last = F.lit(1 << 30)
    index = lambda found: F.when(found == 0, last).otherwise(found)
    place_no = index(F.array_position(F.transform("places", lambda p: p["place"]), F.coalesce("place", F.lit(""))).cast("int"))
    sex_no = index(F.array_position("sexes", F.coalesce("sex", F.lit(""))).cast("int"))
    order = (
        F.when(pairwise & (F.col("_years") > 1), F.struct(F.col("year").alias("a"), F.lit(0).alias("b"), F.col("evidence_id").alias("c")))
        .when(pairwise, F.struct(place_no.alias("a"), sex_no.alias("b"), F.col("evidence_id").alias("c")))
        .otherwise(F.struct(F.col("position").alias("a"), F.lit(0).alias("b"), F.lit("").alias("c")))
    )
    operand = F.struct(order.alias("o"), "evidence_id", "year", "value")
    # The operands of a question: those that it names, or one for each place of a level.
    whole = rows.groupBy("text_id", "operation", "n_operands").agg(
        F.array_sort(F.collect_list(operand)).alias("ops"), F.sum("value").alias("total"), F.max("value").alias("most"), F.count_if(F.col("value").isNull()).alias("n_missing")
    )
    first, second = F.get("ops", F.lit(0)), F.get("ops", F.lit(1))
    op = F.col("operation")
    at_most = F.filter("ops", lambda x: x["value"] == F.col("most"))
    fault = (
        F.when(F.col("n_missing") > 0, "not_observed")
        .when((op == "lookup") & (F.col("n_operands") != 1), "operands")
        .when(op.isin("difference", "comparison", "trend") & (F.col("n_operands") != 2), "operands")
        .when((op == "argmax") & (F.size(at_most) != 1), "tied")
    )
    later = F.when(first["year"] != second["year"], second["value"] - first["value"]).otherwise(first["value"] - second["value"])
    numeric = F.when(op == "lookup", first["value"]).when(op == "sum", F.col("total")).when(op.isin("difference", "trend"), later).when(op == "comparison", second["value"] - first["value"]).when(op == "argmax", F.col("most"))
    larger = F.when(first["value"] > second["value"], "first").when(second["value"] > first["value"], "second").otherwise("equal")
    whole = whole.withColumns({"fault": fault, "evidence_ids": F.transform("ops", lambda x: x["evidence_id"])})
    winner = F.when(op == "comparison", larger).when(op == "argmax", F.get(at_most, F.lit(0))["evidence_id"])
    sound = F.col("fault").isNull()
    return whole.select(
        "text_id", "operation", "fault", "n_operands", F.when(sound, facts.fact_id(op, F.col("evidence_ids"))).alias("fact_id"), F.when(sound, numeric).alias("numeric"), F.when(sound, winner).alias("winner"), "evidence_ids"
    )
