"""Questions as data: what each names, the observations that answer it, and how
far these carry.

All of it is columns over a table of questions and joins to the observations:
names of places and series are found by joins, years, ages and sexes by
expressions, and evidence by equality of all dimensions asked for.  Hot places or
years only make rows of the result, which are spread like any join's.

Defined cases: a null question names nothing; a name of several levels is
ambiguous unless the question says the level; a question without a year, place or
known measure has no evidence; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspan.functions import text
from tallyspan.operators import facts
from tallyspan.operators.names import named_spans
from tallyspan.session import materialise

SUBNATIONAL = ("planning_region", "planning_area", "subzone")

# Words that say the level of a place, the first that stands counts.
LEVEL_WORDS = {"subzone": "subzone", "planning area": "planning_area", "planning region": "planning_region", "region": "planning_region"}
# Attributes that no series measures.
UNSUPPORTED = ("household income", "income", "school quality", "schools", "school", "education", "health")
# Other names of the series, where no series is named in full; the
# first that stands counts.
SERIES_WORDS = {
    "permanent residents": "Permanent Resident Population",
    "permanent resident": "Permanent Resident Population",
    "non residents": "Non-Resident Population",
    "non resident": "Non-Resident Population",
    "visitors": "Visiting Population",
    "citizens": "Citizen Population",
    "citizen population": "Citizen Population",
    "residents": "Resident Population",
    "resident": "Resident Population",
    "population": "Total Population",
}
# Phrases that name an operation; the first operation with one counts.
OPERATION_PHRASES = {
    "argmax": ("largest", "highest", "most"),
    "trend": ("how did", "trend", "grown since", "growth since"),
    "difference": ("how many more", "how much", "difference", "change between", "change from"),
}
# Words that ask for a cause.
CAUSE_WORDS = ("why", "cause", "caused", "reason", "reasons")


def any_phrase(words: Column, phrases) -> Column:
    """Whether any of the phrases stands in plain words."""
    found = F.lit(False)
    for phrase in phrases:
        found = found | text.has_phrase(words, phrase)
    return found


def first_phrase(words: Column, table: dict[str, str]) -> Column:
    """What the first phrase of a table that stands in plain words means."""
    return F.coalesce(*(F.when(text.has_phrase(words, phrase), meaning) for phrase, meaning in table.items()))


def operation(words: Column, several: Column, bands: Column | int = 0) -> Column:
    """The operation that plain words ask for: by phrase, else by the number of
    things compared, else by the number of age bands."""
    named = F.coalesce(*(F.when(any_phrase(words, phrases), name) for name, phrases in OPERATION_PHRASES.items()))
    return F.coalesce(named, F.when(several, "comparison").when(F.lit(bands) > 1 if isinstance(bands, int) else bands > 1, "sum").otherwise("lookup"))


def places_of(units: DataFrame) -> DataFrame:
    """(name, level, place, area): every place of the observations, by plain name."""
    rows = units.where("geography_level is not null and place is not null").select(F.col("geography_level").alias("level"), "place", "area").distinct()
    return rows.select(text.phrase(F.col("place")).alias("name"), "level", "place", "area")


def interpret(texts: DataFrame, units: DataFrame) -> DataFrame:
    """What each question asks for.

    ``texts`` has text_id and question; ``units`` is of :func:`units_of`.
    Result: text_id, words, measure_status (resolved, unsupported, unknown),
    measure, years, level, places (array of level, place, area in order of
    mention), is_ambiguous, is_mismatch (a level with a name of another one),
    all_at_level, age (kind, low, high), bands, is_exact, sexes, is_subnational,
    evidence_operation, is_causal.
    """
    asked = materialise(texts.select("text_id", "question", text.phrase(F.coalesce("question", F.lit(""))).alias("words")))
    places = places_of(units)
    candidates = places.groupBy("name").agg(F.collect_set(F.struct("level", "place", "area")).alias("found"))
    spans = named_spans(asked, "text_id", "words", candidates, ["found"])
    each = spans.select("text_id", "start", F.explode("found").alias("f")).groupBy("text_id", "f").agg(F.min("start").alias("start"))
    # A text holds few names.
    named = each.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("start", "f.level", "f.place", "f.area"))).alias("named"))

    series = units.where("series is not null").select("series").distinct().select(text.phrase(F.col("series")).alias("name"), "series")
    longest = named_spans(asked, "text_id", "words", series, ["series"]).groupBy("text_id").agg(F.max_by("series", F.struct(F.length("name"), -F.col("start"))).alias("named_series"))
    words = F.col("words")
    rows = asked.join(named, "text_id", "left").join(longest, "text_id", "left")
    # The published series: a few dozen names; of an alias, the first that is published counts.
    published = F.broadcast(series.select(F.lit(1).alias("_one"), "series").groupBy("_one").agg(F.collect_set("series").alias("published")))
    rows = rows.withColumn("_one", F.lit(1)).join(published, "_one", "left").drop("_one")
    alias = F.coalesce(*(F.when(text.has_phrase(words, phrase) & F.array_contains("published", name), name) for phrase, name in SERIES_WORDS.items()))
    measure = F.coalesce("named_series", alias)
    unsupported = any_phrase(words, UNSUPPORTED)
    none = F.array().cast("array<struct<start:int,level:string,place:string,area:string>>")
    rows = rows.withColumns(
        {
            "measure_status": F.when(unsupported, "unsupported").when(measure.isNotNull(), "resolved").otherwise("unknown"),
            "measure": F.when(~unsupported, measure),
            "years": F.coalesce(text.years(F.col("question")), F.array().cast("array<int>")),
            "named": F.coalesce("named", none),
            "explicit": first_phrase(words, LEVEL_WORDS),
        }
    )
    rows = rows.withColumn("places", F.filter("named", lambda p: F.col("explicit").isNull() | (p["level"] == F.col("explicit"))))
    rows = rows.withColumn("_levels", F.array_distinct(F.transform("places", lambda p: p["level"])))
    foreign = F.exists("named", lambda p: p["level"] != "national")
    level = F.when(F.size("_levels") == 1, F.get("_levels", F.lit(0))).when(F.size("_levels") == 0, F.col("explicit"))
    rows = rows.withColumns({"is_ambiguous": F.size("_levels") > 1, "is_mismatch": F.col("explicit").isNotNull() & foreign & (F.size("places") == 0), "level": level})
    below = F.col("level").isin(*SUBNATIONAL) | F.exists("places", lambda p: p["level"] != "national")
    rows = rows.withColumns(
        {
            "all_at_level": F.coalesce(F.col("level") != "national", F.lit(False)) & (F.size("places") == 0) & ~foreign,
            "is_below": F.coalesce(below, F.lit(False)),
            "is_subnational": F.coalesce((F.col("measure") == "Resident Population") & below, F.lit(False)),
            "_age": text.age_constraint(F.col("question")),
            "_sexes": F.coalesce(text.sexes(F.col("question")), F.array().cast("array<string>")),
        }
    )
    total = F.struct(F.lit("total").alias("kind"), F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))
    rows = rows.withColumn("age", F.when(F.col("is_subnational"), F.coalesce("_age", total)).otherwise(F.col("_age")))
    rows = materialise(rows.withColumn("sexes", F.when(F.col("is_subnational") & (F.size("_sexes") == 0), F.array(F.lit("Total"))).otherwise(F.col("_sexes"))))

    bands = units.where("age_group is not null").select("age_group").distinct()
    wanted = rows.where("is_subnational and age.kind <> 'total'").select("text_id", "age.*")
    covered = facts.bands_for(bands, wanted)
    exact = facts.exactness(covered, ["text_id"]).select("text_id", "is_exact")
    lists = covered.groupBy("text_id").agg(F.array_sort(F.collect_list(F.struct("band_low", "age_group"))).alias("_bands")).select("text_id", F.transform("_bands", lambda b: b["age_group"]).alias("_bands"))
    rows = rows.join(lists, "text_id", "left").join(exact, "text_id", "left")
    is_total = F.col("is_subnational") & (F.col("age.kind") == "total")
    rows = rows.withColumns({"bands": F.when(is_total, F.array(F.lit("Total"))).otherwise(F.coalesce("_bands", F.array().cast("array<string>"))), "is_exact": F.coalesce(is_total | F.col("is_exact"), ~F.col("is_subnational"))})
    several = (F.size(F.array_distinct(F.transform("places", lambda p: p["place"]))) > 1) | (F.size("sexes") > 1) | (F.size("years") > 1)
    asked_for = F.when(F.col("measure_status") != "resolved", "unresolved").otherwise(operation(words, several, F.size("bands")))
    columns = ["text_id", "words", "measure_status", "measure", "years", "level", "places", "is_ambiguous", "is_mismatch", "all_at_level", "age", "bands", "is_exact", "sexes", "is_below", "is_subnational"]
    return rows.select(*columns, asked_for.alias("evidence_operation"), any_phrase(words, CAUSE_WORDS).alias("is_causal"))


def evidence(asked: DataFrame, units: DataFrame) -> DataFrame:
    """The observations that meet all that a question asks for, in rank order.

    ``asked`` is of :func:`interpret`.  National counts come from the series
    asked for; counts of smaller places are residents by age and sex.  Result:
    text_id, rank (by year, place and sex in order of mention, age from young to
    old), evidence_id, status, value, year, level, place, area, age_group, sex.
    """
    rows = asked.where((F.col("measure_status") == "resolved") & ~F.col("is_mismatch")).select("*", F.posexplode("years").alias("year_no", "year"))
    # One row without a place for a question that names none.
    rows = rows.select("*", F.posexplode_outer("places").alias("place_no", "p"))
    level = F.coalesce("p.level", "level", F.lit("national"))
    rows = rows.withColumns({"_level": level, "_place": F.col("p.place"), "_area": F.coalesce("p.area", F.lit("")), "place_no": F.coalesce("place_no", F.lit(0))}).drop("p", "level")
    kept = ["evidence_id", "status", "value", "year", "geography_level", "place", "area", "age_group", "sex"]
    orders = ["text_id", "year_no", "place_no", "band_no", "sex_no"]
    national = rows.where("_level = 'national'").select("text_id", "year_no", "place_no", F.lit(0).alias("band_no"), F.lit(0).alias("sex_no"), "year", F.col("measure").alias("series"))
    found = national.join(units.where("series is not null").select("series", *kept), ["series", "year"]).select(*orders, *kept)

    below = rows.where("_level <> 'national' and is_subnational").select("*", F.posexplode("bands").alias("band_no", "age_group")).select("*", F.posexplode("sexes").alias("sex_no", "sex"))
    below = below.select(*orders, "year", "age_group", "sex", F.col("_level").alias("geography_level"), "_place", "_area")
    counts = units.where("series is null").select(*kept, F.col("place").alias("_place"), F.coalesce("area", F.lit("")).alias("_area"))
    keys = ["geography_level", "year", "age_group", "sex"]
    named = below.where("_place is not null").join(counts, [*keys, "_place", "_area"]).select(*orders, *kept)
    whole = below.where("_place is null").drop("_place", "_area").join(counts.drop("_place", "_area"), keys).select(*orders, *kept)
    found = found.unionByName(named).unionByName(whole)
    order = Window.partitionBy("text_id").orderBy("year_no", "place_no", F.lower("place"), "band_no", "sex_no", "evidence_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.select("text_id", "rank", "evidence_id", "status", "value", "year", F.col("geography_level").alias("level"), "place", "area", "age_group", "sex")


def top_evidence(found: DataFrame, k: int) -> DataFrame:
    """The first ``k`` observations of each question."""
    if k < 1:
        raise ValueError("k must be at least 1")
    return found.where(F.col("rank") <= k)


def available_years(units: DataFrame) -> DataFrame:
    """(kind, available): years of each series, and of each level below the nation."""
    kind = F.when(F.col("series").isNotNull(), F.concat(F.lit("series "), "series")).when(F.col("geography_level").isin(*SUBNATIONAL), F.concat(F.lit("level "), "geography_level"))
    return units.select(kind.alias("kind"), "year").where("kind is not null").groupBy("kind").agg(F.collect_set("year").alias("available"))


def support(asked: DataFrame, found: DataFrame, units: DataFrame) -> DataFrame:
    """How far the evidence of each question carries.

    Adds n_expected, n_found, n_unavailable, support (SUPPORTED, UNAVAILABLE,
    UNSUPPORTED, AMBIGUOUS) and reasons to what :func:`interpret` gives.
    """
    counts = found.groupBy("text_id").agg(F.count("*").alias("n_found"), F.count_if(F.col("status") != "observed").alias("n_unavailable"))
    sizes = places_of(units).groupBy("level").agg(F.count_distinct("place", F.coalesce("area", F.lit(""))).alias("n_at_level"))
    first_level = F.coalesce("level", F.when(~F.col("is_ambiguous"), F.get("places", F.lit(0))["level"]), F.lit("national"))
    kind = F.when(first_level == "national", F.concat(F.lit("series "), "measure")).otherwise(F.concat(F.lit("level "), first_level))
    # Levels and series: a few dozen rows.
    rows = asked.join(counts, "text_id", "left").na.fill(0, ["n_found", "n_unavailable"]).join(F.broadcast(sizes), "level", "left")
    rows = rows.withColumn("kind", kind).join(F.broadcast(available_years(units)), "kind", "left")
    n_places = F.when(F.col("all_at_level"), F.coalesce("n_at_level", F.lit(0))).otherwise(F.greatest(F.size("places"), F.lit(1)))
    expected = F.when((F.size("years") == 0) | F.col("is_ambiguous"), 0).otherwise(F.size("years") * n_places * F.when(F.col("is_below"), F.size("bands") * F.size("sexes")).otherwise(1))
    rows = rows.withColumn("n_expected", expected.cast("long"))
    unavailable = F.when(F.col("n_unavailable") > 0, "VALUE_NOT_AVAILABLE")
    missing = (F.col("n_expected") == 0) | (F.col("n_found") < F.col("n_expected"))
    no_year = F.size(F.array_except("years", F.coalesce("available", F.array().cast("array<int>")))) > 0
    gaps = F.array_compact(F.array(unavailable, F.when(missing & no_year, "REQUESTED_YEAR_UNAVAILABLE"), F.when(missing | ~F.col("is_exact"), "MISSING_REQUIRED_OPERANDS")))
    made = lambda name, *reasons: F.struct(F.lit(name).alias("support"), F.array_compact(F.array(*reasons)).alias("reasons"))
    place = made("UNSUPPORTED", F.lit("REQUESTED_GEOGRAPHY_UNAVAILABLE"))
    compared = F.when(F.col("evidence_operation").isin("comparison", "difference", "argmax"), "INCOMPATIBLE_COMPARISON")
    exits = (
        F.when(F.col("measure_status") != "resolved", made("UNSUPPORTED", F.lit("QUERY_NOT_RESOLVED")))
        .when(F.col("is_ambiguous"), made("AMBIGUOUS", F.lit("AMBIGUOUS_GEOGRAPHY"), unavailable, compared))
        .when(F.col("is_mismatch") | (F.col("all_at_level") & (F.col("evidence_operation") != "argmax")), place)
        .when(F.size("years") == 0, made("UNSUPPORTED", F.lit("QUERY_NOT_RESOLVED")))
        .when(F.size(gaps) > 0, F.struct(F.when(F.col("n_unavailable") > 0, "UNAVAILABLE").otherwise("UNSUPPORTED").alias("support"), gaps.alias("reasons")))
        .otherwise(made("SUPPORTED", F.lit("EVIDENCE_COMPLETE")))
    )
    return rows.withColumn("_s", exits).select(*asked.columns, "n_expected", "n_found", "n_unavailable", "_s.support", "_s.reasons")
