"""Queries over observations: ingestion, facts and questions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspan.functions import text
from tallyspan.operators import facts, observations as obs, questions
from tallyspan.operators.names import named_spans
from tallyspan.session import table

COLUMNS = ["evidence_id", "load_id", "row_id", "year", "geography_level", "planning_region", "planning_area", "subzone", "sex", "age_group", "status", "value"]


def _region(spark: SparkSession, sf: str, only_latest: bool = False) -> DataFrame:
    return obs.region_observations(table(spark, sf, "region_rows"), only_latest)


def _census(spark: SparkSession, sf: str, only_latest: bool = False) -> DataFrame:
    return obs.census_observations(table(spark, sf, "census_rows"), only_latest)


def latest(spark: SparkSession, sf: str) -> DataFrame:
    """The last observation of each evidence id, of both sources."""
    return _region(spark, sf, True).unionByName(_census(spark, sf, True))


# --- SQL of the same tables ----------------------------------------------------

_NUMBER = r"'[+-]?([0-9]+|[0-9]+\.[0-9]*|[0-9]*\.[0-9]+)'"
_PARSED = f"""
  CASE WHEN raw IS NULL OR lower(trim(raw, ' ')) IN ('', '-', 'na', 'n.a.', 'null') THEN 'not_available'
       WHEN regexp_full_match(trim(raw, ' '), {_NUMBER}) THEN 'observed' ELSE 'invalid' END AS status,
  CASE WHEN regexp_full_match(trim(raw, ' '), {_NUMBER}) THEN TRY_CAST(trim(raw, ' ') AS DOUBLE) END AS value"""

REGION_SQL = rf"""
region_parent AS (
  SELECT *, CASE WHEN NOT starts_with(rtrim(data_series, ' '), ' ') THEN
      {{'region': regexp_extract(rtrim(data_series, ' '), '^([^ (].*?)(?: \((Male|Female)\))?$', 1),
        'sex': coalesce(nullif(regexp_extract(rtrim(data_series, ' '), '^([^ (].*?)(?: \((Male|Female)\))?$', 2), ''), 'Total')}} END AS parent
  FROM region_rows),
region_filled AS (
  SELECT *, last_value(parent IGNORE NULLS) OVER (PARTITION BY load_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM region_parent),
region_long AS (
  SELECT row_id, load_id, record_id, p.region AS region, p.sex AS sex,
    CASE WHEN starts_with(rtrim(data_series, ' '), ' ') THEN trim(data_series, ' ') WHEN data_series IS NOT NULL THEN 'Total' END AS age_group, column_name, raw
  FROM region_filled UNPIVOT INCLUDE NULLS (raw FOR column_name IN (y2025, y2024, y2023, y2022, y2021, y2020, y2019))),
region_obs AS (
  SELECT 'residents_by_planning_region_annual:r' || record_id || ':y' || column_name[2:5] AS evidence_id, load_id, row_id, record_id,
    CAST(column_name[2:5] AS INTEGER) AS year, 'planning_region' AS geography_level, NULL::VARCHAR AS geography, region AS planning_region, NULL::VARCHAR AS planning_area, NULL::VARCHAR AS subzone,
    sex, age_group, raw, {_PARSED} FROM region_long)"""

CENSUS_SQL = f"""
census_opens AS (
  SELECT *, CASE WHEN lower(trim(number_label, ' ')) = 'total' THEN {{'area': NULL::VARCHAR}}
    WHEN trim(number_label, ' ') LIKE '% - Total' THEN {{'area': regexp_replace(trim(number_label, ' '), ' - Total$', '')}} END AS opens FROM census_rows),
census_filled AS (
  SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY load_id ORDER BY row_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS o,
    CASE WHEN lower(trim(number_label, ' ')) = 'total' THEN 'national' WHEN trim(number_label, ' ') LIKE '% - Total' THEN 'planning_area' WHEN number_label IS NOT NULL THEN 'subzone' END AS geography_level
  FROM census_opens),
census_long AS (
  SELECT row_id, load_id, record_id, geography_level, o.area AS area, trim(number_label, ' ') AS label, column_name, raw
  FROM census_filled UNPIVOT INCLUDE NULLS (raw FOR column_name IN (COLUMNS('^(total|males|females)_')))),
census_named AS (
  SELECT *, CASE split_part(column_name, '_', 1) WHEN 'males' THEN 'Male' WHEN 'females' THEN 'Female' ELSE 'Total' END AS sex,
    CASE regexp_replace(column_name, '^[a-z]+_', '') WHEN 'total' THEN 'Total' WHEN '90andover' THEN '90 Years & Over'
      ELSE replace(regexp_replace(column_name, '^[a-z]+_', ''), '_', ' - ') || ' Years' END AS age_group FROM census_long),
census_obs AS (
  SELECT 'resident_population_census_2020:r' || record_id || ':y2020:age_group=' || trim(regexp_replace(lower(age_group), '[^a-z0-9]+', '-', 'g'), '-') || ':sex=' || lower(sex) AS evidence_id,
    load_id, row_id, record_id, 2020 AS year, geography_level, CASE WHEN geography_level = 'national' THEN 'Talmera' END AS geography, NULL::VARCHAR AS planning_region, area AS planning_area,
    CASE WHEN geography_level = 'subzone' THEN label END AS subzone, sex, age_group, raw, {_PARSED} FROM census_named)"""

LATEST_SQL = f"""{REGION_SQL},{CENSUS_SQL},
all_obs AS (SELECT * FROM region_obs UNION ALL SELECT * FROM census_obs),
latest AS (SELECT * FROM all_obs QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY load_id DESC, row_id DESC) = 1)"""

PLACE_SQL = "coalesce(planning_region, subzone, planning_area, geography, 'Talmera')"


# --- ingestion -------------------------------------------------------------------


def observations_region(spark: SparkSession, sf: str) -> DataFrame:
    """Region rows as observations, hierarchy filled forward."""
    return _region(spark, sf).select(COLUMNS)


def observations_census(spark: SparkSession, sf: str) -> DataFrame:
    """Census rows as observations, hierarchy filled forward, columns decoded."""
    return _census(spark, sf).select(COLUMNS)


def latest_observations(spark: SparkSession, sf: str) -> DataFrame:
    """The last published observation of each evidence id."""
    return latest(spark, sf).select("evidence_id", "load_id", "row_id", "status", "value")


def duplicate_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Evidence ids that a load delivers more than once."""
    return obs.duplicate_ids(_region(spark, sf).unionByName(_census(spark, sf)))


def status_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Observations by status, in total, per source and per source and sex."""
    rows = _region(spark, sf).unionByName(_census(spark, sf))
    return spark.sql(
        """SELECT source_id, sex, status, count(*) AS n_rows, sum(value) AS total
           FROM {rows} GROUP BY GROUPING SETS ((status), (source_id, status), (source_id, sex, status))""",
        rows=rows,
    ).withColumn("total", F.round("total", 2))


def searchable_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Checksum and length of each region observation's sentence form."""
    sentence = obs.searchable_text("Residents by planning region", "National office")
    return _region(spark, sf).select("row_id", "year", F.sha2(sentence, 256).alias("checksum"), F.length(sentence).cast("long").alias("n_chars"))


def wide_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Region observations pivoted back to one row per region row."""
    rows = _region(spark, sf).select("row_id", "year", "raw")
    wide = rows.groupBy("row_id").pivot("year", list(range(2019, 2026))).agg(F.first("raw"))
    return wide.select("row_id", *(F.col(str(y)).alias(f"y{y}") for y in range(2019, 2026)))


# --- facts -----------------------------------------------------------------------


def fact_statements(spark: SparkSession, sf: str) -> DataFrame:
    """Fact id and statement of each observed latest observation."""
    rows = latest(spark, sf).where("status = 'observed'")
    return rows.select("evidence_id", facts.fact_id("lookup", F.array("evidence_id")).alias("fact_id"), facts.statement(obs.entity()).alias("statement"))


def fact_sum_65_up(spark: SparkSession, sf: str) -> DataFrame:
    """Residents aged 65 and over by place and sex, from the bands that cover it."""
    rows = latest(spark, sf).withColumns({"place": obs.entity(), "kind": F.lit("at_least"), "low": F.lit(65), "high": F.lit(None).cast("int")})
    band = text.age_band(F.col("age_group"))
    rows = rows.where(band["low"] >= 65)
    return facts.sum_over(rows, ["source_id", "place", "geography_level", "year", "sex"])


def fact_difference_years(spark: SparkSession, sf: str) -> DataFrame:
    """Change from 2019 to 2025 by region, sex and age group."""
    rows = _region(spark, sf, True).where("planning_region is not null")
    return facts.difference(rows, ["record_id", "planning_region", "sex", "age_group"], "year", 2019, 2025)


def fact_comparison_sexes(spark: SparkSession, sf: str) -> DataFrame:
    """Males against females by census area and age group, summed over rows."""
    rows = _census(spark, sf, True).where("geography_level = 'planning_area' and sex <> 'Total'")
    rows = rows.groupBy("planning_area", "age_group", "sex").agg(F.sum("value").alias("value"))
    return facts.difference(rows, ["planning_area", "age_group"], "sex", "Male", "Female")


def fact_largest_area(spark: SparkSession, sf: str) -> DataFrame:
    """The largest planning area for each sex and age group; none where tied."""
    rows = _census(spark, sf, True).where("geography_level = 'planning_area'")
    return facts.unique_maximum(rows, ["sex", "age_group"], "planning_area")


def fact_trend_years(spark: SparkSession, sf: str) -> DataFrame:
    """Direction of each region series from one observed year to the next."""
    from pyspark.sql import Window

    rows = _region(spark, sf, True).where("value is not null")
    order = Window.partitionBy("record_id").orderBy("year")
    rows = rows.withColumns({"before": F.lag("value").over(order), "year_before": F.lag("year").over(order)}).where("before is not null")
    direction = F.when(F.col("value") > F.col("before"), "increase").when(F.col("value") < F.col("before"), "decrease").otherwise("equal")
    return rows.select("record_id", "year_before", "year", (F.col("value") - F.col("before")).alias("difference"), direction.alias("direction"))


def qualification_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Per record: rounded source, boundary change between years, snapshot."""
    rows = latest(spark, sf).where("status = 'observed'")
    region = F.col("source_id") == obs.REGION_SOURCE
    return rows.groupBy("source_id", "record_id").agg(
        F.max(region).alias("is_rounded"),
        (F.max(region & (F.col("year") == 2019)) & F.max(region & (F.col("year") >= 2020))).alias("has_boundary_change"),
        F.max(~region).alias("is_snapshot"),
    )


def availability(spark: SparkSession, sf: str) -> DataFrame:
    """Years with observed values by geography level."""
    rows = _region(spark, sf).unionByName(_census(spark, sf)).where("status = 'observed'")
    return rows.groupBy("source_id", "geography_level", "year").agg(F.count("*").alias("n_observed"))


def registry_values(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct places, age groups and sexes of the observations, by level."""
    rows = latest(spark, sf).withColumn("place", obs.entity())
    named = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("name")) for k, c in (("place", "place"), ("age_group", "age_group"), ("sex", "sex")))))
    return rows.select("geography_level", named.alias("x")).groupBy("geography_level", "x.kind", "x.name").agg(F.count("*").alias("n"))


# --- questions -------------------------------------------------------------------


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "qa_examples").where("question is not null").select("example_id", "question")


def question_facts(spark: SparkSession, sf: str) -> DataFrame:
    """Years, age constraint and sexes that each question names."""
    q, age = F.col("question"), text.age_constraint(F.col("question"))
    return _questions(spark, sf).select(
        "example_id",
        F.concat_ws(",", text.years(q).cast("array<string>")).alias("years"),
        age["kind"].alias("age_kind"),
        age["low"].alias("age_low"),
        age["high"].alias("age_high"),
        F.concat_ws(",", text.sexes(q)).alias("sexes"),
    )


def question_operations(spark: SparkSession, sf: str) -> DataFrame:
    """Operation that each question asks for, and whether it asks for a cause."""
    words, q = text.phrase(F.col("question")), F.col("question")
    several = (F.size(text.years(q)) > 1) | (F.size(text.sexes(q)) > 1)
    return _questions(spark, sf).select("example_id", questions.operation(words, several).alias("operation"), questions.any_phrase(words, questions.CAUSE_WORDS).alias("is_causal"))


def _bands(spark: SparkSession, sf: str) -> DataFrame:
    from tallyspan.operators.profile import count_columns

    census = table(spark, sf, "census_rows")
    named = obs.census_column(F.col("column_name"))
    return spark.createDataFrame([(c,) for c in count_columns(census)], "column_name string").select(named["age_group"].alias("age_group")).distinct()


def _covered(spark: SparkSession, sf: str) -> DataFrame:
    age = text.age_constraint(F.col("question"))
    asked = _questions(spark, sf).select("example_id", age.alias("a")).where("a is not null").select("example_id", "a.*")
    return facts.bands_for(_bands(spark, sf), asked)


def question_age_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Published age bands that each question's age covers, and if exactly."""
    return facts.exactness(_covered(spark, sf), ["example_id"]).select("example_id", "kind", "n_bands", "is_exact")


def _question_places(spark: SparkSession, sf: str) -> DataFrame:
    """The longest place name that stands in each question, of any number of words."""
    census = table(spark, sf, "census_rows")
    named = census.select(F.regexp_replace(F.trim("number_label"), r" - Total\z", "").alias("place")).where("place is not null").distinct()
    # Of names that differ in spelling only, the first one stands for all.
    named = named.groupBy(text.phrase(F.col("place")).alias("name")).agg(F.max("place").alias("place"))
    asked = _questions(spark, sf).select("example_id", text.phrase(F.col("question")).alias("words"))
    spans = named_spans(asked, "example_id", "words", named, ["place"])
    return spans.groupBy("example_id").agg(F.max_by("place", F.struct(F.length("name"), "name")).alias("place"))


def question_places(spark: SparkSession, sf: str) -> DataFrame:
    """The place that each question names."""
    return _question_places(spark, sf)


def question_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Latest census observations that answer each question, in rank order.

    The place, the year, the sex (Total where none is named) and the covered
    age bands must match.
    """
    from pyspark.sql import Window

    q = F.col("question")
    asked = _questions(spark, sf).select("example_id", F.explode(text.years(q)).alias("year"), F.when(F.size(text.sexes(q)) == 0, F.array(F.lit("Total"))).otherwise(text.sexes(q)).alias("s"))
    asked = asked.select("example_id", "year", F.explode("s").alias("sex"))
    asked = asked.join(_question_places(spark, sf), "example_id").join(_covered(spark, sf).select("example_id", "age_group", "band_low"), "example_id")
    units = _census(spark, sf, True).withColumn("place", F.coalesce("subzone", "planning_area", "geography")).select("place", "year", "sex", "age_group", "evidence_id", "status", "value")
    found = asked.join(units, ["place", "year", "sex", "age_group"])
    order = Window.partitionBy("example_id").orderBy("year", "band_low", "sex", "evidence_id")
    return found.select("example_id", F.row_number().over(order).alias("rank"), "evidence_id", "status", "value")


def support_status(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the evidence of each question with an age is there and observed."""
    q = F.col("question")
    n_sexes = F.greatest(F.size(text.sexes(q)), F.lit(1))
    asked = _questions(spark, sf).select("example_id", (F.size(text.years(q)) * n_sexes).cast("long").alias("per_band"))
    bands = facts.exactness(_covered(spark, sf), ["example_id"]).select("example_id", "n_bands", "is_exact")
    evidence = question_evidence(spark, sf).groupBy("example_id").agg(F.count("*").alias("n_found"), F.count_if(F.col("status") != "observed").alias("n_unavailable"))
    rows = asked.join(bands, "example_id").join(evidence, "example_id", "left").na.fill(0, ["n_found", "n_unavailable"])
    expected = F.col("per_band") * F.col("n_bands")
    status = (
        F.when(F.col("n_found") < expected, "missing")
        .when(F.col("n_unavailable") > 0, "not_available")
        .when(~F.col("is_exact"), "inexact_age")
        .otherwise("supported")
    )
    return rows.select("example_id", expected.alias("n_expected"), "n_found", "n_unavailable", status.alias("status"))


_Q_SQL = r"""
years_of AS (
  SELECT example_id, question, CAST(list_filter(l, lambda x, i: NOT list_contains(l[:i - 1], x)) AS INTEGER[]) AS named
  FROM (SELECT example_id, question, regexp_extract_all(regexp_replace(' ' || question || ' ', '([^0-9])([0-9])', '\1 \2', 'g'), '[^0-9]((?:19|20)[0-9]{2})[^0-9]', 1) AS l FROM qa_examples WHERE question IS NOT NULL)),
asked_years AS (
  SELECT example_id, question, CASE WHEN len(named) = 2 AND regexp_matches(lower(question), 'each year|every year|annually')
    THEN range(list_min(named), list_max(named) + 1) ELSE named END AS years FROM years_of),
ages AS (
  SELECT example_id, lower(question) AS q,
    CASE WHEN regexp_matches(q, 'at least [0-9]{1,3}([^0-9]|$)') THEN 'at_least'
         WHEN regexp_matches(q, '(^|[^0-9])[0-9]{1,3} *(years? *)?(and over|or older|\+)') THEN 'at_least'
         WHEN regexp_matches(q, '(under|younger than) [0-9]{1,3}([^0-9]|$)') THEN 'under'
         WHEN regexp_matches(q, '(^|[^0-9])[0-9]{1,3} *([-–—]|to) *[0-9]{1,3}([^0-9]|$)') THEN 'range'
         WHEN regexp_matches(q, 'aged? [0-9]{1,3}([^0-9]|$)') THEN 'single' END AS k
  FROM qa_examples WHERE question IS NOT NULL),
constraints AS (
  SELECT example_id, CASE k WHEN 'single' THEN 'range' ELSE k END AS kind,
    CAST(CASE WHEN k = 'at_least' AND regexp_matches(q, 'at least [0-9]{1,3}([^0-9]|$)') THEN regexp_extract(q, 'at least ([0-9]{1,3})', 1)
         WHEN k = 'at_least' THEN regexp_extract(q, '(?:^|[^0-9])([0-9]{1,3}) *(?:years? *)?(?:and over|or older|\+)', 1)
         WHEN k = 'range' THEN regexp_extract(q, '(?:^|[^0-9])([0-9]{1,3}) *(?:[-–—]|to) *[0-9]{1,3}(?:[^0-9]|$)', 1)
         WHEN k = 'single' THEN regexp_extract(q, 'aged? ([0-9]{1,3})(?:[^0-9]|$)', 1) END AS INTEGER) AS low,
    CAST(CASE WHEN k = 'under' THEN regexp_extract(q, '(?:under|younger than) ([0-9]{1,3})(?:[^0-9]|$)', 1)
         WHEN k = 'range' THEN regexp_extract(q, '(?:^|[^0-9])[0-9]{1,3} *(?:[-–—]|to) *([0-9]{1,3})(?:[^0-9]|$)', 1)
         WHEN k = 'single' THEN regexp_extract(q, 'aged? ([0-9]{1,3})(?:[^0-9]|$)', 1) END AS INTEGER) AS high
  FROM ages),
sex_words AS (
  SELECT example_id, lower(question) AS q, [CASE WHEN m IN ('female', 'females', 'woman', 'women', 'girl', 'girls') THEN 'Female' ELSE 'Male' END
    FOR m IN regexp_extract_all(lower(question), '\b(female|females|woman|women|girl|girls|male|males|man|men|boy|boys)\b', 1)] AS l
  FROM qa_examples WHERE question IS NOT NULL),
asked_sexes AS (
  SELECT example_id, CASE WHEN regexp_matches(q, '(both|all) sexes') THEN ['Total'] ELSE list_filter(l, lambda x, i: NOT list_contains(l[:i - 1], x)) END AS sexes FROM sex_words),
bands AS (
  SELECT DISTINCT CASE regexp_replace(column_name, '^[a-z]+_', '') WHEN '90andover' THEN '90 Years & Over'
      ELSE replace(regexp_replace(column_name, '^[a-z]+_', ''), '_', ' - ') || ' Years' END AS age_group,
    CAST(regexp_extract(column_name, '_([0-9]+)', 1) AS INTEGER) AS band_low, TRY_CAST(regexp_extract(column_name, '_[0-9]+_([0-9]+)', 1) AS INTEGER) AS band_high
  FROM (SELECT unnest([c FOR c IN (SELECT list(column_name) FROM (DESCRIBE census_rows))]) AS column_name) WHERE regexp_matches(column_name, '^(total|males|females)_[0-9]')),
covered AS (
  SELECT c.*, b.* FROM constraints c JOIN bands b ON (kind = 'at_least' AND band_low >= low) OR (kind = 'under' AND band_high < high) OR (kind = 'range' AND band_low >= low AND band_high <= high)),
exactness AS (
  SELECT example_id, kind, low, high, count(*) AS n_bands, min(band_low) AS f, max(band_high) AS l, bool_or(band_high IS NULL) AS o, bool_or(gap) AS g
  FROM (SELECT *, coalesce(band_low <> lag(band_high) OVER (PARTITION BY example_id ORDER BY band_low) + 1, false) AS gap FROM covered) GROUP BY ALL),
question_bands AS (
  SELECT example_id, kind, n_bands, f = coalesce(low, 0) AND coalesce(CASE kind WHEN 'at_least' THEN o WHEN 'under' THEN l = high - 1 ELSE l = high END, false) AND NOT g AS is_exact FROM exactness),
names AS (
  SELECT DISTINCT regexp_replace(trim(number_label, ' '), ' - Total$', '') AS place FROM census_rows WHERE number_label IS NOT NULL),
named_places AS (SELECT place, trim(regexp_replace(lower(place), '[^\p{L}0-9]+', ' ', 'g'), ' ') AS name FROM names),
question_place AS (
  SELECT example_id, arg_max(place, (length(name), name)) AS place
  FROM (SELECT example_id, ' ' || trim(regexp_replace(lower(question), '[^\p{L}0-9]+', ' ', 'g'), ' ') || ' ' AS words FROM qa_examples WHERE question IS NOT NULL)
  JOIN named_places ON contains(words, ' ' || name || ' ') GROUP BY example_id)"""

_EVIDENCE_SQL = f"""{_Q_SQL},{CENSUS_SQL},
census_latest AS (SELECT * FROM census_obs QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY load_id DESC, row_id DESC) = 1),
asked AS (
  SELECT example_id, unnest(years) AS year, sexes FROM asked_years JOIN (SELECT example_id, CASE WHEN len(sexes) = 0 THEN ['Total'] ELSE sexes END AS sexes FROM asked_sexes) USING (example_id)),
evidence AS (
  SELECT a.example_id, row_number() OVER (PARTITION BY a.example_id ORDER BY a.year, band_low, a.sex, evidence_id) AS rank, evidence_id, status, value
  FROM (SELECT example_id, year, unnest(sexes) AS sex FROM asked) a JOIN question_place USING (example_id) JOIN covered c USING (example_id)
  JOIN census_latest u ON u.year = a.year AND u.sex = a.sex AND u.age_group = c.age_group AND coalesce(u.subzone, u.planning_area, u.geography) = place)"""

_SELECT = ", ".join(COLUMNS)
QUERIES = {
    f.__name__: f
    for f in (
        observations_region, observations_census, latest_observations, duplicate_evidence, status_profile, searchable_texts, wide_regions,
        fact_statements, fact_sum_65_up, fact_difference_years, fact_comparison_sexes, fact_largest_area, fact_trend_years, qualification_flags, availability, registry_values,
        question_facts, question_operations, question_age_bands, question_places, question_evidence, support_status,
    )
}

_HAS = "contains(words, ' {} ')"
_OR = lambda *phrases: "(" + " OR ".join(_HAS.format(p) for p in phrases) + ")"
ORACLES = {
    "observations_region": f"WITH {REGION_SQL} SELECT {_SELECT} FROM region_obs",
    "observations_census": f"WITH {CENSUS_SQL} SELECT {_SELECT} FROM census_obs",
    "latest_observations": f"WITH {LATEST_SQL} SELECT evidence_id, load_id, row_id, status, value FROM latest",
    "duplicate_evidence": f"WITH {LATEST_SQL} SELECT load_id, evidence_id, count(*) AS n_rows FROM all_obs GROUP BY ALL HAVING count(*) > 1",
    "status_profile": f"""WITH {LATEST_SQL}, s AS (SELECT *, split_part(evidence_id, ':', 1) AS source_id FROM all_obs)
        SELECT source_id, sex, status, count(*) AS n_rows, round(sum(value), 2) AS total FROM s GROUP BY GROUPING SETS ((status), (source_id, status), (source_id, sex, status))""",
    "searchable_texts": f"""WITH {REGION_SQL}, t AS (SELECT row_id, year, concat_ws(' ', 'Dataset: Residents by planning region.', 'Publisher: National office.', 'Year: ' || year || '.',
          'Geography level: ' || geography_level || '.', 'Planning region: ' || planning_region || '.', 'Sex: ' || sex || '.', 'Age group: ' || age_group || '.',
          CASE WHEN status = 'observed' THEN 'Published value: ' || trim(raw, ' ') || '.' ELSE 'Published value: not available. Source marker: ' || coalesce(nullif(trim(raw, ' '), ''), 'null') || '.' END) AS s FROM region_obs)
        SELECT row_id, year, sha256(s) AS checksum, CAST(length(s) AS BIGINT) AS n_chars FROM t""",
    "wide_regions": "SELECT row_id, y2019, y2020, y2021, y2022, y2023, y2024, y2025 FROM region_rows",
    "fact_statements": f"""WITH {LATEST_SQL}, o AS (SELECT *, concat_ws(', ', {PLACE_SQL}, year, CASE WHEN age_group <> 'Total' THEN age_group END, CASE WHEN sex <> 'Total' THEN sex END) AS label FROM latest WHERE status = 'observed')
        SELECT evidence_id, 'fact-' || substr(sha256('{{"evidence_ids":["' || evidence_id || '"],"operation":"lookup"}}'), 1, 16) AS fact_id,
          label || ': ' || CASE WHEN value = floor(value) THEN format('{{:,}}', CAST(value AS BIGINT)) ELSE regexp_replace(format('{{:,.6f}}', value), '\\.?0+$', '') END AS statement FROM o""",
    "fact_sum_65_up": f"""WITH {LATEST_SQL} SELECT split_part(evidence_id, ':', 1) AS source_id, {PLACE_SQL} AS place, geography_level, year, sex, sum(value) AS total, count(value) AS n_observed, count(*) - count(value) AS n_missing
        FROM latest WHERE TRY_CAST(regexp_extract(age_group, '^ *([0-9]+) *(?:-|Years)', 1) AS INTEGER) >= 65 GROUP BY ALL""",
    "fact_difference_years": f"""WITH {LATEST_SQL}, d AS (SELECT record_id, planning_region, sex, age_group, max(CASE WHEN year = 2019 THEN value END) AS first_value, max(CASE WHEN year = 2025 THEN value END) AS second_value
          FROM latest WHERE geography_level = 'planning_region' AND planning_region IS NOT NULL GROUP BY ALL)
        SELECT *, second_value - first_value AS difference, CASE WHEN second_value > first_value THEN 'second' WHEN second_value < first_value THEN 'first' ELSE 'equal' END AS larger
        FROM d WHERE first_value IS NOT NULL AND second_value IS NOT NULL""",
    "fact_comparison_sexes": f"""WITH {LATEST_SQL}, v AS (SELECT planning_area, age_group, sex, sum(value) AS value FROM latest WHERE geography_level = 'planning_area' AND sex <> 'Total' GROUP BY ALL),
        d AS (SELECT planning_area, age_group, max(CASE WHEN sex = 'Male' THEN value END) AS first_value, max(CASE WHEN sex = 'Female' THEN value END) AS second_value FROM v GROUP BY ALL)
        SELECT *, second_value - first_value AS difference, CASE WHEN second_value > first_value THEN 'second' WHEN second_value < first_value THEN 'first' ELSE 'equal' END AS larger
        FROM d WHERE first_value IS NOT NULL AND second_value IS NOT NULL""",
    "fact_largest_area": f"""WITH {LATEST_SQL}, v AS (SELECT * FROM latest WHERE geography_level = 'planning_area' AND value IS NOT NULL), m AS (SELECT sex, age_group, max(value) AS maximum FROM v GROUP BY ALL)
        SELECT v.sex, v.age_group, maximum, CASE WHEN count(DISTINCT planning_area) = 1 THEN min(planning_area) END AS winner, count(DISTINCT planning_area) AS n_at_maximum
        FROM v JOIN m ON v.sex = m.sex AND v.age_group = m.age_group AND v.value = m.maximum GROUP BY ALL""",
    "fact_trend_years": f"""WITH {LATEST_SQL}, t AS (SELECT record_id, year, value, lag(value) OVER w AS before, lag(year) OVER w AS year_before FROM latest WHERE geography_level = 'planning_region' AND value IS NOT NULL WINDOW w AS (PARTITION BY record_id ORDER BY year))
        SELECT record_id, year_before, year, value - before AS difference, CASE WHEN value > before THEN 'increase' WHEN value < before THEN 'decrease' ELSE 'equal' END AS direction FROM t WHERE before IS NOT NULL""",
    "qualification_flags": f"""WITH {LATEST_SQL}, s AS (SELECT split_part(evidence_id, ':', 1) AS source_id, * EXCLUDE (geography) FROM latest WHERE status = 'observed')
        SELECT source_id, record_id, bool_or(geography_level = 'planning_region') AS is_rounded, bool_or(geography_level = 'planning_region' AND year = 2019) AND bool_or(geography_level = 'planning_region' AND year >= 2020) AS has_boundary_change,
          bool_or(geography_level IS DISTINCT FROM 'planning_region') AS is_snapshot FROM s GROUP BY ALL""",
    "availability": f"WITH {LATEST_SQL} SELECT split_part(evidence_id, ':', 1) AS source_id, geography_level, year, count(*) AS n_observed FROM all_obs WHERE status = 'observed' GROUP BY ALL",
    "registry_values": f"""WITH {LATEST_SQL}, x AS (SELECT geography_level, unnest([{{'kind': 'place', 'name': {PLACE_SQL}}}, {{'kind': 'age_group', 'name': age_group}}, {{'kind': 'sex', 'name': sex}}]) AS v FROM latest)
        SELECT geography_level, v.kind AS kind, v.name AS name, count(*) AS n FROM x GROUP BY ALL""",
    "question_facts": f"""WITH {_Q_SQL} SELECT y.example_id, array_to_string(years, ',') AS years, kind AS age_kind, low AS age_low, high AS age_high, array_to_string(sexes, ',') AS sexes
        FROM asked_years y JOIN constraints USING (example_id) JOIN asked_sexes USING (example_id)""",
    "question_operations": rf"""WITH {_Q_SQL}, w AS (SELECT example_id, ' ' || trim(regexp_replace(lower(question), '[^\p{{L}}0-9]+', ' ', 'g'), ' ') || ' ' AS words, years FROM asked_years)
        SELECT example_id, CASE {" ".join(f"WHEN {_OR(*phrases)} THEN '{name}'" for name, phrases in questions.OPERATION_PHRASES.items())} WHEN len(years) > 1 OR len(sexes) > 1 THEN 'comparison' ELSE 'lookup' END AS operation,
          {_OR(*questions.CAUSE_WORDS)} AS is_causal FROM w JOIN asked_sexes USING (example_id)""",
    "question_age_bands": f"WITH {_Q_SQL} SELECT example_id, kind, n_bands, is_exact FROM question_bands",
    "question_places": f"WITH {_Q_SQL} SELECT example_id, place FROM question_place",
    "question_evidence": f"WITH {_EVIDENCE_SQL} SELECT example_id, rank, evidence_id, status, value FROM evidence",
    "support_status": f"""WITH {_EVIDENCE_SQL}, e AS (SELECT example_id, count(*) AS n_found, count(*) FILTER (WHERE status <> 'observed') AS n_unavailable FROM evidence GROUP BY ALL),
        r AS (SELECT example_id, len(years) * greatest(len(sexes), 1) * n_bands AS n_expected, coalesce(n_found, 0) AS n_found, coalesce(n_unavailable, 0) AS n_unavailable, is_exact
          FROM asked_years JOIN asked_sexes USING (example_id) JOIN question_bands USING (example_id) LEFT JOIN e USING (example_id))
        SELECT example_id, n_expected, n_found, n_unavailable, CASE WHEN n_found < n_expected THEN 'missing' WHEN n_unavailable > 0 THEN 'not_available' WHEN NOT is_exact THEN 'inexact_age' ELSE 'supported' END AS status FROM r""",
}
