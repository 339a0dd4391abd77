"""Queries that interpret questions, decide on them and compute, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspan.operators import decisions, metrics, observations as obs, questions
from tallyspan.plans import evaluation_queries as ev, observation_queries as oq
from tallyspan.session import materialise, table


def observations_indicator(spark: SparkSession, sf: str) -> DataFrame:
    """National series by record and year, of every delivered payload."""
    return obs.indicator_observations(table(spark, sf, "source_payloads")).select("evidence_id", "load_id", "row_id", "year", "series", "status", "value")


def _units(spark: SparkSession, sf: str) -> DataFrame:
    """The latest observations of all three sources."""
    national = obs.latest_of(obs.indicator_observations(table(spark, sf, "source_payloads")))
    wide = oq.latest(spark, sf).withColumn("series", F.lit(None).cast("string"))
    return materialise(obs.units_of(wide).unionByName(obs.units_of(national)))


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "qa_examples").where("question is not null").select(F.col("example_id").cast("long").alias("text_id"), "question")


def _clauses(texts: DataFrame) -> DataFrame:
    return texts.select("text_id", decisions.first_clause(F.col("question")).alias("question")).where("question is not null")


def _planned(texts: DataFrame, units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(interpreted questions with support, ranked evidence)."""
    asked = materialise(questions.interpret(texts, units))
    found = materialise(questions.evidence(asked, units))
    return materialise(questions.support(asked, found, units)), found


def question_ir(spark: SparkSession, sf: str) -> DataFrame:
    """What each question asks for, in one row."""
    rows = questions.interpret(_texts(spark, sf), _units(spark, sf))
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    return rows.select(
        F.col("text_id").alias("example_id"), "measure_status", "measure", listed("years").alias("years"), "level", F.array_join(F.transform("places", lambda p: p["place"]), ",").alias("places"),
        "is_ambiguous", "is_mismatch", "all_at_level", F.col("age.kind").alias("age_kind"), F.array_join("bands", ",").alias("bands"), "is_exact", listed("sexes").alias("sexes"), "evidence_operation", "is_causal",
    )


def structured_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The observations of all sources that answer each question, in rank order."""
    units = _units(spark, sf)
    found = questions.evidence(materialise(questions.interpret(_texts(spark, sf), units)), units)
    return found.select(F.col("text_id").alias("example_id"), "rank", "evidence_id", "status", "value")


def structured_support(spark: SparkSession, sf: str) -> DataFrame:
    """How far the evidence of each question carries, with the reasons."""
    rows, _ = _planned(_texts(spark, sf), _units(spark, sf))
    return rows.select(F.col("text_id").alias("example_id"), "n_expected", "n_found", "n_unavailable", "support", F.array_join("reasons", ",").alias("reasons"))


def _decided(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    units, texts = _units(spark, sf), _texts(spark, sf)
    whole, found = _planned(texts, units)
    clause, clause_found = _planned(_clauses(texts), units)
    return materialise(decisions.decide(whole, clause, decisions.premises(whole, found))), found, clause_found


def decided(spark: SparkSession, sf: str) -> DataFrame:
    """Label, claims and reasons of each question."""
    rows, _, _ = _decided(spark, sf)
    return rows.select(
        F.col("text_id").alias("example_id"), "label", F.array_join(F.transform("claims", lambda c: F.concat_ws(" ", c["kind"], c["part"], c["support"])), ",").alias("claims"), F.array_join("decision_reasons", ",").alias("reasons")
    )


def computed(spark: SparkSession, sf: str) -> DataFrame:
    """The fact that each question's supported evidence gives, or why it gives none."""
    rows, found, clause_found = _decided(spark, sf)
    made = decisions.compute(decisions.supported_operands(rows, found, clause_found), rows)
    return made.select(F.col("text_id").alias("example_id"), "operation", "fault", "n_operands", "fact_id", F.round("numeric", 6).alias("numeric"), "winner")


def decision_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy, macro-F1, abstention and coverage of the decisions by category."""
    rows, _, _ = _decided(spark, sf)
    gold = table(spark, sf, "qa_examples").select(F.col("example_id").cast("long").alias("text_id"), F.lower(F.trim("category")).alias("category"), metrics.label(F.col("answerability")).alias("gold"))
    return metrics.classification(gold.join(rows.select("text_id", "label"), "text_id", "left"), ["category"], "gold", "label")


def _required(spark: SparkSession, sf: str) -> DataFrame:
    """(example_id, category, evidence_id): required evidence of the examples that
    are to be answered, wholly or partly; each id once."""
    record = F.col("record_json")
    listed = F.coalesce(F.get_json_object(record, "$.required_evidence"), F.get_json_object(record, "$.example.required_evidence"))
    gold = metrics.label(F.col("answerability"))
    rows = table(spark, sf, "qa_examples").where(gold.isin("ANSWERABLE", "PARTIALLY_ANSWERABLE"))
    rows = rows.select(F.col("example_id").cast("long").alias("example_id"), F.lower(F.trim("category")).alias("category"), F.explode(F.array_distinct(F.from_json(listed, "array<string>"))).alias("e"))
    return rows.where("e is not null").select("example_id", "category", F.lower(F.trim("e")).alias("evidence_id")).distinct()


def full_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Share of the required evidence among all that each question finds."""
    found = structured_evidence(spark, sf).select("example_id", "evidence_id", F.lit(True).alias("is_found"))
    rows = _required(spark, sf).join(found, ["example_id", "evidence_id"], "left")
    return rows.groupBy("example_id", "category").agg(F.count("*").alias("n_required"), F.count("is_found").alias("n_recovered"), (F.count("is_found") / F.count("*")).alias("recovery"))


def missing_required(spark: SparkSession, sf: str) -> DataFrame:
    """Required evidence, of any source, that no observation has."""
    record = F.col("record_json")
    listed = F.coalesce(F.get_json_object(record, "$.required_evidence"), F.get_json_object(record, "$.example.required_evidence"))
    wanted = table(spark, sf, "qa_examples").select("example_id", F.explode(F.from_json(listed, "array<string>")).alias("e")).where("e is not null")
    return wanted.select("example_id", F.lower(F.trim("e")).alias("evidence_id")).distinct().join(_units(spark, sf).select("evidence_id"), "evidence_id", "left_anti")


def retrieval_report(spark: SparkSession, sf: str) -> DataFrame:
    """Mean recall at 1, 3, 5 and 10, in total, by category and by the number of
    required observations (grouping sets)."""
    found = structured_evidence(spark, sf).select(F.col("example_id"), "rank", "evidence_id")
    wanted = _required(spark, sf)
    each = metrics.recall_at(found, wanted.select("example_id", "evidence_id"), "example_id", "evidence_id", [1, 3, 5, 10])
    rows = each.join(wanted.select("example_id", "category").distinct(), "example_id")
    sets = [("k",), ("k", "category"), ("k", "n_wanted")]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], F.col("k"), F.col("category"), F.col("n_wanted"))
    return grouped.agg(F.grouping_id().cast("int").alias("grouping"), F.count("*").alias("n_examples"), F.round(F.avg("recall"), 9).alias("recall")).select("k", "category", F.col("n_wanted").alias("n_required"), "grouping", "n_examples", "recall")


def selective_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage, risk and abstention recall of three policies: always answer,
    answer where any evidence is found, answer what is decided answerable."""
    rows, found, _ = _decided(spark, sf)
    gold = table(spark, sf, "qa_examples").select(F.col("example_id").cast("long").alias("text_id"), metrics.label(F.col("answerability")).alias("gold")).where("gold is not null")
    rows = gold.join(rows.select("text_id", "label"), "text_id").join(found.select("text_id").distinct().withColumn("has_any", F.lit(True)), "text_id", "left")
    answers = {"always": F.lit(True), "any_evidence": F.coalesce("has_any", F.lit(False)), "decision": F.col("label").isin("ANSWERABLE", "PARTIALLY_ANSWERABLE")}
    policy = F.explode(F.array(*(F.struct(F.lit(n).alias("policy"), c.alias("answers")) for n, c in answers.items())))
    rows = rows.select(F.col("gold").isin(*metrics.ABSTAIN).alias("should_abstain"), policy.alias("p")).select("should_abstain", "p.*")
    count = lambda when: F.count_if(when)
    divide = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    said, out = F.col("answers"), F.col("should_abstain")
    return rows.groupBy("policy").agg(
        F.count("*").alias("n"), divide(count(said), F.count("*")).alias("coverage"), divide(count(said & out), count(said)).alias("risk"),
        divide(count(~said & out), count(out)).alias("abstention_recall"), divide(count(said & out), count(out)).alias("unsupported_rate"),
    )


QUERIES = {f.__name__: f for f in (observations_indicator, question_ir, structured_evidence, structured_support, decided, computed, decision_scores, full_recovery, missing_required, retrieval_report, selective_risk)}

# --- SQL: the same from the tables' rules alone -----------------------------------

_LIST = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"
_HAS = "contains(' ' || words || ' ', ' {} ')"
_ANY = lambda phrases: "(" + " OR ".join(_HAS.format(p) for p in phrases) + ")"
_PHRASE = r"trim(regexp_replace(lower({0}), '[^\p{{L}}0-9]+', ' ', 'g'), ' ')"
_CASES = lambda table: "CASE " + " ".join(f"WHEN {_HAS.format(k)} THEN '{v}'" for k, v in table.items()) + " END"

_INDICATOR = f"""
tree AS (SELECT file_id, t.* FROM source_payloads, LATERAL (SELECT key, value, type, parent FROM json_tree(body)) t WHERE json_valid(body) AND source_id = 'population_indicators_annual'),
held AS (SELECT file_id, parent, row_number() OVER (PARTITION BY file_id ORDER BY parent) AS row_id, TRY_CAST(regexp_extract(value->>'$', '^\\s*\\+?([0-9]+)(?:\\.0*)?\\s*$', 1) AS BIGINT) AS record_id FROM tree WHERE key = '_id'),
labels AS (SELECT file_id, parent, trim(value->>'$', ' ') AS series FROM tree WHERE key = 'DataSeries' AND type <> 'NULL'),
indicator AS (
  SELECT 'population_indicators_annual:r' || record_id || ':y' || key AS evidence_id, file_id AS load_id, row_id, record_id, CAST(key AS INTEGER) AS year, series, raw, {oq._PARSED}
  FROM (SELECT h.*, t.key, CASE WHEN t.type <> 'NULL' THEN t.value->>'$' END AS raw, l.series FROM held h JOIN tree t ON t.file_id = h.file_id AND t.parent = h.parent AND regexp_full_match(t.key, '(19|20)[0-9]{{2}}') AND t.type NOT IN ('ARRAY', 'OBJECT')
    LEFT JOIN labels l ON l.file_id = h.file_id AND l.parent = h.parent WHERE record_id IS NOT NULL))"""
_UNITS = f"""{oq.LATEST_SQL},{_INDICATOR},
newest AS (SELECT * FROM indicator QUALIFY row_number() OVER (PARTITION BY evidence_id ORDER BY load_id DESC, row_id DESC) = 1),
units AS (
  SELECT evidence_id, geography_level, coalesce(planning_region, subzone, planning_area, geography) AS place, CASE WHEN geography_level = 'subzone' THEN planning_area END AS area, year, sex, age_group, NULL::VARCHAR AS series, status, value FROM latest
  UNION ALL SELECT evidence_id, 'national', 'Talmera', NULL, year, NULL, NULL, series, status, value FROM newest)"""


def _ir_sql(name: str, source: str) -> str:
    """CTEs that interpret the questions of ``source`` (text_id, question), named with a prefix."""
    n = name
    forms = "CASE " + " ".join(f"WHEN regexp_matches(q, '{f}') THEN '{k}'" for k, f in _AGE_FORMS) + " END"
    low = "coalesce(" + ", ".join(f"CASE WHEN form = '{k}' THEN nullif(regexp_extract(q, '{f}', 1), '') END" for k, f in _AGE_FORMS) + ")"
    return f"""
{n}_t AS (SELECT text_id, question, {_PHRASE.format("question")} AS words, lower(question) AS q FROM ({source}) WHERE question IS NOT NULL),
{n}_spots AS (
  SELECT text_id, words, name, level, place, area, strpos(' ' || words || ' ', ' ' || name || ' ') AS spot FROM {n}_t JOIN place_names ON contains(' ' || words || ' ', ' ' || name || ' ')),
{n}_named AS (SELECT * FROM {n}_spots s WHERE NOT EXISTS (SELECT 1 FROM {n}_spots o WHERE o.text_id = s.text_id AND o.name <> s.name AND contains(' ' || o.name || ' ', ' ' || s.name || ' '))),
{n}_explicit AS (SELECT text_id, {_CASES(questions.LEVEL_WORDS)} AS explicit FROM {n}_t),
{n}_place AS (SELECT text_id, level, place, area, row_number() OVER (PARTITION BY text_id ORDER BY spot, level, place, area) - 1 AS place_no FROM {n}_named JOIN {n}_explicit USING (text_id) WHERE explicit IS NULL OR explicit = level),
{n}_placed AS (SELECT text_id, list(place ORDER BY place_no) AS places, list(DISTINCT level) AS levels FROM {n}_place GROUP BY text_id),
{n}_foreign AS (SELECT text_id, bool_or(level <> 'national') AS has_foreign FROM {n}_named GROUP BY text_id),
{n}_series AS (SELECT text_id, arg_max(series, length(name)) AS named_series FROM {n}_t JOIN series_names ON contains(' ' || words || ' ', ' ' || name || ' ') GROUP BY text_id),
{n}_aged AS (SELECT text_id, CASE form WHEN 'single' THEN 'range' ELSE form END AS kind, CASE WHEN form <> 'under' THEN TRY_CAST(raw_low AS INTEGER) END AS low,
    CASE form WHEN 'under' THEN TRY_CAST(raw_low AS INTEGER) WHEN 'single' THEN TRY_CAST(raw_low AS INTEGER) WHEN 'range' THEN TRY_CAST(regexp_extract(q, '(?:^|[^0-9])[0-9]{{1,3}} *(?:[-–—]|to) *([0-9]{{1,3}})(?:[^0-9]|$)', 1) AS INTEGER) END AS high
  FROM (SELECT *, {low} AS raw_low FROM (SELECT text_id, q, {forms} AS form FROM {n}_t)) WHERE form IS NOT NULL),
{n}_sexed AS (SELECT text_id, CASE WHEN regexp_matches(q, '(both|all) sexes') THEN ['Total'] ELSE list_filter(l, lambda x, i: NOT list_contains(l[:i - 1], x)) END AS sexes FROM (SELECT text_id, q,
    [CASE WHEN m IN ('female', 'females', 'woman', 'women', 'girl', 'girls') THEN 'Female' ELSE 'Male' END FOR m IN regexp_extract_all(q, '\\b(female|females|woman|women|girl|girls|male|males|man|men|boy|boys)\\b', 1)] AS l FROM {n}_t)),
{n}_yeared AS (SELECT text_id, CASE WHEN len(l) = 2 AND regexp_matches(q, 'each year|every year|annually') THEN range(list_min(l), list_max(l) + 1) ELSE l END AS years FROM (
    SELECT text_id, q, CAST(list_filter(l, lambda x, i: NOT list_contains(l[:i - 1], x)) AS INTEGER[]) AS l FROM (
      SELECT text_id, q, regexp_extract_all(regexp_replace(' ' || question || ' ', '([^0-9])([0-9])', '\\1 \\2', 'g'), '[^0-9]((?:19|20)[0-9]{{2}})[^0-9]', 1) AS l FROM {n}_t))),
{n}_base AS (
  SELECT text_id, words, CASE WHEN {_ANY(questions.UNSUPPORTED)} THEN NULL ELSE coalesce(named_series, {", ".join(f"CASE WHEN {_HAS.format(k)} AND '{v}' IN (SELECT series FROM series_names) THEN '{v}' END" for k, v in questions.SERIES_WORDS.items())}) END AS measure,
    {_ANY(questions.UNSUPPORTED)} AS is_unsupported, years, explicit, coalesce(places, []) AS places, coalesce(levels, []) AS levels, coalesce(has_foreign, false) AS has_foreign, kind, low, high, sexes AS named_sexes
  FROM {n}_t JOIN {n}_explicit USING (text_id) JOIN {n}_yeared USING (text_id) JOIN {n}_sexed USING (text_id) LEFT JOIN {n}_placed USING (text_id) LEFT JOIN {n}_foreign USING (text_id) LEFT JOIN {n}_series USING (text_id) LEFT JOIN {n}_aged USING (text_id)),
{n}_level AS (
  SELECT *, CASE WHEN len(levels) = 1 THEN levels[1] WHEN len(levels) = 0 THEN explicit END AS level, len(levels) > 1 AS is_ambiguous, explicit IS NOT NULL AND has_foreign AND len(places) = 0 AS is_mismatch FROM {n}_base),
{n}_below AS (
  SELECT *, coalesce(level <> 'national', false) AND len(places) = 0 AND NOT has_foreign AS all_at_level, coalesce(level <> 'national', false) OR len(list_filter(levels, lambda x: x <> 'national')) > 0 AS is_below FROM {n}_level),
{n}_sub AS (SELECT *, coalesce(measure = 'Resident Population', false) AND is_below AS is_subnational FROM {n}_below),
{n}_cover AS (
  SELECT text_id, age_group, band_low, band_high, kind, low, high FROM {n}_sub JOIN band_names ON is_subnational AND ((kind = 'at_least' AND band_low >= low) OR (kind = 'under' AND band_high < high) OR (kind = 'range' AND band_low >= low AND band_high <= high))),
{n}_exact AS (
  SELECT text_id, list(age_group ORDER BY band_low) AS bands, min(band_low) = coalesce(any_value(low), 0) AND coalesce(CASE any_value(kind) WHEN 'at_least' THEN bool_or(band_high IS NULL) WHEN 'under' THEN max(band_high) = any_value(high) - 1 ELSE max(band_high) = any_value(high) END, false) AND NOT bool_or(gap) AS is_exact
  FROM (SELECT *, coalesce(band_low <> lag(band_high) OVER (PARTITION BY text_id ORDER BY band_low) + 1, false) AS gap FROM {n}_cover) GROUP BY text_id),
{n}_ir AS (
  SELECT s.* EXCLUDE (kind), CASE WHEN is_unsupported THEN 'unsupported' WHEN measure IS NOT NULL THEN 'resolved' ELSE 'unknown' END AS measure_status, CASE WHEN is_subnational THEN coalesce(kind, 'total') ELSE kind END AS age_kind,
    CASE WHEN NOT is_subnational THEN [] WHEN kind IS NULL THEN ['Total'] ELSE coalesce(bands, []) END AS bands, CASE WHEN NOT is_subnational OR kind IS NULL THEN true ELSE coalesce(is_exact, false) END AS is_exact,
    CASE WHEN is_subnational AND len(named_sexes) = 0 THEN ['Total'] ELSE named_sexes END AS sexes FROM {n}_sub s LEFT JOIN {n}_exact USING (text_id)),
{n}_asked AS (
  SELECT *, CASE WHEN measure_status <> 'resolved' THEN 'unresolved' {" ".join(f"WHEN {_ANY(p)} THEN '{o}'" for o, p in questions.OPERATION_PHRASES.items())}
    WHEN len(list_distinct(places)) > 1 OR len(sexes) > 1 OR len(years) > 1 THEN 'comparison' WHEN len(bands) > 1 THEN 'sum' ELSE 'lookup' END AS evidence_operation, {_ANY(questions.CAUSE_WORDS)} AS is_causal FROM {n}_ir),
{n}_dims AS (
  SELECT a.text_id, measure, y.year, y.year_no, coalesce(p.place_no, 0) AS place_no, coalesce(p.level, a.level, 'national') AS level, p.place, coalesce(p.area, '') AS area, bands, sexes, is_subnational
  FROM {n}_asked a JOIN (SELECT text_id, unnest(years) AS year, generate_subscripts(years, 1) AS year_no FROM {n}_asked) y USING (text_id) LEFT JOIN {n}_place p USING (text_id) WHERE measure_status = 'resolved' AND NOT is_mismatch),
{n}_cells AS (SELECT d.* EXCLUDE (bands, sexes), b.age_group, b.band_no, s.sex, s.sex_no FROM {n}_dims d JOIN (SELECT text_id, unnest(bands) AS age_group, generate_subscripts(bands, 1) AS band_no FROM {n}_asked) b USING (text_id)
  JOIN (SELECT text_id, unnest(sexes) AS sex, generate_subscripts(sexes, 1) AS sex_no FROM {n}_asked) s USING (text_id) WHERE level <> 'national' AND is_subnational),
{n}_found AS (
  SELECT text_id, year_no, place_no, 0 AS band_no, 0 AS sex_no, u.* FROM {n}_dims d JOIN units u ON d.level = 'national' AND u.series = d.measure AND u.year = d.year
  UNION ALL SELECT text_id, year_no, place_no, band_no, sex_no, u.* FROM {n}_cells c JOIN units u ON u.series IS NULL AND u.geography_level = c.level AND u.year = c.year AND u.age_group = c.age_group AND u.sex = c.sex AND (c.place IS NULL OR u.place = c.place AND coalesce(u.area, '') = c.area)),
{n}_ev AS (SELECT text_id, row_number() OVER (PARTITION BY text_id ORDER BY year_no, place_no, lower(place), band_no, sex_no, evidence_id) AS rank, evidence_id, status, value, year, place, sex FROM {n}_found),
{n}_counts AS (SELECT text_id, count(*) AS n_found, count(*) FILTER (WHERE status <> 'observed') AS n_unavailable FROM {n}_ev GROUP BY text_id),
{n}_counted AS (
  SELECT a.*, coalesce(n_found, 0) AS n_found, coalesce(n_unavailable, 0) AS n_unavailable, CASE WHEN len(years) = 0 OR is_ambiguous THEN 0 ELSE len(years) * CASE WHEN all_at_level THEN coalesce(n_at_level, 0) ELSE greatest(len(places), 1) END * CASE WHEN is_below THEN len(bands) * len(sexes) ELSE 1 END END AS n_expected,
    coalesce(available, []) AS available FROM {n}_asked a LEFT JOIN {n}_counts USING (text_id) LEFT JOIN level_sizes z ON z.level = a.level
  LEFT JOIN years_by v ON v.kind = CASE WHEN coalesce(a.level, CASE WHEN NOT is_ambiguous THEN levels[1] END, 'national') = 'national' THEN 'series ' || measure ELSE 'level ' || coalesce(a.level, levels[1]) END),
{n}_gaps AS (
  SELECT *, n_expected = 0 OR n_found < n_expected AS lacks, len(list_filter(years, lambda y: NOT list_contains(available, y))) > 0 AS no_year FROM {n}_counted),
{n}_support AS (
  SELECT *, CASE WHEN measure_status <> 'resolved' THEN 'UNSUPPORTED' WHEN is_ambiguous THEN 'AMBIGUOUS' WHEN is_mismatch OR all_at_level AND evidence_operation <> 'argmax' OR len(years) = 0 THEN 'UNSUPPORTED'
      WHEN n_unavailable > 0 THEN 'UNAVAILABLE' WHEN lacks OR NOT is_exact THEN 'UNSUPPORTED' ELSE 'SUPPORTED' END AS support,
    list_filter(CASE WHEN measure_status <> 'resolved' THEN ['QUERY_NOT_RESOLVED'] WHEN is_ambiguous THEN ['AMBIGUOUS_GEOGRAPHY', CASE WHEN n_unavailable > 0 THEN 'VALUE_NOT_AVAILABLE' END, CASE WHEN evidence_operation IN ('comparison', 'difference', 'argmax') THEN 'INCOMPATIBLE_COMPARISON' END]
      WHEN is_mismatch OR all_at_level AND evidence_operation <> 'argmax' THEN ['REQUESTED_GEOGRAPHY_UNAVAILABLE'] WHEN len(years) = 0 THEN ['QUERY_NOT_RESOLVED']
      WHEN n_unavailable > 0 OR lacks OR NOT is_exact THEN [CASE WHEN n_unavailable > 0 THEN 'VALUE_NOT_AVAILABLE' END, CASE WHEN lacks AND no_year THEN 'REQUESTED_YEAR_UNAVAILABLE' END, CASE WHEN lacks OR NOT is_exact THEN 'MISSING_REQUIRED_OPERANDS' END]
      ELSE ['EVIDENCE_COMPLETE'] END, lambda x: x IS NOT NULL) AS reasons FROM {n}_gaps)"""


_AGE_FORMS = (
    ("at_least", "at least ([0-9]{1,3})(?:[^0-9]|$)"), ("at_least", "(?:^|[^0-9])([0-9]{1,3}) *(?:years? *)?(?:and over|or older|[+])"), ("under", "(?:under|younger than) ([0-9]{1,3})(?:[^0-9]|$)"),
    ("range", "(?:^|[^0-9])([0-9]{1,3}) *(?:[-–—]|to) *[0-9]{1,3}(?:[^0-9]|$)"), ("single", "aged? ([0-9]{1,3})(?:[^0-9]|$)"),
)
_NAMES = f"""{_UNITS},
place_names AS (SELECT DISTINCT {_PHRASE.format("place")} AS name, geography_level AS level, place, area FROM units WHERE geography_level IS NOT NULL AND place IS NOT NULL),
series_names AS (SELECT DISTINCT {_PHRASE.format("series")} AS name, series FROM units WHERE series IS NOT NULL),
band_names AS (SELECT DISTINCT age_group, CAST(regexp_extract(age_group, '^ *([0-9]+)', 1) AS INTEGER) AS band_low, TRY_CAST(regexp_extract(age_group, '^ *[0-9]+ *[-–—] *([0-9]+)', 1) AS INTEGER) AS band_high
  FROM units WHERE regexp_matches(age_group, '^ *[0-9]+ *[-–—] *[0-9]+|^ *[0-9]+ *(Years|years)? *(&|and)? *(Over|over|older|[+])')),
level_sizes AS (SELECT level, count(DISTINCT (place, coalesce(area, ''))) AS n_at_level FROM place_names GROUP BY level),
years_by AS (SELECT 'series ' || series AS kind, list(DISTINCT year) AS available FROM units WHERE series IS NOT NULL GROUP BY 1 UNION ALL SELECT 'level ' || geography_level, list(DISTINCT year) FROM units WHERE series IS NULL AND geography_level IN ('planning_region', 'planning_area', 'subzone') GROUP BY 1)"""
_WHOLE = f"{_NAMES},{_ir_sql('w', 'SELECT example_id AS text_id, question FROM qa_examples')}"
_OPENERS = "|".join(decisions.QUESTION_WORDS + decisions.AUXILIARIES + decisions.REQUESTS)
_BOTH = f"""{_WHOLE},{_ir_sql("c", f"SELECT text_id, nullif(trim(regexp_extract(question, '(?is)^(.*?), *and +(?:{_OPENERS})(?: |$)', 1), ' ,'), '') AS question FROM w_t")},
prem AS (
  SELECT a.text_id, CASE WHEN {_ANY(decisions.FALL)} THEN 'decrease' WHEN {_ANY(decisions.RISE)} THEN 'increase' END AS wanted, {_ANY(decisions.MORE)} AS more, years[1] AS year_1, years[2] AS year_2, CASE WHEN len(places) >= 2 THEN places[1] ELSE sexes[1] END AS side_1,
    CASE WHEN len(places) >= 2 THEN places[2] ELSE sexes[2] END AS side_2, len(places) >= 2 AS by_place FROM w_asked a WHERE is_causal),
prem_sums AS (
  SELECT p.*, sum(value) FILTER (WHERE year = year_1) AS y1, sum(value) FILTER (WHERE year = year_2) AS y2, sum(value) FILTER (WHERE CASE WHEN by_place THEN place ELSE sex END = side_1) AS s1, sum(value) FILTER (WHERE CASE WHEN by_place THEN place ELSE sex END = side_2) AS s2 FROM prem p JOIN w_ev USING (text_id) GROUP BY ALL),
premise AS (
  SELECT text_id, CASE WHEN wanted IS NOT NULL AND year_2 IS NOT NULL AND y1 IS NOT NULL AND y2 IS NOT NULL THEN wanted <> CASE WHEN y2 > y1 THEN 'increase' WHEN y2 < y1 THEN 'decrease' ELSE 'equal' END WHEN more AND side_2 IS NOT NULL AND s1 IS NOT NULL AND s2 IS NOT NULL THEN s1 <= s2 ELSE false END AS is_false FROM prem_sums),
flags AS (
  SELECT w.*, coalesce(is_false, false) AS is_false, c.text_id IS NOT NULL AS has_clause, coalesce(c.support = 'SUPPORTED', false) AS clause_good, w.support = 'SUPPORTED' AS good, {_ANY(decisions.OUTSIDE).replace("words", "w.words")} AS outside, {_ANY(decisions.FORECAST).replace("words", "w.words")} AS forecast,
    {_ANY(decisions.UNDERLYING).replace("words", "w.words")} OR regexp_matches(w.words, '(^| )(true|actual|underlying)( [^ ]+){{0,2}} change( |$)') AS underlying, coalesce(w.level = 'planning_region', false) AND list_contains(w.years, 2019) AND len(list_filter(w.years, lambda y: y >= 2020)) > 0 AS crossing
  FROM w_support w LEFT JOIN c_support c USING (text_id) LEFT JOIN premise p USING (text_id)),
steps AS (SELECT *, (NOT is_causal AND NOT forecast AND NOT outside OR is_causal AND has_clause OR underlying) AND good AS answered, NOT good AND NOT outside AND NOT forecast AS is_open FROM flags),
listed AS (
  SELECT *, list_filter([CASE WHEN answered THEN {{'c': 'descriptive whole ' || support, 'r': reasons}} END, CASE WHEN is_open AND clause_good THEN {{'c': 'descriptive clause SUPPORTED', 'r': ['EVIDENCE_COMPLETE']}} END, CASE WHEN is_open AND NOT (is_causal AND clause_good) THEN {{'c': 'descriptive whole ' || support, 'r': reasons}} END,
    CASE WHEN is_causal THEN {{'c': 'causal whole UNSUPPORTED', 'r': ['CAUSAL_EVIDENCE_MISSING']}} END, CASE WHEN forecast AND clause_good AND NOT answered THEN {{'c': 'descriptive clause SUPPORTED', 'r': ['EVIDENCE_COMPLETE']}} END, CASE WHEN forecast THEN {{'c': 'forecast whole UNSUPPORTED', 'r': ['PREDICTION_REQUESTED']}} END,
    CASE WHEN outside AND clause_good THEN {{'c': 'descriptive clause SUPPORTED', 'r': ['EVIDENCE_COMPLETE']}} END, CASE WHEN outside THEN {{'c': 'out_of_domain whole OUT_OF_SCOPE', 'r': ['UNSUPPORTED_ATTRIBUTE']}} END, CASE WHEN underlying AND crossing THEN {{'c': 'underlying_change whole UNSUPPORTED', 'r': ['BOUNDARY_DEFINITION_CHANGE']}} END], lambda x: x IS NOT NULL) AS made FROM steps),
claimed AS (SELECT * EXCLUDE (made), CASE WHEN len(made) > 0 THEN made ELSE [{{'c': 'descriptive whole UNSUPPORTED', 'r': ['QUERY_NOT_RESOLVED']}}] END AS made FROM listed),
labelled AS (
  SELECT *, CASE WHEN list_bool_and([x.c LIKE '% SUPPORTED' FOR x IN made]) THEN 'ANSWERABLE' WHEN list_bool_or([x.c LIKE '% SUPPORTED' FOR x IN made]) THEN 'PARTIALLY_ANSWERABLE' WHEN list_bool_and([x.c LIKE '% OUT_OF_SCOPE' FOR x IN made]) THEN 'OUT_OF_SCOPE' ELSE 'INSUFFICIENT_EVIDENCE' END AS label FROM claimed),
reasoned AS (
  SELECT *, list_filter(list_concat(flatten([x.r FOR x IN made]), [CASE WHEN crossing AND NOT underlying THEN 'BOUNDARY_DEFINITION_CHANGE' END, CASE WHEN is_false THEN 'FALSE_PREMISE' END, CASE WHEN label = 'PARTIALLY_ANSWERABLE' THEN 'PARTIAL_SUPPORT' END]), lambda x: x IS NOT NULL) AS all_reasons FROM labelled)"""
_CSV = "array_to_string({0}, ',')"
_GOLD = "CASE WHEN {0} IN ('ANSWERABLE', 'PARTIALLY_ANSWERABLE', 'INSUFFICIENT_EVIDENCE', 'OUT_OF_SCOPE') THEN {0} END".format("trim(regexp_replace(upper(answerability), '[^A-Z]+', '_', 'g'), '_')")
_REQUIRED = f"""required AS (
  SELECT DISTINCT example_id, lower(trim(category, ' ')) AS category, lower(trim(e, ' ')) AS evidence_id FROM (SELECT example_id, category, unnest(CAST(coalesce(record_json->'$.required_evidence', record_json->'$.example.required_evidence') AS VARCHAR[])) AS e FROM qa_examples WHERE {_GOLD} IN ('ANSWERABLE', 'PARTIALLY_ANSWERABLE')) WHERE e IS NOT NULL)"""

ORACLES: dict[str, str] = {
    "observations_indicator": f"WITH {_INDICATOR.lstrip()} SELECT evidence_id, load_id, row_id - 1 AS row_id, year, series, status, value FROM indicator",
    "question_ir": f"""WITH {_WHOLE} SELECT text_id AS example_id, measure_status, measure, {_CSV.format("years")} AS years, level, {_CSV.format("places")} AS places, is_ambiguous, is_mismatch, all_at_level, age_kind, {_CSV.format("bands")} AS bands, is_exact,
        {_CSV.format("sexes")} AS sexes, evidence_operation, is_causal FROM w_asked""",
    "structured_evidence": f"WITH {_WHOLE} SELECT text_id AS example_id, rank, evidence_id, status, value FROM w_ev",
    "structured_support": f"WITH {_WHOLE} SELECT text_id AS example_id, n_expected, n_found, n_unavailable, support, {_CSV.format('reasons')} AS reasons FROM w_support",
    "decided": f"""WITH {_BOTH} SELECT text_id AS example_id, label, array_to_string([x.c FOR x IN made], ',') AS claims, array_to_string(list_filter(all_reasons, lambda x, i: NOT list_contains(all_reasons[:i - 1], x)), ',') AS reasons FROM reasoned""",
    "computed": f"""WITH {_BOTH}, sup AS (SELECT DISTINCT text_id, split_part(m.c, ' ', 2) AS part FROM (SELECT text_id, unnest(made) AS m FROM reasoned) WHERE m.c LIKE '% SUPPORTED'),
        both_parts AS (SELECT text_id, 0 AS later, rank, evidence_id, year, place, sex, value FROM w_ev JOIN sup USING (text_id) WHERE part = 'whole' UNION ALL SELECT text_id, 1, rank, evidence_id, year, place, sex, value FROM c_ev JOIN sup USING (text_id) WHERE part = 'clause'),
        once AS (SELECT * FROM both_parts QUALIFY row_number() OVER (PARTITION BY text_id, evidence_id ORDER BY later, rank) = 1),
        n AS (SELECT text_id, count(*) AS n_operands, count(DISTINCT year) AS n_years, count(*) - count(value) AS n_missing, sum(value) AS total, max(value) AS most FROM once GROUP BY text_id),
        o AS (SELECT o.*, n.* EXCLUDE (text_id), CASE WHEN n_operands = 1 THEN 'lookup' ELSE evidence_operation END AS operation, coalesce(list_position(places, place), 1000000) AS place_no, coalesce(list_position(sexes, sex), 1000000) AS sex_no FROM once o JOIN n USING (text_id) JOIN w_asked USING (text_id)),
        p AS (SELECT *, operation IN ('difference', 'comparison', 'trend') AS pairwise FROM o),
        q AS (SELECT text_id, operation, n_operands, n_missing, total, most, list({{'e': evidence_id, 'y': year, 'v': value}} ORDER BY CASE WHEN NOT pairwise THEN later WHEN n_years > 1 THEN year ELSE place_no END, CASE WHEN NOT pairwise THEN rank WHEN n_years > 1 THEN 0 ELSE sex_no END, evidence_id) AS ops,
          count(*) FILTER (WHERE value = most) AS n_most, min(evidence_id) FILTER (WHERE value = most) AS at_most FROM p GROUP BY ALL),
        r AS (SELECT *, CASE WHEN n_missing > 0 THEN 'not_observed' WHEN operation = 'lookup' AND n_operands <> 1 OR operation IN ('difference', 'comparison', 'trend') AND n_operands <> 2 THEN 'operands' WHEN operation = 'argmax' AND n_most <> 1 THEN 'tied' END AS fault FROM q)
        SELECT text_id AS example_id, operation, fault, n_operands, CASE WHEN fault IS NULL THEN 'fact-' || substr(sha256('{{"evidence_ids":["' || array_to_string([x.e FOR x IN ops], '","') || '"],"operation":"' || operation || '"}}'), 1, 16) END AS fact_id,
          CASE WHEN fault IS NULL THEN round(CASE operation WHEN 'lookup' THEN ops[1].v WHEN 'sum' THEN total WHEN 'argmax' THEN most WHEN 'comparison' THEN ops[2].v - ops[1].v ELSE CASE WHEN ops[1].y <> ops[2].y THEN ops[2].v - ops[1].v ELSE ops[1].v - ops[2].v END END, 6) END AS numeric,
          CASE WHEN fault IS NULL THEN CASE operation WHEN 'comparison' THEN CASE WHEN ops[1].v > ops[2].v THEN 'first' WHEN ops[2].v > ops[1].v THEN 'second' ELSE 'equal' END WHEN 'argmax' THEN at_most END END AS winner FROM r""",
    "decision_scores": f"""WITH {_BOTH}, g AS (SELECT lower(trim(category, ' ')) AS category, {_GOLD} AS gold, label AS by_category FROM qa_examples LEFT JOIN reasoned ON text_id = example_id) {ev._metrics_sql("category", "g")}""",
    "selective_risk": f"""WITH {_BOTH}, g AS (SELECT {_GOLD} AS gold, label, example_id IN (SELECT text_id FROM w_ev) AS has_any FROM qa_examples JOIN reasoned ON text_id = example_id),
        p AS (SELECT gold IN {ev._ABSTAIN} AS o, unnest([{{'policy': 'always', 's': true}}, {{'policy': 'any_evidence', 's': has_any}}, {{'policy': 'decision', 's': label IN ('ANSWERABLE', 'PARTIALLY_ANSWERABLE')}}]) AS p FROM g WHERE gold IS NOT NULL)
        SELECT p.policy AS policy, count(*) AS n, {ev._DIV.format("count(*) FILTER (WHERE p.s)", "count(*)")} AS coverage, {ev._DIV.format("count(*) FILTER (WHERE p.s AND o)", "count(*) FILTER (WHERE p.s)")} AS risk,
          {ev._DIV.format("count(*) FILTER (WHERE NOT p.s AND o)", "count(*) FILTER (WHERE o)")} AS abstention_recall, {ev._DIV.format("count(*) FILTER (WHERE p.s AND o)", "count(*) FILTER (WHERE o)")} AS unsupported_rate FROM p GROUP BY 1""",
    "full_recovery": f"""WITH {_WHOLE}, {_REQUIRED} SELECT example_id, category, count(*) AS n_required, count(w_ev.evidence_id) AS n_recovered, count(w_ev.evidence_id) / count(*) AS recovery
        FROM required r LEFT JOIN w_ev ON w_ev.text_id = r.example_id AND w_ev.evidence_id = r.evidence_id GROUP BY ALL""",
    "missing_required": f"""WITH {_UNITS}, r AS (SELECT DISTINCT example_id, lower(trim(e, ' ')) AS evidence_id FROM (SELECT example_id, unnest(CAST(coalesce(record_json->'$.required_evidence', record_json->'$.example.required_evidence') AS VARCHAR[])) AS e FROM qa_examples) WHERE e IS NOT NULL)
        SELECT * FROM r WHERE evidence_id NOT IN (SELECT evidence_id FROM units WHERE evidence_id IS NOT NULL)""",
    "retrieval_report": f"""WITH {_WHOLE}, {_REQUIRED}, ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
        e AS (SELECT example_id, category, k, count(*) AS n_required, count(*) FILTER (WHERE rank <= k) / count(*) AS recall FROM required r CROSS JOIN ks LEFT JOIN w_ev ON w_ev.text_id = r.example_id AND w_ev.evidence_id = r.evidence_id GROUP BY ALL)
        SELECT k, category, n_required, CAST(grouping(k, category, n_required) AS INTEGER) AS grouping, count(*) AS n_examples, round(avg(recall), 9) AS recall FROM e GROUP BY GROUPING SETS ((k), (k, category), (k, n_required))""",
}
