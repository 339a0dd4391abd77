"""The queries of the general training-data problems, p1, p2, p3 and p5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyspan.operators import drift, nested, profile, rowparse
from tallyspan.plans import drift_sql, nested_sql
from tallyspan.session import materialise, table


def p1_records(spark: SparkSession, sf: str) -> DataFrame:
    """All records of all payloads, each with its file and parent record."""
    return nested.flatten_records(table(spark, sf, "source_payloads"), carry=["source_id"])


def p1_claims(spark: SparkSession, sf: str) -> DataFrame:
    """All claims of all examples, each with its parent claim."""
    return nested.flatten_claims(table(spark, sf, "qa_examples"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """One row per evidence link, resolved to the record it names."""
    links = nested.flatten_evidence(table(spark, sf, "qa_examples"))
    records = nested.flatten_records(table(spark, sf, "source_payloads"), carry=["source_id"], only=["_id"])
    found = nested.link_evidence(links, records)
    return found.select("example_id", "claim_no", "evidence_no", "record_id")


# Further fields that the consistent table takes up.
APPROVED = {
    "Unit": ("unit", "string"),
    "Remarks": ("remarks", "string"),
    "Footnote_No": ("footnote_no", drift.COUNT),
    "revised_flag": ("revised_flag", "string"),
}


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    """Every change of a file against its predecessor, with old id and types."""
    payloads = table(spark, sf, "source_payloads")
    return drift.changes(payloads, materialise(drift.ingest_payloads(payloads)))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """The changes by file, field and kind."""
    return p2_report(spark, sf).select("file_id", "field_id", "change_kind")


def p2_table(spark: SparkSession, sf: str) -> DataFrame:
    """All records in one table: typed, renamed fields replayed, rest as JSON.

    Years that no source declares have columns after the approved fields.
    """
    payloads = table(spark, sf, "source_payloads")
    ingested = materialise(drift.ingest_payloads(payloads))
    return drift.promote(ingested, drift.history(payloads, ingested), APPROVED | drift.further_years(ingested))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The unsound lines with the first reason that holds."""
    return rowparse.unsound_lines(table(spark, sf, "region_lines")).select("line_id", "reason")


def p3_faults(spark: SparkSession, sf: str) -> DataFrame:
    """The unsound lines with the place of the fault."""
    return rowparse.unsound_lines(table(spark, sf, "region_lines"))


def p3_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The sound lines with typed values."""
    return rowparse.typed_rows(table(spark, sf, "region_lines"))


# The wide tables, with the columns whose shift is reported.
WIDE = {"census_rows": ["total_total", "males_0_4"], "region_rows": ["y2020"]}


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Faulty cells and shifted columns of both wide tables."""
    found = []
    for name, watched in WIDE.items():
        rows = table(spark, sf, name)
        shifts = profile.load_shifts(rows, table(spark, sf, "source_loads"), name, watched).where("is_shift")
        shifts = shifts.select(F.lit("shift").alias("check_kind"), F.col("load_id").alias("key_id"), "column_name")
        cells = profile.faulty_cells(rows, "row_id", profile.count_columns(rows))
        found.append(cells.unionByName(shifts).withColumn("table_name", F.lit(name)))
    return found[0].unionByName(found[1]).select("check_kind", "table_name", "key_id", "column_name")


def p5_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls, distinct values, range and faults of every count column."""
    parts = [profile.profile(table(spark, sf, n), profile.count_columns(table(spark, sf, n))).withColumn("table_name", F.lit(n)) for n in WIDE]
    return parts[0].unionByName(parts[1])


def p5_profile_all(spark: SparkSession, sf: str) -> DataFrame:
    """Nulls, markers and distinct values of every column; range and faults of
    the count columns."""
    parts = []
    for name in WIDE:
        rows = table(spark, sf, name)
        parts.append(profile.profile(rows, rows.columns, profile.count_columns(rows)).withColumn("table_name", F.lit(name)))
    return parts[0].unionByName(parts[1])


def p5_shifts(spark: SparkSession, sf: str) -> DataFrame:
    """Every count column of every load against the load before.

    Means and what follows from them are given to six decimals, skewness to four.
    """
    loads = table(spark, sf, "source_loads")
    parts = []
    for name in WIDE:
        rows = table(spark, sf, name)
        parts.append(profile.load_shifts(rows, loads, name, profile.count_columns(rows)).withColumn("table_name", F.lit(name)))
    both = parts[0].unionByName(parts[1])
    six = ("mean", "prev_mean", "deviation", "prev_deviation", "mean_difference")
    return both.withColumns({c: F.round(c, 6) for c in six} | {"skewness_difference": F.round("skewness_difference", 4)})


QUERIES = {f.__name__: f for f in (p1_found, p1_records, p1_claims, p2_found, p2_report, p2_table, p3_found, p3_faults, p3_rows, p5_found, p5_profile, p5_profile_all, p5_shifts)}
_CENSUS = "COLUMNS('^(total|males|females)_')"
_YEARS = "y2025, y2024, y2023, y2022, y2021, y2020, y2019"
_NUMBER = r"'[+-]?([0-9]+|[0-9]+\.[0-9]*|[0-9]*\.[0-9]+)'"
_MISSING = "(raw IS NULL OR lower(trim(raw, ' ')) IN ('', '-', 'na', 'n.a.', 'null'))"
_IS_NUMBER = f"regexp_full_match(trim(raw, ' '), {_NUMBER})"
_CELLS = f"""cells AS (
  SELECT 'census_rows' AS table_name, row_id, load_id, column_name, raw FROM census_rows UNPIVOT INCLUDE NULLS (raw FOR column_name IN ({_CENSUS}))
  UNION ALL SELECT 'region_rows', row_id, load_id, column_name, raw FROM region_rows UNPIVOT INCLUDE NULLS (raw FOR column_name IN ({_YEARS}))),
typed AS (SELECT *, {_MISSING} AS is_missing, CASE WHEN {_IS_NUMBER} THEN TRY_CAST(trim(raw, ' ') AS DOUBLE) END AS value FROM cells)"""
_WATCHED = " OR ".join(f"(table_name = '{t}' AND column_name IN ({', '.join(repr(c) for c in cs)}))" for t, cs in WIDE.items())
_FIELD = r"""'(?:"(?:[^"]|"")*"|[^"\r\n' || (CASE delim WHEN '|' THEN '\|' ELSE delim END) || ']*)'"""
_MARK = r"(CASE delim WHEN '|' THEN '\|' ELSE delim END)"

ORACLES: dict[str, str] = {
    "p1_found": nested_sql.P1_FOUND,
    "p1_claims": nested_sql.P1_CLAIMS,
    "p2_found": drift_sql.P2_FOUND,
    "p2_report": drift_sql.P2_REPORT,
    "p3_found": rf"""WITH l AS (
        SELECT line_id, file_no, line_no, regexp_full_match(raw_line, {_FIELD} || '(?:' || {_MARK} || {_FIELD} || ')*') AS quoted_well,
          [CASE WHEN starts_with(x, '"') THEN replace(x[2:-2], '""', '"') ELSE x END FOR x IN regexp_extract_all(delim || raw_line, {_MARK} || '(' || {_FIELD} || ')', 1)] AS fields FROM region_lines),
      h AS (SELECT file_no, arg_min(fields, line_id) AS names FROM l WHERE line_no = 0 AND quoted_well GROUP BY file_no),
      j AS (SELECT line_id, quoted_well, fields, names, len(list_filter(list_zip(names, fields), lambda x: CASE
          WHEN x[1] = 'DataSeries' THEN trim(x[2], ' ') = '' WHEN x[1] = '_id' THEN NOT regexp_full_match(trim(x[2], ' '), '0*[1-9][0-9]*')
          WHEN regexp_full_match(x[1], '[0-9]{{4}}') THEN NOT (lower(trim(x[2], ' ')) IN ('', '-', 'na', 'n.a.', 'null') OR regexp_full_match(trim(x[2], ' '), {_NUMBER})) ELSE false END)) AS n_bad
        FROM l LEFT JOIN h USING (file_no) WHERE line_no <> 0),
      r AS (SELECT line_id, CASE WHEN NOT quoted_well THEN 'quoting' WHEN names IS NULL OR len(fields) <> len(names) THEN 'column_count' WHEN n_bad > 0 THEN 'invalid_value' END AS reason FROM j)
      SELECT line_id, reason FROM r WHERE reason IS NOT NULL""",
    "p5_found": f"""WITH {_CELLS},
      described AS (SELECT table_name, load_id, column_name, count(*) AS n, count(*) FILTER (WHERE is_missing) AS m, median(value) FILTER (WHERE value BETWEEN 0 AND 10000000) AS med FROM typed WHERE {_WATCHED} GROUP BY ALL),
      chain AS (SELECT DISTINCT target_table, load_id, prev_load_id FROM source_loads WHERE prev_load_id IS NOT NULL)
      SELECT 'pattern' AS check_kind, table_name, row_id AS key_id, column_name FROM typed WHERE NOT is_missing AND value IS NULL
      UNION ALL SELECT 'range', table_name, row_id, column_name FROM typed WHERE value < 0 OR value > 10000000
      UNION ALL SELECT 'shift', d.table_name, d.load_id, d.column_name FROM described d JOIN chain c ON c.target_table = d.table_name AND c.load_id = d.load_id
        JOIN described b ON b.table_name = d.table_name AND b.load_id = c.prev_load_id AND b.column_name = d.column_name
        WHERE abs(d.m * b.n - b.m * d.n) * 100 > 15 * d.n * b.n OR d.med > 2 * b.med OR b.med > 2 * d.med""",
    "p5_shifts": f"""WITH {_CELLS},
      inside AS (SELECT *, CASE WHEN value BETWEEN 0 AND 10000000 THEN value END AS v FROM typed),
      first AS (SELECT table_name, load_id, column_name, count(*) AS n, count(*) FILTER (WHERE is_missing) AS m, median(v) AS med, avg(v) AS mean, stddev_pop(v) AS sd FROM inside GROUP BY ALL),
      third AS (SELECT table_name, load_id, column_name, avg((v - mean) ** 3) AS m3 FROM inside JOIN first USING (table_name, load_id, column_name) GROUP BY ALL),
      d AS (SELECT *, CASE WHEN sd > 0 THEN m3 / sd ** 3 END AS skew FROM first JOIN third USING (table_name, load_id, column_name)),
      p AS (SELECT d.*, b.n AS bn, b.m AS bm, b.med AS bmed, b.mean AS bmean, b.sd AS bsd, b.skew AS bskew FROM d
        JOIN (SELECT DISTINCT target_table, load_id, prev_load_id FROM source_loads WHERE prev_load_id IS NOT NULL) c ON c.target_table = d.table_name AND c.load_id = d.load_id
        JOIN d b ON b.table_name = d.table_name AND b.load_id = c.prev_load_id AND b.column_name = d.column_name)
      SELECT table_name, load_id, column_name, m / n AS share_missing, bm / bn AS prev_share_missing, round(mean, 6) AS mean, round(bmean, 6) AS prev_mean, round(sd, 6) AS deviation, round(bsd, 6) AS prev_deviation,
        round((mean - bmean) / nullif(sqrt((sd ** 2 + bsd ** 2) / 2), 0), 6) AS mean_difference, coalesce(abs((mean - bmean) / nullif(sqrt((sd ** 2 + bsd ** 2) / 2), 0)) > 0.5, false) AS is_mean_shift,
        round(skew - bskew, 4) AS skewness_difference, med AS median, bmed AS prev_median,
        abs(m * bn - bm * n) * 100 > 15 * n * bn OR coalesce(med > 2 * bmed OR bmed > 2 * med, false) AS is_shift FROM p""",
    "p5_profile": f"""WITH {_CELLS} SELECT table_name, column_name, count(*) AS n_rows, count(*) FILTER (WHERE raw IS NULL) AS n_null, count(*) FILTER (WHERE raw IS NOT NULL AND is_missing) AS n_marker, count(DISTINCT raw) AS n_distinct,
      min(value) AS min_value, max(value) AS max_value, count(*) FILTER (WHERE NOT is_missing AND value IS NULL) AS n_pattern, count(*) FILTER (WHERE value < 0 OR value > 10000000) AS n_range FROM typed GROUP BY ALL""",
    "p5_profile_all": f"""WITH cells AS (
        SELECT 'census_rows' AS table_name, column_name, raw, regexp_matches(column_name, '^(total|males|females)_') AS is_count FROM (SELECT COLUMNS('(.*)')::VARCHAR AS '\\1' FROM census_rows) UNPIVOT INCLUDE NULLS (raw FOR column_name IN (*))
        UNION ALL SELECT 'region_rows', column_name, raw, regexp_matches(column_name, '^y[0-9]{{4}}$') FROM (SELECT COLUMNS('(.*)')::VARCHAR AS '\\1' FROM region_rows) UNPIVOT INCLUDE NULLS (raw FOR column_name IN (*))),
      typed AS (SELECT *, {_MISSING} AS is_missing, CASE WHEN is_count AND {_IS_NUMBER} THEN TRY_CAST(trim(raw, ' ') AS DOUBLE) END AS value FROM cells)
      SELECT table_name, column_name, count(*) AS n_rows, count(*) FILTER (WHERE raw IS NULL) AS n_null, count(*) FILTER (WHERE raw IS NOT NULL AND is_missing) AS n_marker, count(DISTINCT raw) AS n_distinct, min(value) AS min_value, max(value) AS max_value,
      CASE WHEN is_count THEN count(*) FILTER (WHERE NOT is_missing AND value IS NULL) END AS n_pattern, CASE WHEN is_count THEN count(*) FILTER (WHERE value < 0 OR value > 10000000) END AS n_range FROM typed GROUP BY table_name, column_name, is_count""",
}
