"""Wide tables of published counts to one long table of observations.

An observation has an evidence id, its dimensions, the raw literal, a status
and, if it is observed, a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tallyspan.functions.numbers import is_missing, is_number, number
from tallyspan.functions.text import slug
from tallyspan.operators.fill import fill_forward
from tallyspan.operators.nested import flatten_records
from tallyspan.operators.profile import count_columns, long_cells

INDICATOR_SOURCE = "population_indicators_annual"
REGION_SOURCE = "residents_by_planning_region_annual"
CENSUS_SOURCE = "resident_population_census_2020"
CENSUS_YEAR = 2020
_PARENT = r"^([^ (].*?)(?: \((Male|Female)\))?$"

DIMENSIONS = ["geography_level", "geography", "planning_region", "planning_area", "subzone", "sex", "age_group"]


def parsed(raw: str = "raw") -> dict[str, Column]:
    """status (observed, not_available or invalid) and value of a raw literal."""
    literal = F.col(raw)
    status = F.when(is_missing(literal), "not_available").when(is_number(literal), "observed").otherwise("invalid")
    return {"status": status, "value": F.when(~is_missing(literal), number(literal))}


def region_records(region_rows: DataFrame) -> DataFrame:
    """Adds region, sex and age_group to the rows, from the published order.

    An unindented label names a region and perhaps a sex and stands for all
    ages; an indented one is an age group of the last such label.  Rows before
    any such label get no region.
    """
    label = F.rtrim("data_series")
    parent = F.when(~label.startswith(" "), F.struct(F.regexp_extract(label, _PARENT, 1).alias("region"), F.coalesce(F.nullif(F.regexp_extract(label, _PARENT, 2), F.lit("")), F.lit("Total")).alias("sex")))
    rows = fill_forward(region_rows.withColumn("_parent", parent), ["load_id"], "row_id", "_parent")
    return rows.withColumns(
        {"region": F.col("_parent.region"), "sex": F.col("_parent.sex"), "age_group": F.when(label.startswith(" "), F.trim(label)).when(label.isNotNull(), "Total")}
    ).drop("_parent")


def latest_records(rows: DataFrame) -> DataFrame:
    """The row of the last load (then the last row) of each record.

    A row holds all columns of its record, so this is also the last observation
    of each evidence id, found before the rows are unpivoted.
    """
    best = rows.groupBy("record_id").agg(F.max(F.struct("load_id", "row_id")).alias("b")).select(F.col("b.row_id").alias("row_id"))
    return rows.join(best, "row_id", "left_semi")


def region_observations(region_rows: DataFrame, only_latest: bool = False) -> DataFrame:
    """One row per region row and year, of all loads or the latest records."""
    rows = region_records(region_rows)
    rows = latest_records(rows) if only_latest else rows
    long = long_cells(rows, ["row_id", "load_id", "record_id", "region", "sex", "age_group"], count_columns(region_rows))
    year = F.substring("column_name", 2, 4).cast("int")
    evidence = F.concat(F.lit(f"{REGION_SOURCE}:r"), F.col("record_id"), F.lit(":y"), year)
    none = F.lit(None).cast("string")
    return long.select(
        evidence.alias("evidence_id"), F.lit(REGION_SOURCE).alias("source_id"), "load_id", "row_id", "record_id", year.alias("year"),
        F.lit("planning_region").alias("geography_level"), none.alias("geography"), F.col("region").alias("planning_region"), none.alias("planning_area"), none.alias("subzone"),
        "sex", "age_group", "raw",
    ).withColumns(parsed())


def census_records(census_rows: DataFrame) -> DataFrame:
    """Adds geography_level, area and subzone, from the published order.

    ``Total`` is national and ends the current area; ``X - Total`` is a planning
    area and becomes the current one; other labels are subzones of the current
    area and have none after a national row.
    """
    label = F.trim("number_label")
    none = F.lit(None).cast("string")
    opens = (
        F.when(F.lower(label) == "total", F.struct(none.alias("area")))
        .when(label.rlike(" - Total$"), F.struct(F.regexp_replace(label, " - Total$", "").alias("area")))
    )
    rows = fill_forward(census_rows.withColumn("_area", opens), ["load_id"], "row_id", "_area")
    level = F.when(F.lower(label) == "total", "national").when(label.rlike(" - Total$"), "planning_area").when(label.isNotNull(), "subzone")
    return rows.withColumns({"geography_level": level, "area": F.col("_area.area"), "subzone": F.when(level == "subzone", label)}).drop("_area")


def census_column(column: Column) -> dict[str, Column]:
    """sex and age_group that a census column stands for."""
    sex = F.split_part(column, F.lit("_"), F.lit(1))
    age = F.regexp_replace(column, "^[a-z]+_", "")
    return {
        "sex": F.when(sex == "males", "Male").when(sex == "females", "Female").otherwise("Total"),
        "age_group": F.when(age == "total", "Total").when(age == "90andover", "90 Years & Over").otherwise(F.concat(F.replace(age, F.lit("_"), F.lit(" - ")), F.lit(" Years"))),
    }


def census_observations(census_rows: DataFrame, only_latest: bool = False) -> DataFrame:
    """One row per census row and count column, of all loads or the latest records."""
    rows = census_records(census_rows)
    rows = latest_records(rows) if only_latest else rows
    long = long_cells(rows, ["row_id", "load_id", "record_id", "geography_level", "area", "subzone"], count_columns(census_rows))
    long = long.withColumns(census_column(F.col("column_name")))
    evidence = F.concat(F.lit(f"{CENSUS_SOURCE}:r"), F.col("record_id"), F.lit(f":y{CENSUS_YEAR}:age_group="), slug(F.col("age_group")), F.lit(":sex="), slug(F.col("sex")))
    none = F.lit(None).cast("string")
    return long.select(
        evidence.alias("evidence_id"), F.lit(CENSUS_SOURCE).alias("source_id"), "load_id", "row_id", "record_id", F.lit(CENSUS_YEAR).alias("year"),
        "geography_level", F.when(F.col("geography_level") == "national", "Talmera").alias("geography"), none.alias("planning_region"), F.col("area").alias("planning_area"), "subzone",
        "sex", "age_group", "raw",
    ).withColumns(parsed())


def indicator_observations(payloads: DataFrame) -> DataFrame:
    """One row per record and year of the national indicator payloads.

    The series is the record's trimmed label; its columns are those of the other
    sources, and ``series``.  Records of renamed label or year fields have none;
    ``drift.promote`` brings those back.
    """
    rows = flatten_records(payloads.where(F.col("source_id") == INDICATOR_SOURCE))
    rows = rows.where("record_id is not null").select(F.col("file_id").alias("load_id"), "record_no", "record_id", F.trim(F.col("members")["DataSeries"]).alias("series"), F.explode("members").alias("field", "raw"))
    rows = rows.where(F.col("field").rlike(r"^(?:19|20)[0-9]{2}\z")).withColumn("year", F.col("field").cast("int"))
    evidence = F.concat(F.lit(f"{INDICATOR_SOURCE}:r"), F.col("record_id"), F.lit(":y"), F.col("year"))
    none = F.lit(None).cast("string")
    return rows.select(
        evidence.alias("evidence_id"), F.lit(INDICATOR_SOURCE).alias("source_id"), "load_id", F.col("record_no").cast("long").alias("row_id"), F.col("record_id").cast("int").alias("record_id"), "year",
        F.lit("national").alias("geography_level"), F.lit("Talmera").alias("geography"), none.alias("planning_region"), none.alias("planning_area"), none.alias("subzone"),
        none.alias("sex"), none.alias("age_group"), "raw", "series",
    ).withColumns(parsed())


def latest_of(observations: DataFrame) -> DataFrame:
    """The observation of the last load (then the last row) of each evidence id."""
    newest = F.max_by(F.struct(*(c for c in observations.columns if c != "evidence_id")), F.struct("load_id", "row_id"))
    return observations.groupBy("evidence_id").agg(newest.alias("_o")).select("evidence_id", "_o.*")


def units_of(observations: DataFrame) -> DataFrame:
    """Observations with their place, its area (of a subzone) and series."""
    series = F.col("series") if "series" in observations.columns else F.lit(None).cast("string")
    place = F.coalesce("planning_region", "subzone", "planning_area", "geography")
    area = F.when(F.col("geography_level") == "subzone", F.col("planning_area"))
    return observations.select("evidence_id", "source_id", "geography_level", place.alias("place"), area.alias("area"), "year", "sex", "age_group", series.alias("series"), "status", "value")


def entity(order: tuple[str, ...] = ("planning_region", "subzone", "planning_area", "geography")) -> Column:
    """The finest name of an observation's place."""
    return F.coalesce(*order, F.lit("Talmera"))


def searchable_text(dataset: str, publisher: str) -> Column:
    """The sentence form of an observation, for lexical retrieval."""
    part = lambda name: F.concat(F.lit(f"{name.replace('_', ' ').capitalize()}: "), F.col(name), F.lit("."))
    seen = F.concat(F.lit("Published value: "), F.trim("raw"), F.lit("."))
    unseen = F.concat(F.lit("Published value: not available. Source marker: "), F.coalesce(F.nullif(F.trim("raw"), F.lit("")), F.lit("null")), F.lit("."))
    year = F.concat(F.lit("Year: "), F.col("year"), F.lit("."))
    return F.concat_ws(" ", F.lit(f"Dataset: {dataset}."), F.lit(f"Publisher: {publisher}."), year, *(part(d) for d in DIMENSIONS), F.when(F.col("status") == "observed", seen).otherwise(unseen))


def duplicate_ids(observations: DataFrame) -> DataFrame:
    """Evidence ids that occur more than once in a load."""
    return observations.groupBy("load_id", "evidence_id").agg(F.count("*").alias("n_rows")).where("n_rows > 1")
