"""The sources and the fields that their payloads should declare."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F


def census_ids() -> dict[str, str]:
    """Field id to column name of the census counts."""
    ages = ["Total", *(f"{a}_{a + 4}" for a in range(0, 90, 5)), "90andOver"]
    return {f"{s}_{a}": f"{s}_{a}".lower() for s in ("Total", "Males", "Females") for a in ages}


@dataclass(frozen=True)
class Source:
    """A published source: its id, its label field and its expected fields."""

    source_id: str
    label: str
    fields: tuple[tuple[str, str], ...]


def sources() -> tuple[Source, ...]:
    """The three sources with (field id, type), years from new to old."""
    years = lambda first, last: tuple((str(y), "numeric") for y in range(last, first - 1, -1))
    return (
        Source("population_indicators_annual", "DataSeries", (("DataSeries", "text"), *years(1950, 2025), ("_id", "int4"))),
        Source("residents_by_planning_region_annual", "DataSeries", (("DataSeries", "text"), *years(2019, 2025), ("_id", "int4"))),
        Source("resident_population_census_2020", "Number", (("Number", "text"), *((i, "text") for i in census_ids()), ("_id", "int4"))),
    )


def field_faults(files: DataFrame) -> DataFrame:
    """Declared fields that their source does not expect, or with another type.

    ``files`` has file_id, source_id, has_list and fields, as
    ``drift.file_fields`` gives them joined to their source.  Result: file_id,
    field_id, fault (unknown or type), declared.  Files without a list declare
    nothing.
    """
    expected = [(s.source_id, i, t) for s in sources() for i, t in s.fields]
    known = files.sparkSession.createDataFrame(expected, "source_id string, field_id string, expected string")
    listed = files.where("has_list").select("file_id", "source_id", F.explode("fields").alias("f")).select("file_id", "source_id", F.col("f.id").alias("field_id"), F.lower(F.trim("f.type")).alias("declared"))
    # The registry is fixed: some hundred and fifty rows.
    rows = listed.where("field_id is not null").join(F.broadcast(known), ["source_id", "field_id"], "left")
    fault = F.when(F.col("expected").isNull(), "unknown").when(F.coalesce("declared", F.lit("")) != F.col("expected"), "type")
    return rows.select("file_id", "field_id", fault.alias("fault"), "declared").where("fault is not null")
