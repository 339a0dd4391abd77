"""Facts computed from observations: sums, differences, comparisons, maxima."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspan.functions.text import age_band, number_text


def bands_for(bands: DataFrame, constraints: DataFrame) -> DataFrame:
    """Joins age constraints (kind, low, high) to the published bands they cover.

    at_least: bands from the age on; under: closed bands below it; range: bands
    within.  ``bands`` is a small table of distinct labels.
    """
    b = bands.select("age_group", age_band(F.col("age_group")).alias("band")).where("band is not null")
    b = b.select("age_group", F.col("band.low").alias("band_low"), F.col("band.high").alias("band_high"))
    covered = (
        ((F.col("kind") == "at_least") & (F.col("band_low") >= F.col("low")))
        | ((F.col("kind") == "under") & (F.col("band_high") < F.col("high")))
        | ((F.col("kind") == "range") & (F.col("band_low") >= F.col("low")) & (F.col("band_high") <= F.col("high")))
    )
    # Published age labels: a few dozen, whatever the size of the data.
    return constraints.join(F.broadcast(b), covered)


def exactness(covered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Whether the covered bands meet each other and the constraint's ends."""
    order = Window.partitionBy(*keys).orderBy("band_low")
    rows = covered.withColumn("_gap", F.coalesce(F.col("band_low") != F.lag("band_high").over(order) + 1, F.lit(False)))
    ends = rows.groupBy(*keys, "kind", "low", "high").agg(
        F.count("*").alias("n_bands"), F.min("band_low").alias("first"), F.max("band_high").alias("last"), F.max(F.col("band_high").isNull()).alias("is_open"), F.max("_gap").alias("has_gap")
    )
    starts = F.col("first") == F.coalesce("low", F.lit(0))
    stops = F.when(F.col("kind") == "at_least", F.col("is_open")).when(F.col("kind") == "under", F.col("last") == F.col("high") - 1).otherwise(F.col("last") == F.col("high"))
    return ends.withColumn("is_exact", starts & F.coalesce(stops, F.lit(False)) & ~F.col("has_gap"))


def sum_over(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sum of the observed values, with the number of operands and of gaps."""
    return df.groupBy(*keys).agg(F.sum("value").alias("total"), F.count("value").alias("n_observed"), F.count_if(F.col("value").isNull()).alias("n_missing"))


def difference(df: DataFrame, keys: Sequence[str], on: str, first: object, second: object) -> DataFrame:
    """second − first of the values at two points of ``on``; both must be there."""
    at = lambda point: F.max(F.when(F.col(on) == F.lit(point), F.col("value")))
    sides = df.where(F.col(on).isin(first, second)).groupBy(*keys).agg(at(first).alias("first_value"), at(second).alias("second_value"))
    relation = F.when(F.col("second_value") > F.col("first_value"), "second").when(F.col("second_value") < F.col("first_value"), "first").otherwise("equal")
    sides = sides.where("first_value is not null and second_value is not null")
    return sides.withColumns({"difference": F.col("second_value") - F.col("first_value"), "larger": relation})


def unique_maximum(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """The largest value of each group and its name; null where it is tied.

    Count and maximum come from one pass: values are first reduced per value.
    """
    values = df.where("value is not null").groupBy(*keys, "value").agg(F.count_distinct(name).alias("n"), F.min(name).alias("winner"))
    best = values.groupBy(*keys).agg(F.max(F.struct("value", "n", "winner")).alias("b"))
    return best.select(*keys, F.col("b.value").alias("maximum"), F.when(F.col("b.n") == 1, F.col("b.winner")).alias("winner"), F.col("b.n").alias("n_at_maximum"))


def operand_label(place: Column) -> Column:
    """Place, year, age group and sex (unless Total) of an operand."""
    shown = lambda c: F.when(F.col(c) != "Total", F.col(c))
    return F.concat_ws(", ", place, F.col("year"), shown("age_group"), shown("sex"))


def fact_id(operation: str | Column, evidence_ids: Column) -> Column:
    """``fact-`` and 16 hex digits of the hash of operation and evidence ids."""
    text = F.to_json(F.struct(evidence_ids.alias("evidence_ids"), F.lit(operation).alias("operation")))
    return F.concat(F.lit("fact-"), F.substring(F.sha2(text, 256), 1, 16))


def statement(place: Column) -> Column:
    """``label: number`` of an observed operand."""
    return F.concat(operand_label(place), F.lit(": "), number_text(F.col("value")))
