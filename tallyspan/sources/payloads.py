"""Checks of delivered payloads against their own envelope."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyspan.functions.loose_json import objects
from tallyspan.operators.nested import flatten_records


def payload_checks(payloads: DataFrame) -> DataFrame:
    """One row per payload: what its envelope says and what it holds.

    Result: file_id, is_success, resource_matches, total, row_limit (null where
    not given), n_records, n_bad_ids (no whole number of 1 or more), n_repeated_ids
    (records beyond the first of their id), is_sound.  A body that is no envelope
    is not sound.
    """
    envelope = F.get(objects(F.col("body"), "success string, result string"), F.lit(0))
    members = F.get(objects(F.col("e.result"), "resource_id string, total string, `limit` string"), F.lit(0))
    read = payloads.select("file_id", F.col("resource_id").alias("named"), envelope.alias("e")).withColumn("r", members)
    read = read.select(
        "file_id",
        F.coalesce(F.lower(F.col("e.success")) == "true", F.lit(False)).alias("is_success"),
        F.coalesce(F.col("r.resource_id") == F.col("named"), F.lit(False)).alias("resource_matches"),
        F.col("r.total").try_cast("long").alias("total"),
        F.col("r.limit").try_cast("long").alias("row_limit"),
    )
    records = flatten_records(payloads)
    ids = records.groupBy("file_id", "record_id").agg(F.count("*").alias("n"))
    counts = ids.groupBy("file_id").agg(
        F.sum("n").alias("n_records"),
        F.sum(F.when(F.col("record_id").isNull() | (F.col("record_id") < 1), F.col("n")).otherwise(0)).alias("n_bad_ids"),
        F.sum(F.when(F.col("record_id") >= 1, F.col("n") - 1).otherwise(0)).alias("n_repeated_ids"),
    )
    rows = read.join(counts, "file_id", "left").na.fill(0, ["n_records", "n_bad_ids", "n_repeated_ids"])
    sound = F.col("is_success") & F.col("resource_matches") & (F.coalesce(F.col("total"), F.col("n_records")) == F.col("n_records"))
    sound = sound & (F.coalesce(F.col("row_limit"), F.col("n_records")) >= F.col("n_records")) & (F.col("n_bad_ids") == 0) & (F.col("n_repeated_ids") == 0)
    return rows.withColumn("is_sound", sound)
