"""The checks of wide tables on a stream of arriving files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tallyspan.operators.profile import SUMS, count_columns, faulty_cells, power_sums


def read_loads(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Parquet files of a wide table as they arrive in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def stream_faults(rows: DataFrame, key: str = "row_id") -> DataFrame:
    """Faulty cells of arriving rows; stateless, for append output."""
    return faulty_cells(rows, key, count_columns(rows))


def merge_power_sums(rows: DataFrame, folder: str, checkpoint: str):
    """Starts a query that keeps partial power sums of each batch in ``folder``.

    A batch writes its own subfolder, so a batch that is repeated after a
    failure replaces its sums and none count twice.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        power_sums(batch, "load_id", count_columns(batch)).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    return rows.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).start()


def merged_power_sums(spark: SparkSession, folder: str) -> DataFrame:
    """The sums of all batches so far, per load and column."""
    parts = spark.read.parquet(folder)
    # The sums keep their types: a sum of sums has room for as many digits.
    return parts.groupBy("load_id", "column_name").agg(*(F.sum(n).cast(parts.schema[n].dataType).alias(n) for n in SUMS))
