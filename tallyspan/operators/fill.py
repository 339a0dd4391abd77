"""Fill-forward over long groups, in blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

BLOCK = 100_000


def fill_forward(df: DataFrame, group: Sequence[str], order: str, value: str, block: int = BLOCK) -> DataFrame:
    """Replaces nulls of ``value`` by the last value before them in their group.

    ``order`` is a whole number, unique within a group.  Each group is cut into
    blocks of ``block`` order numbers; a window fills within the blocks and the
    last value of each block is carried over, so a group that holds much of the
    table is spread over its blocks.  A leading null stays null.
    """
    rows = df.withColumn("_block", F.floor(F.col(order) / block))
    inner = Window.partitionBy(*group, "_block").orderBy(order)
    rows = rows.withColumn("_own", F.last(value, ignorenulls=True).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.where(F.col(value).isNotNull()).groupBy(*group, "_block").agg(F.max_by(value, order).alias("_end"))
    blocks = df.withColumn("_block", F.floor(F.col(order) / block)).select(*group, "_block").distinct().join(ends, [*group, "_block"], "left")
    before = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select(*group, "_block", F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    rows = rows.join(carried, [*group, "_block"], "left")
    return rows.withColumn(value, F.coalesce("_own", "_carried")).drop("_block", "_own", "_carried")
