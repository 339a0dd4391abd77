"""Column-level quality profile of wide tables and its change between loads.

Cell faults come from one unpivoted scan.  Numeric shifts are described by
exact power sums per load and column, which merge by addition, and by
differences standardised over a load and its predecessor; medians, which no
power sums give, are exact, taken from a mergeable histogram of values.  Both
come from one count of the values, so that no load's values ever meet in one
task.

Defined cases: null and missing-value markers are missing, not faults; numbers
outside the range are counted and do not enter a median; a load without
numbers has a null median and takes part in no median shift; a load whose
predecessor is null or absent has no shift; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence
from decimal import Decimal
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyspan.functions.numbers import is_missing, is_number, number
from tallyspan.session import materialise

LOWEST, HIGHEST = 0, 10_000_000
MISSING_SHIFT = 0.15
MEDIAN_RATIO = 2
MEAN_SHIFT = 0.5
_BIN = 4096
_COUNT_COLUMN = re.compile(r"(total|males|females)_(total|\d+_\d+|\d+andover)|y(19|20)\d\d")


def count_columns(df: DataFrame) -> list[str]:
    """The count columns of a wide table: sex and age counts, or years."""
    return [c for c in df.columns if _COUNT_COLUMN.fullmatch(c)]


def long_cells(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Unpivots ``columns`` to (column_name, raw) and keeps ``keys``.

    An array and its explosion: with sixty columns the code that is generated
    for ``unpivot`` outgrows what the JVM compiles.
    """
    cells = F.array(*(F.col(c).cast("string") for c in columns))
    long = df.select(*keys, F.posexplode(cells).alias("_place", "raw"))
    return long.select(*keys, F.element_at(F.array(*map(F.lit, columns)), F.col("_place") + 1).alias("column_name"), "raw")


def faulty_cells(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(check_kind, key_id, column_name) of cells that break a rule.

    ``pattern``: neither missing nor a number; ``range``: a number below 0 or
    above 10,000,000.
    """
    # A whole number of up to seven digits and a dash break no rule; they are
    # most cells, and one look tells.
    cells = long_cells(df, [key], columns).where(F.col("raw").isNotNull() & (F.col("raw") != "-") & ~F.col("raw").rlike(r"^[0-9]{1,7}\z"))
    value = number(F.col("raw"))
    kind = F.when(is_number(F.col("raw")), F.when((value < LOWEST) | (value > HIGHEST), "range")).when(~is_missing(F.col("raw")), "pattern")
    return cells.select(kind.alias("check_kind"), F.col(key).cast("long").alias("key_id"), "column_name").where("check_kind is not null")


def value_counts(df: DataFrame, load: str, columns: Sequence[str]) -> DataFrame:
    """(load, column_name, raw, n): how often each value stands in each column of
    each load.  Sums and medians both come from these counts, which merge."""
    return long_cells(df, [load], columns).groupBy(load, "column_name", "raw").agg(F.count("*").alias("n"))


#: Names of the sums that are kept, all of which merge by addition.
SUMS = ("n_rows", "n_missing", "n_numbers", "n_rounded", "s1", "s2", *(f"s{p}_{k}" for p in (3, 4) for k in range(p + 1)))


def summed(counts: DataFrame, load: str) -> DataFrame:
    """Per load and column the counts and exact sums named in SUMS.

    ``counts`` is of :func:`value_counts`.  Sums are of whole millionths: s1 of
    the numbers, s2 of their squares.  Third and fourth powers outgrow a
    decimal, so a number is split into its whole part a and its millionths b,
    and s3_k and s4_k are the sums of the terms of (a + b)^p with a^k.  Values
    with more than six decimals are rounded to six and counted in n_rounded;
    numbers out of range are left out.
    """
    raw = F.col("raw")
    value = number(raw)
    inside = F.when((value >= LOWEST) & (value <= HIGHEST), F.trim(raw))
    x = inside.try_cast("decimal(14,6)")
    rows = counts.select(load, "column_name", "n", is_missing(raw).alias("_missing"), x.alias("x"), inside.rlike(r"\.[0-9]{6}[0-9]*[1-9]").alias("_rounded"))
    rows = rows.withColumn("a", F.floor("x").cast("decimal(8,0)")).withColumn("v", (F.col("x") * 1_000_000).cast("decimal(14,0)"))
    rows = rows.withColumn("b", (F.col("v") - F.col("a") * 1_000_000).cast("decimal(6,0)")).withColumn("_n", F.col("n").cast("decimal(11,0)"))

    def total(factors: list[str], digits: int, times: int = 1) -> Column:
        made = F.lit(times).cast("decimal(1,0)")
        for factor in factors:
            made = made * F.col(factor)
        return F.sum((made.cast(f"decimal({digits},0)") * F.col("_n")).cast("decimal(38,0)")).cast("decimal(38,0)")

    return rows.groupBy(load, "column_name").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(F.col("_missing"), F.col("n")).otherwise(0)).alias("n_missing"),
        F.sum(F.when(F.col("x").isNotNull(), F.col("n")).otherwise(0)).alias("n_numbers"),
        F.sum(F.when(F.col("_rounded"), F.col("n")).otherwise(0)).alias("n_rounded"),
        total(["v"], 14).alias("s1"),
        total(["v", "v"], 28).alias("s2"),
        *(total(["a"] * k + ["b"] * (p - k), 7 * k + 6 * (p - k) + 2, math.comb(p, k)).alias(f"s{p}_{k}") for p in (3, 4) for k in range(p + 1)),
    )


def power_sums(df: DataFrame, load: str, columns: Sequence[str]) -> DataFrame:
    """The sums of :func:`summed` of a wide table."""
    return summed(value_counts(df, load, columns), load)


def exact_sum(sums: Mapping[str, int | Decimal | None], p: int) -> int:
    """The sum of p-th powers in units of 10^(-6p), from the sums of one row."""
    if p < 3:
        return int(sums[f"s{p}"])
    return sum(int(sums[f"s{p}_{k}"]) * 10 ** (6 * k) for k in range(p + 1))


def _moments_of(sums: Mapping[str, int | Decimal | None]) -> tuple[float | None, ...]:
    n = sums["n_numbers"]
    if not n:
        return None, None, None, None
    s1, s2, s3, s4 = (exact_sum(sums, p) for p in (1, 2, 3, 4))
    # Central moments times n^p, in whole numbers, so that nothing cancels.
    m2 = n * s2 - s1**2
    m3 = n**2 * s3 - 3 * n * s1 * s2 + 2 * s1**3
    m4 = n**3 * s4 - 4 * n**2 * s1 * s3 + 6 * n * s1**2 * s2 - 3 * s1**4
    mean, deviation = float(Fraction(s1, n * 10**6)), math.sqrt(Fraction(m2, n**2 * 10**12))
    if m2 == 0:
        return mean, deviation, None, None
    return mean, deviation, float(Fraction(m3 * 10**9, m2 * math.isqrt(m2 * 10**18))), float(Fraction(m4, m2**2)) - 3


def moments(sums: DataFrame) -> DataFrame:
    """Adds mean, deviation, skewness and excess kurtosis (of the population) to
    :func:`power_sums`; null without numbers, the last two for equal numbers.

    They come from the exact sums by whole-number arithmetic, one row for each
    load and column.
    """

    @F.pandas_udf("mean double, deviation double, skewness double, kurtosis double")
    def shaped(rows: pd.DataFrame) -> pd.DataFrame:
        made = [_moments_of(row) for row in rows.to_dict("records")]
        return pd.DataFrame(made, columns=["mean", "deviation", "skewness", "kurtosis"], dtype="float64")

    return sums.withColumn("_m", shaped(F.struct(*SUMS))).select(*sums.columns, "_m.*")


def exact_medians(values: DataFrame, keys: Sequence[str], value: str, width: float, weight: str | None = None) -> DataFrame:
    """(keys, median): exact median of the non-null values of each group.

    ``weight`` names a column of how often each value counts (once by default).

    Counts of equal values are binned; a running count over the bins (their
    number is the range of the values over ``width``) finds the bins of the
    middle values, and one within these the values.  No group is gathered.
    """
    keys = list(keys)
    counts = values.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_value")).agg((F.sum(weight) if weight else F.count("*")).alias("n"))
    counts = counts.withColumn("bin", F.floor(F.col("_value") / width))
    bins = counts.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
    ordered = Window.partitionBy(*keys).orderBy("bin")
    bins = bins.withColumns({"upto": F.sum("n").over(ordered), "total": F.sum("n").over(Window.partitionBy(*keys))})
    low, high = F.floor((F.col("total") + 1) / 2), F.floor((F.col("total") + 2) / 2)
    bins = bins.withColumns({"low": low, "high": high, "before": F.col("upto") - F.col("n")})
    bins = bins.where("(low > before and low <= upto) or (high > before and high <= upto)").select(*keys, "bin", "before", "low", "high")
    within = Window.partitionBy(*keys, "bin").orderBy("_value")
    ranked = counts.join(bins, [*keys, "bin"]).withColumn("upto", F.col("before") + F.sum("n").over(within)).withColumn("before", F.col("upto") - F.col("n"))
    at = lambda rank: F.max(F.when((F.col(rank) > F.col("before")) & (F.col(rank) <= F.col("upto")), F.col("_value")))
    return ranked.groupBy(*keys).agg(((at("low") + at("high")) / 2).alias("median"))


def medians(counts: DataFrame, load: str) -> DataFrame:
    """Exact median of the numbers from 0 to 10,000,000 per load and column, from
    the counts of :func:`value_counts`."""
    cells = counts.select(load, "column_name", number(F.col("raw")).alias("value"), "n")
    return exact_medians(cells.where(F.col("value").between(LOWEST, HIGHEST)), [load, "column_name"], "value", _BIN, "n")


def load_shifts(df: DataFrame, loads: DataFrame, table_name: str, columns: Sequence[str]) -> DataFrame:
    """Change of each column of each load against the load before it.

    Result: load_id, column_name, share_missing, prev_share_missing, mean and
    deviation of both, mean_difference (standardised by the pooled deviation),
    is_mean_shift (that is above MEAN_SHIFT), skewness_difference, median,
    prev_median, is_shift (by missing share or median).
    """
    counts = materialise(value_counts(df, "load_id", columns))
    described = moments(summed(counts, "load_id")).join(medians(counts, "load_id"), ["load_id", "column_name"], "left")
    described = described.withColumn("share_missing", F.col("n_missing") / F.col("n_rows"))
    kept = ["share_missing", "n_missing", "n_rows", "mean", "deviation", "skewness", "median"]
    described = described.select("load_id", "column_name", *kept)
    chain = loads.where(F.col("target_table") == table_name).select("load_id", "prev_load_id").where("prev_load_id is not null").distinct()
    before = described.select(F.col("load_id").alias("prev_load_id"), "column_name", *(F.col(c).alias(f"prev_{c}") for c in kept))
    pairs = described.join(chain, "load_id").join(before, ["prev_load_id", "column_name"])
    # Shares are compared as whole numbers: a difference of exactly 0.15 is none.
    gap = F.abs(F.col("n_missing") * F.col("prev_n_rows") - F.col("prev_n_missing") * F.col("n_rows")) * 100
    missing = gap > 15 * F.col("n_rows") * F.col("prev_n_rows")
    ratio = (F.col("median") > MEDIAN_RATIO * F.col("prev_median")) | (F.col("prev_median") > MEDIAN_RATIO * F.col("median"))
    pooled = F.sqrt((F.col("deviation") ** 2 + F.col("prev_deviation") ** 2) / 2)
    apart = F.try_divide(F.col("mean") - F.col("prev_mean"), pooled)
    return pairs.select(
        "load_id",
        "column_name",
        "share_missing",
        "prev_share_missing",
        "mean",
        "prev_mean",
        "deviation",
        "prev_deviation",
        apart.alias("mean_difference"),
        F.coalesce(F.abs(apart) > MEAN_SHIFT, F.lit(False)).alias("is_mean_shift"),
        (F.col("skewness") - F.col("prev_skewness")).alias("skewness_difference"),
        "median",
        "prev_median",
        (missing | F.coalesce(ratio, F.lit(False))).alias("is_shift"),
    )


def profile(df: DataFrame, columns: Sequence[str], numbers: Sequence[str] | None = None) -> DataFrame:
    """One row per column: rows, nulls, markers, distinct values, range, faults.

    Equal values of a column are counted first, so the final grouping sees each
    distinct value once.  Range and faults are null for columns that are not in
    ``numbers`` (by default all are).
    """
    values = long_cells(df, [], columns).groupBy("column_name", "raw").agg(F.count("*").alias("n"))
    raw, value = F.col("raw"), number(F.col("raw"))
    total = lambda when: F.sum(F.when(when, F.col("n")).otherwise(0))
    counts = lambda result: result if numbers is None else F.when(F.col("column_name").isin(list(numbers)), result)
    return values.groupBy("column_name").agg(
        F.sum("n").alias("n_rows"),
        total(raw.isNull()).alias("n_null"),
        total(raw.isNotNull() & is_missing(raw)).alias("n_marker"),
        F.count("raw").alias("n_distinct"),
        counts(F.min(value)).alias("min_value"),
        counts(F.max(value)).alias("max_value"),
        counts(total(raw.isNotNull() & ~is_missing(raw) & ~is_number(raw))).alias("n_pattern"),
        counts(total((value < LOWEST) | (value > HIGHEST))).alias("n_range"),
    )
