import statistics
from fractions import Fraction

from pyspark.sql import functions as F

from tallyspan.operators import profile
from tallyspan.plans import QUERIES
from tallyspan.session import table

WIDE = "row_id long, load_id long, y2020 string, y2021 string, raw string, column_name string, n long, yield string"


def rows(spark, values):
    return spark.createDataFrame([(i, load, a, b, "clash", "clash", 1, "clash") for i, (load, a, b) in enumerate(values)], WIDE)


def test_faulty_cells(spark):
    cells = [(1, "123\n", "12\r\n"), (1, "x", "1e3"), (1, "-1", "10000000"), (1, "10000000.5", "+.5"), (1, "1.", "."), (1, "", "１")]
    df = rows(spark, cells)
    assert profile.count_columns(df) == ["y2020", "y2021"]
    got = sorted(tuple(r) for r in profile.faulty_cells(df, "row_id", ["y2020", "y2021"]).collect())
    assert got == [("pattern", 0, "y2020"), ("pattern", 0, "y2021"), ("pattern", 1, "y2020"), ("pattern", 1, "y2021"), ("pattern", 4, "y2021"), ("pattern", 5, "y2021"), ("range", 2, "y2020"), ("range", 3, "y2020")]
    assert profile.faulty_cells(df.limit(0), "row_id", ["y2020"]).count() == 0


def test_exact_medians(spark):
    values = [(k % 3, float((k * 7919) % 1000) / (1 if k % 2 else 4)) for k in range(500)] + [(9, 5.0), (8, None), (7, 1.0), (7, 1.0), (7, 4.0), (7, 90000.0)]
    df = spark.createDataFrame(values, "k long, v double")
    got = {r.k: r.median for r in profile.exact_medians(df, ["k"], "v", 100.0).collect()}
    assert got == {k: statistics.median(v for j, v in values if j == k) for k in {j for j, v in values if v is not None}}


def test_shifts(spark):
    loads = spark.createDataFrame([(1, "t", None), (2, "t", 1), (3, "t", 2), (4, "t", 77), (2, "other", 9)], "load_id long, target_table string, prev_load_id long")
    base = [(1, "10", "5")] * 20
    second = [(2, "20", "5")] * 17 + [(2, None, "5")] * 3  # 0.15 more missing and twice the median: neither is a shift
    third = [(3, "9.5", None)] * 4 + [(3, "9.5", "na")] * 16
    got = {(r.load_id, r.column_name): r for r in profile.load_shifts(rows(spark, base + second + third + [(4, "1", "1")]), loads, "t", ["y2020", "y2021"]).collect()}
    assert {k: r.is_shift for k, r in got.items()} == {(2, "y2020"): False, (2, "y2021"): False, (3, "y2020"): True, (3, "y2021"): True}
    assert got[3, "y2021"].median is None


def test_power_sums_merge_and_are_exact(spark):
    texts = [str(k) for k in range(50)] + ["7", "0.000001", "1.5", "9999999.999999", "10000000", "3.1415926", "0.1", "12\n", "-1", None, "na"]
    df = rows(spark, [(k % 2, t, None) for k, t in enumerate(texts)])
    whole = profile.power_sums(df.withColumn("load_id", F.lit(0)), "load_id", ["y2020"]).first()
    parts = profile.power_sums(df, "load_id", ["y2020"]).collect()
    for name in profile.SUMS:
        assert Fraction(whole[name]) == sum(Fraction(p[name]) for p in parts)
    units = [round(Fraction(t) * 10**6) for t in texts[:57]]
    for p in (1, 2, 3, 4):
        assert profile.exact_sum(whole.asDict(), p) == sum(u**p for u in units)
    assert (whole.n_rows, whole.n_missing, whole.n_numbers, whole.n_rounded) == (61, 2, 57, 1)


def test_moments(spark):
    df = rows(spark, [(1, t, "5") for t in ("1000000", "1000001", "1000003", "1000010")] + [(2, None, None)])
    got = {(r.load_id, r.column_name): r for r in profile.moments(profile.power_sums(df, "load_id", ["y2020", "y2021"])).collect()}
    x = [1000000, 1000001, 1000003, 1000010]
    mean = statistics.mean(x)
    m = [sum((v - mean) ** p for v in x) / 4 for p in (2, 3, 4)]
    row = got[1, "y2020"]
    assert row["mean"] == mean and abs(row.deviation - m[0] ** 0.5) < 1e-12 and abs(row.skewness - m[1] / m[0] ** 1.5) < 1e-12 and abs(row.kurtosis - (m[2] / m[0] ** 2 - 3)) < 1e-12
    assert (got[1, "y2021"].deviation, got[1, "y2021"].skewness, got[2, "y2020"]["mean"]) == (0.0, None, None)


def test_standardised_difference(spark):
    loads = spark.createDataFrame([(2, "t", 1), (3, "t", 2)], "load_id long, target_table string, prev_load_id long")
    near = [(1, str(100 + k), None) for k in range(9)] + [(2, str(110 + k), None) for k in range(9)] + [(3, str(110 + k), None) for k in range(9)]
    got = {r.load_id: r for r in profile.load_shifts(rows(spark, near), loads, "t", ["y2020"]).collect()}
    assert (got[2].median, got[2].is_shift, got[2].is_mean_shift, got[3].is_mean_shift) == (114.0, False, True, False)


def test_every_column_is_profiled(spark, small):
    got = {(r.table_name, r.column_name): r for r in QUERIES["p5_profile_all"](spark, small).collect()}
    tables = {name: table(spark, small, name) for name in ("census_rows", "region_rows")}
    assert set(got) == {(name, c) for name, df in tables.items() for c in df.columns}
    labels = [r.planning_area for r in tables["census_rows"].select("planning_area").collect()]
    area = got["census_rows", "planning_area"]
    assert (area.n_rows, area.n_null, area.n_distinct, area.n_pattern) == (len(labels), labels.count(None), len(set(labels) - {None}), None)
