from tallyspan.operators import profile
from tallyspan.session import table
from tallyspan.streaming import loads


def test_stream_equals_batch(spark, small, tmp_path):
    rows = table(spark, small, "region_rows")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    columns = profile.count_columns(rows)
    stream = loads.read_loads(spark, str(tmp_path / "in"), rows.schema)
    query = loads.stream_faults(stream).writeStream.format("memory").queryName("stream_faults").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    query.processAllAvailable()
    query.stop()
    want = sorted(map(tuple, profile.faulty_cells(rows, "row_id", columns).collect()))
    assert sorted(map(tuple, spark.table("stream_faults").collect())) == want

    one_by_one = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = loads.merge_power_sums(one_by_one, str(tmp_path / "sums"), str(tmp_path / "c2"))
    query.processAllAvailable()
    query.stop()
    got = {(r.load_id, r.column_name): (r.n_rows, r.n_numbers, r.s1) for r in loads.merged_power_sums(spark, str(tmp_path / "sums")).collect()}
    assert got == {(r.load_id, r.column_name): (r.n_rows, r.n_numbers, r.s1) for r in profile.power_sums(rows, "load_id", columns).collect()}
