from datetime import datetime, timedelta

import pytest

from aeroframe.streaming.adapters import deduplicate_stream, rebin_stream, smooth_stream


def test_streams(spark, tmp_path):
    rows = [(datetime(2024, 3, 1, 10) + timedelta(minutes=m), float(m)) for m in (0, 1, 1, 7, 12, 90)]
    spark.createDataFrame(rows, "ts timestamp_ntz, v double").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ts timestamp_ntz, v double").parquet(str(tmp_path / "in"))
    for name, stream in (("binned", rebin_stream(source, "ts", ["v"], "5min", "sum")), ("single", deduplicate_stream(source, "ts"))):
        stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in spark.sql("select minute(ts), v from binned order by ts").collect()] == [(0, 2.0), (5, 7.0), (10, 12.0)]
    assert spark.table("single").count() == 5
    with pytest.raises(ValueError):
        rebin_stream(source, "ts", ["v"], "5min", "median")
    with pytest.raises(NotImplementedError):
        smooth_stream(source)


def test_first_of_files_that_come_out_of_order(spark, tmp_path):
    """The earliest file's first row wins although it comes last; what comes behind the watermark doesn't count."""
    start = datetime(2024, 3, 1, 10)
    schema = "ts timestamp_ntz, who string, v double, file string, row long"
    batches = [
        [(start, "x", 1.0, "b", 0), (start, "x", 2.0, "b", 1), (start + timedelta(minutes=1), None, 3.0, "b", 2), (start, "y", 4.0, "b", 3), (None, "x", 9.0, "a", 0)],
        [(start, "x", 5.0, "a", 7), (start, "x", 6.0, "a", 5), (start + timedelta(minutes=1), None, 7.0, "c", 0)],
        [(start + timedelta(hours=3), "x", 8.0, "d", 0)],
        [(start, "x", 0.0, "_", 0), (start + timedelta(hours=9), "x", 8.5, "d", 1)],
    ]
    folder = tmp_path / "in"
    folder.mkdir()
    source = spark.readStream.schema(schema).parquet(str(folder))
    stream = deduplicate_stream(source, "ts", "30 minutes", ["file", "row"], ["who"])
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
    assert stream.columns == source.columns
    got = sorted(((r.ts - start).total_seconds() / 60, r.who or "", r.v) for r in spark.read.schema(schema).parquet(str(tmp_path / "out")).collect())
    assert got == [(0, "x", 6.0), (0, "y", 4.0), (1, "", 3.0), (180, "x", 8.0)]
