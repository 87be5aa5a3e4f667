"""Windows over a stream of events whose ts has no time zone."""

import datetime as dt

import pytest

from folioscope.streaming.watch import event_windows


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kolkata", "America/New_York"])
def test_windows_of_times_without_a_zone(spark, tmp_path, zone):
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # in New York the first hour did not exist and the last one came twice
        times = [(2024, 3, 10, 2, 30), (2024, 3, 10, 3, 30), (2024, 11, 3, 1, 59), (2024, 11, 3, 1, 0)]
        rows = [(dt.datetime(*t), "a", 0.5) for t in times] + [(dt.datetime(1969, 12, 31, 23, 59, 59, 999999), "b", 1.0)]
        source, out = str(tmp_path / "events"), str(tmp_path / "windows")
        spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double").write.parquet(source)
        stream = event_windows(spark.readStream.schema("ts timestamp_ntz, event_type string, value double").parquet(source))
        whole = lambda batch, number: batch.write.mode("overwrite").parquet(out) if not batch.isEmpty() else None
        flat = stream.selectExpr("window.start", "window.end", "event_type", "n", "total")
        flat.writeStream.outputMode("complete").option("checkpointLocation", str(tmp_path / "mark")).trigger(availableNow=True).foreachBatch(whole).start().awaitTermination()
        got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    hour = lambda *t: (dt.datetime(*t), dt.datetime(*t) + dt.timedelta(hours=1))
    assert got == [
        (*hour(1969, 12, 31, 23), "b", 1, 1.0),
        (*hour(2024, 3, 10, 2), "a", 1, 0.5),
        (*hour(2024, 3, 10, 3), "a", 1, 0.5),
        (*hour(2024, 11, 3, 1), "a", 2, 1.0),
    ]
