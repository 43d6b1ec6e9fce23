from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loomstone.sources import sinks
from loomstone.streaming import jobs

T0 = datetime(2024, 5, 1)
HISTORY = "request_id string, tool string, query string, request_json string, executed_at timestamp, duration_ms double"


def history(spark):
    rows = [(f"r{i % 7}", "search", f"token=secret{i}", '{"password":"x","q":"ok"}', T0 + timedelta(hours=i), float(i)) for i in range(10)]
    return spark.createDataFrame(rows, HISTORY)


def test_history_stream_equals_batch(spark, tmp_path):
    history(spark).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(HISTORY).parquet(str(tmp_path / "in"))
    jobs.history_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = jobs.redacted_history(history(spark)).dropDuplicates(["request_id"])
    assert {tuple(r) for r in got.select("request_id", "tool").collect()} == {tuple(r) for r in want.select("request_id", "tool").collect()} and got.count() == 7
    assert got.where(F.col("query").contains("secret") | F.col("request_json").contains('"x"')).count() == 0


def test_catalog_stream_applies_once(spark, tmp_path):
    base, schema = str(tmp_path / "snap"), "k string, first int, v string, at int"
    sinks.publish(spark.createDataFrame([("a", 1, "old", 0)], schema), base)
    for i, rows in enumerate([[("a", 9, "new", 1), ("b", 2, "x", 1)], [("b", 3, "y", 2), ("b", 3, "z", 3)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "obs"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "obs"))
        jobs.catalog_stream(stream, base, str(tmp_path / "ck"), ["k"], ["first"], "at").awaitTermination()
        assert sinks.current(spark, base).count() == 2, i
    assert {tuple(r) for r in sinks.current(spark, base).select("k", "first", "v").collect()} == {("a", 1, "new"), ("b", 2, "z")}


def test_windows_match_batch(spark, tmp_path):
    history(spark).write.parquet(str(tmp_path / "in"))
    stream = jobs.windowed_activity(spark.readStream.schema(HISTORY).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = jobs.windowed_activity(spark.read.parquet(str(tmp_path / "in")))
    assert {tuple(r) for r in spark.table("w").collect()} == {tuple(r) for r in batch.collect()}
