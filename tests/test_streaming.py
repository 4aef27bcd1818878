"""Streams drained to the end give the batch result."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators.publication import latest
from ledgerline.streaming import restatements

SCHEMA = "k string, rel int, v int"
PARTS = [[("a", 1, 10), ("b", 1, 5)], [("a", 3, 30), ("a", 2, 20)], [("b", 0, 99), ("c", 1, 1)]]


@pytest.fixture
def source(spark, tmp_path):
    for part in PARTS:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


WANT = [("a", 3, 30), ("b", 1, 5), ("c", 1, 1)]


def test_current_keeps_the_latest_version(spark, source):
    q = restatements.current(source, ["k"], ["rel"]).writeStream.format("memory").queryName("now").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.sql("SELECT k, rel, v FROM now").collect())) == WANT


def test_upsert_snapshot_equals_batch(spark, source, tmp_path):
    restatements.upsert(source, f"{tmp_path}/out", f"{tmp_path}/cp", ["k"], ["rel"]).awaitTermination()
    last = max(int(p.name) for p in (tmp_path / "out").iterdir() if p.name.isdigit())
    batch = latest(spark.createDataFrame(sum(PARTS, []), SCHEMA), ["k"], ["rel"])
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out/{last}").select("k", "rel", "v").collect())) == sorted(map(tuple, batch.collect())) == WANT


def test_windows_and_sessions_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.coalesce(1).sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for name, f in (("rates", lambda s: restatements.rates(s, "ts", "event_type", "6 hours")), ("sessions", lambda s: restatements.sessions(s, "ts", "user_id"))):
        q = f(stream).writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        got, want = set(map(tuple, spark.table(name).collect())), set(map(tuple, f(events).collect()))
        assert got <= want and len(got) > 0.9 * len(want)  # the last windows wait for the watermark
