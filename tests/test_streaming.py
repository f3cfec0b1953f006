from __future__ import annotations

from pyspark.sql import functions as F

from presswork.operators import state as Q
from presswork.streaming import state as W


def drained(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return stream.sparkSession.table(name)


def test_stream_equals_batch(spark, tmp_path):
    rows = [("k%d" % (i % 5), i, (i * 7) % 4) for i in range(60)]
    df = spark.createDataFrame(rows, "key string, seq int, expected int")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = drained(W.stateful(stream, "key", "seq", Q.revision_step, "accepted boolean, revision long"), tmp_path, "revisions")
    want = Q.compare_and_set(df)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_deduplicated_and_windows(spark, tmp_path):
    df = spark.createDataFrame([(i % 6, f"2026-01-01 00:0{i % 3}:00") for i in range(18)], "job_id int, at string").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    assert drained(W.deduplicated(stream, "job_id", "at", 300), tmp_path, "dedup").count() == 6
    counted = drained(W.tumbling(stream, "at", "1 minute", "1 minute"), tmp_path, "windows", "complete")
    assert sorted(r.n for r in counted.collect()) == [6, 6, 6]


def test_bad_messages_and_sink(spark, tmp_path):
    df = spark.createDataFrame([('{"id": 1}',), ("no",), ('{"id": 2}',)], "raw string")
    good, bad = W.split_bad(df, "raw", "id int")
    assert sorted(r.id for r in good.collect()) == [1, 2] and [r.raw for r in bad.collect()] == ["no"]
    write = W.once_sink(str(tmp_path / "out"), "id")
    write(good, 0)
    write(good, 0)
    write(good.unionByName(spark.createDataFrame([(3,)], "id int")), 1)
    stored = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.id, r.batch) for r in stored.collect()) == [(1, 0), (2, 0), (3, 1)]
