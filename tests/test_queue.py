"""Offsets, limits, redelivery and bad messages of the queue."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from presswork.sources import queue as Q


def run(stream, write, base):
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/log").trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()


def published(spark, path, texts, parts=2):
    return Q.publish(spark.createDataFrame([(t,) for t in texts], "payload string").repartition(parts) if texts else spark.createDataFrame([], "payload string"), path)


def test_batches_within_the_limit_and_a_failed_one_again(spark, tmp_path):
    path = str(tmp_path / "q")
    assert published(spark, path, []) == 0
    assert published(spark, path, [f"m{i}" for i in range(25)], 3) == 25 and published(spark, path, ["x", "y"]) == 27
    batches, broken = [], [1]

    def write(batch, number):
        batches.append((number, sorted(r.number for r in batch.collect())))
        if number in broken:
            broken.remove(number)
            raise RuntimeError("lost")

    stream = Q.messages(spark, path, in_flight=10)
    with pytest.raises(Exception, match="lost"):
        run(stream, write, tmp_path)
    run(Q.messages(spark, path, in_flight=10), write, tmp_path)
    assert batches == [(0, list(range(10))), (1, list(range(10, 20))), (1, list(range(10, 20))), (2, list(range(20, 27)))]
    published(spark, path, ["z"])
    run(Q.messages(spark, path, in_flight=10), write, tmp_path)  # a restart after all was done
    assert batches[-1] == (3, [27]) and len(batches) == 5
    assert Q.Folder(path).read("consumers/default.acknowledged", {})["number"] >= 20


def test_errors_come_again_until_they_are_bad(spark, tmp_path):
    path, clock = str(tmp_path / "q"), [0.0]
    published(spark, path, ["good", "broken", "{malformed", "busy", "second"])

    def work(batch):
        p = F.col("payload")
        return batch.withColumn("outcome", F.when(p.startswith("{"), "malformed").when(p == "broken", "error").when((p == "busy") & F.lit(clock[0] < 30), "busy").when((p == "second") & (F.col("deliveries") == 0), "error").otherwise("done"))

    write, table = Q.consumer(spark, str(tmp_path / "held"), work, most=3, wait=20, buckets=4, clock=lambda: clock[0])
    seen = []
    for step in range(5):
        clock[0] = 15.0 * step
        published(spark, path, [f"tick{step}"])
        run(Q.messages(spark, path), write, tmp_path)
        seen.append({(r.payload, r.deliveries, r.status) for r in table.read().collect()})
    malformed = ("{malformed", 0, "bad")
    assert seen[0] == {malformed, ("broken", 1, "pending"), ("second", 1, "pending"), ("busy", 0, "pending")}
    assert seen[1] == seen[0]  # not before 20 seconds have gone; busy is asked again
    assert seen[2] == {malformed, ("broken", 2, "pending")}
    assert seen[4] == {malformed, ("broken", 3, "bad")}
    assert {(r.payload, r.reason) for r in Q.bad(table).collect()} == {("{malformed", "malformed"), ("broken", "deliveries")}
    before = table.manifest()
    write(spark.createDataFrame([(1, "broken")], Q.SCHEMA), 0)  # a batch that was committed
    assert table.manifest() == before
