"""Merges of bucketed tables against a plain dictionary, and what failures and repeats leave."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from presswork.sources import buckets as B
from presswork.sources import sinks

KIND = "url string, title string, created_at long, vector array<double>"


def combine(stored, new):
    return sinks.upsert(stored, new, "url", keep=("created_at",))


@pytest.fixture
def table(spark, tmp_path):
    rows = [(f"u{i}", f"t{i}", i, [float(i)]) for i in range(200)]
    return B.Table.create(spark.createDataFrame(rows, KIND), str(tmp_path / "t"), "url", 16)


def held(table, version=None):
    return {r.url: (r.title, r.created_at, r.vector) for r in table.read(version).collect()}


def test_merges_equal_a_dictionary_and_touch_their_buckets_only(spark, table):
    want, r = held(table), random.Random(1)
    assert len(want) == 200
    for round_ in range(3):
        before = table.manifest()
        new = [(f"u{r.randint(0, 260)}", f"n{round_}", 1000 + round_, r.choice([None, [1.0]])) for _ in range(4)]
        new = list({n[0]: n for n in new}.values())
        df = spark.createDataFrame(new, KIND)
        table.merge(df, combine)
        for url, title, created, vector in new:
            want[url] = (title, want[url][1] if url in want else created, vector)
        after, touched = table.manifest(), set(table.touched(df, before))
        assert held(table) == want and 1 <= len(touched) <= 4
        assert all((before.files.get(b) == after.files.get(b)) == (b not in touched) for b in set(before.files) | set(after.files))
        assert sum(map(len, after.files.values())) == len(after.files)
    assert len(held(table, 1)) == 200 and all(v[0].startswith("t") for v in held(table, 1).values())
    assert {r.url for r in table.lookup(spark.createDataFrame([("u3",), ("none",)], "url string")).collect()} == {"u3"}


def test_a_failed_merge_leaves_the_version_and_a_repeated_one_nothing(spark, table):
    df = spark.createDataFrame([("u1", "new", 5, None), ("x", "new", 5, None)], KIND)
    before, files = held(table), table.manifest()

    def broken(stored, new):
        return combine(stored, new).withColumn("title", F.when(F.col("url") == "x", F.raise_error(F.lit("lost"))).otherwise(F.col("title")))

    with pytest.raises(Exception, match="lost"):
        table.merge(df, broken, "w", 7)
    assert table.manifest() == files and held(table) == before
    first = table.merge(df, combine, "w", 7)
    assert table.merge(df, combine, "w", 7) == first and table.merge(df, combine, "w", 3) == first and table.versions() == [1, 2]
    assert held(table)["u1"] == ("new", 1, None)
    table.write(df, table.manifest())  # as one leaves that fails before its commit
    assert table.vacuum(1) == 1 and table.versions() == [2]  # version 1's other buckets are still in use
    assert len(held(table)) == 201


def test_an_overtaken_merge_is_done_again(spark, table):
    other, calls = B.Table(spark, table.path), []

    def overtaken(stored, new):
        if not calls:
            calls.append(other.merge(spark.createDataFrame([("u1", "theirs", 0, None), ("u5", "theirs", 0, None)], KIND), combine))
        return combine(stored, new)

    table.merge(spark.createDataFrame([("u1", "ours", 0, None)], KIND), overtaken)
    now = held(table)
    assert now["u1"][0] == "ours" and now["u5"][0] == "theirs" and table.versions() == [1, 2, 3]
    with pytest.raises(B.VersionTaken):
        table.commit(table.manifest(2))


def test_updates_carries_resizing_and_streams(spark, table, tmp_path):
    table.merge(spark.createDataFrame([("u2", [9.0]), ("none", [1.0])], "url string, vector array<double>"), lambda s, n: sinks.update_existing(s, n, "url", "vector"))
    assert held(table)["u2"][2] == [9.0] and "none" not in held(table)
    want = held(table)
    assert table.resize(5).buckets == 5 and held(table) == want and {int(b) for b in table.manifest().files} == set(range(5))
    spark.createDataFrame([(f"s{i}", "s", i, None) for i in range(20)], KIND).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(KIND).parquet(str(tmp_path / "in"))
    write = B.merging_sink(table, combine, "stream")
    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert len(held(table)) == 220 and table.manifest().writers == {"stream": 0}


def test_an_empty_table(spark, tmp_path):
    t = B.Table.create(spark.createDataFrame([], KIND), str(tmp_path / "e"), "url", 4)
    assert t.read().count() == 0 and t.merge(spark.createDataFrame([], KIND), combine).version == 1
    t.merge(spark.createDataFrame([("a", None, None, None)], KIND), combine)
    assert held(t) == {"a": (None, None, None)}
    with pytest.raises(B.VersionTaken):
        B.Table.create(spark.createDataFrame([], KIND), str(tmp_path / "e"), "url")
