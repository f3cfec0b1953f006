"""Streaming twins of the batch folds, deduplication windows, idempotent sinks.

The stateful processors keep the same plain state as operators.state and call the same steps, so
that a stream in arrival order gives what the batch fold gives in log order.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stateful(stream: DataFrame, key: str, order: str, step: Callable[[dict, dict], dict], out: str, idle_ms: int | None = None) -> DataFrame:
    """Rows of the stream with what step gives, state per key as JSON.

    With idle_ms a key's state is dropped after as long without rows; such a stream runs empty batches
    to find that out, so it doesn't end by itself.

    Rows of one key in one micro-batch are taken in order; earlier batches aren't reopened.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema.fields)
    names = [f.split()[0] for f in out.split(", ")]

    def run(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = json.loads(state.get[0]) if state.exists else {}
        rows = pd.concat(list(batches)).sort_values(order)
        made = pd.DataFrame([step(held, r) for r in rows.to_dict("records")], columns=names)
        state.update((json.dumps(held),))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.concat([rows.reset_index(drop=True), made], axis=1)

    return stream.groupBy(key).applyInPandasWithState(run, f"{kinds}, {out}", "held string", "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def deduplicated(stream: DataFrame, row_id: str, at: str, seconds: int = 120) -> DataFrame:
    """First row of each id within the window; late rows past the watermark are dropped."""
    return stream.withWatermark(at, f"{seconds} seconds").dropDuplicatesWithinWatermark([row_id])


def tumbling(stream: DataFrame, at: str, size: str, late: str, keys: tuple[str, ...] = (), slide: str | None = None) -> DataFrame:
    """Extension: counts by (sliding) window with a watermark."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    counted = stream.withWatermark(at, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def split_bad(batch: DataFrame, raw: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Parsed messages, and the raw ones that can't be parsed."""
    parsed = batch.withColumn("__m", F.from_json(raw, schema)).withColumn("__ok", F.try_parse_json(raw).isNotNull() & F.col("__m").isNotNull())
    return parsed.where("__ok").select("__m.*"), parsed.where(~F.col("__ok")).select(*batch.columns)


def once_sink(path: str, key: str, slots: int = 64) -> Callable[[DataFrame, int], None]:
    """foreachBatch writer that adds rows whose key is not stored; a repeated batch adds nothing.

    Rows are stored by slot (of the key's hash) and batch. A batch reads only its own slots, of the
    batches before it, and overwrites what an earlier try of it left.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = F.pmod(F.xxhash64(key), F.lit(slots)).cast("int")
        fresh = batch.dropDuplicates([key]).withColumns({"slot": own, "batch": F.lit(number).cast("long")})
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            met = [r[0] for r in fresh.select("slot").distinct().collect()]  # at most ``slots``
            stored = spark.read.schema(fresh.schema).parquet(path).where(F.col("slot").isin(met) & (F.col("batch") < number))
            fresh = fresh.join(stored.select(key), key, "left_anti")
        fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("slot", "batch").parquet(path)

    return write
