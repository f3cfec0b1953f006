"""Passages of a set of any size found in texts by the rarest of their anchors.

Anchors are grams of characters that are least in some window of grams, so which grams of a stretch are anchors depends on that
stretch alone: a text that holds a passage has the passage's anchors. Of each passage the anchor that fewest places of all texts have is
looked up; what it points to is verified by the characters. Both sides are tables that meet by anchors, then by their numbers: no
passage passes the driver, and a text meets only passages whose rarest anchor it has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import stored

#: (least length of a passage, characters of a gram, grams of a window). A passage of gram + window - 1 characters has an anchor.
LEVELS = ((32, 16, 17), (8, 4, 5), *((n, n, 1) for n in range(7, 0, -1)))
#: Grams whose windows are looked at together.
STRIP = 1 << 15
MIX = np.uint64(0x9E3779B97F4A7C15)


def anchors(text: str, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of a text's anchors."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(x) - gram + 1
    if n < window:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(gram):
        h = (h + x[k : k + n] + np.uint64(1)) * MIX
        h ^= h >> np.uint64(29)
    places = np.arange(n)
    if window > 1:
        some = [np.unique(a + np.lib.stride_tricks.sliding_window_view(h[a : a + STRIP + window - 1], window).argmin(axis=1) + np.arange(min(STRIP, n - window + 1 - a))) for a in range(0, n - window + 1, STRIP)]
        places = np.unique(np.concatenate(some))
    return places, h[places].view(np.int64)


def anchored(texts: DataFrame, number: str, text: str, gram: int, window: int) -> DataFrame:
    """number, anchor, place: a row for each anchor of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [anchors(t.as_py() or "", gram, window) for t in part.column(1)]
                sizes = [len(p) for p, _ in found]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), pa.array(np.concatenate([h for _, h in found])), pa.array(np.concatenate([p for p, _ in found]).astype(np.int64))], [number, "anchor", "place"])

    return texts.select(number, text).mapInArrow(rows, f"{number} long, anchor long, place long")


def level_hits(texts: DataFrame, passages: DataFrame, gram: int, window: int) -> DataFrame:
    """t, p: numbers of texts and of the passages that they hold; of one level's passages."""
    of_texts = anchored(texts, "t", "text", gram, window)
    counts = of_texts.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    own = anchored(passages, "p", "passage", gram, window).groupBy("p", "anchor").agg(F.min("place").alias("offset"))
    known = own.join(counts, "anchor", "left").groupBy("p").agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min(F.struct("n", "anchor", "offset")).alias("rare"))
    asked = known.where("least > 0").select("p", "rare.anchor", "rare.offset")  # a passage with an anchor that no text has is in none
    met = of_texts.join(asked, "anchor").select("t", "p", (F.col("place") - F.col("offset")).alias("begin")).where("begin >= 0").distinct()
    checked = met.join(passages, "p").join(texts, "t").where(F.substring("text", F.col("begin").cast("int") + 1, F.length("passage")) == F.col("passage"))
    return checked.select("t", "p").distinct()


def held_passages(texts: DataFrame, text: str, passages: DataFrame, passage: str) -> DataFrame:
    """texts' rows with each passage (column ``passage``, distinct) that stands in them; passages without characters are in none."""
    whole = stored(texts.select(F.struct(*[F.col(f"`{c}`") for c in texts.columns]).alias("row"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("t")), "texts")
    every = stored(passages.where(F.col(passage) != "").select(F.col(passage).alias("passage")).distinct().withColumn("p", F.monotonically_increasing_id()), "passages")
    level = F.coalesce(*[F.when(F.length("passage") >= least, i) for i, (least, _, _) in enumerate(LEVELS)])
    used = sorted(r[0] for r in every.select(level.alias("level")).distinct().collect())  # of nine
    short = whole.select("t", "text")
    hits = [level_hits(short, every.where(level == i), *LEVELS[i][1:]) for i in used]
    found = reduce(DataFrame.unionByName, hits) if hits else every.select(F.col("p").alias("t"), "p").where(F.lit(False))
    return whole.select("t", "row").join(found, "t").join(every, "p").select("row.*", F.col("passage").alias(passage))
