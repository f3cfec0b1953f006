"""Mixing sources to target weights with hash-threshold histograms (DataFrame functions only).

Every document gets a 60-bit hash. Word totals per (source, leading hash digit) tell in which
digit a source's budget ends; only the documents of that boundary digit are histogrammed again
by their next digit, and so on until the hash is used up. A document is then taken iff its hash
lies below its source's threshold, so nothing is sorted and nothing but histograms is shuffled.

Defined results: a null text has size 0; a null source is a source of its own, last in order;
repeated rows share a hash and are taken alike, and where several rows share the boundary hash
each gives the same fraction of its words; an empty table gives an empty mix. Only the id, text
and source columns are read, so further columns can have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Hex digits of the hash per histogram level: 16**3 buckets a source at the first two levels.
DIGITS = (3, 3, 4, 5)


def size_of(text_col: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long")


def hash_of(id_col: str, text_col: str) -> Column:
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), F.coalesce(F.col(text_col), F.lit("")))
    return F.substring(F.md5(key), 1, sum(DIGITS))


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source, words (size) and hash of every row; the only pass over the texts."""
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size_of(text_col).alias("size"), hash_of(id_col, text_col).alias("h")
    )


def targets(base: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """One row per source: source, source_size, target.

    The sources share the total by weight, and none gets more than max_repeats times its size.
    Taking what is above from the capped and sharing it anew until none is above ends at the
    level L with sum(min(cap, L * weight)) = total, found here by one pass in order of cap / weight.
    """
    per = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (turn + 1).cast("int")).cast("long")
    per = per.select("source", "source_size", w.alias("w"), (max_repeats * F.col("source_size")).alias("cap"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumns({
        "left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "w_left": F.sum("w").over(after),
    }).withColumn("level", F.col("left") / F.col("w_left"))
    # The first source in fill order whose cap isn't reached sets the level of all after it.
    ends = F.when(F.col("cap") / F.col("w") >= F.col("level"), F.col("level"))
    level = F.first(ends, ignorenulls=True).over(everything)
    return per.select(
        "source", "source_size",
        F.least(F.col("cap").cast("double"), level * F.col("w")).alias("target"),
    )


def thresholds(base: DataFrame, goal: DataFrame) -> DataFrame:
    """One row per source: copies, cut (hash prefix), edge_take, edge_size, edge_rows.

    Every row is taken ``copies`` times whole, and once more if its hash is below ``cut``. Rows
    whose hash equals ``cut`` (as a rule one) share ``edge_take`` words out of ``edge_size``.
    """
    state = goal.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    # the budget of the extra, partial round; none once a source is taken max_repeats times
    state = state.withColumn("need", F.round(F.col("target") - F.col("copies") * F.col("source_size")).cast("long"))
    state = materialize(state.withColumn("cut", F.lit("")), "mix-targets")
    used = 0
    for digits in DIGITS:
        used += digits
        inside = (
            base.join(state.select("source", "cut"), base["source"].eqNullSafe(state["source"]))
            .where(F.col("h").startswith(F.col("cut")))
            .groupBy(base["source"].alias("source"), F.substring("h", 1, used).alias("p"))
            .agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
        )
        w = Window.partitionBy("source").orderBy("p")
        inside = inside.withColumn("before", F.sum("s").over(w) - F.col("s"))
        at = inside.join(state.select(F.col("source").alias("src"), "need"), F.col("source").eqNullSafe(F.col("src")))
        # the bucket in which the budget ends: the last that begins at or below it and isn't empty of words
        at = at.where((F.col("before") <= F.col("need")) & (F.col("before") + F.col("s") > F.col("need")))
        at = at.select(F.col("src"), F.col("p").alias("next_cut"), (F.col("need") - F.col("before")).alias("next_need"), F.col("s"), F.col("n"))
        state = state.drop("edge_size", "edge_rows").join(at, state["source"].eqNullSafe(at["src"]), "left").select(
            "source", "source_size", "target", "copies",
            F.coalesce("next_cut", F.lit("g")).alias("cut"),  # "g" is above every hex digit: all of the bucket fits
            F.coalesce("next_need", F.lit(0)).alias("need"),
            F.coalesce("s", F.lit(0)).alias("edge_size"), F.coalesce("n", F.lit(0)).alias("edge_rows"),
        )
        state = materialize(state, "mix-cuts")
    return state.withColumnRenamed("need", "edge_take")


def cuts_of(base: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """thresholds() of the sources, its columns prefixed so that they clash with none."""
    cuts = thresholds(base, targets(base, weights, max_repeats))
    return cuts.select(*[F.col(c).alias(f"__{c}") for c in cuts.columns])


def extra_words() -> Column:
    """Words that the partial round takes from a row (__size, __h) of a source with cuts_of's columns."""
    at_edge = F.col("__h") == F.col("__cut")
    nearer = (2 * F.col("__edge_take") >= F.col("__edge_size")) & (F.col("__edge_take") > 0)
    return (
        F.when(F.col("__h") < F.col("__cut"), F.col("__size"))
        .when(at_edge & (F.col("__edge_rows") == 1) & nearer, F.col("__size"))
        .when(at_edge & (F.col("__edge_rows") > 1) & (F.col("__edge_size") > 0), F.expr("__size * __edge_take div __edge_size"))
        .otherwise(0)
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of docs.

    ``taken`` is the number of words that the mix takes from the row, repeats counted. A single
    row at a threshold is taken whole if that brings the source nearer its target. Rows with one
    id and one text can't be told apart, so where several meet at a threshold each gives its share
    of the remaining words.
    """
    base = materialize(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    rows = base.withColumnsRenamed({"size": "__size", "h": "__h"})
    rows = rows.join(cuts_of(base, weights, max_repeats), F.col("source").eqNullSafe(F.col("__source")))
    return rows.select(
        "doc_id", "source", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), (F.col("__copies") * F.col("__size") + extra_words()).cast("long").alias("taken"),
    )


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs as the mix takes it: each row as often as it is taken, in docs' columns and four more.

    mix_copy numbers a row's copies from 1, mix_taken is how many words the mix takes from this
    copy (all of them but at a tied threshold), mix_size and mix_target are the row's words and its
    source's target; columns of docs of these names, in any case, are those of an earlier mix and replaced. The
    texts are not shuffled: thresholds, a row per source, join them.
    """
    base = materialize(sizes(docs, id_col, text_col, source_col), "mix-sizes")
    cuts = cuts_of(base, weights, max_repeats)
    made = ("mix_copy", "mix_taken", "mix_size", "mix_target")
    held = [c for c in docs.columns if c.lower() not in made]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in held]).alias("row"), size_of(text_col).alias("__size"), hash_of(id_col, text_col).alias("__h"), F.col(source_col).alias("own_source"))
    rows = rows.join(cuts, F.col("own_source").eqNullSafe(F.col("__source"))).withColumn("__extra", extra_words())
    copies = F.transform(F.sequence(F.lit(1), F.col("__copies") + 1), lambda k: F.struct(k.alias("k"), F.when(k <= F.col("__copies"), F.col("__size")).otherwise(F.col("__extra")).cast("long").alias("words")))
    rows = rows.withColumn("__copy", F.explode(F.filter(copies, lambda c: c["words"] > 0)))
    values = (F.col("__copy.k").cast("long"), F.col("__copy.words"), F.col("__size"), F.col("__target"))
    return rows.select("row.*", *[v.alias(k) for k, v in zip(made, values, strict=True)])
