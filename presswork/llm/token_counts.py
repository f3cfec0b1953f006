"""Token counts from an exact length histogram.

Documents are encoded once and aggregated to how many there are of each encoded length; all
further answers (totals, quantiles, what each context limit keeps) are suffix sums over that
histogram, whose rows are distinct lengths, not documents.

Defined results: a null or empty text has 0 tokens; repeated rows count each; an empty table
gives an empty histogram; columns other than text are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Lengths of a range of the two-level suffix sums.
RANGE = 4096


def default_ranks() -> str:
    """Path of the installed byte-level vocabulary."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@lru_cache(2)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """n_tokens of every row. ranks: a vocabulary file that every executor has at that path."""
    path = ranks or default_ranks()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(encode(t.as_py() or "")) for t in batch.column(0)], pa.int64())], ["n_tokens"])

    return docs.select(F.col(text_col)).mapInArrow(rows, "n_tokens long")


def histogram(docs: DataFrame, text_col: str = "text", ranks: str | None = None) -> DataFrame:
    """n_tokens, n_docs: the exact histogram."""
    return encoded_lengths(docs, text_col, ranks).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def limits(counts: DataFrame) -> DataFrame:
    """For every length L that occurs, as a context limit: n_tokens (L), n_docs, docs_at_least,
    tokens_at_least, docs_total, tokens_total, truncated_total (tokens left if all documents are
    cut to L), quantile (share of documents of L tokens or fewer).

    Between two lengths that occur, truncated totals are linear: answer() gives any limit.
    Sums run within ranges of lengths; a range's own totals are carried over from the few ranges.
    """
    counts = materialize(counts, "length-histogram").withColumn("r", F.floor(F.col("n_tokens") / RANGE))
    per = counts.groupBy("r").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("t"))
    above = Window.orderBy(F.col("r").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.col("r").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select(
        F.col("r").alias("rr"), F.coalesce(F.sum("d").over(above), F.lit(0)).alias("d_above"), F.coalesce(F.sum("t").over(above), F.lit(0)).alias("t_above"),
        F.sum("d").over(whole).alias("docs_total"), F.sum("t").over(whole).alias("tokens_total"),
    )
    down = Window.partitionBy("r").orderBy(F.col("n_tokens").desc())
    out = counts.withColumns({"d_in": F.sum("n_docs").over(down), "t_in": F.sum(F.col("n_docs") * F.col("n_tokens")).over(down)})
    out = out.join(per, out["r"] == per["rr"])
    at_least = F.col("d_above") + F.col("d_in")
    return out.select(
        "n_tokens", "n_docs", at_least.alias("docs_at_least"), (F.col("t_above") + F.col("t_in")).alias("tokens_at_least"), "docs_total", "tokens_total",
        (F.col("tokens_total") - F.col("t_above") - F.col("t_in") + at_least * F.col("n_tokens")).alias("truncated_total"),
        ((F.col("docs_total") - at_least + F.col("n_docs")) / F.col("docs_total")).alias("quantile"),
    )


def answer(limits_table: DataFrame, limit: int) -> DataFrame:
    """One row: the truncated total for any limit, from the least occurring length at or above it."""
    above = F.struct("truncated_total", "docs_at_least", "n_tokens")
    least = F.min_by(above, F.when(F.col("n_tokens") >= limit, F.col("n_tokens")))
    found = limits_table.agg(least.alias("x"), F.max("tokens_total").alias("every"))
    cut = F.col("x.truncated_total") - F.col("x.docs_at_least") * (F.col("x.n_tokens") - limit)
    return found.select(F.lit(limit).alias("n_tokens"), F.when(F.col("x.n_tokens") >= limit, cut).otherwise(F.coalesce("every", F.lit(0))).alias("truncated_total"))
