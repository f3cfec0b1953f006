"""Which quality filter removes what, in every order in which the filters can be applied.

Texts are measured on the buffers of Arrow batches: a table of byte classes, prefix sums over it and
differences of those at the borders of documents count words, capitals, symbols and code points of
all documents of a run at once. A document's distinct words are counted by sorting its words' 64-bit hashes
(differences of one prefix sum of powers); neighbours of equal hash are compared byte by byte, and a document
where two of them differ is counted by its words themselves.

Filters A to D fail by a text alone, so equal texts share their bits; E fails for all but the least id of
equal texts. Rows are therefore folded by text, part and labels before equal texts meet, so
that a text which a third of the rows hold is a few rows by then. The five bits of a part's documents are
at most 32 counts; every order and step is read off these.

Defined results: a null text is empty, equal texts are told by SHA-256, a null id has no smaller one and is no
smaller one, rows that repeat an id count each; an id with several labels has what any of them says; a null part is the
empty string; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name

FILTERS = "ABCDE"
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITALS_PERCENT = 2
SYMBOLS = b"#$%&*|"

#: Bytes that are measured at once; a longer document is read in pieces cut between words.
RUN = 1 << 19
BLANK, CAPITAL, SYMBOL, INSIDE = 1, 2, 4, 8
BLANKS = b"\t\n\x0b\x0c\r "
#: Odd multiplier of the word hashes (the golden ratio's fraction in 64 bits), and its inverse.
STEP = 0x9E3779B97F4A7C15
COUNTS = ("n_words", "n_distinct", "n_capitals", "n_symbols", "n_points")


def byte_classes() -> np.ndarray:
    kinds = np.zeros(256, np.uint8)
    kinds[list(BLANKS)] = BLANK
    kinds[ord("A") : ord("Z") + 1] = CAPITAL
    kinds[list(SYMBOLS)] = SYMBOL
    kinds[0x80:0xC0] = INSIDE
    return kinds


CLASSES = byte_classes()


@lru_cache(2)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of STEP and of its inverse, modulo 2^64."""
    out = []
    for x in (STEP, pow(STEP, -1, 1 << 64)):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def sums(flags: np.ndarray) -> np.ndarray:
    """Prefix sums with the empty prefix."""
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def words_in(data: np.ndarray, kinds: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, hash of each word; words of each document); cuts: the borders of the documents."""
    n = len(data)
    border = np.zeros(n + 1, bool)
    border[cuts] = True
    letter = (kinds & BLANK) == 0
    first, last = letter.copy(), letter
    first[1:] &= ~letter[:-1] | border[1:n]
    last = letter.copy()
    last[:-1] &= ~letter[1:] | border[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    size = max(RUN, 1 << (n - 1).bit_length()) if n else RUN
    up, down = powers(size)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=total[1:])
    return begin, end, (total[end] - total[begin]) * down[begin], np.diff(sums(first)[cuts])


def differing(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the strings of size bytes at a and at b differ; size > 0."""
    out = np.zeros(len(a), bool)
    ends = np.cumsum(size)
    at = 0
    while at < len(a):
        till = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN, "right")))
        n = size[at:till]
        begins = np.cumsum(n) - n
        step = np.arange(int(n.sum())) - np.repeat(begins, n)
        unlike = data[np.repeat(a[at:till], n) + step] != data[np.repeat(b[at:till], n) + step]
        out[at:till] = np.logical_or.reduceat(unlike, begins)
        at = till
    return out


def first_of_each(data: np.ndarray, begin: np.ndarray, end: np.ndarray, hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of one word of each hash of each document, documents of which two different words have one hash)."""
    order = np.lexsort((hashes, doc))
    d, h = doc[order], hashes[order]
    again = np.zeros(len(order), bool)
    again[1:] = (d[1:] == d[:-1]) & (h[1:] == h[:-1])
    two = np.flatnonzero(again)
    a, b = order[two - 1], order[two]
    n = end[a] - begin[a]
    bad = n != end[b] - begin[b]
    like = np.flatnonzero(~bad)
    if len(like):
        bad[like] = differing(data, begin[a[like]], begin[b[like]], n[like])
    return order[~again], np.unique(doc[b[bad]])


def pieces(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Borders of parts of a document of about RUN bytes, cut after a blank."""
    at = 0
    while at < len(data):
        till = at + RUN
        while till < len(data):
            gap = np.flatnonzero(CLASSES[data[till - 1 : till + RUN]] == BLANK)
            if len(gap):
                till += int(gap[0])
                break
            till += RUN
        till = min(till, len(data))
        yield at, till
        at = till


def distinct_exactly(data: np.ndarray) -> int:
    return len(set(data.tobytes().split()))


def measured(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """COUNTS (rows) of the documents (columns) between the cuts of data, which begin at 0 and end at its length."""
    out = np.zeros((len(COUNTS), len(cuts) - 1), np.int64)
    kinds = CLASSES[data]
    begin, end, hashes, words = words_in(data, kinds, cuts)
    doc = np.repeat(np.arange(len(words)), words)
    kept, bad = first_of_each(data, begin, end, hashes, doc)
    out[0], out[1] = words, np.bincount(doc[kept], minlength=len(words))
    for d in bad:
        out[1, d] = distinct_exactly(data[cuts[d] : cuts[d + 1]])
    for row, kind in ((2, CAPITAL), (3, SYMBOL), (4, INSIDE)):
        out[row] = np.diff(sums(kinds == kind)[cuts])
    out[4] = np.diff(cuts) - out[4]
    return out


def measured_long(data: np.ndarray) -> np.ndarray:
    """COUNTS of one document, piece by piece; of its words, one of each is kept."""
    out = np.zeros(len(COUNTS), np.int64)
    begin, end, hashes = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    exact = False
    for a, b in pieces(data):
        part = data[a:b]
        kinds = CLASSES[part]
        at, till, h, words = words_in(part, kinds, np.array([0, b - a]))
        kept, bad = first_of_each(part, at, till, h, np.zeros(len(at), np.int64))
        begin, end, hashes = np.append(begin, at[kept] + a), np.append(end, till[kept] + a), np.append(hashes, h[kept])
        kept, worse = first_of_each(data, begin, end, hashes, np.zeros(len(begin), np.int64))
        begin, end, hashes = begin[kept], end[kept], hashes[kept]
        exact |= len(bad) + len(worse) > 0
        out += [words[0], 0, np.count_nonzero(kinds == CAPITAL), np.count_nonzero(kinds == SYMBOL), np.count_nonzero(kinds != INSIDE)]
    out[1] = distinct_exactly(data) if exact else len(begin)
    return out


def measured_texts(texts: pa.Array) -> np.ndarray:
    """COUNTS (rows) of an Arrow array of texts (columns), read off its buffers."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    out = np.zeros((len(COUNTS), n), np.int64)
    if not n:
        return out
    _, offsets, values = texts.buffers()
    cuts = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values and values.size else np.empty(0, np.uint8)
    at = 0
    while at < n:
        till = int(np.searchsorted(cuts, cuts[at] + RUN, "right")) - 1
        if till <= at:
            out[:, at] = measured_long(data[cuts[at] : cuts[at + 1]])
            at += 1
        else:
            out[:, at:till] = measured(data[cuts[at] : cuts[till]], cuts[at : till + 1] - cuts[at])
            at = till
    return out


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' other columns, and COUNTS of its text; names that clash with COUNTS are replaced."""
    others = [c for c in docs.columns if c != text_col and c.lower() not in COUNTS]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = measured_texts(batch.column(len(others)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *map(pa.array, counts)], [*others, *COUNTS])

    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(free_name(docs, "text_"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in others), *(f"{c} long" for c in COUNTS)])
    return docs.select(*[F.col(f"`{c}`") for c in others], text).mapInArrow(rows, schema)


def failed() -> F.Column:
    """Bits of the filters A to D that a measured document fails."""
    tests = (
        F.col("n_words") < MIN_WORDS, 100 * F.col("n_distinct") < MIN_DISTINCT_PERCENT * F.col("n_words"), 100 * F.col("n_capitals") > MAX_CAPITALS_PERCENT * F.col("n_points"), F.col("n_symbols") > 0,
    )
    out = F.lit(0)
    for bit, test in enumerate(tests):
        out = out + F.when(test, 1 << bit).otherwise(0)
    return out


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", part_col: str = "source", text_col: str = "text") -> DataFrame:
    """part, mask (bits of the filters failed), n, good, toxic: how many documents of a part fail just these filters."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    alike = measure(read).groupBy("id", "part", "digest", failed().alias("mask")).agg(F.count(F.lit(1)).alias("n"))
    flag = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(flag("quality").alias("is_good"), flag("toxic").alias("is_toxic"))
    # rows without an id match no label: a part of the key deals them out
    dealt = F.when(F.col("id").isNull(), F.xxhash64("digest")).otherwise(F.lit(0).cast("long"))
    joined = alike.withColumn("dealt", dealt).join(known.withColumn("dealt_", F.lit(0).cast("long")), (F.col("id") == F.col("label_id")) & (F.col("dealt") == F.col("dealt_")), "left")
    marks = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("is_good", "is_toxic")]
    least = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n")))
    folded = joined.groupBy("digest", "part", "mask", *marks).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("id").isNull(), F.col("n")).otherwise(0)).alias("no_id"), least.alias("least"))
    first = F.min("least.id").over(Window.partitionBy("digest"))
    stays = F.col("no_id") + F.when(F.col("least.id") == first, F.col("least.n")).otherwise(0)
    told = folded.withColumn("stays", stays)
    both = F.explode(F.array(F.struct(F.col("mask"), F.col("stays").alias("n")), F.struct((F.col("mask") + (1 << 4)).alias("mask"), (F.col("n") - F.col("stays")).alias("n"))))
    split = told.select("part", "is_good", "is_toxic", both.alias("x")).where("x.n > 0")
    return split.groupBy("part", F.col("x.mask").alias("mask")).agg(F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("is_good")).alias("good"), F.sum(F.col("x.n") * F.col("is_toxic")).alias("toxic"))


def audit(cells: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: of each part, for
    each order of the filters and each of its steps."""
    every = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    orders = F.explode(F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)]))
    steps = every.select("part", "cells", orders.alias("filter_order")).select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter"))

    def bits(letters: F.Column) -> F.Column:
        return sum((F.when(letters.contains(x), 1 << i).otherwise(0) for i, x in enumerate(FILTERS)), F.lit(0))

    before = F.substring(F.col("filter_order"), F.lit(1), F.col("at"))
    steps = steps.select("part", "cells", "filter_order", (F.col("at") + 1).alias("step"), bits(F.col("letter")).alias("own"), bits(before).alias("before"))
    own, gone = lambda c: c["mask"].bitwiseAND(F.col("own")) > 0, lambda c: c["mask"].bitwiseAND(F.col("before")) > 0

    def total(which, what=lambda c: c["n"]) -> F.Column:
        return F.aggregate(F.filter("cells", which), F.lit(0).cast("long"), lambda s, c: s + what(c))

    removed = lambda c: own(c) & ~gone(c)
    share = lambda c: c["n"] * (F.lit(120) / F.bit_count(c["mask"])).cast("long")
    return steps.select(
        "part", "filter_order", "step", total(lambda c: ~own(c) & ~gone(c)).alias("kept"), total(removed).alias("removed"), total(lambda c: own(c) & gone(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("own")).alias("unique_fails"), total(removed, lambda c: c["good"]).alias("good_lost"), total(removed, lambda c: c["toxic"]).alias("toxic_lost"), total(own, share).alias("shapley"),
    )
