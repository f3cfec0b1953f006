"""Benchmark decontamination with a distributed positional inverted index.

The corpus is cut into segments of whole documents. For each segment the index stores, for every
term, the ascending positions at which it occurs; documents lie one after another with a gap
between them, so no phrase and no proximity match crosses a document. A query window is looked up
from its corpus-wide rarest term, and only in segments that have that term: the term's positions, less
its offset in the window, are the possible starts, and each further list, offset-adjusted alike,
is intersected with what is left. Segments are independent, so the search shuffles no postings.

Defined results: a null text has no words; a null benchmark text or item id is no item; repeated
document rows are reported each; repeated items of one id count once; an empty corpus gives no
row, an empty benchmark leaves every document clean. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, free_name, materialize

#: Words of a segment after which a new one begins. A longer document is a segment of its own.
SEGMENT_WORDS = 2_000_000
#: Positions between documents; proximity matches may span at most this many words.
GAP = 64
#: Words around a window's rarest term within which a proximity match has all of its words.
SLOP = 12
#: Benchmark items searched with one broadcast; more are searched block by block.
BLOCK_BYTES = 16 << 20

INDEX = "segment string, docs array<struct<id:{id},start:int,words:int>>, terms array<string>, counts array<int>, postings binary"


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split() if text else []


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """One row per segment: its documents and the posting lists of all of its terms."""
    kind = docs.schema[id_col].dataType
    schema = INDEX.format(id=kind.simpleString())

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        target = None

        def flush(doc_ids, starts, counts, tokens, ids):
            token = np.concatenate(tokens) if tokens else np.empty(0, np.int32)
            order = np.argsort(token, kind="stable")
            n = np.bincount(token, minlength=len(ids)).astype(np.int32)
            first = np.cumsum(n) - n
            base = np.repeat(np.array(starts, np.int32), counts) + np.arange(len(token), dtype=np.int32) - np.repeat(np.cumsum(counts) - counts, counts).astype(np.int32)
            place = base[order]
            steps = np.diff(place, prepend=np.int32(0))
            steps[first] = place[first]
            packed = zstandard.ZstdCompressor(level=1).compress(steps.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes())  # like bytes side by side
            entries = [{"id": a, "start": b, "words": c} for a, b, c in zip(doc_ids, starts, counts, strict=True)]
            return pa.RecordBatch.from_pydict({
                "segment": [uuid.uuid4().hex], "docs": pa.array([entries], target.field("docs").type),
                "terms": pa.array([[w.decode("utf-8", "replace") for w in ids]], pa.list_(pa.string())),
                "counts": pa.array([n], pa.list_(pa.int32())), "postings": [packed],
            }, schema=target)

        doc_ids, starts, counts, tokens, base, ids = [], [], [], [], 0, {}
        for batch in batches:
            if target is None:
                entry = pa.struct([("id", batch.schema.field(0).type), ("start", pa.int32()), ("words", pa.int32())])
                target = pa.schema([("segment", pa.string()), ("docs", pa.list_(entry)), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int32())), ("postings", pa.binary())])
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                tokens.append(np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int32, len(words)))
                doc_ids.append(doc_id)
                starts.append(base)
                counts.append(len(words))
                base += len(words) + GAP
                if base >= segment_words:
                    yield flush(doc_ids, starts, counts, tokens, ids)
                    doc_ids, starts, counts, tokens, base, ids = [], [], [], [], 0, {}
        if doc_ids:
            yield flush(doc_ids, starts, counts, tokens, ids)

    index = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(rows, schema)
    return materialize(index, "posting-index")


def term_frequencies(index: DataFrame, terms: set[str]) -> dict[bytes, int]:
    """How often each of the terms (those of one block of queries) occurs in the whole corpus."""
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            for some, n in zip(batch.column(0), batch.column(1), strict=True):
                found = [(t, k) for t, k in zip(some.as_py(), n.as_py(), strict=True) if t in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([k for _, k in found], pa.int64())], ["term", "n"])

    counted = index.select("terms", "counts").mapInArrow(rows, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r["term"].encode(): r["n"] for r in counted.toLocalIterator()}


def windows_of(items: list[tuple], size: int) -> dict[tuple[bytes, ...], list]:
    """Each window of the items (its words) and the ids of the items that hold it."""
    found: dict[tuple[bytes, ...], dict] = {}
    for item_id, text in items:
        words = words_of(text)
        if item_id is None or not words:
            continue
        for i in range(max(1, len(words) - size + 1)):
            found.setdefault(tuple(words[i : i + size]), {})[item_id] = None
    return {w: list(x) for w, x in found.items()}


class Postings:
    """The posting lists of one segment, those of the wanted terms."""

    def __init__(self, row: dict, wanted: set[bytes]):
        counts = np.array(row["counts"], np.int64)
        ends = np.cumsum(counts)
        found = [(t.encode(), i) for i, t in enumerate(row["terms"]) if t.encode() in wanted]
        self.lists = {}
        if found:
            raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["postings"]), np.uint8).reshape(4, -1)
            for t, i in found:
                part = np.ascontiguousarray(raw[:, ends[i] - counts[i] : ends[i]].T).view(np.int32).ravel()
                self.lists[t] = np.cumsum(part, dtype=np.int64)

    def phrase(self, words: tuple[bytes, ...], order: list[int]) -> np.ndarray:
        """Starts of the exact phrase; order: its offsets from the rarest term on."""
        starts = None
        for k in order:
            at = self.lists.get(words[k])
            if at is None:
                return np.empty(0, np.int64)
            if starts is None:
                starts = at - k
                continue
            near = np.searchsorted(at, starts + k)
            near[near == len(at)] = 0
            starts = starts[at[near] == starts + k]
            if not len(starts):
                break
        return starts

    def proximity(self, words: tuple[bytes, ...], order: list[int], slop: int) -> np.ndarray:
        """Positions of the rarest term that have every other term of the window within slop words."""
        anchors = None
        for k in order:
            at = self.lists.get(words[k])
            if at is None:
                return np.empty(0, np.int64)
            if anchors is None:
                anchors = at
                continue
            right = np.searchsorted(at, anchors)
            gap = np.minimum(np.abs(at[np.minimum(right, len(at) - 1)] - anchors), np.abs(at[np.maximum(right - 1, 0)] - anchors))
            anchors = anchors[gap <= slop]
            if not len(anchors):
                break
        return anchors


def search(index: DataFrame, items: list[tuple], frequencies: dict[bytes, int], size: int = 10, slop: int | None = None) -> DataFrame:
    """Matches of the items' windows: segment, doc (ordinal), items, spans, of documents that have any.

    spans: word intervals [start, end) of the document that exact occurrences cover, disjoint and
    ascending. With slop, near holds the items with a proximity match in the document.
    """
    if slop is not None and slop > GAP:
        raise ValueError(f"slop can be at most {GAP}")
    found = windows_of(items, size)
    queries: dict[bytes, list] = {}  # by rarest term
    for w, ids in found.items():
        if all(x in frequencies for x in w):
            order = sorted(range(len(w)), key=lambda k: (frequencies[w[k]], k))
            queries.setdefault(w[order[0]], []).append((w, order, ids))
    shared = index.sparkSession.sparkContext.broadcast((queries, {x for some in queries.values() for w, _, _ in some for x in w}))
    schema = "segment string, doc int, items array<string>, near array<string>, spans array<struct<start:int,end:int>>"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, wanted = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                postings = Postings(row, wanted)
                first = np.array([d["start"] for d in row["docs"]], np.int64)
                hits: dict[int, tuple[set, set, list]] = {}
                for words, order, ids in (q for t in postings.lists if t in queries for q in queries[t]):
                    at = postings.phrase(words, order)
                    for doc, start in zip((np.searchsorted(first, at, "right") - 1).tolist(), at.tolist(), strict=True):
                        hit = hits.setdefault(doc, (set(), set(), []))
                        hit[0].update(ids)
                        hit[2].append((int(start - first[doc]), int(start - first[doc]) + len(words)))
                    if slop is not None:
                        for doc in set((np.searchsorted(first, postings.proximity(words, order, slop), "right") - 1).tolist()):
                            hits.setdefault(doc, (set(), set(), []))[1].update(ids)
                out = {"segment": [], "doc": [], "items": [], "near": [], "spans": []}
                for doc, (ids, near, spans) in sorted(hits.items()):
                    out["segment"].append(row["segment"])
                    out["doc"].append(doc)
                    out["items"].append(sorted(map(str, ids)))
                    out["near"].append(sorted(map(str, near)))
                    out["spans"].append([{"start": a, "end": b} for a, b in merged(spans)])
                span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("segment", pa.string()), ("doc", pa.int32()), ("items", pa.list_(pa.string())), ("near", pa.list_(pa.string())), ("spans", pa.list_(span))]))

    return index.mapInArrow(rows, schema)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def blocks_of(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple]]:
    """The benchmark in blocks of about limit bytes, streamed through the driver."""
    block, held = [], 0
    for row in benchmark.select(F.col(id_col), F.col(text_col)).toLocalIterator():
        block.append((row[0], row[1]))
        held += len(row[1] or "")
        if held >= limit:
            yield block
            block, held = [], 0
    if block:
        yield block


def union_of(spans: F.Column) -> F.Column:
    """Sorted intervals merged where they touch."""
    kind = "array<struct<start:int,end:int>>"

    def step(acc: F.Column, x: F.Column) -> F.Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (x["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), grown).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int | None = None, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_bytes: int = BLOCK_BYTES, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """doc_id, n_words, items, near, spans of every row of docs.

    The benchmark is streamed through the driver in blocks of block_bytes; the windows of one block
    and the frequencies of its terms are broadcast at a time, against the whole index.
    """
    index, hits = build_index(docs, id_col, text_col, segment_words), []
    for block in blocks_of(benchmark, item_col, "text", block_bytes):
        frequencies = term_frequencies(index, {w.decode("utf-8", "replace") for _, text in block for w in words_of(text)})
        hits.append(search(index, block, frequencies, size, slop))
    members = index.select("segment", F.posexplode("docs").alias("doc", "d")).select("segment", "doc", F.col("d.id").alias("doc_id"), F.col("d.words").cast("long").alias("n_words"))
    kinds = {"items": "array<string>", "near": "array<string>", "spans": "array<struct<start:int,end:int>>"}
    if not hits:
        return members.select("doc_id", "n_words", *[F.array().cast(t).alias(c) for c, t in kinds.items()])
    every = hits[0]
    if len(hits) > 1:
        for more in hits[1:]:
            every = every.unionByName(more)
        all_of = lambda c: F.flatten(F.collect_list(c))
        every = every.groupBy("segment", "doc").agg(
            F.array_sort(F.array_distinct(all_of("items"))).alias("items"), F.array_sort(F.array_distinct(all_of("near"))).alias("near"), union_of(all_of("spans")).alias("spans")
        )
    return members.join(every, ["segment", "doc"], "left").select("doc_id", "n_words", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in kinds.items()])


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated; n_near and near: items with a proximity match."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
        F.size("near").cast("long").alias("n_near"), F.array_join("near", ",").alias("near"),
    )


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text holds no window of the benchmark, with all of their columns.

    The search names texts by their hash, so ids may repeat or be null.
    """
    named = docs.select(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("key"), F.col(text_col).alias("text"))
    found = decontaminate(named, benchmark, size, id_col="key")
    hit = found.where(F.size("spans") > 0).select(F.col("doc_id").alias(free_name(docs, "hit"))).distinct()
    return docs.join(hit, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256) == hit[hit.columns[0]], "left_anti")
