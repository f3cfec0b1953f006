"""Exact removal of repeated 400-byte strings, decided by suffix arrays of shards.

1. Prune. Each text is cut into runs of consecutive windows (400-byte strings) that share the first
   of their 128-byte pieces in one order of all: by hash, pieces that a sample shows to be common
   last. Equal windows have equal first pieces, so a window can repeat only if its run's piece
   stands at another place of the corpus; counting pieces, combined before the shuffle, rules out
   all other runs. A window of three pieces' length also holds the whole piece before its first piece or the
   one after it, so a run is ruled out too if neither stands beside its piece elsewhere. As common pieces come last, a window that goes beyond a common passage is named by a piece
   of its own, and what a third of all documents share doesn't draw their other bytes into one task.
2. The bytes under a remaining run (its segment) are folded with those of equal content, so what a
   third of all documents share is one segment with a mark.
3. Segments with one piece go to one shard; one that stands at several places and is its piece's only one
   has no other to be compared with. A shard's text is a scratch file, and its suffixes are
   sorted with their common-prefix lengths by external induced sorting (induced.py) as they are
   taken out of disk-backed queues; a window is repeated iff its suffix shares 400 bytes with a
   neighbour in that order, or its segment stands at several places.
4. The repeated windows go back to every text that holds the segment.

Beside this a text's shared passages are counted, as the byte rule alone misses those of over 50 short
words: of each PASSAGE words in a row the string of ANCHOR words with the least hash is an anchor, so two
texts that have as many words in common, in a row, have an anchor in common.

Equal texts are one text with a count; a text of 400 bytes or more that stands in several rows is
repeated whole. Defined results: a null text is empty; a text under 400 bytes keeps all; repeated
rows are texts of their own and so remove each other; an empty table gives no row; columns other
than id and text are not read.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .induced import Pool, Suffixes, mapped

LENGTH = 400
PIECE = 128  # 8 times a power of two
#: Bytes of segments after which a shard is closed, at the next change of piece.
SHARD_BYTES = 8 << 20
#: Texts that are sampled for common pieces, in how many of them a piece is common, and how many
#: are put last. Any order gives the same result; this one makes less to sort.
ORDER_TEXTS, ORDER_LEAST, ORDER_PIECES = 10_000, 8, 65_536
#: Pieces of which so many leading hash bits are 0 can be common.
ORDER_BITS = 5
#: Words of a passage that is told for certain, and of the anchors that tell it.
PASSAGE, ANCHOR = 51, 34
#: Symbols of a shard's text: a byte b of UTF-8 is b + 1, so that 255 ends a segment and 0 the text.
SHIFTED = bytes((i + 1) % 256 for i in range(256))


def key_of(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def data_of(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def piece_hashes(data: bytes) -> np.ndarray:
    """A hash of the PIECE bytes from each position on: of 8 bytes, then of twice as many, and so on."""
    raw = np.frombuffer(data, np.uint8)
    words = np.lib.stride_tricks.as_strided(raw, (len(data) - 7, 8), (1, 1))
    h, width, k = mixed(np.ascontiguousarray(words).view(np.uint64).ravel()), 8, 32
    while width < PIECE:
        h, width, k = h[:-width] * FACTORS[k] + h[width:], 2 * width, k + 1
    return mixed(h)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each width consecutive values: a running least from both ends of blocks of width."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.uint64(2**64 - 1))
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def ordered(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The hashes with their lowest bit lost, those of common (ascending) behind all others."""
    out = hashes >> np.uint64(1)
    if len(common):
        low = np.flatnonzero(hashes >> np.uint64(64 - ORDER_BITS) == 0)
        at = np.minimum(np.searchsorted(common, hashes[low]), len(common) - 1)
        out[low[common[at] == hashes[low]]] |= np.uint64(1 << 63)
    return out


def runs_of(texts: list[bytes], length: int = LENGTH, common: np.ndarray = np.empty(0, np.uint64)) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many runs of windows each text has; piece, first window, windows, places of the piece, and hashes of the
    PIECE bytes before and after its first place (0 if these aren't all under the run) of each run."""
    data, ends = b"".join(texts), np.cumsum([len(t) for t in texts])
    none = np.empty(0, np.int64)
    if len(data) < length:
        return [0] * len(texts), none, none, none, none, none, none
    hashes = ordered(piece_hashes(data), common)
    width = length - PIECE + 1
    least = sliding_least(hashes, width)
    inside = np.zeros(len(least), bool)  # windows of one text
    for text, end in zip(texts, ends.tolist(), strict=True):
        inside[end - len(text) : max(end - length + 1, end - len(text))] = True
    at = np.flatnonzero(inside)
    if not len(at):
        return [0] * len(texts), none, none, none, none, none, none
    own = least[at]
    first = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (np.diff(at) != 1)))
    count = np.diff(np.append(first, len(at)))
    start, own = at[first], own[first]
    found = [(hashes[s : s + c + width - 1] == h).nonzero()[0] for s, c, h in zip(start.tolist(), count.tolist(), own, strict=True)]
    places = np.fromiter(map(len, found), np.int64, len(found))
    place = np.concatenate(found)[np.cumsum(places) - places] + start
    beside = []
    for near, inside in ((place - PIECE, place - PIECE >= start), (place + PIECE, place + 2 * PIECE <= start + count + length - 1)):
        beside.append(np.where(inside, (hashes[np.clip(near, 0, len(hashes) - 1)] >> np.uint64(20)).astype(np.uint32) | np.uint32(1), np.uint32(0)).view(np.int32))
    of = np.searchsorted(ends, start, "right")
    return np.bincount(of, minlength=len(texts)).tolist(), own.view(np.int64), start - np.append(0, ends)[of], count, places, *beside


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


BLANK = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
#: Bits of an 8-byte word that its first 0 to 8 bytes fill, and odd factors for what is added up.
FILLED = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
FACTORS = mixed(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each word begins, and its hash, from its 8-byte parts."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], BLANK[raw], [True]])))
    first, size = edge[::2], edge[1::2] - edge[::2]
    parts = np.lib.stride_tricks.as_strided(np.concatenate([raw, np.zeros(8, np.uint8)]), (len(raw) + 1, 8), (1, 1))
    load = lambda at, n: np.ascontiguousarray(parts[at]).view(np.uint64).ravel() & FILLED[np.minimum(n, 8)]
    h = (load(first, size) + size.astype(np.uint64)) * FACTORS[0]
    longer, k = np.flatnonzero(size > 8), 1
    while len(longer):
        h[longer] = mixed(h[longer]) + load(first[longer] + 8 * k, size[longer] - 8 * k) * FACTORS[k & 63]
        k += 1
        longer = longer[size[longer] > 8 * k]
    return first, mixed(h)


def joined_hashes(h: np.ndarray, count: int) -> np.ndarray:
    """A hash of each count (above 1) hashes in a row: of two, then of twice as many, and so on."""
    width, k = 1, 8
    while 2 * width <= count:
        h, width, k = h[:-width] * FACTORS[k] + h[width:], 2 * width, k + 1
    return mixed(h[: len(h) - count + width] * FACTORS[k] + h[count - width :] if count > width else h)


def anchors_of(texts: list[bytes], passage: int = PASSAGE, anchor: int = ANCHOR) -> list[np.ndarray]:
    """Hashes of each text's anchors, each once; none if it has fewer words than a passage."""
    first, words = word_hashes(np.frombuffer(b" ".join(texts), np.uint8))
    none = np.empty(0, np.int64)
    if len(words) < passage:
        return [none] * len(texts)
    owner = np.searchsorted(np.cumsum([0, *(len(t) + 1 for t in texts)]), first, "right") - 1
    least = sliding_least(joined_hashes(words, anchor), passage - anchor + 1)
    whole = np.flatnonzero(owner[: len(least)] == owner[passage - 1 :])
    own, found = owner[whole], least[whole]
    fresh = np.append(True, (own[1:] != own[:-1]) | (found[1:] != found[:-1]))[: len(own)]
    own, found = own[fresh], found[fresh]
    order = np.lexsort((found, own))
    own, found = own[order], found[order]
    fresh = np.append(True, (own[1:] != own[:-1]) | (found[1:] != found[:-1]))[: len(own)]
    return np.split(found[fresh].view(np.int64), np.searchsorted(own[fresh], np.arange(1, len(texts))))


RUN = pa.struct([("h", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("places", pa.int32()), ("left", pa.int32()), ("right", pa.int32())])


def common_pieces(docs: DataFrame, text_col: str, length: int, texts: int, least: int = ORDER_LEAST) -> np.ndarray:
    """Hashes, ascending, of the most common pieces among those that can be, in a sample of the texts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0):
                data = data_of(text.as_py())
                if len(data) >= length:
                    hashes = piece_hashes(data)
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes[hashes >> np.uint64(64 - ORDER_BITS) == 0]).view(np.int64))], ["h"])

    some = docs.where(F.pmod(F.xxhash64(text_col, *[c for c in docs.columns if c == "doc_id"]), F.lit(max(1, texts // ORDER_TEXTS))) == 0)
    counted = some.select(text_col).mapInArrow(rows, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    top = counted.orderBy(F.desc("n"), "h").limit(ORDER_PIECES).toPandas()["h"].to_numpy(np.int64)
    return np.sort(top.view(np.uint64))


def text_runs(docs: DataFrame, text_col: str, length: int, common: np.ndarray) -> DataFrame:
    """key, n_bytes, runs, anchors of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                sizes, runs, anchors = [], [], []
                waiting, held = [], 0
                for text in [*batch.column(0).slice(at, 1000), None]:
                    if text is not None:
                        waiting.append(data_of(text.as_py()))
                        held += len(waiting[-1])
                    if waiting and (text is None or held > 1 << 20):
                        sizes += map(len, waiting)
                        runs.append(runs_of(waiting, length, common))
                        anchors += anchors_of(waiting)
                        waiting, held = [], 0
                flat = [np.concatenate([r[i] for r in runs]) for i in range(1, 7)]
                values = pa.StructArray.from_arrays([pa.array(f, t.type) for f, t in zip((flat[0], *(x.astype(np.int32) for x in flat[1:])), RUN, strict=True)], fields=list(RUN))
                ends = np.cumsum([0, *(n for r in runs for n in r[0])]).astype(np.int32)
                of = np.cumsum([0, *map(len, anchors)]).astype(np.int32)
                told = pa.ListArray.from_arrays(pa.array(of), pa.array(np.concatenate(anchors)))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, 1000), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values), told], ["key", "n_bytes", "runs", "anchors"])

    named = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return named.withColumn("key", key_of_text()).mapInArrow(rows, "key binary, n_bytes long, runs array<struct<h:long,start:int,windows:int,places:int,left:int,right:int>>, anchors array<long>")


def cut_segments(texts: DataFrame, length: int) -> DataFrame:
    """h, content (hash of the bytes), key, start, windows, data of each run of (text, key, runs)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            held = 0
            for text, key, runs in zip(*batch.columns, strict=True):
                data = data_of(text.as_py())
                for run in runs.as_py():
                    part = data[run["start"] : run["start"] + run["windows"] + length - 1]
                    for x, v in zip(out, (run["h"], key_of(part), key.as_py(), run["start"], run["windows"], part), strict=True):
                        x.append(v)
                    held += len(part)
                if held > 4 << 20:
                    yield segment_batch(out)
                    out, held = [[] for _ in range(6)], 0
            if out[0]:
                yield segment_batch(out)

    return texts.mapInArrow(rows, "h long, content binary, key binary, start int, windows int, data binary")


def segment_batch(out: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["h", "content", "key", "start", "windows", "data"])


class Shard:
    """Segments of a task: their bytes in a scratch file, and what is told of each."""

    def __init__(self) -> None:
        self.file, self.size = tempfile.TemporaryFile(), 0
        self.rows: list[tuple[int, bytes, bool, int, int]] = []  # h, content, several, start, bytes

    def add(self, h: int, content: bytes, several: bool, data: bytes) -> None:
        self.rows.append((h, content, several, self.size, len(data)))
        self.file.write(data.translate(SHIFTED))
        self.file.write(b"\xff")
        self.size += len(data) + 1

    def repeated(self, length: int, pool: Pool) -> np.ndarray:
        """Whether each byte begins a string of length bytes that begins elsewhere in the shard too."""
        self.file.write(b"\0")
        self.file.flush()
        text = np.memmap(self.file, np.uint8, "r", shape=(self.size + 1,)).view(np.ndarray)
        hit = mapped(self.size + 1, np.bool_)
        last: list[np.ndarray] = []

        def taken(at: np.ndarray, prefix: np.ndarray) -> None:
            near = np.flatnonzero(prefix >= length)
            hit[at[near]] = True
            hit[at[near[near > 0] - 1]] = True
            if len(near) and near[0] == 0:
                hit[last[0]] = True
            last[:] = [at[-1:].copy()]

        Suffixes(text, 256, pool, length).descending(taken)
        return hit


def flag_spans(flags: np.ndarray, length: int) -> list[dict]:
    """Byte spans that the flagged windows cover, those that touch as one."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cuts = np.flatnonzero(np.diff(at) > length)
    first, last = np.append(at[0], at[cuts + 1]), np.append(at[cuts], at[-1])
    return [{"start": int(a), "end": int(b) + length} for a, b in zip(first, last, strict=True)]


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def by_piece(rows: Iterator[tuple]) -> Iterator[tuple[tuple, bool]]:
    """Each of the rows (sorted by their first value), and whether no other row has its first value."""
    held, same = None, False
    for row in rows:
        if held is not None:
            again = row[0] == held[0]
            yield held, not (same or again)
            same = again
        held = row
    if held is not None:
        yield held, not same


def decide(segments: DataFrame, length: int, shard_bytes: int, limits: dict[str, int]) -> DataFrame:
    """h, content, spans: the repeated byte spans of each segment, relative to its start.

    segments: h, content, several (it stands at several places), data; one row per content.
    limits: those of induced.Pool.
    """

    def solve(shard: Shard) -> Iterator[pa.RecordBatch]:
        hit = shard.repeated(length, Pool(**limits))
        for i in range(0, len(shard.rows), 10_000):
            part = shard.rows[i : i + 10_000]
            spans = [[{"start": 0, "end": n}] if several else flag_spans(hit[at : at + n - length + 1], length) for _, _, several, at, n in part]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.binary()), pa.array(spans, SPANS)], ["h", "content", "spans"])

    def whole(alone: list[tuple[int, bytes, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in alone], pa.int64()), pa.array([r[1] for r in alone], pa.binary()), pa.array([[{"start": 0, "end": r[2]}] for r in alone], SPANS)], ["h", "content", "spans"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, alone = Shard(), []
        for some, only in by_piece(tuple(x.as_py() for x in row) for batch in batches for row in zip(*batch.columns, strict=True)):
            h, content, several, data = some
            if only and several:  # repeated whole, and nothing else has its piece
                alone.append((h, content, len(data)))
                if len(alone) == 10_000:
                    yield whole(alone)
                    alone = []
                continue
            if shard.size >= shard_bytes and h != shard.rows[-1][0]:
                yield from solve(shard)
                shard = Shard()
            shard.add(*some)
        if alone:
            yield whole(alone)
        if shard.rows:
            yield from solve(shard)

    at = segments.select("h", "content", "several", "data").repartition("h").sortWithinPartitions("h")
    return at.mapInArrow(rows, "h long, content binary, spans array<struct<start:int,end:int>>")


def distinct_texts(docs: DataFrame, length: int, text_col: str) -> DataFrame:
    """key, copies, n_bytes, runs, anchors of each text that can lose bytes or share a passage."""
    runs = text_runs(docs, text_col, length, common_pieces(docs, text_col, length, docs.count()))
    texts = runs.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("n_bytes").alias("n_bytes"), F.first("runs").alias("runs"), F.first("anchors").alias("anchors"))
    return materialize(texts.where((F.col("n_bytes") >= length) | (F.size("anchors") > 0)), "text-runs")


#: What a row of anchors is: the one of its anchor in its chunk, one that is known to be shared, or the one
#: that tells others so. Rows of a chunk.
ALONE, TOLD, TELLS = 0, 1, 2
CHUNK_ROWS = 1 << 18


def own_anchors(texts: DataFrame) -> DataFrame:
    """anchor, k, kind of (k, anchors): what several texts of a chunk share is told at once, and one of them tells
    the other chunks. So an anchor has a row a chunk at most, whatever the number of texts that hold it."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def chunk() -> pa.RecordBatch:
            anchor, k = map(np.concatenate, zip(*held, strict=True))
            order = np.argsort(anchor, kind="stable")
            anchor, k = anchor[order], k[order]
            again = np.append(False, anchor[1:] == anchor[:-1])
            several = again | np.append(again[1:], False)
            first = several & ~again
            kind = np.concatenate([np.where(several, TOLD, ALONE), np.full(int(first.sum()), TELLS)]).astype(np.int8)
            anchor, k = np.concatenate([np.where(several, k, anchor), anchor[first]]), np.concatenate([k, k[first]])
            return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(k), pa.array(kind)], ["anchor", "k", "kind"])

        for batch in batches:
            lists = batch.column(1)
            counts = np.diff(lists.offsets.to_numpy())
            held.append((lists.flatten().to_numpy(), np.repeat(batch.column(0).to_numpy(), counts)))
            size += len(held[-1][0])
            if size >= CHUNK_ROWS:
                yield chunk()
                held, size = [], 0
        if size:
            yield chunk()

    return texts.mapInArrow(rows, "anchor long, k long, kind byte")


def passages(texts: DataFrame) -> DataFrame:
    """key, n_shared: how many of its anchors another text, or an equal one, has; of texts that have any."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int8)
        for batch in batches:
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array(now[1][now[2] == TOLD])], ["k"])
            anchor, k, kind = (np.concatenate([x, y[now[2] != TOLD]]) for x, y in zip(last, now, strict=True))
            cut = int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0  # the last anchor may go on
            yield pa.RecordBatch.from_arrays([pa.array(met(anchor[:cut], k[:cut], kind[:cut]))], ["k"])
            last = anchor[cut:], k[cut:], kind[cut:]
        yield pa.RecordBatch.from_arrays([pa.array(met(*last))], ["k"])

    named = texts.withColumn("k", F.xxhash64("key"))
    dealt = own_anchors(named.select("k", "anchors"))
    found = dealt.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(rows, "k long").groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    names = named.select("key", "copies", "k", F.size("anchors").cast("long").alias("every"))
    return names.join(found.withColumnRenamed("k", "its"), F.col("k") == F.col("its"), "left").select("key", F.when(F.col("copies") > 1, F.col("every")).otherwise(F.coalesce("n", F.lit(0))).alias("n_shared")).where("n_shared > 0")


def met(anchor: np.ndarray, k: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """The texts of sorted rows that stand alone in their chunk but not in all."""
    again = np.append(False, anchor[1:] == anchor[:-1])[: len(anchor)]
    several = again | np.append(again[1:], False)[: len(anchor)]
    return k[several & (kind == ALONE)]


def beside_again(runs: DataFrame) -> DataFrame:
    """The runs (h, most, left, right, ...) whose piece stands elsewhere too with the same piece before or after it.

    A window of three times PIECE or more has PIECE bytes on one side of its first piece at least. Where a run of the
    piece holds it several times (most), all of the piece's runs stay.
    """
    sides = F.array(F.when(F.col("left") != 0, F.xxhash64("h", F.lit(0), "left")), F.when(F.col("right") != 0, F.xxhash64("h", F.lit(1), "right")))
    runs = materialize(runs, "open-runs")
    several = runs.where("most > 1")
    single = runs.where("most = 1").withColumn("sides", F.filter(sides, lambda s: s.isNotNull()))
    each = single.select("key", "h", "start", F.explode("sides").alias("side"))
    met = each.groupBy("side").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("side")
    stay = each.join(met, "side", "left_semi").select("key", "h", "start").distinct()
    return several.select("key", "h", "start", "windows").unionByName(single.join(stay, ["key", "h", "start"], "left_semi").select("key", "h", "start", "windows"))


def removals(docs: DataFrame, texts: DataFrame, length: int = LENGTH, text_col: str = "text", shard_bytes: int = SHARD_BYTES, **limits: int) -> DataFrame:
    """key, spans: for each text (of distinct_texts) that loses bytes the spans, not yet joined, that it loses."""
    texts = texts.where(F.col("n_bytes") >= length)
    each = texts.select("key", F.explode("runs").alias("r")).select("key", "r.*")
    again = each.groupBy("h").agg(F.sum("places").alias("n"), F.max("places").alias("most")).where("n > 1").select(F.col("h").alias("its_h"), "most")
    each = each.join(again, F.col("h") == F.col("its_h")).drop("its_h")
    open_runs = (beside_again(each) if length >= 3 * PIECE else each).groupBy("key").agg(F.collect_list(F.struct("h", "start", "windows")).alias("runs"))
    keyed = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).where(F.octet_length("text") >= length)
    found = keyed.withColumn("key", key_of_text()).join(open_runs, "key").select("text", "key", "runs")
    segments = materialize(cut_segments(found, length), "segments")
    place = F.struct("key", "start")
    folded = segments.groupBy("h", "content").agg((F.min(place) != F.max(place)).alias("several"), F.first("data").alias("data"))
    decided = decide(folded, length, shard_bytes, limits).where(F.size("spans") > 0)
    back = segments.select("h", "content", "key", "start").join(decided, ["h", "content"])
    shifted = F.transform("spans", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), (s["end"] + F.col("start")).alias("end")))
    of_runs = back.select("key", F.explode(shifted).alias("s")).distinct()
    whole = texts.where("copies > 1").select("key", F.struct(F.lit(0).alias("start"), F.col("n_bytes").cast("int").alias("end")).alias("s"))
    return materialize(of_runs.unionByName(whole).groupBy("key").agg(F.collect_list("s").alias("spans")), "removals")


def key_of_text() -> F.Column:
    """128 bits that name the text of a table with a text column."""
    return F.unhex(F.md5("text"))


def kept_of(data: bytes, spans: list[dict]) -> tuple[bytes, int, int]:
    """What is left of data, bytes removed, and maximal removed runs."""
    flags = np.zeros(len(data) + 1, np.int32)
    for s in spans:
        flags[s["start"]] += 1
        flags[s["end"]] -= 1
    gone = np.cumsum(flags)[:-1] > 0
    n_spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1])) if len(data) else 0
    return np.frombuffer(data, np.uint8)[~gone].tobytes(), int(gone.sum()), n_spans


def deduplicate(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_shared and kept (the bytes left) of every row."""
    texts = distinct_texts(docs, length, text_col)
    gone = removals(docs, texts, length, text_col, **limits).join(passages(texts), "key", "full_outer")
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = keyed.withColumn("key", key_of_text()).join(gone, "key", "left").select("doc_id", "text", "spans", F.coalesce("n_shared", F.lit(0)).alias("n_shared"))
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "n_shared"]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out: list[list] = [[] for _ in range(5)]
                for text, spans in zip(part.column(1), part.column(2), strict=True):
                    data = data_of(text.as_py())
                    spans = spans.as_py()
                    kept, removed, n = kept_of(data, spans) if spans else (data, 0, 0)
                    for x, v in zip(out, (len(data), removed, n, hashlib.sha256(kept).hexdigest(), kept), strict=True):
                        x.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, t) for x, t in zip(out, kinds, strict=True)), part.column(3)], names)

    return joined.mapInArrow(rows, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, n_shared long")


def digest(found: DataFrame) -> DataFrame:
    return found.drop("kept")
