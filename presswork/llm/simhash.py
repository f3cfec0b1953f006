"""SimHash near duplicates by anchor-point covering.

A fingerprint's bits are cut into blocks. If two fingerprints differ in at most D bits, they
differ in at most D // blocks bits of one block. The points of a block are covered by the
codewords of a product of perfect Hamming codes (anchors, covering radius one per factor); each
point has a home anchor, its nearest codeword. A fingerprint is sent to its homes and to every
anchor that is the home of a point within the block's share of the threshold, which are anchors
within covering radius plus threshold. So any two that are near enough meet at the home anchor
of one of them, and are compared there.

Before that, equal fingerprints are folded into one, so copies never meet in a group; each group
hands on a star for what its links connect, not all of its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, discard, discarding, materialize, releasing
from .components import components

SEED = 42
#: Rows compared at once: a block of homes times a block of the group.
COMPARE_CELLS = 4_000_000
#: Members of an anchor that one task compares; a larger group is dealt out as pairs of blocks. Groups
#: are counted by slots of anchors, so that what is broadcast about them has at most a row per slot.
GROUP_ROWS, GROUP_SLOTS = 20_000, 1 << 16
#: Copies from which on a name's rows are joined by a broadcast of such names, and how many there may be.
HOT_ROWS, HOT_NAMES = 1000, 100_000


def words_of(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []


def shingles_of(words: list[bytes], size: int) -> Iterator[bytes]:
    """size consecutive words joined by a space; the whole sequence if it is shorter."""
    if len(words) < size:
        return iter([b" ".join(words)] if words else [])
    return map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))


@lru_cache(1)
def _lanes() -> np.ndarray:
    """For each byte a word whose eight byte lanes hold its bits."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.ascontiguousarray(bits).view(np.uint64).ravel()


def fingerprints(hashes: np.ndarray, counts: list[int]) -> np.ndarray:
    """The fingerprint of each run of counts hashes: bits that are set in over half of the run."""
    out = np.zeros(len(counts), np.uint64)
    if not len(hashes):
        return out
    ends = np.cumsum(counts)
    cuts, owner = [], []
    for i, (end, n) in enumerate(zip(ends, counts, strict=True)):
        for at in range(int(end - n), int(end), 255):  # a lane holds up to 255
            cuts.append(at)
            owner.append(i)
    lanes = _lanes()[hashes.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, cuts, axis=0).view(np.uint8).reshape(-1, 64).astype(np.int32)
    owner = np.array(owner)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    totals = np.add.reduceat(sums, first, axis=0)
    held = owner[first]
    over = totals * 2 > np.array(counts)[held][:, None]
    out[held] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprint_table(docs: DataFrame, size: int, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                hashes, counts = [], []
                for text in part.column(1):
                    words = words_of(text.as_py())
                    n = max(len(words) - size + 1, 1) if words else 0
                    hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, shingles_of(words, size), repeat(seed)), np.uint64, n))
                    counts.append(n)
                fp = fingerprints(np.concatenate(hashes), counts)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(rows, f"doc_id {kind}, fp long")


@lru_cache(4)
def _nearest(r: int) -> np.ndarray:
    """Nearest codeword of every word of 2**r - 1 bits in the Hamming code.

    Bit i has i + 1 as its column of the parity check; a word's syndrome is the xor of its set
    bits' columns, and flipping bit syndrome - 1 makes it a codeword.
    """
    n = 2**r - 1
    word = np.arange(2**n, dtype=np.int64)
    syndrome = np.zeros(2**n, np.int64)
    for i in range(n):
        syndrome ^= ((word >> i) & 1) * (i + 1)
    return np.where(syndrome, word ^ (1 << np.maximum(syndrome - 1, 0)), word)


class AnchorCode:
    """Anchors of a block of bits: Hamming codes of 15 bits (4-bit syndromes), then raw bits."""

    def __init__(self, low: int, width: int, near: int):
        self.low, self.width, self.near = low, width, near
        errors = [sum(1 << i for i in e) for k in range(near + 1) for e in combinations(range(width), k)]
        self.errors = np.array(errors, np.int64)

    def home(self, points: np.ndarray) -> np.ndarray:
        table, out, at = _nearest(4), points.copy(), 0
        while at + 15 <= self.width:
            part = (out >> at) & 0x7FFF
            out ^= (part ^ table[part]) << at
            at += 15
        return out

    def slots(self, anchor: np.ndarray, k: int) -> np.ndarray:
        """The slot of anchors of the code that is number k, by which groups are counted."""
        mixed = (anchor | (k << 40)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(48)).astype(np.int64) % GROUP_SLOTS

    def block(self, fp: np.ndarray) -> np.ndarray:
        return ((fp.view(np.uint64) >> np.uint64(self.low)) & np.uint64(2**self.width - 1)).astype(np.int64)

    def anchors(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """anchor, index into fp, whether it is the fingerprint's home."""
        points = self.block(fp)
        home = self.home(points)
        reached = np.sort(self.home(points[:, None] ^ self.errors[None, :]), axis=1)
        fresh = np.ones(reached.shape, bool)
        fresh[:, 1:] = reached[:, 1:] != reached[:, :-1]
        row, col = np.nonzero(fresh)
        anchor = reached[row, col]
        return anchor, row, anchor == home[row]


def codes_for(distance: int, blocks: int) -> list[AnchorCode]:
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    return [AnchorCode(a, b - a, distance // blocks) for a, b in zip(edges, edges[1:], strict=False)]


def group_blocks(nodes: DataFrame, sides: tuple[str, ...], codes: Callable[[], list[AnchorCode]], most: int) -> np.ndarray:
    """For each slot into how many blocks of members its anchors' groups are dealt: 1 as a rule."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, total = codes(), np.zeros(GROUP_SLOTS, np.int64)
        for batch in batches:
            for side in range(len(sides)):
                every = batch.column(side).to_numpy(zero_copy_only=False)
                for at in range(0, len(every), 4096):
                    for k, code in enumerate(made):
                        slot = code.slots(code.anchors(every[at : at + 4096])[0], side * len(made) + k)
                        total += np.bincount(slot, minlength=GROUP_SLOTS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["slot", "n"])

    counted = nodes.select(*sides).mapInArrow(rows, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.ones(GROUP_SLOTS, np.int64)
    for r in counted.where(F.col("n") > most).toLocalIterator():
        out[r["slot"]] = -(-r["n"] // most)
    return out


def dealt(anchor: np.ndarray, home: np.ndarray, blocks: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """rows (indices), cell, whether a home there, whether another there.

    A group of s blocks has a cell for each pair of a block of homes and a block of members; cell 0
    is all there is of an undivided group.
    """
    whole = np.flatnonzero(blocks == 1)
    yield whole, np.zeros(len(whole), np.int64), home[whole], np.ones(len(whole), bool)
    for s in np.unique(blocks[blocks > 1]).tolist():
        some = np.flatnonzero(blocks == s)
        mine = own[some] % s
        for j in range(s):
            here = home[some]
            yield some[here], mine[here] * s + j, np.ones(int(here.sum()), bool), mine[here] == j
            rest = ~here | (mine != j)  # the home's own cell (mine, mine) has it as both
            yield some[rest], j * s + mine[rest], np.zeros(int(rest.sum()), bool), np.ones(int(rest.sum()), bool)


def anchored(fps: DataFrame, distance: int, blocks: int, most: int = GROUP_ROWS) -> DataFrame:
    """anchor (block number and codeword), cell, home, member, fp: each distinct fingerprint at its anchors."""
    split = fps.sparkSession.sparkContext.broadcast(group_blocks(fps, ("fp",), lambda: codes_for(distance, blocks), most))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = codes_for(distance, blocks)
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(every), 4096):
                fp = every[at : at + 4096]
                for k, code in enumerate(codes):
                    anchor, row, home = code.anchors(fp)
                    own = ((fp[row].view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)).astype(np.int64)
                    for some, cell, is_home, member in dealt(anchor, home, split.value[code.slots(anchor, k)], own):
                        if len(some):
                            yield pa.RecordBatch.from_arrays([pa.array(anchor[some] | (k << 40)), pa.array(cell), pa.array(is_home), pa.array(member), pa.array(fp[row[some]])], ["anchor", "cell", "home", "member", "fp"])

    return fps.select("fp").mapInArrow(rows, "anchor long, cell long, home boolean, member boolean, fp long")


def least_linked(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n items the least item that links reach; links come in blocks of (from, to)."""
    root = np.arange(n)

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        while len(a):  # links inside a component go in one step, as many as there are
            for x, y in zip(a[:256].tolist(), b[:256].tolist(), strict=True):
                p, q = find(x), find(y)
                if p != q:
                    root[max(p, q)] = min(p, q)
            a, b = a[256:], b[256:]
            while not np.array_equal(root, root[root]):
                root[:] = root[root]
            open_ = root[a] != root[b]
            a, b = a[open_], b[open_]
    while not np.array_equal(root, root[root]):
        root[:] = root[root]
    return root


def star_edges(nodes: np.ndarray, root: np.ndarray) -> np.ndarray:
    """(node, least linked node) rows of a group in ascending order. Groups that share members tend
    to agree on the least one, so few different edges are left when all are made distinct."""
    moved = np.flatnonzero(root != np.arange(len(root)))
    return np.stack([nodes[moved], nodes[root[moved]]], axis=1)


def links_at_anchors(at: DataFrame, distance: int) -> DataFrame:
    """a, b: each anchor's links at distance or less, as stars."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []
        held = 0
        for _, _, home, member, fp in groups_of(batches):
            home, member = home.astype(bool), member.astype(bool)
            if len(fp) < 2 or not home.any():
                continue
            order = np.argsort(fp, kind="stable")
            home, member, fp = home[order], member[order], fp[order]
            edges = star_edges(fp, least_linked(len(fp), near_pairs(fp, np.flatnonzero(home), np.flatnonzero(member), distance)))
            if len(edges):
                out.append(edges)
                held += len(edges)
            if held > 50_000:
                every = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], ["a", "b"])
                out, held = [], 0
        if out:
            every = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], ["a", "b"])

    return at.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell").mapInArrow(rows, "a long, b long").distinct()


def near_pairs(fp: np.ndarray, homes: np.ndarray, members: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (home, member) of fingerprints at distance or less, in bounded blocks."""
    every = fp.view(np.uint64)
    step = max(1, COMPARE_CELLS // max(1, len(members)))
    for at in range(0, len(homes), step):
        part = homes[at : at + step]
        a, b = np.nonzero(np.bitwise_count(every[part][:, None] ^ every[members][None, :]) <= distance)
        a, b = part[a], members[b]
        other = a != b
        yield a[other], b[other]


def joined_by_name(rows: DataFrame, names: DataFrame, key: str, total: int) -> DataFrame:
    """rows with the columns of names (one row each: key, ..., copies) of the same key.

    Names of very many rows, at most HOT_NAMES of them, are broadcast, so that their rows stay where they are.
    """
    least = max(HOT_ROWS, -(-total // HOT_NAMES))
    hot, cold = names.where(F.col("copies") >= least), names.where(F.col("copies") < least)
    known = hot.select(F.col(key).alias("hot_key"))
    few = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(known), F.col(key) == F.col("hot_key"), "left_anti").join(cold, key)
    return few.unionByName(rest)


def near_duplicates(docs: DataFrame, size: int = 3, distance: int = 3, blocks: int = 2, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, component_id of every row of docs.

    Fingerprints that differ in at most distance bits are linked; component_id is the least doc_id
    that links reach from the row, itself included. Defined results: a text without words (null
    too) has fingerprint zero and is linked like any other; null ids are no component's least id
    (component_id is null only where all of its ids are); repeated rows are reported each; an
    empty table gives no row; columns other than id and text are not read.
    """
    table = materialize(fingerprint_table(docs, size, seed, id_col, text_col), "fingerprints")
    least = materialize(table.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "distinct-fingerprints")
    edges = links_at_anchors(anchored(least, distance, blocks), distance)
    roots = materialize(components(edges), "fingerprint-components")
    linked = least.join(roots, least["fp"] == roots["node"])
    per_root = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    other = linked.join(per_root, "root").select(F.col("fp").alias("linked_fp"), "component_id")
    owner = least.join(other, least["fp"] == other["linked_fp"], "left").select("fp", F.coalesce("component_id", "least").alias("component_id"), "copies")
    owner = materialize(owner, "fingerprint-owners")
    return joined_by_name(table, owner, "fp", table.count()).select("doc_id", "fp", "component_id")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id."""
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: keep_one: least Jaccard similarity of word shingle sets, their size, and the shingles that are
#: fingerprinted. Two fingerprints (seeds) of four blocks make 128 bits. They find most near copies
#: cheaply and fold them into groups, but not all: cut or appended texts change as many two-word as
#: five-word shingles. The pairs that they miss are found by the prefix join below.
SIMILARITY, SHINGLE = 0.8, 5
SKETCH_SHINGLE, SEEDS, SKETCH_DISTANCE, SKETCH_BLOCKS = 2, (42, 43), 7, 4
NEAR_BITS = 26
#: Texts that are sampled to put common shingles last in the prefix join's order, and how many
#: shingles are; any order finds the same pairs, this one makes fewer candidates.
ORDER_TEXTS, ORDER_SHINGLES = 10_000, 65_536
#: One text in how many is listed in that order first, for the shingles at which many would be listed in spite of
#: it: the sample is of one size, so the larger the table, the more texts have a shingle that is rare in the sample. And how many such shingles there may be.
CROWD_SHARE, CROWD_SHINGLES = 8, 262_144
#: Slots by which texts of no candidate are left out before they are joined.
TEXT_SLOTS = 2**20
#: Texts that are compared with one other in a task.
CENTRE_PAIRS = 500
#: Texts with one shingle in their prefixes up to which their pairs are listed; those of more meet at a
#: pivot, by what each has lost and gained against it. Columns of such differences that are multiplied at once.
LISTED, COLUMNS = 64, 1024


def sketches(docs: DataFrame, text_col: str) -> DataFrame:
    """node (hash of the text), a, b (two fingerprints) of every row of (doc_id, node, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                columns: list[list] = [[] for _ in SEEDS]
                counts = []
                for text in part.column(2):
                    words = words_of(text.as_py())
                    some = list(dict.fromkeys(shingles_of(words, SKETCH_SHINGLE)))
                    counts.append(len(some))
                    for out, seed in zip(columns, SEEDS, strict=True):
                        out.append(np.fromiter(map(xxhash.xxh64_intdigest, some, repeat(seed)), np.uint64, len(some)))
                fps = [pa.array(fingerprints(np.concatenate(out), counts).view(np.int64)) for out in columns]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *fps], ["doc_id", "node", "a", "b"])

    return docs.select("doc_id", "node", text_col).mapInArrow(rows, f"doc_id {kind}, node long, a long, b long")


def anchored_pairs(nodes: DataFrame, most: int = GROUP_ROWS) -> DataFrame:
    """anchor, cell, home, member, node, a, b: each node at the anchors of both of its fingerprints."""
    make = lambda: codes_for(SKETCH_DISTANCE, SKETCH_BLOCKS)
    split = nodes.sparkSession.sparkContext.broadcast(group_blocks(nodes, ("a", "b"), make, most))
    names = ["anchor", "cell", "home", "member", "node", "a", "b"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = make()
        for batch in batches:
            node, a, b = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for at in range(0, len(node), 4096):
                part = slice(at, at + 4096)
                for side, fp in enumerate((a[part], b[part])):
                    for k, code in enumerate(codes):
                        number = side * len(codes) + k
                        anchor, row, home = code.anchors(fp)
                        for some, cell, is_home, member in dealt(anchor, home, split.value[code.slots(anchor, number)], node[part][row] >> 8):
                            if len(some):
                                of = row[some]
                                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (anchor[some] | (number << 40), cell, is_home, member, node[part][of], a[part][of], b[part][of])], names)

    return nodes.select("node", "a", "b").mapInArrow(rows, "anchor long, cell long, home boolean, member boolean, node long, a long, b long")


def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of each run of one value of the first two columns in sorted batches."""
    held: list[list[np.ndarray]] = []
    last = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(columns[0]):
            continue
        cuts = [0, *(np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1).tolist(), len(columns[0])]
        for x, y in zip(cuts, cuts[1:], strict=False):
            own = columns[0][x], columns[1][x]
            if held and own != last:
                yield [np.concatenate(c) for c in zip(*held, strict=True)]
                held = []
            last = own
            held.append([c[x:y] for c in columns])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def sketch_links(at: DataFrame, near_bits: int) -> DataFrame:
    """a, b: nodes within near_bits of each other at each anchor, as stars."""

    def pairs(a: np.ndarray, b: np.ndarray, homes: np.ndarray, members: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        a, b = a.view(np.uint64), b.view(np.uint64)
        step = max(1, COMPARE_CELLS // max(1, len(members)))
        for i in range(0, len(homes), step):
            part = homes[i : i + step]
            bits = np.bitwise_count(a[part][:, None] ^ a[members][None, :]) + np.bitwise_count(b[part][:, None] ^ b[members][None, :])
            x, y = np.nonzero(bits <= near_bits)
            x, y = part[x], members[y]
            other = x != y
            yield x[other], y[other]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for _, _, home, member, node, a, b in groups_of(batches):
            order = np.argsort(node, kind="stable")
            home, member, node, a, b = home[order].astype(bool), member[order].astype(bool), node[order], a[order], b[order]
            homes = np.flatnonzero(home)
            if len(node) > 1 and len(homes):
                edges = star_edges(node, least_linked(len(node), pairs(a, b, homes, np.flatnonzero(member))))
                if len(edges):
                    out.append(edges)
                    held += len(edges)
            if held > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)[:, i]) for i in (0, 1)], ["a", "b"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)[:, i]) for i in (0, 1)], ["a", "b"])

    return at.repartition("anchor", "cell").sortWithinPartitions("anchor", "cell").mapInArrow(rows, "a long, b long").distinct()


def similar(x: np.ndarray, y: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have a Jaccard similarity of least or more."""
    small, large = sorted((len(x), len(y)))
    if small < least * large:
        return False
    if not large:
        return True
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common >= least * (small + large - common) - 1e-9


def shingle_set(text: str | None, size: int) -> np.ndarray:
    some = set(shingles_of(words_of(text), size))
    return np.sort(np.fromiter(map(xxhash.xxh64_intdigest, some), np.uint64, len(some)))


def shingle_keys(text: str | None, size: int) -> np.ndarray:
    """Distinct 60-bit hashes of the shingles, in ascending order, made of hashes of single words."""
    words = words_of(text)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(s) >> 4 for s in shingles_of(words, size)], np.uint64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = len(words) - size + 1
    key = np.zeros(n, np.uint64)
    for i in range(size):
        key = key * np.uint64(0x9E3779B97F4A7C15) + one[i : i + n]
    key ^= key >> np.uint64(29)
    key *= np.uint64(0xC2B2AE3D27D4EB4F)
    return np.unique((key ^ (key >> np.uint64(32))) >> np.uint64(4))


def at_least(share: float, n: np.ndarray) -> np.ndarray:
    """The least whole number that is share * n or more."""
    return np.ceil(share * n - 1e-9).astype(np.int64)


def once_each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str | None]]:
    """node, text of batches of (node, text), without the nodes that the task had before."""
    seen: set[int] = set()
    for batch in batches:
        for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if node not in seen:
                seen.add(node)
                yield node, text.as_py()


def common_shingles(named: DataFrame, total: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, ascending, of the most common shingles of a sample, and their ranks from 1 to 15."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, text in once_each(batches):
            yield pa.RecordBatch.from_arrays([pa.array(shingle_keys(text, size).view(np.int64))], ["key"])

    some = named.where(F.pmod("node", F.lit(max(1, total // ORDER_TEXTS))) == 0).select("node", "text").mapInArrow(rows, "key long")
    with releasing(named.sparkSession):
        top = some.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n >= 4").orderBy(F.desc("n"), "key").limit(ORDER_SHINGLES).collect()
    found = sorted((r["key"], min(r["n"].bit_length(), 15)) for r in top)
    return np.array([k for k, _ in found], np.uint64), np.array([n for _, n in found], np.uint64)


def prefixes(named: DataFrame, common: tuple[np.ndarray, np.ndarray], size: int, least: float) -> DataFrame:
    """key, node, n: the first keys of each text's n, common ones last. Sets of a similarity of
    least or more have at least at_least(least, n) in common, so one of these is."""
    shared = named.sparkSession.sparkContext.broadcast(common)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ranks = shared.value
        keys, nodes, sizes, held = [], [], [], 0

        def batch() -> pa.RecordBatch:
            each = [len(k) for k in keys]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(np.array(nodes, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int32), each))], ["key", "node", "n"])

        for node, text in once_each(batches):
            key = shingle_keys(text, size)
            if not len(key):
                continue
            if len(known):
                at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                key = np.sort(key | np.where(known[at] == key, ranks[at] << np.uint64(60), np.uint64(0)))
            keys.append(key[: len(key) - int(at_least(least, len(key))) + 1])
            nodes.append(node)
            sizes.append(len(key))
            held += len(keys[-1])
            if held > 50_000:
                yield batch()
                keys, nodes, sizes, held = [], [], [], 0
        if keys:
            yield batch()

    return named.select("node", "text").mapInArrow(rows, "key long, node long, n int")


def with_crowded(named: DataFrame, common: tuple[np.ndarray, np.ndarray], total: int, size: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """common and the shingles outside it that about LISTED texts or more are listed at in its order.

    Texts that have no more than such a shingle in common would all be told their differences to its pivot, which are whole sets.
    """
    each = max(1, total // ORDER_TEXTS)
    share = min(CROWD_SHARE, each)
    listed = prefixes(named.where(F.pmod("node", F.lit(share)) == 0), common, size, least).where((F.col("key") >= 0) & (F.col("key") < 1 << 60))
    counts = listed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low"), F.max("node").alias("high"))
    with releasing(named.sparkSession):
        top = counts.where((F.col("n") >= max(4, LISTED // (2 * share))) & (F.col("low") < F.col("high"))).orderBy(F.desc("n"), "key").limit(CROWD_SHINGLES).select("key", "n").toArrow()
    found = top.column("key").to_numpy().view(np.uint64)
    ranks = np.array([min(max(1, (n * share // each).bit_length()), 15) for n in top.column("n").to_pylist()], np.uint64)
    known, ranks = np.concatenate([common[0], found]), np.concatenate([common[1], ranks])
    order = np.argsort(known, kind="stable")
    return known[order], ranks[order]


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of sorted batches, cut so that no run of one value of the first column is divided."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if not len(now[0]):
            continue
        if held:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        cuts = np.flatnonzero(now[0][1:] != now[0][:-1])
        cut = int(cuts[-1]) + 1 if len(cuts) else 0
        if cut:
            yield [c[:cut] for c in now]
        held = [c[cut:] for c in now]
    if held:
        yield held


def held_by_several(prefix: DataFrame) -> DataFrame:
    """The rows of prefix, once each, whose key several nodes have."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, n in whole_runs(batches):
            fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]))
            key, node, n = key[fresh], node[fresh], n[fresh]
            first = np.append(True, key[1:] != key[:-1])
            several = ~(first & np.append(first[1:], True))
            yield pa.RecordBatch.from_arrays([pa.array(x[several]) for x in (key, node, n)], ["key", "node", "n"])

    return prefix.repartition("key").sortWithinPartitions("key", "node").mapInArrow(rows, "key long, node long, n int")


def candidates(held: DataFrame, least: float) -> DataFrame:
    """a, b, at_pivot: nodes of different parts that may have a similarity of least or more.

    held: key, node, n, part. Beyond the prefix that ends first a text has less than
    at_least(least, n) shingles; what else the similarity needs must be in both prefixes. Where a key has more than
    LISTED nodes, each of them (b) is told the key's pivot (a) instead of all others: the node of the
    least mixed number, which is the same for most keys of a group of copies.
    """

    def pairs(node: np.ndarray, n: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(n, kind="stable")
        node, n, part = node[order], n[order].astype(np.int64), part[order]
        ends, every = np.searchsorted(n, np.floor(n / least + 1e-9), "right"), np.arange(len(n))
        x, y = np.nonzero((every > every[:, None]) & (every < ends[:, None]) & (part != part[:, None]))
        need = at_least(least / (1 + least), n[x] + n[y]) - at_least(least, n[y]) + 1
        swap = node[x] > node[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        return node[x], node[y], need

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "need", "at_pivot"])

        for key, node, n, part in whole_runs(batches):
            first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            ends = np.append(first[1:], len(key))
            mixed = np.add.reduceat(part != np.repeat(part[first], ends - first), first) > 0
            for x, y in zip(first[mixed].tolist(), ends[mixed].tolist(), strict=True):
                some = node[x:y]
                if y - x <= LISTED:
                    a, b, need = pairs(some, n[x:y], part[x:y])
                else:
                    pivot = some[np.argmin(some.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))]
                    b = some[some != pivot]
                    a, need = np.full(len(b), pivot), np.ones(len(b), np.int64)
                out.append((a, b, need, np.full(len(a), y - x > LISTED)))
                size += len(a)
                if size > 50_000:
                    yield batch()
                    out, size = [], 0
        if out:
            yield batch()

    found = held.repartition("key").sortWithinPartitions("key").select("key", "node", "n", "part").mapInArrow(rows, "a long, b long, need long, at_pivot boolean")
    return found.groupBy("a", "b", "at_pivot", "need").agg(F.count(F.lit(1)).alias("n")).where("n >= need").select("a", "b", "at_pivot")


def texts_near(named: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of named that may be wanted: their node's slot is a wanted one's."""
    slots = np.zeros(TEXT_SLOTS, bool)
    for r in wanted.select(F.pmod("node", F.lit(TEXT_SLOTS)).alias("slot")).distinct().toLocalIterator():
        slots[r["slot"]] = True
    shared = named.sparkSession.sparkContext.broadcast(np.packbits(slots))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            node = batch.column(batch.schema.get_field_index("node")).to_numpy(zero_copy_only=False)
            yield batch.filter(pa.array(held[np.mod(node, TEXT_SLOTS)]))

    return named.mapInArrow(rows, named.schema)


def texts_at_centres(named: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """centre, salt, own, node, text: the text of each pair's b (node) at its a (centre), sorted, the centre's own first.

    A centre's text comes once for CENTRE_PAIRS of its pairs; so a text that very many are compared
    with is no single task.
    """
    per = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")).withColumn("salts", F.ceil(F.col("n") / CENTRE_PAIRS).cast("int"))
    hot = per.where("salts > 1").select("a", "salts")
    members = pairs.join(hot, "a", "left").select(F.col("a").alias("centre"), F.pmod("b", F.coalesce("salts", F.lit(1))).cast("int").alias("salt"), F.lit(False).alias("own"), F.col("b").alias("node"))
    centres = per.select(F.col("a").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(True).alias("own"), F.col("a").alias("node"))
    members = centres.unionByName(members)
    wanted = nodes.join(members.select("node").distinct(), "node").select(F.col("node").alias("its_node"), "least")
    texts = texts_near(named, members).join(wanted, (F.col("node") == F.col("its_node")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("its_node", "text")
    at = members.join(texts, F.col("node") == F.col("its_node")).select("centre", "salt", "own", "node", "text")
    return at.repartition("centre", "salt").sortWithinPartitions("centre", "salt", F.desc("own"))


def beside_centre(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """centre, node and both shingle sets of rows of texts_at_centres."""
    last, its_set = None, np.empty(0, np.uint64)
    for batch in batches:
        for centre, salt, own, node, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if own:
                if (centre, salt) != last:
                    last, its_set = (centre, salt), shingle_set(text, size)
            else:
                yield centre, node, its_set, shingle_set(text, size)


def confirmed(named: DataFrame, nodes: DataFrame, pairs: DataFrame, size: int, least: float) -> DataFrame:
    """a, b: the pairs (a, b: nodes) whose texts have a similarity of least or more."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [(centre, node) for centre, node, x, y in beside_centre(batches, size) if similar(x, y, least)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], ["a", "b"])

    return texts_at_centres(named, nodes, pairs).mapInArrow(rows, "a long, b long").distinct()


def pivot_links(named: DataFrame, nodes: DataFrame, pairs: DataFrame, parts: DataFrame, size: int, least: float, most: int = GROUP_ROWS) -> DataFrame:
    """a, b: links of a similarity of least or more between different parts among the b of each a (a pivot), and with it.

    A text is its pivot's set less what it lost and with what it gained, so what two texts share is the pivot's size
    less what either lost, and what both gained. Groups beyond ``most`` are dealt out as pairs of blocks.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["pivot", "node", "size", "n", "lost", "gained"]
        out: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)

        for pivot, node, whole, own in beside_centre(batches, size):
            lost = np.flatnonzero(~np.isin(whole, own, assume_unique=True)).astype(np.int32)
            gained = own[~np.isin(own, whole, assume_unique=True)]
            out.append((pivot, node, len(whole), len(own), lost.tobytes(), gained.tobytes()))
            held += 4 * len(lost) + 8 * len(gained)
            if held > 4 << 20:
                yield batch()
                out, held = [], 0
        if out:
            yield batch()

    at = texts_at_centres(named, nodes, pairs).mapInArrow(told, "pivot long, node long, size int, n int, lost binary, gained binary")
    at = materialize(at.join(parts, F.col("node") == F.col("its_node"), "left").select("pivot", "node", "size", "n", "lost", "gained", F.coalesce("root", "node").alias("part")), "pivot-differences")
    own = at.groupBy("pivot").agg(F.max("size").alias("size"), F.count(F.lit(1)).alias("members"))
    none = F.lit(b"").cast("binary")
    own = own.join(parts, F.col("pivot") == F.col("its_node"), "left").select("pivot", F.col("pivot").alias("node"), "size", F.col("size").alias("n"), none.alias("lost"), none.alias("gained"), F.coalesce("root", "pivot").alias("part"), "members")
    blocks = own.where(F.col("members") > most).select(F.col("pivot").alias("hot"), F.ceil(F.col("members") / most).cast("int").alias("blocks"))
    every = at.unionByName(own.drop("members")).join(F.broadcast(blocks), F.col("pivot") == F.col("hot"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    every = every.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cell = (F.least("mine", "other") * F.col("blocks") + F.greatest("mine", "other")).cast("long")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pivot, group in runs_of_pivots(batches):
            edges = difference_links(*group, least)
            if len(edges):
                yield pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["a", "b"])

    dealt_out = every.select("pivot", cell.alias("cell"), "node", "part", "size", "n", "lost", "gained").repartition("pivot", "cell").sortWithinPartitions("pivot", "cell", "node")
    return dealt_out.mapInArrow(rows, "a long, b long").distinct()


def runs_of_pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, tuple]]:
    """(pivot, cell) and its rows' node, part, size, n, lost, gained."""
    last, held = None, []
    for batch in batches:
        for pivot, cell, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (pivot, cell) != last:
                yield last, tuple(zip(*held, strict=True))
                held = []
            last = pivot, cell
            held.append(row)
    if held:
        yield last, tuple(zip(*held, strict=True))


def difference_links(node: tuple, part: tuple, size: tuple, n: tuple, lost: tuple, gained: tuple, least: float) -> np.ndarray:
    """Star edges of the links between different parts of a pivot's members, from their differences to it."""
    node, part, n = np.array(node, np.int64), np.array(part, np.int64), np.array(n, np.int64)
    lost = [np.frombuffer(x, np.int32) for x in lost]
    gained = [np.frombuffer(x, np.uint64) for x in gained]
    rows = np.repeat(np.arange(len(node)), [len(x) for x in gained])
    known, column, times = np.unique(np.concatenate(gained), return_inverse=True, return_counts=True)
    again = times[column] > 1
    sizes = np.array([len(x) for x in lost], np.int64)
    row = np.concatenate([np.repeat(np.arange(len(node)), sizes), rows[again]])
    column = np.concatenate([np.concatenate(lost).astype(np.int64), size[0] + column[again]])
    used, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    parts, members = np.unique(part, return_counts=True)
    some = np.flatnonzero(part != parts[members.argmax()])  # members of the largest part needn't be compared with each other
    step = max(1, COMPARE_CELLS // max(1, len(node)))

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(some), step):
            x = some[at : at + step]
            same = np.zeros((len(x), len(node)), np.float32)
            for low in range(0, len(used), COLUMNS):
                a, b = np.searchsorted(column, (low, low + COLUMNS))
                has = np.zeros((len(node), min(COLUMNS, len(used) - low)), np.float32)
                has[row[a:b], column[a:b] - low] = 1
                same += has[x] @ has.T
            common = size[0] - sizes[x][:, None] - sizes[None, :] + same
            i, j = np.nonzero((common >= least * (n[x][:, None] + n[None, :] - common) - 1e-9) & (part[x][:, None] != part[None, :]))
            yield x[i], j

    return star_edges(node, least_linked(len(node), pairs()))


def missed_links(named: DataFrame, nodes: DataFrame, parts: DataFrame, size: int, least: float) -> DataFrame:
    """a, b: pairs of similar texts of different parts (node, root); with those of one part, all links.

    An exact prefix join: each text is listed at the first of its shingles in one order of all,
    and two texts at a common shingle whose sizes and common prefix allow it are compared. At a shingle that
    very many texts are listed at they are compared by their differences to one of them.
    """
    total = nodes.count()
    common = with_crowded(named, common_shingles(named, total, size), total, size, least)
    prefix = prefixes(named, common, size, least)
    held = materialize(held_by_several(prefix), "prefixes")
    parts = parts.select(F.col("node").alias("its_node"), "root")
    held = held.join(parts, F.col("node") == F.col("its_node"), "left").select("key", "node", "n", F.coalesce("root", "node").alias("part"))
    found = materialize(candidates(held, least), "candidates")
    pivoted = pivot_links(named, nodes, found.where("at_pivot").select("a", "b"), parts, size, least)
    return confirmed(named, nodes, found.where("NOT at_pivot").select("a", "b"), size, least).unionByName(pivoted)


def unique_names(docs: DataFrame, text_col: str) -> F.Column:
    """A 64-bit name of each row's text that no other text has.

    The hash of the text; should 128 bits of two texts with one hash differ, such hashes are
    replaced by salted ones, until none is left. Expected is one round.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    name, salt = F.xxhash64(text), 0
    while True:
        twice = docs.select(name.alias("name"), F.md5(text).alias("key")).groupBy("name").agg((F.min("key") != F.max("key")).alias("twice")).where("twice")
        clash = [r["name"] for r in twice.select("name").toLocalIterator()]
        if not clash:
            return name
        salt += 1
        name = F.when(name.isin(clash), F.xxhash64(F.lit(salt), F.md5(text))).otherwise(name)


def keep_one(docs: DataFrame, size: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, of each group of near duplicates only the one with the least id.

    Two texts are linked if their sets of size-word shingles have a Jaccard similarity of
    similarity or more; groups are what links connect. SimHash proposes pairs that are compared
    exactly, and an exact prefix join finds the links between what these connect. Defined results:
    equal texts are linked, texts without words too (null is empty); null ids come last; of repeated
    rows one stays; an empty table stays empty. Columns of any name are kept.
    """
    spark = docs.sparkSession
    name = unique_names(docs, text_col)
    named = docs.select(F.col(id_col).alias("doc_id"), name.alias("node"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    table = materialize(sketches(named, "text"), "sketches")
    nodes = table.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("a").alias("a"), F.min("b").alias("b"), F.count(F.lit(1)).alias("rows"))
    nodes = materialize(nodes, "distinct-texts")
    proposed = sketch_links(anchored_pairs(nodes), NEAR_BITS).groupBy(F.col("a").alias("member")).agg(F.min("b").alias("centre"))
    proposed = materialize(proposed.select(F.col("centre").alias("a"), F.col("member").alias("b")), "sketch-pairs")
    links = materialize(confirmed(named, nodes, proposed, size, similarity), "sketch-links")
    discard(proposed)
    parts = materialize(components(links), "sketch-groups")
    discard(links)
    with discarding(spark) as keep:
        missed = keep(materialize(missed_links(named, nodes, parts, size, similarity), "missed-links"))
    merged = materialize(components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(missed)), "merged-groups")
    firsts = merged.join(nodes.select("node", "least"), "node")
    best = firsts.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "node")).alias("best")).select(F.col("root").alias("its_root"), F.col("best.node").alias("first"))
    gone = firsts.join(best, F.col("root") == F.col("its_root")).where("node <> first").select("node").distinct()
    stay = nodes.join(gone, "node", "left_anti")
    # the rows that stay, by text and id, and how many rows are alike in both
    alike = table.groupBy("node", "doc_id").agg(F.count(F.lit(1)).alias("alike"))
    stay = alike.join(stay.select(F.col("node").alias("its_node"), "least"), (F.col("node") == F.col("its_node")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("node", "doc_id", "alike")
    keyed = docs.select(name.alias("own"), F.col(id_col).alias("own_id"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = keyed.join(stay, (F.col("own") == F.col("node")) & F.col("own_id").eqNullSafe(F.col("doc_id")))
    once = left.where("alike = 1").unionByName(left.where("alike > 1").dropDuplicates(["node", "doc_id"]))
    return once.select("row.*")
