"""Inverted-file index over vectors: coarse cells, residual product codes, exact re-rank.

Cells and code books are fitted by k-means on a bounded sample (SAMPLE rows, those of the least hashes of their
ids); every row is then put into its nearest cell with a code of PARTS bytes for what is left of it. A search ranks the rows
of the cells nearest to a query by their codes alone, and the CANDIDATES best of all its cells by the vectors
themselves. How many cells a search looks at is measured when the index is fitted: the least number that holds
TARGET of the true neighbours of held-out vectors of the sample.

Cells are the shuffle key. A cell of many rows is split into slots, to each of which its queries go, and one of many
queries into blocks, to each of which its rows go, so a task holds at most QUERY_BLOCK queries and a batch of codes. Pairs
that are scored are queries x probed cells x rows of a cell, not queries x rows; selection.vector_top_k is the exact path.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V

#: Rows that cells and codes are fitted on, and those of them that the number of probed cells is measured with.
SAMPLE, HELD_OUT = 20_000, 500
MAX_CELLS, PARTS, CODES = 1024, 16, 256
ROUNDS, SEED = 10, 7
TARGET = 0.97
CANDIDATES = 100
SLOT_ROWS, QUERY_BLOCK = 200_000, 4096


@dataclass(frozen=True)
class Model:
    """centres: cells x dims; books: parts x codes x dims of a part; probes: cells that a search looks at."""

    centres: np.ndarray
    books: np.ndarray
    probes: int

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distances to the cells' centres, less |x|^2."""
        return (self.centres**2).sum(axis=1) - 2 * (x @ self.centres.T)

    def parts(self, x: np.ndarray) -> np.ndarray:
        """x by parts, padded with zeros to a whole number of dimensions in each."""
        m, _, width = self.books.shape
        return np.pad(x, ((0, 0), (0, m * width - x.shape[1]))).reshape(len(x), m, width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(cell, code) of unit vectors."""
        cell = self.distances(x).argmin(axis=1)
        rest = self.parts(x - self.centres[cell])
        code = np.empty(rest.shape[:2], np.uint8)
        for m, book in enumerate(self.books):
            code[:, m] = ((book**2).sum(axis=1) - 2 * (rest[:, m] @ book.T)).argmin(axis=1)
        return cell, code

    def decode(self, cell: np.ndarray, code: np.ndarray) -> np.ndarray:
        rest = np.concatenate([book[code[:, m]] for m, book in enumerate(self.books)], axis=1)
        return self.centres[cell] + rest[:, : self.dims]


def kmeans(x: np.ndarray, k: int, random: np.random.Generator) -> np.ndarray:
    """k centres; one that is left without points moves to a point far from its own."""
    centres = x[random.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        d = (centres**2).sum(axis=1) - 2 * (x @ centres.T)
        own = d.argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=k)
        far = np.argsort(-d[np.arange(len(x)), own] - (x**2).sum(axis=1), kind="stable")
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        centres[empty] = x[far[: len(empty)]]
    return centres


def unit(vector: Column, dims: int) -> Column:
    return V.normalised(vector, dims)


def sampled(vectors: DataFrame, vector: str, row_id: str, dims: int) -> np.ndarray:
    """Unit vectors of the SAMPLE valid rows whose ids have the least hashes."""
    valid = vectors.where(V.is_valid(F.col(vector), dims))
    least = valid.select(row_id, F.xxhash64(F.col(row_id).cast("string")).alias("__h"), unit(F.col(vector), dims).alias("v")).orderBy("__h", row_id).limit(SAMPLE)
    return np.array([r.v for r in least.select("v").toLocalIterator()], np.float64).reshape(-1, dims)


def fit(vectors: DataFrame, vector: str = "embedding", row_id: str = "vec_id", dims: int = 64, k: int = 10, target: float = TARGET) -> Model:
    """Cells, code books and probes from the sample. The number of cells is about the root of the number of rows."""
    x = sampled(vectors, vector, row_id, dims)
    if not len(x):
        return Model(np.zeros((1, dims)), np.zeros((PARTS, 1, -(-dims // PARTS))), 1)
    random = np.random.default_rng(SEED)
    cells = max(1, min(MAX_CELLS, int(vectors.count() ** 0.5), len(x) // 16))
    model = Model(kmeans(x, cells, random), np.zeros((PARTS, 1, -(-dims // PARTS))), 1)
    own = model.distances(x).argmin(axis=1)
    rest = model.parts(x - model.centres[own])
    books = np.array([kmeans(np.ascontiguousarray(rest[:, m]), min(CODES, len(x)), random) for m in range(PARTS)])
    model = Model(model.centres, books, cells)
    return Model(model.centres, books, probes_for(model, x, own, k, target))


def probes_for(model: Model, x: np.ndarray, own: np.ndarray, k: int, target: float) -> int:
    """The least number of cells nearest to a vector that hold target of its k neighbours, over held-out vectors of x."""
    asked = np.arange(min(HELD_OUT, len(x)))
    cosine = x[asked] @ x.T
    cosine[asked, asked] = -2.0
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(model.distances(x[asked]), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel()) + 1
    return int(needed[max(0, int(np.ceil(target * len(needed))) - 1)])


def encoded(vectors: DataFrame, model: Model, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """row_id, cell, code, vector of every valid row: the index. Written in order of cells, a search for a few reads their row groups only."""
    dims = model.dims

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            cell, code = model.encode(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary()), batch.column(1)], [row_id, "cell", "code", vector])

    valid = vectors.where(V.is_valid(F.col(vector), dims)).select(row_id, vector, unit(F.col(vector), dims).alias("__unit"))
    kind = lambda c: vectors.schema[c].dataType.simpleString()
    return valid.mapInArrow(rows, f"`{row_id}` {kind(row_id)}, cell int, code binary, `{vector}` {kind(vector)}")


def probed(queries: DataFrame, model: Model, vector: str, row_id: str, probes: int) -> DataFrame:
    """query, v, cell: a row for each cell that a query looks at."""
    dims = model.dims

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            cells = np.argsort(model.distances(x), axis=1, kind="stable")[:, :probes]
            at = np.repeat(np.arange(len(x)), cells.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(cells.ravel(), pa.int32())], ["query", "v", "cell"])

    valid = queries.where(V.is_valid(F.col(vector), dims)).select(F.col(row_id).alias("query"), unit(F.col(vector), dims).alias("v"))
    return valid.mapInArrow(rows, f"query {queries.schema[row_id].dataType.simpleString()}, v array<double>, cell int")


def shares(rows: DataFrame, most: int) -> dict[int, int]:
    """Into how many shares a cell's rows go (cells of more than one): a number for each of at most MAX_CELLS cells."""
    return {r.cell: -(-r["count"] // most) for r in rows.groupBy("cell").count().where(F.col("count") > most).collect()}


def share_of(cell: Column, of: dict[int, int]) -> Column:
    if not of:
        return F.lit(1)
    return F.coalesce(F.create_map(*[F.lit(x) for pair in of.items() for x in pair])[cell], F.lit(1))


def best_by_codes(model: Model, most: int) -> callable:
    """For mapInArrow over sorted (cell, slot, block, kind) groups: of each query of a group, the rows whose codes are nearest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, asked, vectors, best, kinds = None, [], [], None, ()
        queries = np.empty((0, model.dims))

        def told() -> Iterator[pa.RecordBatch]:
            if best is not None and len(best):
                queried = [asked[i] for i in best["at"]]
                yield pa.RecordBatch.from_arrays([pa.array(queried, kinds[0]), pa.array(best["id"].tolist(), kinds[1]), pa.array(best["cell"].to_numpy(np.int32)), pa.array(best["score"].to_numpy(np.float64))], ["query", "id", "cell", "score"])

        for batch in batches:
            kinds = batch.schema.field(4).type, batch.schema.field(6).type
            keys = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(keys)], strict=True):
                if b == a:
                    continue
                if group != tuple(keys[a]):
                    yield from told()
                    group, asked, vectors, best = tuple(keys[a]), [], [], None
                part = batch.slice(a, b - a)
                ask = part.filter(pa.compute.equal(part.column(3), 0))
                asked += ask.column(4).to_pylist()
                vectors += ask.column(5).to_pylist()
                held = part.filter(pa.compute.equal(part.column(3), 1))
                if not len(held) or not asked:
                    continue
                queries = np.array(vectors, np.float64) if len(vectors) != len(queries) or best is None else queries
                code = np.frombuffer(b"".join(held.column(7).to_pylist()), np.uint8).reshape(len(held), -1)
                score = np.round(queries @ model.decode(np.full(len(held), group[0]), code).T, 6)
                own, mine = np.array(held.column(6).to_pylist()), np.array(asked)
                score[mine[:, None] == own[None, :]] = -9.0
                bar = np.partition(score, -most, axis=1)[:, -most, None] if score.shape[1] > most else -8.0
                at, col = np.nonzero((score >= bar) & (score > -8.0))
                found = pd.DataFrame({"at": at, "id": own[col], "cell": np.int32(group[0]), "score": score[at, col]})
                best = found if best is None else pd.concat([best, found], ignore_index=True)
                best = best.iloc[np.lexsort((best["id"], -best["score"], best["at"]))].groupby("at", sort=False).head(most)
        yield from told()

    return rows


def search(index: DataFrame, model: Model, queries: DataFrame, k: int = 10, candidates: int = CANDIDATES, probes: int | None = None, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """centre, row_id, cosine, rank: about the k nearest of each query among the index's rows, itself excluded; ties by row_id.

    index is read three times (sizes of cells, codes, vectors of candidates): a written table.
    """
    kind = index.schema[row_id].dataType.simpleString()
    asked = probed(queries, model, vector, row_id, probes or model.probes)
    slots, blocks = shares(index.select("cell"), SLOT_ROWS), shares(asked.select("cell"), QUERY_BLOCK)
    every = lambda of: F.explode(F.sequence(F.lit(0), share_of(F.col("cell"), of) - 1))
    one = lambda column, of: F.pmod(F.xxhash64(F.col(column).cast("string")), share_of(F.col("cell"), of)).cast("int")
    none = lambda t: F.lit(None).cast(t)
    ask = asked.select("cell", every(slots).alias("slot"), one("query", blocks).alias("block"), F.lit(0).alias("kind"), "query", "v", none(kind).alias("id"), none("binary").alias("code"))
    held = index.select("cell", one(row_id, slots).alias("slot"), every(blocks).alias("block"), F.lit(1).alias("kind"), none(kind).alias("query"), none("array<double>").alias("v"), F.col(row_id).alias("id"), "code")
    dealt = ask.unionByName(held).repartition("cell", "slot", "block").sortWithinPartitions("cell", "slot", "block", "kind")
    near = dealt.mapInArrow(best_by_codes(model, candidates), f"query {kind}, id {kind}, cell int, score double")
    first = Window.partitionBy("query").orderBy(F.col("score").desc(), "id")
    near = near.withColumn("n", F.row_number().over(first)).where(F.col("n") <= candidates).select("query", F.col("id").alias(row_id), "cell")
    known = queries.select(F.col(row_id).alias("query"), F.col(vector).alias("__asked"))
    exact = near.join(index.select(row_id, "cell", vector), [row_id, "cell"]).join(known, "query")
    scored = exact.select(F.col("query").alias("centre"), row_id, V.cosine(F.col("__asked"), F.col(vector)).alias("cosine"))
    w = Window.partitionBy("centre").orderBy(F.round("cosine", 12).desc(), row_id)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pairs_scored(index: DataFrame, model: Model, queries: DataFrame, probes: int | None = None, vector: str = "embedding", row_id: str = "vec_id") -> DataFrame:
    """One row: pairs of query and row whose codes a search compares, and all pairs there are."""
    asked = probed(queries, model, vector, row_id, probes or model.probes).groupBy("cell").agg(F.count(F.lit(1)).alias("q"))
    rows = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    n = queries.where(V.is_valid(F.col(vector), model.dims)).count()
    return rows.join(asked, "cell", "left").agg(F.sum(F.col("n") * F.coalesce("q", F.lit(0))).alias("scored"), (F.sum("n") * n).alias("pairs"))
