"""Words of titles: nouns, compounds and what follows them, by a lattice whose costs the collection teaches.

A run of Hangul may be cut into stems and, after them, particles or endings. Stems are prefixes of runs that are frequent and go
on in different ways (they branch); their costs are those of a unigram model, re-estimated by counting the pieces of every distinct
run's cheapest path, and a stem stays as long as it saves more than it takes to write down. All runs of the collection are counted; a model holds MOST_PIECES pieces at most, the most frequent ones,
and is what tasks are sent. A word is cut once for each distinct run.

A word's class is CONTENT (stems alone), TERM (stems and what ends them) or STOP (no stem).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L

#: Characters of a stem, pieces of a model, rounds of re-estimation.
MAX_PIECE, MOST_PIECES, ROUNDS = 8, 200_000, 4
#: Cost of a stretch that no piece covers, and of each of its characters.
UNKNOWN, UNKNOWN_CHAR = 14.0, 2.0
#: What a character of a model's piece costs, in the units of its costs (natural logarithms).
CHAR_COST = 7.0
# Fixed values. Characters of a compound that is a label of its own.
COMPOUND = (5, 14)
RUN = re.compile("[가-힣]+")


class Word(NamedTuple):
    """stem: the part before particles; pieces of it; class."""

    stem: str
    pieces: tuple[str, ...]
    kind: str


@dataclass
class Model:
    """Costs of stems and of particles and endings."""

    stems: dict[str, float]
    tails: dict[str, float]
    trie: dict = field(default_factory=dict, repr=False)
    words: dict[str, Word] = field(default_factory=dict, repr=False)

    def __post_init__(self) -> None:
        for tail, costs in ((False, self.stems), (True, self.tails)):
            for piece, cost in costs.items():
                node = self.trie.setdefault(tail, {})
                for c in piece:
                    node = node.setdefault(c, {})
                node[""] = cost

    def __getstate__(self) -> tuple:
        return self.stems, self.tails

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def from_(self, run: str, at: int, tail: bool) -> Iterator[tuple[int, float]]:
        """(end, cost) of the pieces that begin there."""
        node = self.trie.get(tail, {})
        for end in range(at, len(run)):
            node = node.get(run[end])
            if node is None:
                return
            if "" in node:
                yield end + 1, node[""]

    def path(self, run: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """(stems, tails) of the cheapest path; ties by fewer pieces, then by the pieces."""
        return self.cheapest(run)[2:]

    def cheapest(self, run: str, whole: bool = True) -> tuple[float, int, tuple[str, ...], tuple[str, ...]]:
        """Cost, pieces, stems, tails; whole: whether one stem may be all of the run."""
        best: dict[tuple[int, bool], tuple] = {(0, False): (0.0, 0, (), ())}

        def offer(place: tuple[int, bool], value: tuple) -> None:
            if place not in best or value < best[place]:
                best[place] = value

        for at in range(len(run)):
            if (at, False) in best:
                cost, n, stems, tails = best[at, False]
                for end, more in self.from_(run, at, False):
                    if end - at < len(run) or whole:
                        offer((end, False), (round(cost + more, 9), n + 1, (*stems, run[at:end]), tails))
                for end in range(at + 1, len(run) + 1):
                    offer((end, False), (round(cost + UNKNOWN + UNKNOWN_CHAR * (end - at), 9), n + 1, (*stems, run[at:end]), tails))
            for phase in (False, True):
                if at and (at, phase) in best:
                    cost, n, stems, tails = best[at, phase]
                    for end, more in self.from_(run, at, True):
                        offer((end, True), (round(cost + more, 9), n + 1, stems, (*tails, run[at:end])))
        return min(best[k] for k in ((len(run), False), (len(run), True)) if k in best)

    def word(self, text: str) -> Word:
        """A word of a title: its Hangul run cut, the rest as it is; one of a predicate is STOP."""
        if text not in self.words:
            run = RUN.search(text)
            if run is None:
                made = Word(text, (text,), "CONTENT" if re.search("[a-zA-Z0-9]", text) else "STOP")
            elif re.search(L.PREDICATE, text):
                made = Word("", (), "STOP")
            else:
                stems, tails = self.path(run[0])
                made = Word(text[: run.start()] + "".join(stems), ((text[: run.start()],) if run.start() else ()) + stems, "TERM" if tails or run.end() < len(text) else "CONTENT")
            self.words[text] = made
        return self.words[text]

    def compound(self, word: Word) -> bool:
        """Whether a word is a label of its own: two stems or more that the model knows, within COMPOUND characters."""
        return len(word.pieces) > 1 and COMPOUND[0] <= len(word.stem) <= COMPOUND[1] and all(p in self.stems for p in word.pieces)


def runs(titles: DataFrame, text: Column) -> DataFrame:
    """run, n: how often each run of Hangul occurs."""
    return titles.select(F.explode(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(RUN.pattern), F.lit(0))).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))


def stems(counted: DataFrame, least: int) -> DataFrame:
    """piece, n: prefixes of two characters or more that occur ``least`` times and are followed by two different characters or ends."""
    ends = F.sequence(F.lit(2), F.least(F.length("run"), F.lit(MAX_PIECE)))
    each = counted.where(F.length("run") >= 2).select("run", "n", F.explode(ends).alias("k"))
    next_ = F.when(F.col("k") < F.length("run"), F.substring(F.col("run"), F.col("k") + 1, F.lit(1))).otherwise(F.lit(""))
    per = each.groupBy(F.substring(F.col("run"), F.lit(1), F.col("k")).alias("piece"), next_.alias("next")).agg(F.sum("n").alias("n"))
    return per.groupBy("piece").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("branches")).where((F.col("n") >= least) & (F.col("branches") > 1)).select("piece", "n")


def costs(counts: dict[str, int]) -> dict[str, float]:
    total = sum(counts.values()) or 1
    return {p: -math.log(n / total) for p, n in counts.items() if n > 0}


def worth_keeping(counts: dict[str, int], model: Model) -> dict[str, int]:
    """Stems that save more, over all their occurrences, than it takes to write them down: a compound whose parts do as well goes."""
    saved = lambda p, n: n * (model.cheapest(p, whole=False)[0] - model.stems[p])
    return {p: n for p, n in counts.items() if saved(p, n) >= CHAR_COST * len(p)}


def pieces_used(counted: DataFrame, model: Model) -> DataFrame:
    """piece, tail, n: how often each piece is on the cheapest paths of all runs."""
    sent = counted.sparkSession.sparkContext.broadcast((model.stems, model.tails))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Model(*sent.value)
        for batch in batches:
            used: Counter = Counter()
            for run, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                stems, tails = known.path(run)
                for p in stems:
                    used[p, False] += n
                for p in tails:
                    used[p, True] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in used], pa.string()), pa.array([k[1] for k in used], pa.bool_()), pa.array(used.values(), pa.int64())], ["piece", "tail", "n"])

    return counted.select("run", "n").mapInArrow(rows, "piece string, tail boolean, n long").groupBy("piece", "tail").agg(F.sum("n").alias("n"))


def learn(titles: DataFrame, text: Column, least: int = 3, rounds: int = ROUNDS, most: int = MOST_PIECES, tails: tuple[str, ...] = (*L.PARTICLES, *L.ENDINGS)) -> Model:
    """A model of a collection's titles. least: occurrences of a stem."""
    counted = runs(titles, text).persist()
    try:
        first = {r.piece: r.n for r in stems(counted, least).orderBy(F.col("n").desc(), "piece").limit(most).collect()}
        model = Model(costs(first), {t: math.log(len(tails)) for t in tails})
        for _ in range(rounds):
            used = pieces_used(counted, model).where(F.col("n") >= F.when(F.col("tail"), 1).otherwise(least)).orderBy(F.col("n").desc(), "piece").limit(most + len(tails)).collect()
            kept = {r.piece: r.n for r in used if not r.tail and r.piece in model.stems}
            ends = {t: 1 for t in tails} | {r.piece: r.n + 1 for r in used if r.tail}
            model = Model(costs(worth_keeping(kept, model)), costs(ends))
        return model
    finally:
        counted.unpersist()


def words_of(text: Column, model: Model) -> Column:
    """array<struct<stem, pieces, kind, compound>> of a title's words between blanks."""
    def run(titles: pd.Series) -> pd.Series:
        each = ([model.word(w) for w in (t or "").split()] for t in titles)
        return pd.Series([[{"stem": w.stem, "pieces": list(w.pieces), "kind": w.kind, "compound": model.compound(w)} for w in some] for some in each])

    return F.pandas_udf(run, "array<struct<stem:string,pieces:array<string>,kind:string,compound:boolean>>")(text)
