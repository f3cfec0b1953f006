"""Toxic spans and document scores from a linear-chain conditional random field.

Labels are per document. Words and word beginnings that set labelled toxic documents apart from
clean ones (document frequencies on a bounded sample) give token labels: such a word in a toxic
document is tagged T, everything else O. A two-state linear-chain field with weights for words and
their beginnings is fitted to these by gradient ascent in numpy. Forward-backward marginals over
a whole text tell which words are toxic; a logistic fit turns the largest, the summed and the mean
marginal into the document's score.

Defined results: a null or wordless text scores like one whose marginals are all zero; a row with
a null id is in no fold; labels of one id that differ count as toxic; without a labelled toxic or
clean document the score is the share of toxic ones (0 if there is none); repeated rows are
reported each; an empty table gives no row. Scores come from the text alone.
"""

from __future__ import annotations

import math
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORDS, fold

#: Bounds of the sample that the model is fitted on: labelled rows of each class, and the longest text.
SAMPLE_PER_CLASS = 1500
SAMPLE_CHARS = 50_000
#: A word is labelled T if one of its features is in as many toxic documents, as precise, and told
#: apart by a likelihood ratio that exceeds chance among all features by the margin.
MIN_DOCS, MARGIN, MIN_PRECISION = 4, 2.0, 0.8
#: Features that the field has a weight for are in as many documents of the sample.
MIN_FEATURE_DOCS = 3
#: Lengths in bytes of the word beginnings that are features, beside the whole word.
STEMS = (4, 5, 6, 7, 8)
#: Word scores that an executor's process keeps; beyond, it begins anew.
KEPT_SCORES = 1_000_000
STEPS, RATE, DECAY = 80, 0.25, 0.05
#: Words a training sequence holds; a longer text is several.
TRAIN_WORDS = 64

TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(WORDS).split() if text else []


def features_of(word: bytes) -> list[bytes]:
    """The whole word and its beginnings."""
    return [b"=" + word, *(word[:n] for n in STEMS if len(word) >= n)]


@dataclass
class Field:
    """Weights of T against O: per feature, for any word, at the start, and of the transitions."""

    features: dict[bytes, float]
    bias: float = 0.0
    start: float = 0.0
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))  # moves[0, 0] is 0
    document: np.ndarray = field(default_factory=lambda: np.zeros(4))  # weights of summary()
    prior: float = 0.0
    scores: dict[bytes, float] = field(default_factory=dict)

    def score(self, word: bytes) -> float:
        found = self.bias + sum(self.features.get(f, 0.0) for f in features_of(word))
        if len(self.scores) >= KEPT_SCORES:
            self.scores.clear()
        self.scores[word] = found
        return found

    def emissions(self, words: list[bytes]) -> np.ndarray:
        kept = self.scores
        return np.array([kept[w] if w in kept else self.score(w) for w in words], np.float64)


def lanes(lengths: list[int], cells: int = 2_000_000) -> Iterator[list[int]]:
    """Groups of sequences to be run side by side, longest first."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    at = 0
    while at < len(order) and lengths[order[at]]:
        longest, end = lengths[order[at]], at
        while end < len(order) and (end - at + 1) * longest <= max(cells, longest) and lengths[order[end]] * 2 + 16 >= longest and lengths[order[end]]:
            end += 1
        yield order[at:end]
        at = end


def run_lanes(scores: list[np.ndarray], start: float, moves: np.ndarray) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """indices, active lanes per step, odds of T (step x lane), and expected moves of the group.

    States are kept as ratios T : O, so a step of the forward (backward) pass is one fraction.
    """
    m = np.exp(moves)
    for group in lanes([len(s) for s in scores]):
        size = np.array([len(scores[i]) for i in group])
        steps, width = int(size[0]), len(group)
        e = np.ones((steps, width))
        for k, i in enumerate(group):
            e[: size[k], k] = scores[i]
        np.exp(np.clip(e, -30, 30, out=e), out=e)
        active = np.searchsorted(-size, -np.arange(1, steps + 1), side="right")
        r = np.ones((steps, width))
        r[0] = math.exp(start) * e[0]
        for t in range(1, steps):
            n = active[t]
            p = r[t - 1, :n]
            r[t, :n] = e[t, :n] * (m[0, 1] + m[1, 1] * p) / (m[0, 0] + m[1, 0] * p)
        b = np.ones(width)
        expected = np.zeros((2, 2))
        odds = np.empty_like(r)
        odds[steps - 1] = r[steps - 1]
        for t in range(steps - 2, -1, -1):
            n = active[t + 1]
            x, p = e[t + 1, :n] * b[:n], r[t, :n]
            w01, w10, w11 = m[0, 1] * x, m[1, 0] * p, m[1, 1] * p * x
            z = m[0, 0] + w01 + w10 + w11
            expected += [[(m[0, 0] / z).sum(), (w01 / z).sum()], [(w10 / z).sum(), (w11 / z).sum()]]
            b[:n] = (m[1, 0] + m[1, 1] * x) / (m[0, 0] + m[0, 1] * x)
            odds[t] = r[t] * b
        yield group, active, odds, expected


def marginals(scores: list[np.ndarray], start: float, moves: np.ndarray) -> list[np.ndarray]:
    """Probability of T at each word of each sequence."""
    out = [np.empty(0)] * len(scores)
    for group, _, odds, _ in run_lanes(scores, start, moves):
        p = odds / (1 + odds)
        for k, i in enumerate(group):
            out[i] = p[: len(scores[i]), k]
    return out


def marked_features(in_toxic: np.ndarray, in_clean: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Which features' document frequencies set the toxic documents apart."""
    a, b = in_toxic.astype(float), in_clean.astype(float)
    total = max(n1 + n0, 1)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12)), 0.0)

    likelihood = 2 * (part(a, (a + b) * n1 / total) + part(b, (a + b) * n0 / total) + part(n1 - a, n1 - (a + b) * n1 / total) + part(n0 - b, n0 - (a + b) * n0 / total))
    sure = likelihood >= 2 * math.log(max(len(a), 1)) + MARGIN  # rarer by chance than one in all features
    return sure & (a >= MIN_DOCS) & (a * max(n0, 1) >= MIN_PRECISION * (a * max(n0, 1) + b * n1))


def fit_field(documents: list[list[bytes]], toxic: list[bool]) -> Field:
    """Token labels, the field's weights by Adam, and the document score by Newton's method."""
    number: dict[bytes, int] = {}
    texts = [np.fromiter((number.setdefault(w, len(number)) for w in d), np.int32, len(d)) for d in documents]
    every: dict[bytes, int] = {}
    at, flat = [0], []
    for w in number:
        flat += [every.setdefault(f, len(every)) for f in features_of(w)]
        at.append(len(flat))
    of_word, at = np.array(flat, np.int32), np.array(at)
    del flat
    counts = np.zeros((2, len(every)), np.int32)
    for d, t in zip(texts, toxic, strict=True):
        if len(d):
            counts[int(t), np.unique(np.concatenate([of_word[at[w] : at[w + 1]] for w in np.unique(d)]))] += 1
    marked = marked_features(counts[1], counts[0], sum(toxic), len(toxic) - sum(toxic))
    used = np.flatnonzero(counts.sum(axis=0) >= MIN_FEATURE_DOCS)
    place = np.full(len(every), -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    word_of = np.repeat(np.arange(len(number), dtype=np.int32), np.diff(at))
    is_marked = np.bincount(word_of, weights=marked[of_word], minlength=len(number)) > 0
    held = place[of_word] >= 0
    pairs = np.stack([word_of[held], place[of_word[held]]], axis=1).reshape(-1, 2)
    names = [f for f, i in every.items() if place[i] >= 0]  # in the order of their places
    del every, counts, of_word, word_of, held, place
    model = Field({}, prior=sum(toxic) / max(len(toxic), 1))
    ids, tags = [], []
    for d, t in zip(texts, toxic, strict=True):
        for i in range(0, len(d), TRAIN_WORDS):
            ids.append(d[i : i + TRAIN_WORDS])
            tags.append(is_marked[ids[-1]] & t)
    if not ids:
        return model
    n, m = len(number), len(names)
    truth_word = np.bincount(np.concatenate(ids), weights=np.concatenate(tags), minlength=n)
    truth_start = sum(float(t[0]) for t in tags)
    truth_moves = np.zeros((2, 2))
    for t in tags:
        np.add.at(truth_moves, (t[:-1].astype(int), t[1:].astype(int)), 1)
    theta = np.zeros(m + 5)  # features, bias, start, three moves
    theta[m] = -2.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, STEPS + 1):
        start, moves = theta[m + 1], np.array([[0, theta[m + 2]], [theta[m + 3], theta[m + 4]]])
        of_words = theta[m] + np.bincount(pairs[:, 0], weights=theta[pairs[:, 1]], minlength=n)
        got, got_start, got_moves = np.zeros(n), 0.0, np.zeros((2, 2))
        for group, _, odds, expected in run_lanes([of_words[i] for i in ids], start, moves):
            p = odds / (1 + odds)
            got_moves += expected
            got_start += p[0].sum()
            got += np.bincount(np.concatenate([ids[i] for i in group]), weights=np.concatenate([p[: len(ids[i]), k] for k, i in enumerate(group)]), minlength=n)
        gap = truth_word - got
        of_features = np.bincount(pairs[:, 1], weights=gap[pairs[:, 0]], minlength=m) - DECAY * theta[:m]
        grad = np.concatenate([of_features, [gap.sum(), truth_start - got_start, *(truth_moves - got_moves).ravel()[1:]]])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        theta = theta + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    model.features = {f: float(theta[i]) for i, f in enumerate(names)}
    model.bias, model.start = float(theta[m]), float(theta[m + 1])
    model.moves = np.array([[0, theta[m + 2]], [theta[m + 3], theta[m + 4]]])
    if 0 < sum(toxic) < len(toxic):
        p = marginals([model.emissions(d) for d in documents], model.start, model.moves)
        model.document = logistic(np.array([summary(v) for v in p]), np.array(toxic, float))
    model.scores = {}
    return model


def summary(p: np.ndarray) -> tuple[float, float, float, float]:
    """1, the largest marginal's logit within +-10 over 10, log(1 + expected toxic words), their share."""
    if not len(p):
        return 1.0, -1.0, 0.0, 0.0
    top = min(max(float(p.max()), 1e-9), 1 - 1e-9)
    total = float(p.sum())
    return 1.0, max(-10.0, min(10.0, math.log(top / (1 - top)))) / 10, math.log1p(total), math.sqrt(total / (len(p) + 20))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + ridge * w
        w -= np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + ridge * np.eye(len(w)), grad)
    return w


def train(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5, per_class: int = SAMPLE_PER_CLASS, max_chars: int = SAMPLE_CHARS) -> Field:
    """Field from labelled rows outside the held-out fold.

    The sample: of each class the per_class documents with the least hashes of their ids, without
    texts of over max_chars characters.
    """
    marked = labels.where(F.col("toxic").isNotNull() & (fold("doc_id", folds) != held_out)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    classes = [marked.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in ("toxic > 0", "toxic = 0")]
    chosen = classes[0].unionByName(classes[1])
    texts = docs.select(F.col("doc_id"), F.col("text")).where(F.col("text").isNotNull() & (F.length("text") <= max_chars))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit_sample(held))], pa.binary())], ["field"])

    # one worker fits the sample: the driver would keep the memory that this takes
    found = rows.select(F.col("doc_id").cast("string"), "toxic", "text").repartition(1).mapInArrow(fitted, "field binary").collect()
    return pickle.loads(found[0]["field"]) if found else fit_field([], [])


def fit_sample(rows: list[tuple[str, int, str]]) -> Field:
    """Field from (id, toxic, text) of the sample."""
    documents, toxic, seen = [], [], set()
    for _, label, text in sorted(rows, key=lambda r: r[0]):  # copies and near copies count once
        words = words_of(text)
        least = sorted(xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4)))[:8]
        if sum(h in seen for h in least) * 3 < len(least):
            documents.append(words)
            toxic.append(label > 0)
        seen.update(least)
    return fit_field(documents, toxic)


def score_texts(texts: list[str | None], field: Field) -> tuple[list[float], list[np.ndarray]]:
    """Score and marginals of each text."""
    p = marginals([field.emissions(words_of(t)) for t in texts], field.start, field.moves)
    if not field.document.any():
        return [field.prior if field.prior in (0.0, 1.0) else 0.0 for _ in texts], p
    x = np.array([summary(v) for v in p]) @ field.document if texts else np.empty(0)
    return (1 / (1 + np.exp(-np.clip(x, -30, 30)))).tolist(), p


def offending(text: str, p: np.ndarray) -> list[tuple[int, int]]:
    """Code point spans of the words more likely T than O; neighbours as one."""
    data = text.encode("utf-8", "surrogatepass")
    spans: list[list[int]] = []
    last = -2
    for k, m in enumerate(TOKEN.finditer(data)):
        if p[k] >= 0.5:
            if last == k - 1:
                spans[-1][1] = m.end()
            else:
                spans.append([m.start(), m.end()])
            last = k
    points = lambda at: len(data[:at].decode("utf-8", "surrogatepass"))
    return [(points(a), points(b)) for a, b in spans]


def score_documents(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", part: int = 2000) -> DataFrame:
    """doc_id, score, n_toxic, offsets (array of start, end in code points) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema[id_col].dataType.simpleString()
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, part):
                some = batch.slice(at, part)
                texts = some.column(1).to_pylist()
                scores, p = score_texts(texts, shared.value)
                found = [offending(t, v) if len(v) and v.max() >= 0.5 else [] for t, v in zip(texts, p, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(scores, pa.float64()), pa.array([len(f) for f in found], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in f] for f in found], pa.list_(span))], ["doc_id", "score", "n_toxic", "offsets"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(rows, f"doc_id {kind}, score double, n_toxic long, offsets array<struct<start:int,end:int>>")


def keep_clean(docs: DataFrame, field: Field, threshold: float = 0.5, text_col: str = "text", part: int = 2000) -> DataFrame:
    """The rows of docs that score below the threshold, with all of their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    place = docs.columns.index(text_col)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, part):
                some = batch.slice(at, part)
                scores, _ = score_texts(some.column(place).to_pylist(), shared.value)
                yield some.filter(pa.array([s < threshold for s in scores], pa.bool_()))

    return docs.mapInArrow(rows, docs.schema)


def digest(docs: DataFrame, field: Field, held_out: int = 0, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted, n_toxic, offsets (start:end, comma-joined)."""
    joined = F.array_join(F.transform("offsets", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return score_documents(docs, field).select(
        "doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", joined.alias("offsets"),
    )
