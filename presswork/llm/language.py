"""Language of a text from a bidirectional gated recurrent network over its bytes.

The network reads the whole text as one sequence of UTF-8 bytes (A-Z lower-cased, nothing left
out) in both directions and gives every byte a distribution over the languages; a document's is
the mean over the bytes of its letters. So that long texts are read side by side, a sequence is
read in windows of WINDOW bytes at fixed places; the state runs over CONTEXT further bytes before a
window (after it, backwards) and is empty before that, and a text's ends are padded by blanks.
Training is backpropagation through time in numpy, on windows of a bounded sample of labelled
documents.

Defined results: a text that is null or has no letter is ``und`` with score 0, as is every text
if nothing can be learned; a row with a null id is in no fold; repeated rows are reported each; an
empty table gives no row. Predictions come from the text alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, fold

#: Bounds of the training sample: documents per language, their longest text, windows per language.
SAMPLE_PER_LANGUAGE = 300
SAMPLE_CHARS = 20_000
SAMPLE_WINDOWS = 1500
#: Width of the state in either direction, and of training: bytes of a window, windows of a batch.
STATE = 12
TRAIN_BYTES, BATCH, EPOCHS, RATE = 48, 64, 12, 0.01
#: Bytes of a window, bytes that its state runs over before it counts, and windows read at once.
WINDOW, CONTEXT, LANES = 256, 32, 1024

#: Whether a byte is part of a letter: a-z and all of what isn't ASCII.
LETTERS = np.array([97 <= c <= 122 or c > 127 for c in range(256)], np.float32)


def sequence(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(LOWER)


def windows_of(data: bytes, size: int = WINDOW, context: int = CONTEXT) -> np.ndarray:
    """The windows of a sequence with their contexts, padded by blanks; one row each."""
    n = -(-len(data) // size)
    padded = np.full(n * size + 2 * context, 32, np.uint8)
    padded[context : context + len(data)] = np.frombuffer(data, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, size + 2 * context), (size, 1)) if n else np.empty((0, size + 2 * context), np.uint8)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


@dataclass
class Network:
    """Per direction: input rows of the 256 bytes, recurrent matrix, bias of the candidate's recurrent
    part; then the output layer over both states."""

    languages: list[str]
    weights: dict[str, np.ndarray]
    turned: dict[str, tuple] = field(default_factory=dict)

    @classmethod
    def fresh(cls, languages: list[str], seed: int = 0, state: int = STATE) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        w = {}
        for d in "fb":
            w |= {f"{d}x": draw(256, 3 * state), f"{d}h": draw(state, 3 * state), f"{d}c": np.zeros(state, np.float32)}
        return cls(languages, w | {"o": draw(2 * state, len(languages)), "ob": np.zeros(len(languages), np.float32)})

    def states(self, data: np.ndarray, d: str, trace: list | None = None) -> np.ndarray:
        """State after each byte (window, step, unit), reading forwards (f) or backwards (b)."""
        x, u, c = self.weights[f"{d}x"], self.weights[f"{d}h"], self.weights[f"{d}c"]
        n, steps, s = len(data), data.shape[1], len(c)
        h, out = np.zeros((n, s), np.float32), np.empty((n, steps, s), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, b = x[data[:, t]], h @ u
            gates = sigmoid(a[:, : 2 * s] + b[:, : 2 * s])
            z, r = gates[:, :s], gates[:, s:]
            inner = b[:, 2 * s :] + c
            new = np.tanh(a[:, 2 * s :] + r * inner)
            if trace is not None:
                trace.append((t, h, z, r, inner, new))
            h = new + z * (h - new)
            out[:, t] = h
        return out

    def positions(self, data: np.ndarray) -> np.ndarray:
        """Distribution over the languages at each byte of equally long sequences."""
        both = np.concatenate([self.states(data, "f"), self.states(data, "b")], axis=2)
        return softmax(both @ self.weights["o"] + self.weights["ob"])

    def gradients(self, data: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross entropy over the bytes of letters and its gradient, through time."""
        traces: dict[str, list] = {"f": [], "b": []}
        both = np.concatenate([self.states(data, d, traces[d]) for d in "fb"], axis=2)
        p = softmax(both @ self.weights["o"] + self.weights["ob"])
        n, steps = data.shape
        weight = LETTERS[data] / max(float(LETTERS[data].sum()), 1.0)
        loss = -float((np.log(p[np.arange(n), :, label] + 1e-9) * weight).sum())
        p[np.arange(n), :, label] -= 1
        p *= weight[:, :, None]
        s = len(self.weights["fc"])
        grads = {"o": np.einsum("nts,ntl->sl", both, p), "ob": p.sum(axis=(0, 1))}
        back = p @ self.weights["o"].T
        for k, d in enumerate("fb"):
            u = self.weights[f"{d}h"]
            gx, gu, gc = np.zeros_like(self.weights[f"{d}x"]), np.zeros_like(u), np.zeros(s, np.float32)
            carry = np.zeros((n, s), np.float32)
            for t, h, z, r, inner, new in reversed(traces[d]):
                dh = carry + back[:, t, k * s : k * s + s]
                dnew = dh * (1 - z) * (1 - new * new)
                dz = dh * (h - new) * z * (1 - z)
                dr = dnew * inner * r * (1 - r)
                dinner = dnew * r
                db = np.concatenate([dz, dr, dinner], axis=1)
                gu += h.T @ db
                gc += dinner.sum(axis=0)
                np.add.at(gx, data[:, t], np.concatenate([dz, dr, dnew], axis=1))
                carry = dh * z + db @ u.T
            grads |= {f"{d}x": gx, f"{d}h": gu, f"{d}c": gc}
        return loss, grads

    def reader(self, d: str) -> tuple:
        """Weights of a direction with units as rows, the gates' halved: a gate is 0.5 * tanh(0.5 * x) + 0.5."""
        if d not in self.turned:
            x, u, c = (self.weights[f"{d}{k}"].astype(np.float32) for k in "xhc")
            half = np.where(np.arange(x.shape[1]) < 2 * len(c), np.float32(0.5), np.float32(1.0))
            self.turned[d] = np.ascontiguousarray((x * half).T), np.ascontiguousarray((u * half).T), c[:, None].copy()
        return self.turned[d]

    def read(self, data: np.ndarray, d: str) -> Iterator[tuple[int, np.ndarray]]:
        """Step and state (unit, window) after each byte, in the direction's order. The state is reused."""
        x, u, c = self.reader(d)
        s, (n, steps) = len(c), data.shape
        at = np.ascontiguousarray(data.T).astype(np.intp)
        h, a, b = np.zeros((s, n), np.float32), np.empty((3 * s, n), np.float32), np.empty((3 * s, n), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            np.take(x, at[t], axis=1, out=a, mode="clip")
            np.matmul(u, h, out=b)
            gates, new = a[: 2 * s], b[2 * s :]
            gates += b[: 2 * s]
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            new += c
            new *= gates[s:]
            new += a[2 * s :]
            np.tanh(new, out=new)
            h -= new
            h *= gates[:s]
            h += new
            yield t, h

    def labelled(self, data: np.ndarray, context: int = CONTEXT) -> Iterator[tuple[int, np.ndarray]]:
        """Step and distributions (language, window) at each byte of windows, from their last one on."""
        n, steps = data.shape
        ahead = np.empty((steps - 2 * context, len(self.weights["fc"]), n), np.float32)
        for t, h in self.read(data[:, : steps - context], "f"):
            if t >= context:
                ahead[t - context] = h
        o, bias = np.ascontiguousarray(self.weights["o"].T), self.weights["ob"][:, None]
        s = len(self.weights["fc"])
        for t, h in self.read(data[:, context:], "b"):
            if t < steps - 2 * context:
                p = o[:, :s] @ ahead[t]
                p += o[:, s:] @ h
                p += bias
                p -= p.max(axis=0)
                np.exp(p, out=p)
                p /= p.sum(axis=0)
                yield t, p

    def documents(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and probability of each text."""
        names, scores = ["und"] * len(texts), [0.0] * len(texts)
        which = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        totals = np.zeros((len(texts), len(self.languages)))
        held: list[np.ndarray] = []
        owner: list[int] = []

        def flush() -> None:
            every, whose = np.concatenate(held), np.array(owner)
            for a in range(0, len(every), LANES):
                data = np.ascontiguousarray(every[a : a + LANES])
                letters = np.ascontiguousarray(LETTERS[data[:, CONTEXT : CONTEXT + WINDOW]].T)
                sums = np.zeros((len(self.languages), len(data)), np.float32)
                for t, p in self.labelled(data):
                    p *= letters[t]
                    sums += p
                np.add.at(totals, whose[a : a + LANES], sums.T)
            held.clear()
            owner.clear()

        for i in which:
            windows = windows_of(sequence(texts[i]))
            for a in range(0, len(windows), 16 * LANES):
                held.append(windows[a : a + 16 * LANES])
                owner.extend([i] * len(held[-1]))
                if len(owner) >= 16 * LANES:
                    flush()
        if owner:
            flush()
        for i in which:
            p = totals[i] / max(totals[i].sum(), 1e-9)
            best = int(p.argmax())
            names[i], scores[i] = self.languages[best], float(min(p[best], 1.0))
        return names, scores


def label_positions(text: str, network: Network) -> list[str]:
    """The language of every byte of the text's UTF-8."""
    data = sequence(text)
    windows = windows_of(data)
    out = np.zeros((len(windows), WINDOW), np.int64)
    for a in range(0, len(windows), LANES):
        for t, p in network.labelled(np.ascontiguousarray(windows[a : a + LANES])):
            out[a : a + LANES, t] = p.argmax(axis=0)
    return [network.languages[i] for i in out.ravel()[: len(data)]]


def fit_network(windows: dict[str, np.ndarray], epochs: int = EPOCHS, seed: int = 0) -> Network:
    """A network from equally long windows of bytes per language: Adam over batches."""
    languages = sorted(windows)
    network = Network.fresh(languages, seed)
    if len(languages) < 2:
        return network
    r = np.random.default_rng(seed)
    data = np.concatenate([windows[name] for name in languages])
    label = np.repeat(np.arange(len(languages)), [len(windows[name]) for name in languages])
    first = {k: np.zeros_like(v) for k, v in network.weights.items()}
    second = {k: np.zeros_like(v) for k, v in network.weights.items()}
    step = 0
    for _ in range(epochs):
        order = r.permutation(len(data))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            _, grads = network.gradients(data[some], label[some])
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                network.weights[k] = (network.weights[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return network


def train(docs: DataFrame, held_out: int = 2, folds: int = 4, per_language: int = SAMPLE_PER_LANGUAGE, max_chars: int = SAMPLE_CHARS, most: int = SAMPLE_WINDOWS) -> Network:
    """Network from labelled documents outside the held-out fold.

    The sample: of each language the per_language documents with the least hashes of their ids,
    without texts of over max_chars characters, and of their windows the ``most`` that an even
    stride over them takes. One pass over the documents finds all languages' samples.
    """
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", folds) != held_out) & (F.length("text") <= max_chars))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = rows.select("doc_id", "lang").withColumn("n", rank).where(F.col("n") <= per_language)
    found = docs.select("doc_id", F.col("lang").alias("its"), "text").join(F.broadcast(chosen.select("doc_id", "lang")), "doc_id").where("its = lang")
    texts: dict[str, set[str]] = {}
    for r in found.select("lang", "text").toLocalIterator():
        if len(r["text"] or "") <= max_chars:
            texts.setdefault(r["lang"], set()).add(r["text"])
    windows = {}
    for name, some in texts.items():
        each = [windows_of(sequence(t), TRAIN_BYTES, 0) for t in sorted(some)]
        every = np.concatenate(each) if each else np.empty((0, TRAIN_BYTES), np.uint8)
        if len(every):
            windows[name] = every[:: max(1, -(-len(every) // most))]
    return fit_network(windows)


def predict(docs: DataFrame, network: Network, id_col: str = "doc_id", text_col: str = "text", part: int = 1000) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, part):
                some = batch.slice(at, part)
                names, scores = shared.value.documents(some.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(rows, f"doc_id {kind}, lang_pred string, score double")


def digest(docs: DataFrame, network: Network, held_out: int = 2, folds: int = 4) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    return predict(docs, network).select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
