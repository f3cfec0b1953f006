"""Whole queries and the pipeline against slow versions, and on odd tables."""

from __future__ import annotations

import math
import random
import struct
import zlib

import numpy as np
import pytest

import corpus_pipeline
from presswork.llm import induced, language, mixing, ogg, queries, secrets, substrings, toxicity
from presswork.llm.common import table


@pytest.fixture
def folder(spark, tmp_path):
    """A folder of the given documents, with labels and benchmark items."""

    def make(documents, labels=(), items=()):
        for name, rows, kind in (
            ("documents", documents, "doc_id long, text string, lang string, source string, n_chars long"),
            ("labels", list(labels), "doc_id long, quality int, toxic int"), ("benchmark", list(items), "item_id long, text string"),
        ):
            spark.createDataFrame(rows, kind).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return make


def plain_marginals(field, words):
    """Forward and backward sums over both states, step by step."""
    if not words:
        return []
    score = [field.bias + sum(field.features.get(f, 0.0) for f in toxicity.features_of(w)) for w in words]
    m = [[math.exp(field.moves[a][b]) for b in (0, 1)] for a in (0, 1)]
    forward = [[1.0, math.exp(field.start + score[0])]]
    for s in score[1:]:
        p = forward[-1]
        now = [p[0] * m[0][0] + p[1] * m[1][0], (p[0] * m[0][1] + p[1] * m[1][1]) * math.exp(s)]
        forward.append([x / sum(now) for x in now])
    back = [[1.0, 1.0]]
    for s in reversed(score[1:]):
        q = [back[0][0], back[0][1] * math.exp(s)]
        now = [m[0][0] * q[0] + m[0][1] * q[1], m[1][0] * q[0] + m[1][1] * q[1]]
        back.insert(0, [x / sum(now) for x in now])
    return [f[1] * b[1] / (f[0] * b[0] + f[1] * b[1]) for f, b in zip(forward, back, strict=True)]


def test_op5_equals_plain_sums(spark, folder):
    r = random.Random(20)
    words = [f"word{i}" for i in range(80)]
    documents, labels = [], []
    for i in range(300):
        some = r.choices(words, k=r.randint(0, 40))
        for _ in range(4 * (i % 4 == 0)):
            some.insert(r.randint(0, len(some)), r.choice(["scum", "vilest", "vileness"]))
        documents.append((i, " ".join(some) if i % 50 else None, "en", "s", 0))
        labels.append((i, 1, int(i % 4 == 0)))
    where = folder(documents, labels)
    field = toxicity.train(table(spark, where, "documents"), table(spark, where, "labels"))
    got = {x.doc_id: x for x in queries.op5_toxicity(spark, where).collect()}
    assert len(got) == 300 and field.document.any()
    for doc_id, text, *_ in documents:
        p = plain_marginals(field, toxicity.words_of(text))
        top = min(max(max(p, default=0), 1e-9), 1 - 1e-9)
        total = sum(p)
        x = (1.0, max(-10.0, min(10.0, math.log(top / (1 - top)))) / 10 if p else -1.0, math.log1p(total), math.sqrt(total / (len(p) + 20)))
        want = 1 / (1 + math.exp(-sum(a * b for a, b in zip(x, field.document, strict=True))))
        row = got[doc_id]
        assert row.score == pytest.approx(want, abs=1e-6) and row.predicted == (want >= 0.5) and row.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0)


def test_op9_equals_the_plain_recurrence(spark, folder):
    r = random.Random(21)
    parts = {"xx": ["tion", "the", "ing"], "yy": ["ung", "sch", "ä"]}
    documents = [(i, " ".join("".join(r.choices(parts[k], k=2)) for _ in range(r.choice([1, 10, 120]))), k, "s", 0) for i, k in enumerate(r.choices(["xx", "yy"], k=120))]
    documents += [(500, "123", None, "s", 0), (501, None, "xx", "s", 0), (502, "语言 the", None, "s", 0)]
    where = folder(documents)
    network = language.train(table(spark, where, "documents"))
    got = {x.doc_id: x for x in queries.op9_language(spark, where).collect()}
    for doc_id, text, *_ in documents:
        data = language.sequence(text)
        if not language.has_letter(text):
            assert (got[doc_id].lang_pred, got[doc_id].score) == ("und", 0.0)
            continue
        total = np.zeros(len(network.languages))
        size, context = language.WINDOW, language.CONTEXT
        for at in range(0, len(data), size):
            part = np.frombuffer((b" " * context + data + b" " * 2 * size)[at : at + size + 2 * context], np.uint8)[None]
            both = np.concatenate([network.states(part[:, :-context], "f")[:, context:], network.states(part[:, context:], "b")[:, :size]], axis=2)
            p = language.softmax(both @ network.weights["o"] + network.weights["ob"])[0][: len(data) - at]
            total += (p * language.LETTERS[np.frombuffer(data[at : at + size], np.uint8)][:, None]).sum(axis=0)
        assert got[doc_id].lang_pred == network.languages[int(total.argmax())] and got[doc_id].score == pytest.approx(total.max() / total.sum(), rel=1e-3)


def pages_by_hand(data):
    """(serial, granule, segments) of each page, straight from the format: no checksum, no resync."""
    at = 0
    while at < len(data):
        assert data[at : at + 4] == b"OggS"
        granule, serial = struct.unpack_from("<qI", data, at + 6)
        count = data[at + 26]
        sizes, body = list(data[at + 27 : at + 27 + count]), at + 27 + count
        segments = []
        for n in sizes:
            segments.append(data[body : body + n])
            body += n
        yield serial, granule, segments
        at = body


def test_op10_read_by_another_reader(spark, docs):
    texts = [(1, "abc"), (2, "é" * 50_000), (3, ""), (4, "x" * 255 * 64)]
    for x in ogg.store_texts(docs(texts), keep_media=True).collect():
        packets, held = [], b""
        for serial, _, segments in pages_by_hand(bytes(x.media)):
            if serial == ogg.SAMPLES:
                for s in segments:
                    held += s
                    if len(s) < 255:
                        packets.append(held)
                        held = b""
        assert b"".join(packets[1:]) == ogg.payload_of(dict(texts)[x.doc_id]) and not held


def test_pipeline_on_odd_and_empty_tables(spark, folder):
    odd = [(1, None, None, None, None), (None, "a b c", "en", "s", 5), (2, "", "en", "s", 0), (3, " \n", "en", "s", 2), (4, "a b c", "en", None, 5), (4, "a b c", "en", None, 5), (5, "word " * 30_000, "en", "t", 9), (6, "mail a@b.co now", "en", "t", 15)]
    out = corpus_pipeline.run(spark, folder(odd, [(1, None, 1)], [(None, "x"), (1, None), (2, "")])).collect()
    assert {x.doc_id for x in out} == {4, 5, 6} and {x.text for x in out if x.doc_id == 6} == {"mail <EMAIL> now"}
    assert corpus_pipeline.run(spark, folder([], [], [])).count() == 0


def test_mixed_rows_replaces_an_earlier_mix(docs):
    table_ = docs([(1, "a b c", "s"), (2, "a b", "t"), (3, "c d e f", "t")])
    once = mixing.mixed_rows(table_)
    again = mixing.mixed_rows(once.drop("mix_copy").dropDuplicates(["doc_id"]).withColumnsRenamed({"size": "__size", "h": "row"}))
    assert again.columns[-4:] == once.columns[-4:] and "row" in again.columns and {x.mix_size for x in again.collect()} <= {2, 3, 4}
    assert sum(x.mix_taken for x in again.collect()) == sum(x.mix_taken for x in once.collect())


def test_very_many_secrets_in_a_text(docs):
    text = " ".join(f"token=abcdefgh{i:05d}" for i in range(1500))
    row = secrets.digest(secrets.scan(docs([(1, text)]))).first()
    assert row.n_assign == 1500 and row.spans.split(",")[-1] == f"assign:{len(text) - 19}:{len(text)}"


def test_a_full_shard_spills_and_recurses():
    """At the default limits, a shard of the default size goes through disk and through recursion."""
    r = np.random.default_rng(22)
    words = np.array([bytes(r.integers(97, 123, int(n)).astype(np.uint8)) + b" " for n in r.integers(2, 9, 5000)], object)
    piece = b"".join(words[r.integers(0, 5000, 200)])
    parts = [b"".join(words[r.integers(0, 5000, 100_000)]) for _ in range(16)]
    text = b"\xff".join(p[:at] + piece + p[at:] for p, at in zip(parts, r.integers(0, 300_000, 16), strict=True))
    shard, pool = substrings.Shard(), induced.Pool()
    for i, p in enumerate(text.split(b"\xff")):
        shard.add(i, b"", False, p)
    assert shard.size > substrings.SHARD_BYTES
    hit = shard.repeated(400, pool)
    assert pool.spilled > 0 and pool.recursions > 0
    want = len(piece) - 400 + 1
    counts = [int(hit[s : s + n].sum()) for _, _, _, s, n in shard.rows]
    assert all(want <= c <= want + 40 for c in counts)  # a few bytes more where neighbours agree by chance
