"""What of op3's segments comes to be sorted."""

from __future__ import annotations

import random

import pytest

from presswork.llm import substrings


def line(r, n):
    return "".join(r.choice("abcdefghijklmnop ") for _ in range(n))


@pytest.mark.parametrize("shared, sorted_", [(200, False), (400, True), (450, True)])
def test_a_piece_alone_is_not_sorted(docs, monkeypatch, shared, sorted_):
    """Texts that share more than a piece but far less than a window have no window to compare."""
    r, seen = random.Random(5), []
    own = substrings.decide
    monkeypatch.setattr(substrings, "decide", lambda segments, *a: (seen.append(segments.count()), own(segments, *a))[1])
    texts = []
    for _ in range(40):
        some = line(r, shared)
        texts += [line(r, r.randint(300, 900)) + some + line(r, r.randint(300, 900)) for _ in range(2)]
    got = substrings.deduplicate(docs(list(enumerate(texts)))).collect()
    assert bool(seen[0]) == sorted_
    assert all((x.n_removed >= shared) == sorted_ for x in got)


def test_a_window_is_found_wherever_its_piece_is(docs):
    """Windows of just 400 bytes, at any place of texts and beside pieces that a text holds several times."""
    r = random.Random(6)
    texts = []
    for i in range(120):
        some, again = line(r, 400), line(r, 130)
        texts += [line(r, r.choice((0, 1, 127, 128, 129, 500))) + some + line(r, r.choice((0, 1, 127, 128, 500))), line(r, 600) + some]
        if i % 4 == 0:
            texts += [again + line(r, 30) + again + line(r, 300), again + line(r, 30) + again + line(r, 300)]
    got = {x.doc_id: x.n_removed for x in substrings.deduplicate(docs(list(enumerate(texts)))).collect()}
    windows = {}
    for i, t in enumerate(texts):
        for k in range(len(t) - 399):
            windows.setdefault(t[k : k + 400], []).append((i, k))
    want = {i: set() for i in range(len(texts))}
    for places in windows.values():
        for i, k in places if len(places) > 1 else []:
            want[i].update(range(k, k + 400))
    assert got == {i: len(x) for i, x in want.items()} and sum(map(bool, want.values())) >= 240


def test_the_only_segment_of_a_piece_is_not_sorted(spark):
    """What stands at several places and has nothing beside it of its piece is repeated whole, without a shard."""
    some = [(1, b"a", True, b"x" * 500), (2, b"b", True, b"y" * 450), (2, b"c", False, b"y" * 440), (3, b"d", False, b"z" * 401)]
    rows = list(substrings.by_piece(iter(some)))
    assert rows == [(some[0], True), (some[1], False), (some[2], False), (some[3], True)]
    table = spark.createDataFrame([(h, bytearray(c), s, bytearray(d)) for h, c, s, d in some], "h long, content binary, several boolean, data binary")
    got = {bytes(x.content): [tuple(s) for s in x.spans] for x in substrings.decide(table, 400, 1000, {}).collect()}
    assert got == {b"a": [(0, 500)], b"b": [(0, 450)], b"c": [(0, 440)], b"d": [(0, 401)]}
