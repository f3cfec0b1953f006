"""Passages by their rarest anchors against a plain search."""

from __future__ import annotations

import random

import numpy as np
import pytest

from presswork.operators import passages as P


def test_a_text_has_the_anchors_of_what_it_holds(monkeypatch):
    monkeypatch.setattr(P, "STRIP", 50)
    r = random.Random(1)
    for alphabet in ("ab", "abcdefgh é中\U0001f600"):
        text = "".join(r.choices(alphabet, k=700))
        for least, gram, window in P.LEVELS:
            places, hashes = P.anchors(text, gram, window)
            held = dict(zip(places.tolist(), hashes.tolist(), strict=True))
            for _ in range(20):
                n = r.randint(least, least + 40)
                at = r.randint(0, len(text) - n)
                own = P.anchors(text[at : at + n], gram, window)
                assert len(own[0]) and all(held.get(at + p) == h for p, h in zip(*map(np.ndarray.tolist, own), strict=True))


@pytest.mark.parametrize("alphabet", ["ab ", "abcdefghijklmnopqrstuvwxyz 가나é"])
def test_held_passages_equal_a_plain_search(spark, alphabet):
    r = random.Random(2)
    texts = ["".join(r.choices(alphabet, k=r.choice([0, 3, 40, 400]))) for _ in range(60)] + ["ab" * 300]
    texts += [texts[5]] * 30  # a third are copies
    passages = {t[a : a + n] for t in texts for a, n in [(r.randint(0, max(len(t) - 1, 0)), r.choice([1, 2, 5, 7, 8, 20, 31, 32, 60, 200]))] if t}
    passages |= {"".join(r.choices(alphabet, k=n)) for n in (1, 3, 9, 33, 90)} | {"ab" * 20}
    passages.discard("")
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(99, None, "x")], "i int, body string, p string")
    asked = spark.createDataFrame([(p,) for p in passages] + [("",), (None,)] + [(p,) for p in passages], "quote string")
    got = sorted((r.i, r.quote) for r in P.held_passages(df, "body", asked, "quote").collect())
    assert got == sorted((i, p) for i, t in enumerate(texts) for p in passages if p in t)
    assert P.held_passages(df, "body", asked.where("quote = ''"), "quote").count() == 0


def test_quotes_stay_off_the_driver(spark):
    quotes = spark.range(60_000).selectExpr("concat('a passage of some length with the number ', id, ' in it') AS quote")
    texts = spark.createDataFrame([(i, f"Before. a passage of some length with the number {i * 7919 % 75_000} in it. After.") for i in range(300)], "i int, body string")
    got = {(r.i, r.quote) for r in P.held_passages(texts, "body", quotes, "quote").collect()}
    assert got == {(i, f"a passage of some length with the number {i * 7919 % 75_000} in it") for i in range(300) if i * 7919 % 75_000 < 60_000}
