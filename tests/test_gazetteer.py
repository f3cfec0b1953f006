"""Names by an automaton against one pattern for each spelling, and a table of very many."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from presswork.functions import lexicon as L
from presswork.operators import gazetteer as G


def by_patterns(text, pairs):
    """Longest spelling first, no character used twice."""
    taken, out = bytearray(len(text)), set()
    for name, a in sorted(pairs, key=lambda x: -len(x[1])):
        border = rf"(?<![A-Za-z0-9]){re.escape(a)}(?![A-Za-z0-9])" if re.fullmatch(r"[A-Za-z0-9.+-]+", a) else re.escape(a)
        for m in re.finditer(border, text, re.IGNORECASE):
            if not any(taken[m.start() : m.end()]):
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
                out.add(name)
    return out


def made(seed, n=200):
    r = random.Random(seed)
    words = [a for some in L.EVENT_NAMES.values() for a in some] + ["AI", "반도체", "AIR", "x", "삼성", "전자", ".", "-", "Ä", "ß"]
    return ["".join(r.choice(words) + r.choice(["", " ", "", "이 "]) for _ in range(r.randint(0, 12))) for _ in range(n)]


def test_present_names_by_the_present_rule():
    pairs = G.flat({**L.ALIASES, **L.EVENT_NAMES, "삼성": ("삼성",), "S": ("AI",)})
    known = G.built(pairs, False)
    for text in made(1):
        assert {m.name for m in G.longest_first(known.matches(text))} == by_patterns(text, pairs), text


def test_a_hundred_thousand_spellings(spark):
    names = spark.range(100_000).select(F.concat(F.lit("name"), "id").alias("name"), F.concat(F.lit("word "), "id").alias("spelling"))
    texts = spark.createDataFrame([(1, "a word 12, WORD 99999 and word 100000"), (2, None), (3, "word 1234567 sword 5 word 7"), (4, "")], "i int, t string")
    hits = G.found(texts, "i", "t", names, bordered=True)
    assert sorted((r.i, r.start, r.end, r.name) for r in hits.collect()) == [(1, 2, 9, "name12"), (1, 11, 21, "name99999"), (3, 21, 27, "name7")]
    few = G.found(texts, "i", "t", names.limit(10), bordered=True)
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(hits) == size(few)


@pytest.mark.parametrize("exclusive", [True, False])
def test_shards_give_what_one_automaton_gives(spark, monkeypatch, exclusive):
    r = random.Random(2)
    spellings = [(f"n{i % 60}", "".join(r.choices("ab ", k=r.randint(1, 4))).strip() or "a") for i in range(90)]
    table = spark.createDataFrame([*spellings, (None, "a"), ("x", "")], "name string, spelling string")
    texts = spark.createDataFrame([(i, "".join(r.choices("abAB .", k=30))) for i in range(40)], "i int, t string")
    one = sorted(map(tuple, G.found(texts, "i", "t", table, exclusive=exclusive).collect()))
    monkeypatch.setattr(G, "MOST_BYTES", 100)
    assert sorted(map(tuple, G.found(texts, "i", "t", table, exclusive=exclusive).collect())) == one and one
    with pytest.raises(ValueError, match="found"):
        G.names_in(F.col("t"), tuple(spellings))
