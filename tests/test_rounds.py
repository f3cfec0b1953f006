"""Work in rounds against plain loops: ordered dedupes, closures, the vector index."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from presswork.operators import dedupe as D
from presswork.operators import maps as M
from presswork.operators import selection as S
from presswork.operators import vector_index as I
from presswork.sources.tables import stored

TREE = "map_id int, node_id long, parent_id long"


def first_by_keys(rows):
    seen, kept = set(), []
    for g, i, keys in rows:
        own = {(g, k) for k in keys or () if k is not None}
        if not seen & own:
            seen |= own
            kept.append((g, i))
    return kept


@pytest.mark.parametrize("small", [0, 30, 10_000])
def test_identities_by_rounds_equal_the_loop(spark, small):
    r = random.Random(3)
    rows = [(g, i, [f"k{r.randint(0, 60)}" for _ in range(r.randint(1, 3))]) for g in range(4) for i in range(60)]
    rows += [(9, i, r.choice([["hot"], ["hot", f"x{i}"], [], None, [None, f"y{i // 2}"]])) for i in range(240)]  # a group with half of the rows
    got = D.identity_dedupe(spark.createDataFrame(rows, "g int, i int, keys array<string>").repartition(5), ["g"], [F.col("i")], small=small)
    assert sorted((x.g, x.i) for x in got.collect()) == sorted(first_by_keys(rows))
    assert getattr(got, "rounds", 0) <= 12


def test_a_chain_of_conflicts_ends(spark, monkeypatch):
    monkeypatch.setattr(D, "MAX_ROUNDS", 3)
    df = spark.createDataFrame([(1, i, [f"k{i}", f"k{i + 1}"]) for i in range(40)], "g int, i int, keys array<string>")
    got = D.identity_dedupe(df, ["g"], [F.col("i").desc()], small=0)
    assert got.rounds == 3 and sorted(x.i for x in got.collect()) == list(range(1, 40, 2))


def first_by_titles(rows):
    kept = []
    for g, i, url, tokens in rows:
        own = set(tokens)
        met = any(g == h and (url == u or (own & t and len(own & t) / min(len(own), len(t)) >= 0.4)) for h, u, t in kept)
        if url and not met:
            kept.append((g, url, own))
            yield g, i


@pytest.mark.parametrize("small", [0, 50, 10_000])
def test_titles_by_rounds_equal_the_loop(spark, small):
    r = random.Random(5)
    words = ["".join(r.choices("bcdfgklmnprstvz", k=5)) for _ in range(120)]
    rows = []
    for i in range(300):
        g = 1 if i % 2 else r.randint(2, 5)
        rows.append((g, i, r.choice(["", f"u{i}", f"u{i}", f"u{i // 3}"]), r.choices(words, weights=[40] * 3 + [1] * 117, k=r.randint(0, 11))))
    df = spark.createDataFrame([(g, i, u, " ".join(t)) for g, i, u, t in rows], "g int, i int, url string, title string").repartition(5)
    got = D.title_overlap_dedupe(df, ["g"], [F.col("i")], small=small)
    assert sorted((x.g, x.i) for x in got.collect()) == sorted(first_by_titles(sorted(rows)))
    assert getattr(got, "rounds", 0) <= 20


def test_near_copies_go_in_two_rounds(spark):
    df = spark.createDataFrame([(1, i, f"u{i}", f"central bank holds interest rate steady {'abcdefghij'[i % 10] * 4}") for i in range(500)], "g int, i int, url string, title string")
    got = D.title_overlap_dedupe(df, ["g"], [F.col("i")], small=0)
    assert [x.i for x in got.collect()] == [0] and got.rounds == 1


def pairs(parents):
    out = Counter()
    for x in parents:
        a, d = x, 0
        while a in parents:
            out[a, x, d] += 1
            a, d = parents[a], d + 1
    return out


def test_closures_of_chains_forests_and_circles(spark):
    r = random.Random(8)
    forest = {i: r.choice([None, r.randrange(i) if i else None, i - 1 if i else None]) for i in range(200)}
    chain = {1000 + i: 999 + i if i else None for i in range(300)}
    rows = [(1, x, p) for x, p in forest.items()] + [(2, x, p) for x, p in chain.items()] + [(1, 9999, 123456)]
    got = Counter((x.root, x.node_id, x.level) for x in M.descendants(spark.createDataFrame(rows, TREE)).collect())
    assert got == pairs(forest) + pairs(chain) + Counter({(9999, 9999, 0): 1})
    near = Counter((x.root, x.node_id, x.level) for x in M.descendants(spark.createDataFrame(rows, TREE), 5).collect())
    assert near == Counter({k: n for k, n in got.items() if k[2] <= 5})
    circle = [(1, 1, 2), (1, 2, 3), (1, 3, 1), (1, 4, 2), (1, 5, 4), (1, 6, 6), (2, 1, None)]
    cut = {1: None, 2: 3, 3: 1, 4: 2, 5: 4, 6: None}
    assert Counter((x.root, x.node_id, x.level) for x in M.descendants(spark.createDataFrame(circle, TREE)).collect()) == pairs(cut) + pairs({1: None})
    assert M.descendants(spark.createDataFrame([], TREE)).count() == 0


def test_ancestors_by_distance(spark):
    df = spark.createDataFrame([(i, i - 1 if i % 40 else None) for i in range(1, 120)], "map_id int, previous_map_id int")
    got = sorted(map(tuple, M.ancestors(df, most=6).select("map_id", "ancestor", "distance").collect()))
    assert got == sorted((i, i - d, d) for i in range(1, 120) for d in range(1, 7) if i % 40 and d <= i % 40)


def clustered(spark, n, dims, groups, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, dims))
    x = centres[r.integers(groups, size=n)] + 0.4 * r.normal(size=(n, dims))
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third are copies
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)] + [(n, None), (n + 1, [0.0] * dims), (n + 2, [1.0] * 3)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_vector_index_recall_and_work(spark, monkeypatch):
    df = stored(clustered(spark, 3000, 24, 40, 1), "vectors")
    model = I.fit(df, dims=24)
    index = stored(I.encoded(df, model), "index")
    asked = df.where("vec_id % 100 = 0")
    want = {(r.centre, r.vec_id): round(r.cosine, 9) for r in S.vector_top_k(df, asked, 10, dims=24).collect()}
    found = {(r.centre, r.vec_id): round(r.cosine, 9) for r in I.search(index, model, asked).collect()}
    assert len(set(want) & set(found)) >= 0.9 * len(want) and all(found[k] == want[k] for k in set(want) & set(found))
    work = I.pairs_scored(index, model, asked).first()
    assert index.count() == 3000 and work.scored < 0.8 * work.pairs
    monkeypatch.setattr(I, "SLOT_ROWS", 100)
    monkeypatch.setattr(I, "QUERY_BLOCK", 7)
    assert {(r.centre, r.vec_id): round(r.cosine, 9) for r in I.search(index, model, asked).collect()} == found


def test_vector_index_of_odd_tables(spark):
    df = stored(clustered(spark, 12, 8, 2, 2), "vectors")
    none = df.where("vec_id < 0")
    model = I.fit(none, dims=8)
    assert I.search(stored(I.encoded(none, model), "index"), model, none).count() == 0
    model = I.fit(df, dims=8)
    got = I.search(stored(I.encoded(df, model), "index"), model, df.where("vec_id IN (0, 12)"), 3).collect()
    assert sorted(r.centre for r in got) == [0, 0, 0]
    for kind in ("int", "string"):
        named = stored(df.withColumn("vec_id", F.col("vec_id").cast(kind)), "vectors")
        again = I.search(stored(I.encoded(named, model), "index"), model, named.where("vec_id IN (0, 12)"), 3)
        assert again.schema["centre"].dataType.simpleString() == kind and again.count() == 3
