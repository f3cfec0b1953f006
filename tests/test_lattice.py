"""Words by the lattice against all ways to cut them, and what a made collection teaches."""

from __future__ import annotations

import pickle
import random

from pyspark.sql import functions as F

from presswork.operators import keywords as K
from presswork.operators import lattice as X


def every_cut(run, model):
    """All ways: stems or unknown stretches, then particles."""

    def stems(at, cost, out):
        if at:
            yield from tails(at, cost, out, ())
        for end in range(at + 1, len(run) + 1):
            piece = run[at:end]
            yield from stems(end, cost + X.UNKNOWN + X.UNKNOWN_CHAR * len(piece), (*out, piece))
            if piece in model.stems:
                yield from stems(end, cost + model.stems[piece], (*out, piece))

    def tails(at, cost, out, ends):
        if at == len(run):
            yield round(cost, 9), len(out) + len(ends), out, ends
        for end in range(at + 1, len(run) + 1):
            if run[at:end] in model.tails:
                yield from tails(end, cost + model.tails[run[at:end]], out, (*ends, run[at:end]))

    return min(stems(0, 0.0, ()))[2:]


def test_cheapest_paths_equal_all_ways():
    r = random.Random(1)
    letters = "가나다라"
    word = lambda: "".join(r.choices(letters, k=r.randint(1, 3)))
    model = X.Model({word(): r.choice([1.0, 2.5, 4.0]) for _ in range(10)}, {word(): r.choice([0.5, 1.0]) for _ in range(5)})
    for _ in range(150):
        run = "".join(r.choices(letters, k=r.randint(1, 8)))
        assert model.path(run) == every_cut(run, model), run
    again = pickle.loads(pickle.dumps(model))
    assert again.path("가나다라") == model.path("가나다라")


NOUNS = ["금리", "환율", "수출", "물가", "반도체", "은행", "시장", "정부", "기업", "투자", "배터리", "전기차", "유가", "주가", "채권", "예산"]


def test_a_collection_teaches_nouns_particles_and_compounds(spark):
    r = random.Random(2)
    truth = {}
    for _ in range(1500):
        some = r.choices(NOUNS, k=r.choice([1, 1, 2]))
        tail = r.choice(["", "", "는", "에서", "까지", "의", "로"])
        truth["".join(some) + tail] = (tuple(some), (tail,) if tail else ())
    titles = [" ".join(r.choices(list(truth), k=4)) for _ in range(900)]
    model = X.learn(spark.createDataFrame([(t,) for t in titles] + [(None,), ("no hangul 12",)], "t string"), F.col("t"), least=3)
    right = sum(model.path(w) == cut for w, cut in truth.items())
    assert right >= 0.9 * len(truth), (right, len(truth))
    assert model.word("반도체시장에서") == X.Word("반도체시장", ("반도체", "시장"), "TERM") and model.compound(model.word("반도체시장에서"))
    assert model.word("금리") == X.Word("금리", ("금리",), "CONTENT") and not model.compound(model.word("금리")) and model.word("올랐다").kind == "STOP"
    found = K.phrases("전기차 배터리시장 투자가 오른다", "정부", model)
    assert {"전기차 배터리시장", "배터리시장", "전기차 배터리시장 투자"} <= {p[0] for p in found}


def test_an_empty_collection(spark):
    model = X.learn(spark.createDataFrame([], "t string"), F.col("t"))
    assert model.stems == {} and model.path("가나") == (("가나",), ()) and model.word("-").kind == "STOP"
