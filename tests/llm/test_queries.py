"""The registered queries against their SQL, and the pipeline's stages one by one."""

from __future__ import annotations

import re

import pytest

import corpus_pipeline
from presswork.llm import pii, queries, toxicity
from presswork.llm.common import materialize, table

from ..compare import connect, rows
from .test_operators import leaks


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, small, name):
    got = queries.queries()[name](spark, small).toPandas()
    want = connect(small).execute(queries.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_every_document_has_a_row(spark, small, name):
    out = queries.queries()[name](spark, small)
    docs = table(spark, small, "documents").count()
    assert out.agg({"n_docs": "sum"}).first()[0] == docs if name.startswith("op2_") else out.count() == docs


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.queries()) == list(range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "benchmark_decontamination", "pii", "mixing"]


def test_pipeline(spark, small):
    docs = table(spark, small, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, kept, small), f"test-{name}")
        before, after = {r.doc_id: r for r in kept.collect()}, out.collect()
        if name != "mixing":
            assert out.columns == docs.columns
        if name == "toxicity":
            field = toxicity.train(docs, table(spark, small, "labels"))
            scores, _ = toxicity.score_texts([r.text for r in before.values()], field)
            assert {r.doc_id for r in after} == {d for d, s in zip(before, scores, strict=True) if s < 0.5}
        elif name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
            assert {r.doc_id for r in after} == {x[0] for x in leaks([(d, r.text) for d, r in before.items()], items) if not x[5]}
        elif name == "pii":
            assert {r.doc_id: r.text for r in after} == {d: pii.redacted(r.text) for d, r in before.items()}
            assert not any(s[1] in (0, 1) for r in after for s in pii.find(r.text))
        elif name == "mixing":
            taken, target = {}, {}
            for r in after:
                taken[r.source] = taken.get(r.source, 0) + r.mix_taken
                target[r.source] = r.mix_target
            longest = max(r.mix_size for r in after)
            assert all(abs(taken[s] - target[s]) <= longest for s in target)
        kept = out
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).select("doc_id", "mix_copy", "mix_taken").collect())) == sorted(map(tuple, kept.select("doc_id", "mix_copy", "mix_taken").collect()))
