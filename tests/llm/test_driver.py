"""What the driver does and keeps."""

from __future__ import annotations

import pytest

from presswork.llm import components, toxicity


def test_the_field_is_fitted_by_a_worker(spark, docs, monkeypatch):
    """The driver would keep the memory that the fit takes for all later stages."""
    table = docs([(i, f"some scum{i % 7} words" if i % 2 else f"kind words {i % 7}") for i in range(60)])
    marks = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    rows = [(str(r.doc_id), r.toxic, r.text) for r in table.join(marks, "doc_id").where(toxicity.fold("doc_id", 5) != 0).collect()]
    want = toxicity.fit_sample(rows)

    def here(*args):
        raise AssertionError("fitted in the driver")

    monkeypatch.setattr(toxicity, "fit_field", here)
    got = toxicity.train(table, marks)
    assert got.features == want.features and got.bias == want.bias and got.prior == want.prior
    assert got.document.tolist() == want.document.tolist()


@pytest.mark.parametrize("edges", [[], [(3, 3)], [(i, i + 1) for i in range(100)] + [(500, 400), (400, 500), (-1, 400)]])
def test_components_need_no_count_jobs(spark, edges, monkeypatch):
    def counted(self):
        raise AssertionError("a job to count edges")

    table = spark.createDataFrame(edges, "a long, b long")
    monkeypatch.setattr(type(table), "count", counted)
    got = {(r.node, r.root) for r in components.components(table).collect()}
    want = {(i, 0) for i in range(101)} | {(x, -1) for x in (-1, 400, 500)} if len(edges) > 1 else set()
    assert got == want
