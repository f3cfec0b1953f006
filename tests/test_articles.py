from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from presswork.operators import articles as A
from presswork.operators import comparison as C
from presswork.sources import articles as S


def test_documents_round_trip(spark):
    df = spark.createDataFrame([("http://a.com/1", "금리 인상", "설명", "", "2026-10-10T00:00:00Z"), ("http://b.com/2", "t", None, "B", "20261010T010203Z"), ("http://b.com/3", "t", None, None, "soon")], "url string, title string, description string, source string, published_at string")
    stored = A.to_documents(df, F.lit("2026-10-11T00:00:00Z").cast("timestamp"))
    got = {r.url: r for r in stored.collect()}
    assert got["http://a.com/1"].source.name == "a.com" and got["http://a.com/1"].language == "ko" and got["http://b.com/2"].published_at.hour == 1 and got["http://b.com/3"].published_at is None
    back = {r.url: r for r in A.from_documents(stored).collect()}
    assert back["http://a.com/1"].published_at == "2026-10-10T00:00:00Z" and back["http://b.com/3"].published_at == "" and back["http://b.com/2"].description == ""


def test_metadata(spark):
    raw = '```json\n{"keywords":["hbm","연준","없는말","x"],"categories":["반도체","기타"]}\n```'
    df = spark.createDataFrame([(raw, "hbm과 연준 소식"), ('{"keywords":["없는말"],"categories":[]}', "hbm"), ("{", "hbm"), ('{"keywords":[],"categories":[]}', "a")], "raw string, low string")
    got = [r.m for r in df.select(A.parsed_metadata(F.col("raw"), F.col("low")).alias("m")).collect()]
    assert (got[0].keywords, got[0].categories) == (["HBM", "연준"], ["반도체"]) and got[1] is None and got[2] is None and got[3].keywords == []
    state = spark.createDataFrame([("h", "llm", 0.0), ("h", "fallback", 50.0), ("h", "fallback", 200.0), ("x", "llm", 0.0)], "input_hash string, method string, retry_after double")
    assert [r.r for r in state.select(A.reusable_metadata(F.struct("*"), F.lit("h"), F.lit(100.0)).alias("r")).collect()] == [True, False, True, False]
    inputs = spark.createDataFrame([("T", "body", "desc"), ("T", "", "desc"), ("T", "", "T"), ("T", None, None)], "title string, cleaned_content string, description string")
    assert [(r.basis, r.meta_body) for r in A.metadata_input(inputs).collect()] == [("body", "body"), ("description", "desc"), ("title", ""), ("title", "")]


def test_images_cards_and_pools(spark):
    df = spark.createDataFrame([(True, "http://m/i.png", "http://p/i.png"), (False, "http://m/i.png", "http://p/qr_code.png"), (False, "ftp://m", "")], "naver boolean, meta string, primary string")
    got = [r.i for r in df.select(A.image_choice(F.col("naver"), F.col("meta"), F.col("primary"), F.array(F.lit("http://o/1.png"))).alias("i")).collect()]
    assert got == ["http://m/i.png", "http://o/1.png", "http://o/1.png"]
    t = df.select(A.thumbnail(F.col("meta"), F.lit(7)).alias("t")).collect()
    assert (t[0].t.fallback_used, t[2].t.fallback) == (False, 2)
    a, b = spark.createDataFrame([("1", "m")], "news_id string, w string"), spark.createDataFrame([("1", "s"), ("2", "s")], "news_id string, w string")
    assert sorted((r.news_id, r.w) for r in A.merged_pools(a, b).collect()) == [("1", "m"), ("2", "s")]
    n = spark.createDataFrame([("r", str(i), i) for i in range(8)] + [("r", "3", 9)], "rid string, news_id string, rank int")
    asked = spark.createDataFrame([("r", "0"), ("r", "2")], "rid string, news_id string")
    assert [r.news_id for r in A.rag_rows(n, asked, ["rid"]).orderBy("n").collect()] == ["1", "3", "4"]


def test_usage_and_extraction(spark):
    df = spark.createDataFrame([("gemini", '{"prompt_token_count": 5, "candidates_token_count": "x"}'), ("anthropic", '{"input_tokens": -1, "output_tokens": 2}')], "p string, j string")
    got = [tuple(r.u) for r in df.select(A.usage(F.col("p"), F.col("j")).alias("u")).collect()]
    assert got == [(5, None), (None, 2)]
    e = spark.createDataFrame([('{"objects":[{"text":" a \\n\\n b"}]}',), ('{"errorCode":429}',), ('{"objects":[]}',)], "j string").select(A.extraction(F.col("j")).alias("x")).collect()
    assert (e[0].x.text, e[0].x.error) == ("a\nb", None) and [r.x.error for r in e[1:]] == ["rate_limited", "empty"]
    t = spark.createDataFrame([(None, [1, 3000], 9), (5, [1], None), (None, None, None)], "r long, s array<long>, c long").select(A.embedding_tokens(F.col("r"), F.col("s"), F.col("c")).alias("x")).collect()
    assert [tuple(r.x) for r in t] == [(3001, "statistics", True), (5, "response", False), (None, None, False)]


def test_comparison(spark):
    with pytest.raises(ValueError):
        C.arms(spark, ("A", "D"))
    assert C.arms(spark, ("A", "C'")).count() == 2
    df = spark.createDataFrame([([("1", "x")], []), ([("1", "x"), ("1", "y")], []), ([], []), ([("1", "x" * 60_001)], [])], "e array<struct<news_id:string,input_excerpt:string>>, r array<string>")
    assert [r.p for r in df.select(C.input_problem(F.col("e"), F.col("r")).alias("p")).collect()] == [None, "duplicate_ids", "evidence_count", "too_long"]
    polls = spark.createDataFrame([("j", 0, "a"), ("j", 1, "a"), ("j", 5, "b"), ("j", 6, "b"), ("j", 9, None)], "j string, at int, stage string")
    assert [(r.stage, r.seconds) for r in C.stage_changes(polls, ["j"]).orderBy("at").collect()] == [("a", None), ("b", 5), (None, 4)]
    g = spark.createDataFrame([("running", "w", 9), ("cancel_requested", "w", 9), ("running", "x", 9), ("running", "w", 1)], "s string, o string, d int")
    assert [r.x for r in g.select(C.checkpoint_guard(F.col("s"), F.col("o"), F.lit("w"), F.col("d"), F.lit(5)).alias("x")).collect()] == [None, "cancelled", "lease_lost", "timeout"]


def test_article_view_keeps_every_line(spark):
    lines = [f"l{i}" for i in range(1500)]
    other = [*lines[:-1], "else"]
    df = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(other)), (3, "only"), (4, None)], "doc_id long, text string").withColumns({"source": F.lit("s"), "lang": F.lit("en")})
    view = S.article_view(df)
    got = {r.doc_id: r for r in view.select("doc_id", "title", "description", A.summary_key(F.col("title"), F.col("description")).alias("key")).collect()}
    assert got[1].description == " ".join(lines[1:]) and got[2].description == " ".join(other[1:]) and got[1].key != got[2].key
    assert (got[3].title, got[3].description, got[4].title, got[4].description) == ("only", "", "", "")
