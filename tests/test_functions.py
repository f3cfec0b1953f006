from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from presswork.functions import text as T
from presswork.functions import udfs as U
from presswork.functions import vectors as V
from presswork.functions import words as P
from presswork.sources import articles as A
from presswork.sources import html as H

WORDS = ["기준금리를", "한국은행이", "인상했다", "3.5%", "samsung", "ai", "반도체의", "가격은", "이날", "2026", "chip", "수출이", "a", "약", "상승했습니다", "전망에서는"]


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, (int, float)) else 'double'}" for k, v in values.items())).select(column.alias("x")).first().x


def test_content_tokens_equal_the_plain_ones(spark):
    r = random.Random(0)
    texts = [" ".join(r.choices(WORDS, k=r.randint(0, 12))) for _ in range(60)] + ["", None]
    texts += ["".join(r.choices([*WORDS, "이다", "에서", "는", "5", "1.", "7%", ".3", "+", " ", "b", "가"], k=r.randint(1, 9))) for _ in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(T.content_tokens(F.col("t")).alias("x")).collect()
    assert [g.x for g in got] == [P.tokens(t or "") for t in texts]


def test_bigrams_and_similarities(spark):
    df = spark.createDataFrame([(["rate", "ab", "35%"], ["rates", "ab"])], "a array<string>, b array<string>")
    row = df.select(T.bigrams(F.col("a")).alias("ga"), T.bigrams(F.col("b")).alias("gb")).select("ga", "gb", T.dice(F.col("ga"), F.col("gb")).alias("d"), T.containment(F.col("ga"), F.col("gb")).alias("c"), T.overlap(F.array(), F.col("gb")).alias("o")).first()
    assert set(row.ga) == {"ra", "at", "te", "ab", "35%"} and row.o == 0
    assert row.d == pytest.approx(2 * 4 / (5 + 5)) and row.c == pytest.approx(4 / 5)


def test_keys(spark):
    assert one(spark, T.name_key(F.col("t")), t="(주) 삼성 전자 주식회사") == "삼성전자"
    assert one(spark, T.ticker(F.col("t")), t=" krx:a005930") is None or one(spark, T.ticker(F.col("t")), t="KRX:A005930") == "005930"
    assert one(spark, T.query_key(F.col("t")), t="  Oil  Price ") == "oil price"
    assert one(spark, T.first_sentence(F.col("t")), t="금리가 올랐다 그리고") == "금리가 올랐다"
    assert one(spark, T.search_query(F.col("q"), F.col("t")), q="금리", t="기준 금리 인상") == "기준 금리 인상"
    assert one(spark, T.direction(F.col("t")), t="코스피 급락") == -1
    assert one(spark, T.lenient_object(F.col("t")), t='x ```json\n{"a": {"b": 1}}``` y') == '{"a": {"b": 1}}'


def test_urls():
    assert U.canonical("HTTPS://Ex.com/a/?b=2&utm_x=1&a=1&c=#f") == "https://ex.com/a?a=1&b=2"
    assert U.host_key("http://www.ex.com/a/?b=&fbclid=3") == "ex.com/a?b="
    assert U.canonical("http://[bad") == "http://[bad" and U.canonical(None) == ""
    assert U.client("2001:db8::1") == "2001:db8::/64" and U.client("::ffff:1.2.3.4") == "1.2.3.4" and U.client("x") == "unknown"


def test_quotes_and_cuts():
    assert U.quoted("3% 올랐다", "주가는 3% 올랐다고 한다") and not U.quoted("3%", "13% 상승") and not U.quoted("3%", "-3% 하락")
    assert not U.quoted("15%", "1.5% 상승") and not U.quoted("", "x")
    assert U.canonical_digest('{"b":1,"a":2}') == U.canonical_digest('{"a": 2, "b": 1}') and U.canonical_digest("{") is None


def test_excerpts(spark):
    df = spark.createDataFrame([("aaaa. bbbb. cc", 12), ("a" * 20, 10), (None, 5), ("a. b\u3000" + "c" * 9, 8), ("ab。\u3000cdef", 6), ("short", 9)], "t string, n int")
    assert [r.x for r in df.select(U.excerpt(F.col("t"), F.col("n")).alias("x")).collect()] == ["aaaa. bbbb.", "a" * 10, "", "a. b\u3000ccc", "ab。", "short"]


def test_clean_and_normal():
    assert U.clean("<b>A&amp;B</b>　x") == "A&B x" and U.clean(None) == ""
    assert U.normal("[단독] 美 금리↑ 결정...") == "미국 금리 상승"
    assert U.normal("한은이 동결") == "한국은행이 동결"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, float("nan")], [1.0, 0.0]), (None, [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    got = df.select(V.cosine(F.col("a"), F.col("b")).alias("c"), V.is_valid(F.col("a"), 2).alias("v"), V.normalised(F.col("a"), 2).alias("n")).collect()
    assert got[0].c == pytest.approx(0.96) and got[0].n == pytest.approx([0.6, 0.8])
    assert [g.v for g in got] == [True, False, False, False, False] and got[1].c is None and got[4].c is None


def test_dates_and_payloads(spark, tmp_path):
    df = spark.createDataFrame([("Mon, 12 Oct 2026 09:00:00 +0900",), ("12 Foo 2026 09:00:00 +0900",), (None,)], "d string")
    got = [r.x for r in df.select(F.date_format(A.rfc822(F.col("d")), A.ISO).alias("x")).collect()]
    assert got == ["2026-10-12T00:00:00Z", None, None]
    naver = spark.createDataFrame([("<b>금리</b> &amp; 물가", "https://www.ex.com/a", "https://n.news.naver.com/1", "x", "Mon, 12 Oct 2026 09:00:00 +0900"), ("t", "", "https://evil.com/news.naver.com", "x", "")], "title string, originallink string, link string, description string, pubDate string")
    rows = A.from_naver(naver).collect()
    assert len(rows) == 1 and rows[0].title == "금리 & 물가" and rows[0].source == "ex.com"
    path = tmp_path / "m.json"
    path.write_text('{"status":"ok","totalResults":1,"articles":[{"source":{"name":"S"},"title":"T","description":null,"url":"http://u","publishedAt":"2026-01-01T00:00:00Z"}]}')
    r = A.read_fixture(spark, str(path)).first()
    assert (r.title, r.description, r.source) == ("T", "", "S") and re.fullmatch("[0-9a-f]{12}", r.news_id)


def test_pages(spark):
    df = spark.createDataFrame([(i, f"u{i % 4}", "k") for i in range(1, 9)], "position int, url string, k string")
    got = [(r.search_rank, r.url, r.search_end) for r in A.search_page(df, 2, 5, ["k"]).orderBy("search_rank").collect()]
    assert got == [(2, "u2", 6), (3, "u3", 6), (4, "u0", 6), (5, "u1", 6)]
    with pytest.raises(ValueError):
        A.search_page(df, 0, 5, ["k"])


def test_retry_after(spark):
    df = spark.createDataFrame([("7",), ("1 day, 00:00:05",), ("01:00:00",), ("soon",)], "t string")
    assert [r.x for r in df.select(A.retry_after_seconds(F.col("t")).alias("x")).collect()] == [7, 86405, 3600, None]


def test_body():
    text = "".join(f"<p>오늘 시장은 {i}번째 소식으로 크게 움직였으며 투자자들은 관망했다.</p>" for i in range(12))
    page = f"<html><head><meta property='og:title' content='아주 긴 기사 제목 하나입니다'></head><body><nav>메뉴 메뉴 메뉴 메뉴</nav><div id='article_body'><h1>아주 긴 기사 제목 하나입니다</h1>{text}<p>Copyright 2026 무단 전재</p><div class='ad'>광고 광고 광고 광고</div></div></body></html>"
    got = H.body(page)
    assert len(got.split("\n")) == 12 and "광고" not in got and "제목" not in got
    assert H.body("<p>short</p>") == "" and H.body(None) == ""
    assert H.body(page.replace("article_body", "x")).split("\n") == got.split("\n")  # no block: the paragraphs
    assert H.body(page.replace("article_body", "related")) == ""  # noise is cut off with all that is in it
    wide = f"<div id='content'><p>앞에 있는 짧은 안내 문장입니다</p><div class='story-body'>{text}</div></div>"
    assert H.body(wide).startswith("앞에 있는") and len(H.body(wide).split("\n")) == 13  # a block around it that adds little
    labels, image = H.page_labels("<em class='media_end_categorize_item'>경제</em><em class='media_end_categorize_item'>경제</em><meta property='og:image' content='i.png'>")
    assert labels == ["경제"] and image == "i.png"
