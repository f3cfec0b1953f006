from __future__ import annotations

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from presswork.functions import lexicon as L
from presswork.functions import words as P
from presswork.operators import dedupe as D
from presswork.operators import evidence as E
from presswork.operators import judgment as J
from presswork.operators import keywords as K
from presswork.operators import maps as M
from presswork.operators import selection as S
from presswork.operators import state as Q
from presswork.operators import tracking as T
from presswork.sources import sinks

T0, T1 = "2026-10-10T00:00:00Z", "2026-10-10T05:00:00Z"
LONG = "한국은행 금융통화위원회는 이날 기준금리를 연 2.5%로 동결한다고 밝혔다. 물가 상승률이 목표 수준에 근접했다는 판단에 따른 것이다."


CASES = [
    ((("코스피 급등", "", T0), ("새 스마트폰 공개", "", T0), 0.99), ("different_event", "no_shared_event")),
    ((("갤럭시 S12 공개", "", T0), ("갤럭시 S13 공개", "", T0), 0.95), ("different_event", "model")),
    ((("기준금리 인상", LONG, T0), ("기준금리 인하", LONG, T0), 0.99), ("different_event", "direction")),
    ((("코스피 3% 상승", "", T0), ("코스피 5% 상승", "", T0), 0.99), ("different_event", "figure")),
    ((("12일 코스피 상승", "", T0), ("15일 코스피 상승", "", T0), 0.99), ("different_event", "date")),
    ((("기준금리 동결", LONG, T0), ("기준금리 동결", LONG, "2026-10-13T00:00:00Z"), 0.99), ("different_event", "time")),
    ((("기준금리 동결", "", T0), ("기준금리 동결", "", T1), 0.99), ("repeat", "identical_text")),
    ((("기준금리 동결", LONG, T0), ("기준금리 동결", LONG, T1), 0.99), ("repeat", "repeated_information")),
    ((("기준금리 동결", LONG, T0), ("기준금리 동결", LONG, T1), 0.5), ("insufficient_evidence", "semantic_difference")),
    ((("기준금리 동결", LONG, None), ("기준금리 동결", LONG, T1), 0.99), ("insufficient_evidence", "time_unknown")),
    ((("기준금리 동결", "", None), ("기준금리 동결", "", T1), 0.99), ("insufficient_evidence", "short_text")),
    ((("기준금리 동결", LONG, T0), ("기준금리 동결, 환율 급등", LONG + " 환율 1400원", T1), 0.99), ("same_event_new_info", "title_addition")),
]


def judged(spark, cases):
    """Relation and reason of each ((article, article, cosine)) of cases."""
    articles = [(2 * i + k, *x[k]) for i, x in enumerate(cases) for k in (0, 1)]
    told = J.evidence(spark.createDataFrame(articles, "news_id int, title string, description string, published_at string"))
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1, float(x[2])) for i, x in enumerate(cases)], "a_id int, b_id int, cosine double")
    return [((r.relation, r.reason), r.features) for r in sorted(J.judge(pairs, told).collect(), key=lambda r: r.a_id)]


def test_judgment_rules(spark):
    got = judged(spark, [c for c, _ in CASES])
    assert [x for x, _ in got] == [want for _, want in CASES]


def test_each_text_is_judged_once(spark, monkeypatch):
    """Articles of equal texts and unlike times, none too: what judge gives of all, from one row a text."""
    cases = [c for c, _ in CASES] * 2 + [((None, "", T0), ("", None, T1), 0.99), (("ab", "c", T0), ("a", "bc", T0), 0.9)]
    articles = [(2 * i + j, *c[j]) for i, c in enumerate(cases) for j in (0, 1)] + [(999, "alone", "", None)]
    table = spark.createDataFrame(articles, "news_id int, title string, description string, published_at string")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1, c[2], q) for i, c in enumerate(cases) for q in (None, "금리")] + [(0, 12345, 0.9, None)], "a_id int, b_id int, cosine double, q string")
    every = lambda df: sorted(map(str, df.collect()))
    want = every(J.judge(pairs, J.evidence(table), query="q"))
    seen, own = [], J.evidence
    monkeypatch.setattr(J, "evidence", lambda some, *a: (seen.append(some.count()), own(some, *a))[1])
    got = J.judge_articles(pairs, table, query="q")
    assert every(got) == want and len(want) == 2 * len(cases)
    assert seen == [len({(a[1] or "", a[2] or "") for a in articles})] and seen[0] < len(articles) / 2


def test_judgment_is_directional_and_counts_what_is_new(spark):
    short, more = ("기준금리 동결", LONG, T0), ("기준금리 동결", LONG + " 이창용 한국은행 총재는 가계부채 누증과 수도권 집값 불안이 통화 완화를 늦췄다고 밝혔다.", T1)
    model = ("갤럭시 S12 울트라 공개", "", T0), ("갤럭시 S12 공개", "울트라 갤럭시 S12 울트라", T0)
    (there, f), (back, g), (_, m) = judged(spark, [(short, more, 0.99), (more, short, 0.99), (*model, 0.95)])
    assert there == ("same_event_new_info", "description_addition") and f.attributed and back == ("repeat", "repeated_information") and not g.attributed
    assert m.anchored and not m.model_clash and f.gap_hours == 5 and f.covered < 1 == g.covered
    empty = (None, None, None)
    assert judged(spark, [(empty, empty, 0.99)])[0][0] == ("different_event", "no_shared_event")


def test_figures_and_dates(spark):
    texts = ["수출 1209억달러", "수출 1200억달러", "10월 12일 발표, 3일간 진행", "우유 원유 가격", "국제 원유 가격", "이창용 한국은행 총재는", "산업통상부 장관은", "미국의 10년물 금리", "10년물 금리", "미국 2년물", "갤럭시 탭 S12 울트라"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    t = F.col("t")
    row = df.select("i", J.figures(t).alias("f"), J.dates(t).alias("d"), J.targets(t).alias("k"), J.people(t).alias("p"), J.model_lines(t).alias("m")).orderBy("i").collect()
    assert [(x.value, x.grain, x.unit, x.label, x.rounded) for x in row[0].f] == [(1209e8, 1e8, "달러", "수출", True)]
    assert [tuple(x) for x in row[2].d] == [(None, 10, 12)] and row[3].k == [] and "oil" in [x.family for x in row[4].k]
    assert row[5].p == ["이창용"] and row[6].p == [] and [tuple(x) for x in row[10].m] == [("s12울트라", "갤럭시탭")]
    assert [[tuple(x) for x in row[i].k if x.family == "bond"] for i in (7, 8, 9)] == [[("bond", "us", "10")], [("bond", "?", "10")], [("bond", "us", "2")]]
    pair = df.alias("a").join(df.alias("b")).where("a.i <= 9 and b.i <= 9").select(F.col("a.i").alias("a"), F.col("b.i").alias("b"), J.figures(F.col("a.t")).alias("x"), J.figures(F.col("b.t")).alias("y"), J.targets(F.col("a.t")).alias("p"), J.targets(F.col("b.t")).alias("q"))
    got = {(r.a, r.b): (r.same, r.known) for r in pair.select("a", "b", F.exists("x", lambda f: F.exists("y", lambda g: J.same_figure(f, g))).alias("same"), F.exists("p", lambda k: J.covered_by(k, F.col("q"))).alias("known")).collect()}
    assert got[0, 1][0] and got[7, 8][1] and not got[7, 9][1]
    amounts = spark.createDataFrame([("1조 2,000억",), ("3천",), ("3천만",), ("2.5",)], "n string").select(J.amount(F.col("n")).alias("x")).collect()
    assert [tuple(r.x) for r in amounts] == [(1.2e12, 1e8), (3000.0, 1000.0), (30_010_000.0, 10_000.0), (2.5, 0.1)]


def test_identity_dedupe_is_first_wins(spark):
    r = random.Random(2)
    rows = [(g, i, [f"k{r.randint(0, 12)}" for _ in range(r.randint(1, 3))]) for g in range(8) for i in range(20)]
    got = D.identity_dedupe(spark.createDataFrame(rows, "g int, i int, keys array<string>"), ["g"], [F.col("i")])
    want = []
    for g in range(8):
        seen: set = set()
        for _, i, keys in [x for x in rows if x[0] == g]:
            if not seen & set(keys):
                seen |= set(keys)
                want.append((g, i))
    assert sorted((x.g, x.i) for x in got.collect()) == want


def test_title_and_url_dedupe(spark):
    rows = [("k", 1, "u1", "oil price jumps again"), ("k", 2, "u1", "other words entirely here"), ("k", 3, "u2", "oil price jumps"), ("k", 4, "", "x"), ("k", 5, "u3", "central bank holds")]
    df = spark.createDataFrame(rows, "k string, i int, url string, title string")
    assert [r.i for r in D.title_overlap_dedupe(df, ["k"], [F.col("i")]).orderBy("i").collect()] == [1, 5]
    df = spark.createDataFrame([("k", 1, "a", "t" * 12), ("k", 2, "a", "z"), ("k", 3, "b", "t" * 12), ("k", 4, "", "t"), ("k", 5, "", "t")], "k string, i int, url_key string, title_key string")
    assert [r.i for r in D.url_or_title_dedupe(df, ["k"], [F.col("i")]).orderBy("i").collect()] == [1, 4, 5]


def test_mmr_matches_a_plain_loop(spark):
    r = np.random.default_rng(3)
    v = r.standard_normal((30, 8))
    score = r.random(30).round(3)
    df = spark.createDataFrame([(0, i, float(score[i]), v[i].tolist()) for i in range(30)], "g int, vec_id int, score double, embedding array<double>")
    got = [x.vec_id for x in S.mmr(df, ["g"], 5).orderBy("pick_order").collect()]
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    picks: list[int] = []
    while len(picks) < 5:
        left = [i for i in range(30) if i not in picks]
        value = lambda i: score[i] if not picks else 0.7 * score[i] - 0.3 * max(u[i] @ u[j] for j in picks)  # noqa: E731, B023
        picks.append(min(left, key=lambda i: (-round(value(i), 12), i)))
    assert got == picks
    roles = spark.createDataFrame([(0, i, 0.9 - 0.01 * i, "a" if i < 4 else "b", i) for i in range(6)], "g int, news_id int, score double, role string, search_rank int")
    assert [x.news_id for x in S.role_picks(roles, ["g"], 3).orderBy("pick_order").collect()] == [0, 4, 1]


def test_staged_map(spark):
    base = np.eye(6)[0]
    near = lambda k: (base + 0.6 * np.eye(6)[k]).tolist()
    rows = []
    for i, (title, gate, stage) in enumerate([("기준금리 동결", None, 0), ("환율 급등에 수출 기업 부담", None, 0), ("가계대출 증가세 둔화", None, 1), ("낮은 점수", "below_threshold", 0)]):
        text = LONG if i == 0 else f"{title} 소식은 금리 결정의 영향으로 풀이된다. 시장은 앞으로의 방향을 주목하고 있다는 분석이 나온다."
        rows.append(("c", "금리", "기준금리 동결", LONG, T0, f"n{i}", title, text, T1, 0.9 - i / 10, 0.99 if i == 0 else 0.8, near(i + 1), gate, stage))
    df = spark.createDataFrame(rows, "centre_id string, query string, centre_title string, centre_description string, centre_published_at string, news_id string, title string, description string, published_at string, score double, cosine double, embedding array<double>, gate string, stage int")
    out = {r.news_id: (r.outcome, r.pick_order) for r in S.staged_map(df, 1).collect()}
    assert out["n0"][0] == "center_repeat" and out["n3"][0] == "below_threshold" and out["n1"] == ("picked", 1) and out["n2"][0] == "not_reached"
    more = {r.news_id: (r.outcome, r.pick_order) for r in S.staged_map(df, 2).collect()}
    assert more["n1"] == ("picked", 1) and more["n2"] == ("picked", 2)  # earlier picks stay first
    shuffled = df.orderBy(F.rand(5))
    assert {r.news_id: (r.outcome, r.pick_order) for r in S.staged_map(shuffled, 2).collect()} == more


def test_clusters_of_a_plain_linkage():
    r = np.random.default_rng(4)
    for _ in range(10):
        n = int(r.integers(2, 12))
        v, q = r.standard_normal((n, 5)), r.standard_normal(5)
        titles = [str(r.choice(["금리 상승", "금리 하락", "환율 급등", "수출 증가"])) for _ in range(n)]
        assert K.clustered(titles, v, q, 0.2) == linkage(titles, v, q, 0.2)


def linkage(titles, vectors, query, threshold):
    """The same by recomputing every mean."""
    q = query / np.linalg.norm(query)
    rest = vectors - np.outer(vectors @ q, q)
    rest /= np.linalg.norm(rest, axis=1, keepdims=True)
    n = len(titles)
    grams = [P.grams(P.tokens(t)) for t in titles]
    lex = np.array([[1.0 if i == j else P.dice(grams[i], grams[j]) for j in range(n)] for i in range(n)])
    sim = 0.65 * rest @ rest.T + 0.35 * lex
    groups = [[i] for i in range(n)]
    while len(groups) > 1:
        best, pair = -1.0, None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                signs = {K.polarity(titles[x]) for x in groups[i] + groups[j]} - {0}
                if len(signs) > 1 and lex[np.ix_(groups[i], groups[j])].mean() < 0.45:
                    continue
                s = sim[np.ix_(groups[i], groups[j])].mean()
                if s > best + 1e-12:
                    best, pair = s, (i, j)
        if pair is None or best < threshold:
            break
        groups[pair[0]] += groups.pop(pair[1])
    return sorted(groups, key=len, reverse=True)


def test_keyword_map(spark):
    r = np.random.default_rng(5)
    a, b = r.standard_normal(8), r.standard_normal(8)
    titles = ["삼성전자 반도체 수출 증가", "삼성전자 반도체 수출 회복", "반도체 수출 증가 전망", "테슬라 전기차 판매 감소", "테슬라 전기차 판매 부진", "전기차 판매 감소"]
    rows = [("경제", r.standard_normal(8).tolist(), i, f"n{i}", t, "", ((a if i < 3 else b) + 0.1 * r.standard_normal(8)).tolist()) for i, t in enumerate(titles)]
    q = rows[0][1]
    df = spark.createDataFrame([(x[0], q, *x[2:]) for x in rows], "query string, query_vector array<double>, search_rank int, news_id string, title string, description string, embedding array<double>")
    nodes = K.keyword_map(df).orderBy("position").collect()
    assert nodes[0].kind == "center" and nodes[0].article_count == 6
    issues = [n for n in nodes if n.kind == "issue"]
    assert {tuple(sorted(n.news_ids)) for n in issues} == {("n0", "n1", "n2"), ("n3", "n4", "n5")}
    assert {"삼성전자", "테슬라"} <= {n.keyword for n in nodes if n.kind == "entity"}
    mean = lambda part: [float(x) for x in np.mean([y[5] for y in part], axis=0)]
    for label in ("반도체 수출", "반도체 수출 증가"):
        given = df.withColumn("label_vectors", F.create_map(F.lit(label), F.lit(mean([(*x[:5], x[6]) for x in rows[:3]]))))
        assert label in {n.keyword for n in K.keyword_map(given).where("kind = 'issue'").collect()}


def test_entities_take_longest_first():
    names = K.alias_patterns({"A": ("삼성전자",), "B": ("삼성",), "C": ("AI",)})
    assert K.entities_in("삼성전자 AI", names) == {"A", "C"} and K.entities_in("CHAIR 삼성", names) == {"B"}


def test_quota_and_budget(spark):
    rows = [("s", float(t), u) for t, u in [(0, "a"), (10, "a"), (20, "a"), (30, "b"), (40, "b"), (3599, "a"), (3600, "a"), (7300, "b")]]
    got = Q.quota(spark.createDataFrame(rows, "action string, at double, user string"), {"": 4, "user": 2}).orderBy("at").collect()
    assert [r.accepted for r in got] == [True, True, False, True, True, False, True, True]
    assert got[2].retry_after == 3580 and got[5].retry_after == 1
    charges = spark.createDataFrame([("l", 0.0, "j", 5), ("l", 1.0, "j", 5), ("l", 2.0, "k", 5), ("l", 3.0, "m", 1), ("l", 60000.0, "n", 8)], "ledger string, at double, job_id string, units int")
    assert [r.status for r in Q.budget(charges, daily=11, per_job=8).orderBy("at").collect()] == ["charged", "job_exceeded", "charged", "charged", "charged"]


def test_jobs_sessions_and_revisions(spark):
    cmd = spark.createDataFrame([("j", 0.0, "claim", "w1"), ("j", 1.0, "claim", "w2"), ("j", 70.0, "claim", "w2"), ("j", 75.0, "heartbeat", "w1"), ("j", 80.0, "succeeded", "w2"), ("j", 90.0, "cancel", "")], "job_id string, at double, command string, worker string")
    assert [(r.status, r.outcome) for r in Q.jobs(cmd).orderBy("at").collect()] == [("running", "ok"), ("running", "busy"), ("running", "ok"), ("running", "lease_lost"), ("succeeded", "ok"), ("succeeded", "ended")]
    s = spark.createDataFrame([("s", 0.0, "touch", ""), ("s", 1.0, "create", ""), ("s", 2.0, "view", "a"), ("s", 3.0, "view", "b"), ("s", 4.0, "view", "a"), ("s", 90000.0, "touch", ""), ("s", 90001.0, "create", ""), ("s", 90002.0, "delete", ""), ("s", 90003.0, "touch", "")], "sid string, at double, command string, item string")
    got = Q.sessions(s).orderBy("at").collect()
    assert [r.code for r in got] == [404, 200, 200, 200, 200, 404, 200, 200, 410] and got[4].viewed == ["b", "a"]
    w = spark.createDataFrame([("k", 1, 0), ("k", 2, 0), ("k", 3, 1)], "key string, seq int, expected int")
    assert [(r.accepted, r.revision) for r in Q.compare_and_set(w).orderBy("seq").collect()] == [(True, 1), (False, 1), (True, 2)]


def test_map_commands(spark):
    rows = [("m", 1, "create", 0, None, "c", ["a", "b"]), ("m", 2, "expand", 1, "n2", None, ["d", "a"]), ("m", 3, "expand", 1, "n2", None, ["e"]), ("m", 4, "research", 2, "n2", None, []), ("m", 5, "research", 3, "n2", None, ["f"]), ("m", 6, "reset", 4, None, None, ["g"]), ("m", 7, "delete", 5, None, None, []), ("m", 8, "select", 6, None, None, ["g"])]
    got = M.replay(spark.createDataFrame(rows, "map_id string, seq int, command string, expected int, node_id string, article string, found array<string>")).orderBy("seq").collect()
    assert [r.code for r in got] == ["ok", "ok", "revision_conflict", "ok", "ok", "ok", "ok", "gone"]
    assert got[1].visible == ["a", "b", "c", "d"] and got[3].visible == got[1].visible and got[4].visible == ["a", "b", "c", "f"] and got[5].visible == ["c", "g"]


def test_reports(spark):
    raw = '```json\n{"title":"t","event_summary":"s","event_analysis":"a","market_impact":"m","stock_impacts":[{"ticker":null,"name":"x","impact":"i","direction":"up","evidence_news_ids":["1"]}],"risk_factors":[],"claims":[{"claim_id":"c1","text":"x","kind":"fact","evidence":[{"news_id":"1","sentence":"s"}]},{"claim_id":"c1","text":"y","kind":"fact","evidence":[{"news_id":"1","sentence":"s"}]},{"claim_id":"c99","text":"y","kind":"fact","evidence":[]}]}\n```'
    df = spark.createDataFrame([(raw, ["1"]), (raw, ["2"]), ("[]", ["1"]), ("x", ["1"]), ("", ["1"])], "raw string, ids array<string>")
    r = E.parse_report(F.col("raw"))
    got = df.select(E.parse_status(F.col("raw")).alias("p"), E.report_status(r, F.col("ids")).alias("s"), F.size(E.valid_claims(r["claims"])).alias("n")).collect()
    assert [g.p for g in got] == ["ok", "ok", "json_not_object", "invalid_json", "empty_response"]
    assert [g.s for g in got] == ["ok", "unused_evidence", "invalid_report", "invalid_report", "invalid_report"] and got[0].n == 1


def test_claims(spark):
    claims = spark.createDataFrame([("r", "c1", 1, True), ("r", "c2", 2, True), ("r", "c3", 3, False)], "rid string, claim_id string, position int, sentence_found boolean")
    verdicts = spark.createDataFrame([("r", "c1", "supported", "  ok  fine "), ("r", "c2", "refuted", None), ("r", "c2", "supported", None), ("r", "c3", "supported", None)], "rid string, claim_id string, verdict string, reason string")
    got = {r.claim_id: (r.verdict, r.reason) for r in E.verify_claims(claims, verdicts, ["rid"]).collect()}
    assert got == {"c1": ("supported", "ok fine"), "c2": ("unclear", "verdict_omitted"), "c3": ("unclear", "sentence_missing")}
    s = E.claim_summary(E.verify_claims(claims, verdicts.limit(0), ["rid"]), ["rid"]).first()
    assert s.status == "unavailable" and s.problems == 1
    quotes = spark.createDataFrame([("r", "c1", [("1", "3% 상승")]), ("r", "c2", [("1", "3% 상승"), ("2", "없음")])], "rid string, claim_id string, refs array<struct<news_id:string,sentence:string>>")
    bodies = spark.createDataFrame([("r", "1", "오늘 3% 상승 마감")], "rid string, news_id string, input_excerpt string")
    assert {r.claim_id: r.sentence_found for r in E.check_quotes(quotes, bodies, ["rid"]).collect()} == {"c1": True, "c2": False}


def test_tracking_has_no_look_ahead(spark):
    days = pd.bdate_range("2026-10-19", periods=8)
    bench = spark.createDataFrame([(d.date(), 100.0 + i) for i, d in enumerate(days)], "day date, close double")
    prices = spark.createDataFrame([("A", d.date(), 10.0 + i) for i, d in enumerate(days) if i != 2], "ticker string, day date, close double")
    items = spark.createDataFrame([(1, "A", "buy", days[0].date()), (2, "A", "sell", days[5].date()), (3, "B", "buy", days[0].date()), (4, "A", "buy", days[1].date())], "item_id int, ticker string, action string, t0 date")
    got = {(r.item_id, r.horizon): (r.status, r.return_pct, r.direction) for r in T.horizons(items, prices, bench, F.lit(str(days[6].date())).cast("date")).collect()}
    assert got[1, 1] == ("price_missing", None, None) and got[1, 5] == ("ok", 45.4545, "match") and got[1, 10][0] == "not_due"
    assert got[2, 1][0] == "not_due" and got[3, 1][0] == "price_missing" and got[4, 1][0] == "price_missing"


def test_entry_days_by_bisection(spark):
    import bisect
    import datetime as dt

    r = random.Random(6)
    start = dt.date(2026, 10, 1)
    days = sorted({start + dt.timedelta(r.randrange(60)) for _ in range(20)})
    at = [start + dt.timedelta(k) for k in range(-5, 70)]
    table = spark.createDataFrame([(d, i, 1.0) for i, d in enumerate(days)], "day date, idx int, index_close double")
    got = {x.t0: x.entry_idx for x in T.entry_days(spark.createDataFrame([(d,) for d in at], "t0 date"), table).collect()}
    assert got == {d: (k if (k := bisect.bisect_right(days, d)) < len(days) else None) for d in at}


def test_vector_top_k_of_many_centres(spark, monkeypatch):
    monkeypatch.setattr(S, "CENTRE_BLOCK", 4)
    r = np.random.default_rng(8)
    v = np.repeat(r.standard_normal((40, 6)), 3, axis=0)  # ties by the row's id
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(120)] + [(500, None), (501, [0.0] * 6)], "vec_id int, embedding array<double>").repartition(5)
    got = sorted((x.centre, x["rank"], x.vec_id) for x in S.vector_top_k(df, df.where("vec_id % 11 = 0"), 5, dims=6).collect())
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = [(c, k + 1, i) for c in range(0, 120, 11) for k, i in enumerate(sorted((i for i in range(120) if i != c), key=lambda i: (-round(float(u[c] @ u[i]), 12), i))[:5])]
    assert got == sorted(want)
    assert S.vector_top_k(df, df.where("vec_id < 0"), 5, dims=6).count() == 0


@pytest.mark.parametrize("most", [6, 1000])
def test_loose_quotes(spark, monkeypatch, most):
    monkeypatch.setattr(E, "QUOTE_BYTES", most)
    q = spark.createDataFrame([(1, "ab  cd"), (2, "ab cd"), (3, "b c"), (4, " "), (5, None), (6, "zz")], "q int, quote string")
    b = spark.createDataFrame([(1, "x ab\ncd y"), (2, None), (3, "xab cdz ab cd"), (4, "none")], "b int, body string")
    assert sorted((x.b, x.q) for x in E.loose_quotes(q, b, "quote", "body").collect()) == [(i, k) for i in (1, 3) for k in (1, 2, 3)]
    assert E.loose_quotes(q.where("q = 4"), b, "quote", "body").count() == 0


def test_trees_of_two_calls_dont_mix(spark):
    a = M.descendants(spark.createDataFrame([(1, 1, None), (1, 2, 1)], "map_id int, node_id int, parent_id int"))
    b = M.descendants(spark.createDataFrame([(2, 7, None)], "map_id int, node_id int, parent_id int"))
    assert a.count() == 3 and b.count() == 1 and not [t.name for t in spark.catalog.listTables() if "map" in t.name]


def test_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", "t", "v"), (2, "b", "t", None)], "id int, x string, created_at string, vector string")
    new = spark.createDataFrame([(1, "A", "n", None), (3, "c", "n", None), (3, "d", "n", None)], "id int, x string, created_at string, vector string")
    got = {r.id: (r.x, r.created_at, r.vector) for r in sinks.upsert(old, new, "id", keep=("created_at",), order="x").collect()}
    assert got == {1: ("A", "t", None), 2: ("b", "t", None), 3: ("d", "n", None)}
    sinks.write_csv(spark.createDataFrame([("=1", 2)], "a string, b int"), str(tmp_path / "o"), ["b", "a"])
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).first().asDict() == {"b": "2", "a": "'=1"}
    blind, key = sinks.blinded(spark.createDataFrame([(i, "ab"[i % 2]) for i in range(6)], "id int, arm string"), "id", "arm", 7)
    assert "arm" not in blind.columns and sorted(r.sample for r in key.collect()) == [f"sample-{i:03d}" for i in range(1, 7)]


def test_relevance_and_gate(spark):
    df = spark.createDataFrame([(0.8, ["연준", "금리"], ["연준"]), (0.8, ["금리"], ["금리", "물가"]), (0.1, ["금리"], ["금리"])], "cos double, c array<string>, t array<string>")
    entities = F.array(*[F.lit(n.lower()) for n in L.ENTITY_NAMES])
    s = S.relevance(F.col("cos"), F.col("c"), F.col("t"), entities)
    got = df.select(s.alias("s"), S.gate(s, F.col("c"), F.col("t"), entities).alias("g")).collect()
    assert [round(r.s, 6) for r in got] == [0.62, 0.77, 0.19] and [r.g for r in got] == ["below_threshold", None, "below_threshold"]
