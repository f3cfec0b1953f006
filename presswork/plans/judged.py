"""Repeat judgments and staged selections over texts made of the test tables.

The texts are headlines with figures, dates and models put together from a row's numbers; the oracle
knows the numbers alone and says what a reader would conclude from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import judgment as J
from ..operators import keywords as K
from ..operators import selection as S
from ..sources.tables import stored, table
from .registered import Plans

plans = Plans()

RULING = "한국은행 금융통화위원회는 이날 기준금리를 연 2.5%로 동결한다고 밝혔다. 물가 상승률이 목표 수준에 근접했다는 판단에 따른 것이다."
SPOKEN = " 이창용 한국은행 총재는 가계부채 누증과 수도권 집값 불안이 통화 완화를 늦췄다고 밝혔다."
TWELVE = 12


def _pairs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two articles for each customer, by the customer's number, and their pairs."""
    k = F.col("c_custkey")
    case, n, step = k % TWELVE, (F.floor(k / TWELVE) % 40 + 5).cast("string"), F.floor(k / TWELVE)
    m = (F.floor(k / TWELVE) % 40 + 5 + step % 2).cast("string")
    day, other = (step % 27 + 1).cast("string"), ((step + step % 3) % 27 + 1).cast("string")
    move = lambda x: F.element_at(F.array(*[F.lit(w) for w in ("인상", "인하", "동결")]), (x % 3 + 1).cast("int"))
    hold = F.lit("기준금리 동결")
    row = lambda *x: F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(c) for v, c in zip(x, ("title", "description", "hours"), strict=True)])
    start, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    cases = [
        (row("코스피 급등", "", start), row("새 스마트폰 공개", "", start)),
        (row(F.concat(F.lit("갤럭시 S"), n, F.lit(" 공개")), "", start), row(F.concat(F.lit("갤럭시 S"), m, F.lit(" 공개")), "", start)),
        (row(F.concat(F.lit("기준금리 "), move(step)), RULING, start), row(F.concat(F.lit("기준금리 "), move(F.floor(step / 2))), RULING, start)),
        (row(F.concat(F.lit("코스피 "), n, F.lit("% 상승")), "", start), row(F.concat(F.lit("코스피 "), m, F.lit("% 상승")), "", start)),
        (row(F.concat(day, F.lit("일 코스피 상승")), "", start), row(F.concat(other, F.lit("일 코스피 상승")), "", start)),
        (row(hold, RULING, start), row(hold, RULING, (step % 97).cast("long"))),
        (row(hold, RULING, start), row(hold, RULING, start)),
        (row(hold, RULING, none), row(hold, RULING, start)),
        (row(hold, "", none), row(hold, "", start)),
        (row(hold, RULING, start), row("기준금리 동결, 환율 급등", RULING + " 환율 1400원", start)),
        (row(hold, RULING, start), row(hold, RULING + SPOKEN, F.lit(5).cast("long"))),
        (row(hold, RULING + SPOKEN, start), row(hold, RULING, F.lit(5).cast("long"))),
    ]
    chosen = lambda side: F.element_at(F.array(*[c[side] for c in cases]), (case + 1).cast("int"))
    c = table(spark, sf, "customer").select(k, chosen(0).alias("a"), chosen(1).alias("b"), F.when(case == 6, (900 + 10 * (step % 8)) / 1000).otherwise(0.99).alias("cosine"))
    stamp = lambda s: F.date_format(F.timestamp_seconds(F.lit(1_760_054_400) + F.col(f"{s}.hours") * 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    side = lambda s, at: c.select((F.col("c_custkey") * 2 + at).alias("news_id"), F.col(f"{s}.title").alias("title"), F.col(f"{s}.description").alias("description"), stamp(s).alias("published_at"))
    return c.select("c_custkey", (F.col("c_custkey") * 2).alias("a_id"), (F.col("c_custkey") * 2 + 1).alias("b_id"), "cosine"), side("a", 0).unionByName(side("b", 1))


@plans.add("""WITH k AS (SELECT c_custkey, c_custkey % 12 AS c, c_custkey // 12 AS s FROM customer),
    f AS (SELECT *, CASE c WHEN 5 THEN (s % 97)::DOUBLE WHEN 7 THEN NULL WHEN 8 THEN NULL WHEN 10 THEN 5.0 WHEN 11 THEN 5.0 ELSE 0.0 END AS gap_hours, CASE WHEN c = 6 THEN (900 + 10 * (s % 8)) / 1000 ELSE 0.99 END AS cosine FROM k),
    r AS (SELECT *, CASE WHEN c = 0 THEN 'no_shared_event' WHEN c = 1 AND s % 2 = 1 THEN 'model' WHEN c = 2 AND s % 3 <> (s // 2) % 3 THEN 'direction' WHEN c = 3 AND s % 2 = 1 THEN 'figure' WHEN c = 4 AND s % 3 > 0 THEN 'date' WHEN c = 5 AND gap_hours > 48 THEN 'time'
        WHEN c = 9 THEN 'title_addition' WHEN c IN (1, 3, 4) THEN 'identical_text' WHEN c = 8 THEN 'short_text' WHEN c = 10 THEN 'description_addition' WHEN cosine < 0.92 THEN 'semantic_difference' WHEN c = 7 THEN 'time_unknown' ELSE 'repeated_information' END AS reason FROM f)
    SELECT c_custkey, reason, CASE WHEN reason IN ('no_shared_event', 'model', 'direction', 'figure', 'date', 'time') THEN 'different_event' WHEN reason IN ('title_addition', 'description_addition') THEN 'same_event_new_info' WHEN reason IN ('identical_text', 'repeated_information') THEN 'repeat' ELSE 'insufficient_evidence' END AS relation,
      reason = 'semantic_difference' AS withheld, gap_hours FROM r""")
def repeat_judgments(spark: SparkSession, sf: str) -> DataFrame:
    """What the second of two articles tells a reader of the first."""
    pairs, articles = _pairs(spark, sf)
    judged = J.judge_articles(pairs, stored(articles, "articles"))  # else the cases are made again for each column
    return judged.select("c_custkey", "reason", "relation", "withheld", F.col("features.gap_hours").alias("gap_hours"))


@plans.add("""WITH k AS (SELECT c_custkey, c_custkey % 12 AS c, c_custkey // 12 AS s FROM customer)
    SELECT c_custkey, CASE c WHEN 0 THEN 'stocks' WHEN 1 THEN '' WHEN 3 THEN 'stocks' WHEN 4 THEN 'stocks' ELSE 'policy_rate' END AS targets, CASE WHEN c = 1 THEN 's' || (s % 40 + 5) ELSE '' END AS models, CASE WHEN c = 3 THEN (s % 40 + 5)::DOUBLE END AS figure,
      CASE WHEN c = 4 THEN (s % 27 + 1)::INT ELSE 0 END AS day, CASE WHEN c = 2 THEN ['hike', 'cut', 'hold'][s % 3 + 1] WHEN c >= 5 THEN 'hold' ELSE '' END AS decisions, CASE WHEN c IN (0, 3, 4) THEN 'up' ELSE '' END AS price, CASE WHEN c = 1 THEN 'announce' ELSE '' END AS stages,
      CASE WHEN c = 11 THEN '이창용,한국은행' WHEN c IN (2, 5, 6, 7, 9, 10) THEN '한국은행' ELSE '' END AS names FROM k""")
def headline_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """What the first article of each pair states in its headline, and whom it names."""
    pairs, articles = _pairs(spark, sf)
    told = J.evidence(articles)
    e = pairs.join(told, F.col("a_id") == F.col("news_id"))
    join = lambda c: F.array_join(F.array_sort(c), ",")
    h = F.col("told.head")
    return e.select(
        "c_custkey", join(F.transform(h["targets"], lambda t: t["family"])).alias("targets"), join(h["models"]).alias("models"), F.try_element_at(h["figures"], F.lit(1))["value"].alias("figure"),
        F.coalesce(F.try_element_at(h["dates"], F.lit(1))["day"], F.lit(0)).alias("day"), join(h["decisions"]).alias("decisions"), join(h["price"]).alias("price"), join(h["stages"]).alias("stages"),
        join(F.filter(F.col("told.name_keys"), lambda n: n.isin("한국은행", "이창용"))).alias("names"),
    )


@plans.add("""WITH j AS (SELECT o_orderkey % 997 AS news_id, (o_orderkey // 997) % 4 AS batch, o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') AS different FROM orders),
    d AS (SELECT news_id, batch FROM j GROUP BY 1, 2 HAVING bool_and(different)) SELECT news_id, batch FROM d WHERE batch = (SELECT min(batch) FROM d)""")
def first_distinct_issues(spark: SparkSession, sf: str) -> DataFrame:
    """Candidates that no earlier centre has told of, of the first batch that has any."""
    k = F.col("o_orderkey")
    o = table(spark, sf, "orders").select((k % 997).alias("news_id"), (F.floor(k / 997) % 4).alias("batch"), F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "repeat").otherwise("different_event").alias("relation"))
    return S.distinct_issues(o)


TOPICS = (
    ("태양광 패널 수명", "경제 소식지는 사막 지역 태양광 패널이 모래 폭풍의 영향으로 예정보다 빨리 닳는 문제를 다루었다고 적었다"),
    ("도서관 야간 개관", "경제 소식지는 시골 도서관이 밤에도 문을 여는 제도가 주민 교류의 영향으로 자리를 잡아 가는 모습을 그렸다"),
    ("항만 크레인 자동화", "경제 소식지는 남쪽 항만의 무인 크레인이 날씨의 영향으로 멈추는 까닭을 기술자들에게 물어 꼼꼼히 살펴보았다"),
    ("전통 한지 공방", "경제 소식지는 한지 공방 장인들이 닥나무 값의 영향으로 문을 닫는 마을을 찾아가 오래된 솜씨를 사진에 담았다"),
    ("바다 숲 되살리기", "경제 소식지는 해녀들이 수온의 영향으로 사라진 바다 숲에 해초를 다시 심는 봉사 활동을 여러 날 함께하였다"),
)
PICKS, FIRST = 4, 8


def _candidates(spark: SparkSession, sf: str) -> DataFrame:
    """For each label a centre (its first vector) and its 16 nearest, eight in the first stage; texts by number."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    centre = e.groupBy("label").agg(F.min("vec_id").alias("centre"), F.min_by("embedding", "vec_id").alias("c"))
    near = e.join(centre, "label").where("vec_id <> centre").withColumn("cosine", V.cosine(F.col("c"), F.col("embedding")))
    near = S.top_by_relevance(near.withColumns({"score": F.round("cosine", 9), "description": F.lit("")}), ["label"], 16, keys=("vec_id",))
    text = lambda n, i: F.element_at(F.array(*[F.lit(t[i]) for t in TOPICS]), (n % len(TOPICS) + 1).cast("int"))
    return near.select(
        F.col("label").alias("centre_id"), F.lit("경제").alias("query"), text(F.col("centre"), 0).alias("centre_title"), text(F.col("centre"), 1).alias("centre_description"), F.lit("2026-10-10T00:00:00Z").alias("centre_published_at"),
        F.col("vec_id").alias("news_id"), text(F.col("vec_id"), 0).alias("title"), text(F.col("vec_id"), 1).alias("description"), F.lit("2026-10-10T03:00:00Z").alias("published_at"), "score", "cosine", "embedding",
        F.when(F.col("score") < 0, "below_threshold").alias("gate"), F.when(F.col("relevance_rank") > FIRST, 1).otherwise(0).alias("stage"),
    )


NEAREST = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), c AS (SELECT label, min(vec_id) AS centre FROM v GROUP BY 1),
    n AS (SELECT v.label, v.vec_id, v.v, x.centre, list_cosine_similarity(v.v, y.v) AS cosine FROM v JOIN c x ON v.label = x.label JOIN v y ON y.vec_id = x.centre WHERE v.vec_id <> x.centre),
    k AS (SELECT * FROM (SELECT *, round(cosine, 9) AS score, row_number() OVER (PARTITION BY label ORDER BY round(cosine, 9) DESC, vec_id) AS relevance_rank FROM n) WHERE relevance_rank <= 16)"""


@plans.add(f"WITH {NEAREST} SELECT label AS centre_id, vec_id AS news_id, score, (relevance_rank > {FIRST})::INT AS stage FROM k")
def nearest_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return _candidates(spark, sf).select("centre_id", "news_id", "score", "stage")


def _staged_sql() -> str:
    sizes = "[" + ", ".join(str(len(d)) for _, d in TOPICS) + "]"
    return f"""WITH RECURSIVE {NEAREST},
    p AS (SELECT *, vec_id % 5 AS topic, (relevance_rank > {FIRST})::INT AS stage, CASE WHEN score < 0 THEN 'below_threshold' WHEN vec_id % 5 = centre % 5 THEN CASE WHEN cosine >= 0.92 THEN 'center_repeat' ELSE 'withheld' END END AS out, {sizes}[vec_id % 5 + 1] AS size FROM k),
    r AS (SELECT * FROM p WHERE out IS NULL), s AS (SELECT a.label, a.vec_id AS i, b.vec_id AS j, list_cosine_similarity(a.v, b.v) AS cos FROM r a JOIN r b ON a.label = b.label AND a.vec_id <> b.vec_id),
    w AS (SELECT label, 0 AS pick_order, NULL::BIGINT AS vec_id, []::BIGINT[] AS chosen, []::BIGINT[] AS topics FROM (SELECT DISTINCT label FROM p)
      UNION ALL SELECT label, pick_order + 1, pick.id, list_append(chosen, pick.id), list_append(topics, pick.topic) FROM (
        SELECT label, pick_order, chosen, topics, arg_min({{'id': vec_id, 'topic': topic}}, (stage, -round(CASE WHEN near IS NULL THEN score ELSE 0.7 * score - 0.3 * near END, 12), -score, -size, vec_id)) AS pick FROM (
          SELECT w.label, w.pick_order, w.chosen, w.topics, r.vec_id, r.topic, r.stage, r.score, r.size, max(s.cos) AS near
          FROM w JOIN r ON r.label = w.label AND NOT list_contains(w.topics, r.topic) LEFT JOIN s ON s.label = r.label AND s.i = r.vec_id AND list_contains(w.chosen, s.j) GROUP BY ALL) GROUP BY 1, 2, 3, 4) WHERE pick_order < {PICKS}),
    g AS (SELECT label, max(pick_order) AS n, arg_max(chosen, pick_order) AS chosen FROM w GROUP BY 1),
    e AS (SELECT g.label, g.chosen, (len(list_filter(g.chosen, lambda x: list_contains(f.first, x))) < {PICKS})::INT AS reached FROM g JOIN (SELECT label, coalesce(list(vec_id) FILTER (stage = 0), []) AS first FROM p GROUP BY 1) f USING (label)),
    b AS (SELECT s.i, arg_min(s.cos, list_position(e.chosen, s.j)) AS cos FROM s JOIN e USING (label) JOIN r x ON x.vec_id = s.i JOIN r y ON y.vec_id = s.j WHERE list_contains(e.chosen, s.j) AND x.topic = y.topic GROUP BY 1)
    SELECT p.label AS centre_id, p.vec_id AS news_id, CASE WHEN p.stage > e.reached THEN 'not_reached' WHEN list_contains(e.chosen, p.vec_id) THEN 'picked' WHEN p.out IS NOT NULL THEN p.out WHEN b.cos >= 0.92 THEN 'neighbour_repeat' WHEN b.cos IS NOT NULL THEN 'withheld' ELSE 'remaining' END AS outcome,
      CASE WHEN list_contains(e.chosen, p.vec_id) THEN list_position(e.chosen, p.vec_id)::INT ELSE 0 END AS pick_order FROM p JOIN e ON p.label = e.label LEFT JOIN b ON b.i = p.vec_id"""


@plans.add(_staged_sql())
def staged_selection(spark: SparkSession, sf: str) -> DataFrame:
    """The whole selection around each label's first vector."""
    return S.staged_map(_candidates(spark, sf), PICKS).withColumn("pick_order", F.coalesce("pick_order", F.lit(0)))


@plans.add(f"""WITH RECURSIVE {NEAREST}, r AS (SELECT label, vec_id, score, vec_id % 4 AS role, relevance_rank AS rank FROM k),
    w AS (SELECT label, 0 AS pick_order, NULL::BIGINT AS vec_id, []::BIGINT[] AS chosen, []::BIGINT[] AS roles FROM (SELECT DISTINCT label FROM r)
      UNION ALL SELECT label, pick_order + 1, pick.id, list_append(chosen, pick.id), list_append(roles, pick.role) FROM (
        SELECT w.label, w.pick_order, w.chosen, w.roles, arg_min({{'id': r.vec_id, 'role': r.role}}, (-round(r.score * 3 - 0.3 * len(list_filter(w.roles, lambda x: x = r.role)), 12), r.rank, r.vec_id)) AS pick
        FROM w JOIN r ON r.label = w.label AND NOT list_contains(w.chosen, r.vec_id) GROUP BY ALL) WHERE pick_order < 6)
    SELECT label AS centre_id, vec_id AS news_id, pick_order FROM w WHERE pick_order > 0""".replace("GROUP BY ALL) WHERE pick_order < 6", "GROUP BY 1, 2, 3, 4) WHERE pick_order < 6"))
def picks_by_role(spark: SparkSession, sf: str) -> DataFrame:
    """Six of each label's candidates, the most helpful first, roles that are taken put back."""
    rows = _candidates(spark, sf).withColumns({"role": (F.col("news_id") % 4).cast("string"), "search_rank": F.row_number().over(S.Window.partitionBy("centre_id").orderBy(F.col("score").desc(), "news_id"))})
    return S.role_picks(rows, ["centre_id"], 6)


def probability(at: int, names: tuple[str, ...]) -> Column:
    """A distribution over names from neighbouring vector components."""
    part = F.transform(F.slice(F.col("embedding").cast("array<double>"), at, len(names)), F.abs)
    total = F.aggregate(part, F.lit(0.0), lambda s, x: s + x)
    return F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.transform(part, lambda x: x / total))


@plans.add("""WITH a AS (SELECT vec_id, list_transform(embedding[1:2]::DOUBLE[], lambda x: abs(x)) AS p FROM embeddings), n AS (SELECT vec_id, p[1] / list_sum(p) AS r, p[2] / list_sum(p) AS u FROM a)
    SELECT vec_id, r >= 0.7 AS redundant, vec_id % 3 <> 1 AS valid FROM n""")
def decision_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Redundancy, and whether an answer is a distribution over the names asked for."""
    e = table(spark, sf, "embeddings").select("vec_id", probability(1, ("redundant", "useful")).alias("p"))
    bad = F.map_from_arrays(F.array(F.lit("redundant"), F.lit("useful")), F.array(F.lit(0.5), F.lit(0.6)))
    return e.select("vec_id", S.redundant(F.col("p")).alias("redundant"), S.is_distribution(F.when(F.col("vec_id") % 3 == 1, bad).otherwise(F.col("p")), ("redundant", "useful")).alias("valid"))


ISSUES = ("조선소 증설", "항만 파업", "쌀값 협상", "철강 담합", "우주 발사", "백신 승인")
UPTO = (14, 24, 31, 36, 39, 40)  # ranks at which an issue's articles end
MENTIONS = (("삼성전자", 4, 0), ("엔비디아", 8, 1), ("테슬라", 16, 2), ("한국은행", 40, 39))


def _keyword_map_sql() -> str:
    topic = "CASE " + " ".join(f"WHEN r <= {n} THEN {i}" for i, n in enumerate(UPTO)) + " END"
    names = ", ".join(f"('{n}', {m}, {k})" for n, m, k in MENTIONS)
    titles = "[" + ", ".join(f"'{t}'" for t in ISSUES) + "]"
    return f"""WITH a AS (SELECT label, r, ({topic} + label) % 6 AS topic FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) WHERE r <= 40), t AS (SELECT label, count(*) AS n FROM a GROUP BY 1),
    i AS (SELECT label, {titles}[topic + 1] AS keyword, count(*) AS c, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC) AS k FROM a GROUP BY label, topic HAVING count(*) >= 2),
    e AS (SELECT label, name AS keyword, count(*) AS c, row_number() OVER (PARTITION BY label ORDER BY count(*) * ln(1 + any_value(n) / count(*)) DESC) AS k FROM a JOIN t USING (label) JOIN (VALUES {names}) AS m(name, every, rest) ON r % every = rest GROUP BY label, name HAVING count(*) >= 2 AND count(*) <= floor(any_value(n) * 0.85)),
    u AS (SELECT label, 0 AS part, 0 AS k, '경제' || label AS keyword, 'center' AS kind, n AS article_count FROM t UNION ALL SELECT label, 1, k, keyword, 'issue', c FROM i WHERE k <= 4 UNION ALL SELECT label, 2, k, keyword, 'entity', c FROM e WHERE k <= 4)
    SELECT '경제' || label AS query, (row_number() OVER (PARTITION BY label ORDER BY part, k) - 1)::INT AS position, keyword, kind, CASE WHEN kind = 'center' THEN keyword ELSE '경제' || label || ' ' || keyword END AS search_query, article_count::INT AS article_count FROM u"""


@plans.add(_keyword_map_sql())
def keyword_map_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The map of a search for each label: its issues by size, then the names that its articles mention."""
    e = table(spark, sf, "embeddings").select("label", "vec_id", F.row_number().over(S.Window.partitionBy("label").orderBy("vec_id")).alias("r")).where("r <= 40")
    rank = F.lit(len(UPTO) - 1)
    for i in range(len(UPTO) - 1, -1, -1):
        rank = F.when(F.col("r") <= UPTO[i], i).otherwise(rank)
    e = e.withColumn("topic", (rank + F.col("label")) % len(ISSUES))
    told = F.concat_ws(" ", F.lit("소식"), *[F.when(F.col("r") % every == rest, name) for name, every, rest in MENTIONS])
    unit = lambda at: [F.when(F.lit(i) == at, 1.0).otherwise(0.0) for i in range(8)]
    vector = F.zip_with(F.array(*unit(F.col("topic"))), F.array(*unit(F.lit(7))), lambda x, y: x + y * (F.col("r") % 5) / 50)
    vector = F.zip_with(vector, F.array(*unit(F.lit(6))), lambda x, y: x + y / 2)
    articles = e.select(
        F.concat(F.lit("경제"), F.col("label").cast("string")).alias("query"), F.array(*unit(F.lit(6))).alias("query_vector"), F.col("r").alias("search_rank"), F.col("vec_id").cast("string").alias("news_id"),
        F.element_at(F.array(*[F.lit(t) for t in ISSUES]), (F.col("topic") + 1).cast("int")).alias("title"), told.alias("description"), vector.alias("embedding"),
    )
    return K.keyword_map(articles).select("query", "position", "keyword", "kind", "search_query", "article_count")


QUERIES, ORACLE = plans.queries, plans.oracle
