"""Further outcomes and single functions over the test tables, each against a value that SQL makes anew."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import articles as A
from ..operators import gazetteer
from ..operators import judgment as J
from ..operators import lattice
from ..operators import selection as S
from ..sources import articles as SRC
from ..sources import sinks, templates
from ..sources.tables import shared_dir, stored, table
from .judged import RULING
from .registered import Plans
from .texts import tokens_sql

plans = Plans()

CALM = "시장 참가자들은 이번 회의를 앞두고 채권 금리가 소폭 움직였으며 다음 회의까지 지켜보겠다는 분위기라고 입을 모아 이야기하였다고 한다."


@plans.add("""WITH k AS (SELECT c_custkey, c_custkey % 8 AS c, c_custkey // 8 AS s FROM customer),
    r AS (SELECT c_custkey, CASE WHEN c IN (0, 1) THEN 'stage' WHEN c IN (2, 3) THEN 'short_text_addition' WHEN c = 4 THEN CASE WHEN s % 4 < 2 THEN 'short_text' ELSE 'short_text_covered' END WHEN c = 5 THEN CASE WHEN s % 2 = 1 THEN 'short_text' ELSE 'short_text_covered' END
      WHEN s % 3 = 0 THEN 'low_overlap' WHEN s % 3 = 1 THEN 'repeated_information' ELSE 'semantic_difference' END AS reason FROM k)
    SELECT c_custkey, reason, CASE WHEN reason = 'stage' THEN 'different_event' WHEN reason = 'short_text_addition' THEN 'same_event_new_info' WHEN reason = 'repeated_information' THEN 'repeat' ELSE 'insufficient_evidence' END AS relation,
      reason IN ('short_text_covered', 'low_overlap', 'semantic_difference') AS withheld FROM r""")
def further_judgments(spark: SparkSession, sf: str) -> DataFrame:
    """Outcomes of short texts, of stages of one product and of texts that are near by their vectors alone."""
    k = F.col("c_custkey")
    case, step = k % 8, F.floor(k / 8)
    n = (step % 40 + 5).cast("string")
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    row = lambda title, description, timed=None: F.struct(lit(title).alias("title"), lit(description).alias("description"), (F.lit(True) if timed is None else timed).alias("timed"))
    phone = lambda tail: F.concat(F.lit("갤럭시 S"), n, F.lit(tail))
    near = lambda a, b, c: F.when(step % 3 == 0, a).when(step % 3 == 1, b).otherwise(c)
    cases = [
        (row(phone(" 공개"), ""), row(phone(" 판매 개시"), ""), F.lit(0.99)),
        (row(phone(" 공개"), ""), row(phone(" 리콜"), ""), F.lit(0.99)),
        (row("기준금리 동결", ""), row("기준금리 동결", F.concat(F.lit("환율 "), (step % 400 + 1100).cast("string"), F.lit("원 돌파했다."))), F.lit(0.99)),
        (row("기준금리 동결", ""), row("기준금리 동결", F.concat(F.lit("올해 물가 2."), (step % 9 + 1).cast("string"), F.lit("% 전망"))), F.lit(0.93)),
        (row("기준금리 동결 결정", ""), row("기준금리 동결 결정", "이날 동결"), (90 + F.floor(step % 4 / 2) * 5) / 100),
        (row("기준금리 동결 결정", "이날"), row("기준금리 동결 결정", "", step % 2 == 0), F.lit(0.99)),
        (row("한국은행 기준금리 결정", RULING), row("기준금리 시장 분위기 이야기", CALM), near(0.93, 0.96, 0.90)),
        (row("금통위 기준금리 결정", RULING), row("기준금리 시장 분위기 이야기", CALM), near(0.94, 0.97, 0.91)),
    ]
    pick = lambda i: F.element_at(F.array(*[c[i] for c in cases]), (case + 1).cast("int"))
    c = table(spark, sf, "customer").select(k, pick(0).alias("a"), pick(1).alias("b"), pick(2).alias("cosine"))
    stamp = lambda s: F.when(F.col(f"{s}.timed"), F.date_format(F.timestamp_seconds(F.lit(1_760_054_400)), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    side = lambda s, at: c.select((k * 2 + at).alias("news_id"), F.col(f"{s}.title").alias("title"), F.col(f"{s}.description").alias("description"), stamp(s).alias("published_at"))
    pairs = c.select(k, (k * 2).alias("a_id"), (k * 2 + 1).alias("b_id"), "cosine")
    articles = stored(side("a", 0).unionByName(side("b", 1)), "articles")  # else the cases are made again for each column
    return J.judge_articles(pairs, articles).select(k, "reason", "relation", "withheld")


@plans.add("""SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'nvidia|tesla|rally|again|item' || c_custkey WHEN 1 THEN 'ai|gpu|new|chips|item' || c_custkey ELSE 'item' || c_custkey || '|quiet' END AS words FROM customer""".replace("nvidia|tesla", "엔비디아|테슬라"))
def title_keywords(spark: SparkSession, sf: str) -> DataFrame:
    """Names under one spelling, then other words of titles, stop words left out."""
    k = F.col("c_custkey")
    item = F.concat(F.lit(" item"), k.cast("string"))
    title = F.when(k % 3 == 0, F.concat(F.lit("Nvidia and Tesla rally again"), item)).when(k % 3 == 1, F.concat(F.lit("New AI chips, GPU"), item)).otherwise(item)
    words = S.keyword_tokens(F.regexp_replace(title, " and ", " "), F.when(k % 3 == 2, "news report: quiet"))
    return table(spark, sf, "customer").select(k, F.array_join(words, "|").alias("words"))


@plans.add(f"""WITH t AS (SELECT doc_id, {tokens_sql("split_part(text, chr(10), 1)")} AS t FROM documents)
    SELECT a.doc_id, round(CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0 ELSE len(list_intersect(a.t, b.t))::DOUBLE / least(len(a.t), len(b.t)) END, 3) AS score FROM t a JOIN t b ON b.doc_id = a.doc_id - 1""")
def title_relations(spark: SparkSession, sf: str) -> DataFrame:
    """How far each document's first line shares the words of the one before it."""
    d = table(spark, sf, "documents").select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("title"))
    before = d.select((F.col("doc_id") + 1).alias("doc_id"), F.col("title").alias("other"))
    return d.join(before, "doc_id").select("doc_id", T.relation_score(F.col("title"), F.lit(None), F.col("other"), F.lit(None)).alias("score"))


@plans.add(r"""SELECT doc_id, md5(left(coalesce(nullif(regexp_extract(text, '(?s)^(.*?[.!?다])\s', 1), ''), text), 140)) AS sentence_md5, CASE WHEN contains(lower(regexp_replace(label, '\s', '', 'g')), lower(lang)) THEN label ELSE lang || ' ' || label END AS query
    FROM (SELECT *, left(split_part(text, chr(10), 1), 20) AS label FROM documents)""")
def sentences_and_queries(spark: SparkSession, sf: str) -> DataFrame:
    """First sentences, and a search's words before a label that lacks them."""
    label = F.substring(F.element_at(F.split("text", "\n"), 1), 1, 20)
    return table(spark, sf, "documents").select("doc_id", F.md5(T.first_sentence(F.col("text"))).alias("sentence_md5"), T.search_query(F.col("lang"), label).alias("query"))


@plans.add("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '테슬라,GPU,메모리' ELSE 'GPU,메모리,엔비디아' END AS words, '반도체' AS categories FROM customer".replace("'GPU,메모리,엔비디아'", "'엔비디아,GPU,메모리'"))
def rule_keyword_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Names of a text, those of its title first, and its categories."""
    k = F.col("c_custkey")
    title = F.when(k % 2 == 0, "tesla day").otherwise("NVIDIA day")
    text = F.concat(F.lit("Memory and gpu news: "), title)
    spellings = tuple((n, a) for n, some in L.ALIASES.items() for a in some)
    words = table(spark, sf, "customer").select(k, gazetteer.names_in(title, spellings).alias("head"), gazetteer.names_in(text, spellings).alias("every"))
    return words.select(k, F.array_join(T.rule_keywords(F.col("head"), F.col("every")), ",").alias("words"), F.array_join(T.rule_categories(F.col("every")), ",").alias("categories"))


STEMS, TAILS = ("금리", "환율", "물가", "수출", "인상", "전망", "기준"), ("가", "는", "에서", "에", "서", "까지")


@plans.add("""SELECT k AS c_custkey, stem, class, stem || '=' || pieces AS cut, length(stem) >= 5 AND contains(pieces, '+') AS compound FROM (
    SELECT c_custkey AS k, ['금리', '환율', '물가', '수출'][c_custkey % 4 + 1] || ['', '인상', '전망인상'][c_custkey // 4 % 3 + 1] AS stem, ['금리', '환율', '물가', '수출'][c_custkey % 4 + 1] || ['', '+인상', '+전망+인상'][c_custkey // 4 % 3 + 1] AS pieces,
      CASE WHEN c_custkey // 12 % 4 = 0 THEN 'CONTENT' ELSE 'TERM' END AS class FROM customer)""")
def title_words(spark: SparkSession, sf: str) -> DataFrame:
    """Made words of stems and particles, cut by a model of a few pieces."""
    k = F.col("c_custkey")
    one = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (n % len(words) + 1).cast("int"))
    title = F.concat(one(STEMS[:4], k), one(("", "인상", "전망인상"), F.floor(k / 4)), one(("", "가", "에서", "까지"), F.floor(k / 12)))
    model = lattice.Model(dict.fromkeys(STEMS, 3.0), dict.fromkeys(TAILS, 1.0))
    w = lattice.words_of(title, model)[0]
    return table(spark, sf, "customer").select(k, w.alias("w")).select(k, "w.stem", F.col("w.kind").alias("class"), F.concat("w.stem", F.lit("="), F.array_join("w.pieces", "+")).alias("cut"), "w.compound")


@plans.add("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN -1 ELSE 0 END AS direction FROM customer")
def headline_directions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    title = F.concat(F.lit("코스피 "), k.cast("string"), F.when(k % 4 == 0, " 상승").when(k % 4 == 1, " 하락").when(k % 4 == 2, " 상승 뒤 하락").otherwise(" 회의"))
    return table(spark, sf, "customer").select(k, T.direction(title).alias("direction"))


@plans.add("""SELECT substr(md5('https://' || source || '.example.com/' || doc_id), 1, 12) AS news_id, 'https://' || source || '.example.com/' || doc_id AS url, CASE WHEN regexp_matches(text, '[가-힣]') THEN 'ko' ELSE 'en' END AS language,
    strftime(make_timestamp((1767225600 + doc_id * 600) * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS published_at FROM documents WHERE doc_id % 4 > 0""")
def live_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Stored documents that aren't deleted, as articles again."""
    stored = A.to_documents(SRC.article_view(table(spark, sf, "documents")), F.lit("2026-11-27T00:00:00Z").cast("timestamp"))
    gone: Column = F.element_at(F.split("url", "/"), -1).cast("long") % 4 == 0
    return A.from_documents(stored.withColumn("is_deleted", gone)).select("news_id", "url", "language", "published_at")


@plans.add("SELECT DISTINCT sha256(url) AS input_hash, url AS input FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0)")
def inputs_without_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Each input once whose vector isn't stored."""
    p = table(spark, sf, "pages").select("page_id", F.col("url").alias("input"), F.sha2("url", 256).alias("input_hash"))
    return A.missing_inputs(p, p.where("page_id % 3 = 0"))


@plans.add(r"""WITH d AS (SELECT doc_id, coalesce(source, '') AS host, text FROM documents WHERE text IS NOT NULL), n AS (SELECT host, count(*) AS pages FROM d GROUP BY 1),
    b AS (SELECT doc_id, host, pos, trim(regexp_replace(line, '\s+', ' ', 'g')) AS block FROM (SELECT doc_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d)),
    m AS (SELECT host, block, count(DISTINCT doc_id) AS on_ FROM b WHERE block <> '' GROUP BY 1, 2),
    t AS (SELECT b.*, m.on_ >= 3 AND m.on_ >= 0.05 * n.pages AS many FROM b JOIN m USING (host, block) JOIN n USING (host)), s AS (SELECT host, avg(many::INT) >= 0.6 AS noisy FROM t GROUP BY 1),
    k AS (SELECT doc_id, string_agg(block, chr(10) ORDER BY pos) AS body FROM t JOIN s USING (host) WHERE NOT many AND NOT noisy GROUP BY 1)
    SELECT d.doc_id, md5(CASE WHEN length(regexp_replace(coalesce(body, ''), '[^0-9A-Za-z가-힣]', '', 'g')) >= 250 THEN body ELSE '' END) AS body_md5 FROM d LEFT JOIN k USING (doc_id)""")
def template_body_extract(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' lines as paragraphs of pages of their source, between a menu, a box and a last line that the pages of the source share."""
    line = lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.concat(F.lit("<div class='text'>"), F.array_join(F.transform(F.split(safe, "\n"), line), ""), F.lit("</div>"))
    menu = F.concat(F.lit("<div class='top'><ul><li><a href='/'>Home of "), F.col("host"), F.lit("</a><li>Number "), F.col("doc_id").cast("string"), F.lit("<li>News</ul></div>"))
    pages = table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.coalesce("source", F.lit("")).alias("host"), "text")
    made = pages.select("doc_id", "host", F.concat(F.lit("<html><body>"), menu, body, F.lit("<div class='end'><p>All rights at "), F.col("host"), F.lit("</div></body></html>")).alias("html"))
    return templates.template_bodies(made, "doc_id").select("doc_id", F.md5("body").alias("body_md5"))


@plans.add("""WITH r AS (SELECT ['A', 'B', 'C'][conv_id % 3 + 1] AS arm, conv_id AS repeat, count(*) AS n, count(*) FILTER (role = 'user') AS users, conv_id % 5 > 0 AS done FROM conversations GROUP BY conv_id)
    SELECT arm, count(*) AS runs, count(*) FILTER (done) AS samples, count(*) FILTER (done) AS keys, sum(users) FILTER (done)::BIGINT AS up_count, sum(n) FILTER (done)::BIGINT AS impact_count, count(*) AS figures, bool_and(true) AS hidden FROM r GROUP BY 1""")
def comparison_outputs(spark: SparkSession, sf: str) -> DataFrame:
    """The four outputs of a comparison read back: runs, figures, samples without arms, the key."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_list(F.struct(F.when(F.col("role") == "user", "up").otherwise("down").alias("direction"))).alias("stock_impacts"))
    arm = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("conv_id") % 3 + 1).cast("int"))
    none = lambda kind: F.lit(None).cast(kind)
    runs = c.select(
        arm.alias("arm"), F.col("conv_id").alias("repeat"), F.when(F.col("conv_id") % 5 > 0, "completed").otherwise("failed").alias("outcome"), F.lit(1).alias("elapsed_ms"), F.lit(2).alias("logical_generate_calls"), none("long").alias("tokens_in"), none("long").alias("tokens_out"),
        none("double").alias("est_cost_usd"), none("string").alias("verification_status"), none("array<string>").alias("notes"), "stock_impacts", none("array<struct<action:string>>").alias("strategy_items"), none("string").alias("error_code"), F.concat(F.lit("=text "), F.col("conv_id").cast("string")).alias("content"),
    )
    folder = f"{shared_dir(spark)}/comparison-{uuid.uuid4().hex}"
    sinks.write_comparison(runs, folder, 7, "digest")
    csv = lambda name, schema: spark.read.schema(schema).option("header", True).csv(f"{folder}/{name}")
    figures = csv("comparison.csv", ", ".join(f"{x} {'long' if x in ('repeat', 'up_count', 'impact_count') else 'string'}" for x in sinks.COMPARED))
    sheet = csv("blind_scores.csv", ", ".join(f"{x} string" for x in sinks.SCORED))
    key = spark.read.schema("assessment_id string, arm string, repeat long").json(f"{folder}/answer_key.json")
    every = spark.read.schema("arm string, repeat long").json(f"{folder}/comparison.json")
    opened = key.join(sheet, "assessment_id").groupBy("arm").agg(F.count(F.lit(1)).alias("samples"), F.bool_and(F.col("content") == F.concat(F.lit("'=text "), F.col("repeat").cast("string"))).alias("hidden"))
    shown = figures.groupBy("arm").agg(F.count(F.lit(1)).alias("figures"), F.sum("up_count").alias("up_count"), F.sum("impact_count").alias("impact_count"))
    return every.groupBy("arm").agg(F.count(F.lit(1)).alias("runs")).join(shown, "arm").join(opened, "arm").join(key.groupBy("arm").agg(F.count(F.lit(1)).alias("keys")), "arm")


QUERIES, ORACLE = plans.queries, plans.oracle
