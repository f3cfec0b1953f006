"""Providers' payloads to articles, candidate pools, bodies, images, metadata and exports over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs as U
from ..functions import vectors as V
from ..operators import articles as A
from ..operators import comparison as C
from ..operators import dedupe as D
from ..operators import evidence as E
from ..operators import keywords as K
from ..operators import maps as M
from ..operators import selection as S
from ..operators import tracking as R
from ..sources import articles as SRC
from ..sources import html as H
from ..sources import sinks
from ..sources.tables import shared_dir, table
from .registered import Plans

plans = Plans()
SEEN = "strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ')"


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumn("at", F.col("o_orderdate").cast("timestamp"))


def text(c: str) -> F.Column:
    return F.col(c).cast("string")


@plans.add(f"""SELECT substr(md5('https://a.example.com/' || o_orderkey), 1, 12) AS news_id, 'T' || o_orderkey AS title, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS description, 'S' || o_orderstatus AS source, {SEEN} AS published_at, '' AS naver_url FROM orders""")
def newsapi_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of the nested payload; null texts are empty."""
    rows = _orders(spark, sf).select(
        F.struct(F.lit("id").alias("id"), F.concat(F.lit("S"), "o_orderstatus").alias("name")).alias("source"), F.concat(F.lit("T"), text("o_orderkey")).alias("title"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("description"),
        F.concat(F.lit("https://a.example.com/"), text("o_orderkey")).alias("url"), F.lit(None).cast("string").alias("urlToImage"), F.date_format("at", SRC.ISO).alias("publishedAt"),
    )
    return SRC.from_newsapi(rows).select("news_id", "title", "description", "source", "published_at", "naver_url")


@plans.add(f"""SELECT substr(md5('http://g/' || o_orderkey), 1, 12) AS news_id, CASE WHEN o_orderkey % 2 = 0 THEN 'body ' || o_custkey ELSE 'T' || o_orderkey END AS description, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE {SEEN} END AS published_at FROM orders WHERE o_orderkey % 5 > 0""")
def gdelt_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of the compact payload: no url no row, the body instead of a description, times that can't be read empty."""
    k = F.col("o_orderkey")
    rows = _orders(spark, sf).select(
        F.when(k % 5 > 0, F.concat(F.lit("http://g/"), text("o_orderkey"))).alias("url"), F.concat(F.lit("T"), text("o_orderkey")).alias("title"), F.when(k % 2 == 0, F.concat(F.lit("body "), text("o_custkey"))).otherwise("").alias("body"),
        F.lit("g.example.com").alias("domain"), F.lit("").alias("socialimage"), F.when(k % 7 == 0, "2024-01-01").otherwise(F.date_format("at", "yyyyMMdd'T'HHmmss'Z'")).alias("seendate"),
    )
    return SRC.from_gdelt(rows).select("news_id", "description", "published_at")


@plans.add(f"""SELECT substr(md5(url), 1, 12) AS news_id, title, 'p & q' AS description, source, published_at FROM (SELECT CASE WHEN o_orderkey % 3 = 0 THEN link ELSE 'https://www.Paper.example.com/' || o_orderkey END AS url, 'A "' || o_orderkey || '"' AS title, CASE WHEN o_orderkey % 3 = 0 THEN 'n.news.naver.com' ELSE 'paper.example.com' END AS source,
      CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE {SEEN} END AS published_at, o_orderkey AS k FROM (SELECT *, 'https://n.news.naver.com/' || o_orderkey AS link FROM orders)) WHERE k % 5 > 0 AND k % 6 <> 1""")
def naver_articles(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of a search page: links elsewhere and blank titles go, marks and entities are read, unusable original links fall back."""
    k = F.col("o_orderkey")
    key = text("o_orderkey")
    months = F.element_at(F.array(*[F.lit(m) for m in SRC.MONTHS]), F.month("at"))
    rows = _orders(spark, sf).select(
        F.when(k % 6 == 1, "<b> </b>").otherwise(F.concat(F.lit("<b>A</b> &quot;"), key, F.lit("&quot;"))).alias("title"), F.lit("p &amp; <i>q</i>").alias("description"),
        F.when(k % 3 == 0, "ftp://x").otherwise(F.concat(F.lit("https://www.Paper.example.com/"), key)).alias("originallink"), F.concat(F.when(k % 5 == 0, "https://news.naver.com.evil.example/").otherwise("https://n.news.naver.com/"), key).alias("link"),
        F.when(k % 4 == 0, "yesterday").otherwise(F.concat(F.lit("Mon, "), F.date_format("at", "d "), months, F.date_format("at", " yyyy HH:mm:ss"), F.lit(" +0000"))).alias("pubDate"),
    )
    return SRC.from_naver(rows).select("news_id", "title", "description", "source", "published_at")


@plans.add("SELECT doc_id, contains(lower(text), 'license') AS hit FROM documents WHERE contains(lower(text), 'license') UNION ALL SELECT doc_id, contains(lower(text), 'nothing of the kind') FROM documents WHERE NOT contains(lower(text), 'nothing of the kind') AND doc_id % 2 = 1")
def relevant_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that hold a term; all rows where too few do."""
    d = table(spark, sf, "documents").select("doc_id", F.lit("").alias("title"), F.col("text").alias("description"))
    has = lambda t: F.lower("description").contains(t)
    some = SRC.relevant_or_all(d, ("license",)).select("doc_id", has("license").alias("hit"))
    every = SRC.relevant_or_all(d.where("doc_id % 2 = 1"), ("nothing of the kind",)).select("doc_id", has("nothing of the kind").alias("hit"))
    return some.unionByName(SRC.first_available([every.where("doc_id < 0"), every]))


@plans.add("SELECT 'gdelt' AS provider, o_orderkey FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'newsapi', o_orderkey FROM orders WHERE o_orderkey % 3 = 1 UNION ALL SELECT 'mock', o_orderkey FROM orders WHERE o_orderkey % 3 = 2 UNION ALL SELECT 'fallback', o_orderkey FROM orders WHERE o_orderkey % 3 = 1")
def provider_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Articles of the provider that is set; gdelt falls back where it has no titled article."""
    o = table(spark, sf, "orders").select("o_orderkey", F.lit("t").alias("title"))
    own = {name: o.where(F.col("o_orderkey") % 3 == i) for i, name in enumerate(("gdelt", "newsapi", "mock"))}
    untitled = own | {"gdelt": own["gdelt"].withColumn("title", F.lit(""))}
    rows = {"gdelt": SRC.from_provider("gdelt", own), "newsapi": SRC.from_provider("newsapi", own), "mock": SRC.from_provider("naver", own, mock=True), "fallback": SRC.from_provider("gdelt", untitled)}
    every = [df.select(F.lit(name).alias("provider"), "o_orderkey") for name, df in rows.items()]
    return every[0].unionByName(every[1]).unionByName(every[2]).unionByName(every[3])


@plans.add("SELECT event_id, CASE WHEN q = 'big view' THEN 'whole' ELSE CASE WHEN q LIKE 'big %' THEN 'great ' || CASE WHEN q = 'big click' THEN 'press' ELSE split_part(q, ' ', 2) END END END AS query, CASE event_id % 4 WHEN 0 THEN event_id % 100 WHEN 1 THEN 86400 + event_id % 60 WHEN 2 THEN 3600 ELSE -1 END AS retry_after FROM (SELECT event_id, 'big ' || event_type AS q FROM events)")
def provider_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Queries by phrase or word, and seconds that a provider asks to wait."""
    k = F.col("event_id")
    wait = F.when(k % 4 == 0, (k % 100).cast("string")).when(k % 4 == 1, F.concat(F.lit("1 day, 00:00:"), F.lpad((k % 60).cast("string"), 2, "0"))).when(k % 4 == 2, "01:00:00").otherwise("soon")
    q = SRC.translated(F.concat(F.lit("big "), "event_type"), {"big view": "whole", "big": "great", "click": "press"})
    return table(spark, sf, "events").select("event_id", q.alias("query"), F.coalesce(SRC.retry_after_seconds(wait), F.lit(-1)).alias("retry_after"))


@plans.add("""WITH d AS (SELECT o_orderkey AS news_id, o_orderdate, o_orderstatus FROM orders WHERE o_orderstatus = 'O' AND o_orderkey % 9 > 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 50) SELECT news_id, row_number() OVER (ORDER BY o_orderdate DESC, news_id) AS n FROM d""")
def newest_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """The fifty newest live documents of a search, looked up again in their order."""
    docs = _orders(spark, sf).select(F.col("o_orderkey").alias("news_id"), F.col("at").alias("published_at"), F.col("o_orderstatus").alias("search_keyword"), (F.col("o_orderkey") % 9 == 0).alias("is_deleted"), F.lit(0).alias("embedding"))
    best = A.candidates(docs, "O", 50)
    order = best.withColumn("position", F.row_number().over(S.Window.orderBy(F.col("published_at").desc(), "news_id"))).select("news_id", "position")
    return A.looked_up(order, docs.select("news_id")).select("news_id", F.col("position").cast("long").alias("n"))


@plans.add("SELECT o_orderkey AS news_id, CASE WHEN o_orderkey % 2 = 0 THEN 'memory' ELSE 'stored' END AS pool FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def merged_pools(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("news_id"))
    return A.merged_pools(o.where("news_id % 2 = 0").withColumn("pool", F.lit("memory")), o.where("news_id % 3 = 0").withColumn("pool", F.lit("stored")))


@plans.add("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN (o_custkey % 50)::VARCHAR ELSE '-' END AS rank FROM orders ORDER BY strftime(o_orderdate, '%Y-%m-%d') DESC, o_orderkey LIMIT 40 OFFSET 20")
def stamped_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page, newest days first; ranks for relevance order only."""
    o = _orders(spark, sf).select(F.col("o_orderkey").alias("news_id"), F.date_format("at", "yyyy-MM-dd").alias("published_at"), (F.col("o_custkey") % 50).cast("string").alias("search_rank"), "o_orderstatus")
    kept = A.stamped(A.page(o, 20, 40), F.when(F.col("o_orderstatus") == "O", "relevance").otherwise("date"))
    return kept.select(F.col("news_id").alias("o_orderkey"), F.coalesce("search_rank", F.lit("-")).alias("rank"))


@plans.add("""WITH p AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'https://img.example.com/a.png' WHEN 1 THEN 'https://x.example.com/qr-code.png' WHEN 2 THEN 'no url' WHEN 3 THEN 'http://x.example.com/qr.png' ELSE 'http://y.example.com/' END AS url FROM customer)
    SELECT c_custkey, c_custkey % 5 IN (0, 4) AS usable, CASE WHEN c_custkey % 5 IN (0, 4) THEN -1 ELSE c_custkey % 5 END::INT AS fallback, CASE WHEN c_custkey % 2 = 0 THEN 'https://m.example.com/m.png' WHEN c_custkey % 5 IN (0, 4) THEN url WHEN c_custkey % 3 = 0 THEN 'https://o.example.com/o.png' ELSE 'https://m.example.com/m.png' END AS image FROM p""")
def article_images(spark: SparkSession, sf: str) -> DataFrame:
    """Pictures that aren't codes, canned ones by number, and which of several an article gets."""
    k = F.col("c_custkey")
    url = F.element_at(F.array(*[F.lit(x) for x in ("https://img.example.com/a.png", "https://x.example.com/qr-code.png", "no url", "http://x.example.com/qr.png", "http://y.example.com/")]), (k % 5 + 1).cast("int"))
    others = F.when(k % 3 == 0, F.array(F.lit("data:x"), F.lit("https://o.example.com/o.png")))
    thumb = A.thumbnail(url, k % 5)
    return table(spark, sf, "customer").select(k, H.is_article_image(url).alias("usable"), F.coalesce(thumb["fallback"], F.lit(-1)).alias("fallback"), A.image_choice(k % 2 == 0, F.lit("https://m.example.com/m.png"), url, others).alias("image"))


@plans.add("""SELECT c_custkey, CASE WHEN k = 0 THEN 'rate_limited' WHEN k = 1 THEN 'server_error' WHEN k = 2 THEN 'empty' ELSE 'ok' END AS error, CASE WHEN k IN (3, 4) THEN 'line ' || c_custkey || chr(10) || 'two' ELSE 'before' END AS body FROM (SELECT c_custkey, c_custkey % 5 AS k FROM customer)""")
def extracted_bodies(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies of extraction payloads; without one the body stays as it was."""
    k = F.col("c_custkey") % 5
    good = F.to_json(F.struct(F.array(F.struct(F.lit("t").alias("title"), F.concat(F.lit(" line  "), text("c_custkey"), F.lit("\n\n two ")).alias("text"))).alias("objects")))
    payload = F.when(k == 0, '{"errorCode": 429}').when(k == 1, '{"errorCode": 503}').when(k == 2, '{"objects": [{"text": " "}]}').otherwise(good)
    d = table(spark, sf, "customer").select("c_custkey", payload.alias("payload"), F.lit("before").alias("cleaned_content"), F.lit("https://a.example.com/qr.png").alias("thumbnail_url"))
    d = d.withColumn("x", A.extraction(F.col("payload"))).withColumn("new_text", F.when(F.col("x.error").isNull(), F.col("x.text")))
    return A.with_body(d).select("c_custkey", F.coalesce("x.error", F.lit("ok")).alias("error"), F.col("cleaned_content").alias("body"))


@plans.add("""SELECT c_custkey, CASE WHEN k = 0 THEN 'reused' WHEN k IN (1, 2) THEN 'llm' ELSE 'rules' END AS method, CASE k WHEN 0 THEN 'old' WHEN 1 THEN '엔비디아,금리' WHEN 2 THEN '금리' ELSE 'rule' END AS keywords FROM (SELECT c_custkey, c_custkey % 5 AS k FROM customer)""")
def chosen_metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Stored metadata where it still holds, else a model's usable answer, else the rules'."""
    k = F.col("c_custkey") % 5
    raw = F.when(k == 1, '```json\n{"keywords": ["Nvidia", "interest rate", "news", "absent"], "categories": ["금융", "x"]}\n```').when(k == 2, '{"keywords": ["금리"], "categories": []}').when(k == 3, '{"keywords": ["absent"], "categories": ["x"]}').otherwise("no json")
    made = lambda w: F.struct(F.array(F.lit(w)).alias("keywords"), F.array().cast("array<string>").alias("categories"))
    state = F.struct(F.when(k == 0, "h").otherwise("old").alias("input_hash"), F.lit("llm").alias("method"), F.lit(0).alias("retry_after"))
    chosen = A.chosen_metadata(made("old"), A.reusable_metadata(state, F.lit("h"), F.lit(100)), A.parsed_metadata(raw, F.lit("nvidia 의 금리 interest rate")), made("rule"))
    return table(spark, sf, "customer").select("c_custkey", chosen["method"].alias("method"), F.array_join(chosen["keywords"], ",").alias("keywords"))


@plans.add("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 's' || c_custkey END AS summary, CASE WHEN c_custkey % 2 = 0 THEN 'n' ELSE 'u' || c_custkey END AS source_url, 'public' AS fields FROM customer""")
def article_cards(spark: SparkSession, sf: str) -> DataFrame:
    """What a card shows; private fields are left out."""
    k = F.col("c_custkey")
    a = table(spark, sf, "customer").select(
        text("c_custkey").alias("news_id"), F.lit("t").alias("title"), F.when(k % 3 == 0, F.col("c_name")).otherwise(" ").alias("description"), F.concat(F.lit("s"), text("c_custkey")).alias("summary"), F.lit("src").alias("source"), F.lit("").alias("published_at"),
        F.when(k % 2 == 0, "n").alias("naver_url"), F.concat(F.lit("u"), text("c_custkey")).alias("url"), F.array().cast("array<double>").alias("embedding"), F.lit("secret").alias("cleaned_content"),
    )
    hidden = "public" if not {"embedding", "cleaned_content"} & {*A.public(a).columns, *A.snapshot(a).columns} else "private"
    return A.card(A.public(a)).select(F.col("news_id").cast("long").alias("c_custkey"), "summary", "source_url", F.lit(hidden).alias("fields"))


@plans.add("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id % 500 END::BIGINT AS input_tokens, CASE WHEN event_id % 4 = 0 THEN -1 ELSE event_id % 7 END::BIGINT AS output_tokens, CASE WHEN event_id % 2 = 0 THEN 'response' WHEN event_id % 3 > 0 THEN 'statistics' ELSE 'counted' END AS basis,
    CASE WHEN event_id % 2 = 0 THEN 2041 WHEN event_id % 3 > 0 THEN 2050 ELSE 7 END::BIGINT AS tokens, event_id % 2 = 0 OR event_id % 3 > 0 AS maybe_truncated FROM events""")
def usage_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Token counts by the provider's own names, and where an embedding's count comes from."""
    k = F.col("event_id")
    payload = F.format_string('{"prompt_token_count": %d, "candidates_token_count": %d, "input_tokens": %d, "output_tokens": %d}', *[F.when(k % m == 0, F.lit(-5).cast("long")).otherwise(k % n) for m, n in ((3, 500), (4, 7)) * 2])
    u = A.usage(F.when(k % 2 == 0, "gemini").otherwise("other"), payload)
    stats = F.when(k % 3 > 0, F.array(F.lit(2045).cast("long"), F.lit(5).cast("long")))
    e = A.embedding_tokens(F.when(k % 2 == 0, F.lit(2041).cast("long")), stats, F.lit(7).cast("long"))
    return table(spark, sf, "events").select("event_id", F.coalesce(u["input_tokens"], F.lit(-1)).alias("input_tokens"), F.coalesce(u["output_tokens"], F.lit(-1)).alias("output_tokens"), e["basis"].alias("basis"), e["tokens"].alias("tokens"), e["maybe_truncated"].alias("maybe_truncated"))


@plans.add("""WITH s AS (SELECT c_custkey, c_name, c_custkey % 2 = 0 AS given FROM customer) SELECT c_custkey, CASE WHEN given THEN 'v' || c_custkey ELSE c_name END AS name, CASE WHEN c_custkey % 3 = 0 THEN 'stored' ELSE '' END AS content, CASE WHEN c_custkey % 3 = 0 OR c_custkey % 4 = 0 THEN 'vector' ELSE '' END AS vector FROM s""")
def updated_and_carried(spark: SparkSession, sf: str) -> DataFrame:
    """Updates of what is there only; bodies are carried over where title and url are the same, vectors always."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k, F.col("c_name").alias("name"))
    given = c.where("c_custkey % 2 = 0").select((k * 1).alias("c_custkey"), F.concat(F.lit("v"), text("c_custkey")).alias("name")).unionByName(c.limit(3).select((k + 10**9).alias("c_custkey"), "name"))
    renamed = sinks.update_existing(c, given, "c_custkey", "name")
    none = F.lit(None).cast("string")
    fresh = renamed.select(k, "name", text("c_custkey").alias("url"), F.lit("t").alias("title"), none.alias("content"), none.alias("keywords"), none.alias("categories"), none.alias("vector"))
    stored = c.where("c_custkey % 3 = 0 OR c_custkey % 4 = 0").select(text("c_custkey").alias("url"), F.when(k % 3 == 0, "t").otherwise("other").alias("title"), text("c_custkey").alias("body_url"), F.lit("stored").alias("content"), none.alias("keywords"), none.alias("categories"), F.lit("vector").alias("vector"))
    out = sinks.carry_forward(fresh, stored)
    return out.select("c_custkey", "name", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("vector", F.lit("")).alias("vector"))


@plans.add("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '''=' || c_name ELSE c_name END AS name, '{"event_id":' || c_custkey || ',"status":"ok"}' AS line, '{"title":"' || c_name || '","risk_factors":"r"}' AS blind FROM customer""")
def exported_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A CSV export read back (formulas quoted), telemetry lines of the allowed fields, the text that all arms share."""
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select(k, F.when(k % 2 == 0, F.concat(F.lit("="), "c_name")).otherwise(F.col("c_name")).alias("name"), F.col("c_name").alias("title"), F.lit("r").alias("risk_factors"), F.lit("s").alias("secret"))
    lines = sinks.telemetry(c.select(k.alias("event_id"), F.lit("ok").alias("status"), "secret")).withColumn("c_custkey", F.get_json_object("line", "$.event_id").cast("long"))
    path = f"{shared_dir(spark)}/export-{uuid.uuid4().hex}"
    sinks.write_csv(c.select(k, "name"), path, ["c_custkey", "name"])
    back = spark.read.schema("c_custkey long, name string").option("header", True).csv(path)
    return back.join(lines, "c_custkey").join(c.select(k, C.blind_text(c).alias("blind")), "c_custkey")


@plans.add("WITH d AS (SELECT c_custkey, n_name AS arm FROM customer JOIN nation ON n_nationkey = c_nationkey) SELECT arm, count(*) AS n, count(DISTINCT c_custkey) AS rows, true AS hidden FROM d GROUP BY arm")
def blind_samples(spark: SparkSession, sf: str) -> DataFrame:
    """Samples without their arms, and the key that tells them."""
    d = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("arm"))
    shown, key = sinks.blinded(d, "c_custkey", "arm", 7)
    return key.join(shown.select("sample", F.col("c_custkey").alias("same")), "sample").where("same = c_custkey").groupBy("arm").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_custkey").alias("rows"), F.lit("arm" not in shown.columns).alias("hidden"))


@plans.add("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'PAID' WHEN c_custkey % 3 = 1 THEN 'BASIC' ELSE 'FREE' END AS tier, c_custkey % 3 = 0 AS paid, CASE WHEN c_custkey % 3 = 0 THEN 4 ELSE 3 END AS target, CASE c_custkey % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'expandable' ELSE 'insufficient' END AS status,
    lower(trim(regexp_replace(c_name, '[ #]+', ' ', 'g'))) AS query, CASE c_custkey % 4 WHEN 0 THEN '10.0.0.' || (c_custkey % 200) WHEN 1 THEN '2001:db8::/64' WHEN 2 THEN '1.2.3.4' ELSE 'unknown' END AS client FROM customer""")
def request_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Tiers and what they show, states of a selection, keys of queries and clients."""
    k = F.col("c_custkey")
    tier = F.element_at(F.array(F.lit("PAID"), F.lit("BASIC"), F.lit("FREE")), (k % 3 + 1).cast("int"))
    host = F.when(k % 4 == 0, F.concat(F.lit("10.0.0."), (k % 200).cast("string"))).when(k % 4 == 1, "2001:db8::7").when(k % 4 == 2, "::ffff:1.2.3.4").otherwise("nowhere")
    status = S.selection_status(F.when(k % 3 == 0, 4).otherwise(2), F.lit(4), k % 3 == 2)
    return table(spark, sf, "customer").select(k, tier.alias("tier"), S.tier_allows(tier, "PAID").alias("paid"), S.display_target(F.lit(4), tier).alias("target"), status.alias("status"), T.query_key(F.regexp_replace("c_name", "[ #]+", "  ")).alias("query"), U.client_key(host).alias("client"))


@plans.add("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') ELSE strftime(o_orderdate + INTERVAL 5 HOUR, '%Y-%m-%d %H:%M:%S') END AS created, CASE WHEN hour(o_orderdate + INTERVAL 9 HOUR) >= 16 THEN strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%d') ELSE strftime(o_orderdate - INTERVAL 15 HOUR, '%Y-%m-%d') END AS as_of FROM orders""")
def record_times(spark: SparkSession, sf: str) -> DataFrame:
    """Creation times in two forms, and the day up to which prices may be looked at."""
    o = _orders(spark, sf)
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.to_json(F.struct(F.struct(F.unix_millis("at").cast("string").alias("$numberLong")).alias("$date")))).otherwise(F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'-05:00'"))
    return o.select("o_orderkey", F.date_format(R.created_at(raw), "yyyy-MM-dd HH:mm:ss").alias("created"), F.date_format(R.default_as_of(F.col("at")), "yyyy-MM-dd").alias("as_of"))


@plans.add("SELECT l_partkey, min(l_suppkey % 3) AS source, count(*) FILTER (l_suppkey % 3 = m) AS n FROM (SELECT *, min(l_suppkey % 3) OVER (PARTITION BY l_partkey) AS m FROM lineitem) GROUP BY l_partkey")
def one_price_source(spark: SparkSession, sf: str) -> DataFrame:
    """Prices of each part's best source, never mixed."""
    p = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("ticker"), (F.col("l_suppkey") % 3).alias("priority"))
    return R.first_source(p).groupBy(F.col("ticker").alias("l_partkey")).agg(F.min("priority").alias("source"), F.count(F.lit(1)).alias("n"))


@plans.add("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'a,b' ELSE 'b' END AS chosen, CASE WHEN c_custkey % 3 = 0 THEN 's' ELSE c_custkey::VARCHAR END AS search FROM customer WHERE c_custkey % 3 > 0 OR c_custkey % 2 > 0""")
def map_searches(spark: SparkSession, sf: str) -> DataFrame:
    """What stays visible of a selection, and maps without those of a deleted search."""
    k = F.col("c_custkey")
    maps = table(spark, sf, "customer").select(k, text("c_custkey").alias("map_id"), F.when((k % 3 == 0) & (k % 2 == 0), "gone").when(k % 3 == 0, "s").alias("issue_search_id"))
    left = M.without_search(maps, maps.where("issue_search_id = 'gone'").select(F.col("issue_search_id").alias("search_id")).limit(1))
    visible = F.when(k % 2 == 0, F.array(F.lit("b"), F.lit("a"))).otherwise(F.array(F.lit("b")))
    return left.select(k, F.array_join(M.visible_selection(F.array(F.lit("a"), F.lit("b"), F.lit("c")), visible), ",").alias("chosen"), M.search_group(F.col("issue_search_id"), F.col("map_id")).alias("search"))


@plans.add("""WITH r AS (SELECT page_id, url, page_id % 7 AS g, page_id % 5 AS id FROM pages), f AS (SELECT *, min(page_id) OVER (PARTITION BY g, id) AS by_id FROM r WHERE page_id % 4 > 0) SELECT page_id FROM f WHERE page_id = by_id AND id > 0""")
def identities_kept(spark: SparkSession, sf: str) -> DataFrame:
    """First usable row of each identity of a group; an identity that is known beforehand never counts."""
    p = table(spark, sf, "pages").select("page_id", (F.col("page_id") % 7).alias("g"), F.array(F.concat(F.lit("id:"), (F.col("page_id") % 5).cast("string"))).alias("keys"), F.array(F.lit("id:0")).alias("known"), (F.col("page_id") % 4 > 0).alias("ok"))
    return D.identity_dedupe(p, ["g"], [F.col("page_id")], seed="known", usable="ok").select("page_id")


@plans.add("""WITH p AS (SELECT page_id, page_id % 6 AS host, url, 'title of group ' || lpad((page_id % 9)::VARCHAR, 3, '0') AS title FROM pages), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM p),
    f AS (SELECT host, n, page_id FROM r) SELECT r.page_id FROM r WHERE NOT EXISTS (SELECT 1 FROM r b WHERE b.host = r.host AND b.page_id < r.page_id AND b.title = r.title)""")
def url_or_title_kept(spark: SparkSession, sf: str) -> DataFrame:
    """First row by url or by a title that is long enough; urls are this table's own, so titles decide."""
    p = table(spark, sf, "pages").select("page_id", (F.col("page_id") % 6).alias("host"), text("page_id").alias("url_key"), F.concat(F.lit("title of group "), F.lpad((F.col("page_id") % 9).cast("string"), 3, "0")).alias("title_key"))
    return D.url_or_title_dedupe(p, ["host"], [F.col("page_id")]).select("page_id")


@plans.add("SELECT page_id, lower(url) AS processed FROM pages WHERE page_id % 3 > 0")
def inputs_once(spark: SparkSession, sf: str) -> DataFrame:
    """Work done once for each distinct input, its result on every row."""
    p = table(spark, sf, "pages").select("page_id", "url").where("page_id % 3 > 0")
    return D.distinct_inputs(p, ["url"], lambda once: once.withColumn("processed", F.lower("url"))).select("page_id", "processed")


@plans.add("WITH p AS (SELECT p_partkey, p_name || '/' || p_brand AS key FROM part) SELECT DISTINCT key FROM p WHERE key NOT IN (SELECT key FROM p WHERE p_partkey % 4 = 0)")
def keys_to_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """Keys that aren't stored, each once."""
    p = table(spark, sf, "part").select("p_partkey", F.concat_ws("/", "p_name", "p_brand").alias("key"))
    return D.missing_keys(p, p.where("p_partkey % 4 = 0").select("key").distinct(), "key")


@plans.add("SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN round(e[1] / sqrt(list_sum(list_transform(e, lambda x: x * x))), 6) ELSE 0 END AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def unit_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors at length one, where a stored one was made of this input the same way."""
    meta = F.struct(F.when(F.col("vec_id") % 2 == 0, "m1").otherwise("m2").alias("model"))
    record = F.struct(meta.alias("metadata"), F.col("embedding").alias("values"))
    same = A.vector_matches(record, F.struct(F.lit("m1").alias("model")), 64)
    slot = A.vector_slot(F.lit("rag"), F.lit(None).cast("array<double>"), V.normalised(F.col("embedding"), 64))
    return table(spark, sf, "embeddings").select("vec_id", F.when(same, F.round(slot[0], 6)).otherwise(0.0).alias("first"))


@plans.add("SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'alpha,beta' WHEN 1 THEN 'gamma' ELSE '' END AS terms, CASE WHEN c_custkey % 2 = 0 THEN '삼성전자' ELSE '무명' END AS name, '- a: x' || chr(10) || '- b: ' AS block FROM customer")
def expansion_and_names(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of an answer's list, a spelling's name, the lines of retrieved articles."""
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, "- alpha, * beta\n own, alpha").when(k % 3 == 1, "1) gamma")
    rows = F.array(F.struct(F.lit("a").alias("title"), F.lit("x").alias("description")), F.struct(F.lit("b").alias("title"), F.lit(None).cast("string").alias("description")))
    return table(spark, sf, "customer").select(k, F.array_join(K.expansion_terms(raw, F.lit("OWN")), ",").alias("terms"), A.canonical_name(F.when(k % 2 == 0, "samsung  Electronics").otherwise(" 무명")).alias("name"), A.rag_block(rows).alias("block"))


@plans.add("""SELECT page_id, sha256('{"requested":["' || least(page_id::VARCHAR, (page_id + 1)::VARCHAR) || '","' || greatest(page_id::VARCHAR, (page_id + 1)::VARCHAR) || '"],"used":["a' || page_id % 7 || '","b"],"failed":[' || CASE WHEN page_id % 5 = 0 THEN '"f"' ELSE '' END || '],"rag":' || CASE WHEN page_id % 2 = 0 THEN 'true' ELSE 'false' END || ',"config":"c' || page_id % 3 || '"}') AS key, true AS ordered FROM pages""")
def report_keys(spark: SparkSession, sf: str) -> DataFrame:
    """The key of a report by what it is made from; the order in which that is named changes nothing."""
    k, p, q = F.col("page_id"), text("page_id"), F.col("page_id") + 1
    used, none = [F.concat(F.lit("a"), (k % 7).cast("string")), F.lit("b")], F.array().cast("array<string>")
    rest = (F.when(k % 5 == 0, F.array(F.lit("f"))).otherwise(none), k % 2 == 0, F.concat(F.lit("c"), (k % 3).cast("string")))
    key = E.report_key(F.array(p, q.cast("string")), F.array(*used), *rest)
    turned = E.report_key(F.array(q.cast("string"), p), F.array(*reversed(used)), *rest)
    return table(spark, sf, "pages").select("page_id", key.alias("key"), (key == turned).alias("ordered"))


QUERIES, ORACLE = plans.queries, plans.oracle
