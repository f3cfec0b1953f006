"""Search pages, dedupe, ranks, frequencies over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T
from ..operators import dedupe, keywords, selection
from ..sources import articles as A
from ..sources import html as H
from ..sources.tables import table
from .registered import Plans, sql_list
from .texts import tokens_sql

plans = Plans()


@plans.add("""WITH m AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS search_rank FROM documents WHERE contains(lower(text), 'tion') OR contains(lower(text), 'license'))
    SELECT doc_id, lang, search_rank FROM m WHERE search_rank BETWEEN 11 AND 30""")
def search_filter_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of twenty after the first ten, per language."""
    hits = table(spark, sf, "documents").where(T.relevant_terms(("tion", "license", "of"), F.lit(""), F.col("text")))
    return A.search_page(hits, 11, 20, ["lang"], url="doc_id", position="doc_id").select("doc_id", "lang", "search_rank")


@plans.add("SELECT page_id, url FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY page_id) AS n FROM pages) WHERE n = 1")
def url_dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", "url")
    return p.groupBy("url").agg(F.min("page_id").alias("page_id")).select("page_id", "url")


@plans.add("""WITH k AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS url, split_part(text, chr(10), 1) AS title FROM documents),
    f AS (SELECT *, row_number() OVER (PARTITION BY lang, coalesce(nullif(trim(url), ''), 'idx-' || doc_id || '-' || coalesce(title, '')) ORDER BY doc_id) AS n FROM k)
    SELECT doc_id, lang, title AS clean_title FROM f WHERE n = 1 AND trim(title) <> ''""")
def corpus_first_rows(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 != 0, F.col("source")).alias("url"), F.lit(None).cast("string").alias("naver_url"), F.element_at(F.split("text", "\n"), 1).alias("title"))
    return dedupe.corpus_rows(d, ["lang"], "doc_id").select("doc_id", "lang", "clean_title")


STOP = sql_list((*L.TITLE_STOPWORDS, *L.CONTENT_STOPWORDS, *L.KEYWORD_STOPWORDS))
EACH_TOKEN = """SELECT lang, doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS token FROM (
    SELECT lang, doc_id, regexp_extract_all(lower(text), '[a-z가-힣]+') AS l FROM documents)"""


@plans.add(f"""WITH t AS ({EACH_TOKEN}), c AS (SELECT lang, token, count(*) AS n, min(doc_id * 1000000 + pos) AS f FROM t WHERE length(token) >= 3 AND NOT list_contains({STOP}, token) GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, f) AS rank FROM c) SELECT lang, token, n, rank FROM r WHERE rank <= 7""")
def keyword_frequency(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").withColumnRenamed("doc_id", "position")
    return keywords.frequent_tokens(d, ["lang"], "text").select("lang", "token", "n", F.col("rank").cast("long").alias("rank"))


@plans.add("""WITH t AS (SELECT source AS cluster, unnest(regexp_extract_all(lower(split_part(text, chr(10), 1)), '[a-z]{4,}')) AS token FROM documents),
    tf AS (SELECT cluster, token, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM tf GROUP BY 1), k AS (SELECT count(DISTINCT cluster) AS k FROM tf)
    SELECT cluster, token, tf, df, round(ln(1 + tf) * (ln((1 + k)::DOUBLE / (1 + df)) + 1), 6) AS weight FROM tf JOIN df USING (token), k""")
def class_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    first = F.regexp_extract_all(F.lower(F.element_at(F.split("text", "\n"), 1)), F.lit("[a-z]{4,}"), F.lit(0))
    t = table(spark, sf, "documents").select(F.col("source").alias("cluster"), F.explode(first).alias("token"))
    return keywords.class_tfidf(t)


POOL = """SELECT doc_id, lang, source, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE 'S' || (doc_id % 3) END AS searched_at, (doc_id * 7) % 11 AS search_rank, 'P' || lpad((doc_id % 13)::VARCHAR, 2, '0') AS published_at,
    substr(md5(doc_id::VARCHAR), 1, 12) AS news_id FROM documents"""


def _pool(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id", "lang", "source", F.when(d % 5 != 0, F.concat(F.lit("S"), (d % 3).cast("string"))).alias("searched_at"), ((d * 7) % 11).alias("search_rank"),
        F.concat(F.lit("P"), F.lpad((d % 13).cast("string"), 2, "0")).alias("published_at"), T.news_id(d.cast("string")).alias("news_id"),
    )


ORDER = "coalesce(searched_at, '') DESC, CASE WHEN search_rank = 0 THEN 1000000000 ELSE search_rank END, published_at DESC, news_id"


@plans.add(f"WITH p AS ({POOL}) SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {ORDER}) AS pool_rank FROM p")
def pool_order(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("lang").orderBy(*selection.pool_order())
    return _pool(spark, sf).select("doc_id", "lang", F.row_number().over(w).cast("long").alias("pool_rank"))


@plans.add(f"""WITH p AS ({POOL}), f AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY {ORDER}) = 1 AS fresh FROM p),
    s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY lang ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) AS seen FROM f)
    SELECT doc_id, lang, CASE WHEN seen > 8 OR (seen = 8 AND NOT fresh) THEN 1 ELSE 0 END AS stage FROM s""")
def initial_stage(spark: SparkSession, sf: str) -> DataFrame:
    order = selection.pool_order()
    fresh = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)) == 1
    return selection.initial_cut(_pool(spark, sf).withColumn("fresh", fresh), ["lang"], order, "fresh", 8).select("doc_id", "lang", "stage")


@plans.add(f"""WITH p AS ({POOL}), m AS (SELECT *, max(coalesce(searched_at, '')) OVER (PARTITION BY lang) AS newest FROM p)
    SELECT lang, max(search_rank) AS raw_end, any_value(newest) AS session FROM m WHERE coalesce(searched_at, '') = newest GROUP BY lang""")
def latest_session(spark: SparkSession, sf: str) -> DataFrame:
    p = _pool(spark, sf).withColumn("search_end", F.lit(None).cast("long"))
    return selection.latest_session_end(p, ["lang"])


@plans.add("""SELECT doc_id, CASE WHEN NOT contains(lower(q), 'sourcelang:') THEN trim(q) || ' sourcelang:Korean' ELSE trim(q) END AS query FROM (
    SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ' SourceLang:' || lang ELSE ' ' || lang END AS q FROM documents)""")
def source_query(spark: SparkSession, sf: str) -> DataFrame:
    q = F.when(F.col("doc_id") % 2 == 0, F.concat("lang", F.lit(" SourceLang:"), "lang")).otherwise(F.concat(F.lit(" "), "lang"))
    return table(spark, sf, "documents").select("doc_id", A.gdelt_query(q).alias("query"))


@plans.add("SELECT event_id, CASE WHEN s = 429 THEN 'rate_limited' WHEN s IN (401, 403) THEN 'unauthorized' WHEN s >= 500 THEN 'server_error' ELSE 'api_error' END AS class, least(30.0, pow(2, event_id % 7)) AS wait FROM (SELECT event_id, [200, 401, 403, 404, 429, 500, 503][event_id % 7 + 1] AS s FROM events)")
def retry_classes(spark: SparkSession, sf: str) -> DataFrame:
    codes = F.array(*[F.lit(x) for x in (200, 401, 403, 404, 429, 500, 503)])
    k = (F.col("event_id") % 7).cast("int")
    return table(spark, sf, "events").select("event_id", A.status_class(F.element_at(codes, k + 1)).alias("class"), A.backoff(k).alias("wait"))


@plans.add("""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages)
    SELECT page_id, substr(md5(host), 1, 12) AS site, title, (page_id % 5)::INT AS fallback_image FROM p""")
def card_projection(spark: SparkSession, sf: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1))
    return table(spark, sf, "pages").select("page_id", T.news_id(host).alias("site"), title.alias("title"), F.pmod(F.col("page_id"), F.lit(5)).cast("int").alias("fallback_image"))


# The given pages have one article each, without lines that the lists of captions know.
BODIES = r"""WITH a AS (SELECT page_id, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1) AS x FROM pages),
    d AS (SELECT page_id, x, list_transform(string_split_regex(x, '<[^>]*>'), lambda t: regexp_replace(replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#39;', chr(39)), '&amp;?', '&', 'g')) AS nodes FROM a),
    h AS (SELECT *, trim(nodes[2]) AS title FROM d), u AS (SELECT *, list_filter(list_transform([title] || string_split_regex(title, '[-|｜:]'), lambda t: regexp_replace(t, '\s+', '', 'g')), lambda t: length(t) >= 10) AS unwanted FROM h),
    l AS (SELECT page_id, unwanted, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM (SELECT *, list_transform(flatten(list_transform(nodes, lambda t: string_split(trim(t, E' \t\n\r'), chr(10)))), lambda t: trim(regexp_replace(t, '\s+', ' ', 'g'))) AS lines FROM u)),
    k AS (SELECT page_id, line, pos, length(regexp_replace(line, '[^0-9A-Za-z가-힣]', '', 'g')) AS signal, row_number() OVER (PARTITION BY page_id, replace(line, ' ', '') ORDER BY pos) AS again FROM l
      WHERE length(replace(line, ' ', '')) >= 8 AND NOT list_contains(unwanted, replace(line, ' ', '')) AND NOT regexp_matches(line, '^(?i:Copyright|#|\+|·)') AND NOT regexp_matches(line, '^[\w.%-]+@[\w.-]+\.[A-Za-z]{2,}$')),
    b AS (SELECT page_id, string_agg(line, chr(10) ORDER BY pos) AS body, sum(signal) AS signal FROM k WHERE again = 1 GROUP BY 1)
    SELECT page_id, length(CASE WHEN signal >= 250 THEN body ELSE '' END)::INT AS n, md5(CASE WHEN signal >= 250 THEN body ELSE '' END) AS body_md5 FROM pages LEFT JOIN b USING (page_id)"""


@plans.add(BODIES)
def html_body_extract(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return p.select("page_id", H.extract_body("html", F.lit("")).alias("body")).select("page_id", F.length("body").alias("n"), F.md5("body").alias("body_md5"))


@plans.add("SELECT page_id, 0 AS n, false AS allowed FROM pages WHERE NOT contains(html, 'media_end_categorize_item')")
def page_categories(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", H.page_categories("html").alias("c"))
    return p.select("page_id", F.size(F.coalesce("c.labels", F.array().cast("array<string>"))).alias("n"), A.allowed_categories(F.col("c.labels")).alias("allowed"))


@plans.add(f"""WITH RECURSIVE p AS (SELECT page_id, trim(url) AS url, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, {tokens_sql("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS t FROM pages),
    r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS n FROM p),
    f AS (SELECT host, 0::BIGINT AS n, NULL::BIGINT AS page_id, false AS kept, []::STRUCT(url VARCHAR, t VARCHAR[])[] AS seen FROM (SELECT DISTINCT host FROM r)
      UNION ALL SELECT host, n, page_id, fresh, CASE WHEN fresh THEN list_append(seen, {{'url': url, 't': t}}) ELSE seen END FROM (
        SELECT r.host, r.n, r.page_id, r.url, r.t, f.seen, r.url <> '' AND len(list_filter(f.seen, lambda s: s.url = r.url OR (len(s.t) > 0 AND len(r.t) > 0 AND len(list_intersect(s.t, r.t))::DOUBLE / least(len(s.t), len(r.t)) >= 0.4))) = 0 AS fresh
        FROM f JOIN r ON r.host = f.host AND r.n = f.n + 1))
    SELECT page_id, host FROM f WHERE kept""")
def greedy_title_dedupe(spark: SparkSession, sf: str) -> DataFrame:
    """Titles of each site's pages, first wins, an overlap of 0.4 or more dropped."""
    p = table(spark, sf, "pages").select("page_id", "url", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"))
    return dedupe.title_overlap_dedupe(p, ["host"], [F.col("page_id")]).select("page_id", "host")


@plans.add("SELECT p.page_id FROM pages p WHERE NOT EXISTS (SELECT 1 FROM pages e WHERE e.page_id % 10 = 0 AND (e.url = p.url OR e.page_id = p.page_id))")
def without_excluded(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that share neither id nor url with one of an exclusion list (every tenth page)."""
    p = table(spark, sf, "pages").select(F.col("page_id").alias("row_id"), dedupe.identity_keys(F.col("page_id").cast("string"), F.col("url")).alias("keys"))
    return dedupe.without_excluded(p, p.where("row_id % 10 = 0")).select(F.col("row_id").alias("page_id"))


QUERIES, ORACLE = plans.queries, plans.oracle
