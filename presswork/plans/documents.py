"""Article documents, metadata inputs, lookups and measured runs over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import articles as A
from ..operators import comparison as C
from ..operators import maps as M
from ..operators import state as S
from ..sources import articles as SRC
from ..sources.tables import table
from .registered import Plans
from .texts import tokens_sql

plans = Plans()


@plans.add("""SELECT doc_id, substr(md5('https://' || source || '.example.com/' || doc_id), 1, 12) AS news_id, CASE WHEN source = '' THEN source || '.example.com' ELSE source END AS source_name, source || '.example.com' AS domain,
    CASE WHEN regexp_matches(text, '[가-힣]') THEN 'ko' ELSE 'en' END AS language, (1767225600 + doc_id * 600)::BIGINT AS published FROM documents""")
def stored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Articles in their stored form."""
    view = SRC.article_view(table(spark, sf, "documents"))
    stored = A.to_documents(view, F.lit("2026-11-27T00:00:00Z").cast("timestamp"))
    doc_id = F.element_at(F.split("url", "/"), -1).cast("long")
    return stored.select(doc_id.alias("doc_id"), "news_id", F.col("source.name").alias("source_name"), F.col("source.domain").alias("domain"), "language", F.unix_seconds("published_at").alias("published"))


BODY = r"trim(regexp_replace(array_to_string(string_split(text, chr(10))[2:], ' '), '\s+', ' ', 'g'))"
TITLE = r"trim(regexp_replace(split_part(text, chr(10), 1), '\s+', ' ', 'g'))"


@plans.add(f"""WITH m AS (SELECT doc_id, {TITLE} AS title, CASE WHEN doc_id % 2 = 0 THEN {BODY} ELSE '' END AS body, {BODY} AS descr FROM documents),
    c AS (SELECT *, CASE WHEN body <> '' THEN body ELSE descr END AS chosen FROM m)
    SELECT doc_id, md5(substr(title, 1, 500)) AS title_md5, md5(CASE WHEN chosen = '' OR chosen = title THEN '' ELSE substr(chosen, 1, 6000) END) AS body_md5, CASE WHEN chosen = '' OR chosen = title THEN 'title' WHEN body <> '' THEN 'body' ELSE 'description' END AS basis FROM c""")
def metadata_inputs(spark: SparkSession, sf: str) -> DataFrame:
    a = SRC.article_view(table(spark, sf, "documents"))
    m = A.metadata_input(a.withColumn("cleaned_content", F.when(F.col("doc_id") % 2 == 0, F.col("description"))))
    return m.select("doc_id", F.md5("meta_title").alias("title_md5"), F.md5("meta_body").alias("body_md5"), "basis")


@plans.add(f"""SELECT x.conv_id, x.turn, array_to_string(list_sort(list_intersect({tokens_sql('x.text')}, {tokens_sql('y.text')}))[1:5], ',') AS shared
    FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1""")
def shared_title_tokens(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    p = c.select("conv_id", "turn", F.col("text").alias("a")).join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("b")), ["conv_id", "turn"])
    return p.select("conv_id", "turn", F.array_join(A.shared_tokens(F.col("a"), F.col("b")), ",").alias("shared"))


@plans.add("""SELECT doc_id, md5(substr(CASE WHEN trim(array_to_string(string_split(text, chr(10))[2:], ' ')) <> '' THEN trim(array_to_string(string_split(text, chr(10))[2:], ' ')) ELSE split_part(text, chr(10), 1) END, 1, 120)) AS cut_md5,
    md5(split_part(text, chr(10), 1) || '|' || array_to_string(string_split(text, chr(10))[2:], ' ')) AS cache_key FROM documents""")
def summary_fallbacks(spark: SparkSession, sf: str) -> DataFrame:
    a = SRC.article_view(table(spark, sf, "documents"))
    return a.select("doc_id", F.md5(A.summary_or_cut(F.lit(None).cast("string"), F.col("title"), F.col("description"))).alias("cut_md5"), A.summary_key(F.col("title"), F.col("description")).alias("cache_key"))


@plans.add("""WITH s AS (SELECT user_id, ts, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)
    SELECT event_id, user_id, event_type AS stage FROM s WHERE event_type IS DISTINCT FROM before""")
def stage_changes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("event_type").alias("stage"), F.col("event_id").alias("at"))
    return C.stage_changes(e, ["user_id"]).select("event_id", "user_id", "stage")


@plans.add("""SELECT user_id, count(DISTINCT CASE WHEN event_type = 'purchase' THEN event_id END) AS succeeded, count(DISTINCT CASE WHEN event_type = 'error' THEN event_id END) AS failed, count(DISTINCT event_id) AS requested,
    count(DISTINCT CASE WHEN event_type = 'purchase' THEN event_id END) + count(DISTINCT CASE WHEN event_type = 'error' THEN event_id END) AS processed FROM events GROUP BY user_id""")
def progress_counts(spark: SparkSession, sf: str) -> DataFrame:
    fate = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "error", "failed").otherwise("requeued")
    return C.progress(table(spark, sf, "events").select("user_id", F.col("event_id").alias("item"), fate.alias("fate")), ["user_id"])


@plans.add("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) <= 10 AS reserved FROM events")
def call_limit(spark: SparkSession, sf: str) -> DataFrame:
    return C.within_limit(table(spark, sf, "events").select("event_id", "user_id"), ["user_id"], "event_id", 10)


@plans.add("""WITH n AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS rank FROM lineitem WHERE l_partkey % 5 > 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY rank, l_partkey) AS n FROM n)
    SELECT l_orderkey, l_partkey AS news_id, n FROM r WHERE n <= 3""")
def rag_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """The first three neighbours of each report that weren't asked for."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("news_id"), F.col("l_linenumber").alias("rank"))
    asked = li.where("news_id % 5 = 0").select("l_orderkey", "news_id")
    return A.rag_rows(li, asked, ["l_orderkey"]).select("l_orderkey", "news_id", F.col("n").cast("long").alias("n"))


@plans.add("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 200 WHEN o_custkey % 2 = 0 THEN 410 ELSE 404 END AS code FROM orders")
def lookup_codes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", C.lookup_code(F.col("o_custkey") % 2 == 0, F.col("o_orderstatus") == "F").alias("code"))


@plans.add("""SELECT DISTINCT o.o_custkey AS sid, o.o_orderkey AS result_id FROM orders o WHERE o.o_orderstatus = 'F' OR o.o_orderkey % 10 = 0""")
def authorised_results(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("sid"), F.col("o_orderkey").alias("result_id"), "o_orderstatus")
    return C.authorised(o.select("sid", "result_id"), o.where("o_orderstatus = 'F'"), o.where("result_id % 10 = 0"))


@plans.add("SELECT p.page_id, p.url, e.page_id IS NOT NULL AS reused FROM pages p LEFT JOIN (SELECT url, min(page_id) AS page_id FROM pages WHERE page_id % 3 = 0 GROUP BY url) e USING (url)")
def cached_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs whose vector is stored under the same hash."""
    p = table(spark, sf, "pages").select("page_id", "url", F.sha2("url", 256).alias("input_hash"))
    cache = p.where("page_id % 3 = 0").groupBy("input_hash").agg(F.min(F.array(F.col("page_id").cast("double"))).alias("vector"))
    return A.with_cached_vectors(p, cache).select("page_id", "url", "reused")


@plans.add("""WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS tm, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
    f AS (SELECT user_id, n, event_id, false AS hit, tm + CASE WHEN ok THEN 60 ELSE 5 END AS ends FROM r WHERE n = 1 UNION ALL
      SELECT r.user_id, r.n, r.event_id, f.ends > r.tm, CASE WHEN f.ends > r.tm THEN f.ends ELSE r.tm + CASE WHEN r.ok THEN 60 ELSE 5 END END FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
    SELECT event_id, hit FROM f""")
def cache_reads(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), (F.col("event_type") != "error").alias("ok"))
    return S.cache_replay(e).select("event_id", "hit")


JOBS = """WITH RECURSIVE r AS (SELECT event_id, event_id // 20 AS job, event_id::DOUBLE AS tm, ['claim', 'heartbeat', 'cancel', 'claim', 'succeeded'][event_id % 5 + 1] AS c, user_id % 2 AS worker FROM events),
    f AS (SELECT job, -1::BIGINT AS event_id, 'queued' AS status, '' AS outcome, 0::DOUBLE AS lease, 0 AS starts, -1::BIGINT AS owner, 1e18 AS deadline, job * 20 - 1 AS last FROM (SELECT DISTINCT job FROM r)
      UNION ALL SELECT job, id, CASE WHEN ended THEN st WHEN c = 'claim' THEN CASE WHEN lease > tm THEN st WHEN starts >= 2 THEN 'failed' WHEN st = 'cancel_requested' THEN st ELSE 'running' END WHEN c = 'cancel' THEN CASE WHEN st = 'queued' THEN 'cancelled' ELSE 'cancel_requested' END
          WHEN owner <> worker OR lease <= tm OR c = 'heartbeat' THEN st WHEN st = 'cancel_requested' THEN 'cancelled' ELSE c END,
        CASE WHEN ended THEN 'ended' WHEN c = 'claim' AND lease > tm THEN 'busy' WHEN c = 'claim' AND starts >= 2 THEN 'worker_lost' WHEN c IN ('heartbeat', 'succeeded') AND (owner <> worker OR lease <= tm) THEN 'lease_lost' ELSE 'ok' END,
        CASE WHEN NOT ended AND ((c = 'claim' AND lease <= tm AND starts < 2) OR (c = 'heartbeat' AND owner = worker AND lease > tm)) THEN tm + 60 ELSE lease END,
        CASE WHEN NOT ended AND c = 'claim' AND lease <= tm AND starts < 2 THEN starts + 1 ELSE starts END, CASE WHEN NOT ended AND c = 'claim' AND lease <= tm AND starts < 2 THEN worker ELSE owner END,
        CASE WHEN NOT ended AND c = 'claim' AND lease <= tm AND starts < 2 AND deadline = 1e18 THEN tm + 1800 ELSE deadline END, id
      FROM (SELECT *, st IN ('succeeded', 'partial', 'failed', 'cancelled') AS ended FROM (SELECT f.job, r.event_id AS id, r.tm, r.c, r.worker, f.lease, f.starts, f.owner, f.deadline, CASE WHEN f.status NOT IN ('succeeded', 'partial', 'failed', 'cancelled') AND r.tm >= f.deadline THEN 'failed' ELSE f.status END AS st
        FROM f JOIN r ON r.job = f.job AND r.event_id = f.last + 1)))
    SELECT event_id, status, outcome FROM f WHERE event_id >= 0"""


@plans.add(JOBS)
def job_commands(spark: SparkSession, sf: str) -> DataFrame:
    return S.jobs(job_log(table(spark, sf, "events"))).select("event_id", "status", "outcome")


def job_log(events: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("claim", "heartbeat", "cancel", "claim", "succeeded")]), (F.col("event_id") % 5 + 1).cast("int"))
    return events.select("event_id", F.concat(F.lit("j"), F.floor(F.col("event_id") / 20)).alias("job_id"), F.col("event_id").cast("double").alias("at"), kind.alias("command"), (F.col("user_id") % 2).cast("string").alias("worker"))


SESSIONS = """WITH RECURSIVE r AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS tm, ['create', 'view', 'expand', 'touch', 'collapse'][event_id % 5 + 1] AS c, event_type AS item, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events),
    f AS (SELECT user_id, 0::BIGINT AS n, NULL::BIGINT AS event_id, 0 AS code, 0::DOUBLE AS ends, []::VARCHAR[] AS viewed FROM (SELECT DISTINCT user_id FROM events)
      UNION ALL SELECT r.user_id, r.n, r.event_id, CASE WHEN f.ends > r.tm OR r.c = 'create' THEN 200 ELSE 404 END, CASE WHEN f.ends > r.tm OR r.c = 'create' THEN r.tm + 86400 ELSE f.ends END,
        CASE WHEN f.ends > r.tm AND r.c = 'view' THEN list_append(list_filter(f.viewed, lambda x: x <> r.item), r.item)[-50:] WHEN f.ends <= r.tm AND r.c = 'create' THEN [] ELSE f.viewed END FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1)
    SELECT event_id, code, CASE WHEN code = 200 THEN len(viewed)::INT ELSE 0 END AS n_viewed FROM f WHERE n > 0"""


SESSION_ENDS = SESSIONS.replace("SELECT event_id, code, CASE WHEN code = 200 THEN len(viewed)::INT ELSE 0 END AS n_viewed FROM f WHERE n > 0", """SELECT user_id AS sid, round(ends, 3) AS at FROM (
      SELECT f.user_id, f.ends, lead(r.tm) OVER (PARTITION BY f.user_id ORDER BY f.n) AS next, f.code FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n)
    WHERE code = 200 AND ends <= coalesce(next, (SELECT max(tm) - 600 FROM r))""")


@plans.add(SESSIONS)
def session_commands(spark: SparkSession, sf: str) -> DataFrame:
    return S.sessions(session_log(table(spark, sf, "events"))).select("event_id", "code", F.size(F.coalesce("viewed", F.array().cast("array<string>"))).alias("n_viewed"))


def session_log(events: DataFrame) -> DataFrame:
    kind = F.element_at(F.array(*[F.lit(x) for x in ("create", "view", "expand", "touch", "collapse")]), (F.col("event_id") % 5 + 1).cast("int"))
    return events.select("event_id", F.col("user_id").alias("sid"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), kind.alias("command"), F.col("event_type").alias("item"))


MAPS = """WITH RECURSIVE r AS (SELECT l_orderkey AS map_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS seq, CASE WHEN l_linenumber = 1 THEN 'create' WHEN l_linenumber % 3 = 0 THEN 'research' ELSE 'expand' END AS c, l_linenumber - 1 AS expected, list_filter(list_distinct([l_partkey, l_suppkey]), lambda x: x <> l_orderkey) AS found,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem),
    f AS (SELECT map_id, 0::BIGINT AS n, 0::BIGINT AS seq, '' AS code, 0::BIGINT AS rev, []::BIGINT[] AS below FROM (SELECT DISTINCT map_id FROM r)
      UNION ALL SELECT r.map_id, r.n, r.seq, CASE WHEN r.c = 'create' THEN CASE WHEN f.rev > 0 THEN 'exists' ELSE 'ok' END WHEN f.rev = 0 THEN 'missing' WHEN r.expected <> f.rev THEN 'revision_conflict' ELSE 'ok' END,
        CASE WHEN r.c = 'create' AND f.rev = 0 THEN 1 WHEN r.c <> 'create' AND f.rev > 0 AND r.expected = f.rev THEN f.rev + 1 ELSE f.rev END,
        CASE WHEN r.c = 'create' AND f.rev = 0 THEN r.found WHEN r.c = 'create' OR f.rev = 0 OR r.expected <> f.rev THEN f.below WHEN r.c = 'research' THEN r.found ELSE list_distinct(list_concat(f.below, r.found)) END FROM f JOIN r ON r.map_id = f.map_id AND r.n = f.n + 1)
    SELECT map_id, seq, code, rev AS revision, CASE WHEN rev = 0 THEN 0 ELSE 1 + len(below) END::INT AS nodes FROM f WHERE n > 0"""


@plans.add(MAPS)
def map_commands(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_linenumber")
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("map_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(k, "l_partkey", "l_suppkey")).cast("long").alias("seq"), F.when(k == 1, "create").when(k % 3 == 0, "research").otherwise("expand").alias("command"), (k - 1).alias("expected"), F.lit("n1").alias("node_id"),
        F.col("l_orderkey").cast("string").alias("article"), F.array(F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("found"),
    )
    return M.replay(li).select("map_id", "seq", "code", "revision", "nodes")


QUERIES, ORACLE = plans.queries, plans.oracle
