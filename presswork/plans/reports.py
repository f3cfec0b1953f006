"""Evidence, claims, verdicts, usage and stored results over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..sources import buckets, sinks
from ..sources.tables import shared_dir, table
from .registered import Plans

plans = Plans()


@plans.add("SELECT d.doc_id, count(*) AS n_items, min(b.item_id) AS first_item FROM documents d JOIN benchmark b ON contains(trim(regexp_replace(d.text, '\\s+', ' ', 'g')), trim(regexp_replace(b.text, '\\s+', ' ', 'g'))) GROUP BY d.doc_id")
def quote_in_body(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages that stand in a document, white space aside; the passages are the stated query set."""
    quotes = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("quote"))
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    hits = E.loose_quotes(quotes, docs, "quote", "body")
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.min("item_id").alias("first_item"))


CLAIMS_SQL = """WITH c AS (SELECT d.lang, l.doc_id, l.quality = 1 AS sentence_found, CASE WHEN l.toxic = 1 THEN 'refuted' WHEN l.quality = 1 THEN 'supported' ELSE 'unclear' END AS verdict
    FROM labels l JOIN documents d USING (doc_id))"""


@plans.add(CLAIMS_SQL + """ SELECT lang, count(*) AS total, count(*) FILTER (verdict = 'supported') AS supported, count(*) FILTER (verdict = 'refuted') AS refuted, count(*) FILTER (verdict = 'unclear') AS unclear,
    count(*) FILTER (NOT sentence_found) AS sentence_missing, count(*) FILTER (verdict = 'refuted' OR (verdict = 'unclear' AND NOT sentence_found)) AS problems,
    CASE WHEN count(*) FILTER (verdict = 'supported') = count(*) THEN 'passed' ELSE 'warning' END AS status FROM c GROUP BY lang""")
def claim_summary(spark: SparkSession, sf: str) -> DataFrame:
    v = F.when(F.col("toxic") == 1, "refuted").when(F.col("quality") == 1, "supported").otherwise("unclear")
    claims = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    return E.claim_summary(claims.select("lang", (F.col("quality") == 1).alias("sentence_found"), v.alias("verdict"), F.lit(False).alias("check_failed")), ["lang"])


CONV_LISTS = """WITH c AS (SELECT conv_id, list_sort(list(turn::VARCHAR)) AS requested, coalesce(list(turn::VARCHAR) FILTER (role = 'user'), []) AS used, coalesce(list(turn::VARCHAR) FILTER (role <> 'user' AND turn % 3 > 0), []) AS failed,
    coalesce(list(turn::VARCHAR) FILTER (length(text) % 7 = 0), []) AS stock FROM conversations GROUP BY conv_id)"""


@plans.add(CONV_LISTS + """ SELECT conv_id, concat_ws(',', CASE WHEN len(list_intersect(used, failed)) > 0 THEN 'overlap' END,
      CASE WHEN list_sort(list_distinct(list_concat(used, failed))) <> list_sort(list_distinct(requested)) THEN 'not_requested' END,
      CASE WHEN len(failed) <> 1 THEN 'coverage' END, CASE WHEN len(list_filter(stock, lambda s: NOT list_contains(used, s))) > 0 THEN 'unused_stock_evidence' END) AS problems FROM c""")
def report_constraints(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn").cast("string")
    some = lambda test: F.collect_list(F.when(test, t))
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.collect_list(t).alias("requested"), some(F.col("role") == "user").alias("used"), some((F.col("role") != "user") & (F.col("turn") % 3 > 0)).alias("failed"), some(F.length("text") % 7 == 0).alias("stock"),
    )
    problems = E.report_problems(F.col("requested"), F.col("used"), F.col("failed"), F.col("stock"), F.size("used"), F.lit(1))
    return c.select("conv_id", F.array_join(problems, ",").alias("problems"))


@plans.add("""WITH m AS (SELECT max(ts) AS now FROM events), r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
    SELECT user_id, event_id FROM r, m WHERE n = 1 AND floor(epoch(now)) - floor(epoch(ts)) <= 86400""")
def latest_body_ttl(spark: SparkSession, sf: str) -> DataFrame:
    """Newest row of each key, if it is at most a day older than the newest of all."""
    e = table(spark, sf, "events").select(F.col("user_id"), F.col("event_id").alias("body_id"), F.col("ts").cast("timestamp").alias("extracted_at"))
    now = e.agg(F.max("extracted_at")).first()[0]
    fresh = E.latest_body(e, F.lit(now), key="user_id", seconds=86400)
    return fresh.select("user_id", F.col("body_id").alias("event_id"))


@plans.add("""WITH s AS (SELECT o_orderkey AS row_id, o_custkey AS gen FROM orders WHERE o_orderkey % 2 = 0), n AS (SELECT o_orderkey + (o_orderkey % 3) AS row_id, o_custkey + 1 AS gen, o_orderkey FROM orders WHERE o_orderkey % 2 = 1),
    k AS (SELECT gen, min(row_id) AS stored_id FROM s GROUP BY gen)
    SELECT n.o_orderkey, k.stored_id::VARCHAR AS stored_id, CASE WHEN k.stored_id IS NOT NULL THEN 'reused' WHEN s.row_id IS NOT NULL THEN 'id_collision' ELSE 'insert' END AS outcome FROM n LEFT JOIN k ON n.gen = k.gen LEFT JOIN s ON s.row_id = n.row_id""")
def append_once(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    stored = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("gen"))
    new = o.where("o_orderkey % 2 = 1").select((F.col("o_orderkey") + F.col("o_orderkey") % 3).alias("row_id"), (F.col("o_custkey") + 1).alias("gen"), "o_orderkey")
    return E.append_once(new, stored, "row_id", "gen").select("o_orderkey", F.col("stored_id").cast("string").alias("stored_id"), "outcome")


UPSERTED = """WITH n AS (SELECT c_custkey, c_name || '!' AS c_name, round(c_acctbal, 2) AS c_acctbal, 'new' AS created_at FROM customer WHERE c_custkey % 3 = 0), s AS (SELECT c_custkey, c_name, round(c_acctbal, 2) AS c_acctbal, 'old' AS created_at FROM customer WHERE c_custkey % 2 = 0)
    SELECT coalesce(s.c_custkey, n.c_custkey) AS c_custkey, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_name ELSE s.c_name END AS c_name, CASE WHEN n.c_custkey IS NOT NULL THEN n.c_acctbal ELSE s.c_acctbal END AS c_acctbal, coalesce(s.created_at, n.created_at) AS created_at
    FROM s FULL JOIN n USING (c_custkey)""".replace("coalesce(s.c_custkey, n.c_custkey) AS c_custkey", "c_custkey").replace("n.c_custkey IS NOT NULL", "n.c_name IS NOT NULL")


@plans.add(UPSERTED)
def upsert_rows(spark: SparkSession, sf: str) -> DataFrame:
    stored, new = _customers(spark, sf)
    return sinks.upsert(stored, new, "c_custkey", keep=("created_at",))


@plans.add(UPSERTED)
def merged_table(spark: SparkSession, sf: str) -> DataFrame:
    """upsert_rows as two merges of a stored table, each of which rewrites the buckets of its own rows, and one that is repeated."""
    stored, new = _customers(spark, sf)
    merge = lambda old, rows: sinks.upsert(old, rows, "c_custkey", keep=("created_at",))
    held = buckets.Table.create(stored, f"{shared_dir(spark)}/merged-{uuid.uuid4().hex}", "c_custkey", 16)
    held.merge(new.where("c_custkey % 2 = 0"), merge, "loader", 1)
    for _ in range(2):
        held.merge(new.where("c_custkey % 2 = 1"), merge, "loader", 2)
    return held.read()


def _customers(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf, "customer").withColumn("c_acctbal", F.round("c_acctbal", 2))
    stored = c.where("c_custkey % 2 = 0").select("c_custkey", "c_name", "c_acctbal", F.lit("old").alias("created_at"))
    new = c.where("c_custkey % 3 = 0").select("c_custkey", F.concat("c_name", F.lit("!")).alias("c_name"), "c_acctbal", F.lit("new").alias("created_at"))
    return stored, new


@plans.add("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations")
def conversation_trace(spark: SparkSession, sf: str) -> DataFrame:
    return E.trace(table(spark, sf, "conversations"), ["conv_id"], "turn").select("conv_id", "turn", F.col("seq").cast("long").alias("seq"))


@plans.add("""WITH f AS (SELECT conv_id, role AS name, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)
    SELECT conv_id, name, turn, false AS too_many_targets FROM f WHERE n <= 2""")
def first_arguments(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "conversations").select("conv_id", F.col("role").alias("name"), F.lit(None).cast("string").alias("ticker"), F.col("turn").alias("position"))
    return E.first_arguments(a, ["conv_id"]).select("conv_id", "name", F.col("position").alias("turn"), "too_many_targets")


@plans.add("""WITH c AS (SELECT conv_id, turn, 'c' || (turn % 4) AS claim_id, role, length(text) AS n FROM conversations), v AS (SELECT conv_id, turn, claim_id FROM c WHERE n % 5 > 0),
    u AS (SELECT conv_id, claim_id FROM v GROUP BY 1, 2 HAVING count(*) = 1) SELECT v.conv_id, v.turn, v.claim_id FROM v JOIN u USING (conv_id, claim_id)""")
def usable_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of known value, claims judged twice left out."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("c"), (F.col("turn") % 4).cast("string")).alias("claim_id"), F.when(F.length("text") % 5 > 0, "supported").otherwise("maybe").alias("verdict"))
    return E.usable_verdicts(c, ["conv_id"]).select("conv_id", "turn", "claim_id")


@plans.add("""WITH i AS (SELECT l_orderkey, l_linenumber, (l_partkey % 4)::INT AS target_index FROM lineitem), s AS (SELECT l_orderkey, l_linenumber - 1 AS position, l_suppkey FROM lineitem),
    s1 AS (SELECT l_orderkey, position, min(l_suppkey) AS stock_name FROM s GROUP BY 1, 2),
    j AS (SELECT i.l_orderkey, i.l_linenumber, i.target_index, s1.stock_name FROM i LEFT JOIN s1 ON i.l_orderkey = s1.l_orderkey AND i.target_index = s1.position),
    o AS (SELECT l_orderkey, bool_or(stock_name IS NULL) AS unknown, count(DISTINCT target_index) < count(*) AS twice FROM j GROUP BY 1)
    SELECT j.l_orderkey, j.l_linenumber, j.target_index, j.stock_name::VARCHAR AS stock_name, CASE WHEN unknown THEN 'unknown_target' WHEN twice THEN 'duplicate_target' ELSE 'ok' END AS status FROM j JOIN o USING (l_orderkey)""")
def resolve_targets(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    items = li.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 4).cast("int").alias("target_index"))
    stocks = li.groupBy("l_orderkey", (F.col("l_linenumber") - 1).alias("position")).agg(F.min("l_suppkey").alias("name")).withColumn("ticker", F.lit(None).cast("string"))
    return E.resolve_targets(items, stocks, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "target_index", F.col("stock_name").cast("string").alias("stock_name"), "status")


@plans.add("""WITH u AS (SELECT event_type, user_id, CASE WHEN event_id % 97 = 0 THEN NULL ELSE (json_extract_string(props, '$.k'))::BIGINT END AS tokens FROM events)
    SELECT event_type, user_id, CASE WHEN count(*) FILTER (tokens IS NULL OR tokens < 0) = 0 THEN sum(tokens)::BIGINT::VARCHAR END AS total_tokens, count(*) AS calls FROM u GROUP BY 1, 2""")
def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Token totals, null where one count is unknown."""
    tokens = F.when(F.col("event_id") % 97 != 0, F.get_json_object("props", "$.k").cast("long"))
    return E.usage_total(table(spark, sf, "events").select("event_type", "user_id", tokens.alias("tokens")), ["event_type", "user_id"]).withColumn("total_tokens", F.col("total_tokens").cast("string"))


@plans.add("""WITH r AS (SELECT conv_id, turn + 1 AS round, (length(text) % 3 > 0) AS taken FROM conversations), f AS (SELECT conv_id, round, bool_and(taken) OVER (PARTITION BY conv_id ORDER BY round ROWS UNBOUNDED PRECEDING) AS adopted FROM r WHERE round <= 2)
    SELECT conv_id, round, adopted FROM f""")
def revision_rounds(spark: SparkSession, sf: str) -> DataFrame:
    r = table(spark, sf, "conversations").select("conv_id", (F.col("turn") + 1).alias("round"), (F.length("text") % 3 > 0).alias("taken"))
    return E.revision_rounds(r, ["conv_id"]).select("conv_id", "round", "adopted")


@plans.add("""WITH b AS (SELECT conv_id, turn, text AS content, length(text) % 2 = 0 AS supported, turn % 2 = 0 AS target FROM conversations), a AS (SELECT conv_id, turn, CASE WHEN length(text) % 5 = 0 THEN text || '.' ELSE text END AS content, length(text) % 3 > 0 AS supported FROM conversations WHERE length(text) % 7 > 0),
    j AS (SELECT b.conv_id, b.turn, b.supported, b.target, CASE WHEN a.content IS NULL THEN 'removed' WHEN a.content <> b.content THEN 'rewritten' ELSE 'kept' END AS action, a.supported AS now FROM b LEFT JOIN a USING (conv_id, turn))
    SELECT conv_id, turn, action, (target OR (action = 'kept' AND (NOT supported OR coalesce(now, false)))) AS intact FROM j""")
def claim_changes(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    n = F.length("text")
    before = c.select("conv_id", F.col("turn").alias("claim_id"), F.col("text").alias("content"), F.when(n % 2 == 0, "supported").otherwise("unclear").alias("verdict"), (F.col("turn") % 2 == 0).alias("target"))
    after = c.where(n % 7 > 0).select("conv_id", F.col("turn").alias("claim_id"), F.when(n % 5 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")).alias("content"), F.when(n % 3 > 0, "supported").otherwise("unclear").alias("verdict"))
    return E.claim_changes(before, after, ["conv_id"]).select("conv_id", F.col("claim_id").alias("turn"), "action", "intact")


@plans.add("SELECT doc_id, source, least(12000, floor(60000 / count(*) OVER (PARTITION BY source)))::INT AS budget FROM documents")
def evidence_budget(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("content"))
    return E.evidence_budget(d, ["source"]).select("doc_id", "source", "budget")


@plans.add("""WITH q AS (SELECT doc_id, coalesce(split_part(text, chr(10), 1), '') AS line FROM documents) SELECT doc_id, regexp_matches(line, '[\\p{L}\\p{N}%]') AS sentence_found FROM q""")
def quotes_checked(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's first line as a quote of its own text, numbers uncut."""
    d = table(spark, sf, "documents")
    claims = d.select("doc_id", F.lit("c1").alias("claim_id"), F.array(F.struct(F.col("doc_id").cast("string").alias("news_id"), F.element_at(F.split("text", "\n"), 1).alias("sentence"))).alias("refs"))
    bodies = d.select("doc_id", F.col("doc_id").cast("string").alias("news_id"), F.col("text").alias("input_excerpt"))
    return E.check_quotes(claims, bodies, ["doc_id"]).select("doc_id", "sentence_found")


QUERIES, ORACLE = plans.queries, plans.oracle
