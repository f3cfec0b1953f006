"""State folds, sessions, trees and graphs over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import maps as M
from ..operators import state as S
from ..operators import tracking as K
from ..sources import queue as Q
from ..sources.tables import shared_dir, table
from ..streaming import processors as P
from ..streaming import state as W
from . import documents
from .registered import Plans

plans = Plans()


def _events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@plans.add("SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts)::VARCHAR AS at FROM events GROUP BY user_id")
def status_latest(spark: SparkSession, sf: str) -> DataFrame:
    latest = S.latest_status(_events(spark, sf), "user_id", "event_type", "ts", "event_id")
    return latest.select("user_id", "status", F.col("at").cast("string").alias("at"))


@plans.add("SELECT floor((floor(epoch(ts)) + 32400) / 86400)::BIGINT AS day, count(*) AS n, round(sum(value), 4) AS units FROM events GROUP BY 1")
def kst_daily_units(spark: SparkSession, sf: str) -> DataFrame:
    return _events(spark, sf).groupBy(K.kst_day(F.col("ts")).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("units"))


@plans.add("""WITH g AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > 1800000000, true) AS fresh FROM events), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
    SELECT user_id, session::BIGINT AS session, min(ts)::VARCHAR AS begin, max(ts)::VARCHAR AS "end", count(*) AS n FROM s GROUP BY 1, 2""")
def session_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: sessions that end after half an hour without an event."""
    s = S.session_windows(_events(spark, sf), "user_id", "ts", 1800)
    return s.select("user_id", "session", F.col("begin").cast("string").alias("begin"), F.col("end").cast("string").alias("end"), "n")


@plans.add("""WITH RECURSIVE e AS (SELECT s_suppkey AS c, CASE WHEN s_suppkey > 0 THEN (s_suppkey - 1) // 4 END AS p FROM supplier), walk AS (SELECT c AS root, c AS node_id, 0 AS level FROM e UNION ALL SELECT w.root, e.c, w.level + 1 FROM walk w JOIN e ON w.node_id = e.p)
    SELECT root, node_id, level FROM walk""")
def descendants(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    nodes = table(spark, sf, "supplier").select(F.lit(1).alias("map_id"), k.alias("node_id"), F.when(k > 0, F.floor((k - 1) / 4)).alias("parent_id"))
    return M.descendants(nodes).select("root", "node_id", "level")


@plans.add("""WITH RECURSIVE e AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 10 > 0 THEN s_suppkey - 1 END AS prev FROM supplier), b AS (SELECT id AS map_id, prev AS ancestor, 1 AS distance FROM e WHERE prev IS NOT NULL UNION ALL SELECT b.map_id, e.prev, b.distance + 1 FROM b JOIN e ON b.ancestor = e.id WHERE e.prev IS NOT NULL)
    SELECT map_id, ancestor, distance FROM b""")
def ancestors(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    return M.ancestors(table(spark, sf, "supplier").select(k.alias("map_id"), F.when(k % 10 > 0, k - 1).alias("previous_map_id")))


@plans.add("""SELECT r_regionkey AS graph, r_regionkey AS news_id, 0 AS distance, true AS is_center, NULL::DOUBLE AS relevance_score FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
    UNION ALL SELECT n_regionkey, n_nationkey, 1, false, n_nationkey / 100.0::DOUBLE FROM nation""")
def star_graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("centre_id"), F.col("n_nationkey").alias("news_id"), (F.col("n_nationkey") / 100.0).alias("score"))
    return M.star_graph(n)[0]


@plans.add("SELECT map_id, CASE WHEN status = 'expandable' THEN 'insufficient' ELSE status END AS status, returned < requested AS shortage, next FROM (SELECT o_orderkey AS map_id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'insufficient' ELSE 'expandable' END AS status, 4 AS requested, (o_custkey % 5)::INT AS returned, (o_orderstatus = 'F' OR (o_orderstatus = 'O' AND o_custkey % 2 = 0)) AS next FROM orders)")
def selection_states(spark: SparkSession, sf: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "insufficient").otherwise("expandable")
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("map_id"), status.alias("status"), (F.col("o_custkey") % 5).cast("int").alias("returned"), F.when(F.col("o_custkey") % 2 == 0, "m").alias("previous"))
    s = M.shortage(F.col("status"), F.lit(4), F.col("returned"))
    return o.select("map_id", s["status"].alias("status"), s["shortage"].alias("shortage"), M.can_find_next(F.lit("n1"), F.lit(False), F.col("status"), F.col("previous")).alias("next"))


QUOTA = """WITH RECURSIVE r AS (SELECT event_id, event_type, user_id, epoch_us(ts) / 1e6 AS tm, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events),
    f AS (SELECT event_type, 0::BIGINT AS n, NULL::BIGINT AS event_id, NULL::BOOLEAN AS accepted, 0::BIGINT AS retry_after, 0 AS gc, 0::DOUBLE AS ge, MAP([-1::BIGINT], [{'c': 0, 'e': 0::DOUBLE}]) AS u FROM (SELECT DISTINCT event_type FROM events)
      UNION ALL SELECT s.event_type, s.n, s.event_id, wait = 0, ceil(wait)::BIGINT, CASE WHEN wait = 0 THEN gc2 + 1 ELSE gc END, CASE WHEN wait = 0 THEN ge2 ELSE ge END,
        CASE WHEN wait = 0 THEN map_concat(u, MAP([s.user_id], [{'c': uc + 1, 'e': ue}])) ELSE u END
      FROM (SELECT *, greatest(CASE WHEN gc2 >= 30 THEN ge2 - tm ELSE 0 END, CASE WHEN uc >= 3 THEN ue - tm ELSE 0 END) AS wait FROM (
        SELECT r.event_type, r.n, r.event_id, r.user_id, r.tm, f.gc, f.ge, f.u, CASE WHEN f.ge <= r.tm THEN 0 ELSE f.gc END AS gc2, CASE WHEN f.ge <= r.tm THEN r.tm + 3600 ELSE f.ge END AS ge2,
          CASE WHEN coalesce(f.u[r.user_id].e, 0) <= r.tm THEN 0 ELSE f.u[r.user_id].c END AS uc, CASE WHEN coalesce(f.u[r.user_id].e, 0) <= r.tm THEN r.tm + 3600 ELSE f.u[r.user_id].e END AS ue
        FROM f JOIN r ON r.event_type = f.event_type AND r.n = f.n + 1)) s)
    SELECT event_id, accepted, retry_after FROM f WHERE n > 0"""


@plans.add(QUOTA)
def quota_fixed_window(spark: SparkSession, sf: str) -> DataFrame:
    """At most 30 requests an hour of each event type, and 3 of a user, the window from the first accepted one."""
    e = _events(spark, sf).select("event_id", F.col("event_type").alias("action"), F.col("user_id").cast("string").alias("user"), (F.unix_micros("ts") / 1e6).alias("at"))
    return S.quota(e, {"": 30, "user": 3}).select("event_id", "accepted", "retry_after")


BUDGET = """WITH RECURSIVE r AS (SELECT event_id, event_type, user_id, epoch_us(ts) / 1e6 AS tm, floor((epoch_us(ts) / 1e6 + 32400) / 86400) AS day, event_id % 3 + 1 AS units, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS n FROM events),
    f AS (SELECT event_type, 0::BIGINT AS n, NULL::BIGINT AS event_id, '' AS status, 0::BIGINT AS retry_after, -1::DOUBLE AS day, 0::BIGINT AS used, MAP([-1::BIGINT], [0::BIGINT]) AS jobs FROM (SELECT DISTINCT event_type FROM events)
      UNION ALL SELECT event_type, n, event_id, status, CASE WHEN status = 'daily_exceeded' THEN greatest(1, ceil((d + 1) * 86400 - 32400 - tm))::BIGINT ELSE 0 END, CASE WHEN status = 'charged' THEN d ELSE day END, CASE WHEN status = 'charged' THEN u + units ELSE used END,
        CASE WHEN status = 'charged' THEN map_concat(jobs, MAP([user_id], [j + units])) ELSE jobs END
      FROM (SELECT *, CASE WHEN j + units > 32 THEN 'job_exceeded' WHEN u + units > 80 THEN 'daily_exceeded' ELSE 'charged' END AS status FROM (
        SELECT r.event_type, r.n, r.event_id, r.user_id, r.tm, r.units, r.day AS d, f.day, f.used, f.jobs, coalesce(f.jobs[r.user_id], 0) AS j, CASE WHEN f.day = r.day THEN f.used ELSE 0 END AS u FROM f JOIN r ON r.event_type = f.event_type AND r.n = f.n + 1)))
    SELECT event_id, status, retry_after FROM f WHERE n > 0"""


@plans.add(BUDGET)
def budget_fold(spark: SparkSession, sf: str) -> DataFrame:
    """Units charged to a day and a job of each ledger in order, denied ones not counted."""
    e = _events(spark, sf).select("event_id", F.col("event_type").alias("ledger"), (F.unix_micros("ts") / 1e6).alias("at"), F.col("user_id").cast("string").alias("job_id"), (F.col("event_id") % 3 + 1).alias("units"))
    return S.budget(e, daily=80, per_job=32).select("event_id", "status", "retry_after")


WRITES = """WITH RECURSIVE w AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 4 END AS expected FROM events),
    f AS (SELECT user_id, event_id, n, expected = 0 AS accepted, (expected = 0)::BIGINT AS revision FROM w WHERE n = 1 UNION ALL SELECT w.user_id, w.event_id, w.n, w.expected = f.revision, f.revision + (w.expected = f.revision)::BIGINT FROM f JOIN w ON w.user_id = f.user_id AND w.n = f.n + 1)
    SELECT event_id, accepted, revision FROM f"""


@plans.add(WRITES)
def revision_writes(spark: SparkSession, sf: str) -> DataFrame:
    """Writes that name the revision they expect; only those that are right count."""
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("event_id") % 4).alias("expected"))
    return S.compare_and_set(e).select("event_id", "accepted", "revision")


@plans.add("""WITH r AS (SELECT *, first_value(value > 5) OVER w AS h0, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, CASE WHEN n = 1 THEN 'created' WHEN (value > 5) = h0 THEN 'replayed' ELSE 'conflict' END AS outcome FROM r""")
def idempotent_admissions(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("idempotency_key"), F.col("event_id").alias("seq"), (F.col("value") > 5).cast("string").alias("content_hash"), F.col("event_id").cast("string").alias("job_id"))
    return S.admissions(e).select("event_id", "outcome")


@plans.add("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def flag_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: subtotals."""
    return table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count_distinct("l_suppkey").alias("suppliers"))


@plans.add("SELECT time_bucket(INTERVAL 1 HOUR, ts)::VARCHAR AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def hourly_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Extension: tumbling windows."""
    w = _events(spark, sf).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value"))
    return w.select(F.col("w.start").cast("string").alias("start"), "event_type", "n", "value")


def _drained(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """All that a stream gives of what is there now, written to the session's shared folder and read back."""
    base = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/log").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))


@plans.add("SELECT DISTINCT user_id, event_type FROM events")
def stream_deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    """Users' kinds of events by a stream, each once within a window longer than the table."""
    e = _event_stream(spark, sf).withColumn("pair", F.concat_ws("/", "user_id", "event_type"))
    return _drained(spark, W.deduplicated(e, "pair", "ts", 40 * 86400).select("user_id", "event_type"), "dedup")


@plans.add("""WITH r AS (SELECT event_id, user_id, event_id::DOUBLE AS tm, [200, 429, 500, 404][event_id % 4 + 1] AS code, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, min(event_id) OVER (PARTITION BY user_id) AS began FROM events)
    SELECT event_id, CASE WHEN tm - began >= 2000 THEN 'expired' WHEN code = 200 THEN 'done' WHEN code IN (429, 500) THEN 'requeued' ELSE 'failed' END AS fate,
      (count(*) FILTER (code = 429 AND tm - began < 2000) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING))::INT AS key_index FROM r""")
def retry_fates(spark: SparkSession, sf: str) -> DataFrame:
    """What becomes of each attempt of a job, and which provider key it has come to."""
    codes = F.array(*[F.lit(x) for x in (200, 429, 500, 404)])
    code = F.element_at(codes, (F.col("event_id") % 4 + 1).cast("int"))
    e = table(spark, sf, "events").select("event_id", F.col("user_id").alias("job_id"), F.col("event_id").cast("double").alias("at"), F.lit("x").alias("item"), code.alias("code"), code.isin(429, 500).alias("retryable"))
    return S.retry_queue(e, seconds=2000).select("event_id", "fate", "key_index")


@plans.add(WRITES)
def stream_revision_writes(spark: SparkSession, sf: str) -> DataFrame:
    """revision_writes by a stateful stream."""
    e = _event_stream(spark, sf).select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("event_id") % 4).alias("expected"))
    out = W.stateful(e, "key", "seq", S.revision_step, "accepted boolean, revision long")
    return _drained(spark, out.select(F.col("seq").alias("event_id"), "accepted", "revision"), "revisions")


@plans.add(documents.SESSIONS)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """session_commands by a stream of typed state and timers; rows of sessions that ran out are stream_session_ends."""
    return _session_stream(spark, sf).where("seq IS NOT NULL").select(F.col("seq").alias("event_id"), "code", F.size(F.coalesce("viewed", F.array().cast("array<string>"))).alias("n_viewed"))


@plans.add(documents.SESSION_ENDS)
def stream_session_ends(spark: SparkSession, sf: str) -> DataFrame:
    """When each session ran out: told by timers, up to ten minutes before the newest event."""
    return _session_stream(spark, sf).where("command = 'expired'").select(F.col("sid").cast("long").alias("sid"), F.round("at", 3).alias("at"))


def _session_stream(spark: SparkSession, sf: str) -> DataFrame:
    commands = documents.session_log(_event_stream(spark, sf)).withColumn("seq", F.col("event_id"))
    return _drained(spark, P.sessions(commands), "sessions")


@plans.add(documents.JOBS)
def stream_jobs(spark: SparkSession, sf: str) -> DataFrame:
    """job_commands by a stream whose leases and deadlines are timers."""
    commands = documents.job_log(_event_stream(spark, sf)).withColumns({"seq": F.col("event_id"), "at": F.col("at") + 1})  # a watermark begins at 0, which would be late
    return _drained(spark, P.jobs(commands, late="100 days"), "jobs").where("seq IS NOT NULL").select(F.col("seq").alias("event_id"), "status", "outcome")


@plans.add("SELECT doc_id::VARCHAR AS payload, CASE WHEN doc_id % 97 = 0 THEN 0 ELSE 1 END AS deliveries, CASE WHEN doc_id % 97 = 0 THEN 'malformed' ELSE 'deliveries' END AS reason FROM documents WHERE doc_id % 97 = 0 OR doc_id % 89 = 0")
def queue_bad_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Documents' ids through a queue; those that are malformed or fail as often as they may are its bad messages."""
    base = f"{shared_dir(spark)}/queue-{uuid.uuid4().hex}"
    Q.publish(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("payload")), f"{base}/messages")
    n = F.col("payload").cast("long")
    work = lambda batch: batch.withColumn("outcome", F.when(n % 97 == 0, "malformed").when(n % 89 == 0, "error").otherwise("done"))
    write, held = Q.consumer(spark, f"{base}/held", work, most=1)
    q = Q.messages(spark, f"{base}/messages", in_flight=1_000_000).writeStream.foreachBatch(write).option("checkpointLocation", f"{base}/log").trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return Q.bad(held).select("payload", "deliveries", "reason")


QUERIES, ORACLE = plans.queries, plans.oracle
