"""From a model's text to a checked report: parsing, claims, verdicts, revisions, debate, strategy.

The model texts are JSON put together from the conversations, some of them broken on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs as U
from ..operators import comparison as C
from ..operators import evidence as E
from ..sources.tables import table
from .registered import Plans

plans = Plans()


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id, turn, raw: a model's text for each turn."""
    k = F.col("conv_id") * 7 + F.col("turn")
    good = F.concat(F.lit('{"title": "t'), F.col("turn").cast("string"), F.lit('", "list": [1, 2]}'))
    raw = F.when(k % 7 == 0, "").when(k % 7 == 1, "  \n").when(k % 7 == 2, "[1, 2]").when(k % 7 == 3, "{broken").when(k % 7 == 4, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(k % 7 == 5, F.concat(F.lit("so: "), good, F.lit(" ok"))).otherwise(good)
    return table(spark, sf, "conversations").select("conv_id", "turn", raw.alias("raw"))


@plans.add("""SELECT conv_id, turn, CASE (conv_id * 7 + turn) % 7 WHEN 0 THEN 'empty_response' WHEN 1 THEN 'empty_response' WHEN 2 THEN 'json_not_object' WHEN 3 THEN 'invalid_json' WHEN 5 THEN 'invalid_json' ELSE 'ok' END AS status,
    CASE WHEN (conv_id * 7 + turn) % 7 IN (4, 5, 6) THEN '{"title": "t' || turn || '", "list": [1, 2]}' ELSE '' END AS found FROM conversations""")
def answer_statuses(spark: SparkSession, sf: str) -> DataFrame:
    """Whether an answer can be parsed, and the object that a lenient reading finds in it."""
    raw = F.col("raw")
    return _answers(spark, sf).select("conv_id", "turn", E.parse_status(raw).alias("status"), F.coalesce(T.lenient_object(raw), F.lit("")).alias("found"))


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    """o_orderkey, raw, allowed: a report's JSON for each order."""
    k = F.col("o_orderkey")
    stock = lambda i: F.struct(F.lit("005930").alias("ticker"), F.when(k % 11 == 3, "").otherwise("A").alias("name"), F.lit("up").alias("impact"), F.when(k % 11 == 4, "sideways").otherwise("up").alias("direction"), F.array(F.when((k % 11 == 5) & (F.lit(i) == 0), "n9").otherwise("n1")).alias("evidence_news_ids"), F.array(F.lit("c1")).alias("claim_ids"))
    claim = lambda i: F.struct(F.when(F.lit(i) == 2, "c1").when((F.lit(i) == 3) & (k % 2 == 0), "x").otherwise(f"c{i + 1}").alias("claim_id"), F.lit("text").alias("text"), F.when((F.lit(i) == 1) & (k % 3 == 0), "guess").otherwise("fact").alias("kind"), F.array(F.struct(F.lit("n1").alias("news_id"), F.lit("s").alias("sentence"))).alias("evidence"), F.lit("f").alias("falsifier"))
    stocks = F.slice(F.array(*[stock(i) for i in range(8)]), 1, F.when(k % 11 == 6, 7).otherwise(2))
    report = F.struct(F.when(k % 11 == 1, " ").otherwise("T").alias("title"), F.lit("s").alias("event_summary"), F.lit("a").alias("event_analysis"), F.lit("m").alias("market_impact"), stocks.alias("stock_impacts"), F.array(F.lit("r")).alias("risk_factors"), F.array(*[claim(i) for i in range(5)]).alias("claims"))
    return table(spark, sf, "orders").select(k, F.when(k % 11 == 2, "no json").otherwise(F.to_json(report)).alias("raw"))


@plans.add("""SELECT o_orderkey, CASE o_orderkey % 11 WHEN 1 THEN 'invalid_report' WHEN 2 THEN 'invalid_report' WHEN 3 THEN 'invalid_report' WHEN 4 THEN 'invalid_report' WHEN 5 THEN 'unused_evidence' WHEN 6 THEN 'too_many_stocks' ELSE 'ok' END AS status,
    CASE WHEN o_orderkey % 11 = 2 THEN '' ELSE 'c1' || CASE WHEN o_orderkey % 3 > 0 THEN ',c2' ELSE '' END || CASE WHEN o_orderkey % 2 = 1 THEN ',c4' ELSE '' END || ',c5' END AS claims FROM orders""")
def report_drafts(spark: SparkSession, sf: str) -> DataFrame:
    """Why a report can't be used, and the claims of it that can be checked."""
    r = E.parse_report(F.col("raw"))
    return _reports(spark, sf).withColumn("r", r).select("o_orderkey", E.report_status(F.col("r"), F.array(F.lit("n1"), F.lit("n2"))).alias("status"), F.array_join(F.transform(E.valid_claims(F.col("r.claims")), lambda c: c["claim_id"]), ",").alias("claims"))


VERDICTS = """WITH c AS (SELECT conv_id, turn AS position, 'c' || (turn + 1) AS claim_id, (conv_id + turn) % 4 > 0 AS found FROM conversations), o AS (SELECT *, found AND row_number() OVER (PARTITION BY conv_id, found ORDER BY position) <= 12 AS sent FROM c),
    v AS (SELECT conv_id, 'c' || (turn + 1) AS claim_id, ['supported', 'refuted', 'unclear'][(length(text) % 3 + 1)::INT] AS verdict, 'why ' || turn AS reason FROM conversations WHERE conv_id % 5 > 0 AND (conv_id + turn) % 6 > 0),
    j AS (SELECT o.*, CASE WHEN sent THEN v.verdict END AS verdict, v.reason FROM o LEFT JOIN v USING (conv_id, claim_id)), x AS (SELECT *, bool_or(sent) OVER w AND count(verdict) OVER w = 0 AS check_failed FROM j WINDOW w AS (PARTITION BY conv_id))"""


def _verified(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "conversations")
    claim = F.concat(F.lit("c"), (F.col("turn") + 1).cast("string"))
    claims = c.select("conv_id", claim.alias("claim_id"), F.col("turn").alias("position"), ((F.col("conv_id") + F.col("turn")) % 4 > 0).alias("sentence_found"))
    told = c.where("conv_id % 5 > 0 AND (conv_id + turn) % 6 > 0").select("conv_id", claim.alias("claim_id"), F.element_at(F.array(*[F.lit(x) for x in ("supported", "refuted", "unclear")]), (F.length("text") % 3 + 1).cast("int")).alias("verdict"), F.concat(F.lit(" why  "), F.col("turn").cast("string")).alias("reason"))
    return E.verify_claims(claims, told, ["conv_id"])


@plans.add(VERDICTS + """ SELECT conv_id, claim_id, coalesce(verdict, 'unclear') AS verdict, CASE WHEN NOT found THEN 'sentence_missing' WHEN verdict IS NOT NULL THEN reason WHEN check_failed THEN 'critic_failed' ELSE 'verdict_omitted' END AS reason, check_failed,
    coalesce(verdict, 'unclear') = 'refuted' OR (verdict IS NULL AND NOT found) OR (verdict = 'unclear' AND NOT found) AS problem FROM x""")
def verified_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Each claim's verdict, or why it has none."""
    return _verified(spark, sf).select("conv_id", "claim_id", "verdict", "reason", "check_failed", E.is_problem(F.col("verdict"), F.col("sentence_found")).alias("problem"))


@plans.add(VERDICTS + """, y AS (SELECT *, coalesce(verdict, 'unclear') AS told FROM x)
    SELECT conv_id, string_agg(claim_id, ',' ORDER BY position) FILTER (told = 'refuted' OR (told = 'unclear' AND NOT found)) IS NOT NULL AND NOT bool_or(check_failed) AS revise,
      CASE WHEN bool_or(check_failed) THEN '' ELSE coalesce(string_agg(claim_id, ',' ORDER BY position) FILTER (told = 'refuted' OR (told = 'unclear' AND NOT found)), '') END AS targets,
      coalesce(string_agg(claim_id || ': ' || CASE WHEN NOT found THEN 'sentence_missing' ELSE told END, ',' ORDER BY position) FILTER (NOT found OR told <> 'supported'), '') AS notes FROM y GROUP BY conv_id""")
def revision_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """What a revision has to mend, and the notes that a reader sees."""
    row = F.struct("position", "claim_id", "verdict", "sentence_found")
    r = _verified(spark, sf).groupBy("conv_id").agg(F.array_sort(F.collect_list(row)).alias("claims"), F.bool_or("check_failed").alias("failed"))
    r = r.withColumn("targets", E.revision_targets(F.when(F.col("failed"), "unavailable").otherwise("warning"), F.col("claims"), F.array().cast("array<string>")))
    return r.select("conv_id", (F.size("targets") > 0).alias("revise"), F.array_join("targets", ",").alias("targets"), F.array_join(E.notes(F.col("claims")), ",").alias("notes"))


@plans.add("SELECT l_orderkey, l_linenumber, l_quantity > l_tax * 500 AND l_returnflag <> 'A' AND l_linestatus = 'F' AS adopted FROM lineitem")
def revision_adoptions(spark: SparkSession, sf: str) -> DataFrame:
    adopted = E.adopts(F.col("l_quantity"), F.col("l_tax") * 500, F.col("l_returnflag") != "A", F.col("l_linestatus") == "F")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", adopted.alias("adopted"))


@plans.add("""WITH s AS (SELECT conv_id, turn, role AS name FROM conversations), d AS (SELECT conv_id, role AS name, turn, 'v' || turn AS verdict, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations WHERE turn % 2 = 0)
    SELECT s.conv_id, s.turn, coalesce(d.verdict, 'impact') AS verdict, CASE WHEN d.turn IS NULL THEN 0 ELSE least(2, d.turn % 4)::INT END AS bulls FROM s LEFT JOIN d ON s.conv_id = d.conv_id AND s.name = d.name AND d.n = 1""")
def debated_stocks(spark: SparkSession, sf: str) -> DataFrame:
    """Stocks with the first debate of their name; without one the impact stands."""
    c = table(spark, sf, "conversations")
    none = F.lit(None).cast("string")
    stocks = c.select("conv_id", "turn", F.col("role").alias("name"), none.alias("ticker"), F.lit("impact").alias("impact"))
    some = F.slice(F.array(*[F.lit(x) for x in ("x", "y", "z")]), F.lit(1), (F.col("turn") % 4).cast("int"))
    debate = c.where("turn % 2 = 0").select("conv_id", F.col("role").alias("name"), none.alias("ticker"), F.col("turn").alias("position"), F.concat(F.lit("v"), F.col("turn").cast("string")).alias("verdict"), some.alias("bull"), some.alias("bear"))
    return E.debate_rows(stocks, debate, ["conv_id"]).select("conv_id", "turn", "verdict", F.size("bull").alias("bulls"))


@plans.add("""SELECT event_id, CASE WHEN event_type = 'error' THEN 'unavailable' ELSE 'checked' END AS status, event_type <> 'error' AND event_id % 2 = 0 AS grounded, CASE WHEN event_type IN ('buy', 'view') THEN 'hold' ELSE 'watch' END AS action, CASE event_type WHEN 'error' THEN 'try again' WHEN 'click' THEN 'clicked' ELSE 'failed' END AS message,
    CASE WHEN event_id % 5 = 0 THEN 'unavailable' WHEN event_id % 2 = 1 OR event_id % 3 = 0 THEN 'warning' ELSE 'passed' END AS verdict FROM events""")
def critic_and_actions(spark: SparkSession, sf: str) -> DataFrame:
    """A failed check isn't counted as grounded; unknown actions are watched; codes become messages."""
    kind, even = F.col("event_type"), F.col("event_id") % 2 == 0
    c = C.critic_defaults(even, F.lit(0.5), kind == "error")
    notes = F.when(F.col("event_id") % 3 == 0, F.array(F.lit("note"))).otherwise(F.array().cast("array<string>"))
    return table(spark, sf, "events").select(
        "event_id", c["status"].alias("status"), F.coalesce(c["grounded"], F.lit(False)).alias("grounded"), C.strategy_action(F.when(kind == "view", "hold").otherwise(kind)).alias("action"), C.failure_message(kind, {"error": "try again", "click": "clicked"}).alias("message"),
        E.critic_status(F.when(F.col("event_id") % 5 > 0, even), notes).alias("verdict"),
    )


@plans.add("SELECT event_id, CASE WHEN user_id % 3 > 0 THEN 'lease_lost' WHEN event_type = 'error' THEN 'cancelled' WHEN event_id <= 500 THEN 'timeout' WHEN event_type <> 'view' THEN 'not_running' ELSE 'go' END AS stop FROM events")
def checkpoints(spark: SparkSession, sf: str) -> DataFrame:
    """Why a job may not go on."""
    status = F.when(F.col("event_type") == "error", "cancel_requested").when(F.col("event_type") == "view", "running").otherwise("queued")
    stop = C.checkpoint_guard(status, F.when(F.col("user_id") % 3 == 0, "w"), F.lit("w"), F.col("event_id"), F.lit(500))
    return table(spark, sf, "events").select("event_id", F.coalesce(stop, F.lit("go")).alias("stop"))


@plans.add("SELECT doc_id, coalesce(doc_id % 2 = 0 AND text IS NOT NULL, false) AS same, sha256(text || chr(10) || lang) AS input_hash FROM documents WHERE text IS NOT NULL")
def stored_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a stored body's hash is that of its text, and the key of a cached input."""
    from ..operators import articles as A

    d = table(spark, sf, "documents").where("text IS NOT NULL")
    stored = F.when(F.col("doc_id") % 2 == 0, F.sha2("text", 256)).otherwise("x")
    return d.select("doc_id", E.body_hash_matches(F.col("text"), stored).alias("same"), A.input_hash(F.col("text"), F.col("lang")).alias("input_hash"))


@plans.add("""SELECT o_orderkey, CASE WHEN n = 0 OR n > 10 THEN 'evidence_count' WHEN o_orderkey % 5 = 1 AND n > 1 THEN 'duplicate_ids' WHEN n * 7000 > 60000 THEN 'too_long' WHEN o_orderkey % 3 = 0 THEN 'rag_count' ELSE 'ok' END AS problem,
    CASE WHEN o_orderkey % 2 = 0 THEN 'a' ELSE '' END AS missing FROM (SELECT o_orderkey, o_orderkey % 13 AS n FROM orders)""")
def comparison_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Why an input can't be compared, and which required fields are missing."""
    k = F.col("o_orderkey")
    item = lambda i: F.struct(F.when(k % 5 == 1, "n").otherwise(F.concat(F.lit("n"), i.cast("string"))).alias("news_id"), F.repeat(F.lit("x"), 7000).alias("input_excerpt"))
    evidence = F.transform(F.slice(F.sequence(F.lit(1), F.lit(12)), F.lit(1), (k % 13).cast("int")), item)
    rag = F.array_repeat(F.lit(1), F.when(k % 3 == 0, 4).otherwise(3))
    row = F.struct(F.when(k % 2 == 1, 1).alias("a"), F.lit(1).alias("b"))
    return table(spark, sf, "orders").select(k, F.coalesce(C.input_problem(evidence, rag), F.lit("ok")).alias("problem"), F.array_join(C.missing_fields(row, ("a", "b")), ",").alias("missing"))


@plans.add("""SELECT conv_id, count(*) FILTER (turn % 2 = 0) AS warnings, sum(turn % 3)::BIGINT AS impacts, sum(CASE WHEN turn % 3 = 2 THEN 1 ELSE 0 END)::BIGINT AS up, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END)::BIGINT AS buy, count(*) AS strategies FROM conversations GROUP BY conv_id""")
def run_summaries(spark: SparkSession, sf: str) -> DataFrame:
    """Warnings, stocks by direction and actions of each run."""
    stocks = F.slice(F.array(F.struct(F.lit("down").alias("direction")), F.struct(F.lit("up").alias("direction"))), F.lit(1), (F.col("turn") % 3).cast("int"))
    items = F.array(F.struct(F.when(F.col("role") == "user", "buy").otherwise("hold").alias("action")))
    c = table(spark, sf, "conversations").select("conv_id", F.when(F.col("turn") % 2 == 0, "warning").otherwise("passed").alias("verification_status"), stocks.alias("stock_impacts"), items.alias("strategy_items"))
    return C.run_summary(c, ["conv_id"])


@plans.add("SELECT user_id, event_type AS outcome, count(*) AS n FROM events GROUP BY 1, 2")
def outcome_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return C.reasons(table(spark, sf, "events").withColumnRenamed("event_type", "outcome"), ["user_id"])


@plans.add("""SELECT c.conv_id, a.arm, a.position, a.flags, count(*) AS runs FROM conversations c JOIN (VALUES ('A', 0, ''), ('C', 1, 'claims,debate'), ('B''', 2, 'claims,revise')) AS a(arm, position, flags) ON (c.conv_id + c.turn) % 3 = a.position GROUP BY 1, 2, 3, 4""")
def comparison_arms(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of each conversation by the arm that its turns are dealt to, with what the arm switches on."""
    runs = table(spark, sf, "conversations").select("conv_id", ((F.col("conv_id") + F.col("turn")) % 3).cast("int").alias("position"))
    named = runs.join(C.arms(spark, ("A", "C", "B'")), "position")
    return named.groupBy("conv_id", "arm", "position", F.array_join("flags", ",").alias("flags")).agg(F.count(F.lit(1)).alias("runs"))


@plans.add(r"""WITH p AS (SELECT doc_id, text, left(text, 300) AS head FROM documents WHERE text IS NOT NULL), e AS (SELECT *, length(regexp_extract(head, '(?s)^(.*(?:[.!?。]\s|\n))', 1)) AS till FROM p)
    SELECT doc_id, md5(CASE WHEN length(text) <= 300 THEN text ELSE rtrim(left(head, CASE WHEN till >= 150 THEN till ELSE 300 END), E' \t\n\x0b\x0c\r') END) AS excerpt_md5 FROM e""")
def excerpts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts up to 300 characters; longer ones end with their last sentence within that, if it ends in the second half."""
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", F.md5(U.excerpt(F.col("text"), F.lit(300))).alias("excerpt_md5"))


@plans.add("""WITH k AS (SELECT event_id AS k FROM events) SELECT k AS event_id, CASE WHEN k % 2 = 0 AND k % 3 = 0 THEN 'no_debate' WHEN k % 5 = 0 THEN 'no_judge' ELSE 'judged' END AS debate, CASE WHEN k % 7 = 0 THEN 'old' WHEN k % 11 > 0 THEN 'new' ELSE '-' END AS report,
    CASE WHEN k % 7 = 0 THEN CASE WHEN k % 4 = 0 THEN 'old' WHEN k % 13 > 0 THEN 'new' ELSE '-' END WHEN k % 11 > 0 AND k % 13 > 0 THEN 'new' ELSE '-' END AS strategy,
    CASE WHEN k % 7 > 0 AND k % 11 = 0 THEN 'failed' WHEN k % 13 = 0 AND NOT (k % 7 = 0 AND k % 4 = 0) THEN 'partial' ELSE 'succeeded' END AS status FROM k""")
def job_results(spark: SparkSession, sf: str) -> DataFrame:
    """How a debate ends, and what a job keeps when parts of it are stored or fail."""
    k = F.col("event_id")
    some = lambda test, v: F.when(test, v)
    d = E.debate_outcome(some(k % 2 > 0, "bull"), some(k % 3 > 0, "bear"), some(k % 5 > 0, "judge"), F.lit("impact"))
    r = E.job_result(some(k % 7 == 0, "old"), some(k % 11 > 0, "new"), some(k % 4 == 0, "old"), some(k % 13 > 0, "new"))
    return table(spark, sf, "events").select(k, d["basis"].alias("debate"), F.coalesce(r["report"], F.lit("-")).alias("report"), F.coalesce(r["strategy"], F.lit("-")).alias("strategy"), r["status"].alias("status"))


QUERIES, ORACLE = plans.queries, plans.oracle
