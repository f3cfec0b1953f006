"""Comparing pipeline variants: input checks, arms, call limits, summaries, measured stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values. Bounds of an input; arms and what each switches on.
MAX_EVIDENCE, MAX_RAG, MAX_CHARS = 10, 3, 60_000
ARMS = {"A": (), "B": ("claims",), "C": ("claims", "debate"), "B'": ("claims", "revise"), "C'": ("claims", "debate", "revise")}


def arms(spark, names: tuple[str, ...]) -> DataFrame:
    """arm, position, flags; names must be known and different."""
    if not names or len(set(names)) != len(names) or any(n not in ARMS for n in names):
        raise ValueError("arms must be known and different")
    return spark.createDataFrame([(n, i, list(ARMS[n])) for i, n in enumerate(names)], "arm string, position int, flags array<string>")


def input_problem(evidence: Column, rag: Column) -> Column:
    """Why an input (arrays of news_id, input_excerpt) can't be compared; null if it can."""
    ids = F.transform(evidence, lambda e: e["news_id"])
    chars = F.aggregate(evidence, F.lit(0), lambda s, e: s + F.length(F.coalesce(e["input_excerpt"], F.lit(""))))
    return (
        F.when(~F.coalesce(F.size(evidence).between(1, MAX_EVIDENCE), F.lit(False)), "evidence_count").when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate_ids")
        .when(chars > MAX_CHARS, "too_long").when(F.coalesce(F.size(rag), F.lit(0)) > MAX_RAG, "rag_count")
    )


def within_limit(calls: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """calls with reserved: whether the call is among the first most of its run."""
    return calls.withColumn("reserved", F.row_number().over(Window.partitionBy(*by).orderBy(order)) <= most)


def run_summary(reports: DataFrame, by: list[str]) -> DataFrame:
    """Warnings, stocks by direction, and strategy actions of each run."""
    n = lambda c, test: F.sum(F.size(F.filter(F.coalesce(c, F.array()), test)))
    return reports.groupBy(*by).agg(
        F.count_if(F.col("verification_status") == "warning").alias("warnings"), F.sum(F.size("stock_impacts")).alias("impacts"), n(F.col("stock_impacts"), lambda s: s["direction"] == "up").alias("up"),
        n(F.col("strategy_items"), lambda s: s["action"] == "buy").alias("buy"), F.sum(F.size("strategy_items")).alias("strategies"),
    )


def blind_text(df: DataFrame, fields: tuple[str, ...] = ("title", "event_summary", "event_analysis", "market_impact", "risk_factors")) -> Column:
    """JSON of the fields that all arms share."""
    return F.to_json(F.struct(*[c for c in fields if c in df.columns]))


def missing_fields(row: Column, fields: tuple[str, ...]) -> Column:
    """Required fields that are null in a struct."""
    return F.array_compact(F.array(*[F.when(row[f].isNull(), f) for f in fields]))


def stage_changes(polls: DataFrame, by: list[str], at: str = "at", stage: str = "stage") -> DataFrame:
    """First poll of each stage in a row, with the seconds that the stage before took."""
    w = Window.partitionBy(*by).orderBy(at)
    changed = polls.withColumn("__before", F.lag(stage).over(w)).where(~F.col(stage).eqNullSafe(F.col("__before")))
    return changed.withColumn("seconds", F.col(at) - F.lag(at).over(w)).drop("__before")


def progress(events: DataFrame, by: list[str]) -> DataFrame:
    """processed = succeeded + failed for good, of the bodies asked for."""
    done = events.groupBy(*by).agg(F.count_distinct(F.when(F.col("fate") == "done", F.col("item"))).alias("succeeded"), F.count_distinct(F.when(F.col("fate").isin("failed", "expired"), F.col("item"))).alias("failed"), F.count_distinct("item").alias("requested"))
    return done.withColumn("processed", F.col("succeeded") + F.col("failed"))


def reasons(rows: DataFrame, by: list[str], reason: str = "outcome") -> DataFrame:
    """Counts per reason: a selection's diagnostics."""
    return rows.groupBy(*by, reason).agg(F.count(F.lit(1)).alias("n"))


def critic_defaults(grounded: Column, confidence: Column, failed: Column) -> Column:
    """struct<grounded, confidence, status>; a failed check says so and isn't counted as grounded."""
    return F.struct(F.when(~failed, grounded).alias("grounded"), F.when(~failed, confidence).alias("confidence"), F.when(failed, "unavailable").otherwise("checked").alias("status"))


def strategy_action(action: Column) -> Column:
    return F.when(action.isin("buy", "hold", "sell", "watch"), action).otherwise("watch")


def failure_message(code: Column, messages: dict[str, str], default: str = "failed") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, v in messages.items() for x in (k, v)]), code), F.lit(default))


def authorised(results: DataFrame, grants: DataFrame, links: DataFrame) -> DataFrame:
    """Results that a session owns by grant, or reaches through a map or job of its own."""
    allowed = grants.select("sid", "result_id").unionByName(links.select("sid", "result_id")).distinct()
    return results.join(allowed, ["sid", "result_id"], "left_semi")


def lookup_code(indexed: Column, live: Column) -> Column:
    """200 for a live resource, 410 for one that was, 404 else."""
    return F.when(live, 200).when(indexed, 410).otherwise(404)


def checkpoint_guard(status: Column, lease_owner: Column, worker: Column, deadline: Column, now: Column) -> Column:
    """Why a job may not go on; null if it may."""
    return F.when(~lease_owner.eqNullSafe(worker), "lease_lost").when(status == "cancel_requested", "cancelled").when(deadline <= now, "timeout").when(~status.isin("running"), "not_running")
