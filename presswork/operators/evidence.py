"""Evidence and constraint checks around reports, claims, revisions and strategies.

Everything is an expression or a window over exploded rows; model texts are input columns and are
parsed with explicit schemas. A failed parse is a status, never a made-up report.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import udfs as U
from . import passages

#: Fixed values. Most claims, stocks, arguments a target, characters of a reason and of a note.
MAX_CLAIMS, MAX_STOCKS, MAX_ARGUMENTS, MAX_REASON, NOTE_TARGET = 12, 6, 2, 80, 120
INPUT_CHARS, EXCERPT_CHARS = 60_000, 12_000
BODY_SECONDS = 3600
QUOTE_BYTES = 8 << 20
CLAIM_ID = "^c([1-9]|1[0-2])$"
REPORT_SCHEMA = (
    "title string, event_summary string, event_analysis string, market_impact string, "
    "stock_impacts array<struct<ticker:string,name:string,impact:string,direction:string,evidence_news_ids:array<string>,claim_ids:array<string>>>, "
    "risk_factors array<string>, "
    "claims array<struct<claim_id:string,text:string,kind:string,evidence:array<struct<news_id:string,sentence:string>>,falsifier:string>>"
)


def subset(part: Column, whole: Column) -> Column:
    return F.size(F.array_except(part, whole)) == 0


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def evidence_budget(rows: DataFrame, by: list[str], body: str = "content", row_id: str = "news_id") -> DataFrame:
    """input_excerpt, input_char_count, truncated: an equal share of the input for each article."""
    share = F.least(F.lit(EXCERPT_CHARS), F.floor(F.lit(INPUT_CHARS) / F.count(F.lit(1)).over(Window.partitionBy(*by))))
    out = rows.withColumn("budget", share.cast("int")).withColumn("input_excerpt", U.excerpt(F.col(body), F.col("budget")))
    return out.withColumns({"input_char_count": F.length("input_excerpt"), "truncated": F.length("input_excerpt") < F.length(F.coalesce(body, F.lit("")))})


def body_hash_matches(content: Column, content_hash: Column) -> Column:
    return F.coalesce(F.sha2(content, 256) == content_hash, F.lit(False))


def report_problems(requested: Column, used: Column, failed: Column, stock_ids: Column, coverage_used: Column, coverage_failed: Column) -> Column:
    """Names of the constraints that a report breaks.

    Used and failed ids are distinct, disjoint and together the requested ones; the stated counts
    agree; stocks rest on used ids only.
    """
    tests = {
        "duplicate_used": F.size(F.array_distinct(used)) != F.size(used),
        "duplicate_failed": F.size(F.array_distinct(failed)) != F.size(failed),
        "overlap": F.size(F.array_intersect(used, failed)) > 0,
        "not_requested": F.array_sort(F.array_union(used, failed)) != F.array_sort(F.array_distinct(requested)),
        "coverage": (coverage_used != F.size(used)) | (coverage_failed != F.size(failed)),
        "unused_stock_evidence": ~subset(stock_ids, used),
    }
    return F.array_compact(F.array(*[F.when(F.coalesce(t, F.lit(True)), k) for k, t in tests.items()]))


def latest_body(bodies: DataFrame, now: Column, key: str = "news_id", at: str = "extracted_at", seconds: int = BODY_SECONDS) -> DataFrame:
    """Newest body of each key, if that is recent enough: the age is looked at after the choice."""
    newest = bodies.groupBy(key).agg(F.max_by(F.struct(*[c for c in bodies.columns if c != key]), F.struct(at, "body_id")).alias("b"))
    return newest.select(key, "b.*").where(F.unix_seconds(now) - F.unix_seconds(F.col(at)) <= seconds)


def append_once(new: DataFrame, stored: DataFrame, row_id: str, generation_key: str) -> DataFrame:
    """new with outcome: 'id_collision', 'reused' (its generation is stored, with that row's id) or 'insert'."""
    ids = stored.select(F.col(row_id).alias("__id"))
    keys = stored.where(F.col(generation_key).isNotNull()).groupBy(generation_key).agg(F.min(row_id).alias("stored_id"))
    joined = new.join(keys, generation_key, "left").join(ids, F.col(row_id) == F.col("__id"), "left")
    return joined.withColumn("outcome", F.when(F.col("stored_id").isNotNull(), "reused").when(F.col("__id").isNotNull(), "id_collision").otherwise("insert")).drop("__id")


def bare_json(raw: Column) -> Column:
    """The text without code fences and without white space around it."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"```(?:json)?", ""), r"^(?U)\s+|(?U)\s+$", "")


def parse_report(raw: Column) -> Column:
    """Report of a model's text: code fences dropped, one JSON object; null else."""
    bare = bare_json(raw)
    return F.when(bare.startswith("{"), F.from_json(bare, REPORT_SCHEMA, {"mode": "PERMISSIVE"}))


def parse_status(raw: Column) -> Column:
    bare = bare_json(raw)
    parsed = F.try_parse_json(bare)
    return F.when(bare == "", "empty_response").when(parsed.isNull(), "invalid_json").when(F.schema_of_variant(parsed).startswith("OBJECT"), "ok").otherwise("json_not_object")


def report_status(report: Column, allowed: Column) -> Column:
    """'ok' or why a parsed report can't be used."""
    missing = blank(report["title"]) | blank(report["event_summary"]) | blank(report["event_analysis"]) | blank(report["market_impact"]) | report["stock_impacts"].isNull() | report["risk_factors"].isNull()
    stocks = report["stock_impacts"]
    bad = F.exists(stocks, lambda s: blank(s["name"]) | blank(s["impact"]) | ~F.coalesce(s["direction"].isin("up", "down", "mixed", "unknown"), F.lit(False)) | ~F.coalesce(F.size(s["evidence_news_ids"]).between(1, 10), F.lit(False)))
    used = F.forall(stocks, lambda s: subset(s["evidence_news_ids"], allowed))
    return F.when(report.isNull() | missing | bad, "invalid_report").when(F.size(stocks) > MAX_STOCKS, "too_many_stocks").when(~used, "unused_evidence").otherwise("ok")


def valid_claims(claims: Column) -> Column:
    """The first claims with a valid id, text, kind and evidence, one per id, at most MAX_CLAIMS looked at."""
    ok = lambda c: (
        F.coalesce(c["claim_id"].rlike(CLAIM_ID), F.lit(False)) & F.coalesce(F.length(c["text"]).between(1, 200), F.lit(False)) & F.coalesce(c["kind"].isin("fact", "interpretation"), F.lit(False))
        & F.coalesce(F.size(c["evidence"]) >= 1, F.lit(False)) & F.coalesce(F.length(c["falsifier"]) <= 120, F.lit(True))
    )
    cut = F.transform(F.slice(F.coalesce(claims, F.array().cast("array<struct<claim_id:string,text:string,kind:string,evidence:array<struct<news_id:string,sentence:string>>,falsifier:string>>")), 1, MAX_CLAIMS), lambda c: c.withField("evidence", F.slice(c["evidence"], 1, 3)))
    some = F.filter(cut, ok)
    return F.filter(some, lambda c, i: ~F.exists(F.slice(some, F.lit(1), i), lambda p: p["claim_id"] == c["claim_id"]))


def check_quotes(claims: DataFrame, evidence: DataFrame, by: list[str]) -> DataFrame:
    """sentence_found per claim: all of its quotes stand in their articles' excerpts.

    claims: by, claim_id, refs (array of news_id, sentence). evidence: by, news_id, input_excerpt.
    """
    refs = claims.select(*by, "claim_id", F.explode("refs").alias("r")).select(*by, "claim_id", F.col("r.news_id").alias("news_id"), F.col("r.sentence").alias("sentence"))
    found = refs.join(evidence.select(*by, "news_id", "input_excerpt"), [*by, "news_id"], "left").withColumn("hit", U.quote_found(F.col("sentence"), F.col("input_excerpt")))
    per = found.groupBy(*by, "claim_id").agg(F.bool_and("hit").alias("sentence_found"))
    return claims.join(per, [*by, "claim_id"], "left").withColumn("sentence_found", F.coalesce("sentence_found", F.lit(False)))


def loose_quotes(quotes: DataFrame, bodies: DataFrame, quote: str, body: str) -> DataFrame:
    """Pairs of bodies and quotes that stand in them, white space aside.

    Quotes of up to QUOTE_BYTES in all (their size is summed first) are one automaton that reads every body once; more of them meet
    the bodies by their rarest anchors, as tables.
    """
    q = quotes.withColumn("__quote", T.collapse(F.col(quote))).where("__quote <> ''")
    b = bodies.withColumn("__body", T.collapse(F.col(body)))
    texts = q.select("__quote").distinct()
    if (texts.agg(F.sum(F.octet_length("__quote"))).first()[0] or 0) > QUOTE_BYTES:
        found = passages.held_passages(b, "__body", texts, "__quote").withColumnRenamed("__quote", "__hit")
    else:
        some = [r[0] for r in texts.toLocalIterator()]
        found = b.withColumn("__hit", F.explode(quotes_in(some)("__body"))) if some else b.withColumn("__hit", F.lit("")).where(F.lit(False))
    return found.join(q, F.col("__hit") == F.col("__quote")).drop("__quote", "__body", "__hit")


def quotes_in(quotes: list[str]) -> Callable[[str], Column]:
    """Function column: the quotes that a text holds."""

    @F.pandas_udf("array<string>")
    def found(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for x in quotes:
            automaton.add_word(x, x)
        automaton.make_automaton()
        for texts in parts:
            yield pd.Series([sorted({x for _, x in automaton.iter(t or "")}) for t in texts])

    return found


def usable_verdicts(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Verdict rows with a known value whose claim was judged once: one judged twice has no answer."""
    valid = verdicts.where(F.col("claim_id").isNotNull() & F.col("verdict").isin("supported", "refuted", "unclear"))
    once = F.count(F.lit(1)).over(Window.partitionBy(*by, "claim_id")) == 1
    return valid.withColumn("__once", once).where("__once").drop("__once")


def clean_reason(c: Column) -> Column:
    return F.nullif(F.substring(T.collapse(c), 1, MAX_REASON), F.lit(""))


def verify_claims(claims: DataFrame, verdicts: DataFrame, by: list[str]) -> DataFrame:
    """claims (by, claim_id, sentence_found, position) with verdict and reason.

    Verdicts count for quoted claims only, of which the first MAX_CLAIMS were sent. If none came
    back, the check failed.
    """
    order = Window.partitionBy(*by, "sentence_found").orderBy("position")
    sent = claims.withColumn("sent", F.col("sentence_found") & (F.row_number().over(order) <= MAX_CLAIMS))
    told = usable_verdicts(verdicts, by).select(*by, "claim_id", F.col("verdict").alias("__verdict"), F.col("reason").alias("__reason"))
    joined = sent.join(told, [*by, "claim_id"], "left").withColumn("__verdict", F.when(F.col("sent"), F.col("__verdict")))
    w = Window.partitionBy(*by)
    failed = (F.max(F.col("sent").cast("int")).over(w) == 1) & (F.count("__verdict").over(w) == 0)
    reason = F.when(~F.col("sentence_found"), "sentence_missing").when(F.col("__verdict").isNotNull(), clean_reason(F.col("__reason"))).when(failed, "critic_failed").otherwise("verdict_omitted")
    return joined.withColumns({"verdict": F.coalesce("__verdict", F.lit("unclear")), "reason": reason, "check_failed": failed}).drop("__verdict", "__reason", "sent")


def claim_summary(checked: DataFrame, by: list[str]) -> DataFrame:
    """Counts of verdicts and missing quotes, problems, and the status of each report."""
    n = lambda t: F.count_if(t)
    problem = (F.col("verdict") == "refuted") | ((F.col("verdict") == "unclear") & ~F.col("sentence_found"))
    out = checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), *[n(F.col("verdict") == v).alias(v) for v in ("supported", "refuted", "unclear")],
        n(~F.col("sentence_found")).alias("sentence_missing"), n(problem).alias("problems"), F.bool_or(F.col("check_failed")).alias("__failed"),
    )
    return out.withColumn("status", F.when(F.col("__failed"), "unavailable").when(F.col("supported") == F.col("total"), "passed").otherwise("warning")).drop("__failed")


def is_problem(verdict: Column, sentence_found: Column) -> Column:
    return (verdict == "refuted") | ((verdict == "unclear") & ~F.coalesce(sentence_found, F.lit(True)))


def notes(claims: Column) -> Column:
    """A fixed note per claim (array of claim_id, verdict, sentence_found): a missing quote comes first."""
    note = lambda c: F.when(~c["sentence_found"], F.concat(c["claim_id"], F.lit(": sentence_missing"))).when(c["verdict"].isin("refuted", "unclear"), F.concat(c["claim_id"], F.lit(": "), c["verdict"]))
    return F.array_compact(F.transform(claims, note))


def revision_targets(status: Column, claims: Column, note_list: Column) -> Column:
    """What a revision has to mend: problem claims, or notes where there are no claims; none if unchecked."""
    some = F.transform(F.filter(claims, lambda c: is_problem(c["verdict"], c["sentence_found"])), lambda c: c["claim_id"])
    return F.when(status == "unavailable", F.array().cast("array<string>")).when(F.size(claims) > 0, some).otherwise(F.transform(note_list, lambda n: F.substring(n, 1, NOTE_TARGET)))


def claim_changes(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """claim_id, target, action (removed, rewritten, kept) and intact of each claim of before.

    before: by, claim_id, content, verdict, target. after: by, claim_id, content, verdict.
    """
    now = after.select(*by, "claim_id", F.col("content").alias("__content"), F.col("verdict").alias("__verdict"))
    joined = before.join(now, [*by, "claim_id"], "left")
    action = F.when(F.col("__content").isNull(), "removed").when(F.col("__content") != F.col("content"), "rewritten").otherwise("kept")
    intact = F.col("target") | ((action == "kept") & ((F.col("verdict") != "supported") | F.col("__verdict").eqNullSafe(F.lit("supported"))))
    return joined.withColumns({"action": action, "intact": intact}).drop("__content", "__verdict")


def adopts(targets: Column, after: Column, intact: Column, changed: Column) -> Column:
    """Whether a round is taken: fewer problems than targets, all else intact, something changed."""
    return F.coalesce((after < targets) & intact & changed, F.lit(False))


def revision_rounds(rounds: DataFrame, by: list[str], most: int = 2) -> DataFrame:
    """adopted per round: rounds end at the first that isn't taken."""
    w = Window.partitionBy(*by).orderBy("round").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rounds.where(F.col("round") <= most).withColumn("adopted", F.bool_and("taken").over(w))


def first_arguments(arguments: DataFrame, by: list[str]) -> DataFrame:
    """First two arguments of each target (name and ticker, null ticker equal to null); too_many_targets per side."""
    w = Window.partitionBy(*by, "name", "ticker").orderBy("position")
    few = arguments.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= MAX_ARGUMENTS).drop("__n")
    target = F.struct("name", "ticker")
    many = few.groupBy(*by).agg((F.count_distinct(target) > MAX_STOCKS).alias("too_many_targets"))
    return few.join(many, by)


def debate_rows(stocks: DataFrame, debate: DataFrame, by: list[str]) -> DataFrame:
    """Each stock with the first debate row of its name and ticker; a verdict falls back to the impact."""
    w = Window.partitionBy(*by, "name", "ticker").orderBy("position")
    first = debate.withColumn("__n", F.row_number().over(w)).where("__n = 1")
    d = first.select(*[F.col(c).alias(f"__{c}") for c in (*by, "name", "ticker", "verdict", "bull", "bear")])
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*by, "name", "ticker")]
    cut = lambda c: F.transform(F.slice(F.coalesce(c, F.array().cast("array<string>")), 1, MAX_ARGUMENTS), lambda x: F.substring(x, 1, 100))
    joined = stocks.join(d, on, "left")
    return joined.select(*stocks.columns, cut(F.col("__bull")).alias("bull"), cut(F.col("__bear")).alias("bear"), F.substring(F.coalesce("__verdict", "impact"), 1, 200).alias("verdict"))


def debate_outcome(bull: Column, bear: Column, judge: Column, fallback: Column) -> Column:
    """struct<text, basis>: the judge's word where a side was heard and it gave one, else the fallback."""
    heard = bull.isNotNull() | bear.isNotNull()
    judged = heard & judge.isNotNull()
    return F.struct(F.when(judged, judge).otherwise(fallback).alias("text"), F.when(judged, "judged").when(heard, "no_judge").otherwise("no_debate").alias("basis"))


def job_result(stored_report: Column, report: Column, stored_strategy: Column, strategy: Column) -> Column:
    """struct<report, strategy, status> of a job: what is stored is used again, and a report stays where the strategy fails.

    A strategy that is stored belongs to the stored report: it isn't used with a new one.
    """
    kept = F.coalesce(stored_report, report)
    plan = F.when(stored_report.isNotNull(), F.coalesce(stored_strategy, strategy)).otherwise(strategy)
    status = F.when(kept.isNull(), "failed").when(plan.isNull(), "partial").otherwise("succeeded")
    return F.struct(kept.alias("report"), F.when(kept.isNotNull(), plan).alias("strategy"), status.alias("status"))


def resolve_targets(items: DataFrame, stocks: DataFrame, by: list[str]) -> DataFrame:
    """Strategy items with their stock's name and ticker by target_index, and the draft's status."""
    joined = items.join(stocks.select(*by, F.col("position").alias("target_index"), F.col("name").alias("stock_name"), "ticker"), [*by, "target_index"], "left")
    w = Window.partitionBy(*by)
    unknown = F.max(F.col("stock_name").isNull().cast("int")).over(w) == 1
    twice = F.size(F.collect_set("target_index").over(w)) < F.count(F.lit(1)).over(w)
    return joined.withColumn("status", F.when(unknown, "unknown_target").when(twice, "duplicate_target").otherwise("ok"))


def critic_status(grounded: Column, note_list: Column) -> Column:
    return F.when(grounded.isNull(), "unavailable").when(~grounded | (F.size(note_list) > 0), "warning").otherwise("passed")


def report_key(requested: Column, snapshots: Column, failed: Column, rag: Column, config: Column) -> Column:
    """Digest of what a report is made from; equal inputs in any order give equal keys."""
    parts = F.struct(F.array_sort(requested).alias("requested"), F.array_sort(snapshots).alias("used"), F.array_sort(failed).alias("failed"), rag.alias("rag"), config.alias("config"))
    return F.sha2(F.to_json(parts), 256)


def usage_total(rows: DataFrame, by: list[str], tokens: str = "tokens") -> DataFrame:
    """Sum of tokens if every row has a count of 0 or more, else null: what isn't measured isn't 0."""
    known = F.count_if(F.col(tokens).isNull() | (F.col(tokens) < 0)) == 0
    return rows.groupBy(*by).agg(F.when(known, F.sum(tokens)).alias("total_tokens"), F.count(F.lit(1)).alias("calls"))


def trace(events: DataFrame, by: list[str], at: str, most: int = 128) -> DataFrame:
    """seq of each event in order of completion, the first most ones."""
    return events.withColumn("seq", F.row_number().over(Window.partitionBy(*by).orderBy(at))).where(F.col("seq") <= most)
