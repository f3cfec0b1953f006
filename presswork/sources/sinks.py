"""Sinks: upserts as rewritten tables, append-once, exports in fixed column order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .tables import stored


def upsert(stored: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ("created_at", "collected_at"), order: str | None = None) -> DataFrame:
    """stored with new's rows in place of those of the same key; keep columns stay as first stored.

    new may hold a key several times: the row that is last in order counts (its first columns break
    ties). A column that new has as null becomes null, so stale values don't survive.
    """
    columns = stored.columns
    last = new.groupBy(key).agg(F.max_by(F.struct(*[c for c in columns if c != key]), F.col(order) if order else F.lit(0)).alias("n")).select(key, F.lit(True).alias("__new"), "n")
    both = stored.withColumn("__old", F.lit(True)).join(last, key, "full_outer")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"n.{c}")) if c in keep else F.when(F.col("__new"), F.col(f"n.{c}")).otherwise(F.col(c))
    return both.select(*[F.col(key) if c == key else pick(c).alias(c) for c in columns])


def update_existing(stored: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """stored with column from new where the key is in both; no row is added."""
    given = new.groupBy(key).agg(F.first(column, ignorenulls=True).alias("__v"))
    return stored.join(given, key, "left").withColumn(column, F.coalesce("__v", column)).drop("__v").select(*stored.columns)


def carry_forward(new: DataFrame, stored: DataFrame, key: str = "url", body: tuple[str, ...] = ("content", "keywords", "categories"), vectors: tuple[str, ...] = ("vector",)) -> DataFrame:
    """new with the stored body columns where title and body url are unchanged, and with its vectors always."""
    old = stored.select(F.col(key).alias("__key"), *[F.col(c).alias(f"__{c}") for c in ("title", "body_url", *body, *vectors)])
    same = F.col("title").eqNullSafe(F.col("__title")) & F.col("__body_url").eqNullSafe(F.col(key))
    joined = new.join(old, F.col(key) == F.col("__key"), "left")
    fill = {c: F.when(same, F.coalesce(c, f"__{c}")).otherwise(F.col(c)) for c in body} | {c: F.coalesce(c, f"__{c}") for c in vectors}
    return joined.withColumns(fill).select(*new.columns)


def write_csv(df: DataFrame, path: str, columns: list[str], guard: bool = True) -> None:
    """One CSV folder in fixed column order; texts that a spreadsheet would run get a leading quote."""
    kinds = dict(df.dtypes)
    shown = [T.guard_formula(F.col(c)).alias(c) if guard and kinds[c] == "string" else F.col(c) for c in columns]
    df.select(*shown).write.mode("overwrite").option("header", True).csv(path)


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with the places of its rows in order, from 1: counted within ranges of the order, each with what the ranges before it hold."""
    rows = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    sizes = rows.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))  # a row for each range
    place = (F.col("__at") - F.shiftleft("__part", 33) + F.col("__before") + 1).alias(name)
    return rows.withColumn("__part", part).join(before, "__part").select(*df.columns, place)


def blinded(df: DataFrame, row_id: str, arm: str, seed: int) -> tuple[DataFrame, DataFrame]:
    """Rows under sample names in an order that the seed gives, and the key to their arms."""
    mixed = numbered(df.withColumn("__h", F.xxhash64(F.lit(seed), F.col(row_id), F.col(arm))), ["__h", row_id, arm], "__n")
    named = mixed.withColumn("sample", F.format_string("sample-%03d", "__n")).drop("__h", "__n")
    return named.drop(arm), named.select("sample", row_id, arm)


# Fixed values. Columns of a comparison's table and of its sheet for scores.
COMPARED = (
    "arm", "repeat", "outcome", "input_digest", "execution_mode", "elapsed_ms", "logical_generate_calls", "tokens_in", "tokens_out", "est_cost_usd", "verification_status", "warning_count", "up_count", "impact_count", "buy_count", "strategy_count", "error_code",
)
SCORED = ("assessment_id", "content", "grounding_0_1_2", "important_information_0_1_2", "comments")


def write_comparison(runs: DataFrame, folder: str, seed: int, input_digest: str, execution_mode: str = "fixture") -> None:
    """A comparison's four outputs: comparison.json (all runs), comparison.csv (a row of figures for each), blind_scores.csv
    (completed runs without their arms, mixed by the seed, with columns to be filled in) and answer_key.json (their arms).

    runs: arm, repeat, outcome, elapsed_ms, logical_generate_calls, tokens_in, tokens_out, est_cost_usd, verification_status, notes, stock_impacts (array of structs with
    direction), strategy_items (with action), error_code, content. arm and repeat name a run. Figures of a run without a result are empty.
    """
    known = F.col("outcome") == "completed"
    size = lambda c: F.when(known, F.coalesce(F.size(c), F.lit(0)))
    of = lambda c, test: F.when(known, F.coalesce(F.size(F.filter(c, test)), F.lit(0)))
    rows = runs.withColumns({
        "input_digest": F.lit(input_digest), "execution_mode": F.lit(execution_mode), "warning_count": size("notes"), "up_count": of("stock_impacts", lambda i: i["direction"] == "up"), "impact_count": size("stock_impacts"),
        "buy_count": of("strategy_items", lambda i: i["action"] == "buy"), "strategy_count": size("strategy_items"),
    })
    runs.withColumns({"input_digest": F.lit(input_digest), "execution_mode": F.lit(execution_mode)}).write.json(f"{folder}/comparison.json")
    write_csv(rows, f"{folder}/comparison.csv", list(COMPARED))
    run = F.concat_ws("/", "arm", F.col("repeat").cast("string"))
    sheet, key = blinded(runs.where(known).select(run.alias("run"), "arm", "repeat", "content"), "run", "arm", seed)
    empty = {c: F.lit("") for c in SCORED[2:]}
    write_csv(sheet.withColumnRenamed("sample", "assessment_id").withColumns(empty), f"{folder}/blind_scores.csv", list(SCORED))
    told = key.select(F.lit(input_digest).alias("input_digest"), F.lit(seed).alias("seed"), F.col("sample").alias("assessment_id"), "arm", F.substring_index("run", "/", -1).cast("long").alias("repeat"))
    told.write.json(f"{folder}/answer_key.json")


#: Fixed values. Fields of a telemetry event that are written.
TELEMETRY = ("event_id", "kind", "provider", "operation", "outcome", "stage", "status", "duration_ms", "input_tokens", "output_tokens")


def telemetry(df: DataFrame) -> DataFrame:
    """JSON lines of the allowed fields that df has."""
    return df.select(F.to_json(F.struct(*[c for c in TELEMETRY if c in df.columns])).alias("line"))
