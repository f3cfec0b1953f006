"""Recorded recommendations against later prices: entry, horizons, directions, summary.

Prices are only looked at up to the as-of date, filtered before any join. Days are numbered once
on the benchmark's calendar, so entry and horizons are equi-joins on a day number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed values. Horizons in trading days, least trackable items, first day of the rule, schema.
HORIZONS = (1, 5, 10)
MIN_TRACKABLE = 10
CREATED_FROM = "2026-10-19"
SCHEMA_VERSION = "v2"


def kst_date(ts: Column) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, "Asia/Seoul"))


def kst_day(ts: Column) -> Column:
    """Number of the day in Korea, which is 9 hours ahead."""
    return F.floor((F.unix_seconds(ts) + 32400) / 86400)


def default_as_of(now: Column) -> Column:
    """Today in Korea once the market has settled at 16:00, else the day before."""
    return F.to_date(F.from_utc_timestamp(now, "Asia/Seoul") - F.expr("interval 16 hours"))


def settled(prices: DataFrame, as_of: Column, day: str = "day", close: str = "close") -> DataFrame:
    """Finite, positive closes up to as_of."""
    usable = F.col(close).isNotNull() & ~F.isnan(close) & (F.col(close) > 0) & (F.col(close) < float("inf"))
    return prices.where(usable & (F.col(day) <= as_of))


def created_at(raw: Column) -> Column:
    """Timestamp of an ISO text or an extended JSON date (text, number, numberLong); no zone is UTC."""
    inner = F.coalesce(F.get_json_object(raw, "$['$date']['$numberLong']"), F.get_json_object(raw, "$['$date']"), raw)
    number = F.when(inner.rlike("^-?[0-9]+$"), inner.try_cast("long"))
    return F.coalesce(F.timestamp_millis(number), inner.try_cast("timestamp"))


def select_records(records: DataFrame) -> DataFrame:
    """records (position, strategy_id, schema_version, created, valid) with why each is skipped, or null."""
    first = F.row_number().over(Window.partitionBy("strategy_id", "__open").orderBy("position")) > 1
    reason = F.when(~F.coalesce(F.col("valid"), F.lit(False)), "invalid_record").when(
        ~F.col("schema_version").eqNullSafe(F.lit(SCHEMA_VERSION)), "not_schema_v2"
    ).when(F.col("created").isNull(), "invalid_created_at").when(kst_date(F.col("created")) < F.lit(CREATED_FROM).cast("date"), "before_rule_start")
    out = records.withColumn("skipped", reason).withColumn("__open", F.col("skipped").isNull())
    again = F.col("__open") & F.col("strategy_id").isNotNull() & first
    return out.withColumn("skipped", F.when(again, "duplicate_strategy_id").otherwise(F.col("skipped"))).drop("__open")


def classify(items: DataFrame, master: DataFrame) -> DataFrame:
    """items (ticker_raw, stock_name) with ticker, listing, name_check and exclusion_reason."""
    listed = items.withColumn("ticker", T.ticker(F.col("ticker_raw")))
    known = master.select(F.col("code").alias("ticker"), F.col("name").alias("master_name"), "market")
    joined = listed.join(known, "ticker", "left")
    blank = F.trim(F.coalesce("ticker_raw", F.lit(""))) == ""
    reason = F.when(blank, "ticker_missing").when(F.col("ticker").isNull(), "ticker_not_krx_format").when(F.col("master_name").isNull(), "not_in_master")
    same = T.name_key(F.col("stock_name")) == T.name_key(F.col("master_name"))
    return joined.withColumn("exclusion_reason", reason).withColumn("name_check", F.when(F.col("exclusion_reason").isNull(), F.when(same, "match").otherwise("mismatch")))


def calendar(benchmark: DataFrame) -> DataFrame:
    """day, index_close, idx: trading days numbered from 0."""
    w = Window.orderBy("day")
    return benchmark.select("day", F.col("close").alias("index_close"), (F.row_number().over(w) - 1).alias("idx"))


def percent(start: Column, end: Column) -> Column:
    return F.round((end / start - 1) * 100, 4)


def ratio(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole), 4)


def direction(action: Column, value: Column) -> Column:
    moved = F.when(value == 0, "flat").when((value > 0) == (action == "buy"), "match").otherwise("mismatch")
    return F.when(action.isin("buy", "sell") & value.isNotNull(), moved)


def entry_days(items: DataFrame, days: DataFrame, t0: str = "t0") -> DataFrame:
    """items with entry_idx: number of the first trading day strictly after t0, null if there is none.

    Every date from one trading day up to the day before the next has that next day as its entry, so
    the calendar is spread over its dates once and items find theirs by an equi-join; dates before
    the calendar have its first day.
    """
    before = F.lag("day", 1).over(Window.orderBy("day"))
    gaps = days.select(F.col("idx").alias("entry_idx"), before.alias("__from"), "day").where("__from IS NOT NULL")
    dates = gaps.select("entry_idx", F.explode(F.sequence("__from", F.date_sub("day", 1))).alias("__date"))
    first = days.agg(F.min("day").alias("__first"))
    joined = items.join(dates, F.col(t0) == F.col("__date"), "left").join(F.broadcast(first))
    return joined.withColumn("entry_idx", F.when(F.col(t0) < F.col("__first"), 0).otherwise(F.col("entry_idx"))).drop("__date", "__first")


def horizons(items: DataFrame, prices: DataFrame, benchmark: DataFrame, as_of: Column, key: str = "ticker", by: tuple[int, ...] = HORIZONS) -> DataFrame:
    """A row per item and horizon: status, dates, closes, returns, excess, direction.

    items: item_id, key, action, t0. Returns and excess are rounded one after the other.
    """
    days = calendar(settled(benchmark, as_of))
    closes = settled(prices, as_of).select(F.col(key).alias("__key"), F.col("day").alias("__day"), F.col("close").alias("__close"))
    at = entry_days(items, days).join(days.select(F.col("idx").alias("entry_idx"), F.col("day").alias("entry_date"), F.col("index_close").alias("entry_index")), "entry_idx", "left")
    entry = closes.select("__key", F.col("__day").alias("entry_date"), F.col("__close").alias("entry_close"))
    at = at.join(entry, (F.col(key) == F.col("__key")) & (at["entry_date"] == entry["entry_date"]), "left").drop("__key").drop(entry["entry_date"])
    each = at.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in by]))).withColumn("__target", F.col("entry_idx") + F.col("horizon"))
    due = days.select(F.col("idx").alias("__target"), F.col("day").alias("due_date"), F.col("index_close").alias("due_index"))
    each = each.join(due, "__target", "left")
    end = closes.select("__key", F.col("__day").alias("__due"), F.col("__close").alias("close"))
    each = each.join(end, (F.col(key) == F.col("__key")) & (F.col("due_date") == F.col("__due")), "left")
    status = F.when(F.col("entry_idx").isNull(), "not_due").when(F.col("entry_close").isNull(), "price_missing").when(F.col("due_date").isNull(), "not_due").when(
        F.col("close").isNull(), "price_missing"
    ).otherwise("ok")
    ok = status == "ok"
    out = each.withColumn("status", status).withColumn("return_pct", F.when(ok, percent(F.col("entry_close"), F.col("close")))).withColumn(
        "index_return_pct", F.when(ok, percent(F.col("entry_index"), F.col("due_index")))
    )
    return out.select(
        "item_id", key, "action", "t0", "entry_date", "entry_close", "horizon", "status", F.when(ok, F.col("due_date")).alias("due_date"), F.when(ok, F.col("close")).alias("close"),
        "return_pct", "index_return_pct", F.round(F.col("return_pct") - F.col("index_return_pct"), 4).alias("excess_pct"), direction(F.col("action"), F.col("return_pct")).alias("direction"),
    )


def horizon_summary(rows: DataFrame) -> DataFrame:
    """Counts of states and directions per horizon."""
    count = lambda c, v: F.count_if(F.col(c) == v)
    return rows.groupBy("horizon").agg(
        *[count("status", s).alias(s) for s in ("ok", "not_due", "price_missing")],
        *[count("direction", d).alias(f"direction_{d}") for d in ("match", "mismatch", "flat")],
        F.count("direction").alias("buy_sell_counted"),
    )


def coverage(items: DataFrame) -> DataFrame:
    """One row: how many items can be tracked, and whether that is enough to read prices at all."""
    trackable = F.count_if(F.col("exclusion_reason").isNull())
    filled = F.count_if(~F.col("exclusion_reason").eqNullSafe("ticker_missing"))
    total = F.count(F.lit(1))
    return items.agg(
        total.alias("items_total"), filled.alias("ticker_filled"), ratio(filled, total).alias("ticker_fill_ratio"), trackable.alias("trackable"), ratio(trackable, total).alias("trackable_ratio"),
        F.count_if(F.col("name_check") == "mismatch").alias("name_mismatch"), F.when(trackable < MIN_TRACKABLE, "hold").otherwise("proceed").alias("verdict"),
    )


def first_source(prices: DataFrame, priority: str = "priority", key: str = "ticker") -> DataFrame:
    """Rows of each key's best source that has any; sources are never mixed."""
    best = F.min(priority).over(Window.partitionBy(key))
    return prices.withColumn("__best", best).where(F.col(priority) == F.col("__best")).drop("__best")
