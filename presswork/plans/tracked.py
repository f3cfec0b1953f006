"""Orders as recommendations, line items as prices: tracking over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tracking as K
from ..sources.tables import table
from .registered import Plans

plans = Plans()
AS_OF = "2000-06-30"


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """items, prices (highest of a supplier's day) and benchmark (highest of the day)."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("unit"))
    prices = li.groupBy(F.col("l_suppkey").alias("ticker"), "day").agg(F.max("unit").alias("close"))
    benchmark = li.groupBy("day").agg(F.max("unit").alias("close"))
    first = li.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("ticker"))
    action = F.when(F.col("o_orderpriority").startswith("1"), "buy").when(F.col("o_orderpriority").startswith("5"), "sell").otherwise("hold")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("item_id"), action.alias("action"), F.to_date("o_orderdate").alias("t0"))
    return orders.join(first, F.col("item_id") == F.col("l_orderkey")).drop("l_orderkey"), prices, benchmark


SQL = f"""WITH li AS (SELECT l_orderkey, l_suppkey, l_shipdate::DATE AS day, l_extendedprice AS unit FROM lineitem),
  p AS (SELECT l_suppkey AS ticker, day, max(unit) AS close FROM li WHERE day <= DATE '{AS_OF}' GROUP BY 1, 2),
  b AS (SELECT day, max(unit) AS close, row_number() OVER (ORDER BY day) - 1 AS idx FROM li WHERE day <= DATE '{AS_OF}' GROUP BY day),
  i AS (SELECT o_orderkey AS item_id, CASE WHEN starts_with(o_orderpriority, '1') THEN 'buy' WHEN starts_with(o_orderpriority, '5') THEN 'sell' ELSE 'hold' END AS action, o_orderdate::DATE AS t0, f.ticker
        FROM orders JOIN (SELECT l_orderkey, min(l_suppkey) AS ticker FROM li GROUP BY 1) f ON o_orderkey = f.l_orderkey),
  e AS (SELECT i.*, b.idx AS entry_idx, b.day AS entry_date, b.close AS entry_index FROM i ASOF LEFT JOIN b ON i.t0 < b.day),
  h AS (SELECT e.*, p.close AS entry_close, unnest([1, 5, 10]) AS horizon FROM e LEFT JOIN p ON e.ticker = p.ticker AND e.entry_date = p.day),
  d AS (SELECT h.*, b.day AS due, b.close AS due_index, p.close AS due_close FROM h LEFT JOIN b ON b.idx = h.entry_idx + h.horizon LEFT JOIN p ON p.ticker = h.ticker AND p.day = b.day),
  s AS (SELECT *, CASE WHEN entry_idx IS NULL THEN 'not_due' WHEN entry_close IS NULL THEN 'price_missing' WHEN due IS NULL THEN 'not_due' WHEN due_close IS NULL THEN 'price_missing' ELSE 'ok' END AS status FROM d),
  r AS (SELECT *, CASE WHEN status = 'ok' THEN round((due_close / entry_close - 1) * 100, 4) END AS ret, CASE WHEN status = 'ok' THEN round((due_index / entry_index - 1) * 100, 4) END AS ind FROM s),
  o AS (SELECT item_id, ticker, action, t0, entry_date, entry_close, horizon, status, CASE WHEN status = 'ok' THEN due END AS due_date, CASE WHEN status = 'ok' THEN due_close END AS close, ret AS return_pct, ind AS index_return_pct, round(ret - ind, 4) AS excess_pct,
    CASE WHEN action IN ('buy', 'sell') AND ret IS NOT NULL THEN CASE WHEN ret = 0 THEN 'flat' WHEN (ret > 0) = (action = 'buy') THEN 'match' ELSE 'mismatch' END END AS direction FROM r)"""


@plans.add(SQL + " SELECT item_id, ticker, action, t0::VARCHAR AS t0, horizon, status, due_date::VARCHAR AS due_date, direction, excess_pct FROM o")
def post_track_horizons(spark: SparkSession, sf: str) -> DataFrame:
    items, prices, benchmark = _inputs(spark, sf)
    h = K.horizons(items, prices, benchmark, F.lit(AS_OF).cast("date"))
    return h.select("item_id", "ticker", "action", F.col("t0").cast("string").alias("t0"), "horizon", "status", F.col("due_date").cast("string").alias("due_date"), "direction", "excess_pct")


@plans.add(SQL + """ SELECT horizon, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'not_due') AS not_due, count(*) FILTER (status = 'price_missing') AS price_missing,
    count(*) FILTER (direction = 'match') AS direction_match, count(*) FILTER (direction = 'mismatch') AS direction_mismatch, count(*) FILTER (direction = 'flat') AS direction_flat, count(direction) AS buy_sell_counted FROM o GROUP BY horizon""")
def post_track_summary(spark: SparkSession, sf: str) -> DataFrame:
    items, prices, benchmark = _inputs(spark, sf)
    return K.horizon_summary(K.horizons(items, prices, benchmark, F.lit(AS_OF).cast("date")))


@plans.add("""WITH i AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'A' || lpad(p_partkey::VARCHAR, 6, '0') WHEN 2 THEN lpad(p_partkey::VARCHAR, 6, '0') ELSE p_brand END AS raw, p_name FROM part),
    t AS (SELECT *, CASE WHEN regexp_matches(regexp_replace(upper(raw), '^A([0-9]{6})$', '\\1'), '^[0-9][0-9A-Z]{5}$') THEN regexp_replace(upper(raw), '^A([0-9]{6})$', '\\1') END AS ticker FROM i),
    m AS (SELECT lpad(s_suppkey::VARCHAR, 6, '0') AS code, 'small ring' AS name FROM supplier),
    c AS (SELECT t.*, m.name, CASE WHEN coalesce(trim(raw), '') = '' THEN 'ticker_missing' WHEN ticker IS NULL THEN 'ticker_not_krx_format' WHEN m.name IS NULL THEN 'not_in_master' END AS reason FROM t LEFT JOIN m ON t.ticker = m.code)
    SELECT count(*) AS items_total, count(*) FILTER (reason IS DISTINCT FROM 'ticker_missing') AS ticker_filled, round(count(*) FILTER (reason IS DISTINCT FROM 'ticker_missing')::DOUBLE / count(*), 4) AS ticker_fill_ratio,
      count(*) FILTER (reason IS NULL) AS trackable, round(count(*) FILTER (reason IS NULL)::DOUBLE / count(*), 4) AS trackable_ratio,
      count(*) FILTER (reason IS NULL AND replace(p_name, ' ', '') <> replace(name, ' ', '')) AS name_mismatch, CASE WHEN count(*) FILTER (reason IS NULL) < 10 THEN 'hold' ELSE 'proceed' END AS verdict FROM c""")
def tracking_coverage(spark: SparkSession, sf: str) -> DataFrame:
    k, code = F.col("p_partkey") % 4, F.lpad(F.col("p_partkey").cast("string"), 6, "0")
    raw = F.when(k == 1, F.concat(F.lit("A"), code)).when(k == 2, code).when(k == 3, F.col("p_brand"))
    items = table(spark, sf, "part").select(raw.alias("ticker_raw"), F.col("p_name").alias("stock_name"))
    master = table(spark, sf, "supplier").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("code"), F.lit("small ring").alias("name"), F.lit("KOSPI").alias("market"))
    return K.coverage(K.classify(items, master))


@plans.add("""WITH r AS (SELECT o_orderkey AS position, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS strategy_id, CASE WHEN o_orderkey % 5 = 0 THEN 'v1' ELSE 'v2' END AS schema_version, o_orderdate + INTERVAL 28 YEAR AS created, o_orderkey % 11 > 0 AS valid FROM orders),
    s AS (SELECT *, CASE WHEN NOT valid THEN 'invalid_record' WHEN schema_version <> 'v2' THEN 'not_schema_v2' WHEN (created + INTERVAL 9 HOUR)::DATE < DATE '2026-10-19' THEN 'before_rule_start' END AS skip FROM r)
    SELECT position, coalesce(skip, CASE WHEN strategy_id IS NOT NULL AND row_number() OVER (PARTITION BY strategy_id, skip IS NULL ORDER BY position) > 1 THEN 'duplicate_strategy_id' END) AS skipped FROM s""")
def strategy_records(spark: SparkSession, sf: str) -> DataFrame:
    o, k = table(spark, sf, "orders"), F.col("o_orderkey")
    r = o.select(
        k.alias("position"), F.when(k % 7 != 0, F.col("o_custkey")).alias("strategy_id"), F.when(k % 5 == 0, "v1").otherwise("v2").alias("schema_version"),
        (F.col("o_orderdate").cast("timestamp") + F.expr("interval 28 years")).alias("created"), (k % 11 > 0).alias("valid"),
    )
    return K.select_records(r).select("position", "skipped")


QUERIES, ORACLE = plans.queries, plans.oracle
