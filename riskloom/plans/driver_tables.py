"""The domain's frames read from the star-schema tables, and the same as SQL.

Instruments are event types (complete grid of dates) or parts; prices are daily maxima of event values; portfolios are market segments
or customers; exposures are account balances dealt to instruments by key; runs are orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INSTRUMENTS = ("click", "error", "purchase", "signup", "view")
_LIST = "[" + ", ".join(f"'{x}'" for x in INSTRUMENTS) + "]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("instrument_id"), F.col("ts").cast("date").alias("price_date"))
    return rows.agg(F.max(F.col("value").cast("decimal(18,2)")).alias("close_price")).withColumn("adjusted_close_price", F.col("close_price"))


def exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    instrument = F.element_at(F.array(*[F.lit(x) for x in INSTRUMENTS]), (F.col("c_custkey") % len(INSTRUMENTS)).cast("int") + 1)
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("run_id"), instrument.alias("instrument_id"))
    return rows.agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("decimal(23,6)").alias("market_value"))


def position_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed quantities and prices by segment, brand and month-end of the order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", F.col("l_quantity").cast("decimal(18,2)").alias("q"), F.col("l_extendedprice").cast("decimal(18,2)").alias("mv"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.last_day(F.col("o_orderdate").cast("date")).alias("valuation_date"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("portfolio_id"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("instrument_id"))
    short = F.col("l_returnflag") == "R"
    rows = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("portfolio_id", "instrument_id", "valuation_date").agg(
        F.sum(F.when(short, -F.col("q")).otherwise(F.col("q"))).cast("decimal(23,6)").alias("signed_quantity"),
        F.sum(F.when(short, -F.col("mv")).otherwise(F.col("mv"))).cast("decimal(23,6)").alias("signed_market_value"),
    )


def segment_cash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("portfolio_id"))
    return rows.agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("decimal(23,6)").alias("closing_cash"))


_ROW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def raw_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as source-aligned text with faults. source_record_id is order:line:n, with n counting the rows of a line in a total
    order; the window has the partitioning that the duplicate rules need, so it costs no shuffle beside theirs."""
    k = F.col("l_orderkey")
    n = F.row_number().over(Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*_ROW_ORDER[2:]))
    rows = table(spark, sf_dir, "lineitem").withColumn("source_row_number", n.cast("bigint"))
    money = lambda c: F.col(c).cast("decimal(18,2)").cast("string")
    return rows.select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("source_row_number").cast("string")).alias("source_record_id"),
        "source_row_number",
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_returnflag",
        F.when(k % 11 == 0, "abc").when(k % 13 == 0, "").otherwise(money("l_quantity")).alias("raw_quantity"),
        F.when(k % 17 == 0, "-5.00").when(k % 19 == 0, "  ").otherwise(money("l_extendedprice")).alias("raw_price"),
        F.when(k % 23 == 0, "2016-13-45").otherwise(F.col("l_shipdate").cast("date").cast("string")).alias("raw_date"),
    )


def typed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.functions.expr import record_hash, try_cast

    rows = raw_items(spark, sf_dir).withColumns({"quantity": try_cast("raw_quantity", "decimal(18,2)"), "price": try_cast("raw_price", "decimal(18,2)"), "ship_date": try_cast("raw_date", "date")})
    return rows.withColumn("record_hash", record_hash(["l_orderkey", "l_linenumber", "l_partkey", "quantity", "price", "ship_date"]))


PRICES = "prices AS (SELECT event_type AS instrument_id, CAST(ts AS DATE) AS price_date, MAX(CAST(value AS DECIMAL(18,2))) AS close_price FROM events GROUP BY 1, 2)"
EXPOSURES = f"exposures AS (SELECT c_mktsegment AS run_id, ({_LIST})[CAST(c_custkey % 5 AS INT) + 1] AS instrument_id, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(23,6)) AS market_value FROM customer GROUP BY 1, 2)"
RETURNS = """prior AS (SELECT instrument_id, price_date AS scenario_date, LAG(price_date) OVER w AS prior_date, close_price, LAG(close_price) OVER w AS prior_price FROM prices WINDOW w AS (PARTITION BY instrument_id ORDER BY price_date)),
returns AS (SELECT instrument_id, scenario_date, prior_date, CAST(ROUND(CAST(close_price AS DOUBLE) / CAST(prior_price AS DOUBLE), 12) - 1 AS DECIMAL(14,12)) AS simple_return FROM prior WHERE prior_price IS NOT NULL)"""
COMPONENTS = "components AS (SELECT run_id, scenario_date, prior_date, instrument_id, market_value * simple_return AS pnl FROM exposures JOIN returns USING (instrument_id))"
SCENARIOS = "scenarios AS (SELECT run_id, scenario_date, MAX(prior_date) AS prior_date, SUM(pnl) AS pnl, -SUM(pnl) AS loss FROM components GROUP BY 1, 2)"
RISK = f"WITH {PRICES}, {EXPOSURES}, {RETURNS}, {COMPONENTS}, {SCENARIOS}"
MEASURES = """ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY loss, scenario_date) AS loss_rank, COUNT(*) OVER (PARTITION BY run_id) AS observations FROM scenarios),
measures AS (SELECT run_id, level, observations, loss_rank, scenario_date, loss FROM ranked CROSS JOIN (SELECT UNNEST([0.95, 0.99]::DECIMAL(3,2)[]) AS level) WHERE loss_rank = CEIL(level * observations))"""
VALUES = """vals AS (SELECT c_mktsegment AS portfolio_id, p_brand AS instrument_id, LAST_DAY(CAST(o_orderdate AS DATE)) AS valuation_date,
CAST(SUM(CASE WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS DECIMAL(18,2)) ELSE CAST(l_quantity AS DECIMAL(18,2)) END) AS DECIMAL(23,6)) AS signed_quantity,
CAST(SUM(CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DECIMAL(23,6)) AS mv
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""
CASH = "cash AS (SELECT c_mktsegment AS portfolio_id, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(23,6)) AS cash FROM customer GROUP BY 1)"
METRICS = f"""WITH {VALUES}, {CASH},
sums AS (SELECT portfolio_id, valuation_date, COUNT(*) AS position_count, SUM(CASE WHEN mv > 0 THEN mv ELSE 0 END) AS long_value, SUM(CASE WHEN mv < 0 THEN -mv ELSE 0 END) AS short_value FROM vals GROUP BY 1, 2),
navs AS (SELECT sums.*, cash.cash, long_value + short_value AS gross_value, long_value - short_value AS net_value, long_value - short_value + cash AS nav FROM sums JOIN cash USING (portfolio_id)),
based AS (SELECT *, COALESCE(LAG(nav) OVER (PARTITION BY portfolio_id ORDER BY valuation_date), nav) AS baseline FROM navs),
metrics AS (SELECT *, nav - baseline AS pnl, CASE WHEN baseline > 0 THEN CAST(nav - baseline AS DOUBLE) / CAST(baseline AS DOUBLE) ELSE 0 END AS daily_return FROM based)"""
RAW = """numbers AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS source_row_number FROM lineitem),
raw AS (SELECT concat_ws(':', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(source_row_number AS VARCHAR)) AS source_record_id, source_row_number, l_orderkey, l_linenumber, l_partkey, l_returnflag,
CASE WHEN l_orderkey % 11 = 0 THEN 'abc' WHEN l_orderkey % 13 = 0 THEN '' ELSE CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) END AS raw_quantity,
CASE WHEN l_orderkey % 17 = 0 THEN '-5.00' WHEN l_orderkey % 19 = 0 THEN '  ' ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) END AS raw_price,
CASE WHEN l_orderkey % 23 = 0 THEN '2016-13-45' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS raw_date FROM numbers),
typed0 AS (SELECT *, TRY_CAST(NULLIF(TRIM(raw_quantity), '') AS DECIMAL(18,2)) AS quantity, TRY_CAST(NULLIF(TRIM(raw_price), '') AS DECIMAL(18,2)) AS price, TRY_CAST(NULLIF(TRIM(raw_date), '') AS DATE) AS ship_date FROM raw),
typed AS (SELECT *, sha256(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), COALESCE(CAST(quantity AS VARCHAR), '<NULL>'), COALESCE(CAST(price AS VARCHAR), '<NULL>'), COALESCE(CAST(ship_date AS VARCHAR), '<NULL>'))) AS record_hash FROM typed0)"""


def money(c: str, scale: int = 4) -> str:
    return f"CAST(CAST({c} AS DECIMAL(38,{scale})) AS DOUBLE)"
