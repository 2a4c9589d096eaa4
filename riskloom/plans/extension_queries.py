"""Reconciliation and snapshot checks, dimensions, and the metrics that are specified but not part of the daily run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.expr import castable, shown, try_cast
from riskloom.operators import guards as G
from riskloom.operators import risk as R
from riskloom.operators import snapshot_rules as K
from riskloom.plans import driver_tables as T
from riskloom.plans.catalog import query
from riskloom.sources.store import SnapshotStore

M = T.money


@query("SELECT DISTINCT c_mktsegment AS portfolio_id FROM customer")
def dim_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("portfolio_id")).distinct()


@query("SELECT p_brand AS instrument_id, p_type AS sector, COUNT(*) AS parts FROM part GROUP BY 1, 2")
def dim_instrument(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("instrument_id"), F.col("p_type").alias("sector")).agg(F.count(F.lit(1)).alias("parts"))


@query(
    f"WITH {T.PRICES}, c AS (SELECT price_date, COUNT(DISTINCT instrument_id) AS m FROM prices GROUP BY 1) "
    "SELECT 'PRICE_BUSINESS_KEY_UNIQUE' AS rule_id, COUNT(*) = 0 AS is_met, CAST(COUNT(*) AS VARCHAR) AS observed FROM (SELECT user_id, CAST(ts AS DATE) FROM events GROUP BY 1, 2 HAVING COUNT(*) > 1) UNION ALL SELECT 'PRICE_EXPECTED_COVERAGE', COUNT(*) = 150, CAST(COUNT(*) AS VARCHAR) FROM prices UNION ALL SELECT 'PRICE_EXPECTED_DATE_GRID', COUNT(*) FILTER (m <> 5) = 0, CAST(COUNT(*) FILTER (m <> 5) AS VARCHAR) FROM c "
    "UNION ALL SELECT 'ACTIONS_IN_SESSIONS', COUNT(*) = 0, CAST(COUNT(*) AS VARCHAR) FROM ((SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE event_type = 'signup') EXCEPT ALL (SELECT DISTINCT price_date FROM prices))"
)
def snapshot_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = T.prices(spark, sf_dir)
    actions = T.table(spark, sf_dir, "events").where("event_type = 'signup'").select(F.col("ts").cast("date").alias("d")).distinct()
    checks = [
        K.key_unique(T.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("price_date")), "PRICE_BUSINESS_KEY_UNIQUE", ["user_id", "price_date"]),
        K.row_count(prices, "PRICE_EXPECTED_COVERAGE", 150),
        K.complete_grid(prices, "PRICE_EXPECTED_DATE_GRID", "price_date", "instrument_id", 5),
        K.contained(actions, prices.select(F.col("price_date").alias("d")).distinct(), "ACTIONS_IN_SESSIONS"),
    ]
    return reduce(DataFrame.unionByName, checks)


@query("WITH s AS (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events WHERE event_type = 'view'), a AS (SELECT event_type, CAST(ts AS DATE) AS d FROM events GROUP BY 1, 2) SELECT event_type AS instrument_id, (SELECT COUNT(*) FROM s) AS sessions, COUNT(*) AS priced, COUNT(*) FILTER (d IN (SELECT d FROM s)) = COUNT(*) AND COUNT(*) = (SELECT COUNT(*) FROM s) AS is_admitted FROM a GROUP BY 1")
def silver_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per instrument: whether its dates are the calendar's sessions, neither more nor less."""
    rows = T.prices(spark, sf_dir).select("instrument_id", F.col("price_date").alias("d"))
    sessions = rows.where("instrument_id = 'view'").select("d", F.lit(True).alias("in_session"))
    n = sessions.agg(F.count(F.lit(1)).alias("sessions"))
    found = rows.join(sessions, "d", "left").groupBy("instrument_id").agg(F.count(F.lit(1)).alias("priced"), F.count("in_session").alias("inside"))
    return found.crossJoin(n).select("instrument_id", "sessions", "priced", ((F.col("inside") == F.col("priced")) & (F.col("priced") == F.col("sessions"))).alias("is_admitted"))  # one row of n


@query("SELECT event_type AS source_id, COUNT(*) AS row_count, COUNT(DISTINCT event_id) AS distinct_records, CAST(MIN(CAST(ts AS DATE)) AS VARCHAR) AS first_date, CAST(MAX(CAST(ts AS DATE)) AS VARCHAR) AS last_date, COUNT(*) = COUNT(DISTINCT event_id) AS is_reconciled FROM events GROUP BY 1")
def bronze_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("source_id"))
    day = F.col("ts").cast("date")
    out = rows.agg(F.count(F.lit(1)).alias("row_count"), F.count_distinct("event_id").alias("distinct_records"), F.min(day).cast("string").alias("first_date"), F.max(day).cast("string").alias("last_date"))
    return out.withColumn("is_reconciled", F.col("row_count") == F.col("distinct_records"))


@query(
    f"{T.RISK}, navs AS (SELECT run_id, SUM(market_value) AS nav FROM exposures GROUP BY 1), recent AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY scenario_date DESC) AS n FROM scenarios), "
    "l AS (SELECT UNNEST([0.95, 0.99]::DOUBLE[]) AS confidence_level), q AS (SELECT run_id, confidence_level, COUNT(*) AS observations, quantile_cont(CAST(loss AS DOUBLE), 0.95) AS v95, quantile_cont(CAST(loss AS DOUBLE), 0.99) AS v99 FROM recent CROSS JOIN l WHERE n <= 20 GROUP BY 1, 2) "
    "SELECT run_id, CAST(confidence_level AS DOUBLE) AS confidence_level, observations, ROUND(CASE WHEN confidence_level = 0.95 THEN v95 ELSE v99 END, 4) AS var_amount, ROUND(CASE WHEN nav > 0 THEN CASE WHEN confidence_level = 0.95 THEN v95 ELSE v99 END / CAST(nav AS DOUBLE) END, 8) AS var_share FROM q JOIN navs USING (run_id)"
)
def continuous_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interpolated quantiles of the last 20 losses, as the tables have 29 dates."""
    exposures = T.exposures(spark, sf_dir)
    rows = R.historical_pnl(exposures, R.adjusted_returns(T.prices(spark, sf_dir)))
    found = R.continuous_var(rows, exposures.groupBy("run_id").agg(F.sum("market_value").alias("static_nav")), window=20, least=20)
    return found.select("run_id", "confidence_level", "observations", F.round("var_amount", 4).alias("var_amount"), F.round("var_share", 8).alias("var_share"))


@query("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'yesterday' ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS raw_ts, epoch(TRY_CAST(CASE WHEN event_id % 7 = 0 THEN 'yesterday' ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS TIMESTAMP))::BIGINT AS seconds, event_id % 7 <> 0 AS is_castable FROM events")
def timestamp_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as timestamps; what can't be cast is null and reported."""
    text = F.when(F.col("event_id") % 7 == 0, "yesterday").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = T.table(spark, sf_dir, "events").select("event_id", text.alias("raw_ts")).withColumn("ts", try_cast("raw_ts", "timestamp"))
    return rows.select("event_id", "raw_ts", F.unix_timestamp("ts").alias("seconds"), castable("raw_ts", "ts").alias("is_castable"))


@query("WITH b AS (SELECT event_type AS batch_id, COUNT(*) AS found_rows, COUNT(*) + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS stated_rows FROM events GROUP BY 1) SELECT batch_id, found_rows, CAST(CASE WHEN batch_id = 'click' THEN 2 ELSE 1 END AS BIGINT) AS audits, CAST(CASE WHEN batch_id = 'click' THEN 2 * stated_rows ELSE stated_rows END AS BIGINT) AS stated_rows, batch_id NOT IN ('error', 'click') AS is_reconciled FROM b")
def batch_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each batch against its audit row: one batch has a wrong count, another two audit rows."""
    rows = T.table(spark, sf_dir, "events").select(F.col("event_type").alias("batch_id"))
    log = rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("row_count")).withColumn("status", F.lit("SUCCEEDED"))
    log = log.withColumn("row_count", F.col("row_count") + F.when(F.col("batch_id") == "error", 1).otherwise(0))
    return G.single_batch(rows, log.unionByName(log.where("batch_id = 'click'")))


@query("SELECT o_custkey AS portfolio_id, COUNT(*) AS runs, CAST(0 AS BIGINT) AS prior_runs, CAST(COALESCE(MAX(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END), -1) AS BIGINT) AS last_finished FROM orders GROUP BY 1")
def no_prior_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First runs: the frame of prior runs is empty by a constant filter, and missing values get their default."""
    runs = T.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("portfolio_id"), "o_orderkey", "o_orderstatus")
    prior = G.none_of(runs).groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("prior_runs"))
    last = F.max(F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey")))
    found = runs.groupBy("portfolio_id").agg(F.count(F.lit(1)).alias("runs"), F.coalesce(last, F.lit(-1)).cast("bigint").alias("last_finished"))
    return found.join(prior, "portfolio_id", "left").withColumn("prior_runs", F.coalesce("prior_runs", F.lit(0)).cast("bigint"))


@query(
    f"WITH {T.PRICES}, d AS (SELECT event_type AS instrument_id, CAST(ts AS DATE) AS price_date, SUM(CAST(value AS DECIMAL(18,2))) AS dividend FROM events GROUP BY 1, 2), "
    "p AS (SELECT instrument_id, price_date, close_price - LAG(close_price) OVER (PARTITION BY instrument_id ORDER BY price_date) AS move FROM prices) "
    f"SELECT instrument_id, CAST(price_date AS VARCHAR) AS price_date, {M('move * 100')} AS price_pnl, {M('COALESCE(dividend, 0) * 100')} AS dividend_pnl, {M('(move + COALESCE(dividend, 0)) * 100')} AS total_pnl FROM p LEFT JOIN d USING (instrument_id, price_date) WHERE move IS NOT NULL"
)
def pnl_decomposition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price and dividend P&L of 100 units held, per instrument and date."""
    w = Window.partitionBy("instrument_id").orderBy("price_date")
    moves = T.prices(spark, sf_dir).withColumn("move", F.col("close_price") - F.lag("close_price").over(w)).where("move is not null")
    paid = T.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("instrument_id"), F.col("ts").cast("date").alias("price_date")).agg(F.sum(F.col("value").cast("decimal(18,2)")).alias("dividend"))
    rows = moves.join(paid, ["instrument_id", "price_date"], "left").withColumn("dividend", F.coalesce("dividend", F.lit(0).cast("decimal(18,2)")))
    return rows.select("instrument_id", F.col("price_date").cast("string").alias("price_date"), shown(F.col("move") * 100).alias("price_pnl"), shown(F.col("dividend") * 100).alias("dividend_pnl"), shown((F.col("move") + F.col("dividend")) * 100).alias("total_pnl"))


@query("WITH l AS (SELECT MAX(CAST(ts AS DATE)) AS today FROM events) SELECT user_id AS instrument_id, CAST(MAX(CAST(ts AS DATE)) AS VARCHAR) AS last_date, CAST(MAX(today) - MAX(CAST(ts AS DATE)) AS INT) AS days_behind, CASE WHEN MAX(today) - MAX(CAST(ts AS DATE)) = 0 THEN 'COMPLETE' ELSE 'PARTIAL' END AS freshness FROM events, l GROUP BY 1")
def price_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("instrument_id")).agg(F.max(F.col("ts").cast("date")).alias("last_date"))
    today = rows.agg(F.max("last_date").alias("today"))
    behind = F.datediff("today", "last_date")
    return rows.crossJoin(today).select("instrument_id", F.col("last_date").cast("string").alias("last_date"), behind.alias("days_behind"), F.when(behind == 0, "COMPLETE").otherwise("PARTIAL").alias("freshness"))  # one row of today


def register_views(spark: SparkSession, store: SnapshotStore) -> list[str]:
    """Serving views over the current snapshots, for reports to import."""
    names = sorted(store.versions())
    for name in names:
        store.read(name).createOrReplaceTempView(f"v_{name}")
    return [f"v_{n}" for n in names]


def import_view(spark: SparkSession, name: str, columns: list[str] | None = None) -> DataFrame:
    """What a report imports of a registered view: all its columns, or the given ones in their order. ValueError if it isn't there."""
    if not spark.catalog.tableExists(name):
        raise ValueError(f"no view {name}")
    view = spark.table(name)
    return view if columns is None else view.select(*columns)
