"""Risk, position and valuation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.expr import shown
from riskloom.operators import positions as P
from riskloom.operators import risk as R
from riskloom.operators import serving as S
from riskloom.plans import driver_tables as T
from riskloom.plans.catalog import query

M = T.money


def _scenarios(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    returns = R.adjusted_returns(T.prices(spark, sf_dir))
    exposures = T.exposures(spark, sf_dir)
    return exposures, returns, R.historical_pnl(exposures, returns)


@query(f"{T.RISK}, {T.MEASURES} SELECT run_id, CAST(level AS DOUBLE) AS confidence_level, observations, loss_rank AS var_rank, CAST(scenario_date AS VARCHAR) AS scenario_date, {M('loss')} AS var_amount FROM measures")
def historical_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, scenarios = _scenarios(spark, sf_dir)
    return R.discrete_var(scenarios).select("run_id", F.col("confidence_level").cast("double").alias("confidence_level"), "observations", F.col("var_rank").cast("bigint").alias("var_rank"), F.col("scenario_date").cast("string").alias("scenario_date"), shown(F.col("var_amount")).alias("var_amount"))


@query(
    f"{T.RISK}, {T.MEASURES} SELECT run_id, CAST(level AS DOUBLE) AS confidence_level, instrument_id, {M('-pnl')} AS contribution, SUM(-pnl) OVER (PARTITION BY run_id, level) = loss AS reconciles, "
    "ROUND(CAST(CASE WHEN loss <> 0 THEN CAST(-pnl AS DOUBLE) / CAST(loss AS DOUBLE) END AS DOUBLE), 6) AS share FROM measures JOIN components USING (run_id, scenario_date)"
)
def var_component_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    exposures, returns, scenarios = _scenarios(spark, sf_dir)
    rows = R.var_components(R.discrete_var(scenarios), R.component_pnl(exposures, returns).drop("prior_date"))
    return rows.select("run_id", F.col("confidence_level").cast("double").alias("confidence_level"), "instrument_id", shown(F.col("contribution")).alias("contribution"), "reconciles", F.round("share", 6).alias("share"))


@query(f"{T.RISK} SELECT run_id, CAST(scenario_date AS VARCHAR) AS scenario_date, CAST(prior_date AS VARCHAR) AS prior_date, ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY scenario_date) AS observation, {M('pnl')} AS pnl, {M('loss')} AS loss FROM scenarios")
def historical_pnl_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    *_, rows = _scenarios(spark, sf_dir)
    return rows.select("run_id", F.col("scenario_date").cast("string").alias("scenario_date"), F.col("prior_date").cast("string").alias("prior_date"), F.col("observation").cast("bigint").alias("observation"), shown(F.col("pnl")).alias("pnl"), shown(F.col("loss")).alias("loss"))


@query(f"WITH {T.PRICES}, {T.RETURNS} SELECT instrument_id, CAST(scenario_date AS VARCHAR) AS scenario_date, CAST(prior_date AS VARCHAR) AS prior_date, CAST(simple_return AS DOUBLE) AS simple_return FROM returns")
def adjusted_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.adjusted_returns(T.prices(spark, sf_dir))
    return rows.select("instrument_id", F.col("scenario_date").cast("string").alias("scenario_date"), F.col("prior_date").cast("string").alias("prior_date"), F.col("simple_return").cast("double").alias("simple_return"))


_SHOCKS = f"""navs AS (SELECT run_id, SUM(market_value) AS static_nav FROM exposures GROUP BY 1),
shocks AS (SELECT s.scenario_id, i.instrument_id, CAST(CASE s.scenario_id WHEN 'BROAD' THEN -0.10 WHEN 'TECH' THEN -0.02 * i.n ELSE -0.05 + 0.01 * i.n END AS DECIMAL(12,10)) AS shock_ratio
FROM (SELECT UNNEST(['BROAD', 'TECH', 'SUPPLY']) AS scenario_id) s CROSS JOIN (SELECT UNNEST({T._LIST}) AS instrument_id, UNNEST([0, 1, 2, 3, 4]) AS n) i),
stressed AS (SELECT run_id, scenario_id, SUM(market_value * shock_ratio) AS stress_pnl, COUNT(*) AS shock_count FROM exposures JOIN shocks USING (instrument_id) GROUP BY 1, 2)"""


def _shocks(spark: SparkSession) -> DataFrame:
    from decimal import Decimal as D

    rows = []
    for n, i in enumerate(T.INSTRUMENTS):
        rows += [("BROAD", i, D("-0.10")), ("TECH", i, D("-0.02") * n), ("SUPPLY", i, D("-0.05") + D("0.01") * n)]
    return spark.createDataFrame(rows, "scenario_id string, instrument_id string, shock_ratio decimal(12,10)")


def _stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    exposures = T.exposures(spark, sf_dir)
    return R.stress(exposures, _shocks(spark), exposures.groupBy("run_id").agg(F.sum("market_value").alias("static_nav")))


@query(f"WITH {T.EXPOSURES}, {_SHOCKS} SELECT run_id, scenario_id, shock_count, {M('stress_pnl')} AS stress_pnl, {M('static_nav')} AS static_nav, {M('static_nav + stress_pnl')} AS stressed_nav FROM stressed JOIN navs USING (run_id)")
def stress_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stress(spark, sf_dir).select("run_id", "scenario_id", "shock_count", *[shown(F.col(c)).alias(c) for c in ("stress_pnl", "static_nav", "stressed_nav")])


# stored results: amounts of technology scenarios were booked in whole units
_STORED = "stored AS (SELECT run_id, scenario_id, CASE WHEN scenario_id = 'TECH' THEN CAST(ROUND(stress_pnl) AS DECIMAL(38,4)) ELSE CAST(stress_pnl AS DECIMAL(38,4)) END AS stored_pnl FROM stressed), again AS (SELECT run_id, scenario_id, CAST(stress_pnl AS DECIMAL(38,4)) AS again_pnl FROM stressed)"


@query(f"WITH {T.EXPOSURES}, {_SHOCKS}, {_STORED} SELECT run_id, scenario_id, CAST(stored_pnl AS DOUBLE) AS stress_pnl, CAST(again_pnl AS DOUBLE) AS again_pnl, shock_count, shock_count = 5 AS has_all_shocks, stored_pnl = again_pnl AS is_match FROM stored JOIN again USING (run_id, scenario_id) JOIN stressed USING (run_id, scenario_id)")
def stress_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stress(spark, sf_dir).withColumn("stress_pnl", F.col("stress_pnl").cast("decimal(38,4)")).withColumn("stressed_nav", (F.col("static_nav") + F.col("stress_pnl")).cast("decimal(38,4)"))
    stored = rows.withColumn("stress_pnl", F.when(F.col("scenario_id") == "TECH", F.round("stress_pnl").cast("decimal(38,4)")).otherwise(F.col("stress_pnl")))
    found = R.stress_reconciliation(stored.withColumn("stressed_nav", (F.col("static_nav") + F.col("stress_pnl")).cast("decimal(38,4)")), rows, expected_shocks=len(T.INSTRUMENTS))
    return found.select("run_id", "scenario_id", F.col("stress_pnl").cast("double").alias("stress_pnl"), F.col("again_pnl").cast("double").alias("again_pnl"), "shock_count", "has_all_shocks", "is_match")


@query(f"WITH {T.VALUES} SELECT portfolio_id, instrument_id, CAST(valuation_date AS VARCHAR) AS valuation_date, {M('signed_quantity')} AS signed_quantity, {M('signed_quantity * p.close')} AS signed_market_value, {M('ABS(signed_quantity * p.close)')} AS absolute_market_value, CASE WHEN signed_quantity >= 0 THEN 'LONG' ELSE 'SHORT' END AS position_side FROM vals JOIN (SELECT p_brand, MAX(CAST(p_retailprice AS DECIMAL(18,2))) AS close FROM part GROUP BY 1) p ON p_brand = instrument_id")
def position_market_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    closes = T.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("instrument_id")).agg(F.max(F.col("p_retailprice").cast("decimal(18,2)")).alias("close_price"))
    rows = P.market_values(T.position_values(spark, sf_dir).drop("signed_market_value").join(closes, "instrument_id"))
    return rows.select("portfolio_id", "instrument_id", F.col("valuation_date").cast("string").alias("valuation_date"), *[shown(F.col(c)).alias(c) for c in ("signed_quantity", "signed_market_value", "absolute_market_value")], "position_side")


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = T.position_values(spark, sf_dir)
    dates = values.select("portfolio_id", "valuation_date").distinct()
    return P.daily_metrics(values, dates.join(T.segment_cash(spark, sf_dir), "portfolio_id"))


_AMOUNTS = ("long_value", "short_value", "gross_value", "net_value", "cash", "nav", "baseline", "pnl")


@query(
    f"{T.METRICS} SELECT portfolio_id, CAST(valuation_date AS VARCHAR) AS valuation_date, position_count, {', '.join(f'{M(c)} AS {c}' for c in _AMOUNTS)}, ROUND(daily_return, 8) AS daily_return, "
    + ", ".join(f"ROUND(CASE WHEN nav > 0 THEN CAST({a}_value AS DOUBLE) / CAST(nav AS DOUBLE) ELSE 0 END, 8) AS {a}_ratio" for a in ("long", "short", "gross", "net"))
    + " FROM metrics"
)
def portfolio_daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metrics(spark, sf_dir).select("portfolio_id", F.col("valuation_date").cast("string").alias("valuation_date"), "position_count", *[shown(F.col(c)).alias(c) for c in _AMOUNTS], *[F.round(c, 8).alias(c) for c in ("daily_return", "long_ratio", "short_ratio", "gross_ratio", "net_ratio")])


_FIRST = """navs AS (SELECT c_mktsegment AS portfolio_id, CAST(SUM(CAST(c_acctbal AS DECIMAL(18,2))) AS DECIMAL(16,2)) AS initial_nav FROM customer GROUP BY 1),
starts AS (SELECT instrument_id, MIN(price_date) AS position_date, MIN_BY(close_price, price_date) AS close_price FROM prices GROUP BY 1)"""


def _inception(spark: SparkSession, sf_dir: str) -> DataFrame:
    navs = T.table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("portfolio_id")).agg(F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("decimal(16,2)").alias("initial_nav"))
    starts = T.prices(spark, sf_dir).groupBy("instrument_id").agg(F.min("price_date").alias("position_date"), F.min_by("close_price", "price_date").alias("close_price"))
    weights = navs.select("portfolio_id").crossJoin(spark.createDataFrame([(i,) for i in T.INSTRUMENTS], "instrument_id string")).withColumn("target_weight", F.lit("0.2").cast("decimal(12,10)"))  # segments by instruments
    return P.inception_quantities(weights, navs, starts)


@query(f"WITH {T.PRICES}, {_FIRST} SELECT portfolio_id, instrument_id, CAST(position_date AS VARCHAR) AS position_date, ROUND(CAST(CAST(initial_nav * 0.2 AS DECIMAL(20,6)) AS DOUBLE) / CAST(close_price AS DOUBLE), 4) AS signed_quantity FROM navs CROSS JOIN starts")
def inception_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _inception(spark, sf_dir).select("portfolio_id", "instrument_id", F.col("position_date").cast("string").alias("position_date"), F.round(F.col("signed_quantity").cast("double"), 4).alias("signed_quantity"))


# every event is an action of its user's instrument: errors are splits of 0.9 to 1.13, all others dividends of a hundredth of their value
_ACTIONS = """acts AS (SELECT event_id, event_type, CAST(user_id AS VARCHAR) AS instrument_id, CAST(ts AS DATE) AS d, CAST(value AS DECIMAL(18,2)) AS v FROM events),
splits AS (SELECT instrument_id, d, event_id, CAST(0.9 + CAST(CAST(v * 100 AS BIGINT) % 37 AS DECIMAL(18,0)) * CAST(0.0061728395 AS DECIMAL(18,10)) AS DECIMAL(18,10)) AS ratio FROM acts WHERE event_type = 'error'),
multipliers AS (SELECT instrument_id, d, CAST(list_reduce(list_prepend(CAST(1 AS DECIMAL(18,10)), LIST(ratio ORDER BY event_id)), lambda a, x: CAST(ROUND(a * x, 10) AS DECIMAL(18,10))) AS DECIMAL(18,10)) AS m, COUNT(*) AS split_count,
sha256(string_agg(sha256(concat_ws('|', instrument_id, CAST(d AS VARCHAR), CAST(event_id AS VARCHAR), CAST(ratio AS VARCHAR))), chr(10) ORDER BY event_id)) AS split_set FROM splits GROUP BY 1, 2)"""


def _actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = (F.col("value").cast("decimal(18,2)") * 100).cast("bigint")
    is_split = F.col("event_type") == "error"
    ratio = (F.lit("0.9").cast("decimal(11,10)") + (cents % 37).cast("decimal(2,0)") * F.lit("0.0061728395").cast("decimal(11,10)")).cast("decimal(20,10)")
    return T.table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("instrument_id"),
        F.col("ts").cast("date").alias("effective_date"),
        F.when(is_split, "STOCK_SPLIT").otherwise("CASH_DIVIDEND").alias("action_type"),
        F.col("event_id").alias("source_record_id"),
        F.when(is_split, ratio).alias("split_ratio"),
        F.when(~is_split, (F.col("value").cast("decimal(18,2)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(20,8)")).alias("dividend_amount_per_share"),
    )


@query(f"WITH {_ACTIONS} SELECT instrument_id, CAST(d AS VARCHAR) AS position_date, CAST(m AS VARCHAR) AS split_multiplier, split_count, split_set AS split_set_sha256 FROM multipliers")
def split_multipliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.split_multipliers(_actions(spark, sf_dir)).select("instrument_id", F.col("position_date").cast("string").alias("position_date"), F.col("split_multiplier").cast("string").alias("split_multiplier"), "split_count", "split_set_sha256")


_CARRIED = f"""{_ACTIONS}, inception AS (SELECT event_type AS portfolio_id, instrument_id, MIN(d) AS inception_date, SUM(v) AS q FROM acts GROUP BY 1, 2), days AS (SELECT DISTINCT d FROM acts),
grid AS (SELECT i.*, days.d AS position_date FROM inception i JOIN days ON days.d >= i.inception_date),
factors AS (SELECT g.portfolio_id, g.instrument_id, g.inception_date, g.position_date, g.q, CAST(list_reduce(list_prepend(CAST(1 AS DECIMAL(18,10)), COALESCE(LIST(s.m ORDER BY s.d) FILTER (s.m IS NOT NULL), CAST([] AS DECIMAL(18,10)[]))), lambda a, x: CAST(ROUND(a * x, 10) AS DECIMAL(18,10))) AS DECIMAL(18,10)) AS f,
CAST(list_reduce(list_prepend(CAST(g.q AS DECIMAL(38,16)), COALESCE(LIST(CAST(s.m AS DECIMAL(38,16)) ORDER BY s.d) FILTER (s.m IS NOT NULL), CAST([] AS DECIMAL(38,16)[]))), lambda a, x: CAST(CAST(a AS DECIMAL(20,8)) * CAST(x AS DECIMAL(17,8)) AS DECIMAL(38,16))) AS DECIMAL(38,16)) AS quantity
FROM grid g LEFT JOIN multipliers s ON s.instrument_id = g.instrument_id AND s.d > g.inception_date AND s.d <= g.position_date GROUP BY 1, 2, 3, 4, 5),
carried AS (SELECT * FROM factors)"""


def _carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = T.table(spark, sf_dir, "events").select("event_type", F.col("user_id").cast("string").alias("instrument_id"), F.col("ts").cast("date").alias("d"), F.col("value").cast("decimal(18,2)").alias("v"))
    inception = events.groupBy(F.col("event_type").alias("portfolio_id"), "instrument_id").agg(F.min("d").alias("position_date"), F.sum("v").alias("signed_quantity"))
    return P.carry_forward(inception, events.select(F.col("d").alias("position_date")).distinct(), P.split_multipliers(_actions(spark, sf_dir)))


@query(f"WITH {_CARRIED} SELECT portfolio_id, instrument_id, CAST(position_date AS VARCHAR) AS position_date, CAST(f AS VARCHAR) AS cumulative_split, {M('quantity', 8)} AS carried_quantity, CASE WHEN position_date = inception_date THEN 'INCEPTION' ELSE 'CARRY_FORWARD' END AS basis FROM carried")
def carry_forward_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _carried(spark, sf_dir).select("portfolio_id", "instrument_id", F.col("position_date").cast("string").alias("position_date"), F.col("cumulative_split").cast("string").alias("cumulative_split"), shown(F.col("carried_quantity"), 8).alias("carried_quantity"), "basis")


@query(
    f"WITH {_CARRIED}, paid AS (SELECT instrument_id, d, SUM(CAST(v * 0.01 AS DECIMAL(18,8))) AS dps FROM acts WHERE event_type <> 'error' GROUP BY 1, 2), "
    "prior AS (SELECT *, LAG(quantity) OVER (PARTITION BY portfolio_id, instrument_id ORDER BY position_date) AS pq FROM carried) "
    f"SELECT portfolio_id, CAST(position_date AS VARCHAR) AS cash_date, {M('CAST(SUM(COALESCE(CAST(pq AS DECIMAL(20,8)) * CAST(dps AS DECIMAL(17,8)), 0)) AS DECIMAL(32,6))')} AS dividend_flow, COUNT(dps) AS dividend_positions FROM prior LEFT JOIN paid ON paid.instrument_id = prior.instrument_id AND paid.d = prior.position_date GROUP BY 1, 2"
)
def dividend_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = _carried(spark, sf_dir).select("portfolio_id", "instrument_id", "position_date", F.col("carried_quantity").alias("signed_quantity"))
    rows = P.dividend_flows(positions, _actions(spark, sf_dir).where("dividend_amount_per_share is not null"))
    return rows.select("portfolio_id", F.col("cash_date").cast("string").alias("cash_date"), shown(F.col("dividend_flow")).alias("dividend_flow"), "dividend_positions")


@query(
    "WITH flows AS (SELECT CAST(user_id % 5 AS VARCHAR) AS portfolio_id, CAST(ts AS DATE) AS cash_date, SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) ELSE 0 END) AS flow FROM events GROUP BY 1, 2), "
    "closing AS (SELECT *, 1000000 + SUM(flow) OVER (PARTITION BY portfolio_id ORDER BY cash_date ROWS UNBOUNDED PRECEDING) AS closing_cash FROM flows) "
    f"SELECT portfolio_id, CAST(cash_date AS VARCHAR) AS cash_date, {M('closing_cash - flow')} AS opening_cash, {M('flow')} AS dividend_flow, {M('closing_cash')} AS closing_cash FROM closing"
)
def cash_roll_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = T.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 5).cast("string").alias("portfolio_id"), F.col("ts").cast("date").alias("cash_date"))
    flows = events.agg(F.sum(F.when(F.col("event_type") == "purchase", F.col("value").cast("decimal(18,2)")).otherwise(0)).alias("dividend_flow")).withColumn("initial_cash", F.lit(1000000).cast("decimal(18,2)"))
    return P.cash_roll_forward(flows).select("portfolio_id", F.col("cash_date").cast("string").alias("cash_date"), *[shown(F.col(c)).alias(c) for c in ("opening_cash", "dividend_flow", "closing_cash")])


@query(
    "WITH c AS (SELECT CAST(ts AS DATE) AS d, COUNT(DISTINCT user_id) AS n FROM events GROUP BY 1), most AS (SELECT MAX(n) AS m FROM c) "
    "SELECT CAST(d AS VARCHAR) AS price_date, n AS key_count, n = m AS is_complete, CAST(MAX(CASE WHEN n = m THEN d END) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS VARCHAR) AS previous_complete_date FROM c, most"
)
def previous_complete_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = T.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("date").alias("price_date"))
    most = events.groupBy("price_date").agg(F.count_distinct("user_id").alias("n")).agg(F.max("n").alias("expected"))
    rows = P.previous_complete_asof(events, "user_id", most)
    return rows.select(F.col("price_date").cast("string").alias("price_date"), "key_count", "is_complete", F.col("previous_complete_date").cast("string").alias("previous_complete_date"))


@query(f"{T.METRICS} SELECT portfolio_id, CAST(MAX(valuation_date) AS VARCHAR) AS valuation_date, {M('MAX_BY(nav, valuation_date)')} AS closing_nav FROM metrics GROUP BY 1")
def closing_nav_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.at_latest_date(_metrics(spark, sf_dir), ["portfolio_id"], "valuation_date", F.col("nav"), "closing_nav")
    return rows.select("portfolio_id", F.col("valuation_date").cast("string").alias("valuation_date"), shown(F.col("closing_nav")).alias("closing_nav"))


@query(f"{T.METRICS} SELECT CAST(valuation_date AS VARCHAR) AS valuation_date, CASE WHEN MIN(portfolio_id) = MAX(portfolio_id) THEN ROUND(MAX(daily_return), 8) END AS daily_return FROM metrics GROUP BY 1")
def daily_return_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.only_if_single(_metrics(spark, sf_dir), ["valuation_date"], ["portfolio_id"], F.round("daily_return", 8), "daily_return")
    return rows.select(F.col("valuation_date").cast("string").alias("valuation_date"), "daily_return")


@query(f"WITH {T.VALUES}, latest AS (SELECT portfolio_id, MAX(valuation_date) AS valuation_date FROM vals GROUP BY 1) SELECT portfolio_id, CASE WHEN mv >= 0 THEN 'LONG' ELSE 'SHORT' END AS position_side, COUNT(*) AS positions, {M('SUM(ABS(mv))')} AS exposure FROM vals JOIN latest USING (portfolio_id, valuation_date) GROUP BY 1, 2")
def exposure_by_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = T.position_values(spark, sf_dir)
    latest = values.groupBy("portfolio_id").agg(F.max("valuation_date").alias("valuation_date"))
    rows = values.join(latest, ["portfolio_id", "valuation_date"])
    side = F.when(F.col("signed_market_value") >= 0, "LONG").otherwise("SHORT")
    return rows.groupBy("portfolio_id", side.alias("position_side")).agg(F.count(F.lit(1)).alias("positions"), shown(F.sum(F.abs("signed_market_value"))).alias("exposure"))


@query(f"WITH {T.VALUES} SELECT instrument_id, {M('SUM(ABS(mv))')} AS exposure FROM vals GROUP BY 1 ORDER BY exposure DESC, instrument_id LIMIT 10")
def exposure_by_instrument_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-ten report."""
    rows = T.position_values(spark, sf_dir).groupBy("instrument_id").agg(shown(F.sum(F.abs("signed_market_value"))).alias("exposure"))
    return rows.orderBy(F.col("exposure").desc(), "instrument_id").limit(10)


@query(f"WITH {T.VALUES}, w AS (SELECT *, CAST(ABS(mv) AS DOUBLE) / NULLIF(CAST(SUM(ABS(mv)) OVER (PARTITION BY portfolio_id, valuation_date) AS DOUBLE), 0) AS g FROM vals) SELECT portfolio_id, CAST(valuation_date AS VARCHAR) AS valuation_date, ROUND(SUM(COALESCE(g, 0) * COALESCE(g, 0)), 8) AS hhi, COUNT(*) AS positions FROM w GROUP BY 1, 2")
def hhi_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.concentration(T.position_values(spark, sf_dir)).select("portfolio_id", F.col("valuation_date").cast("string").alias("valuation_date"), F.round("hhi", 8).alias("hhi"), "positions")


@query(f"SELECT p_type AS sector, p_brand AS cluster_id, {M('SUM(CASE WHEN l_returnflag = $$R$$ THEN -CAST(l_extendedprice AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END)')} AS net_exposure, {M('SUM(CAST(l_extendedprice AS DECIMAL(18,2)))')} AS gross_exposure FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2")
def sector_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    mv = F.col("l_extendedprice").cast("decimal(18,2)")
    rows = T.table(spark, sf_dir, "lineitem").join(T.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy(F.col("p_type").alias("sector"), F.col("p_brand").alias("cluster_id")).agg(shown(F.sum(F.when(F.col("l_returnflag") == "R", -mv).otherwise(mv))).alias("net_exposure"), shown(F.sum(mv)).alias("gross_exposure"))


@query(f"{T.METRICS} SELECT portfolio_id, CAST(valuation_date AS VARCHAR) AS valuation_date, COUNT(daily_return) OVER w AS window_count, ROUND(STDDEV_SAMP(daily_return) OVER w * SQRT(252), 6) AS volatility FROM metrics WINDOW w AS (PARTITION BY portfolio_id ORDER BY valuation_date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)")
def rolling_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rolling_volatility(_metrics(spark, sf_dir), window=12).select("portfolio_id", F.col("valuation_date").cast("string").alias("valuation_date"), "window_count", F.round("volatility", 6).alias("volatility"))


@query(
    f"{T.METRICS}, peaks AS (SELECT *, MAX(nav) OVER (PARTITION BY portfolio_id ORDER BY valuation_date ROWS UNBOUNDED PRECEDING) AS peak FROM metrics), "
    "d AS (SELECT *, CASE WHEN peak > 0 THEN CAST(nav AS DOUBLE) / CAST(peak AS DOUBLE) - 1 ELSE 0 END AS drawdown FROM peaks) "
    f"SELECT portfolio_id, CAST(valuation_date AS VARCHAR) AS valuation_date, {M('peak')} AS peak_nav, ROUND(drawdown, 8) AS drawdown, ROUND(MIN(drawdown) OVER (PARTITION BY portfolio_id ORDER BY valuation_date ROWS UNBOUNDED PRECEDING), 8) AS max_drawdown FROM d"
)
def drawdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.drawdown(_metrics(spark, sf_dir)).select("portfolio_id", F.col("valuation_date").cast("string").alias("valuation_date"), shown(F.col("peak_nav")).alias("peak_nav"), F.round("drawdown", 8).alias("drawdown"), F.round("max_drawdown", 8).alias("max_drawdown"))
