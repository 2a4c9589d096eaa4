"""The rules of derived data on the driver's tables, with faults put into some rows, and the serving views of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.expr import AMOUNT, QUANTITY, shown
from riskloom.operators import positions as P
from riskloom.operators import risk as R
from riskloom.operators import serving as S
from riskloom.plans import derived_rules as DR
from riskloom.plans import driver_tables as T
from riskloom.plans import risk_queries as Q
from riskloom.plans.catalog import query

M = T.money


def _texts(df: DataFrame, *dates: str) -> DataFrame:
    return df.withColumns({d: F.col(d).cast("string") for d in dates})


def _rules(rows: str, keys: str, rules: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, '{n}' AS rule_id FROM {rows} WHERE {c}" for n, c in rules)


# ---- positions ------------------------------------------------------------------------------------------------------
# faults by instrument and day: wrong, zero and turned quantities, lost days, a day that is no session, unknown references, hashes

@query(
    f"""WITH {Q._CARRIED}, sess AS (SELECT d, LAG(d) OVER (ORDER BY d) AS before FROM days WHERE day(d) <> 25), pays AS (SELECT DISTINCT instrument_id, d FROM acts WHERE event_type <> 'error'),
p0 AS (SELECT c.portfolio_id, c.instrument_id, c.position_date, c.inception_date, c.q, CAST(c.instrument_id AS INT) % 20 AS u, day(c.position_date) AS n, c.quantity, m.m FROM carried c LEFT JOIN multipliers m ON m.instrument_id = c.instrument_id AND m.d = c.position_date),
p AS (SELECT *, CASE WHEN u = 3 AND n = 10 THEN quantity + 1 WHEN u = 4 AND n = 12 THEN 0 WHEN u = 5 AND n = 15 THEN -quantity ELSE quantity END AS sq FROM p0 WHERE NOT (u = 6 AND n = 20)),
r AS (SELECT p.*, p.position_date = p.inception_date AS first, LAG(sq) OVER w AS prior, LAG(position_date) OVER w AS prior_date, CAST(q AS DECIMAL(38,16)) + CASE WHEN u = 8 THEN 1 ELSE 0 END AS expected, sess.d IS NOT NULL AS is_session, sess.before, pays.d IS NOT NULL AS pays
FROM p LEFT JOIN sess ON sess.d = p.position_date LEFT JOIN pays ON pays.instrument_id = p.instrument_id AND pays.d = p.position_date WINDOW w AS (PARTITION BY p.portfolio_id, p.instrument_id ORDER BY position_date)),
e AS (SELECT *, CAST(CAST(prior AS DECIMAL(20,8)) * CAST(COALESCE(m, 1) AS DECIMAL(17,8)) AS DECIMAL(38,16)) AS moved FROM r) """
    + _rules(
        "e",
        "portfolio_id, instrument_id, CAST(position_date AS VARCHAR) AS position_date",
        [
            ("POSITION_REFERENCES_VALID", "portfolio_id = 'error' OR u = 9"),
            ("POSITION_VALID_SESSION", "NOT is_session"),
            ("POSITION_DATE_SEQUENCE", "NOT first AND prior_date IS NOT NULL AND prior_date IS DISTINCT FROM before"),
            ("POSITION_INPUT_COVERAGE", "NOT first AND prior IS NULL"),
            ("POSITION_NONZERO_QUANTITY", "sq = 0"),
            ("POSITION_STRATEGY_SIGN", "(portfolio_id NOT IN ('error', 'view') AND sq < 0) OR sign(sq) <> sign(expected)"),
            ("POSITION_INCEPTION_RECONCILIATION", "first AND (sq <> expected OR prior IS NOT NULL)"),
            ("POSITION_BUY_AND_HOLD_CONTINUITY", "NOT first AND m IS NULL AND prior IS NOT NULL AND sq <> prior"),
            ("POSITION_SPLIT_RECONCILIATION", "NOT first AND m IS NOT NULL AND prior IS NOT NULL AND sq <> moved"),
            ("POSITION_DIVIDEND_QUANTITY_UNCHANGED", "NOT first AND pays AND prior IS NOT NULL AND sq <> moved"),
            ("POSITION_RECORD_HASH_VALID", "u = 7 AND n = 5"),
        ],
    )
)
def position_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = Q._actions(spark, sf_dir)
    multipliers = P.split_multipliers(actions)
    carried = Q._carried(spark, sf_dir)
    u, n = F.col("instrument_id").cast("int") % 20, F.day("position_date")
    q = F.col("carried_quantity")
    rows = carried.where(~((u == 6) & (n == 20))).join(multipliers.select("instrument_id", "position_date", F.lit(True).alias("splits")), ["instrument_id", "position_date"], "left")
    rows = rows.select(
        "portfolio_id",
        "instrument_id",
        "position_date",
        F.when((u == 3) & (n == 10), (q + 1).cast(QUANTITY)).when((u == 4) & (n == 12), F.lit(0).cast(QUANTITY)).when((u == 5) & (n == 15), -q).otherwise(q).alias("signed_quantity"),
        F.when(F.col("basis") == "INCEPTION", "INITIAL_ALLOCATION").when(F.col("splits"), "SPLIT_ADJUSTED_CARRY_FORWARD").otherwise("BUY_AND_HOLD_CARRY_FORWARD").alias("basis"),
        F.lit("x").alias("record_hash"),
        F.when((u == 7) & (n == 5), "y").otherwise("x").alias("computed_hash"),
    )
    inception = carried.where("basis = 'INCEPTION'").select("portfolio_id", "instrument_id", (F.col("signed_quantity") + F.when(u == 8, 1).otherwise(0)).cast("decimal(38,16)").alias("expected_quantity"))
    sessions = T.table(spark, sf_dir, "events").select(F.col("ts").cast("date").alias("position_date")).distinct().where(F.day("position_date") != 25)
    dividends = actions.where("dividend_amount_per_share is not null").select("instrument_id", F.col("effective_date").alias("position_date"))
    portfolios = carried.select("portfolio_id").distinct().where("portfolio_id <> 'error'").withColumn("strategy_code", F.when(F.col("portfolio_id") == "view", "LONG_SHORT_130_30").otherwise("LONG_ONLY"))
    instruments = carried.select("instrument_id").distinct().where(u != 9)
    found = DR.position_violations(rows, sessions, multipliers, dividends, portfolios, instruments, inception)
    return _texts(found.select("portfolio_id", "instrument_id", "position_date", "rule_id"), "position_date")


# ---- cash -----------------------------------------------------------------------------------------------------------

_CASH_FLOWS = f"""{Q._CARRIED}, paid AS (SELECT instrument_id, d, SUM(CAST(v * 0.01 AS DECIMAL(18,8))) AS dps FROM acts WHERE event_type <> 'error' GROUP BY 1, 2),
prior AS (SELECT *, LAG(quantity) OVER (PARTITION BY portfolio_id, instrument_id ORDER BY position_date) AS pq FROM carried),
flows AS (SELECT portfolio_id, position_date AS cash_date, CAST(SUM(COALESCE(CAST(pq AS DECIMAL(20,8)) * CAST(dps AS DECIMAL(17,8)), 0)) AS DECIMAL(32,6)) AS flow, COUNT(dps) AS actions FROM prior LEFT JOIN paid ON paid.instrument_id = prior.instrument_id AND paid.d = prior.position_date GROUP BY 1, 2),
rolled AS (SELECT *, 1000 + SUM(flow) OVER (PARTITION BY portfolio_id ORDER BY cash_date ROWS UNBOUNDED PRECEDING) AS closing FROM flows)"""


@query(
    f"""WITH {_CASH_FLOWS}, sess AS (SELECT d, LAG(d) OVER (ORDER BY d) AS before FROM days),
c AS (SELECT portfolio_id, cash_date, day(cash_date) AS n, closing - flow + CASE WHEN day(cash_date) = 3 THEN 1 ELSE 0 END AS opening, flow + CASE WHEN day(cash_date) = 5 THEN 1 ELSE 0 END AS df, closing + CASE WHEN day(cash_date) = 7 THEN 1 ELSE 0 END AS cl, flow, actions, actions + CASE WHEN day(cash_date) = 11 THEN 1 ELSE 0 END AS ac FROM rolled WHERE day(cash_date) <> 13),
e AS (SELECT c.*, LAG(cl) OVER w AS pc, LAG(cash_date) OVER w AS pd, before FROM c JOIN sess ON sess.d = cash_date WINDOW w AS (PARTITION BY portfolio_id ORDER BY cash_date)) """
    + _rules(
        "e",
        "portfolio_id, CAST(cash_date AS VARCHAR) AS cash_date",
        [
            ("CASH_BALANCE_BASE_CURRENCY_MATCH", "n = 9"),
            ("CASH_BALANCE_DATE_SEQUENCE", "pd IS NOT NULL AND pd IS DISTINCT FROM before"),
            ("CASH_BALANCE_INCEPTION_RECONCILIATION", "pd IS NULL AND opening <> 1000 + CASE WHEN portfolio_id = 'view' THEN 5 ELSE 0 END"),
            ("CASH_BALANCE_OPENING_CONTINUITY", "pd IS NOT NULL AND opening <> pc"),
            ("CASH_BALANCE_DIVIDEND_RECONCILIATION", "df <> flow"),
            ("CASH_BALANCE_CLOSING_RECONCILIATION", "cl <> opening + df"),
            ("CASH_BALANCE_ACTION_COUNT_CONSISTENT", "ac <> actions"),
            ("CASH_BALANCE_RECORD_HASH_VALID", "n = 15"),
        ],
    )
)
def cash_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    positions = Q._carried(spark, sf_dir).select("portfolio_id", "instrument_id", "position_date", F.col("carried_quantity").alias("signed_quantity"))
    flows = P.dividend_flows(positions, Q._actions(spark, sf_dir).where("dividend_amount_per_share is not null"))
    n = F.day("cash_date")
    plus = lambda c, day: (F.col(c) + F.when(n == day, 1).otherwise(0)).cast(AMOUNT)
    rolled = P.cash_roll_forward(flows.withColumn("initial_cash", F.lit(1000).cast(AMOUNT))).where(n != 13)
    rows = rolled.select(
        "portfolio_id",
        "cash_date",
        F.when(n == 9, "EUR").otherwise("USD").alias("base_currency"),
        plus("opening_cash", 3).alias("opening_cash"),
        plus("dividend_flow", 5).alias("dividend_flow"),
        plus("closing_cash", 7).alias("closing_cash"),
        (F.col("dividend_positions") + F.when(n == 11, 1).otherwise(0)).alias("action_count"),
        F.lit("x").alias("record_hash"),
        F.when(n == 15, "y").otherwise("x").alias("computed_hash"),
    )
    expected = flows.select("portfolio_id", "cash_date", F.col("dividend_flow").alias("expected_flow"), F.col("dividend_positions").alias("expected_actions"))
    names = flows.select("portfolio_id").distinct()
    initial = names.withColumn("initial_cash", (F.lit(1000) + F.when(F.col("portfolio_id") == "view", 5).otherwise(0)).cast(AMOUNT))
    found = DR.cash_violations(rows, expected, initial, names.withColumn("base_currency", F.lit("USD")), flows.select("cash_date"))
    return _texts(found.select("portfolio_id", "cash_date", "rule_id"), "cash_date")


# ---- market values --------------------------------------------------------------------------------------------------

@query(
    f"""WITH {T.VALUES}, closes AS (SELECT p_brand, MAX(CAST(p_retailprice AS DECIMAL(18,2))) AS close FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1),
v AS (SELECT portfolio_id, instrument_id, valuation_date, month(valuation_date) AS n, signed_quantity AS sq, CAST(signed_quantity * COALESCE(close, 1) AS DECIMAL(38,16)) AS right_value, close FROM vals LEFT JOIN closes ON p_brand = instrument_id),
w AS (SELECT *, CASE WHEN n = 1 AND portfolio_id = 'BUILDING' THEN right_value + 1 ELSE right_value END AS mv, CASE WHEN n = 2 AND portfolio_id = 'BUILDING' THEN 0 ELSE ABS(right_value) END AS av, CASE WHEN n = 3 AND portfolio_id = 'BUILDING' THEN CASE WHEN sq >= 0 THEN 'SHORT' ELSE 'LONG' END ELSE CASE WHEN sq >= 0 THEN 'LONG' ELSE 'SHORT' END END AS side FROM v) """
    + _rules(
        "w",
        "portfolio_id, instrument_id, CAST(valuation_date AS VARCHAR) AS valuation_date",
        [
            ("POSITION_MARKET_VALUE_INPUT_COVERAGE", "close IS NULL"),
            ("POSITION_MARKET_VALUE_DATE_ALIGNMENT", "n = 4 AND portfolio_id = 'BUILDING'"),
            ("POSITION_MARKET_VALUE_CURRENCY_MATCH", "n = 5 AND portfolio_id = 'BUILDING' AND close IS NOT NULL"),
            ("POSITION_MARKET_VALUE_FORMULA_RECONCILES", "close IS NOT NULL AND mv <> right_value"),
            ("POSITION_MARKET_VALUE_ABSOLUTE_RECONCILES", "av <> ABS(mv)"),
            ("POSITION_MARKET_VALUE_SIGN_RECONCILES", "(side = 'LONG' AND mv < 0) OR (side = 'SHORT' AND mv > 0)"),
            ("POSITION_MARKET_VALUE_RECORD_HASH_VALID", "n = 6 AND portfolio_id = 'BUILDING'"),
        ],
    )
)
def market_value_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = T.position_values(spark, sf_dir).drop("signed_market_value")
    closes = T.table(spark, sf_dir, "part").where("p_brand <> 'Brand#11'").groupBy(F.col("p_brand").alias("instrument_id")).agg(F.max(F.col("p_retailprice").cast("decimal(18,2)")).alias("close_price"))
    rows = P.market_values(values.join(closes, "instrument_id", "left").withColumn("close_price", F.coalesce("close_price", F.lit(1).cast("decimal(18,2)"))))
    at = lambda month: (F.month("valuation_date") == month) & (F.col("portfolio_id") == "BUILDING")
    v, flipped = F.col("signed_market_value"), F.when(F.col("position_side") == "LONG", "SHORT").otherwise("LONG")
    rows = rows.select(
        "portfolio_id",
        "instrument_id",
        "valuation_date",
        F.when(at(4), F.date_add("valuation_date", 1)).otherwise(F.col("valuation_date")).alias("price_date"),
        F.when(at(5), "EUR").otherwise("USD").alias("currency"),
        F.when(at(1), v + 1).otherwise(v).cast("decimal(38,16)").alias("signed_market_value"),
        F.when(at(2), F.lit(0)).otherwise(F.col("absolute_market_value")).cast("decimal(38,16)").alias("absolute_market_value"),
        F.when(at(3), flipped).otherwise(F.col("position_side")).alias("position_side"),
        F.lit("x").alias("record_hash"),
        F.when(at(6), "y").otherwise("x").alias("computed_hash"),
    )
    dates = values.select("valuation_date").distinct()
    priced = closes.join(dates, F.lit(True)).withColumn("quote_currency", F.lit("USD"))  # brands by month-ends
    found = DR.market_value_violations(rows, values, priced)
    return _texts(found.select("portfolio_id", "instrument_id", "valuation_date", "rule_id"), "valuation_date")


# ---- daily metrics --------------------------------------------------------------------------------------------------


@query(
    f"""{T.METRICS}, lagged AS (SELECT *, CASE WHEN month(valuation_date) = 1 THEN nav + 1 ELSE nav END AS n_nav FROM metrics),
f AS (SELECT *, month(valuation_date) AS n, LAG(n_nav) OVER (PARTITION BY portfolio_id ORDER BY valuation_date) AS pn FROM lagged),
g AS (SELECT *, CASE WHEN n = 2 THEN baseline + 1 ELSE baseline END AS n_base, CASE WHEN n = 3 THEN pnl + 1 ELSE pnl END AS n_pnl FROM f) """
    + _rules(
        "g",
        "portfolio_id, CAST(valuation_date AS VARCHAR) AS valuation_date",
        [
            ("PORTFOLIO_DAILY_CURRENCY_MATCH", "n = 4"),
            ("PORTFOLIO_DAILY_POSITION_COUNTS_RECONCILE", "n = 5"),
            ("PORTFOLIO_DAILY_MARKET_VALUES_RECONCILE", "n = 6"),
            ("PORTFOLIO_DAILY_NAV_RECONCILES", "n_nav <> net_value + cash"),
            ("PORTFOLIO_DAILY_NAV_POSITIVE", "n_nav <= 0"),
            ("PORTFOLIO_DAILY_BASELINE_RECONCILES", "n_base <> COALESCE(pn, n_nav)"),
            ("PORTFOLIO_DAILY_PNL_RECONCILES", "n_pnl <> n_nav - n_base"),
            ("PORTFOLIO_DAILY_RETURN_RECONCILES", "n = 7 OR (n IN (2, 3) AND n_base > 0 AND (n_pnl <> pnl OR (n_base <> baseline AND n_pnl <> 0)))"),
            ("PORTFOLIO_DAILY_RECORD_HASH_VALID", "n = 9"),
        ],
    )
)
def daily_metric_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All but the exposure ratios, whose eighteen digits SQL lacks (tests cover them)."""
    n = F.month("valuation_date")
    plus = lambda c, month: (F.col(c) + F.when(n == month, 1).otherwise(0)).cast(AMOUNT)
    rows = Q._metrics(spark, sf_dir).withColumns(
        {
            "nav": plus("nav", 1),
            "baseline": plus("baseline", 2),
            "pnl": plus("pnl", 3),
            "base_currency": F.when(n == 4, "EUR").otherwise("USD"),
            "position_count": F.col("position_count") + F.when(n == 5, 1).otherwise(0),
            "gross_value": plus("gross_value", 6),
            "daily_return": (F.col("daily_return").cast("decimal(30,18)") + F.when(n == 7, 1).otherwise(0)).cast("decimal(38,18)"),
            "record_hash": F.lit("x"),
            "computed_hash": F.when(n == 9, "y").otherwise("x"),
        }
    )
    values = T.position_values(spark, sf_dir)
    dates = values.select("portfolio_id", "valuation_date").distinct()
    cash = dates.join(T.segment_cash(spark, sf_dir), "portfolio_id")
    initial = dates.select("portfolio_id").distinct().withColumns({"initial_nav": F.lit(None).cast(AMOUNT), "base_currency": F.lit("USD")})
    found = DR.daily_metric_violations(rows, values, cash, initial)
    return _texts(found.where("rule_id <> 'PORTFOLIO_DAILY_EXPOSURE_RATIOS_RECONCILE'").select("portfolio_id", "valuation_date", "rule_id"), "valuation_date")


# ---- risk -----------------------------------------------------------------------------------------------------------

_RISK = f"{T.RISK}, {T.MEASURES}, {Q._SHOCKS}"


@query(
    f"""{_RISK}, approved AS (SELECT COUNT(DISTINCT instrument_id) AS held, run_id FROM exposures GROUP BY 2), dates AS (SELECT run_id, COUNT(*) AS n FROM scenarios GROUP BY 1)
SELECT run_id, CAST(scenario_date AS VARCHAR) AS item, 'HISTORICAL_PNL_SCENARIO_FORMULA_RECONCILES' AS rule_id FROM scenarios WHERE day(scenario_date) = 10
UNION ALL SELECT run_id, CAST(CAST(level AS DECIMAL(3,2)) AS VARCHAR), 'VAR_MEASURE_DISCRETE_QUANTILE_RECONCILES' FROM measures WHERE run_id = 'BUILDING'
UNION ALL SELECT run_id, CAST(CAST(level AS DECIMAL(3,2)) AS VARCHAR), 'VAR_MEASURE_AMOUNT_RECONCILES' FROM measures WHERE run_id = 'MACHINERY'
UNION ALL SELECT run_id, scenario_id, 'STRESS_RESULT_SHOCK_COVERAGE_VALID' FROM stressed WHERE run_id = 'FURNITURE' AND scenario_id = 'TECH'
UNION ALL SELECT run_id, scenario_id, 'STRESS_RESULT_FORMULA_RECONCILES' FROM stressed WHERE run_id = 'AUTOMOBILE' AND scenario_id = 'SUPPLY'
UNION ALL SELECT run_id, '', 'STRESS_RESULT_APPROVED_SCENARIO_SET_COMPLETE' FROM approved
UNION ALL SELECT run_id, '', 'HISTORICAL_PNL_SCENARIO_COUNT_COMPLETE' FROM dates WHERE n <> 29 UNION ALL SELECT run_id, '', 'RISK_RUN_STATIC_EXPOSURE_INSTRUMENT_COVERAGE' FROM approved WHERE held <> 5"""
)
def risk_rule_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    exposures, returns, scenarios = Q._scenarios(spark, sf_dir)
    run = F.col("run_id")
    wrong = scenarios.withColumn("pnl", F.col("pnl") + F.when(F.day("scenario_date") == 10, 1).otherwise(0))
    measures = R.discrete_var(scenarios).withColumn("var_rank", (F.col("var_rank") + F.when(run == "BUILDING", 1).otherwise(0)).cast("int"))
    measures = measures.withColumn("var_amount", F.col("var_amount") + F.when(run == "MACHINERY", 1).otherwise(0)).drop("observations")
    results = Q._stress(spark, sf_dir).withColumn("shock_count", F.col("shock_count") + F.when((run == "FURNITURE") & (F.col("scenario_id") == "TECH"), 1).otherwise(0))
    results = results.withColumn("stress_pnl", F.col("stress_pnl") + F.when((run == "AUTOMOBILE") & (F.col("scenario_id") == "SUPPLY"), 1).otherwise(0)).drop("static_nav")
    navs = exposures.groupBy("run_id").agg(F.sum("market_value").alias("static_nav"))
    found = DR.risk_violations(wrong, measures, results, R.component_pnl(exposures, returns).drop("prior_date"), exposures, Q._shocks(spark), navs, 29, 5, ("BROAD", "SUPPLY", "TECH", "WAR"))
    return found.select("run_id", "item", "rule_id")


# ---- static exposures, lineage, serving -----------------------------------------------------------------------------


@query(f"WITH {Q._CARRIED}, closes AS (SELECT instrument_id, MAX(v) AS close FROM acts WHERE d = (SELECT MAX(d) FROM acts) GROUP BY 1) SELECT portfolio_id AS run_id, carried.instrument_id, {M('CAST(CAST(quantity AS DECIMAL(20,8)) * close AS DECIMAL(23,6))')} AS market_value FROM carried LEFT JOIN closes ON closes.instrument_id = carried.instrument_id WHERE position_date = (SELECT MAX(d) FROM acts)")
def static_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities frozen at the last date, at that date's closes; instruments without one have no value."""
    events = T.table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("instrument_id"), F.col("ts").cast("date").alias("d"), F.col("value").cast("decimal(18,2)").alias("v"))
    last = events.agg(F.max("d").alias("last"))
    closes = events.join(F.broadcast(last), F.col("d") == F.col("last")).groupBy("instrument_id").agg(F.max("v").alias("close_price"))  # one row of last
    frozen = Q._carried(spark, sf_dir).join(F.broadcast(last), F.col("position_date") == F.col("last")).select(F.col("portfolio_id").alias("run_id"), "instrument_id", F.col("carried_quantity").alias("signed_quantity"))
    return R.static_exposures(frozen, closes).withColumn("market_value", shown(F.col("market_value")))


@query(f"WITH {T.PRICES}, {T.RETURNS}, h AS (SELECT *, sha256(concat_ws('|', instrument_id, CAST(price_date AS VARCHAR), CAST(close_price AS VARCHAR))) AS hash FROM prices) SELECT r.instrument_id, CAST(r.scenario_date AS VARCHAR) AS scenario_date, CAST(r.prior_date AS VARCHAR) AS prior_date, p.hash AS prior_price_hash, s.hash AS scenario_price_hash FROM returns r LEFT JOIN h p ON p.instrument_id = r.instrument_id AND p.price_date = r.prior_date LEFT JOIN h s ON s.instrument_id = r.instrument_id AND s.price_date = r.scenario_date")
def price_lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    from riskloom.functions.expr import record_hash

    prices = T.prices(spark, sf_dir)
    hashed = prices.withColumn("record_hash", record_hash(["instrument_id", "price_date", "close_price"]))
    return _texts(R.price_lineage(R.adjusted_returns(prices).drop("simple_return"), hashed), "scenario_date", "prior_date")


_SERVED = f"""{_RISK}, runs AS (SELECT o_orderkey AS attempt, c_mktsegment AS run_id, CAST(o_orderdate AS DATE) AS as_of_date, CASE WHEN o_orderstatus = 'P' THEN 'FAILED' ELSE 'SUCCEEDED' END AS status FROM orders JOIN customer ON o_custkey = c_custkey),
selected AS (SELECT * FROM runs WHERE status = 'SUCCEEDED' QUALIFY ROW_NUMBER() OVER (PARTITION BY run_id ORDER BY as_of_date DESC, attempt DESC) = 1)"""


def _selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = T.table(spark, sf_dir, "orders").join(T.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    runs = orders.select(F.col("o_orderkey").alias("attempt"), F.col("c_mktsegment").alias("run_id"), F.col("o_orderdate").cast("date").alias("as_of_date"), F.when(F.col("o_orderstatus") == "P", "FAILED").otherwise("SUCCEEDED").alias("status"))
    return S.latest_published(runs, ["run_id"], ["as_of_date", "attempt"], F.col("status") == "SUCCEEDED")


def _bundle(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    *_, scenarios = Q._scenarios(spark, sf_dir)
    runs = _selected(spark, sf_dir)
    return runs, S.bundle(runs, R.discrete_var(scenarios), Q._stress(spark, sf_dir).drop("static_nav"))


@query(f"{_SERVED} SELECT run_id, attempt, CAST(as_of_date AS VARCHAR) AS as_of_date, CAST(level AS DOUBLE) AS confidence_level, observations, loss_rank AS var_rank, {M('loss')} AS var_amount FROM selected JOIN measures USING (run_id)")
def served_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bundle(spark, sf_dir)[1]["var"]
    return _texts(rows.select("run_id", "attempt", "as_of_date", F.col("confidence_level").cast("double").alias("confidence_level"), "observations", F.col("var_rank").cast("bigint").alias("var_rank"), shown(F.col("var_amount")).alias("var_amount")), "as_of_date")


@query(f"{_SERVED} SELECT run_id, attempt, CAST(as_of_date AS VARCHAR) AS as_of_date, scenario_id, shock_count, {M('stress_pnl')} AS stress_pnl, {M('static_nav + stress_pnl')} AS stressed_nav FROM selected JOIN stressed USING (run_id) JOIN navs USING (run_id)")
def served_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _bundle(spark, sf_dir)[1]["stress"]
    return _texts(rows.select("run_id", "attempt", "as_of_date", "scenario_id", "shock_count", shown(F.col("stress_pnl")).alias("stress_pnl"), shown(F.col("stressed_nav")).alias("stressed_nav")), "as_of_date")


@query(f"{_SERVED}, a AS (SELECT run_id, COUNT(DISTINCT level) AS levels FROM measures GROUP BY 1), b AS (SELECT run_id, COUNT(DISTINCT scenario_id) AS scenarios FROM stressed WHERE run_id <> 'BUILDING' OR scenario_id <> 'TECH' GROUP BY 1) SELECT run_id, COALESCE(levels, 0) AS levels, COALESCE(scenarios, 0) AS scenarios, COALESCE(levels, 0) = 2 AND COALESCE(scenarios, 0) = 3 AS is_complete FROM selected LEFT JOIN a USING (run_id) LEFT JOIN b USING (run_id)")
def bundle_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one stress result missing, so that there is something to find."""
    runs, views = _bundle(spark, sf_dir)
    return S.bundle_completeness(runs, views["var"], views["stress"].where("run_id <> 'BUILDING' or scenario_id <> 'TECH'"), 2, 3)


@query(f"{_SERVED} SELECT run_id, CASE WHEN MIN(level) = MAX(level) THEN {M('MAX(loss)')} END AS var_amount FROM measures GROUP BY 1")
def var_if_one_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.only_if_single(_bundle(spark, sf_dir)[1]["var"], ["run_id"], ["confidence_level"], shown(F.col("var_amount")), "var_amount")


@query(f"{_SERVED} SELECT run_id, scenario_id, {M('stress_pnl')} AS stress_pnl FROM stressed")
def stress_if_one_scenario(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.only_if_single(_bundle(spark, sf_dir)[1]["stress"], ["run_id", "scenario_id"], ["scenario_id"], shown(F.col("stress_pnl")), "stress_pnl")


@query(f"{T.METRICS} SELECT CAST(valuation_date AS VARCHAR) AS valuation_date, {M('SUM(pnl)')} AS daily_pnl FROM metrics GROUP BY 1")
def daily_pnl_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Q._metrics(spark, sf_dir).groupBy("valuation_date").agg(shown(F.sum("pnl")).alias("daily_pnl"))
    return _texts(rows, "valuation_date")
