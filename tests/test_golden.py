"""A year of two portfolios with known daily values, Value at Risk and stress results."""

import datetime as dt
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from riskloom.operators import positions as P
from riskloom.operators import risk as R
from riskloom.sources.synthetic import price_paths

# Fixed values of the scenario: instrument, cluster, weights (long-only, long-short), close on the second day, shocks (technology, supply)
INSTRUMENTS = [
    ("NVDA_US", "TECH", "0.0950000000", "0.1482", 110, "-0.27", "-0.17"),
    ("AAPL_US", "TECH", "0.0950000000", "0.1482", 95, "-0.14", "-0.11"),
    ("GOOGL_US", "TECH", "0.0950000000", "0.1482", 102, "-0.16", "-0.07"),
    ("MSFT_US", "TECH", "0.0950000000", "0.1482", 100, "-0.13", "-0.06"),
    ("TSM_US", "SEMIS", "0.0600000000", "0.0936", 104, "-0.24", "-0.32"),
    ("AVGO_US", "SEMIS", "0.0600000000", "0.0936", 97, "-0.21", "-0.19"),
    ("AMZN_US", "CONSUMER", "0.0650000000", "0.1014", 101, "-0.11", "-0.09"),
    ("WMT_US", "CONSUMER", "0.0650000000", "-0.1", 98, "-0.02", "-0.06"),
    ("LLY_US", "HEALTHCARE", "0.0550000000", "0.0858", 106, "-0.04", "-0.03"),
    ("UNH_US", "HEALTHCARE", "0.0550000000", "-0.1", 96, "-0.05", "-0.05"),
    ("JPM_US", "FINANCIALS", "0.0600000000", "0.0936", 103, "-0.08", "-0.11"),
    ("BRK_B_US", "FINANCIALS", "0.0600000000", "0.0936", 99, "-0.04", "-0.08"),
    ("XOM_US", "MACRO", "0.0466666667", "0.0728", 105, "0.01", "0.16"),
    ("TSLA_US", "MACRO", "0.0466666667", "-0.1", 90, "-0.23", "-0.14"),
    ("LMT_US", "MACRO", "0.0466666666", "0.0728", 102, "-0.01", "0.13"),
]
PORTFOLIOS = ("CORE_15_LONG", "LONG_SHORT_130_30")
SEED = "MARKET_RISK_PHASE_07_2016_V1"
HOLIDAYS = {"2016-01-18", "2016-02-15", "2016-03-25", "2016-05-30", "2016-07-04", "2016-09-05", "2016-11-24", "2016-12-26"}
NAVS = {"CORE_15_LONG": [1000000, 1007499.999997, 1008149.999997, 1008149.999997], "LONG_SHORT_130_30": [1000000, 1040440, 1039440, 1039440]}
VAR = {("CORE_15_LONG", "0.95"): (11916.83394, "2016-12-30"), ("CORE_15_LONG", "0.99"): (14370.61983, "2016-11-23"), ("LONG_SHORT_130_30", "0.95"): (12858.56790, "2016-09-27"), ("LONG_SHORT_130_30", "0.99"): (16137.12296, "2016-11-23")}
STATIC_NAV = {"CORE_15_LONG": 1078738.331309, "LONG_SHORT_130_30": 1139993.764929}
STRESS = {
    ("CORE_15_LONG", "BROAD"): -107808.83313, ("CORE_15_LONG", "TECHNOLOGY"): -137808.46660, ("CORE_15_LONG", "SUPPLY"): -96452.35027,
    ("LONG_SHORT_130_30", "BROAD"): -114099.37649, ("LONG_SHORT_130_30", "TECHNOLOGY"): -163191.35369, ("LONG_SHORT_130_30", "SUPPLY"): -106194.81813,
}


def day(text):
    return dt.date.fromisoformat(text)


@pytest.fixture(scope="module")
def year(spark):
    """Raw and adjusted closes of 252 sessions."""
    first = ["2016-01-04", "2016-01-05", "2016-01-06", "2016-01-07"]
    rows = []
    for name, _, _, _, close, *_ in INSTRUMENTS:
        raw = [100, close, close, 55 if name == "NVDA_US" else close]
        adjusted = [100, close, 99 if name == "WMT_US" else close, {"NVDA_US": 110, "WMT_US": 99}.get(name, close)]
        rows += [(name, day(t), D(r), D(a)) for t, r, a in zip(first, raw, adjusted)]
    start = spark.createDataFrame(rows, "instrument_id string, price_date date, close_price decimal(20,8), adjusted_close_price decimal(20,8)")
    span = [day("2016-01-08") + dt.timedelta(days=k) for k in range(358)]
    sessions = [t for t in span if t.weekday() < 5 and t.isoformat() not in HOLIDAYS]
    assert len(sessions) == 248
    anchors = spark.createDataFrame([(n, c, D(55 if n == "NVDA_US" else m)) for n, c, _, _, m, *_ in INSTRUMENTS], "instrument_id string, cluster_id string, anchor_price decimal(20,8)")
    dates = spark.createDataFrame(list(zip(sessions, range(1, 249))), "price_date date, date_index int")
    paths = price_paths(anchors, dates, SEED)
    up, down = F.when(F.col("instrument_id") == "NVDA_US", 2).when(F.col("instrument_id") == "WMT_US", 99).otherwise(1), F.when(F.col("instrument_id") == "WMT_US", 98).otherwise(1)
    adjusted = F.round(F.col("close_price").cast("decimal(16,8)") * up / down, 8).cast("decimal(20,8)")
    return start.unionByName(paths.select("instrument_id", "price_date", "close_price", adjusted.alias("adjusted_close_price"))).cache()


def positions(spark, year):
    weights = spark.createDataFrame([(p, n, D(w)) for n, _, a, b, *_ in INSTRUMENTS for p, w in zip(PORTFOLIOS, (a, b))], "portfolio_id string, instrument_id string, target_weight decimal(12,10)")
    navs = spark.createDataFrame([(p, D(1000000)) for p in PORTFOLIOS], "portfolio_id string, initial_nav decimal(18,2)")
    closes = year.where("price_date = '2016-01-04'").select("instrument_id", "close_price")
    inception = P.inception_quantities(weights, navs, closes).select("portfolio_id", "instrument_id", F.lit("2016-01-04").cast("date").alias("position_date"), "signed_quantity")
    split = spark.createDataFrame([("NVDA_US", day("2016-01-07"), "STOCK_SPLIT", "1", D(2))], "instrument_id string, effective_date date, action_type string, source_record_id string, split_ratio decimal(20,10)")
    held = P.carry_forward(inception, year.select(F.col("price_date").alias("position_date")).distinct(), P.split_multipliers(split))
    return held.select("portfolio_id", "instrument_id", F.col("position_date").alias("valuation_date"), F.col("carried_quantity").alias("signed_quantity"))


def valued(spark, year):
    prices = year.select("instrument_id", F.col("price_date").alias("valuation_date"), "close_price")
    return P.market_values(positions(spark, year).join(prices, ["instrument_id", "valuation_date"])).cache()


def test_daily_values(spark, year):
    values = valued(spark, year)
    held = positions(spark, year).where("instrument_id = 'WMT_US' and valuation_date = '2016-01-05'")
    paid = held.select("portfolio_id", F.lit("2016-01-06").cast("date").alias("cash_date"), F.col("signed_quantity").alias("paid"))
    flows = values.select("portfolio_id", F.col("valuation_date").alias("cash_date")).distinct().join(paid, ["portfolio_id", "cash_date"], "left")
    cash = P.cash_roll_forward(flows.select("portfolio_id", "cash_date", F.lit(0).cast("decimal(18,2)").alias("initial_cash"), F.coalesce("paid", F.lit(0)).cast("decimal(20,6)").alias("dividend_flow")))
    metrics = P.daily_metrics(values, cash.select("portfolio_id", F.col("cash_date").alias("valuation_date"), "closing_cash"), F.lit(1000000))
    for p in PORTFOLIOS:
        rows = metrics.where((F.col("portfolio_id") == p) & (F.col("valuation_date") <= "2016-01-07")).orderBy("valuation_date").collect()
        assert [float(r.nav) for r in rows] == pytest.approx(NAVS[p], abs=1e-6)
        assert [r.position_count for r in rows] == [15] * 4


def test_var_and_stress(spark, year):
    last = valued(spark, year).where("valuation_date = '2016-12-30'").select(F.col("portfolio_id").alias("run_id"), "instrument_id", F.col("signed_market_value").cast("decimal(20,6)").alias("market_value"))
    history = R.historical_pnl(last, R.adjusted_returns(year))
    got = {(r.run_id, str(r.confidence_level)): r for r in R.discrete_var(history).collect()}
    assert {k: r.scenario_date.isoformat() for k, r in got.items()} == {k: v[1] for k, v in VAR.items()}
    assert {k: float(r.var_amount) for k, r in got.items()} == pytest.approx({k: v[0] for k, v in VAR.items()}, abs=1e-3)
    assert {r.observations for r in got.values()} == {251} and {r.var_rank for r in got.values()} == {239, 249}
    shocks = spark.createDataFrame([(s, n, D(x)) for n, *_, tech, supply in INSTRUMENTS for s, x in (("BROAD", "-0.1"), ("TECHNOLOGY", tech), ("SUPPLY", supply))], "scenario_id string, instrument_id string, shock_ratio decimal(12,10)")
    cash = F.when(F.col("run_id") == "CORE_15_LONG", 650).otherwise(-1000)
    navs = last.groupBy("run_id").agg(F.sum("market_value").alias("v")).select("run_id", (F.col("v") + cash).alias("static_nav"))
    assert {r.run_id: float(r.static_nav) for r in navs.collect()} == pytest.approx(STATIC_NAV, abs=1e-4)
    results = {(r.run_id, r.scenario_id): r for r in R.stress(last, shocks, navs).collect()}
    assert {k: float(r.stress_pnl) for k, r in results.items()} == pytest.approx(STRESS, abs=1e-3)
    assert all(r.shock_count == 15 for r in results.values())
