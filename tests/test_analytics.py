import datetime as dt
import hashlib
import math
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from riskloom.operators import positions as P
from riskloom.operators import risk as R
from riskloom.operators import serving as S
from riskloom.operators.calendar import calendar_checks, session_pairs, trading_calendar
from riskloom.sources.synthetic import price_paths


def d(n):
    return dt.date(2016, 1, 4) + dt.timedelta(days=n)


def test_discrete_var_ranks(spark):
    rows = [("r", d(k), Decimal((k * 37) % 251)) for k in range(251)]
    got = {str(r.confidence_level): r for r in R.discrete_var(spark.createDataFrame(rows, "run_id string, scenario_date date, loss decimal(38,18)")).collect()}
    assert (got["0.95"].var_rank, got["0.99"].var_rank) == (239, 249) == (math.ceil(0.95 * 251), math.ceil(0.99 * 251))
    assert int(got["0.95"].var_amount) == 238 and int(got["0.99"].var_amount) == 248


def test_ties_go_to_the_earlier_date_and_gains_are_not_clipped(spark):
    rows = [("r", d(k), Decimal(-5)) for k in range(10)]
    got = R.discrete_var(spark.createDataFrame(rows, "run_id string, scenario_date date, loss decimal(38,18)"), (0.5,)).first()
    assert got.scenario_date == d(4) and got.var_amount == -5


def test_history_components_and_stress(spark):
    prices = [("A", d(k), Decimal(100 + k)) for k in range(5)] + [("B", d(k), Decimal(50 - k)) for k in range(5)]
    returns = R.adjusted_returns(spark.createDataFrame(prices, "instrument_id string, price_date date, adjusted_close_price decimal(20,8)"))
    exposures = spark.createDataFrame([("r", "A", Decimal(1000)), ("r", "B", Decimal(-500))], "run_id string, instrument_id string, market_value decimal(20,6)")
    history = R.historical_pnl(exposures, returns)
    first = history.where("observation = 1").first()
    ra, rb = (Decimal(101) / 100 - 1), (Decimal(49) / 50 - 1)
    assert abs(first.pnl - (1000 * ra - 500 * rb)) < Decimal("1e-8") and first.loss == -first.pnl and first.prior_date == d(0)
    parts = R.var_components(R.discrete_var(history), R.component_pnl(exposures, returns).drop("prior_date")).collect()
    assert len(parts) == 4 and all(r.reconciles for r in parts)
    shocks = spark.createDataFrame([("S", "A", Decimal("-0.1")), ("S", "B", Decimal("-0.1"))], "scenario_id string, instrument_id string, shock_ratio decimal(12,10)")
    got = R.stress(exposures, shocks, exposures.groupBy("run_id").agg(F.sum("market_value").alias("static_nav")))
    assert got.first().stress_pnl == Decimal(-50) and got.first().stressed_nav == Decimal(450) and got.first().shock_count == 2
    assert R.stress_reconciliation(got, got).first().is_match
    assert not R.stress_reconciliation(got, got.where("false")).first().is_match


def test_splits_and_carry_forward(spark):
    actions = [("A", d(2), "STOCK_SPLIT", 1, Decimal(2)), ("A", d(2), "STOCK_SPLIT", 2, Decimal("1.5")), ("A", d(4), "STOCK_SPLIT", 3, Decimal("0.5")), ("A", d(0), "STOCK_SPLIT", 4, Decimal(9)), ("A", d(3), "CASH_DIVIDEND", 5, None)]
    multipliers = P.split_multipliers(spark.createDataFrame(actions, "instrument_id string, effective_date date, action_type string, source_record_id int, split_ratio decimal(20,10)"))
    assert {r.position_date: r.split_multiplier for r in multipliers.collect()} == {d(0): 9, d(2): 3, d(4): Decimal("0.5")}
    inception = spark.createDataFrame([("p", "A", d(0), Decimal(10)), ("p", "B", d(1), Decimal(7))], "portfolio_id string, instrument_id string, position_date date, signed_quantity decimal(38,16)")
    sessions = spark.createDataFrame([(d(k),) for k in range(6)], "position_date date")
    got = {(r.instrument_id, r.position_date): (float(r.carried_quantity), r.basis) for r in P.carry_forward(inception, sessions, multipliers).collect()}
    assert [got["A", d(k)][0] for k in range(6)] == [10, 10, 30, 30, 15, 15] and got["A", d(0)][1] == "INCEPTION" and got["A", d(1)][1] == "CARRY_FORWARD"
    assert [got["B", d(k)][0] for k in range(1, 6)] == [7] * 5 and ("B", d(0)) not in got


def test_inception_and_cash_and_metrics(spark):
    q = P.inception_quantities(
        spark.createDataFrame([("p", "A", Decimal("-0.3"))], "portfolio_id string, instrument_id string, target_weight decimal(12,10)"),
        spark.createDataFrame([("p", Decimal(1000000))], "portfolio_id string, initial_nav decimal(18,2)"),
        spark.createDataFrame([("A", Decimal("48.5"))], "instrument_id string, close_price decimal(20,8)"),
    ).first()
    assert abs(float(q.signed_quantity) + 300000 / 48.5) < 1e-6
    flows = spark.createDataFrame([("p", d(k), Decimal(100), Decimal(k)) for k in range(4)], "portfolio_id string, cash_date date, initial_cash decimal(18,2), dividend_flow decimal(18,2)")
    cash = {r.cash_date: (int(r.opening_cash), int(r.closing_cash)) for r in P.cash_roll_forward(flows).collect()}
    assert cash == {d(0): (100, 100), d(1): (100, 101), d(2): (101, 103), d(3): (103, 106)}
    values = spark.createDataFrame([("p", d(0), Decimal(60)), ("p", d(0), Decimal(-20)), ("p", d(1), Decimal(70)), ("p", d(1), Decimal(-20))], "portfolio_id string, valuation_date date, signed_market_value decimal(20,6)")
    closing = spark.createDataFrame([("p", d(0), Decimal(60)), ("p", d(1), Decimal(60))], "portfolio_id string, valuation_date date, closing_cash decimal(20,6)")
    a, b = P.daily_metrics(values, closing, F.lit(100)).orderBy("valuation_date").collect()
    assert (a.nav, a.pnl, a.gross_value, a.net_value) == (100, 0, 80, 40) and (b.nav, b.pnl) == (110, 10) and b.daily_return == Decimal("0.1") and str(b.gross_ratio) == "0.818181818181818182"


def test_previous_complete_date(spark):
    rows = [(d(0), "a"), (d(0), "b"), (d(1), "a"), (d(2), "a"), (d(2), "b"), (d(3), "b")]
    got = {r.price_date: r.previous_complete_date for r in P.previous_complete_asof(spark.createDataFrame(rows, "price_date date, k string"), "k", 2).collect()}
    assert got == {d(0): None, d(1): d(0), d(2): d(0), d(3): d(2)}
    assert [(r.price_date, r.previous_date) for r in P.previous_complete(spark.createDataFrame(rows, "price_date date, k string"), "k", 2).collect()] == [(d(0), None), (d(2), d(0))]


def test_price_path_equals_decimal_arithmetic(spark):
    instruments = spark.createDataFrame([("I", "C", Decimal("123.45"))], "instrument_id string, cluster_id string, anchor_price decimal(20,8)")
    dates = spark.createDataFrame([(d(k), k) for k in range(1, 61)], "price_date date, date_index int")
    got = {r.price_date: r.close_price for r in price_paths(instruments, dates, "seed").collect()}
    bp = lambda label, m: int(hashlib.sha256(f"seed|{label}".encode()).hexdigest()[:8], 16) % (2 * m + 1) - m
    p = Decimal("123.45")
    for k in range(1, 61):
        day = d(k).isoformat()
        total = 0 if k % 29 == 0 else bp(f"MARKET|{day}", 120) + bp(f"CLUSTER|C|{day}", 55) + bp(f"INSTRUMENT|I|{day}", 35)
        p = (p * (10000 + total) / 10000).quantize(Decimal("1e-8"), ROUND_HALF_UP)
        assert got[d(k)] == p


def test_calendar(spark):
    calendar = trading_calendar(spark, "2016-01-01", "2016-12-31", ["XNYS", "XNAS"], {"2016-01-01": "New Year's Day", "2016-11-24": "Thanksgiving"}, ["2016-11-25"])
    rows = {r.calendar_date.isoformat(): r for r in calendar.where("exchange_mic = 'XNYS'").collect()}
    assert len(rows) == 366 and rows["2016-01-01"].holiday_name and not rows["2016-01-02"].is_trading_day
    assert rows["2016-01-04"].market_open_utc.isoformat() == "2016-01-04T14:30:00" and rows["2016-07-05"].market_open_utc.isoformat() == "2016-07-05T13:30:00"
    assert rows["2016-11-25"].market_close_utc.isoformat() == "2016-11-25T18:00:00"
    assert all(r.is_contiguous and r.has_right_durations and r.days == 366 and r.early_closes == 1 for r in calendar_checks(calendar).collect())
    pairs = {r.calendar_date.isoformat(): r.next_date.isoformat() for r in session_pairs(calendar.where("is_trading_day and exchange_mic = 'XNYS'")).collect()}
    assert pairs["2016-11-23"] == "2016-11-25" and pairs["2016-01-08"] == "2016-01-11"


def test_serving(spark):
    runs = spark.createDataFrame([("p", d(0), 1, "r1"), ("p", d(0), 2, "r2"), ("q", d(0), 1, "r3"), (None, d(0), 1, "r4")], "k string, day date, attempt int, run string")
    assert {r.k: r.run for r in S.latest_published(runs, ["k"], ["attempt", "run"], F.col("k").isNotNull()).collect()} == {"p": "r2", "q": "r3"}
    assert {r.run: (r.attempt_number, r.reprocess_of) for r in S.attempts(runs, ["k"], ["attempt"], "run").collect()}["r2"] == (2, "r1")
    assert tuple(S.key_checks(runs, ["k"], "v").first()) == ("v", 4, 2, 1, 1)
    facts = spark.createDataFrame([("p", d(0), 5), ("p", d(1), 7), ("p", d(1), 1), ("q", d(0), 2)], "k string, day date, v int")
    assert {r.k: r.nav for r in S.at_latest_date(facts, ["k"], "day", F.col("v"), "nav").collect()} == {"p": 8, "q": 2}
    assert {r.day: r.x for r in S.only_if_single(facts, ["day"], ["k"], F.col("v"), "x").collect()} == {d(0): None, d(1): 7}
    assert S.dim_date(facts.select(F.col("day").alias("d"))).count() == 2


def test_forty_doubling_splits_and_amounts_above_1e14(spark):
    actions = spark.createDataFrame([("A", d(1) + dt.timedelta(days=k), "STOCK_SPLIT", k, Decimal(2)) for k in range(40)], "instrument_id string, effective_date date, action_type string, source_record_id int, split_ratio decimal(20,10)")
    inception = spark.createDataFrame([("p", "A", d(0), Decimal("1.5"))], "portfolio_id string, instrument_id string, position_date date, signed_quantity decimal(38,16)")
    sessions = spark.range(41).selectExpr("date_add(date'" + d(0).isoformat() + "', cast(id as int)) as position_date")
    rows = P.carry_forward(inception, sessions, P.split_multipliers(actions)).orderBy("position_date").collect()
    assert [r.cumulative_split for r in rows] == [2**k for k in range(41)] and [r.carried_quantity for r in rows] == [Decimal("1.5") * 2**k for k in range(41)]
    lost = actions.withColumn("split_ratio", F.lit("9999999999").cast("decimal(20,10)"))
    assert P.carry_forward(inception, sessions, P.split_multipliers(lost)).orderBy("position_date").collect()[-1].carried_quantity is None
    values = spark.createDataFrame([("p", d(0), Decimal("9e20")), ("p", d(1), Decimal("9.9e20"))], "portfolio_id string, valuation_date date, signed_market_value decimal(38,6)")
    a, b = P.daily_metrics(values, spark.createDataFrame([], "portfolio_id string, valuation_date date, closing_cash decimal(20,6)")).orderBy("valuation_date").collect()
    assert (a.nav, b.pnl, b.position_count) == (Decimal("9e20"), Decimal("9e19"), 1)
    held = P.market_values(spark.createDataFrame([(Decimal(10**15), Decimal("123.45")), (Decimal(-3), Decimal("0.00000001"))], "signed_quantity decimal(38,16), close_price decimal(20,8)")).collect()
    assert [h.signed_market_value for h in held] == [Decimal("123450000000000000"), Decimal("-3e-8")] and [h.position_side for h in held] == ["LONG", "SHORT"]


def test_dividends_opening_cash_and_static_exposure(spark):
    positions = spark.createDataFrame([("p", "A", d(k), Decimal(q)) for k, q in ((0, 10), (1, 20), (2, 20))] + [("p", "B", d(k), Decimal(-4)) for k in range(3)], "portfolio_id string, instrument_id string, position_date date, signed_quantity decimal(38,16)")
    dividends = spark.createDataFrame([("A", d(1), Decimal("0.5")), ("A", d(1), Decimal("0.25")), ("B", d(2), Decimal(1)), ("A", d(0), Decimal(9))], "instrument_id string, effective_date date, dividend_amount_per_share decimal(20,8)")
    flows = {r.cash_date: (r.dividend_flow, r.dividend_positions) for r in P.dividend_flows(positions, dividends).collect()}
    assert flows == {d(0): (0, 1), d(1): (Decimal("7.5"), 1), d(2): (-4, 1)}  # the quantity before the day's split, none before inception
    navs = spark.createDataFrame([("p", Decimal(1000)), ("q", Decimal(5))], "portfolio_id string, initial_nav decimal(18,2)")
    values = spark.createDataFrame([("p", Decimal("990.25"))], "portfolio_id string, signed_market_value decimal(38,16)")
    assert {r.portfolio_id: r.initial_cash for r in P.opening_cash(navs, values).collect()} == {"p": Decimal("9.75"), "q": 5}
    frozen = spark.createDataFrame([("r", "A", Decimal(3)), ("r", "B", Decimal(-2)), ("r", "C", Decimal(1))], "run_id string, instrument_id string, signed_quantity decimal(38,16)")
    closes = spark.createDataFrame([("A", Decimal("1.5")), ("B", Decimal(10))], "instrument_id string, close_price decimal(20,8)")
    assert {r.instrument_id: r.market_value for r in R.static_exposures(frozen, closes).collect()} == {"A": Decimal("4.5"), "B": -20, "C": None}


def test_price_lineage(spark):
    prices = spark.createDataFrame([("A", d(k), f"h{k}") for k in range(2)], "instrument_id string, price_date date, record_hash string")
    rows = spark.createDataFrame([("A", d(1), d(0)), ("A", d(2), d(1))], "instrument_id string, scenario_date date, prior_date date")
    assert {r.scenario_date: (r.prior_price_hash, r.scenario_price_hash) for r in R.price_lineage(rows, prices).collect()} == {d(1): ("h0", "h1"), d(2): ("h1", None)}


def test_calendar_does_not_depend_on_the_session_zone(spark):
    at = lambda: {r.m for r in trading_calendar(spark, "2016-01-04", "2016-01-04", ["XNYS"], {}).select(F.unix_timestamp("market_open_utc").alias("m")).collect()}
    utc = at()
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        assert at() == utc == {1451917800}
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_continuous_var(spark):
    history = spark.createDataFrame([("r", d(0) + dt.timedelta(days=k), Decimal(k)) for k in range(30)] + [("s", d(0), Decimal(1))], "run_id string, scenario_date date, loss decimal(38,18)")
    navs = spark.createDataFrame([("r", Decimal(200))], "run_id string, static_nav decimal(38,6)")
    got = {(r.run_id, r.confidence_level): (r.observations, r.var_amount, r.var_share) for r in R.continuous_var(history, navs, window=21, least=20).collect()}
    assert got["s", 0.95] == (1, None, None) and got["r", 0.95] == (21, 28.0, 0.14) and abs(got["r", 0.99][1] - 28.8) < 1e-9
