from pyspark.sql import functions as F

from riskloom.operators import merge as G
from riskloom.operators import resolve as V
from riskloom.operators import snapshot_rules as K
from riskloom.operators.rules import QUARANTINE, REJECT, WARN, WARNING, Rule, judged, summarise, violations
from riskloom.plans.contracts import CONTRACTS
from riskloom.plans import domain_rules as D


def test_rules_in_one_scan(spark):
    df = spark.createDataFrame([(1, 5), (2, -1), (3, None), (4, 100)], "id int, v int")
    rules = [Rule("POSITIVE", F.col("v") <= 0), Rule("PRESENT", F.col("v").isNull(), disposition=QUARANTINE), Rule("LARGE", F.col("v") > 50, severity=WARNING, disposition=WARN, observed=("v",))]
    found = violations(df, rules, ["id"])
    assert sorted((r.id, r.rule_id) for r in found.collect()) == [(2, "POSITIVE"), (3, "PRESENT"), (4, "LARGE")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert {r.observed_value for r in found.where("id = 4").collect()} == {'{"v":"100"}'}
    got = {r.id: (r.violation_count, r.warning_count, r.has_reject, r.has_quarantine, r.has_error) for r in summarise(found, ["id"]).collect()}
    assert got == {2: (1, 0, True, False, True), 3: (1, 0, False, True, True), 4: (1, 1, False, False, False)}
    beside = {r.id: (r.violation_count, r.warning_count, r.has_reject, r.has_quarantine, r.has_error) for r in judged(df, rules).collect()}
    assert beside == got | {1: (0, 0, False, False, False)}


def test_batch_and_correction_violations(spark):
    rows = spark.createDataFrame([(1, "k", "a"), (2, "k", "a"), (3, "l", "a"), (4, "l", "b")], "row int, k string, h string")
    found = V.batch_violations(V.same_batch_market(rows, ["k"], "h", ["row"]), ["row"], "PRICE", QUARANTINE)
    assert sorted((r.row, r.rule_id, r.disposition) for r in found.collect()) == [(2, "PRICE_SAME_BATCH_IDENTICAL_DUPLICATE", "DEDUPLICATE"), (3, "PRICE_SAME_BATCH_CONFLICT", QUARANTINE), (4, "PRICE_SAME_BATCH_CONFLICT", QUARANTINE)]
    found = V.batch_violations(V.same_batch_versioned(rows, F.col("k"), "row", "h", ["row"]), ["row"], "PORTFOLIO", REJECT)
    assert sorted((r.row, r.disposition) for r in found.collect()) == [(2, "DEDUPLICATE"), (3, REJECT), (4, REJECT)]
    compared = V.compare_versioned(spark.createDataFrame([("a", "h", "1.0.0")], "k string, h string, v string"), spark.createDataFrame([("a", "g", "1.0.0")], "k string, h string, v string"), ["k"], "h", "v")
    assert [(r.rule_id, r.observed_value) for r in V.correction_violations(compared, ["k"], "PORTFOLIO", "v").collect()] == [("PORTFOLIO_INVALID_CORRECTION", '{"v":"1.0.0","current_version":"1.0.0"}')]


def test_market_evidence_and_outcomes(spark):
    rows = [(1, "k1", "a"), (2, "k1", "a"), (3, "k2", "a"), (4, "k2", "b"), (5, "k3", "n"), (6, "k4", "c"), (7, None, "x"), (8, None, "x")]
    df = V.same_batch_market(spark.createDataFrame(rows, "row int, k string, h string"), ["k"], "h", ["row"])
    current = spark.createDataFrame([("k1", "a"), ("k4", "old")], "k string, h string")
    out = V.compare_market(df, current, ["k"], "h").withColumn("outcome", V.outcome_market(F.lit(False), F.col("is_conflict"), F.col("is_duplicate"), F.col("comparison")))
    got = {r.row: r.outcome for r in out.collect()}
    assert got == {1: "UNCHANGED", 2: "DEDUPLICATED", 3: "QUARANTINED", 4: "QUARANTINED", 5: "ACCEPTED_NEW", 6: "ACCEPTED_CORRECTION", 7: "ACCEPTED_NEW", 8: "DEDUPLICATED"}
    counts = V.conservation(out)
    row = V.publication(counts).first()
    assert row.is_conserved and row.evaluated == 8 and row.status == "FAILED" and not row.published
    assert V.publication(V.conservation(out.where("row in (1, 2, 5)"))).first().status == "SUCCEEDED_WITH_WARNINGS"
    assert V.publication(V.conservation(out.where("row in (5, 6)"))).first().published


def test_versioned_evidence_and_outcomes(spark):
    rows = [(1, "a", "h1", "1.0.0"), (2, "b", "h", "1.0.0"), (3, "b", "g", "1.0.0"), (4, "c", "new", "1.10.0"), (5, "d", "new", "1.1.0"), (6, None, "z", "1.0.0"), (7, None, "z", "1.0.0"), (8, "e", "s", "1.0.0"), (9, "e", "s", "1.0.0")]
    df = V.same_batch_versioned(spark.createDataFrame(rows, "row int, k string, h string, v string"), F.col("k"), "row", "h", ["row"])
    current = spark.createDataFrame([("a", "h1", "1.0.0"), ("c", "old", "1.9.0"), ("d", "old", "1.1.0")], "k string, h string, v string")
    out = V.compare_versioned(df, current, ["k"], "h", "v")
    got = {r.row: r.o for r in out.select("row", V.outcome_versioned(F.lit(False), F.col("is_conflict"), F.col("is_duplicate"), F.col("comparison")).alias("o")).collect()}
    assert got == {1: "UNCHANGED", 2: "REJECTED", 3: "REJECTED", 4: "ACCEPTED_CORRECTION", 5: "REJECTED", 6: "ACCEPTED_NEW", 7: "ACCEPTED_NEW", 8: "ACCEPTED_NEW", 9: "DEDUPLICATED"}


def test_merges(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    s = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(G.upsert(t, s, ["k"])) == [(1, "a"), (2, "B"), (3, "C")] == rows(G.upsert(G.upsert(t, s, ["k"]), s, ["k"]))
    assert rows(G.insert_only(t, s, ["k"])) == [(1, "a"), (2, "b"), (3, "C")]
    assert rows(G.replace_partition(t, s.where("k = 3"), F.col("k") == 2)) == [(1, "a"), (3, "C")]
    state, actions = G.conditional_upsert(t, s.unionByName(t.where("k = 1")), ["k"], "v")
    assert rows(state) == [(1, "a"), (2, "B"), (3, "C")] and {r.k: r.action for r in actions.collect()} == {1: "UNCHANGED", 2: "UPDATE", 3: "INSERT"}
    assert tuple(G.bag_difference(t.unionByName(t), t).first()) == (2, 0, False)


def test_snapshot_rules(spark):
    df = spark.createDataFrame([("p", "i1", "2020-01-01", "2020-06-01", 0.6), ("p", "i1", "2020-05-01", None, 0.4)], "portfolio_id string, instrument_id string, s string, e string, target_weight double")
    assert K.failures(K.key_unique(df, "KEY", ["portfolio_id", "instrument_id"]), K.row_count(df, "COUNT", 2), K.ranges_disjoint(df, "RANGES", ["instrument_id"], "s", "e"), K.totals(df, "TOTALS", 1.0, 0.0), K.complete_grid(df, "GRID", "s", "instrument_id", 1)) == ["KEY", "RANGES"]
    assert K.failures(K.contained(df, df.limit(1), "IN")) == ["IN"]


def portfolios(spark, **changes):
    row = {"portfolio_id": "CORE_LONG", "portfolio_name": "Core", "strategy_code": "LONG_ONLY", "base_currency": "USD", "target_inception_date": "2016-01-04", "actual_inception_date": "2016-01-04", "initial_nav": "1000000.00", "target_long_ratio": "1", "target_short_ratio": "0", "target_gross_ratio": "1", "target_net_ratio": "1", "rebalance_policy": "BUY_AND_HOLD", "cash_policy": "RETAIN_DIVIDENDS_NO_INTEREST", "is_active": "true", "config_version": "1.0.0"} | changes
    contract = CONTRACTS["portfolios"]
    import hashlib

    row["record_hash"] = changes.get("record_hash") or hashlib.sha256("|".join("<NULL>" if row[f] is None else row[f] for f in contract.hash_fields).encode()).hexdigest()
    raw = spark.createDataFrame([tuple(row[f.name] for f in contract.fields)], contract.raw_schema())
    return sorted(r.rule_id for r in violations(contract.typed(raw), contract.rules() + D.portfolio_rules(), ["business_key"]).collect())


def test_portfolio_contract(spark):
    assert portfolios(spark) == []
    assert portfolios(spark, actual_inception_date="") == ["PORTFOLIO_ACTUAL_INCEPTION_DATE_MISSING"]
    assert portfolios(spark, initial_nav="-1") == ["PORTFOLIO_INITIAL_NAV_POSITIVE"]
    assert portfolios(spark, initial_nav="x") == ["PORTFOLIO_REQUIRED_FIELDS", "PORTFOLIO_TYPES_CASTABLE"]
    assert portfolios(spark, portfolio_id="core") == ["PORTFOLIO_ID_FORMAT"]
    assert portfolios(spark, target_short_ratio="0.3") == ["PORTFOLIO_RATIO_RECONCILIATION", "PORTFOLIO_STRATEGY_TARGETS"]
    assert portfolios(spark, record_hash="0" * 64) == ["PORTFOLIO_RECORD_HASH_VALID"]
    assert portfolios(spark, config_version="1.0") == ["PORTFOLIO_CONFIG_VERSION_VALID"]
    assert portfolios(spark, cash_policy="PAY_OUT") == portfolios(spark, base_currency="EUR") == ["PORTFOLIO_ALLOWED_VALUES"]
    assert portfolios(spark, strategy_code="SHORT") == ["PORTFOLIO_ALLOWED_VALUES"]


def test_price_and_action_rules(spark):
    instruments = spark.createDataFrame([("A_US", "A", "USD", "XNYS", True)], "instrument_id string, yfinance_symbol string, quote_currency string, exchange_mic string, is_active boolean")
    days = spark.sql("select 'XNYS' as exchange_mic, date'2016-01-04' as calendar_date, true as is_trading_day")
    base = "cast('{i}' as string) instrument_id, date'{d}' price_date, 'YAHOO_FINANCE' source_id, 'A' source_symbol, {o} open_price, {h} high_price, {l} low_price, {c} close_price, {c} adjusted_close_price, {v} volume, '{y}' quote_currency, '1.0.0' contract_version"
    plain = {"i": "A_US", "d": "2016-01-04", "o": 10.0, "h": 11.0, "l": 9.0, "c": 10.5, "v": 5, "y": "USD"}

    def broken(**changes):
        rows = spark.sql("select " + base.format(**(plain | changes)))
        return sorted(r.rule_id for r in violations(D.enriched(rows, instruments, days, "price_date"), D.price_rules(), ["instrument_id"]).collect())

    assert broken() == []
    assert broken(h=10.0) == ["PRICE_OHLC_CONSISTENCY"] and broken(v=0) == ["PRICE_VOLUME_MISSING_OR_ZERO"] and broken(v=-1) == ["PRICE_VOLUME_NEGATIVE"]
    assert broken(d="2016-01-05") == ["PRICE_VALID_SESSION"] and broken(y="EUR") == ["PRICE_SUPPORTED_CURRENCY"]
    assert broken(i="B_US") == ["PRICE_INSTRUMENT_MAPPING", "PRICE_VALID_SESSION"] and broken(l=-1.0) == ["PRICE_POSITIVE_VALUES"]
    actions = spark.sql("select 'A_US' instrument_id, date'2016-01-04' effective_date, 'YAHOO_FINANCE' source_id, 'A' source_symbol, 'STOCK_SPLIT' action_type, cast(null as decimal(20,8)) dividend_amount_per_share, cast(null as string) dividend_currency, cast(1 as decimal(20,10)) split_ratio, '1.0.0' contract_version")
    assert [r.rule_id for r in violations(D.enriched(actions, instruments, days, "effective_date"), D.action_rules(), ["instrument_id"]).collect()] == ["ACTION_SPLIT_FIELDS"]


def test_rules_of_metrics_and_risk(spark):
    import datetime as dt
    from decimal import Decimal as X

    from riskloom.operators import positions as P
    from riskloom.operators import risk as R
    from riskloom.plans import derived_rules as DR

    day = lambda k: dt.date(2020, 1, 1) + dt.timedelta(days=k)
    values = spark.createDataFrame([("p", day(k), X(v)) for k, v in ((0, 70), (0, -30), (1, 80), (1, -20))], "portfolio_id string, valuation_date date, signed_market_value decimal(38,6)")
    cash = spark.createDataFrame([("p", day(0), X(60)), ("p", day(1), X(61))], "portfolio_id string, valuation_date date, closing_cash decimal(32,6)")
    initial = spark.createDataFrame([("p", None, "USD")], "portfolio_id string, initial_nav decimal(32,6), base_currency string")
    metrics = P.daily_metrics(values, cash).withColumns({"base_currency": F.lit("USD"), "record_hash": F.lit("x"), "computed_hash": F.lit("x")})
    broken = lambda df: sorted((r.valuation_date, r.rule_id) for r in DR.daily_metric_violations(df, values, cash, initial, 2).collect())
    assert broken(metrics) == []
    off = metrics.withColumn("gross_ratio", (F.col("gross_ratio").cast("decimal(36,18)") + F.when(F.col("valuation_date") == day(1), F.lit("0.000000000000000002")).otherwise("0").cast("decimal(36,18)")).cast("decimal(38,18)"))
    assert broken(off) == [(day(1), "PORTFOLIO_DAILY_EXPOSURE_RATIOS_RECONCILE")]
    assert broken(metrics.unionByName(metrics.where(F.col("valuation_date") == day(1))))[0] == (day(1), "PORTFOLIO_DAILY_BASELINE_RECONCILES")

    exposures = spark.createDataFrame([("r", "A", X(100)), ("r", "B", X(-50))], "run_id string, instrument_id string, market_value decimal(23,6)")
    returns = spark.createDataFrame([(i, day(k), day(k - 1), X(k) / 100 * s) for k in range(1, 21) for i, s in (("A", 1), ("B", -1))], "instrument_id string, scenario_date date, prior_date date, simple_return decimal(14,12)")
    components = R.component_pnl(exposures, returns)
    scenarios = R.price_scenarios(components)
    shocks = spark.createDataFrame([("BROAD", i, X("-0.1")) for i in "AB"], "scenario_id string, instrument_id string, shock_ratio decimal(12,10)")
    navs = spark.createDataFrame([("r", X(60))], "run_id string, static_nav decimal(38,18)")
    found = lambda e=exposures, s=shocks, n=20, k=2, base="-0.1", c=components: sorted({r.rule_id for r in DR.risk_violations(scenarios, R.discrete_var(scenarios), R.stress(exposures, shocks, navs), c.drop("prior_date"), e, s, navs, n, k, ("BROAD",), ("BROAD", base)).collect()})
    assert found() == []
    assert found(n=21) == ["HISTORICAL_PNL_SCENARIO_COUNT_COMPLETE"] and found(base="-0.2") == ["STRESS_BROAD_MARKET_BASELINE"]
    assert found(e=exposures.withColumn("market_value", F.when(F.col("instrument_id") == "A", F.col("market_value")))) == ["RISK_RUN_STATIC_EXPOSURE_REPRICE_COMPLETE", "STRESS_RESULT_FORMULA_RECONCILES"]
    assert "RISK_RUN_PRICE_HISTORY_COVERAGE_COMPLETE" in found(c=components.where(F.col("instrument_id") == "A")) and "RISK_RUN_STATIC_EXPOSURE_INSTRUMENT_COVERAGE" in found(k=3)
