"""The rules of derived data: positions, cash, market values, daily metrics and risk.

Each pack recomputes what a row should be from its inputs, for all portfolios and dates at once, and reports violations as rows
(keys, rule_id, observed_value, ...) by one projection; rules on whole groups come as rows of the group's keys. A run is published
only if its partition has none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.expr import AMOUNT, QUANTITY, product, share
from riskloom.operators.risk import LEVELS, ranked_losses
from riskloom.operators.rules import Rule, violations

_KEY = ["portfolio_id", "instrument_id", "position_date"]
#: Largest difference of a recomputed ratio.
RATIO_TOLERANCE = "0.000000000000000001"


def _differs(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def _repeated(keys: list[str]) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def groups_violating(groups: DataFrame, rule_id: str, keys: list[str], violated: Column, observed: list[str], expected: str = "") -> DataFrame:
    """Violations of a rule on groups, in the form of row violations."""
    return violations(groups, [Rule(rule_id, violated, expected=expected, observed=tuple(observed))], keys)


def position_violations(positions: DataFrame, sessions: DataFrame, multipliers: DataFrame, dividends: DataFrame, portfolios: DataFrame, instruments: DataFrame, inception: DataFrame) -> DataFrame:
    """portfolio_id, instrument_id, position_date and the rule broken.

    positions: keys, signed_quantity, basis (INITIAL_ALLOCATION, BUY_AND_HOLD_CARRY_FORWARD or SPLIT_ADJUSTED_CARRY_FORWARD),
    record_hash and computed_hash; sessions: position_date; multipliers: instrument_id, position_date, split_multiplier;
    dividends: instrument_id, position_date; portfolios: portfolio_id, strategy_code; instruments: instrument_id; inception:
    portfolio_id, instrument_id, expected_quantity. A row of several faults breaks several rules.
    """
    by_date = Window.partitionBy("portfolio_id", "instrument_id").orderBy("position_date")
    calendar = sessions.select("position_date").distinct().withColumn("session_before", F.lag("position_date").over(Window.orderBy("position_date")))  # one row a date
    rows = positions.withColumns({"prior_quantity": F.lag("signed_quantity").over(by_date), "prior_date": F.lag("position_date").over(by_date), "is_repeated": _repeated(_KEY)})
    rows = rows.join(calendar.withColumn("is_session", F.lit(True)), "position_date", "left")
    rows = rows.join(multipliers.select("instrument_id", "position_date", "split_multiplier"), ["instrument_id", "position_date"], "left")
    rows = rows.join(dividends.select("instrument_id", "position_date", F.lit(True).alias("pays")).distinct(), ["instrument_id", "position_date"], "left")
    rows = rows.join(portfolios.select("portfolio_id", "strategy_code"), "portfolio_id", "left").join(instruments.select("instrument_id", F.lit(True).alias("is_known")).distinct(), "instrument_id", "left")
    rows = rows.join(inception.select("portfolio_id", "instrument_id", "expected_quantity"), ["portfolio_id", "instrument_id"], "left")
    q, prior = F.col("signed_quantity"), F.col("prior_quantity")
    first = F.col("basis") == "INITIAL_ALLOCATION"
    expected = product(prior, F.coalesce("split_multiplier", F.lit(1).cast("decimal(20,10)")))
    seen = ("signed_quantity", "prior_quantity", "split_multiplier")
    rules = [
        Rule("POSITION_BUSINESS_KEY_UNIQUE", F.col("is_repeated")),
        Rule("POSITION_REFERENCES_VALID", F.col("strategy_code").isNull() | F.col("is_known").isNull()),
        Rule("POSITION_VALID_SESSION", F.col("is_session").isNull(), field_name="position_date"),
        Rule("POSITION_DATE_SEQUENCE", ~first & F.col("prior_date").isNotNull() & _differs(F.col("prior_date"), F.col("session_before")), field_name="position_date", observed=("prior_date", "session_before")),
        Rule("POSITION_INPUT_COVERAGE", ~first & prior.isNull()),
        Rule("POSITION_NONZERO_QUANTITY", q.isNull() | (q == 0), field_name="signed_quantity", observed=("signed_quantity",)),
        Rule("POSITION_STRATEGY_SIGN", ((F.col("strategy_code") == "LONG_ONLY") & (q < 0)) | (F.signum(q) != F.signum("expected_quantity")), field_name="signed_quantity", observed=("signed_quantity", "strategy_code")),
        Rule("POSITION_INCEPTION_RECONCILIATION", first & (_differs(q, F.col("expected_quantity").cast(QUANTITY)) | prior.isNotNull()), field_name="signed_quantity", observed=("signed_quantity", "expected_quantity")),
        Rule("POSITION_BUY_AND_HOLD_CONTINUITY", ~first & F.col("split_multiplier").isNull() & prior.isNotNull() & _differs(q, prior), field_name="signed_quantity", observed=seen),
        Rule("POSITION_SPLIT_RECONCILIATION", ~first & F.col("split_multiplier").isNotNull() & prior.isNotNull() & _differs(q, expected), field_name="signed_quantity", observed=seen),
        Rule("POSITION_DIVIDEND_QUANTITY_UNCHANGED", ~first & F.col("pays") & prior.isNotNull() & _differs(q, expected), field_name="signed_quantity", observed=seen),
        Rule("POSITION_RECORD_HASH_VALID", _differs(F.col("record_hash"), F.col("computed_hash"))),
    ]
    return violations(rows, rules, _KEY)


def coverage_violations(rows: DataFrame, rule_id: str, keys: list[str], member: str, expected: int) -> DataFrame:
    """Groups that don't have exactly ``expected`` distinct members."""
    counted = rows.groupBy(*keys).agg(F.count_distinct(member).alias("members"))
    return groups_violating(counted, rule_id, keys, F.col("members") != expected, ["members"], str(expected))


def cash_violations(cash: DataFrame, flows: DataFrame, initial: DataFrame, portfolios: DataFrame, sessions: DataFrame) -> DataFrame:
    """portfolio_id, cash_date and the rule broken.

    cash: keys, base_currency, opening_cash, dividend_flow, closing_cash, action_count, record_hash and computed_hash; flows:
    portfolio_id, cash_date, expected_flow and expected_actions, recomputed; initial: portfolio_id, initial_cash;
    portfolios: portfolio_id, base_currency; sessions: cash_date.
    """
    keys = ["portfolio_id", "cash_date"]
    by_date = Window.partitionBy("portfolio_id").orderBy("cash_date")
    calendar = sessions.select("cash_date").distinct().withColumn("session_before", F.lag("cash_date").over(Window.orderBy("cash_date")))  # one row a date
    rows = cash.withColumns({"prior_closing": F.lag("closing_cash").over(by_date), "prior_date": F.lag("cash_date").over(by_date), "is_repeated": _repeated(keys)})
    rows = rows.join(calendar.withColumn("is_session", F.lit(True)), "cash_date", "left").join(flows.select(*keys, "expected_flow", "expected_actions"), keys, "left")
    rows = rows.join(initial.select("portfolio_id", "initial_cash"), "portfolio_id", "left").join(portfolios.select("portfolio_id", F.col("base_currency").alias("portfolio_currency")), "portfolio_id", "left")
    first = F.col("prior_date").isNull()
    money = lambda c: F.col(c).cast(AMOUNT)
    rules = [
        Rule("CASH_BALANCE_BUSINESS_KEY_UNIQUE", F.col("is_repeated")),
        Rule("CASH_BALANCE_REFERENCES_VALID", F.col("portfolio_currency").isNull()),
        Rule("CASH_BALANCE_BASE_CURRENCY_MATCH", F.col("base_currency") != F.col("portfolio_currency"), field_name="base_currency", observed=("base_currency",)),
        Rule("CASH_BALANCE_INPUT_COVERAGE", F.col("expected_flow").isNull() | F.col("is_session").isNull()),
        Rule("CASH_BALANCE_DATE_SEQUENCE", ~first & _differs(F.col("prior_date"), F.col("session_before")), field_name="cash_date", observed=("prior_date", "session_before")),
        Rule("CASH_BALANCE_INCEPTION_RECONCILIATION", first & _differs(money("opening_cash"), money("initial_cash")), field_name="opening_cash", observed=("opening_cash", "initial_cash")),
        Rule("CASH_BALANCE_OPENING_CONTINUITY", ~first & _differs(money("opening_cash"), money("prior_closing")), field_name="opening_cash", observed=("opening_cash", "prior_closing")),
        Rule("CASH_BALANCE_DIVIDEND_RECONCILIATION", F.col("expected_flow").isNotNull() & _differs(money("dividend_flow"), money("expected_flow")), field_name="dividend_flow", observed=("dividend_flow", "expected_flow")),
        Rule("CASH_BALANCE_CLOSING_RECONCILIATION", _differs(money("closing_cash"), (money("opening_cash") + money("dividend_flow")).cast(AMOUNT)), field_name="closing_cash", observed=("closing_cash",)),
        Rule("CASH_BALANCE_ACTION_COUNT_CONSISTENT", F.col("expected_actions").isNotNull() & _differs(F.col("action_count"), F.col("expected_actions")), field_name="action_count", observed=("action_count", "expected_actions")),
        Rule("CASH_BALANCE_RECORD_HASH_VALID", _differs(F.col("record_hash"), F.col("computed_hash"))),
    ]
    return violations(rows, rules, keys)


def market_value_violations(values: DataFrame, positions: DataFrame, closes: DataFrame) -> DataFrame:
    """portfolio_id, instrument_id, valuation_date and the rule broken.

    values: keys, price_date, currency, signed_market_value, absolute_market_value, position_side, record_hash and computed_hash;
    positions: portfolio_id, instrument_id, valuation_date, signed_quantity; closes: instrument_id, valuation_date, close_price, quote_currency.
    """
    keys = ["portfolio_id", "instrument_id", "valuation_date"]
    rows = values.withColumn("is_repeated", _repeated(keys)).join(positions.select(*keys, "signed_quantity"), keys, "left")
    rows = rows.join(closes.select("instrument_id", "valuation_date", "close_price", "quote_currency"), ["instrument_id", "valuation_date"], "left")
    v, a = F.col("signed_market_value"), F.col("absolute_market_value")
    expected = product(F.col("signed_quantity"), F.col("close_price"))
    rules = [
        Rule("POSITION_MARKET_VALUE_KEY_UNIQUE", F.col("is_repeated")),
        Rule("POSITION_MARKET_VALUE_INPUT_COVERAGE", F.col("signed_quantity").isNull() | F.col("close_price").isNull()),
        Rule("POSITION_MARKET_VALUE_DATE_ALIGNMENT", _differs(F.col("price_date"), F.col("valuation_date")), field_name="price_date", observed=("price_date",)),
        Rule("POSITION_MARKET_VALUE_CURRENCY_MATCH", F.col("quote_currency").isNotNull() & _differs(F.col("currency"), F.col("quote_currency")), field_name="currency", observed=("currency", "quote_currency")),
        Rule("POSITION_MARKET_VALUE_FORMULA_RECONCILES", expected.isNotNull() & _differs(v.cast(QUANTITY), expected), field_name="signed_market_value", observed=("signed_market_value", "signed_quantity", "close_price")),
        Rule("POSITION_MARKET_VALUE_ABSOLUTE_RECONCILES", _differs(a, F.abs(v)), field_name="absolute_market_value", observed=("absolute_market_value",)),
        Rule("POSITION_MARKET_VALUE_SIGN_RECONCILES", ((F.col("position_side") == "LONG") & (v < 0)) | ((F.col("position_side") == "SHORT") & (v > 0)), field_name="position_side", observed=("position_side",)),
        Rule("POSITION_MARKET_VALUE_RECORD_HASH_VALID", _differs(F.col("record_hash"), F.col("computed_hash"))),
    ]
    return violations(rows, rules, keys)


def daily_metric_violations(metrics: DataFrame, values: DataFrame, cash: DataFrame, initial: DataFrame, position_count: int | None = None) -> DataFrame:
    """portfolio_id, valuation_date and the rule broken.

    metrics: what ``daily_metrics`` returns, with base_currency, record_hash and computed_hash; values: portfolio_id, valuation_date,
    signed_market_value; cash: portfolio_id, valuation_date, closing_cash; initial: portfolio_id, initial_nav, base_currency (initial_nav
    null: the first NAV is its own baseline).
    """
    keys = ["portfolio_id", "valuation_date"]
    v = F.col("signed_market_value")
    sums = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(v > 0, v).otherwise(0)).cast(AMOUNT).alias("longs"), F.sum(F.when(v < 0, -v).otherwise(0)).cast(AMOUNT).alias("shorts"))
    by_date = Window.partitionBy("portfolio_id").orderBy("valuation_date")
    rows = metrics.withColumns({"prior_nav": F.lag("nav").over(by_date), "is_repeated": _repeated(keys)}).join(sums, keys, "left")
    rows = rows.join(cash.select(*keys, "closing_cash"), keys, "left").join(initial.select("portfolio_id", "initial_nav", F.col("base_currency").alias("portfolio_currency")), "portfolio_id", "left")
    money = lambda c: F.col(c).cast(AMOUNT)
    baseline = F.coalesce(F.col("prior_nav"), F.col("initial_nav"), F.col("nav")).cast(AMOUNT)
    limit = F.lit(RATIO_TOLERANCE).cast("decimal(38,18)")
    exact = lambda c: c.try_cast("decimal(36,18)")  # noqa: E731  # differences of (38,18) would lose the last digit
    off = lambda c, a, b: F.coalesce(F.abs(exact(F.col(c)) - exact(share(F.col(a), F.col(b)))) > limit, F.lit(True))
    ratios = reduce(lambda x, y: x | y, [off(f"{n}_ratio", f"{n}_value", "nav") for n in ("long", "short", "gross", "net")])
    counts = F.col("position_count") != F.col("n")
    rules = [
        Rule("PORTFOLIO_DAILY_KEY_UNIQUE", F.col("is_repeated")),
        Rule("PORTFOLIO_DAILY_INPUT_COVERAGE", F.col("n").isNull()),
        Rule("PORTFOLIO_DAILY_DATE_ALIGNMENT", F.col("closing_cash").isNull(), field_name="valuation_date"),
        Rule("PORTFOLIO_DAILY_CURRENCY_MATCH", _differs(F.col("base_currency"), F.col("portfolio_currency")), field_name="base_currency", observed=("base_currency",)),
        Rule("PORTFOLIO_DAILY_POSITION_COUNTS_RECONCILE", counts if position_count is None else counts | (F.col("n") != position_count), field_name="position_count", observed=("position_count", "n")),
        Rule("PORTFOLIO_DAILY_MARKET_VALUES_RECONCILE", (money("long_value") != F.col("longs")) | (money("short_value") != F.col("shorts")) | (money("gross_value") != F.col("longs") + F.col("shorts")) | (money("net_value") != F.col("longs") - F.col("shorts")), observed=("long_value", "short_value", "gross_value", "net_value")),
        Rule("PORTFOLIO_DAILY_NAV_RECONCILES", _differs(money("nav"), (money("net_value") + money("cash")).cast(AMOUNT)) | (money("cash") != money("closing_cash")), field_name="nav", observed=("nav", "net_value", "cash")),
        Rule("PORTFOLIO_DAILY_NAV_POSITIVE", F.col("nav").isNull() | (F.col("nav") <= 0), field_name="nav", observed=("nav",)),
        Rule("PORTFOLIO_DAILY_BASELINE_RECONCILES", _differs(money("baseline"), baseline), field_name="baseline", observed=("baseline", "prior_nav")),
        Rule("PORTFOLIO_DAILY_PNL_RECONCILES", _differs(money("pnl"), (money("nav") - money("baseline")).cast(AMOUNT)), field_name="pnl", observed=("pnl",)),
        Rule("PORTFOLIO_DAILY_RETURN_RECONCILES", off("daily_return", "pnl", "baseline"), field_name="daily_return", observed=("daily_return",)),
        Rule("PORTFOLIO_DAILY_EXPOSURE_RATIOS_RECONCILE", ratios, observed=("long_ratio", "short_ratio", "gross_ratio", "net_ratio")),
        Rule("PORTFOLIO_DAILY_RECORD_HASH_VALID", _differs(F.col("record_hash"), F.col("computed_hash"))),
    ]
    return violations(rows, rules, keys)


def risk_violations(scenarios: DataFrame, measures: DataFrame, results: DataFrame, components: DataFrame, exposures: DataFrame, shocks: DataFrame, navs: DataFrame, observations: int, instruments: int, approved: tuple[str, ...], baseline: tuple[str, str] | None = None, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """run_id, item (a date, a level, a scenario or the empty text) and the rule broken, recomputed from exposures and returns.

    scenarios: run_id, scenario_date, pnl, loss; measures: run_id, confidence_level, var_rank, scenario_date, var_amount; results:
    run_id, scenario_id, shock_count, stress_pnl, stressed_nav; components: run_id, scenario_date, instrument_id, pnl; exposures: run_id,
    instrument_id, market_value; shocks: scenario_id, instrument_id, shock_ratio; navs: run_id, static_nav; baseline: a scenario
    and the ratio of all its shocks.
    """
    keys = ["run_id", "item"]
    held = exposures.groupBy("run_id").agg(F.count_distinct("instrument_id").alias("held"), F.count_if(F.col("market_value").isNull()).alias("unpriced"))
    none = F.lit("").alias("item")
    per_run = held.join(navs.select("run_id", "static_nav"), "run_id", "left").join(scenarios.groupBy("run_id").agg(F.count(F.lit(1)).alias("dates")), "run_id", "left")
    found = results.groupBy("run_id").agg(F.array_sort(F.collect_set("scenario_id")).alias("found"))
    per_run = per_run.join(found, "run_id", "left").withColumn("item", none)
    wanted = F.array_sort(F.array(*[F.lit(x) for x in approved]))
    run_rules = [
        Rule("RISK_RUN_STATIC_EXPOSURE_INSTRUMENT_COVERAGE", F.col("held") != instruments, observed=("held",)),
        Rule("RISK_RUN_STATIC_EXPOSURE_REPRICE_COMPLETE", F.col("unpriced") > 0, observed=("unpriced",)),
        Rule("RISK_RUN_STATIC_CASH_VALID", F.col("static_nav").isNull()),
        Rule("HISTORICAL_PNL_SCENARIO_COUNT_COMPLETE", F.coalesce("dates", F.lit(0)) != observations, observed=("dates",), expected=str(observations)),
        Rule("STRESS_RESULT_APPROVED_SCENARIO_SET_COMPLETE", _differs(F.col("found"), wanted)),
    ]
    again = components.groupBy("run_id", "scenario_date").agg(F.sum("pnl").alias("again"), F.count_distinct("instrument_id").alias("priced"))
    dated = scenarios.join(again, ["run_id", "scenario_date"], "left").withColumn("item", F.col("scenario_date").cast("string"))
    date_rules = [
        Rule("HISTORICAL_PNL_SCENARIO_FORMULA_RECONCILES", _differs(F.col("pnl"), F.col("again")) | _differs(F.col("loss"), -F.col("again")), field_name="pnl", observed=("pnl", "again")),
        Rule("RISK_RUN_PRICE_HISTORY_COVERAGE_COMPLETE", F.coalesce("priced", F.lit(0)) != instruments, observed=("priced",)),
    ]
    recomputed = scenarios.select("run_id", "scenario_date").join(again.select("run_id", "scenario_date", (-F.col("again")).alias("loss")), ["run_id", "scenario_date"])
    ranked = ranked_losses(recomputed).withColumn("confidence_level", F.explode(F.array(*[F.lit(x).cast("decimal(3,2)") for x in levels])))
    ranked = ranked.where(F.col("loss_rank") == F.ceil(F.col("confidence_level") * F.col("observations"))).select("run_id", "confidence_level", F.col("loss_rank").alias("right_rank"), F.col("scenario_date").alias("right_date"), F.col("loss").alias("right_amount"))
    measured = ranked.join(measures, ["run_id", "confidence_level"], "full").withColumn("item", F.col("confidence_level").cast("string"))
    level_rules = [
        Rule("VAR_MEASURE_DISCRETE_QUANTILE_RECONCILES", _differs(F.col("var_rank"), F.col("right_rank")) | _differs(F.col("scenario_date"), F.col("right_date")), field_name="var_rank", observed=("var_rank", "right_rank")),
        Rule("VAR_MEASURE_AMOUNT_RECONCILES", _differs(F.col("var_amount"), F.col("right_amount")), field_name="var_amount", observed=("var_amount", "right_amount")),
    ]
    terms = exposures.join(shocks, "instrument_id").groupBy("run_id", "scenario_id").agg(F.sum(F.col("market_value") * F.col("shock_ratio").cast("decimal(12,10)")).alias("right_pnl"), F.count(F.lit(1)).alias("right_count"))
    stressed = results.join(terms, ["run_id", "scenario_id"], "left").join(navs.select("run_id", F.col("static_nav").alias("own_nav")), "run_id", "left").withColumn("item", F.col("scenario_id"))
    stress_rules = [
        Rule("STRESS_RESULT_SHOCK_COVERAGE_VALID", _differs(F.col("shock_count"), F.col("right_count")) | (F.col("right_count") != instruments), field_name="shock_count", observed=("shock_count", "right_count")),
        Rule("STRESS_RESULT_FORMULA_RECONCILES", _differs(F.col("stress_pnl"), F.col("right_pnl")) | _differs(F.col("stressed_nav"), F.col("own_nav") + F.col("right_pnl")), field_name="stress_pnl", observed=("stress_pnl", "right_pnl")),
    ]
    parts = [violations(per_run, run_rules, keys), violations(dated, date_rules, keys), violations(measured, level_rules, keys), violations(stressed, stress_rules, keys)]
    if baseline:
        wrong = shocks.where((F.col("scenario_id") == baseline[0]) & (F.col("shock_ratio") != F.lit(baseline[1]).cast("decimal(12,10)"))).groupBy("scenario_id").agg(F.count(F.lit(1)).alias("wrong"))
        runs = results.select("run_id", "scenario_id").join(wrong, "scenario_id").withColumn("item", F.col("scenario_id"))
        parts.append(violations(runs, [Rule("STRESS_BROAD_MARKET_BASELINE", F.col("wrong") > 0, observed=("wrong",))], keys))
    return _all(parts)
