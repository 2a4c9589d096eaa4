"""The contracts and rules of the domain's datasets on the driver's tables, whose columns decide which rows are faulty.

Raw rows are written once as expressions that both engines understand; the rules' SQL is stated apart from their columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.rules import Rule, violations
from riskloom.plans import contracts as C
from riskloom.plans import domain_rules as D
from riskloom.plans import driver_tables as T
from riskloom.plans.catalog import query
from riskloom.plans.contracts import Contract

_OUT = ["business_key", "source_record_id", "rule_id", "severity", "disposition"]
Fields = dict[str, str]


def _raw(spark: SparkSession, sf_dir: str, table: str, fields: Fields, record: str, hashed: Contract, wrong_hash: str) -> DataFrame:
    """Source rows; their hash is right but where ``wrong_hash`` holds."""
    rows = T.table(spark, sf_dir, table).selectExpr(f"{record} AS lineage_record_id", f"{wrong_hash} AS __wrong", *[f"{e} AS `{n}`" for n, e in fields.items()])
    typed = hashed.typed(rows.withColumn("record_hash", F.lit("x"))).select("lineage_record_id", F.col("computed_hash").alias("__hash"), "__wrong", *[F.col(f"raw_{f.name}").alias(f.name) for f in hashed.fields if f.name != "record_hash"], *[n for n in fields if n not in {f.name for f in hashed.fields}])
    return typed.withColumn("record_hash", F.when(F.col("__wrong"), F.lit("0" * 64)).otherwise(F.col("__hash"))).drop("__hash", "__wrong")


def _found(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    return violations(rows, rules, ["business_key", "lineage_record_id"]).withColumnRenamed("lineage_record_id", "source_record_id").select(*_OUT)


def _sql(contract: Contract, table: str, fields: Fields, record: str, wrong_hash: str, own: list[tuple[str, str, str, str]], lookups: str = "", joins: str = "") -> str:
    """Typed rows and the violations of the contract's own rules and of those given as (rule, condition, severity, disposition)."""
    kind = lambda k: "VARCHAR" if k == "string" else k.upper()
    names = [f for f in contract.fields if f.name != "record_hash"]
    cast = lambda n, k: f"TRY_CAST(NULLIF(TRIM({n}), '') AS {kind(k)})"
    raw = f"raw AS (SELECT {record} AS source_record_id, {wrong_hash} AS wrong, {', '.join(f'{e} AS {n}' for n, e in fields.items())} FROM {table})"
    extra = [n for n in fields if n not in {f.name for f in contract.fields}]
    typed = f"typed AS (SELECT source_record_id, wrong, {''.join(n + ', ' for n in extra)}{', '.join(f'{f.name} AS raw_{f.name}, {cast(f.name, f.kind)} AS t_{f.name}' for f in names)} FROM raw)"
    parts = ", ".join(f"COALESCE(raw_{f.name}, '<NULL>')" if contract.raw_hash else f"COALESCE(CAST(t_{f.name} AS VARCHAR), '<NULL>')" for f in names)
    blank = " OR ".join(f"TRIM(COALESCE(raw_{k}, '')) = ''" for k in contract.key)
    key = f"CASE WHEN NOT ({blank}) THEN concat_ws('|', {', '.join(f'raw_{k}' for k in contract.key)}) END AS business_key"
    rows = f"rows AS (SELECT {key}, source_record_id, wrong, {''.join(n + ', ' for n in extra)}{', '.join(f'raw_{f.name}, t_{f.name} AS {f.name}' for f in names)}, sha256(concat_ws('|', {parts})) AS computed_hash FROM typed)"
    prefix = contract.rule_prefix
    generic = [(f"{prefix}_REQUIRED_FIELDS", " OR ".join(f"r.{f.name} IS NULL" for f in names if not f.nullable))]
    generic.append((f"{prefix}_TYPES_CASTABLE", " OR ".join(f"(TRIM(r.raw_{f.name}) <> '' AND r.{f.name} IS NULL)" for f in names if f.kind != "string")))
    if any(f.allowed for f in names):
        generic.append((f"{prefix}_ALLOWED_VALUES", " OR ".join(f"COALESCE(r.{f.name} NOT IN ({', '.join(repr(x) for x in f.allowed)}), FALSE)" for f in names if f.allowed)))
    if any(f.pattern for f in names):
        generic.append((f"{prefix}_ID_FORMAT", " OR ".join(f"COALESCE(NOT regexp_matches(r.{f.name}, '{f.pattern}'), FALSE)" for f in names if f.pattern)))
    generic.append((f"{prefix}_RECORD_HASH_VALID", "r.wrong"))
    every = [(n, c, "ERROR", "REJECT") for n, c in generic] + own
    return f"WITH {lookups}{raw}, {typed}, {rows} " + " UNION ALL ".join(f"SELECT r.business_key, r.source_record_id, '{n}' AS rule_id, '{s}' AS severity, '{d}' AS disposition FROM rows r {joins} WHERE {c}" for n, c, s, d in every)


_VERSION = "NOT regexp_matches(r.{0}, '^[0-9]+\\.[0-9]+\\.[0-9]+$')"
_E, _W = ("ERROR", "REJECT"), ("WARNING", "WARN_AND_ACCEPT")
_Q = ("ERROR", "QUARANTINE")


# ---- portfolios: customers ------------------------------------------------------------------------------------------

_PORTFOLIO: Fields = {
    "portfolio_id": "CASE WHEN c_nationkey = 3 THEN 'bad id' ELSE concat('P_', CAST(c_custkey AS STRING)) END",
    "portfolio_name": "c_name",
    "strategy_code": "CASE WHEN c_mktsegment = 'MACHINERY' THEN 'LONG_SHORT_130_30' WHEN c_nationkey = 4 THEN 'OTHER' ELSE 'LONG_ONLY' END",
    "base_currency": "CASE WHEN c_nationkey = 5 THEN 'EUR' ELSE 'USD' END",
    "target_inception_date": "CASE WHEN c_nationkey = 6 THEN '2016-02-30' ELSE '2016-01-04' END",
    "actual_inception_date": "CASE WHEN c_nationkey = 7 THEN '' WHEN c_nationkey = 8 THEN '2015-12-31' ELSE '2016-01-04' END",
    "initial_nav": "CASE WHEN c_nationkey = 9 THEN 'abc' ELSE CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS STRING) END",
    "target_long_ratio": "CASE WHEN c_mktsegment = 'MACHINERY' THEN '1.3' ELSE '1' END",
    "target_short_ratio": "CASE WHEN c_mktsegment = 'MACHINERY' THEN '0.3' WHEN c_nationkey = 10 THEN '0.2' ELSE '0' END",
    "target_gross_ratio": "CASE WHEN c_mktsegment = 'MACHINERY' THEN '1.6' WHEN c_nationkey = 10 THEN '1.2' ELSE '1' END",
    "target_net_ratio": "CASE WHEN c_nationkey = 10 AND c_mktsegment <> 'MACHINERY' THEN '0.8' WHEN c_nationkey = 11 THEN '1.1' ELSE '1' END",
    "rebalance_policy": "'BUY_AND_HOLD'",
    "cash_policy": "'RETAIN_DIVIDENDS_NO_INTEREST'",
    "is_active": "'true'",
    "config_version": "CASE WHEN c_nationkey = 13 THEN '1.0' ELSE '1.0.0' END",
}
_P_ARGS = ("customer", _PORTFOLIO, "CAST(c_custkey AS STRING)")
_RATIOS = "CAST(r.target_{0}_ratio AS DOUBLE)"
_L, _S, _G, _N = (_RATIOS.format(x) for x in ("long", "short", "gross", "net"))


@query(
    _sql(
        C.PORTFOLIOS, *_P_ARGS, "c_nationkey = 15",
        [
            ("PORTFOLIO_ACTUAL_INCEPTION_DATE_MISSING", "r.actual_inception_date IS NULL", *_W),
            ("PORTFOLIO_INITIAL_NAV_POSITIVE", "r.initial_nav <= 0", *_E),
            ("PORTFOLIO_RATIO_RECONCILIATION", f"ABS({_G} - {_L} - {_S}) > 1e-6 OR ABS({_N} - {_L} + {_S}) > 1e-6", *_E),
            ("PORTFOLIO_STRATEGY_TARGETS", f"(r.strategy_code = 'LONG_ONLY' AND (ABS({_L} - 1) > 1e-6 OR ABS({_S}) > 1e-6 OR ABS({_G} - 1) > 1e-6 OR ABS({_N} - 1) > 1e-6)) OR (r.strategy_code = 'LONG_SHORT_130_30' AND (ABS({_L} - 1.3) > 1e-6 OR ABS({_S} - 0.3) > 1e-6 OR ABS({_G} - 1.6) > 1e-6 OR ABS({_N} - 1) > 1e-6))", *_E),
            ("PORTFOLIO_INCEPTION_ORDER", "r.actual_inception_date < r.target_inception_date", *_E),
            ("PORTFOLIO_CONFIG_VERSION_VALID", _VERSION.format("config_version"), *_E),
        ],
    )
)
def portfolio_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw(spark, sf_dir, *_P_ARGS, C.PORTFOLIOS, "c_nationkey = 15")
    return _found(C.PORTFOLIOS.typed(rows), C.PORTFOLIOS.rules() + D.portfolio_rules())


# ---- instruments: parts ---------------------------------------------------------------------------------------------

_INSTRUMENT: Fields = {
    "instrument_id": "CASE WHEN p_size = 1 THEN 'bad id' ELSE concat('I_', CAST(p_partkey AS STRING)) END",
    "display_symbol": "p_name",
    "yfinance_symbol": "concat('Y', CAST(p_partkey AS STRING))",
    "instrument_name": "p_name",
    "asset_class": "CASE WHEN p_size = 2 THEN 'BOND' ELSE 'EQUITY' END",
    "security_type": "'COMMON_STOCK'",
    "exchange_mic": "CASE WHEN p_size % 2 = 0 THEN 'XNAS' ELSE 'XNYS' END",
    "quote_currency": "'USD'",
    "issuer_country_code": "'US'",
    "official_sector_name": "CASE WHEN p_size = 3 THEN '' ELSE 'Energy' END",
    "risk_cluster_id": "'FINANCIAL_FOUNDATIONS'",
    "classification_source": "p_brand",
    "classification_as_of_date": "CASE WHEN p_size = 4 THEN '2016-99-01' ELSE '2016-01-01' END",
    "active_from": "'2010-01-01'",
    "active_to": "CASE WHEN p_size = 5 THEN '2009-01-01' ELSE '' END",
    "is_active": "CASE WHEN p_size = 6 THEN 'maybe' ELSE 'true' END",
    "config_version": "CASE WHEN p_size = 7 THEN 'v1' ELSE '1.0.0' END",
}
_I_ARGS = ("part", _INSTRUMENT, "CAST(p_partkey AS STRING)")


@query(
    _sql(
        C.INSTRUMENTS, *_I_ARGS, "p_size = 8",
        [
            ("INSTRUMENT_ACTIVE_DATE_RANGE", "r.active_to < r.active_from", *_E),
            ("INSTRUMENT_CLASSIFICATION_REQUIRED", "r.is_active AND (r.official_sector_name IS NULL OR r.classification_source IS NULL OR r.classification_as_of_date IS NULL)", *_E),
            ("INSTRUMENT_CONFIG_VERSION_VALID", _VERSION.format("config_version"), *_E),
        ],
    )
)
def instrument_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw(spark, sf_dir, *_I_ARGS, C.INSTRUMENTS, "p_size = 8")
    return _found(C.INSTRUMENTS.typed(rows), C.INSTRUMENTS.rules() + D.instrument_rules())


# ---- allocations and shocks: line items -----------------------------------------------------------------------------

_LINE = "concat_ws(':', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING))"
_ALLOCATION: Fields = {
    "portfolio_id": "concat('P_', CAST(l_suppkey AS STRING))",
    "instrument_id": "concat('I_', CAST(l_partkey AS STRING))",
    "effective_from": "CAST(CAST(l_shipdate AS DATE) AS STRING)",
    "effective_to": "CASE WHEN l_linenumber = 7 THEN '1990-01-01' ELSE '' END",
    "target_weight": "CASE WHEN l_quantity = 10 THEN 'heavy' ELSE CAST(CAST(l_discount AS DECIMAL(12,10)) AS STRING) END",
    "allocation_version": "CASE WHEN l_linenumber = 6 THEN '1.0' ELSE '1.0.0' END",
}
_A_ARGS = ("lineitem", _ALLOCATION, _LINE)
_KNOWN = "kp AS (SELECT concat('P_', CAST(s_suppkey AS STRING)) AS id FROM supplier WHERE s_nationkey <> 3), ki AS (SELECT concat('I_', CAST(p_partkey AS STRING)) AS id FROM part WHERE p_size <> 9), "


def _known(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    holders = T.table(spark, sf_dir, "supplier").where("s_nationkey <> 3").selectExpr("concat('P_', cast(s_suppkey as string)) as portfolio_id", "concat('S_', cast(s_suppkey as string)) as scenario_id", "if(s_nationkey = 4, '2.0.0', '1.0.0') as scenario_version")
    return holders, T.table(spark, sf_dir, "part").where("p_size <> 9").selectExpr("concat('I_', cast(p_partkey as string)) as instrument_id")


@query(
    _sql(
        C.TARGET_ALLOCATIONS, *_A_ARGS, "l_quantity = 20",
        [
            ("ALLOCATION_WEIGHT_NONZERO", "r.target_weight = 0", *_E),
            ("ALLOCATION_EFFECTIVE_DATE_RANGE", "r.effective_to < r.effective_from", *_E),
            ("ALLOCATION_VERSION_VALID", _VERSION.format("allocation_version"), *_E),
            ("ALLOCATION_FOREIGN_KEYS", "kp.id IS NULL OR ki.id IS NULL", *_E),
        ],
        _KNOWN, "LEFT JOIN kp ON kp.id = r.portfolio_id LEFT JOIN ki ON ki.id = r.instrument_id",
    )
)
def allocation_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    holders, instruments = _known(spark, sf_dir)
    typed = C.TARGET_ALLOCATIONS.typed(_raw(spark, sf_dir, *_A_ARGS, C.TARGET_ALLOCATIONS, "l_quantity = 20"))
    rows = D.referenced(typed, portfolio=(holders, ["portfolio_id"]), instrument=(instruments, ["instrument_id"]))
    return _found(rows, C.TARGET_ALLOCATIONS.rules() + D.allocation_rules())


_SHOCK: Fields = {
    "scenario_id": "CASE WHEN l_suppkey = 10 THEN 'BROAD_MARKET_DOWN_10' ELSE concat('S_', CAST(l_suppkey AS STRING)) END",
    "instrument_id": "concat('I_', CAST(l_partkey AS STRING))",
    "shock_ratio": "CASE WHEN l_linenumber = 1 THEN '-1.5000000000' WHEN l_linenumber = 2 THEN '1.2000000000' WHEN l_linenumber = 4 THEN 'much' ELSE '-0.1000000000' END",
    "shock_rationale": "CASE WHEN l_quantity = 30 THEN ' ' ELSE 'why' END",
    "scenario_version": "CASE WHEN l_linenumber = 3 THEN '2.0.0' ELSE '1.0.0' END",
}
_S_ARGS = ("lineitem", _SHOCK, _LINE)
_SCENARIOS = "ks AS (SELECT concat('S_', CAST(s_suppkey AS STRING)) AS id, CASE WHEN s_nationkey = 4 THEN '2.0.0' ELSE '1.0.0' END AS version FROM supplier WHERE s_nationkey <> 3), "


@query(
    _sql(
        C.STRESS_SCENARIO_SHOCKS, *_S_ARGS, "l_quantity = 21",
        [
            ("SHOCK_MINIMUM_VALID", "r.shock_ratio < -1", *_E),
            ("SHOCK_EXTREME_GAIN_REVIEW", "r.shock_ratio > 1", *_W),
            ("SHOCK_FOREIGN_KEYS", "ks.id IS NULL OR ki.id IS NULL", *_E),
            ("SHOCK_VERSION_MATCH", "r.scenario_version <> ks.version", *_E),
            ("SHOCK_BROAD_MARKET_BASELINE", "r.scenario_id = 'BROAD_MARKET_DOWN_10' AND r.shock_ratio <> -0.1", *_E),
        ],
        _KNOWN + _SCENARIOS, "LEFT JOIN ks ON ks.id = r.scenario_id LEFT JOIN ki ON ki.id = r.instrument_id",
    )
)
def shock_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenarios, instruments = _known(spark, sf_dir)
    typed = C.STRESS_SCENARIO_SHOCKS.typed(_raw(spark, sf_dir, *_S_ARGS, C.STRESS_SCENARIO_SHOCKS, "l_quantity = 21"))
    rows = D.scenario_versions(D.referenced(typed, scenario=(scenarios, ["scenario_id"]), instrument=(instruments, ["instrument_id"])), scenarios)
    return _found(rows, C.STRESS_SCENARIO_SHOCKS.rules() + D.shock_rules())


# ---- scenarios: suppliers -------------------------------------------------------------------------------------------

_SCENARIO: Fields = {
    "scenario_id": "concat('S_', CAST(s_suppkey AS STRING))",
    "scenario_name": "s_name",
    "scenario_description": "CASE WHEN s_nationkey = 1 THEN 'A Hypothetical forecast.' WHEN s_nationkey = 2 THEN 'A move.' ELSE 'A Hypothetical move.' END",
    "scenario_type": "CASE WHEN s_nationkey = 3 THEN 'OTHER' ELSE 'DETERMINISTIC_HYPOTHETICAL' END",
    "is_active": "CASE WHEN s_acctbal < 0 THEN 'perhaps' ELSE 'true' END",
    "scenario_version": "CASE WHEN s_nationkey = 5 THEN '1' ELSE '1.0.0' END",
    "effective_from": "'2016-01-01'",
    "effective_to": "CASE WHEN s_nationkey = 4 THEN '2015-01-01' ELSE '' END",
}
_SC_ARGS = ("supplier", _SCENARIO, "CAST(s_suppkey AS STRING)")


@query(
    _sql(
        C.STRESS_SCENARIOS, *_SC_ARGS, "s_nationkey = 6",
        [
            ("SCENARIO_LANGUAGE_HYPOTHETICAL", "NOT contains(lower(r.scenario_description), 'hypothetical') OR contains(lower(r.scenario_description), 'forecast')", *_E),
            ("SCENARIO_EFFECTIVE_RANGE", "r.effective_to < r.effective_from", *_E),
            ("SCENARIO_VERSION_VALID", _VERSION.format("scenario_version"), *_E),
            ("SCENARIO_TYPE_VALID", "r.scenario_type <> 'DETERMINISTIC_HYPOTHETICAL'", *_E),
        ],
    )
)
def scenario_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _raw(spark, sf_dir, *_SC_ARGS, C.STRESS_SCENARIOS, "s_nationkey = 6")
    return _found(C.STRESS_SCENARIOS.typed(rows), C.STRESS_SCENARIOS.rules() + D.scenario_rules())


# ---- prices: line items ---------------------------------------------------------------------------------------------

_CLOSE = "CAST(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(20,8)) AS STRING)"
_PRICE: Fields = {
    "instrument_id": "concat('I_', CAST(l_partkey AS STRING))",
    "price_date": "CASE WHEN l_quantity = 11 THEN '2016-13-45' ELSE CAST(CAST(l_shipdate AS DATE) AS STRING) END",
    "source_id": "CASE WHEN l_quantity = 12 THEN 'OTHER' ELSE 'YAHOO_FINANCE' END",
    "source_symbol": "CASE WHEN l_quantity = 13 THEN 'Z' ELSE concat('Y', CAST(l_partkey AS STRING)) END",
    "open_price": _CLOSE,
    "high_price": f"CASE WHEN l_quantity = 14 THEN '1.00000000' ELSE {_CLOSE} END",
    "low_price": f"CASE WHEN l_quantity = 15 THEN '-1.00000000' ELSE {_CLOSE} END",
    "close_price": _CLOSE,
    "adjusted_close_price": f"CASE WHEN l_quantity = 16 THEN 'n/a' ELSE {_CLOSE} END",
    "volume": "CASE WHEN l_quantity = 17 THEN '' WHEN l_quantity = 18 THEN '0' WHEN l_quantity = 19 THEN '-1' ELSE CAST(CAST(l_quantity AS BIGINT) AS STRING) END",
    "quote_currency": "CASE WHEN l_quantity = 21 THEN 'EUR' ELSE 'USD' END",
    "source_updated_at_utc": "''",
    "source_record_id": _LINE,
    "contract_version": "CASE WHEN l_quantity = 22 THEN '0.9.0' ELSE '1.0.0' END",
}
_PR_ARGS = ("lineitem", _PRICE, _LINE)
_MAPPED = "ki AS (SELECT concat('I_', CAST(p_partkey AS STRING)) AS id, concat('Y', CAST(p_partkey AS STRING)) AS symbol FROM part WHERE p_size <> 9), kd AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS day, dayofweek(CAST(l_shipdate AS DATE)) NOT IN (0, 6) AS is_session FROM lineitem), "


def _mapped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    instruments = T.table(spark, sf_dir, "part").selectExpr("concat('I_', cast(p_partkey as string)) as instrument_id", "concat('Y', cast(p_partkey as string)) as yfinance_symbol", "'USD' as quote_currency", "'XNAS' as exchange_mic", "p_size <> 9 as is_active")
    days = T.table(spark, sf_dir, "lineitem").selectExpr("cast(l_shipdate as date) as calendar_date").distinct()
    return instruments, days.selectExpr("'XNAS' as exchange_mic", "calendar_date", "dayofweek(calendar_date) between 2 and 6 as is_trading_day")


@query(
    _sql(
        C.DAILY_PRICES, *_PR_ARGS, "l_quantity = 23",
        [
            ("PRICE_SOURCE_PROVENANCE_VALID", "r.source_id NOT IN ('YAHOO_FINANCE', 'PROJECT_GIT_FIXTURE')", *_E),
            ("PRICE_INSTRUMENT_MAPPING", "ki.id IS NULL OR ki.symbol <> r.source_symbol", *_Q),
            ("PRICE_POSITIVE_VALUES", "least(r.open_price, r.high_price, r.low_price, r.close_price, r.adjusted_close_price) <= 0", *_E),
            ("PRICE_OHLC_CONSISTENCY", "r.high_price < greatest(r.open_price, r.low_price, r.close_price) OR r.low_price > least(r.open_price, r.high_price, r.close_price)", *_E),
            ("PRICE_VOLUME_MISSING_OR_ZERO", "r.volume IS NULL OR r.volume = 0", *_W),
            ("PRICE_VOLUME_NEGATIVE", "r.volume < 0", *_E),
            ("PRICE_VALID_SESSION", "NOT COALESCE(ki.id IS NOT NULL AND kd.is_session, FALSE)", *_E),
            ("PRICE_SUPPORTED_CURRENCY", "r.quote_currency <> 'USD'", *_Q),
            ("PRICE_CONTRACT_VERSION_VALID", "r.contract_version <> '1.0.0'", *_E),
        ],
        _MAPPED, "LEFT JOIN ki ON ki.id = r.instrument_id LEFT JOIN kd ON kd.day = r.price_date",
    )
)
def price_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = C.DAILY_PRICES.typed(_raw(spark, sf_dir, *_PR_ARGS, C.DAILY_PRICES, "l_quantity = 23"))
    rows = D.enriched(typed, *_mapped(spark, sf_dir), "price_date")
    return _found(rows, C.DAILY_PRICES.rules() + D.price_rules())


# ---- actions: events ------------------------------------------------------------------------------------------------

_AMOUNT = "CAST(CAST(CAST(value AS DECIMAL(18,2)) AS DECIMAL(20,8)) AS STRING)"
_ACTION: Fields = {
    "instrument_id": "concat('U_', CAST(user_id AS STRING))",
    "effective_date": "CAST(CAST(ts AS DATE) AS STRING)",
    "action_type": "CASE WHEN event_type IN ('click', 'purchase') THEN 'CASH_DIVIDEND' WHEN event_type = 'signup' THEN 'SPIN_OFF' ELSE 'STOCK_SPLIT' END",
    "source_id": "CASE WHEN user_id = 5 THEN 'OTHER' ELSE 'PROJECT_GIT_FIXTURE' END",
    "source_symbol": "CASE WHEN user_id = 6 THEN 'Z' ELSE concat('Y', CAST(user_id AS STRING)) END",
    "dividend_amount_per_share": f"CASE WHEN event_type IN ('click', 'purchase') THEN {_AMOUNT} ELSE '' END",
    "dividend_currency": "CASE WHEN event_type IN ('click', 'purchase') THEN CASE WHEN user_id = 7 THEN 'EUR' ELSE 'USD' END ELSE '' END",
    "split_ratio": "CASE WHEN event_type = 'view' THEN '2.0000000000' WHEN event_type = 'error' THEN '1.0000000000' WHEN event_type = 'purchase' AND user_id = 8 THEN '3.0000000000' WHEN event_type = 'signup' AND user_id = 9 THEN 'half' ELSE '' END",
    "source_action_id": "''",
    "source_updated_at_utc": "''",
    "source_record_id": "CAST(event_id AS STRING)",
    "contract_version": "CASE WHEN user_id = 10 THEN '2.0.0' ELSE '1.0.0' END",
}
_AC_ARGS = ("events", _ACTION, "CAST(event_id AS STRING)")


@query(
    _sql(
        C.CORPORATE_ACTIONS, *_AC_ARGS, "user_id = 11",
        [
            ("ACTION_SOURCE_PROVENANCE_VALID", "r.source_id NOT IN ('YAHOO_FINANCE', 'PROJECT_GIT_FIXTURE')", *_E),
            ("ACTION_INSTRUMENT_MAPPING", "ki.id IS NULL OR ki.symbol <> r.source_symbol", *_Q),
            ("ACTION_EFFECTIVE_SESSION", "NOT COALESCE(ki.id IS NOT NULL AND dayofweek(r.effective_date) NOT IN (0, 6), FALSE)", *_Q),
            ("ACTION_TYPE_ALLOWED", "r.action_type NOT IN ('CASH_DIVIDEND', 'STOCK_SPLIT')", *_E),
            ("ACTION_DIVIDEND_FIELDS", "r.action_type = 'CASH_DIVIDEND' AND (r.dividend_amount_per_share IS NULL OR r.dividend_amount_per_share <= 0 OR r.dividend_currency IS DISTINCT FROM 'USD' OR r.split_ratio IS NOT NULL)", *_E),
            ("ACTION_SPLIT_FIELDS", "r.action_type = 'STOCK_SPLIT' AND (r.split_ratio IS NULL OR r.split_ratio <= 0 OR r.split_ratio = 1 OR r.dividend_amount_per_share IS NOT NULL OR r.dividend_currency IS NOT NULL)", *_E),
            ("ACTION_CONTRACT_VERSION_VALID", "r.contract_version <> '1.0.0'", *_E),
        ],
        "ki AS (SELECT DISTINCT concat('U_', CAST(user_id AS STRING)) AS id, concat('Y', CAST(user_id AS STRING)) AS symbol FROM events WHERE user_id <> 4), ", "LEFT JOIN ki ON ki.id = r.instrument_id",
    )
)
def action_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = T.table(spark, sf_dir, "events")
    instruments = events.selectExpr("user_id").distinct().selectExpr("concat('U_', cast(user_id as string)) as instrument_id", "concat('Y', cast(user_id as string)) as yfinance_symbol", "'USD' as quote_currency", "'XNAS' as exchange_mic", "user_id <> 4 as is_active")
    days = events.selectExpr("cast(ts as date) as calendar_date").distinct().selectExpr("'XNAS' as exchange_mic", "calendar_date", "dayofweek(calendar_date) between 2 and 6 as is_trading_day")
    rows = D.enriched(C.CORPORATE_ACTIONS.typed(_raw(spark, sf_dir, *_AC_ARGS, C.CORPORATE_ACTIONS, "user_id = 11")), instruments, days, "effective_date")
    return _found(rows, C.CORPORATE_ACTIONS.rules() + D.action_rules())
