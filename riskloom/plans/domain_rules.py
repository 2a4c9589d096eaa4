"""The executable rules of prices, actions, portfolios, instruments, allocations, scenarios and shocks.

Rules refer to the columns of ``Contract.typed``, for prices and actions of ``enriched`` and lineage, for allocations and shocks of
``referenced`` and ``scenario_versions``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.expr import semver
from riskloom.operators.rules import QUARANTINE, WARN, WARNING, Rule

#: Fixed values of the domain.
PRICE_SOURCES = ("YAHOO_FINANCE", "PROJECT_GIT_FIXTURE")
STRATEGY_RATIOS = {"LONG_ONLY": (1.0, 0.0, 1.0, 1.0), "LONG_SHORT_130_30": (1.3, 0.3, 1.6, 1.0)}
TOLERANCE = 1e-6
SCENARIO_TYPE = "DETERMINISTIC_HYPOTHETICAL"
SCENARIOS = ("BROAD_MARKET_DOWN_10", "TECHNOLOGY_CORRECTION", "GEOPOLITICAL_SUPPLY_SHOCK")


def enriched(typed: DataFrame, instruments: DataFrame, calendar: DataFrame, date_col: str) -> DataFrame:
    """Rows with their active instrument (mapped_id, mapped_symbol, mapped_currency) and calendar day (is_session).

    Both sides are dimension tables; whether to broadcast them is left to the optimizer, which knows their size.
    """
    active = instruments.where("is_active").select(F.col("instrument_id").alias("mapped_id"), F.col("yfinance_symbol").alias("mapped_symbol"), F.col("quote_currency").alias("mapped_currency"), F.col("exchange_mic").alias("mapped_mic"))
    days = calendar.select(F.col("exchange_mic").alias("day_mic"), F.col("calendar_date").alias("day"), F.col("is_trading_day").alias("is_session"))
    rows = typed.join(active, F.col("instrument_id") == F.col("mapped_id"), "left")
    return rows.join(days, (F.col("mapped_mic") == F.col("day_mic")) & (F.col(date_col) == F.col("day")), "left")


def referenced(rows: DataFrame, **others: tuple[DataFrame, list[str]]) -> DataFrame:
    """Rows with a flag ``has_<name>`` for each other table (frame, shared key columns): whether it holds the row's key.

    The other tables are dimensions with one row a key; whether to broadcast them is left to the optimizer.
    """
    for name, (other, keys) in others.items():
        known = other.select(*[F.col(k).alias(f"__{k}") for k in keys], F.lit(True).alias("__known")).distinct()
        on = [F.col(k) == F.col(f"__{k}") for k in keys]
        rows = rows.join(known, on, "left").withColumn(f"has_{name}", F.coalesce("__known", F.lit(False))).drop("__known", *[f"__{k}" for k in keys])
    return rows


def scenario_versions(shocks: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Shocks with their scenario's version (current_scenario_version)."""
    own = scenarios.select(F.col("scenario_id").alias("__sid"), F.col("scenario_version").alias("current_scenario_version"))
    return shocks.join(own, F.col("scenario_id") == F.col("__sid"), "left").drop("__sid")


def _contract_version(prefix: str, version: str = "1.0.0") -> Rule:
    return Rule(f"{prefix}_CONTRACT_VERSION_VALID", ~F.col("contract_version").eqNullSafe(version), field_name="contract_version", expected=version, observed=("contract_version",))


def price_rules() -> list[Rule]:
    o, h, low, c, a = (F.col(f"{x}_price") for x in ("open", "high", "low", "close", "adjusted_close"))
    return [
        Rule("PRICE_SOURCE_PROVENANCE_VALID", ~F.col("source_id").isin(*PRICE_SOURCES)),
        Rule("PRICE_INSTRUMENT_MAPPING", F.col("mapped_id").isNull() | (F.col("mapped_symbol") != F.col("source_symbol")), disposition=QUARANTINE),
        Rule("PRICE_POSITIVE_VALUES", F.least(o, h, low, c, a) <= 0),
        Rule("PRICE_OHLC_CONSISTENCY", (h < F.greatest(o, low, c)) | (low > F.least(o, h, c))),
        Rule("PRICE_VOLUME_MISSING_OR_ZERO", F.col("volume").isNull() | (F.col("volume") == 0), severity=WARNING, disposition=WARN),
        Rule("PRICE_VOLUME_NEGATIVE", F.col("volume") < 0),
        Rule("PRICE_VALID_SESSION", ~F.coalesce(F.col("is_session"), F.lit(False))),
        Rule("PRICE_SUPPORTED_CURRENCY", (F.col("quote_currency") != "USD") | (F.col("quote_currency") != F.col("mapped_currency")), disposition=QUARANTINE),
        _contract_version("PRICE"),
    ]


def action_rules() -> list[Rule]:
    dividend, split = F.col("action_type") == "CASH_DIVIDEND", F.col("action_type") == "STOCK_SPLIT"
    amount, ratio, currency = F.col("dividend_amount_per_share"), F.col("split_ratio"), F.col("dividend_currency")
    return [
        Rule("ACTION_SOURCE_PROVENANCE_VALID", ~F.col("source_id").isin(*PRICE_SOURCES)),
        Rule("ACTION_INSTRUMENT_MAPPING", F.col("mapped_id").isNull() | (F.col("mapped_symbol") != F.col("source_symbol")), disposition=QUARANTINE),
        Rule("ACTION_EFFECTIVE_SESSION", ~F.coalesce(F.col("is_session"), F.lit(False)), disposition=QUARANTINE),
        Rule("ACTION_TYPE_ALLOWED", ~F.col("action_type").isin("CASH_DIVIDEND", "STOCK_SPLIT")),
        Rule("ACTION_DIVIDEND_FIELDS", dividend & (amount.isNull() | (amount <= 0) | ~currency.eqNullSafe("USD") | ratio.isNotNull())),
        Rule("ACTION_SPLIT_FIELDS", split & (ratio.isNull() | (ratio <= 0) | (ratio == 1) | amount.isNotNull() | currency.isNotNull())),
        _contract_version("ACTION"),
    ]


def portfolio_rules() -> list[Rule]:
    lo, sh, gr, ne = (F.col(f"target_{x}_ratio").cast("double") for x in ("long", "short", "gross", "net"))
    off = F.lit(False)
    for name, values in STRATEGY_RATIOS.items():
        wrong = F.lit(False)
        for column, value in zip((lo, sh, gr, ne), values, strict=True):
            wrong = wrong | (F.abs(column - value) > TOLERANCE)
        off = off | ((F.col("strategy_code") == name) & wrong)
    return [
        Rule("PORTFOLIO_ACTUAL_INCEPTION_DATE_MISSING", F.col("actual_inception_date").isNull(), severity=WARNING, disposition=WARN),
        Rule("PORTFOLIO_INITIAL_NAV_POSITIVE", F.col("initial_nav") <= 0),
        Rule("PORTFOLIO_RATIO_RECONCILIATION", (F.abs(gr - lo - sh) > TOLERANCE) | (F.abs(ne - lo + sh) > TOLERANCE)),
        Rule("PORTFOLIO_STRATEGY_TARGETS", off),
        Rule("PORTFOLIO_INCEPTION_ORDER", F.col("actual_inception_date") < F.col("target_inception_date")),
        Rule("PORTFOLIO_CONFIG_VERSION_VALID", semver("config_version").isNull()),
    ]


def instrument_rules() -> list[Rule]:
    return [
        Rule("INSTRUMENT_ACTIVE_DATE_RANGE", F.col("active_to") < F.col("active_from")),
        Rule("INSTRUMENT_CLASSIFICATION_REQUIRED", F.col("is_active") & (F.col("official_sector_name").isNull() | F.col("classification_source").isNull() | F.col("classification_as_of_date").isNull())),
        Rule("INSTRUMENT_CONFIG_VERSION_VALID", semver("config_version").isNull()),
    ]


def allocation_rules() -> list[Rule]:
    return [
        Rule("ALLOCATION_WEIGHT_NONZERO", F.col("target_weight") == 0),
        Rule("ALLOCATION_EFFECTIVE_DATE_RANGE", F.col("effective_to") < F.col("effective_from")),
        Rule("ALLOCATION_VERSION_VALID", semver("allocation_version").isNull()),
        Rule("ALLOCATION_FOREIGN_KEYS", ~F.col("has_portfolio") | ~F.col("has_instrument")),
    ]


def scenario_rules() -> list[Rule]:
    text = F.lower("scenario_description")
    return [
        Rule("SCENARIO_LANGUAGE_HYPOTHETICAL", ~text.contains("hypothetical") | text.contains("forecast")),
        Rule("SCENARIO_EFFECTIVE_RANGE", F.col("effective_to") < F.col("effective_from")),
        Rule("SCENARIO_VERSION_VALID", semver("scenario_version").isNull()),
        Rule("SCENARIO_TYPE_VALID", F.col("scenario_type") != SCENARIO_TYPE, field_name="scenario_type", expected=SCENARIO_TYPE, observed=("scenario_type",)),
    ]


def shock_rules() -> list[Rule]:
    return [
        Rule("SHOCK_MINIMUM_VALID", F.col("shock_ratio") < -1),
        Rule("SHOCK_EXTREME_GAIN_REVIEW", F.col("shock_ratio") > 1, severity=WARNING, disposition=WARN),
        Rule("SHOCK_FOREIGN_KEYS", ~F.col("has_scenario") | ~F.col("has_instrument")),
        Rule("SHOCK_VERSION_MATCH", F.col("scenario_version") != F.col("current_scenario_version")),
        Rule("SHOCK_RATIONALE_REQUIRED", F.trim("shock_rationale") == ""),
        Rule("SHOCK_BROAD_MARKET_BASELINE", (F.col("scenario_id") == "BROAD_MARKET_DOWN_10") & (F.col("shock_ratio") != F.lit("-0.1").cast("decimal(12,10)"))),
    ]
