"""Data contracts: one declaration from which schemas, casts, keys, hashes and basic rules follow."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from riskloom.functions.expr import business_key, castable, is_blank, record_hash, try_cast
from riskloom.operators.rules import Rule


@dataclass(frozen=True)
class Field:
    name: str
    kind: str = "string"
    nullable: bool = False
    allowed: tuple[str, ...] = ()
    pattern: str = ""


@dataclass(frozen=True)
class Contract:
    """hash_fields are hashed as typed values, or as the raw texts with ``raw_hash``."""

    name: str
    version: str
    fields: tuple[Field, ...]
    key: tuple[str, ...]
    hash_fields: tuple[str, ...] = ()
    raw_hash: bool = False
    rule_prefix: str = ""
    extra_rules: tuple[Rule, ...] = field(default_factory=tuple)

    def raw_schema(self) -> StructType:
        return StructType([StructField(f.name, StringType()) for f in self.fields])

    def schema(self) -> StructType:
        return StructType([StructField(f.name, _parse_datatype_string(f.kind), f.nullable) for f in self.fields])

    def typed(self, raw: DataFrame) -> DataFrame:
        """Typed columns under their names, the source's texts as raw_<name>, computed_hash and business_key."""
        others = [c for c in raw.columns if c not in {f.name for f in self.fields}]
        texts = raw.select(*others, *[F.col(f.name).alias(f"raw_{f.name}") for f in self.fields])
        out = texts.select("*", *[try_cast(f"raw_{f.name}", f.kind).alias(f.name) for f in self.fields])
        hashed = [f"raw_{c}" if self.raw_hash else c for c in self.hash_fields]
        if hashed:
            out = out.withColumn("computed_hash", record_hash(hashed))
        return out.withColumn("business_key", business_key([f"raw_{c}" for c in self.key]))

    def rules(self) -> list[Rule]:
        """Required fields, castable values, allowed values, formats and the record hash."""
        prefix = self.rule_prefix or self.name.upper()
        required = [F.col(f.name).isNull() for f in self.fields if not f.nullable]
        lost = [~castable(f"raw_{f.name}", f.name) for f in self.fields if f.kind != "string"]
        closed = [~F.col(f.name).isin(*f.allowed) for f in self.fields if f.allowed]
        shaped = [~F.col(f.name).rlike(f.pattern) for f in self.fields if f.pattern]
        out = [Rule(f"{prefix}_{name}", _any(parts)) for name, parts in (("REQUIRED_FIELDS", required), ("TYPES_CASTABLE", lost), ("ALLOWED_VALUES", closed), ("ID_FORMAT", shaped)) if parts]
        if self.hash_fields and "record_hash" in {f.name for f in self.fields}:
            out.append(Rule(f"{prefix}_RECORD_HASH_VALID", F.col("record_hash") != F.col("computed_hash")))
        return [*out, *self.extra_rules]

    def blank_required(self) -> Column:
        return _any([is_blank(f"raw_{f.name}") for f in self.fields if not f.nullable])


def _any(parts: list[Column]) -> Column:
    """True if any part is true; parts that are null count as false."""
    return reduce(lambda a, b: a | b, [F.coalesce(p, F.lit(False)) for p in parts], F.lit(False))


_ID = r"^[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*$"


def _fields(text: str, allowed: dict[str, tuple[str, ...]]) -> tuple[Field, ...]:
    """Fields from lines of a name and, unless it is a string, a type; one that ends in ? is nullable."""
    out = []
    for line in text.split("\n"):
        name, _, kind = line.strip().partition(" ")
        if name:
            pattern = _ID if name in ("portfolio_id", "instrument_id", "scenario_id") else ""
            out.append(Field(name, kind.rstrip("?") or "string", kind.endswith("?"), allowed.get(name, ()), pattern))
    return tuple(out)


def _contract(name: str, prefix: str, key: str, fields: str, raw_hash: bool = False, allowed: dict[str, tuple[str, ...]] | None = None) -> Contract:
    parsed = _fields(fields, allowed or {})
    return Contract(name, "1.0.0", parsed, tuple(key.split()), tuple(f.name for f in parsed if f.name != "record_hash"), raw_hash, prefix)


# Fixed names, types and closed lists of the domain's datasets.

PORTFOLIOS = _contract(
    "portfolios", "PORTFOLIO", "portfolio_id",
    """
    portfolio_id
    portfolio_name
    strategy_code
    base_currency
    target_inception_date date
    actual_inception_date date?
    initial_nav decimal(18,2)
    target_long_ratio decimal(12,10)
    target_short_ratio decimal(12,10)
    target_gross_ratio decimal(12,10)
    target_net_ratio decimal(12,10)
    rebalance_policy
    cash_policy
    is_active boolean
    config_version
    record_hash
    """,
    raw_hash=True,
    allowed={
        "strategy_code": ("LONG_ONLY", "LONG_SHORT_130_30"),
        "base_currency": ("USD",),
        "rebalance_policy": ("BUY_AND_HOLD",),
        "cash_policy": ("RETAIN_DIVIDENDS_NO_INTEREST",),
    },
)

INSTRUMENTS = _contract(
    "instruments", "INSTRUMENT", "instrument_id",
    """
    instrument_id
    display_symbol
    yfinance_symbol
    instrument_name
    asset_class
    security_type
    exchange_mic
    quote_currency
    issuer_country_code
    official_sector_name
    risk_cluster_id
    classification_source
    classification_as_of_date date
    active_from date
    active_to date?
    is_active boolean
    config_version
    record_hash
    """,
    allowed={
        "asset_class": ("EQUITY",),
        "security_type": ("COMMON_STOCK", "ADR"),
        "exchange_mic": ("XNAS", "XNYS"),
        "quote_currency": ("USD",),
        "issuer_country_code": ("US", "TW"),
        "official_sector_name": (
            "Communication Services", "Consumer Discretionary", "Consumer Staples", "Energy", "Financials", "Health Care", "Industrials", "Information Technology",
        ),
        "risk_cluster_id": (
            "SYSTEMIC_CORE_TECHNOLOGY", "SEMICONDUCTOR_INFRASTRUCTURE", "CONSUMER_AND_LOGISTICS", "HEALTHCARE_AND_POLICY_SENSITIVITY", "FINANCIAL_FOUNDATIONS", "MACRO_AND_GEOPOLITICAL_SENSITIVITY",
        ),
    },
)

TARGET_ALLOCATIONS = _contract(
    "target_allocations", "ALLOCATION", "portfolio_id instrument_id effective_from",
    """
    portfolio_id
    instrument_id
    effective_from date
    effective_to date?
    target_weight decimal(12,10)
    allocation_version
    record_hash
    """,
)

STRESS_SCENARIOS = _contract(
    "stress_scenarios", "SCENARIO", "scenario_id",
    """
    scenario_id
    scenario_name
    scenario_description
    scenario_type
    is_active boolean
    scenario_version
    effective_from date
    effective_to date?
    record_hash
    """,
)

STRESS_SCENARIO_SHOCKS = _contract(
    "stress_scenario_shocks", "SHOCK", "scenario_id instrument_id",
    """
    scenario_id
    instrument_id
    shock_ratio decimal(12,10)
    shock_rationale
    scenario_version
    record_hash
    """,
)

DAILY_PRICES = _contract(
    "daily_prices", "PRICE", "instrument_id price_date source_id",
    """
    instrument_id
    price_date date
    source_id
    source_symbol
    open_price decimal(20,8)
    high_price decimal(20,8)
    low_price decimal(20,8)
    close_price decimal(20,8)
    adjusted_close_price decimal(20,8)
    volume bigint?
    quote_currency
    source_updated_at_utc timestamp?
    source_record_id
    record_hash
    """,
)

CORPORATE_ACTIONS = _contract(
    "corporate_actions", "ACTION", "instrument_id effective_date action_type source_id",
    """
    instrument_id
    effective_date date
    action_type
    source_id
    source_symbol
    dividend_amount_per_share decimal(20,8)?
    dividend_currency string?
    split_ratio decimal(20,10)?
    source_action_id string?
    source_updated_at_utc timestamp?
    source_record_id
    record_hash
    """,
)

TRADING_CALENDAR = _contract(
    "trading_calendar", "CALENDAR", "exchange_mic calendar_date",
    """
    exchange_mic
    calendar_date date
    is_trading_day boolean
    market_open_utc timestamp?
    market_close_utc timestamp?
    is_early_close boolean
    holiday_name string?
    exchange_timezone
    calendar_source
    calendar_version
    generated_at_utc timestamp
    record_hash
    """,
)

CONTRACTS = {c.name: c for c in (PORTFOLIOS, INSTRUMENTS, TARGET_ALLOCATIONS, STRESS_SCENARIOS, STRESS_SCENARIO_SHOCKS, DAILY_PRICES, CORPORATE_ACTIONS, TRADING_CALENDAR)}
