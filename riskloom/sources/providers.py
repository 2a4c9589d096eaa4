"""Provider rows brought into the canonical form of prices and corporate actions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.expr import record_hash

_PRICES = ("open_price", "high_price", "low_price", "close_price", "adjusted_close_price")


def normalised_prices(rows: DataFrame) -> DataFrame:
    """Prices rounded half up to eight digits, whether high and low bound the others, and the record's hash."""
    exact = {c: F.round(F.col(c).cast("decimal(28,14)"), 8).cast("decimal(20,8)") for c in _PRICES}
    out = rows.withColumns(exact)
    o, h, low, c = (F.col(x) for x in _PRICES[:4])
    out = out.withColumn("is_consistent", (h >= F.greatest(o, low, c)) & (low <= F.least(o, h, c)))
    return out.withColumn("record_hash", record_hash(["instrument_id", "price_date", "source_id", *_PRICES, "quote_currency"]))


def normalised_actions(rows: DataFrame) -> DataFrame:
    """Dividends or splits from rows that give both amounts: neither is dropped, both at once is an error."""
    amount, split = F.coalesce(F.col("dividend").cast("decimal(20,8)"), F.lit(0)), F.coalesce(F.col("split").cast("decimal(20,10)"), F.lit(0))
    has_split = (split != 0) & (split != 1)
    kind = F.when((amount > 0) & has_split, F.lit("ERROR")).when(amount > 0, "CASH_DIVIDEND").when(has_split, "STOCK_SPLIT")
    out = rows.withColumn("action_type", kind).where("action_type is not null")
    return out.withColumns({"dividend_amount_per_share": F.when(F.col("action_type") == "CASH_DIVIDEND", amount), "split_ratio": F.when(F.col("action_type") == "STOCK_SPLIT", split)})
