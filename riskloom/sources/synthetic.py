"""Deterministic synthetic prices from hashes: a market, a cluster and an own factor per date."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions.expr import record_hash


def basis_points(seed: str, label: Column, most: int) -> Column:
    """A whole number from -most to most, from the first eight hex digits of sha256(seed|label)."""
    digits = F.conv(F.substring(F.sha2(F.concat(F.lit(seed + "|"), label), 256), 1, 8), 16, 10).cast("bigint")
    return digits % (2 * most + 1) - most


def price_paths(instruments: DataFrame, dates: DataFrame, seed: str, market: int = 120, cluster: int = 55, own: int = 35, flat_every: int = 29) -> DataFrame:
    """Prices per instrument and date, each rounded half up to eight digits before the next.

    instruments has instrument_id, cluster_id and anchor_price; dates has price_date and date_index from 1. As every step rounds,
    the path is a fold over the instrument's ordered returns, one array per instrument.
    """
    day = F.col("price_date").cast("string")
    bp = basis_points(seed, F.concat(F.lit("MARKET|"), day), market) + basis_points(seed, F.concat(F.lit("CLUSTER|"), "cluster_id", F.lit("|"), day), cluster) + basis_points(seed, F.concat(F.lit("INSTRUMENT|"), "instrument_id", F.lit("|"), day), own)
    steps = instruments.crossJoin(dates).withColumn("bp", F.when(F.col("date_index") % flat_every == 0, 0).otherwise(bp))  # two small dimension tables
    paths = steps.groupBy("instrument_id", F.col("anchor_price").cast("decimal(20,8)").alias("anchor_price")).agg(F.array_sort(F.collect_list(F.struct("date_index", "price_date", "bp"))).alias("s"))
    start = F.struct(F.col("anchor_price").alias("p"), F.array().cast("array<decimal(20,8)>").alias("all"))

    def step(acc: Column, x: Column) -> Column:
        price = F.round(acc["p"].cast("decimal(18,8)") * (F.lit(10000) + x["bp"]).cast("decimal(6,0)") / F.lit(10000).cast("decimal(5,0)"), 8).cast("decimal(20,8)")
        return F.struct(price.alias("p"), F.concat(acc["all"], F.array(price)).alias("all"))

    folded = paths.withColumn("prices", F.aggregate("s", start, step, lambda acc: acc["all"]))
    return folded.select("instrument_id", F.inline(F.arrays_zip("s", "prices"))).select("instrument_id", F.col("s.price_date").alias("price_date"), F.col("s.bp").alias("return_bp"), F.col("prices").alias("close_price"))


def scenario_actions(spark: SparkSession, events: list[dict], source_id: str = "PROJECT_GIT_FIXTURE") -> DataFrame:
    """Corporate actions of a scenario, in the canonical form, ordered by instrument, date and kind.

    Each event gives instrument_id, effective_date, symbol and either dividend or split, as texts. ValueError where both or neither
    are given, for amounts that aren't positive, and for a split of 1.
    """
    rows = []
    for e in events:
        dividend, split = e.get("dividend"), e.get("split")
        if (dividend is None) == (split is None):
            raise ValueError(f"{e['instrument_id']}: either a dividend or a split")
        amount = Decimal(dividend if split is None else split)
        if amount <= 0 or (split is not None and amount == 1):
            raise ValueError(f"{e['instrument_id']}: not an amount: {amount}")
        kind = "CASH_DIVIDEND" if split is None else "STOCK_SPLIT"
        rows.append((e["instrument_id"], dt.date.fromisoformat(e["effective_date"]), kind, source_id, e["symbol"], amount if split is None else None, "USD" if split is None else None, None if split is None else amount))
    rows.sort(key=lambda r: r[:3])
    schema = "instrument_id string, effective_date date, action_type string, source_id string, source_symbol string, dividend_amount_per_share decimal(20,8), dividend_currency string, split_ratio decimal(20,10)"
    out = spark.createDataFrame(rows, schema)
    record = F.concat_ws(":", "source_id", "instrument_id", F.col("effective_date").cast("string"), "action_type")
    return out.withColumn("source_record_id", record).withColumn("record_hash", record_hash(out.columns))
