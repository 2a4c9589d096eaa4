"""Positions, cash and valuation for all portfolios and dates at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.digests import ordered_set_sha256
from riskloom.functions.expr import AMOUNT, MONEY, PRICE, QUANTITY, WEIGHT, product, record_hash, share


def inception_quantities(allocations: DataFrame, navs: DataFrame, closes: DataFrame) -> DataFrame:
    """signed_quantity = target_weight * initial_nav / close: allocations (portfolio_id, instrument_id, target_weight) with
    navs (portfolio_id, initial_nav) and closes (instrument_id, close_price)."""
    rows = allocations.join(navs, "portfolio_id").join(closes, "instrument_id")
    money = (F.col("target_weight").cast(WEIGHT) * F.col("initial_nav").try_cast("decimal(20,2)")).try_cast(MONEY)
    return rows.withColumn("signed_quantity", (money / F.nullif(F.col("close_price").try_cast("decimal(14,4)"), F.lit(0).cast("decimal(14,4)"))).try_cast(QUANTITY))


#: Ten digits of a running product of splits; 17 digits in front of them.
SPLIT = "decimal(27,10)"


def split_multipliers(actions: DataFrame) -> DataFrame:
    """Per instrument and date: the product of the split ratios, rounded to ten digits at every step, in source order.

    split_set_sha256 is the digest of the splits' hashes in the same order. A product that no longer fits is null.
    """
    ordered = F.array_sort(F.collect_list(F.struct("source_record_id", F.col("split_ratio").cast("decimal(20,10)").alias("r"))))
    multiplier = F.aggregate(ordered, F.lit(1).cast(SPLIT), lambda acc, x: _compounded(acc, x["r"]))
    splits = actions.where((F.col("action_type") == "STOCK_SPLIT") & F.col("split_ratio").isNotNull()).withColumn("__hash", record_hash(["instrument_id", "effective_date", "source_record_id", F.col("split_ratio").cast("decimal(20,10)")]))
    return splits.groupBy("instrument_id", F.col("effective_date").alias("position_date")).agg(multiplier.alias("split_multiplier"), F.count(F.lit(1)).alias("split_count"), ordered_set_sha256(F.col("__hash"), F.col("source_record_id")).alias("split_set_sha256"))


def _compounded(acc: Column, ratio: Column) -> Column:
    """acc * ratio; Spark rounds a product of (27,10) and (20,10) half up to ten digits."""
    return (acc * ratio.try_cast("decimal(20,10)")).try_cast(SPLIT)


def carry_forward(inception: DataFrame, sessions: DataFrame, multipliers: DataFrame) -> DataFrame:
    """Quantities on every session from inception on: each day's is that of the day before times the day's splits.

    Each position folds its instrument's splits once into ranges of dates with their quantity and running product; the sessions, one
    sorted array of the calendar, are then dealt to the ranges. No join compares dates, and nothing loops over them. inception has
    portfolio_id, instrument_id, position_date, signed_quantity; sessions has position_date.
    """
    folded = multipliers.groupBy("instrument_id").agg(F.array_sort(F.collect_list(F.struct("position_date", "split_multiplier"))).alias("__splits"))
    calendar = sessions.agg(F.array_sort(F.collect_set("position_date")).alias("__days"))
    grid = inception.withColumnRenamed("position_date", "inception_date").join(folded, "instrument_id", "left").crossJoin(F.broadcast(calendar))  # one row
    ranges = f"array<struct<since:date,factor:{SPLIT},quantity:{QUANTITY}>>"
    first = F.array(F.struct(F.col("inception_date").alias("since"), F.lit(1).cast(SPLIT).alias("factor"), F.col("signed_quantity").try_cast(QUANTITY).alias("quantity"))).cast(ranges)
    own = F.filter(F.coalesce("__splits", F.array().cast(f"array<struct<position_date:date,split_multiplier:{SPLIT}>>")), lambda s: s["position_date"] > F.col("inception_date"))

    def split(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.concat(acc, F.array(F.struct(s["position_date"].alias("since"), _compounded(last["factor"], s["split_multiplier"]).alias("factor"), product(last["quantity"], s["split_multiplier"]).alias("quantity"))))

    grid = grid.withColumn("__steps", F.aggregate(own, first, split)).select(*[c for c in grid.columns if c != "__splits"], F.posexplode("__steps").alias("__at", "__step"), F.expr("try_element_at(__steps, __at + 2).since").alias("__until"))
    here = F.filter("__days", lambda d: (d >= F.col("__step.since")) & (F.col("__until").isNull() | (d < F.col("__until"))))
    rows = grid.select(*[c for c in grid.columns if not c.startswith("__")], F.col("__step.factor").alias("cumulative_split"), F.col("__step.quantity").alias("carried_quantity"), F.explode(here).alias("position_date"))
    return rows.withColumn("basis", F.when(F.col("position_date") == F.col("inception_date"), "INCEPTION").otherwise("CARRY_FORWARD"))


def _complete(dates: DataFrame, key: str, expected: int | DataFrame, date_col: str) -> DataFrame:
    """Per date the number of distinct keys and whether it is the expected one: a number, or one row with column ``expected``."""
    counts = dates.groupBy(date_col).agg(F.count_distinct(key).alias("key_count"))
    if isinstance(expected, DataFrame):
        counts = counts.crossJoin(F.broadcast(expected.select(F.col("expected").alias("__expected"))))  # one row
    else:
        counts = counts.withColumn("__expected", F.lit(expected))
    return counts.withColumn("is_complete", F.col("key_count") == F.col("__expected")).drop("__expected")


def previous_complete(dates: DataFrame, key: str, expected: int | DataFrame, date_col: str = "price_date") -> DataFrame:
    """Dates on which ``expected`` distinct keys are present, with the one before each."""
    complete = _complete(dates, key, expected, date_col).where("is_complete").drop("is_complete")
    # one row a date: the single window task holds the calendar, not the data
    return complete.withColumn("previous_date", F.lag(date_col).over(Window.orderBy(date_col)))


def previous_complete_asof(dates: DataFrame, key: str, expected: int | DataFrame, date_col: str = "price_date") -> DataFrame:
    """For every date present, the latest earlier complete date (null if there is none)."""
    before = Window.orderBy(date_col).rowsBetween(Window.unboundedPreceding, -1)
    return _complete(dates, key, expected, date_col).withColumn("previous_complete_date", F.max(F.when(F.col("is_complete"), F.col(date_col))).over(before))


def dividend_flows(positions: DataFrame, dividends: DataFrame) -> DataFrame:
    """Cash that dividends bring per portfolio and date: the quantity of the session before times the amount per share.

    positions (portfolio_id, instrument_id, position_date, signed_quantity) hold every session once; dividends (instrument_id,
    effective_date, dividend_amount_per_share) may be several a day. Short positions pay. Dates without dividends have flow 0.
    """
    by_date = Window.partitionBy("portfolio_id", "instrument_id").orderBy("position_date")
    held = positions.withColumn("prior_quantity", F.lag("signed_quantity").over(by_date))
    paid = dividends.groupBy("instrument_id", F.col("effective_date").alias("position_date")).agg(F.sum("dividend_amount_per_share").alias("per_share"))
    flow = F.coalesce(product(F.col("prior_quantity"), F.col("per_share")), F.lit(0).cast(QUANTITY))
    rows = held.join(paid, ["instrument_id", "position_date"], "left").withColumn("__flow", flow)
    return rows.groupBy("portfolio_id", F.col("position_date").alias("cash_date")).agg(F.sum("__flow").cast(AMOUNT).alias("dividend_flow"), F.count("per_share").alias("dividend_positions"))


def opening_cash(navs: DataFrame, values: DataFrame) -> DataFrame:
    """Cash at inception: the initial NAV less the net market value of the first positions (portfolio_id, initial_cash)."""
    first = values.groupBy("portfolio_id").agg(F.sum("signed_market_value").alias("__value"))
    return navs.join(first, "portfolio_id", "left").select("portfolio_id", (F.col("initial_nav").cast(AMOUNT) - F.coalesce("__value", F.lit(0)).cast(AMOUNT)).cast(AMOUNT).alias("initial_cash"))


def cash_roll_forward(flows: DataFrame) -> DataFrame:
    """Opening and closing cash: flows (portfolio_id, cash_date, initial_cash, dividend_flow), one row per portfolio and date."""
    upto = Window.partitionBy("portfolio_id").orderBy("cash_date").rowsBetween(Window.unboundedPreceding, 0)
    closing = F.first("initial_cash").over(upto) + F.sum("dividend_flow").over(upto)
    return flows.withColumn("closing_cash", closing.cast("decimal(38,6)")).withColumn("opening_cash", (F.col("closing_cash") - F.col("dividend_flow")).cast("decimal(38,6)"))


def market_values(positions: DataFrame) -> DataFrame:
    """signed and absolute market value and side of rows with signed_quantity and close_price."""
    signed = product(F.col("signed_quantity"), F.col("close_price"))
    side: Column = F.when(F.col("signed_quantity") >= 0, "LONG").otherwise("SHORT")
    return positions.withColumns({"signed_market_value": signed, "absolute_market_value": F.abs(signed), "position_side": side})


def daily_metrics(values: DataFrame, cash: DataFrame, initial_nav: Column | None = None) -> DataFrame:
    """Exposures, NAV, P&L, return and ratios per portfolio and date.

    values has portfolio_id, valuation_date and signed_market_value; cash has portfolio_id, valuation_date and closing_cash.
    P&L is against the previous NAV, or ``initial_nav`` on a portfolio's first date; ratios have eighteen digits, and
    division by nothing or less gives 0.
    """
    v = F.col("signed_market_value")
    sums = values.groupBy("portfolio_id", "valuation_date").agg(
        F.count(F.lit(1)).alias("position_count"),
        F.sum(F.when(v > 0, v).otherwise(0)).cast(AMOUNT).alias("long_value"),
        F.sum(F.when(v < 0, -v).otherwise(0)).cast(AMOUNT).alias("short_value"),
    )
    rows = sums.join(cash, ["portfolio_id", "valuation_date"], "left").withColumn("cash", F.coalesce("closing_cash", F.lit(0)).cast(AMOUNT)).drop("closing_cash")
    rows = rows.withColumns({"gross_value": (F.col("long_value") + F.col("short_value")).cast(AMOUNT), "net_value": (F.col("long_value") - F.col("short_value")).cast(AMOUNT)})
    rows = rows.withColumn("nav", (F.col("net_value") + F.col("cash")).cast(AMOUNT))
    before = F.lag("nav").over(Window.partitionBy("portfolio_id").orderBy("valuation_date"))
    rows = rows.withColumn("baseline", F.coalesce(before, initial_nav if initial_nav is not None else F.col("nav")).cast(AMOUNT))
    rows = rows.withColumn("pnl", (F.col("nav") - F.col("baseline")).cast(AMOUNT))

    ratios = {"daily_return": ("pnl", "baseline"), "long_ratio": ("long_value", "nav"), "short_ratio": ("short_value", "nav"), "gross_ratio": ("gross_value", "nav"), "net_ratio": ("net_value", "nav")}
    return rows.withColumns({name: share(F.col(a), F.col(b)) for name, (a, b) in ratios.items()})


def closing_price(prices: DataFrame, source: str | None = None) -> DataFrame:
    """One close per instrument and date. The source is part of a price's key, so one has to be named where there are several."""
    rows = prices if source is None else prices.where(F.col("source_id") == source)
    return rows.select("instrument_id", "price_date", F.col("close_price").cast(PRICE))
