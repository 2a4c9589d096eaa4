"""Historical simulation, discrete Value at Risk, its components, and stress tests, for all runs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.expr import MONEY, RETURN, product, ratio

LEVELS = (0.95, 0.99)


def adjusted_returns(prices: DataFrame) -> DataFrame:
    """Simple returns of adjusted closes between adjacent dates of each instrument; first dates have none."""
    w = Window.partitionBy("instrument_id").orderBy("price_date")
    rows = prices.withColumns({"prior_date": F.lag("price_date").over(w), "prior_price": F.lag("adjusted_close_price").over(w)})
    simple = ratio(F.col("adjusted_close_price"), F.col("prior_price")) - F.lit(1)
    return rows.where("prior_price is not null").select("instrument_id", F.col("price_date").alias("scenario_date"), "prior_date", simple.cast(RETURN).alias("simple_return"))


def component_pnl(exposures: DataFrame, returns: DataFrame) -> DataFrame:
    """P&L per run, date and instrument: exposures has run_id, instrument_id and market_value."""
    pnl = F.col("market_value").try_cast(MONEY) * F.col("simple_return")
    return exposures.join(returns, "instrument_id").select("run_id", "scenario_date", "prior_date", "instrument_id", pnl.alias("pnl"))


def historical_pnl(exposures: DataFrame, returns: DataFrame) -> DataFrame:
    """P&L, loss (never clipped) and observation number per run and scenario date."""
    return price_scenarios(component_pnl(exposures, returns))


def price_scenarios(components: DataFrame) -> DataFrame:
    """``historical_pnl`` of components that are there already."""
    rows = components.groupBy("run_id", "scenario_date").agg(F.sum("pnl").alias("pnl"), F.max("prior_date").alias("prior_date"))
    by_date = Window.partitionBy("run_id").orderBy("scenario_date")
    return rows.withColumn("loss", -F.col("pnl")).withColumn("observation", F.row_number().over(by_date))


def ranked_losses(scenarios: DataFrame) -> DataFrame:
    """loss_rank from the smallest loss on, ties by date, and the number of observations of the run."""
    w = Window.partitionBy("run_id")
    return scenarios.withColumns({"loss_rank": F.row_number().over(w.orderBy("loss", "scenario_date")), "observations": F.count(F.lit(1)).over(w)})


def discrete_var(scenarios: DataFrame, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """The loss of rank ceil(level * n) per run and level; no interpolation."""
    ranked = ranked_losses(scenarios)
    each = ranked.withColumn("confidence_level", F.explode(F.array(*[F.lit(x).cast("decimal(3,2)") for x in levels])))
    return each.where(F.col("loss_rank") == F.ceil(F.col("confidence_level") * F.col("observations"))).select("run_id", "confidence_level", "observations", F.col("loss_rank").alias("var_rank"), "scenario_date", F.col("loss").alias("var_amount"))


def var_components(measures: DataFrame, components: DataFrame) -> DataFrame:
    """What each instrument adds to the VaR: its loss on the selected date; the sum over instruments is the VaR."""
    rows = measures.join(components, ["run_id", "scenario_date"]).withColumn("contribution", -F.col("pnl"))
    w = Window.partitionBy("run_id", "confidence_level")
    total = F.sum("contribution").over(w)
    return rows.withColumn("reconciles", total == F.col("var_amount")).withColumn("share", F.when(F.col("var_amount") != 0, F.col("contribution").cast("double") / F.col("var_amount").cast("double")))


def stress(exposures: DataFrame, shocks: DataFrame, navs: DataFrame) -> DataFrame:
    """Stress P&L and stressed NAV per run and scenario: shocks has scenario_id, instrument_id, shock_ratio; navs run_id and static_nav."""
    term = F.col("market_value").try_cast(MONEY) * F.col("shock_ratio").cast("decimal(12,10)")
    rows = exposures.join(shocks, "instrument_id").groupBy("run_id", "scenario_id").agg(F.sum(term).alias("stress_pnl"), F.count(F.lit(1)).alias("shock_count"))
    return rows.join(navs, "run_id").withColumn("stressed_nav", F.col("static_nav") + F.col("stress_pnl"))


def stress_reconciliation(results: DataFrame, recomputed: DataFrame, expected_shocks: int | None = None) -> DataFrame:
    """Stored against recomputed results: no match where either side lacks a row or an amount differs.

    has_all_shocks says whether the stored result rests on as many shocks as expected.
    """
    other = recomputed.select("run_id", "scenario_id", F.col("stress_pnl").alias("again_pnl"), F.col("stressed_nav").alias("again_nav"))
    rows = results.join(other, ["run_id", "scenario_id"], "full")
    same = F.col("stress_pnl").eqNullSafe(F.col("again_pnl")) & F.col("stressed_nav").eqNullSafe(F.col("again_nav"))
    rows = rows.withColumn("is_match", same)
    return rows if expected_shocks is None else rows.withColumn("has_all_shocks", F.coalesce(F.col("shock_count") == expected_shocks, F.lit(False)))


def static_exposures(positions: DataFrame, closes: DataFrame) -> DataFrame:
    """Frozen quantities at the closes of the as-of date: positions (run_id, instrument_id, signed_quantity) and closes
    (instrument_id, close_price) give run_id, instrument_id and market_value; a position without a close has none (null)."""
    rows = positions.join(closes.select("instrument_id", "close_price"), "instrument_id", "left")
    return rows.select("run_id", "instrument_id", product(F.col("signed_quantity"), F.col("close_price")).try_cast(MONEY).alias("market_value"))


def price_lineage(scenarios: DataFrame, prices: DataFrame) -> DataFrame:
    """Each scenario row (instrument_id, scenario_date, prior_date) with the record hashes of both prices behind it."""
    def hashes(date: str, name: str) -> DataFrame:
        return prices.select("instrument_id", F.col("price_date").alias(date), F.col("record_hash").alias(name))

    return scenarios.join(hashes("prior_date", "prior_price_hash"), ["instrument_id", "prior_date"], "left").join(hashes("scenario_date", "scenario_price_hash"), ["instrument_id", "scenario_date"], "left")


def expected_grid_missing(left: DataFrame, right: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of ``left`` and the dimension ``right`` that ``actual`` lacks. ``right`` (dates, as a rule) becomes one row with an
    array, which every row of ``left`` explodes, so the left side may be as large as it likes."""
    members = right.agg(F.collect_set(F.struct(*right.columns)).alias("__members"))
    grid = left.crossJoin(F.broadcast(members)).select(*left.columns, F.inline("__members"))  # one row
    return grid.join(actual.select(*keys).distinct(), keys, "left_anti")


def rolling_volatility(returns: DataFrame, window: int = 252, annual: int = 252) -> DataFrame:
    """Annualised sample deviation of the last ``window`` returns per portfolio (specified by the reference, not in its code)."""
    w = Window.partitionBy("portfolio_id").orderBy("valuation_date").rowsBetween(-(window - 1), 0)
    return returns.withColumn("volatility", F.stddev_samp("daily_return").over(w) * F.sqrt(F.lit(float(annual)))).withColumn("window_count", F.count("daily_return").over(w))


def drawdown(navs: DataFrame) -> DataFrame:
    """NAV against its running peak, and the worst of it so far (specified by the reference, not in its code)."""
    w = Window.partitionBy("portfolio_id").orderBy("valuation_date").rowsBetween(Window.unboundedPreceding, 0)
    rows = navs.withColumn("peak_nav", F.max("nav").over(w))
    rows = rows.withColumn("drawdown", F.when(F.col("peak_nav") > 0, F.col("nav").cast("double") / F.col("peak_nav").cast("double") - 1.0).otherwise(F.lit(0.0)))
    return rows.withColumn("max_drawdown", F.min("drawdown").over(w))


def concentration(values: DataFrame) -> DataFrame:
    """Herfindahl index of gross weights per portfolio and date (specified by the reference, not in its code)."""
    total = F.sum(F.abs("signed_market_value")).over(Window.partitionBy("portfolio_id", "valuation_date"))
    weight = F.when(total > 0, F.abs(F.col("signed_market_value")).cast("double") / total.cast("double")).otherwise(0.0)
    return values.withColumn("gross_weight", weight).groupBy("portfolio_id", "valuation_date").agg(F.sum(F.col("gross_weight") * F.col("gross_weight")).alias("hhi"), F.count(F.lit(1)).alias("positions"))


def continuous_var(history: DataFrame, navs: DataFrame | None = None, window: int = 1260, least: int = 1000, levels: tuple[float, ...] = LEVELS) -> DataFrame:
    """Interpolated VaR of the last ``window`` losses per run and level, and its share of the run's NAV; null below ``least``
    observations (specified by the reference, superseded there by discrete ranks)."""
    recent = Window.partitionBy("run_id").orderBy(F.col("scenario_date").desc())
    rows = history.withColumn("__n", F.row_number().over(recent)).where(F.col("__n") <= window)
    loss = F.col("loss").cast("double")
    found = rows.groupBy("run_id").agg(F.count(F.lit(1)).alias("observations"), F.percentile(loss, F.array(*[F.lit(x) for x in levels])).alias("__v"))
    each = found.select("run_id", "observations", F.explode(F.arrays_zip(F.array(*[F.lit(x) for x in levels]).alias("l"), F.col("__v").alias("v"))).alias("z"))
    each = each.select("run_id", "observations", F.col("z.l").alias("confidence_level"), F.when(F.col("observations") >= least, F.col("z.v")).alias("var_amount"))
    if navs is None:
        return each
    own = F.col("static_nav").cast("double")
    return each.join(navs.select("run_id", "static_nav"), "run_id", "left").withColumn("var_share", F.when(own > 0, F.col("var_amount") / own)).drop("static_nav")
