"""Serving views, their checks, and semi-additive measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest_published(runs: DataFrame, keys: list[str], order: list[str], condition: Column | None = None) -> DataFrame:
    """Exactly one run per key: the last of those that meet the condition, by ``order``, all descending."""
    rows = runs if condition is None else runs.where(condition)
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def attempts(runs: DataFrame, keys: list[str], order: list[str], run_id: str) -> DataFrame:
    """Attempt numbers per key and the run that each one reprocesses."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return runs.withColumns({"attempt_number": F.row_number().over(w), "reprocess_of": F.lag(run_id).over(w)})


def exactly_one_run(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the number of runs, and whether it is one."""
    return runs.groupBy(*keys).agg(F.count(F.lit(1)).alias("run_count")).withColumn("is_single", F.col("run_count") == 1)


def bundle(runs: DataFrame, measures: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """The measures and stress results of the selected runs, beside what the runs say of themselves (joined by run_id)."""
    return {"var": runs.join(measures, "run_id"), "stress": runs.drop("static_nav").join(results, "run_id")}


def bundle_completeness(runs: DataFrame, var: DataFrame, stress: DataFrame, levels: int, scenarios: int) -> DataFrame:
    """Per run the served measures and stress results, and whether they are as many as expected."""
    a = var.groupBy("run_id").agg(F.count_distinct("confidence_level").alias("levels"))
    b = stress.groupBy("run_id").agg(F.count_distinct("scenario_id").alias("scenarios"))
    rows = runs.select("run_id").join(a, "run_id", "left").join(b, "run_id", "left").select("run_id", F.coalesce("levels", F.lit(0)).alias("levels"), F.coalesce("scenarios", F.lit(0)).alias("scenarios"))
    return rows.withColumn("is_complete", (F.col("levels") == levels) & (F.col("scenarios") == scenarios))


def key_checks(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """One row: rows, distinct keys without nulls, duplicate and null keys of a served frame."""
    null_key = ~F.lit(True)
    for k in keys:
        null_key = null_key | F.col(k).isNull()
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).withColumn("is_null", null_key)
    return per.agg(
        F.lit(name).alias("view_name"),
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("row_count"),
        F.count_if(~F.col("is_null")).alias("distinct_keys"),
        F.count_if(F.col("n") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum(F.when(F.col("is_null"), F.col("n"))), F.lit(0)).cast("bigint").alias("null_keys"),
    )


def row_parity(served: DataFrame, gold: DataFrame, name: str) -> DataFrame:
    """One row: counts of the served and the gold frame and whether they agree."""
    a = served.agg(F.count(F.lit(1)).alias("served_rows"))
    b = gold.agg(F.count(F.lit(1)).alias("gold_rows"))
    return a.crossJoin(b).select(F.lit(name).alias("view_name"), "served_rows", "gold_rows", (F.col("served_rows") == F.col("gold_rows")).alias("is_equal"))  # one row each


def at_latest_date(facts: DataFrame, groups: list[str], date_col: str, measure: Column, name: str) -> DataFrame:
    """Semi-additive: the measure summed over the rows of each group's latest date."""
    per_day = facts.groupBy(*groups, date_col).agg(F.sum(measure).alias("__v"))
    return per_day.groupBy(*groups).agg(F.max(date_col).alias(date_col), F.max_by("__v", date_col).alias(name))


def only_if_single(facts: DataFrame, groups: list[str], single: list[str], measure: Column, name: str) -> DataFrame:
    """The measure where the group holds one value of each column of ``single``, else null."""
    one = F.lit(True)
    for c in single:
        one = one & (F.min(c) == F.max(c))
    return facts.groupBy(*groups).agg(F.when(one, F.max(measure)).alias(name))


def dim_date(dates: DataFrame, date_col: str = "d") -> DataFrame:
    """A row for every day from the first to the last observed date, with year, month and month name."""
    span = dates.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))
    days = span.select(F.explode(F.sequence(F.col("lo").cast("date"), F.col("hi").cast("date"))).alias("date_value"))
    return days.select("date_value", F.year("date_value").alias("year"), F.month("date_value").alias("month"), F.date_format("date_value", "MMMM").alias("month_name"))


def effective_overlaps(rows: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Rows whose range reaches the next row's start of the same key."""
    w = Window.partitionBy(*keys).orderBy(start)
    nexts = rows.withColumn("next_start", F.lead(start).over(w))
    return nexts.where(F.col("next_start").isNotNull() & (F.col(end).isNull() | (F.col(end) >= F.col("next_start"))))


def allocation_totals(rows: DataFrame, weight: str = "target_weight") -> DataFrame:
    """Long, short, gross and net weight per portfolio."""
    w = F.col(weight)
    sums = rows.groupBy("portfolio_id").agg(F.sum(F.when(w > 0, w).otherwise(0)).alias("long_weight"), F.sum(F.when(w < 0, -w).otherwise(0)).alias("short_weight"))
    return sums.withColumns({"gross_weight": F.col("long_weight") + F.col("short_weight"), "net_weight": F.col("long_weight") - F.col("short_weight")})
