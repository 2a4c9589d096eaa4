"""Checks of a whole prospective snapshot, before it is published. Each gives one row: rule_id, is_met, observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.operators.serving import allocation_totals, effective_overlaps


def _row(df: DataFrame, rule_id: str, observed: Column, is_met: Column) -> DataFrame:
    return df.select(F.lit(rule_id).alias("rule_id"), F.coalesce(is_met, F.lit(False)).alias("is_met"), observed.cast("string").alias("observed"))


def row_count(df: DataFrame, rule_id: str, expected: int) -> DataFrame:
    n = F.col("n")
    return _row(df.agg(F.count(F.lit(1)).alias("n")), rule_id, n, n == expected)


def key_unique(df: DataFrame, rule_id: str, keys: list[str]) -> DataFrame:
    n = F.col("n")
    return _row(df.groupBy(*keys).count().where("count > 1").agg(F.count(F.lit(1)).alias("n")), rule_id, n, n == 0)


def complete_grid(df: DataFrame, rule_id: str, group: str, member: str, members: int) -> DataFrame:
    """Every group has exactly ``members`` distinct members."""
    n = F.col("n")
    bad = df.groupBy(group).agg(F.count_distinct(member).alias("m")).where(F.col("m") != members)
    return _row(bad.agg(F.count(F.lit(1)).alias("n")), rule_id, n, n == 0)


def ranges_disjoint(df: DataFrame, rule_id: str, keys: list[str], start: str, end: str) -> DataFrame:
    n = F.col("n")
    return _row(effective_overlaps(df, keys, start, end).agg(F.count(F.lit(1)).alias("n")), rule_id, n, n == 0)


def totals(df: DataFrame, rule_id: str, long: float, short: float, tolerance: float = 1e-6) -> DataFrame:
    """Every portfolio's long and short weights are as given."""
    n = F.col("n")
    off = (F.abs(F.col("long_weight").cast("double") - long) > tolerance) | (F.abs(F.col("short_weight").cast("double") - short) > tolerance)
    return _row(allocation_totals(df).where(off).agg(F.count(F.lit(1)).alias("n")), rule_id, n, n == 0)


def contained(df: DataFrame, other: DataFrame, rule_id: str) -> DataFrame:
    """Every row of ``df``, with its multiplicity, is in ``other``."""
    n = F.col("n")
    return _row(df.exceptAll(other).agg(F.count(F.lit(1)).alias("n")), rule_id, n, n == 0)


def failures(*checks: DataFrame) -> list[str]:
    """The sorted ids of the checks that aren't met; one row each reaches the driver."""
    return sorted({r["rule_id"] for c in checks for r in c.where(~F.col("is_met")).collect()})
