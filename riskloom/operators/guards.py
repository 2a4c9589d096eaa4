"""Guards on inputs: bounded driver frames, empty frames of a schema, single values with a default, and exact batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Overflow(ValueError):
    """A frame that was meant to be small isn't."""


def bounded(df: DataFrame, most: int, strict: bool = True) -> tuple[list, bool]:
    """At most ``most`` rows on the driver, and whether there were no more. One more row than that is asked for, so the rest of
    a large frame is never fetched; with ``strict`` an overflow raises, without it the caller records it as a broken rule."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most and strict:
        raise Overflow(f"more than {most} rows")
    return rows[:most], len(rows) <= most


def none_of(df: DataFrame) -> DataFrame:
    """The frame without rows, as where there is nothing before: the optimizer replaces it by an empty relation."""
    return df.where(F.lit(False))


def value_or(df: DataFrame, aggregate: Column, default: object, name: str = "value") -> DataFrame:
    """One row with the aggregate over all rows, or the default where it is null; to be joined, so that plans stay whole."""
    return df.agg(F.coalesce(aggregate, F.lit(default)).alias(name))


def single_batch(rows: DataFrame, log: DataFrame, by: str = "batch_id") -> DataFrame:
    """Per batch: its rows against what its audit row says (row_count), and whether it has exactly one successful audit row."""
    stated = log.where("status = 'SUCCEEDED'").groupBy(by).agg(F.count(F.lit(1)).alias("audits"), F.sum("row_count").alias("stated_rows"))
    found = rows.groupBy(by).agg(F.count(F.lit(1)).alias("found_rows")).join(stated, by, "full")
    return found.withColumn("is_reconciled", F.coalesce((F.col("audits") == 1) & (F.col("found_rows") == F.col("stated_rows")), F.lit(False)))
