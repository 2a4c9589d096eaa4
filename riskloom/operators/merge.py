"""Merges as DataFrame algebra: each returns the target's next state, to be written as a new snapshot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Source rows replace target rows of the same key; the others stay."""
    return target.join(source.select(*keys), list(keys), "left_anti").unionByName(source)


def insert_only(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only source rows with a new key are added."""
    return target.unionByName(source.join(target.select(*keys), list(keys), "left_anti"))


def replace_partition(target: DataFrame, source: DataFrame, partition: Column) -> DataFrame:
    """What the target holds of the partition is replaced by the source's rows."""
    return target.where(~F.coalesce(partition, F.lit(False))).unionByName(source)


def conditional_upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], hash_col: str) -> tuple[DataFrame, DataFrame]:
    """The next state, where rows change only if their hash differs, and per source row its action."""
    have = target.select(*keys, F.col(hash_col).alias("__have"))
    actions = source.join(have, list(keys), "left").withColumn("action", F.when(F.col("__have").isNull(), "INSERT").when(F.col("__have") != F.col(hash_col), "UPDATE").otherwise("UNCHANGED")).drop("__have")
    changed = actions.where("action <> 'UNCHANGED'").drop("action")
    return upsert(target, changed, keys), actions


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: rows that either side has more of, and whether both are equal as bags."""
    a = left.exceptAll(right).agg(F.count(F.lit(1)).alias("only_left"))
    b = right.exceptAll(left).agg(F.count(F.lit(1)).alias("only_right"))
    return a.crossJoin(b).withColumn("is_equal", (F.col("only_left") == 0) & (F.col("only_right") == 0))  # one row each
