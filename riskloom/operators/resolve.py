"""Duplicates, conflicts and corrections: evidence, comparison with the canonical table, and one outcome a row.

Two policies: ``market`` rows are quarantined when a batch contradicts itself and any change of content is a correction;
``versioned`` rows are rejected then, and a correction needs a higher version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from riskloom.functions.expr import semver
from riskloom.operators.rules import DEDUPLICATE, WARNING, Rule, violations


def same_batch_market(df: DataFrame, key: Sequence[str], hash_col: str, order: Sequence[str]) -> DataFrame:
    """Add key_count, is_conflict (one key, several contents), duplicate_rank, is_duplicate and winner (first row's order)."""
    by_key = Window.partitionBy(*key)
    by_row = Window.partitionBy(*key, hash_col).orderBy(*order)
    df = df.withColumns(
        {
            "key_count": F.count(F.lit(1)).over(by_key),
            "is_conflict": F.min(hash_col).over(by_key) != F.max(hash_col).over(by_key),
            "duplicate_rank": F.row_number().over(by_row),
            "winner": F.first(order[0]).over(by_row),
        }
    )
    return df.withColumn("is_duplicate", F.col("duplicate_rank") > 1)


def same_batch_versioned(df: DataFrame, key: Column, fallback: str, hash_col: str, order: Sequence[str]) -> DataFrame:
    """Add key_rank by key, or by ``fallback`` where the key is null. Several contents make a conflict of all rows of a
    key; with one content all but the first are duplicates. One shuffle by the key."""
    df = df.withColumn("__k", F.coalesce(key, F.col(fallback).cast("string")))
    by_key = Window.partitionBy("__k")
    df = df.withColumns({"is_conflict": F.coalesce(F.min(hash_col).over(by_key) != F.max(hash_col).over(by_key), F.lit(False)), "key_rank": F.row_number().over(by_key.orderBy(*order))})
    return df.withColumn("is_duplicate", ~F.col("is_conflict") & (F.col("key_rank") > 1)).drop("__k")


def batch_violations(df: DataFrame, keys: Sequence[str], prefix: str, disposition: str) -> DataFrame:
    """The evidence of ``same_batch_*`` as violations: <prefix>_SAME_BATCH_CONFLICT (an error) on all rows of a key with several
    contents, <prefix>_SAME_BATCH_IDENTICAL_DUPLICATE (a warning) on all but the first of equal rows."""
    rules = [
        Rule(f"{prefix}_SAME_BATCH_CONFLICT", F.col("is_conflict"), disposition=disposition, message="rows of one key differ within the batch"),
        Rule(f"{prefix}_SAME_BATCH_IDENTICAL_DUPLICATE", F.col("is_duplicate") & ~F.col("is_conflict"), severity=WARNING, disposition=DEDUPLICATE, message="an equal row comes earlier in the batch"),
    ]
    return violations(df, rules, keys)


def correction_violations(df: DataFrame, keys: Sequence[str], prefix: str, version_col: str) -> DataFrame:
    """<prefix>_INVALID_CORRECTION for the rows that ``compare_versioned`` rejects."""
    rule = Rule(f"{prefix}_INVALID_CORRECTION", F.col("comparison") == "REJECTED", field_name=version_col, expected="other content with a higher version", observed=(version_col, "current_version"))
    return violations(df, [rule], keys)


def compare_market(candidates: DataFrame, current: DataFrame, key: Sequence[str], hash_col: str) -> DataFrame:
    """Add comparison: NEW, UNCHANGED or CORRECTION."""
    have = current.select(*key, F.col(hash_col).alias("current_hash"))
    status = F.when(F.col("current_hash").isNull(), "NEW").when(F.col("current_hash") == F.col(hash_col), "UNCHANGED").otherwise("CORRECTION")
    return candidates.join(have, list(key), "left").withColumn("comparison", status)


def compare_versioned(candidates: DataFrame, current: DataFrame, key: Sequence[str], hash_col: str, version_col: str) -> DataFrame:
    """Add comparison: NEW, UNCHANGED (same version and content), CORRECTION (higher version) or REJECTED."""
    have = current.select(*key, F.col(hash_col).alias("current_hash"), F.col(version_col).alias("current_version"))
    new, old = semver(version_col), semver("current_version")
    status = (
        F.when(F.col("current_hash").isNull(), "NEW")
        .when((F.col("current_hash") == F.col(hash_col)) & (F.col("current_version") == F.col(version_col)), "UNCHANGED")
        .when((F.col("current_hash") != F.col(hash_col)) & (new > old), "CORRECTION")
        .otherwise("REJECTED")
    )
    return candidates.join(have, list(key), "left").withColumn("comparison", status)


def outcome_market(has_reject: Column, has_quarantine: Column, is_duplicate: Column, comparison: Column) -> Column:
    accepted = F.when(comparison == "NEW", "ACCEPTED_NEW").when(comparison == "UNCHANGED", "UNCHANGED").otherwise("ACCEPTED_CORRECTION")
    no = F.lit(False)
    return F.when(F.coalesce(has_reject, no), "REJECTED").when(F.coalesce(has_quarantine, no), "QUARANTINED").when(F.coalesce(is_duplicate, no), "DEDUPLICATED").otherwise(accepted)


def outcome_versioned(has_error: Column, is_conflict: Column, is_duplicate: Column, comparison: Column) -> Column:
    accepted = F.when(comparison == "NEW", "ACCEPTED_NEW").when(comparison == "UNCHANGED", "UNCHANGED").when(comparison == "CORRECTION", "ACCEPTED_CORRECTION").otherwise("REJECTED")
    no = F.lit(False)
    return F.when(F.coalesce(has_error, no) | F.coalesce(is_conflict, no), "REJECTED").when(F.coalesce(is_duplicate, no), "DEDUPLICATED").otherwise(accepted)


def conservation(outcomes: DataFrame, col: str = "outcome") -> DataFrame:
    """One row: how many rows each outcome has, and whether every row has exactly one of them."""
    kinds = ("ACCEPTED_NEW", "ACCEPTED_CORRECTION", "UNCHANGED", "DEDUPLICATED", "QUARANTINED", "REJECTED")
    counts = outcomes.agg(F.count(F.lit(1)).alias("evaluated"), *[F.count_if(F.col(col) == k).alias(k.lower()) for k in kinds])
    total = sum((F.col(k.lower()) for k in kinds), F.lit(0))
    return counts.withColumn("is_conserved", total == F.col("evaluated"))


def publication(counts: DataFrame, failures: int = 0) -> DataFrame:
    """All or nothing: a batch is published if nothing was rejected, quarantined or failed, and something was accepted."""
    clean = (F.col("rejected") == 0) & (F.col("quarantined") == 0) & F.lit(failures == 0)
    accepted = F.col("accepted_new") + F.col("accepted_correction")
    return counts.withColumn("status", F.when(~clean, "FAILED").when(F.col("deduplicated") > 0, "SUCCEEDED_WITH_WARNINGS").otherwise("SUCCEEDED")).withColumn("published", clean & (accepted > 0))
