"""Order-independent digests of sets of rows.

``exact`` digests sort and join all rows of a group, as the manifests of small published sets need; groups must be of
bounded size. ``tree_digest`` hashes per bucket first and then over the buckets, so that one group may be as large
as it likes and no task sees it whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMPTY = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def ordered_set_sha256(row: Column, *order: Column) -> Column:
    """Aggregate: SHA-256 of the group's rows joined by line feeds in the given order; of nothing, the hash of ''."""
    keys = [o.alias(f"k{i}") for i, o in enumerate(order)]
    members = F.array_sort(F.collect_list(F.struct(*keys, row.alias("row"))))
    return F.sha2(F.concat_ws("\n", F.transform(members, lambda m: m["row"])), 256)


#: Members of a leaf that are meant to be hashed together, and hash digits that one further level folds.
LEAF, FOLD = 4096, 3


def leaf_digits(rows: int) -> int:
    """Hex digits of the leaf buckets of that many rows: none up to LEAF, and one more for each factor of 16."""
    digits = 0
    while rows > LEAF << 4 * digits:
        digits += 1
    return digits


def tree_digest(df: DataFrame, groups: list[str], row: Column, order: Column, digits: int | None = None) -> DataFrame:
    """(groups..., rows, digest): ordered digests of hash buckets, folded level by level to one digest.

    Rows fall into 16**digits leaves by the hash of ``order``, and every level above joins at most 4,096 digests. Without
    ``digits`` they follow from the number of rows, so that a leaf holds a few thousand of them whatever the table's size; equal
    sets have equal digests.
    """
    if digits is None:
        digits = leaf_digits(df.count())
    rows = df.select(*groups, F.substring(F.sha2(order.cast("string"), 256), 1, max(1, digits)).alias("__b"), row.alias("__row"), order.alias("__order"))
    level = rows.withColumn("__b", F.substring("__b", 1, digits)).groupBy(*groups, "__b").agg(ordered_set_sha256(F.col("__row"), F.col("__order")).alias("__d"), F.count(F.lit(1)).alias("__n"))
    while digits > FOLD:
        digits -= FOLD
        level = level.groupBy(*groups, F.substring("__b", 1, digits).alias("__up")).agg(ordered_set_sha256(F.col("__d"), F.col("__b")).alias("__d"), F.sum("__n").alias("__n")).withColumnRenamed("__up", "__b")
    return level.groupBy(*groups).agg(F.sum("__n").alias("rows"), ordered_set_sha256(F.col("__d"), F.col("__b")).alias("digest"))


def manifest_digest(entries: DataFrame) -> DataFrame:
    """One digest over manifest entries (dataset, contract_version, snapshot_ref, scope, rows, digest), by name."""
    line = F.concat_ws("|", "dataset", "contract_version", "snapshot_ref", "scope", F.col("rows").cast("string"), "digest")
    return entries.agg(F.count(F.lit(1)).alias("datasets"), ordered_set_sha256(line, F.col("dataset")).alias("manifest_sha256"))
