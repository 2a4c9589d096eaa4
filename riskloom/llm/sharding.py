"""Sharding by a hierarchical weighted hash tree (DataFrame functions only).

A tree of regions, racks and shards is descended from the root. At every level each child draws the
exponential variate ``-ln(u) / weight``, with ``u`` hashed from the key and the child's name, and the
smallest draw wins. A child is drawn in proportion to its weight, and when one weight changes, only that
child's draw changes: rows move into or out of that subtree alone. A shard added by ``grown`` is a region of
its own, so that all rows which move go into it.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import stash


@dataclass(frozen=True)
class Tree:
    """Shard weights by region and rack: ``regions[r][k][s]``. Shards are numbered in this order."""

    regions: tuple[tuple[tuple[float, ...], ...], ...]

    @property
    def shards(self) -> int:
        return sum(len(rack) for region in self.regions for rack in region)

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard, alone in a region of its own."""
        return replace(self, regions=(*self.regions, ((weight,),)))


def even_tree(shards: int, racks: int = 4, per_rack: int = 2) -> Tree:
    """Regions of ``racks`` racks of ``per_rack`` shards of weight 1; what is left over makes smaller ones."""
    left, regions = shards, []
    while left:
        region = []
        while left and len(region) < racks:
            region.append((1.0,) * min(per_rack, left))
            left -= len(region[-1])
        regions.append(tuple(region))
    return Tree(tuple(regions))


def _draw(key: Column, node: Column, weight: Column) -> Column:
    """An exponential variate of rate ``weight``; the 53 upper bits of the hash give u in (0, 1)."""
    u = (F.shiftrightunsigned(F.xxhash64(node, key), 11).cast("double") + 0.5) / F.lit(float(2**53))
    return -F.log(u) / weight


def _winner(key: Column, prefix: Column, weights: list[float]) -> Column:
    draws = [F.struct(_draw(key, F.concat(prefix, F.lit(f"/{i}")), F.lit(float(w))).alias("d"), F.lit(i).alias("i")) for i, w in enumerate(weights) if w > 0]
    return F.array_min(F.array(*draws))


def _by(index: Column, options: list[Column]) -> Column:
    """options[index], with one branch where all are alike."""
    out = options[-1]
    for i in range(len(options) - 2, -1, -1):
        out = F.when(index == i, options[i]).otherwise(out)
    return out


def place(df: DataFrame, key: Column, tree: Tree, out: str = "shard") -> DataFrame:
    """Add ``out`` (int) by descending the tree, and ``<out>_draw``, the winning draw at the root."""
    totals = [sum(sum(rack) for rack in region) for region in tree.regions]
    df = df.withColumn("__key", key).withColumn("__r", _winner(F.col("__key"), F.lit("root"), totals))
    region = F.col("__r.i")
    shapes = sorted({tuple(sum(rack) for rack in r) for r in tree.regions})
    at = F.concat(F.lit("root/"), region.cast("string"))
    if len(shapes) == 1:
        rack = _winner(F.col("__key"), at, list(shapes[0]))
    else:
        rack = _by(region, [_winner(F.col("__key"), F.lit(f"root/{i}"), [sum(x) for x in r]) for i, r in enumerate(tree.regions)])
    df = df.withColumn("__k", rack["i"])
    at = F.concat(F.lit("root/"), region.cast("string"), F.lit("/"), F.col("__k").cast("string"))
    racks = {rack for r in tree.regions for rack in r}
    flat = [(i, j, rack) for i, r in enumerate(tree.regions) for j, rack in enumerate(r)]
    if len(racks) == 1:
        leaf = _winner(F.col("__key"), at, list(next(iter(racks))))
    else:
        leaf = _winner(F.col("__key"), at, list(flat[-1][2]))
        for i, j, rack in flat[-2::-1]:
            leaf = F.when((region == i) & (F.col("__k") == j), _winner(F.col("__key"), at, list(rack))).otherwise(leaf)
    firsts, n = {}, 0
    for i, j, rack in flat:
        firsts[i, j] = n
        n += len(rack)
    first = F.element_at(F.array(*[F.lit(firsts[i, j]) for i, j, _ in flat]), _rack_number(tree, region, F.col("__k")) + 1)
    return df.withColumn(out, (first + leaf["i"]).cast("int")).withColumn(f"{out}_draw", F.col("__r.d")).drop("__key", "__r", "__k")


def _rack_number(tree: Tree, region: Column, rack: Column) -> Column:
    before, n = [], 0
    for r in tree.regions:
        before.append(n)
        n += len(r)
    return F.element_at(F.array(*[F.lit(x) for x in before]), region + 1) + rack


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", buckets: int = 256, payload: bool = False) -> DataFrame:
    """Put rows into ``shards`` shards by the law ``key``: the id and the tree decide, nothing else.

    Returns id, size (UTF-8 bytes of ``text`` plus 16), text_crc32, law, shard, slot and grown_shard (the
    shard in the tree with one more); with ``payload`` the columns of ``docs`` and then shard, slot and
    grown_shard. Slots are gapless from 0 in each shard. They are numbered in ``buckets`` hash buckets whose
    counts give the offsets, so that no task holds a whole shard: the counts are at most shards * buckets rows. Rows go to buckets by
    their id and text together, and equal rows are counted before they are numbered, so neither a repeated id nor a
    repeated row makes a bucket hot (with ``payload``, rows that are equal in id and text share a bucket).

    A null text has no bytes and checksum 0. A null id is hashed as the word ``null``. Rows with equal ids
    share a shard and get different slots, in the order of a hash of the row; rows that are equal in it are
    equal altogether, so it is all one which of them gets which slot. Very long texts are hashed whole. An empty table stays empty.
    Other columns are ignored, or kept with ``payload``, whatever their names.
    """
    tree = even_tree(shards)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    text_hash = F.xxhash64(F.lit("slot"), key, F.coalesce("text", F.lit("")))
    bucket = F.pmod(F.col("__th"), F.lit(buckets)).cast("int")

    def placed(rows: DataFrame) -> DataFrame:
        rows = place(rows, key, tree)
        added = _draw(key, F.lit(f"root/{len(tree.regions)}"), F.lit(1.0))
        return rows.withColumn("grown_shard", F.when(added < F.col("shard_draw"), F.lit(shards)).otherwise(F.col("shard")).cast("int")).drop("shard_draw")

    def offsets(counts: DataFrame) -> DataFrame:
        """First slot of each bucket of each shard; at most shards * buckets rows."""
        found = counts.selectExpr("__cs", "__cb", "sum(__n) over (partition by __cs order by __cb) - __n as __first")
        return F.broadcast(found) if shards * buckets <= 1 << 16 else found

    if payload:
        kept = docs.drop("shard", "slot", "grown_shard", "shard_draw")
        counts = place(docs.select(id_col, "text"), key, tree).withColumn("__th", text_hash).groupBy(F.col("shard").alias("__cs"), bucket.alias("__cb")).agg(F.count(F.lit(1)).alias("__n"))
        rows = placed(kept.withColumn("__th", text_hash).withColumn("__row", F.xxhash64(*kept.columns))).withColumn("__b", bucket)
        numbered = rows.selectExpr("*", f"row_number() over (partition by shard, __b order by `{id_col}`, __th, __row) - 1 as __at")
        out = numbered.join(offsets(counts), (F.col("shard") == F.col("__cs")) & (F.col("__b") == F.col("__cb")))
        return out.select(*kept.columns, "shard", (F.col("__first") + F.col("__at")).cast("long").alias("slot"), "grown_shard")

    narrow = docs.select(
        id_col,
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16).alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        text_hash.alias("__th"),
    )
    # the one reading of the texts; equal rows are counted before they are shuffled
    groups = stash(placed(narrow.groupBy(id_col, "size", "text_crc32", "__th").agg(F.count(F.lit(1)).alias("__n"))).withColumn("__b", bucket), "shard-rows")
    counts = groups.groupBy(F.col("shard").alias("__cs"), F.col("__b").alias("__cb")).agg(F.sum("__n").alias("__n"))
    upto = f"sum(__n) over (partition by shard, __b order by `{id_col}`, __th, size, text_crc32 rows unbounded preceding) - __n as __at"
    numbered = groups.selectExpr("*", upto).join(offsets(counts), (F.col("shard") == F.col("__cs")) & (F.col("__b") == F.col("__cb")))
    first = F.col("__first") + F.col("__at")
    return numbered.select(id_col, "size", "text_crc32", F.lit("key").alias("law"), "shard", F.explode(F.sequence(first, first + F.col("__n") - 1)).alias("slot"), "grown_shard").select(id_col, "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
