"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is cut into hash blocks of whole documents. A source whose target is e.g. 2.4 times its size is
drawn twice in full and once for the blocks that make up the rest; the last, partly drawn block is filled
document by document. The counts of block draws per source are split among the output shards by recursive
multivariate-hypergeometric draws: the counts of each node are divided in two as if the draws had been
shuffled, so every shard's share is exact in total and random in make-up. Each leaf then owns a run of its
sources' permuted blocks, disjoint from all other leaves'. ``mix`` deals the copies to one partition a shard and
shuffles them there by a seeded hash of id, text and copy, so copies of a document don't stay side by side. There are as many
shards as the words need, so that a shard fits a task however large the corpus is.

Three things reach the driver: one row per source (sources are meant to be some thousands at most), ``max_blocks`` block
sizes, and the tree of shards by sources. The texts are shuffled once, to their shards.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import WORD_PATTERN, stash

_PLAN = "__src int, __block int, __copies int, __shards array<int>, __part int"


@dataclass(frozen=True)
class MixConfig:
    """weights are given in turn to the sources in code-point order, null last; shards None: one for each ``shard_words``
    words, and 64 at least."""

    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    max_repeats: int = 3
    shards: int | None = None
    block_docs: int = 64
    max_blocks: int = 1 << 18
    seed: int = 20240
    shard_words: int = 1 << 24

    def sized(self, words: int) -> MixConfig:
        return self if self.shards else replace(self, shards=max(64, -(-words // self.shard_words)))


def water_fill(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Shares of sum(sizes) in proportion to weights, none above cap times its size; the excess is reshared."""
    targets, left, free = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while free and left > 0:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if unit * weights[i] > cap * sizes[i]}
        for i in over or free:
            targets[i] = float(cap * sizes[i]) if over else unit * weights[i]
        left -= sum(targets[i] for i in over or free)
        free -= over or free
    return targets


def split(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """counts[source] block draws, divided among shards: an array [shard, source] with those column sums."""
    out = np.zeros((shards, len(counts)), dtype=np.int64)

    def go(lo: int, hi: int, here: np.ndarray) -> None:
        total = int(here.sum())
        if hi - lo == 1 or total == 0:
            out[lo] = here
            return
        mid = (lo + hi) // 2
        left = np.random.default_rng([seed, lo, hi]).multivariate_hypergeometric(here, total * (mid - lo) // (hi - lo), method="marginals")
        go(lo, mid, left)
        go(mid, hi, here - left)

    go(0, shards, counts.astype(np.int64))
    return out


def _pick(need: dict[int, int]):
    """Fill what a source still needs from the documents of its partly drawn block.

    Documents are taken in hash order as long as they fit; then one of them is exchanged for the unused one
    that closes most of what is left.
    """

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        left = need[int(rows["__src"].iat[0])]
        rows = rows.sort_values("__h", kind="stable")
        size, keep = rows["__size"].to_numpy(), np.zeros(len(rows), dtype=bool)
        for i, words in enumerate(size.tolist()):
            if words <= left:
                keep[i] = True
                left -= words
        used, spare = np.flatnonzero(keep), np.flatnonzero(~keep)
        if left and len(used) and len(spare):
            spare = spare[np.argsort(size[spare], kind="stable")]
            at = np.searchsorted(size[spare], size[used] + left, side="right") - 1
            gain = np.where(at >= 0, size[spare[at]] - size[used], 0)
            if gain.max() > 0:
                best = int(gain.argmax())
                keep[used[best]], keep[spare[at[best]]] = False, True
        return rows.loc[keep, ["__src", "__h"]].set_axis(["__ps", "__ph"], axis=1)

    return pick


def _hash(config: MixConfig, id_col: str) -> Column:
    """What a row is drawn by: equal only for rows of equal id and text."""
    return F.xxhash64(F.lit(config.seed), F.col(id_col), F.col("text"))


@dataclass(frozen=True)
class _Draw:
    """config with its shards; sources (__name, __src, __blocks, source_size, target), blocks (_PLAN, keys with _p) and picked
    (__ps, __ph): the chosen documents of partly drawn blocks; sizes: id, source, size and hash of every row."""

    config: MixConfig
    sizes: DataFrame
    sources: DataFrame
    blocks: DataFrame
    picked: DataFrame

    def placed(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with __source and __h) and what the draw says of them: copies, shards and the columns of sources."""
        rows = rows.join(self.sources, F.col("__source").eqNullSafe(F.col("__name"))).withColumn("__block", F.pmod(F.col("__h"), F.col("__blocks")).cast("int"))
        rows = rows.join(self.blocks, (F.col("__src") == F.col("__src_p")) & (F.col("__block") == F.col("__block_p")))

        def with_picked(some: DataFrame, picked: DataFrame) -> DataFrame:
            some = some.join(picked, (F.col("__src") == F.col("__ps")) & (F.col("__h") == F.col("__ph")) & F.col("__part").isNotNull(), "left")
            extra = F.col("__ph").isNotNull()
            return some.withColumns({"copies": F.col("__copies") + extra.cast("int"), "shards": F.when(extra, F.concat("__shards", F.array("__part"))).otherwise(F.col("__shards"))})

        if self.picked.count() <= 1 << 18:  # two numbers a row
            return with_picked(rows, F.broadcast(self.picked))
        # only the rows of partly drawn blocks are shuffled
        whole = rows.where("__part is null").withColumns({"copies": F.col("__copies"), "shards": F.col("__shards")})
        part = with_picked(rows.where("__part is not null"), self.picked)
        return whole.unionByName(part.select(*whole.columns))


def draw(docs: DataFrame, config: MixConfig = MixConfig(), id_col: str = "doc_id") -> _Draw:
    """Decide how often each row is taken, and for which shards."""
    spark = docs.sparkSession
    words = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    sizes = stash(docs.select(F.col(id_col).alias("__id"), F.col("source").cast("string").alias("__source"), words.alias("__size"), _hash(config, id_col).alias("__h")), "mix-sizes")
    found = sizes.groupBy("__source").agg(F.sum("__size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    found.sort(key=lambda r: (r["__source"] is None, r["__source"] or ""))
    size, n = [int(r["size"]) for r in found], [int(r["n"]) for r in found]
    config = config.sized(sum(size))
    weights = [config.weights[i % len(config.weights)] for i in range(len(found))]
    targets = water_fill(size, weights, config.max_repeats)
    most = max(1, config.max_blocks // max(1, len(found)))
    blocks = [max(1, min(k // config.block_docs, most)) for k in n]

    sources = spark.createDataFrame(
        [(r["__source"], i, blocks[i], size[i], targets[i]) for i, r in enumerate(found)],
        "__name string, __src int, __blocks int, source_size long, target double",
    )
    small = F.broadcast(sources) if len(found) <= 1 << 16 else sources
    rows = sizes.join(small, F.col("__source").eqNullSafe(F.col("__name"))).withColumn("__block", F.pmod(F.col("__h"), F.col("__blocks")).cast("int"))

    weighed: list[np.ndarray] = [np.zeros(b, dtype=np.int64) for b in blocks]
    for r in rows.groupBy("__src", "__block").agg(F.sum("__size").alias("size")).toLocalIterator():
        weighed[r["__src"]][r["__block"]] = r["size"]

    draws: list[list[tuple[int, bool]]] = []  # of each source: (block, whether it is drawn in part)
    need: dict[int, int] = {}
    for i, total in enumerate(size):
        rng = np.random.default_rng([config.seed, i])
        full = min(int(targets[i] // total), config.max_repeats) if total else 1
        own = [(int(b), False) for _ in range(full) for b in rng.permutation(blocks[i])]
        left = round(targets[i]) - full * total
        for b in rng.permutation(blocks[i]) if left > 0 else ():
            if weighed[i][b] <= left:
                own.append((int(b), False))
                left -= int(weighed[i][b])
            else:
                own.append((int(b), True))
                need[i] = int(left)
                break
        draws.append(own)

    owned = split(np.array([len(x) for x in draws], dtype=np.int64), config.shards, config.seed) if found else np.zeros((0, 0), dtype=np.int64)
    chosen: dict[tuple[int, int], list] = {(i, b): [0, [], None] for i, k in enumerate(blocks) for b in range(k)}
    for i, own in enumerate(draws):
        for (b, partly), at in zip(own, np.repeat(np.arange(config.shards), owned[:, i]).tolist(), strict=True):
            x = chosen[i, b]
            if partly:
                x[2] = at
            else:
                x[0] += 1
                x[1].append(at)
    table = spark.createDataFrame([(i, b, c, s, p) for (i, b), (c, s, p) in chosen.items()], _PLAN)  # at most max_blocks rows and one a source
    table = table.select(*[F.col(c).alias(f"{c}_p" if c in ("__src", "__block") else c) for c in table.columns])
    table = F.broadcast(table) if len(chosen) <= 1 << 19 else table

    edge = rows.join(table, (F.col("__src") == F.col("__src_p")) & (F.col("__block") == F.col("__block_p"))).where(F.col("__part").isNotNull()).groupBy("__src", "__h").agg(F.sum("__size").alias("__size"))
    picked = stash(edge.groupBy("__src").applyInPandas(_pick(need), "__ps int, __ph long"), "picked")
    return _Draw(config, sizes, small, table, picked)


def plan(docs: DataFrame, config: MixConfig = MixConfig(), id_col: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, taken, copies and shards (one per copy).

    Size is the number of words (runs without ASCII white space) of ``text``. ``taken`` is copies times size.
    Null and empty texts have size 0. Rows are drawn by their id and text, so rows that are equal in both go together; a null
    source is a source of its own; a source without words has target 0. Very long texts are counted whole. Reruns give the same
    rows, as every draw is seeded or hashed. Extra columns are ignored, and an empty table gives an empty plan.
    """
    drawn = draw(docs, config, id_col)
    return drawn.placed(drawn.sizes).select(
        F.col("__id").alias(id_col),
        F.col("__source").alias("source"),
        F.col("__size").alias("size"),
        "source_size",
        "target",
        (F.col("copies") * F.col("__size")).cast("long").alias("taken"),
        "copies",
        "shards",
    )


def mix(docs: DataFrame, config: MixConfig = MixConfig(), id_col: str = "doc_id") -> DataFrame:
    """The mixed rows themselves: the columns of ``docs``, each row as often as it is taken (never, for some).

    Partition k holds the copies dealt to shard k, in the order of a seeded hash, so written files keep the mix.
    """
    drawn = draw(docs, config, id_col)
    rows = docs.select(*[F.col(c).alias(f"__c{k}") for k, c in enumerate(docs.columns)], F.col("source").cast("string").alias("__source"), _hash(config, id_col).alias("__h"))
    own = [f"__c{k}" for k in range(len(docs.columns))]
    out = drawn.placed(rows).select(*own, "__h", F.posexplode("shards").alias("__copy", "__shard"))
    out = out.withColumn("__order", F.xxhash64("__h", "__copy"))
    out = out.repartitionById(drawn.config.shards, "__shard").sortWithinPartitions("__order")
    return out.select(*[F.col(x).alias(c) for x, c in zip(own, docs.columns, strict=True)])
