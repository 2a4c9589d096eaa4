import random
import re
from collections import Counter

import numpy as np
import pytest

from riskloom.llm.mixing import MixConfig, mix, plan, split, water_fill


def test_water_fill():
    assert water_fill([100, 100, 100], [1, 2, 3], 3) == pytest.approx([50, 100, 150])
    got = water_fill([10, 1000], [10, 1], 3)
    assert got == pytest.approx([30, 980])
    assert water_fill([0, 0], [1, 2], 3) == [0, 0] and water_fill([], [], 3) == []
    assert water_fill([1, 1, 100], [50, 50, 1], 3) == pytest.approx([3, 3, 96])


def test_split_is_exact_and_repeatable():
    counts = np.array([50, 7, 0, 143])
    a, b = split(counts, 9, seed=1), split(counts, 9, seed=1)
    assert (a == b).all() and (a.sum(axis=0) == counts).all() and (a >= 0).all()
    sizes = a.sum(axis=1)
    assert sizes.max() - sizes.min() <= 4
    assert not (a == split(counts, 9, seed=2)).all()


def test_plan_on_mixed_rows(make_docs, mixed_rows):
    docs = make_docs(mixed_rows)
    rows = plan(docs).collect()
    assert len(rows) == len(mixed_rows)
    sizes = Counter(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in mixed_rows)
    assert Counter(r["size"] for r in rows) == sizes
    assert all(r.taken <= 3 * r["size"] and r.taken == r.copies * r["size"] and len(r.shards) == r.copies for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, plan(docs).collect()))


def test_taken_words_come_near_their_targets(make_docs):
    rng = random.Random(3)
    rows = [(i, "w " * (1 + int(rng.expovariate(1 / 40))), "en", f"s{min(rng.randrange(9), 5)}" if i % 9 else None) for i in range(3000)]
    got = plan(make_docs(rows), MixConfig(block_docs=16)).collect()
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert sum(r["size"] for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(2, 0.01 * own[0].target)
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(r["size"] for r in got))
    per_shard = Counter(s for r in got for s in r.shards)
    assert len(per_shard) == 64 or len(per_shard) > 32


def test_mix_repeats_rows_as_planned(make_docs, mixed_rows):
    docs = make_docs([r for r in mixed_rows if r[0] is not None], extra=False).dropDuplicates(["doc_id"])
    copies = {r.doc_id: r.copies for r in plan(docs).collect()}
    out = Counter(r.doc_id for r in mix(docs).collect())
    assert mix(docs).columns == docs.columns
    assert out == Counter({i: c for i, c in copies.items() if c})


def test_mix_deals_rows_to_their_shards_and_shuffles_them(spark, make_docs, tmp_path):
    from pyspark.sql import functions as F

    rows = [(i, f"word {i} " * 5, "en", "hot" if i % 10 else "rare") for i in range(600)]
    docs, config = make_docs(rows), MixConfig(shards=4, block_docs=8)
    dealt = Counter((s, r.doc_id) for r in plan(docs, config).collect() for s in r.shards)
    got = mix(docs, config).select(F.spark_partition_id().alias("p"), "doc_id").collect()
    assert Counter((r.p, r.doc_id) for r in got) == dealt and {s for s, _ in dealt} == {0, 1, 2, 3}
    for shard in range(4):
        ids = [r.doc_id for r in got if r.p == shard]
        assert ids != sorted(ids)
        assert sum(a == b for a, b in zip(ids, ids[1:])) <= 0.2 * (len(ids) - len(set(ids)))
        assert all(len({i % 10 == 0 for i in half}) == 2 for half in (ids[: len(ids) // 2], ids[len(ids) // 2 :]))  # no source is at one end
    assert len({(r.p, r.doc_id) for r in got}) < len(got)  # some shard holds two copies of a document
    mix(docs, config).write.parquet(str(tmp_path / "mixed"))
    files = [[r.doc_id for r in spark.read.parquet(str(f)).collect()] for f in sorted((tmp_path / "mixed").glob("part-*"))]
    assert files == [[r.doc_id for r in got if r.p == shard] for shard in range(4)]


def test_query_returns_the_shards(spark):
    from riskloom.llm.queries import op2_mixing

    got = op2_mixing(spark, "/root/testdata/sf0.001").collect()
    assert got and all(len(r.shards) == r.copies for r in got)


def test_empty_table(make_docs):
    assert plan(make_docs([])).count() == 0
    assert mix(make_docs([])).count() == 0


def test_sizes_equal_sql(make_docs, mixed_rows, tmp_path):
    """size, source_size and, below the cap, target against DuckDB."""
    duckdb = pytest.importorskip("duckdb")
    docs = make_docs(mixed_rows, extra=False)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sql = f"""WITH s AS (SELECT doc_id, source, len(regexp_extract_all(COALESCE(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM '{tmp_path}/documents.parquet/*.parquet'),
    t AS (SELECT source, SUM(size) AS source_size, 1 + (ROW_NUMBER() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM s GROUP BY 1)
    SELECT doc_id, size, source_size, w, SUM(size) OVER () AS total FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source"""
    expected = duckdb.sql(sql).fetchall()
    got = plan(docs).collect()
    assert Counter((r.doc_id, r["size"], r.source_size) for r in got) == Counter((i, n, int(m)) for i, n, m, *_ in expected)
    # the targets by a plain bisection of the level at which shares sum to the total
    sources = {(int(m), w) for _, _, m, w, _ in expected}
    by_source = {}
    for r in got:
        by_source[r.source] = (r.source_size, r.target)
    weights = {s: 1 + k % 3 for k, s in enumerate(sorted(by_source, key=lambda s: (s is None, s or "")))}
    total, lo, hi = sum(m for m, _ in by_source.values()), 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * m, mid * weights[s]) for s, (m, _) in by_source.items()) < total else (lo, mid)
    assert all(t == pytest.approx(min(3 * m, hi * weights[s]), rel=1e-6) for s, (m, t) in by_source.items()) and sources


def test_a_source_without_ids_meets_its_target(make_docs):
    rng = random.Random(7)
    rows = [(None if i % 2 else i, "w " * rng.randrange(1, 60) + str(i), "en", "hot" if i % 3 else "rare") for i in range(900)]
    docs = make_docs(rows, extra=False)
    got = plan(docs, MixConfig(block_docs=8)).collect()
    for source in ("hot", "rare"):
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(2, 0.01 * own[0].target)
    assert Counter(r.text for r in mix(docs, MixConfig(block_docs=8)).collect()).total() == sum(r.copies for r in got)


def test_shards_grow_with_the_words(make_docs):
    assert MixConfig().sized(10).shards == 64 and MixConfig().sized(100 << 24).shards == 100 and MixConfig(shards=3).sized(1 << 40).shards == 3
    assert mix(make_docs([(i, "w w w", "en", "s") for i in range(50)]), MixConfig(shard_words=1)).rdd.getNumPartitions() == 150
