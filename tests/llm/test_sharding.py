import zlib
from collections import Counter, defaultdict

from riskloom.llm.sharding import even_tree, place, shard


def test_contract_on_mixed_rows(make_docs, mixed_rows):
    rows = shard(make_docs(mixed_rows), shards=40).collect()
    assert len(rows) == len(mixed_rows)
    slots, shards = defaultdict(list), defaultdict(set)
    for r in rows:
        slots[r.shard].append(r.slot)
        shards[r.doc_id].add(r.shard)
        assert 0 <= r.shard < 40 and r.law == "key" and r.grown_shard in (r.shard, 40)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())
    by_id = {r.doc_id: r for r in rows}
    for i, text, *_ in mixed_rows:
        data = (text or "").encode()
        assert (by_id[i].size, by_id[i].text_crc32) == (len(data) + 16, zlib.crc32(data))


def test_growth_moves_rows_only_into_the_new_shard(spark):
    keys = spark.range(20_000)
    from pyspark.sql import functions as F

    tree = even_tree(40)
    key = F.col("id").cast("string")
    before = {r.id: r.shard for r in place(keys, key, tree).collect()}
    after = {r.id: r.shard for r in place(keys, key, tree.grown()).collect()}
    moved = {i for i in before if before[i] != after[i]}
    assert {after[i] for i in moved} == {40}
    assert 0.6 * 20_000 / 41 < len(moved) < 1.4 * 20_000 / 41
    grown = {r.doc_id: r.grown_shard for r in shard(keys.selectExpr("id as doc_id", "'' as text"), 40).collect()}
    assert grown == after


def test_draws_follow_the_weights(spark):
    from pyspark.sql import functions as F

    from riskloom.llm.sharding import Tree

    tree = Tree((((1.0, 3.0),), ((2.0,), (2.0,))))
    found = Counter(r.shard for r in place(spark.range(8000), F.col("id").cast("string"), tree).collect())
    assert all(abs(found[s] / 8000 - w / 8) < 0.03 for s, w in enumerate((1, 3, 2, 2)))


def test_uneven_tree_numbers_every_shard(spark):
    from pyspark.sql import functions as F

    found = {r.shard for r in place(spark.range(3000), F.col("id").cast("string"), even_tree(11)).collect()}
    assert found == set(range(11)) and even_tree(11).shards == 11


def test_payload_keeps_columns_and_empty_table(make_docs, mixed_rows):
    docs = make_docs(mixed_rows, extra=False)
    out = shard(docs, payload=True)
    assert out.columns == [*docs.columns, "shard", "slot", "grown_shard"] and out.count() == len(mixed_rows)
    assert shard(make_docs([])).count() == 0


def test_tree_equals_brute_force(spark):
    """The descent, recomputed with another implementation of the hash."""
    import math

    import xxhash

    def u(node, key):
        h = xxhash.xxh64_intdigest(key.encode(), seed=xxhash.xxh64_intdigest(node.encode(), seed=42))
        return ((h >> 11) + 0.5) / 2**53

    def descend(key, regions):
        names, at = regions, "root"
        path = []
        while isinstance(names, tuple):
            total = lambda x: x if isinstance(x, float) else sum(map(total, x))
            draws = [(-math.log(u(f"{at}/{i}", key)) / total(x), i) for i, x in enumerate(names)]
            i = min(draws)[1]
            path.append(i)
            names, at = names[i], f"{at}/{i}"
        before = sum(len(k) for r in regions[: path[0]] for k in r) + sum(len(k) for k in regions[path[0]][: path[1]])
        return before + path[2]

    tree = even_tree(40)
    docs = spark.range(0, 3000, 1, 7).selectExpr("if(id % 100 = 7, null, id * 977) as doc_id", "'t' as text")
    for r in shard(docs).select("doc_id", "shard", "grown_shard").collect():
        key = "null" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (descend(key, tree.regions), descend(key, tree.grown().regions))


def test_repeated_ids_and_rows_make_no_bucket_hot(spark):
    docs = spark.range(6000).selectExpr("cast(null as long) as doc_id", "if(id < 3000, 'same', concat('t', id)) as text")
    for out in (shard(docs), shard(docs, payload=True)):
        rows = out.collect()
        assert len(rows) == 6000 and len({r.shard for r in rows}) == 1 and sorted(r.slot for r in rows) == list(range(6000))
    first = sorted((r.text_crc32, r.slot) for r in shard(docs).collect())
    assert first == sorted((r.text_crc32, r.slot) for r in shard(docs.repartition(13)).collect())
