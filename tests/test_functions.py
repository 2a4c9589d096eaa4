import hashlib

from pyspark.sql import functions as F

from riskloom.functions.digests import EMPTY, manifest_digest, ordered_set_sha256, tree_digest
from riskloom.functions.expr import business_key, castable, in_force, null_if_blank, ratio, record_hash, semver, try_cast


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


def test_blanks_and_casts(spark):
    assert one(spark, null_if_blank("a"), a="  ") is None and one(spark, null_if_blank("a"), a=" b ") == "b"
    assert one(spark, try_cast("a", "decimal(12,2)"), a="abc") is None and str(one(spark, try_cast("a", "decimal(12,2)"), a=" 1.5 ")) == "1.50"
    assert one(spark, try_cast("a", "date"), a="2016-13-45") is None
    df = spark.createDataFrame([("abc", None), ("", None), (None, None), ("1", 1)], "raw string, typed int")
    assert [r.ok for r in df.select(castable("raw", "typed").alias("ok")).collect()] == [False, True, True, True]


def test_hashes_and_keys(spark):
    df = spark.createDataFrame([("a", 1, None)], "x string, y int, z string")
    expected = hashlib.sha256(b"a|1|<NULL>").hexdigest()
    assert df.select(record_hash(["x", "y", "z"]).alias("h")).first().h == expected
    assert df.select(business_key(["x", "y"]).alias("k")).first().k == "a|1"
    assert df.select(business_key(["x", "z"]).alias("k")).first().k is None


def test_versions_compare_by_number(spark):
    df = spark.createDataFrame([("1.10.0", "1.9.9"), ("2.0.0", "10.0.0"), ("x", "1.0.0")], "a string, b string")
    assert [r.g for r in df.select((semver("a") > semver("b")).alias("g")).collect()] == [True, False, None]


def test_ratio_and_ranges(spark):
    df = spark.createDataFrame([("1", "3"), ("1", "0")], "a string, b string").select(ratio(F.col("a").cast("decimal(20,8)"), F.col("b").cast("decimal(20,8)")).alias("r"))
    assert [r.r if r.r is None else str(r.r)[:14] for r in df.collect()] == ["0.333333333333", None]
    d = lambda x: F.lit(x).cast("date")
    assert one(spark, in_force(d("2020-01-01"), d(None), d("2020-01-01"))) and one(spark, in_force(d("2020-01-01"), d("2020-02-01"), d("2020-02-01")))
    assert not one(spark, in_force(d("2020-01-01"), d("2020-02-01"), d("2020-02-02")))


def test_digests_ignore_the_order_of_rows(spark):
    rows = [(i % 3, i) for i in range(500)]
    a, b = spark.createDataFrame(rows, "g int, v int"), spark.createDataFrame(rows[::-1], "g int, v int").repartition(7)
    text = F.col("v").cast("string")
    exact = lambda df: df.agg(ordered_set_sha256(text, F.col("v")).alias("d")).first().d
    assert exact(a) == exact(b) == hashlib.sha256("\n".join(str(i) for i in range(500)).encode()).hexdigest()
    assert exact(a.limit(0)) == EMPTY
    tree = lambda df: sorted(map(tuple, tree_digest(df, ["g"], text, F.col("v")).collect()))
    assert tree(a) == tree(b) and tree(a) != tree(a.where("v <> 3")) and [r[1] for r in tree(a)] == [167, 167, 166]


def test_manifest_is_ordered_by_dataset(spark):
    entry = "dataset string, contract_version string, snapshot_ref string, scope string, rows long, digest string"
    rows = [("b", "1", "s", "all", 2, "x"), ("a", "1", "s", "all", 1, "y")]
    got = manifest_digest(spark.createDataFrame(rows, entry)).first()
    assert got.datasets == 2 and got.manifest_sha256 == hashlib.sha256(b"a|1|s|all|1|y\nb|1|s|all|2|x").hexdigest()


def test_digest_levels_follow_from_the_number_of_rows(spark):
    import hashlib

    from riskloom.functions.digests import leaf_digits

    assert [leaf_digits(n) for n in (0, 4096, 4097, 65536, 65537, 10**12)] == [0, 0, 1, 1, 2, 7]
    rows = spark.range(300).select(F.lit("g").alias("g"), F.col("id").alias("k"), F.concat(F.lit("row"), F.col("id")).alias("text"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    def folded(members, digits, depth=0):
        """members: (hash of key, key, text) of one bucket; levels end at digits, digits - 3, ... counted from the leaves."""
        ends = sorted({max(0, e) for e in range(digits, -3, -3)})
        if depth == len(ends) - 1:
            return sha("\n".join(t for _, _, t in sorted(members, key=lambda m: m[1])))
        buckets = {}
        for m in members:
            buckets.setdefault(m[0][: ends[depth + 1]], []).append(m)
        return sha("\n".join(folded(own, digits, depth + 1) for _, own in sorted(buckets.items())))

    members = [(sha(str(k)), k, f"row{k}") for k in range(300)]
    for digits in (1, 2, 4, 5):
        assert tuple(tree_digest(rows, ["g"], F.col("text"), F.col("k"), digits).first()) == ("g", 300, folded(members, digits))
