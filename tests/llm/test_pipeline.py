import random

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("sf")
    rng = random.Random(1)
    vocabulary = {"en": [f"th{k}e" for k in range(300)], "de": [f"sch{k}ß" for k in range(300)]}
    text = lambda lang, n: " ".join(rng.choices(vocabulary[lang], k=n))
    items = [(k, text("en", 25)) for k in range(6)]
    rows = [(i, text(("en", "de")[i % 2], rng.randrange(20, 80)), ("en", "de")[i % 2], f"s{i % 3}") for i in range(120)]
    rows += [(200 + k, f"{text('en', 10)} {items[k][1]} {text('en', 10)}", "en", "s0") for k in range(6)]
    rows += [(300 + k, rows[k][1], "en", "s1") for k in range(10)]
    rows += [(400, None, None, None), (401, "123 456", "en", "s0"), (402, "", "de", None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "ngram_jaccard", "decontamination", "mixing", "sharding"]
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    kept = stages["language_id"](spark, docs, sf_dir)
    assert kept.columns == docs.columns and ids(kept) == [i for i in ids(docs) if i < 400]
    alone = stages["ngram_jaccard"](spark, kept, sf_dir)
    assert alone.columns == docs.columns and ids(alone) == [i for i in ids(kept) if i < 300]
    clean = stages["decontamination"](spark, alone, sf_dir)
    assert clean.columns == docs.columns and ids(clean) == [i for i in ids(alone) if i < 200]
    mixed = stages["mixing"](spark, clean, sf_dir)
    assert mixed.columns == docs.columns and set(ids(mixed)) <= set(ids(clean))
    total = clean.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0]
    assert abs(mixed.agg(F.sum(F.regexp_count("text", F.lit(r"\S+")))).first()[0] - total) <= 0.03 * total
    sharded = stages["sharding"](spark, mixed, sf_dir)
    assert sharded.columns == [*docs.columns, "shard", "slot", "grown_shard"] and ids(sharded) == ids(mixed)


def test_run_is_repeatable(spark, sf_dir):
    rows = lambda: sorted(map(str, corpus_pipeline.run(spark, sf_dir).select("doc_id", "shard", "slot").collect()))
    assert rows() == rows()


def test_one_row_of_each_group_of_copies_stays(spark, make_docs):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(40))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a, "en", "s"), (1, a, "en", "s"), (1, a, "de", "s"), (2, a + " end", "en", "s")]  # repeats of an id, and a near copy
    rows += [(None, b, "en", "s"), (None, b, "en", "t"), (None, c, "en", "s"), (3, c, "en", "s"), (None, a, "en", "s")]  # without an id
    rows += [(4, d, "en", "s"), (4, e, "en", "s"), (4, e, "en", "s"), (None, "", "en", "s"), (None, None, None, None), (5, "", "en", "s")]
    docs = make_docs(rows, extra=False)
    got = dict(corpus_pipeline.STAGES)["ngram_jaccard"](spark, docs, "")
    assert got.columns == docs.columns
    found = sorted(((r.doc_id, r.text) for r in got.collect()), key=str)
    assert [x for x in found if x[1]] == sorted([(1, a), (None, b), (3, c), (4, d), (4, e)], key=str)
    assert len(found) == 8  # and the three without words


def test_stages_equal_brute_force(spark, make_docs):
    """Every stage on its own input against another computation."""
    from test_decontam import brute as leaks
    from test_jaccard import brute as classes

    from riskloom.llm.decontam import Rules
    from riskloom.llm.mixing import plan
    from riskloom.llm.sharding import shard

    rng = random.Random(8)
    vocabulary = {"en": [f"th{k}e" for k in range(200)], "de": [f"sch{k}\u00df" for k in range(200)]}
    text = lambda lang, n: rng.choices(vocabulary[lang], k=n)
    items = [(k, " ".join(text("en", rng.randrange(14, 40))) + ". " + " ".join(text("en", 8)) + ".") for k in range(8)]
    rows = []
    for i in range(90):
        own = text(("en", "de")[i % 2], rng.randrange(15, 90))
        if i % 10 == 1:
            own = [*own[:6], *items[i % 8][1].split(), *own[6:]]
        rows.append((i, " ".join(own), ("en", "de")[i % 2], f"s{i % 3}"))
        if i % 6 == 0:  # near copies, some of them too far away
            for k in range(3):
                changed = list(own)
                changed[rng.randrange(len(own))] = f"n{k}"
                rows.append((1000 + 10 * i + k, " ".join(changed), "en", "s1"))
    rows += [(5000, None, "en", "s0"), (5001, "12 34", "en", None), (5002, "", None, "s0")]
    docs, stages = make_docs(rows, extra=False), dict(corpus_pipeline.STAGES)
    import tempfile

    sf_dir = tempfile.mkdtemp()
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf_dir}/benchmark.parquet")
    held = lambda df: sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
    after = stages["language_id"](spark, docs, sf_dir)
    expected = sorted((i, t) for i, t, *_ in rows if any(c.isalpha() for c in t or ""))
    assert held(after) == expected
    after = stages["ngram_jaccard"](spark, after, sf_dir)
    roots = classes(expected)
    expected = [(i, t) for i, t in expected if roots[i] == i]
    assert held(after) == expected and len(expected) < len(roots)
    after = stages["decontamination"](spark, after, sf_dir)
    bad = {d for d, _ in leaks(expected, items, Rules())}
    expected = [(i, t) for i, t in expected if i not in bad]
    assert held(after) == expected and len(bad) >= 5
    copies = {r.doc_id: r.copies for r in plan(after).collect()}
    after = stages["mixing"](spark, after, sf_dir)
    expected = sorted((i, t) for i, t in expected for _ in range(copies[i]))
    assert held(after) == expected
    last = stages["sharding"](spark, after, sf_dir)
    assert held(last) == expected
    by_id = lambda df: sorted({(r.doc_id, r.shard, r.grown_shard) for r in df.collect()})
    assert by_id(last) == by_id(shard(after))


def test_unusual_rows_in_every_stage(spark, make_docs, mixed_rows, sf_dir):
    for rows in (mixed_rows, [], [(None, None, None, None)] * 3, [(1, "same text here", "en", "s")] * 4):
        docs = make_docs(rows)  # with columns whose names clash with the operators' own
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name == "sharding":
                assert set(out.columns) == {*docs.columns, "shard", "slot", "grown_shard"} and out.count() == len(rows)
                continue
            assert out.columns == docs.columns
            got = [r.text for r in out.select("text").collect()]
            assert set(got) <= {r[1] for r in rows}
            if name == "language_id":
                assert len(got) == sum(any(c.isalpha() for c in r[1] or "") for r in rows)
    nothing = make_docs([(i, "some words", None, "s") for i in range(3)] + [(9, "12", None, "s")], extra=False)
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, nothing, sf_dir).collect()) == [0, 1, 2]
