import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm.jaccard import components, jaccard_classes, linked, occurrences, probe, shingle_sets, steps, walked

import numpy as np


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    sets = {}
    for i, t, *_ in rows:
        sets.setdefault(i, []).append(shingles(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            if any(linked(len(a & b), len(a), len(b)) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def check(make_docs, rows):
    got = jaccard_classes(make_docs(rows)).collect()
    assert len(got) == len(rows)
    expected = brute(rows)
    assert {r.doc_id: r.component_id for r in got} == expected
    assert sorted((r.doc_id, r.n_shingles) for r in got) == sorted((i, len(shingles(t))) for i, t, *_ in rows)


@given(st.lists(st.text(alphabet="aB \t\n\x0b\x1c é", max_size=40), max_size=8))
@settings(max_examples=60, deadline=None)
def test_shingle_counts(texts):
    assert [len(s) for s in shingle_sets(texts)] == [len(shingles(t)) for t in texts]


def test_equal_shingles_have_equal_hashes_wherever_they_stand():
    a, b = shingle_sets(["x y z p q r", "filler words first x Y z P q r and more"])
    assert probe(a, b) == 2
    assert probe(np.array([1, 3, 5]), np.array([2, 3])) == 1 and probe(np.array([], dtype=int), np.array([1])) == 0


def test_copies_near_copies_and_special_texts(make_docs):
    rng = random.Random(11)
    text = lambda n: [f"v{rng.randrange(5000)}" for _ in range(n)]
    shared = text(60)
    rows, i = [], 0
    for _ in range(12):
        base = text(rng.randrange(20, 160))
        for _ in range(rng.randrange(1, 9)):
            own = list(base)
            for _ in range(rng.randrange(0, 4)):
                own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            rows.append((i, " ".join(own), "en", "s"))
            i += 1
    for _ in range(15):  # unrelated documents with a common passage
        rows.append((i, " ".join([*text(rng.randrange(10, 60)), *shared, *text(20)]), "en", "s"))
        i += 1
    rows += [(i, None, None, None), (i + 1, "", "en", "s"), (i + 2, " \n", "en", "s"), (i + 3, "one two", "en", "s"), (i + 4, "ONE  two", "en", "s"), (i + 5, "one two three", "en", "s")]
    rows += [(i + 6, rows[0][1].upper(), "en", "s"), rows[1], rows[1], (i + 7, " ".join(text(20_000)), "en", "s")]
    check(make_docs, rows)


def test_chain_and_large_group(make_docs):
    rng = random.Random(4)
    base = [f"c{k}" for k in range(80)]
    rows = []
    for i in range(60):  # each differs from the next by little, from the first by much
        base = list(base)
        base[rng.randrange(80)] = f"d{i}"
        rows.append((i, " ".join(base), "en", "s"))
    rows += [(100 + i, "the same text of six words", "en", "s") for i in range(200)]
    check(make_docs, rows)


def test_rows_without_id_and_repeated_ids(make_docs, mixed_rows):
    got = jaccard_classes(make_docs(mixed_rows)).collect()
    assert len(got) == len(mixed_rows)
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(1, None)]
    named = [r for r in mixed_rows if r[0] is not None]
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == brute(named)


def test_empty_table(make_docs):
    assert jaccard_classes(make_docs([])).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(50)] + [(k, k + 1) for k in range(100, 140)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent if find(x) != x}


@given(st.lists(st.lists(st.integers(0, 4000), max_size=30), max_size=6))
@settings(max_examples=80, deadline=None)
def test_packed_owners_round_trip(runs):
    runs = [sorted(r) for r in runs]
    numbers = np.array([x for r in runs for x in r], dtype=np.int64)
    sizes = np.array([len(r) for r in runs], dtype=np.int64)
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    data, ends = steps(numbers, starts)
    assert walked(data.tobytes(), sizes).tolist() == numbers.tolist() and len(ends) == len(numbers)


@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)), st.integers(0, 100), st.integers(0, 60))
@settings(max_examples=200, deadline=None)
def test_occurrences_by_merge_and_probe(a, b, seed, need):
    x, y = (np.array(sorted(s), dtype=np.int64) for s in (a, b))
    short = np.array([random.Random(seed + int(v)).random() < 0.4 for v in x], dtype=bool)
    got = occurrences(x, short, y, need)
    assert got == len(a & b) or (got < need and len(a & b) < need)


def test_a_list_that_all_documents_share(make_docs):
    """A common passage and nothing else alike: no link, and copies among them still found."""
    rng = random.Random(12)
    shared = " ".join(f"common{k}" for k in range(60))
    rows = [(i, f"{' '.join(f'u{rng.randrange(10**6)}' for _ in range(10))} {shared}" if i % 3 else f"{shared} tail{i // 6}", "en", "s") for i in range(300)]
    check(make_docs, rows)
