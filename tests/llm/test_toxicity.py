import math
import random
import re

from pyspark.sql import functions as F

from riskloom.llm.toxicity import Scorer, Training, fit, learn, score, sentences

BAD = ["vilegrub", "rottenham", "smeltoad"]


def corpus(n=400, seed=1):
    rng = random.Random(seed)
    texts, labels = [], []
    for i in range(n):
        own = [[f"word{rng.randrange(300)}" for _ in range(rng.randrange(3, 12))] for _ in range(rng.randrange(1, 30))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 3)):
                own[rng.randrange(len(own))].insert(1, rng.choice(BAD))
        texts.append(". ".join(" ".join(s) for s in own))
        labels.append(int(toxic))
    return texts, labels


def test_held_out_accuracy_and_located_sentences():
    texts, labels = corpus()
    model = fit(texts[:300], labels[:300])
    scorer = Scorer(model)
    for text, label in zip(texts[300:], labels[300:]):
        p, spans = scorer.score(text)
        assert (p >= model.threshold) == bool(label)
        assert all(any(b in text.lower()[a:e] for b in BAD) for a, e, _ in spans)
        assert bool(spans) == bool(label)


def test_score_is_the_noisy_or_of_sentences():
    """Against a plain computation from the weights, without the scorer."""
    texts, labels = corpus()
    model = fit(texts, labels)

    def plain(text):
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", text.lower()):
            own = set()
            for w in re.findall(r"[a-z0-9]+", sentence):
                own |= {w, *("^" + w[:n] for n in (4, 5, 6) if len(w) >= n)}
            if own:
                clean *= 1 - 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(f, 0) for f in own))))
        return 1 - clean

    for text in [*texts[:60], "VileGrub! word1? rottenham", "", "..."]:
        assert abs(Scorer(model).score(text)[0] - plain(text)) < 1e-9


def test_spans_count_characters_of_the_text():
    model = fit(*corpus())
    text = "İİİ word1. İ vilegrub İ. word2"
    (a, e, p), = Scorer(model).score(text)[1]
    assert len(text.lower()) != len(text) and text[a:e] == "İ vilegrub İ" and p >= 0.5


def test_defined_results():
    assert sentences(None) == [] == sentences(" .!\n")
    model = fit([], [])
    assert Scorer(model).score("anything")[0] < 0.01
    assert Scorer(fit(["a b"], [1])).score("a b")[0] > 0.7
    model = fit(*corpus())
    assert Scorer(model).score(None) == (0, []) == Scorer(model).score("")
    assert 0 <= Scorer(model).score("word1 word2. " * 50_000)[0] <= 1


def test_frames(spark, make_docs, mixed_rows):
    texts, labels = corpus(200)
    rows = [(1000 + i, t, "en", "s") for i, t in enumerate(texts)]
    docs = make_docs([*rows, *mixed_rows])
    marks = spark.createDataFrame([(1000 + i, y) for i, y in enumerate(labels)] + [(1000, None), (5, None), (None, 1), (77777, 1), (1001, 0)], "doc_id long, toxic int")
    model = learn(docs, marks, F.col("doc_id") % 3 != 1, Training(sample_toxic=40, sample_clean=80))
    got = score(docs, model).collect()
    assert len(got) == len(rows) + len(mixed_rows)
    truth = {1000 + i: y for i, y in enumerate(labels)}
    assert all(r.predicted == truth[r.doc_id] for r in got if r.doc_id in truth)
    assert all(r.score == 0 for r in got if r.doc_id in (60, 61, 62))
    assert score(make_docs([]), model).count() == 0
