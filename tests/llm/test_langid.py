import random

from pyspark.sql import functions as F

from riskloom.llm.langid import SEGMENT, Automaton, LanguageModel, clean, identify, learn, predict

TRAIN = {"a": b"the house and the garden of the king and the queen " * 20, "b": b"das haus und der garten vom koenig und der koenigin " * 20}


def brute_phrases(text, train):
    n, i = 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in train:
            j += 1
        n, i = n + 1, max(j - 1, i + 1)
    return n


def test_phrases_equal_brute_force():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"abcdehin rst\xc3\xa9") for _ in range(rng.randrange(1, 900))) for _ in range(60)] + [b"", b"zz", b"the queen"]
    texts += [b"the house and the garden " * 200, TRAIN["a"] * 3, b"the queen " * 25 + b"zz" + b"der garten vom " * 60]  # phrases that go on over the borders of segments
    assert max(map(len, texts)) > 4 * SEGMENT
    for train in TRAIN.values():
        assert Automaton(train).phrases(texts).tolist() == [brute_phrases(t, train) for t in texts]


def test_identify_defined_results():
    model = LanguageModel((("a", TRAIN["a"], 5), ("b", TRAIN["b"], 9)))
    langs, scores = identify(["The king!", "Der König und das Haus", None, "", "123 ...", "x" * 200_000], model)
    assert langs[:5] == ["a", "b", "und", "und", "und"] and langs[5] in ("a", "b")
    assert all(0 <= s <= 1 for s in scores) and scores[2:5] == [0, 0, 0]
    alike = LanguageModel((("a", TRAIN["a"], 5), ("b", TRAIN["a"], 9)))
    assert identify(["the king"], alike) == (["b"], [0.5])  # a tie goes to the language with more documents
    assert identify(["text"], LanguageModel(())) == (["und"], [0.0])


def test_clean():
    assert clean("Hello,  WORLD 12é") == "hello world é".encode() and clean(None) == b""
    assert clean("„Été“ — ok… 😀 ٣ x\u00a0y") == "été ok x y".encode() and clean("हिन्दी।") == "हिन्दी".encode()


def test_language_with_long_documents_only(make_docs):
    rng = random.Random(6)
    vocabulary = {"en": "the and of house garden king queen river stone".split(), "fi": "talo ja puutarha kuningas joki kivi vesi metsä".split()}
    rows = [(i, " ".join(rng.choices(vocabulary["en"], k=30)), "en", "s") for i in range(40)]
    rows += [(100 + i, " ".join(rng.choices(vocabulary["fi"], k=2000)), "fi", "s") for i in range(4)]
    docs = make_docs(rows)
    model = learn(docs, F.lit(True), sample_bytes=4000)
    assert [m[0] for m in model.samples] == ["en", "fi"] and all(0 < len(m[1]) <= 5000 for m in model.samples)
    assert {r.doc_id: r.lang_pred for r in predict(docs, model).collect()} == {i: lang for i, _, lang, _ in rows}


def test_learn_and_predict(make_docs):
    rng = random.Random(2)
    vocabulary = {"en": "the and of house garden king queen river stone".split(), "de": "der und von haus garten könig fluss stein das".split()}
    rows = [(i, " ".join(rng.choices(vocabulary[lang], k=30)), lang, "s") for i in range(120) for lang in [("en", "de")[i % 2]]]
    rows += [(200, None, "en", None), (201, "", "de", "s"), (202, "der könig", None, "s"), (203, "the king", None, "s"), (203, "the king", None, "s")]
    docs = make_docs(rows)
    model = learn(docs, F.col("doc_id") % 5 != 0)
    assert [m[0] for m in model.samples] == ["de", "en"]
    out = predict(docs, model)
    assert set(docs.columns) | {"lang_pred", "score"} == set(out.columns)
    got = {r.doc_id: r.lang_pred for r in out.collect()}
    assert all(got[i] == lang for i, t, lang, _ in rows[:120]) and got[200] == got[201] == "und" and got[202] == "de" and got[203] == "en"
    assert out.count() == len(rows)
    assert predict(make_docs([]), model).count() == 0
    assert learn(make_docs([]), F.lit(True)).samples == ()
