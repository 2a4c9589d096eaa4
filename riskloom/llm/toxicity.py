"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over its words and word beginnings, and
the document's probability is the noisy-or of its sentences: one offending sentence is enough, and a clean
document needs all its sentences clean. The weights are trained from document labels alone, on a bounded
sample; the sentence scores then locate what offends.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import held, slices

_WORD = re.compile(r"[^\W_]+")
_SENTENCE = re.compile(r"[^\W_][^.!?\n]*")  # from its first letter or digit to its end
#: Lengths of the word beginnings that are features beside the whole word.
PREFIXES = (4, 5, 6)


@dataclass(frozen=True)
class ToxicityModel:
    weights: dict[str, float]
    bias: float
    threshold: float = 0.7


@dataclass(frozen=True)
class Training:
    """sample_toxic and sample_clean bound the labelled documents that are fetched; evidence is the least
    log-likelihood ratio of a feature."""

    sample_toxic: int = 1500
    sample_clean: int = 3000
    evidence: float = 12.0
    max_features: int = 4096
    steps: int = 300
    rate: float = 0.3
    decay: float = 1e-6


def features(word: str) -> list[str]:
    """The word itself and its beginnings, marked by a leading ``^``."""
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


def sentences(text: str | None) -> list[list[str]]:
    """Lower-cased words of every sentence that has any."""
    return [w for s in _SENTENCE.findall((text or "").lower()) if (w := _WORD.findall(s))]


def fit(texts: list[str], toxic: list[int], how: Training = Training()) -> ToxicityModel:
    """Maximise the noisy-or likelihood by gradient steps (Adam) over the selected features."""
    bags = [sentences(t) for t in texts]
    y = np.array(toxic, dtype=np.float64)
    if not len(bags) or y.min() == y.max():
        rate = float(y.mean()) if len(bags) else 0.0
        return ToxicityModel({}, -20.0 if rate < 0.5 else 20.0)
    inside, outside = Counter(), Counter()
    for bag, t in zip(bags, toxic, strict=True):
        (inside if t else outside).update({f for s in bag for w in s for f in features(w)})
    n1, n0 = float(y.sum()), float(len(y) - y.sum())

    def evidence(f: str) -> float:
        a, b = inside[f], outside[f]
        p = (a + b) / (n1 + n0)
        if a / n1 <= b / n0:
            return 0.0
        return 2 * sum(k * math.log(k / (n * p)) for k, n in ((a, n1), (b, n0)) if k)

    ranked = sorted(((evidence(f), f) for f, a in inside.items() if a > 1), key=lambda x: (-x[0], x[1]))
    names = [f for e, f in ranked[: how.max_features] if e >= how.evidence]
    number = {f: i for i, f in enumerate(names)}
    sentence_of, feature_of, document_of = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            for f in sorted({number[f] for w in s for f in features(w) if f in number}):
                sentence_of.append(len(document_of))
                feature_of.append(f)
            document_of.append(d)
    sentence, feature, document = (np.array(x, dtype=np.int64) for x in (sentence_of, feature_of, document_of))
    weights, bias = np.full(len(names), 0.5), -4.0
    moment, square = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, how.steps + 1):
        z = bias + np.bincount(sentence, weights=weights[feature], minlength=len(document))
        p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        clean = np.bincount(document, weights=np.logaddexp(0, z), minlength=len(y))  # -log of the chance that all are clean
        wrong = np.where(y > 0, -np.exp(-clean) / np.maximum(-np.expm1(-clean), 1e-9), 1.0)
        share = wrong[document] * p / len(y)
        slope = np.concatenate((np.bincount(feature, weights=share[sentence], minlength=len(names)) + how.decay * weights, [share.sum()]))
        moment = 0.9 * moment + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        move = how.rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8) / math.sqrt(1 + step / 20)
        weights, bias = weights - move[:-1], bias - move[-1]
    return ToxicityModel({f: float(w) for f, w in zip(names, weights, strict=True) if abs(w) > 0.02}, float(bias))


def learn(docs: DataFrame, labels: DataFrame, usable: Column, how: Training = Training(), id_col: str = "doc_id", label_col: str = "toxic") -> ToxicityModel:
    """Fit on the ``usable`` labelled documents with the smallest hash of their id, within the sample bounds.

    Null labels and labels without a document are not used; of contradicting labels of one id the toxic one counts.
    """
    marked = labels.where(usable & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).alias("__toxic"))
    ranked = marked.withColumn("__h", F.xxhash64("__id"))
    picked = None
    for value, most in ((1, how.sample_toxic), (0, how.sample_clean)):
        some = ranked.where(F.col("__toxic") == value).orderBy("__h", "__id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select(F.col(id_col).alias("__doc"), F.col("text").alias("__text")).join(F.broadcast(picked), F.col("__doc") == F.col("__id"))  # sample_toxic + sample_clean rows
    found = sorted((r["__h"], r["__doc"], r["__text"] or "", int(r["__toxic"])) for r in rows.select("__h", "__doc", "__text", "__toxic").toLocalIterator())
    return fit([t for _, _, t, _ in found], [y for *_, y in found], how)


class Scorer:
    def __init__(self, model: ToxicityModel) -> None:
        self.model = model
        self.quiet = float(np.logaddexp(0, model.bias))
        self.starts = {f.lstrip("^")[: min(PREFIXES)] for f in model.weights}

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """The document's probability, and start, end (in characters of the text) and probability of the
        sentences from 0.5 on."""
        lower, starts, n = (text or "").lower(), self.starts, min(PREFIXES)
        if not any(w[:n] in starts for w in _WORD.findall(lower)):
            return -math.expm1(-self.quiet * len(_SENTENCE.findall(lower))), []
        total, located, weights = 0.0, [], self.model.weights
        for m in _SENTENCE.finditer(lower):
            hot = {f for w in _WORD.findall(m.group()) if w[:n] in starts for f in features(w)}
            if not hot:
                total += self.quiet
                continue
            z = self.model.bias + sum(weights.get(f, 0.0) for f in sorted(hot))
            total += float(np.logaddexp(0, z))
            if z >= 0:
                located.append((m.start(), m.end(), 1 / (1 + math.exp(-min(z, 500)))))
        if located and len(lower) != len(text):  # some character is longer in lower case
            ends = list(accumulate(len(c.lower()) for c in text))
            located = [(bisect_right(ends, a), bisect_left(ends, e) + 1, p) for a, e, p in located]
        return -math.expm1(-total), located


_OUT = "score double, predicted int, offending array<struct<start:int,end:int,score:double>>"


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, score, predicted (score from the model's threshold on) and the offending sentences.

    Only the whole text decides, however long; null and empty texts have score 0. Equal texts get equal scores, repeated rows
    are scored each. Spans count characters of the text from 0, the end excluded. Other columns are ignored, and an empty table
    gives an empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)  # max_features weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        scorer = held("toxicity", (tuple(model.weights.items()), model.bias, model.threshold), lambda: Scorer(model))
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            for part in slices(batch, 1):
                found = [scorer.score(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([s for s, _ in found], pa.float64()),
                        pa.array([int(s >= scorer.model.threshold) for s, _ in found], pa.int32()),
                        pa.array([[{"start": a, "end": b, "score": p} for a, b, p in spans] for _, spans in found], kind),
                    ],
                    names=["doc_id", "score", "predicted", "offending"],
                )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, {_OUT}")
