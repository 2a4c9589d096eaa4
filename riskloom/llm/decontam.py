"""Benchmark decontamination by a BM25 inverted index of the test items with block-max WAND.

Passages of the training documents (overlapping windows of words) are the queries. A score is a share of the
item's own BM25 score, so that 1 means that all its terms are there; whatever reaches ``threshold`` is retrieved.
The windows are sized to the items: items of more than 2**(k-1) and at most 2**k words have an index and windows (of twice that
length) of their own, so no item's result depends on how long another one is. Document frequencies and the mean length are
those of the whole benchmark.

Retrieval has two steps that both only discard what cannot reach the threshold:

1. For all passages of an Arrow batch at once: an item's commonest terms, as long as they amount to less than
   the threshold together, can't make a hit alone. Summing the impacts of the other ("essential") terms by passage and
   item bounds every score from above.
2. Passages that are left go through block-max WAND: lists are moved by item, a pivot is chosen by list maxima,
   and blocks whose maxima don't add up are skipped.

A retrieved pair counts as a leak when enough of the shingles of the item's question and, if it has one, of its
answer (the last line or sentence) stand in the passage, or most of the shingles of the whole item do. Shingles of
answers of less than two widths are shorter (of at most a quarter of the words), so that one changed word doesn't undo all.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, StructField, StructType

from riskloom.llm.common import held, slices

BLOCK = 8
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


@dataclass(frozen=True)
class Rules:
    """threshold: share of the item's own score; the overlaps: shares of shingles of ``width`` words, item_overlap of the whole item."""

    threshold: float = 0.5
    question_overlap: float = 0.5
    answer_overlap: float = 0.5
    width: int = 5
    min_window: int = 32
    k1: float = 1.2
    b: float = 0.75
    slice_bytes: int = 16 << 20
    item_overlap: float = 0.75

    def answer_width(self, n: int) -> int:
        return self.width if n >= 2 * self.width else min(self.width, max(1, n // 4))


def words(text: str | None) -> list[bytes]:
    """Words without case and ASCII punctuation."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """The answer is the last line, or else the last sentence, of an item that has more than one."""
    body = text.strip()
    for mark in ("\n", ". ", "? ", "! "):
        head, found, tail = body.rpartition(mark)
        if found and words(head) and words(tail):
            return words(head), words(tail)
    return words(body), []


def shingles(tokens: list[bytes], width: int) -> set[tuple[bytes, ...]]:
    return set(zip(*[tokens[k:] for k in range(width)], strict=False))


@dataclass
class Index:
    """Posting lists over items 0, 1, ...; impacts are shares of the item's own score."""

    ids: list
    parts: list[tuple[tuple[set, int], ...]]  # of each item the shingles, and their width, of question and answer
    rules: Rules
    texts: list[list[bytes]]  # of each item the words
    terms: dict[bytes, int] = field(default_factory=dict)
    items: list[list[int]] = field(default_factory=list)  # of each term, ascending
    impacts: list[list[float]] = field(default_factory=list)
    blocks: list[list[float]] = field(default_factory=list)  # largest impact of each block of postings
    stride: int = 1


@dataclass
class Totals:
    """What scores and passages take from the whole benchmark, whatever its slices; df may be cut to a slice's terms."""

    n: int = 0
    words: int = 0
    df: Counter[bytes] = field(default_factory=Counter)

    def add(self, tokens: list[bytes]) -> None:
        if tokens:
            self.n += 1
            self.words += len(tokens)
            self.df.update(set(tokens))

    def cut(self, items: list[tuple]) -> Totals:
        own = {t for _, text in items for t in words(text)}
        return Totals(self.n, self.words, Counter({t: self.df[t] for t in sorted(own)}))


def stride(rules: Rules, n: int) -> int:
    """Words from one window to the next for items of ``n`` words: the power of two that holds them, min_window at least."""
    return max(rules.min_window, 1 << max(0, n - 1).bit_length())


def build(items: list[tuple], rules: Rules = Rules(), totals: Totals | None = None) -> list[Index]:
    """An index for each length of window, by length. ``totals`` are those of the whole benchmark where ``items`` are a slice of it."""
    tokens = [(i, words(t), question_and_answer(t or "")) for i, t in sorted(items, key=lambda x: (x[0] is not None, x[0], x[1] or ""))]
    tokens = [x for x in tokens if x[1]]
    if totals is None:
        totals = Totals()
        for _, w, _ in tokens:
            totals.add(w)
    by_stride: dict[int, list] = {}
    for x in tokens:
        by_stride.setdefault(stride(rules, len(x[1])), []).append(x)
    return [_index(own, rules, totals, n) for n, own in sorted(by_stride.items())]


def _index(tokens: list[tuple], rules: Rules, totals: Totals, window: int) -> Index:
    parts = []
    for _, _, (q, a) in tokens:
        widths = ((q, min(rules.width, len(q))), (a, rules.answer_width(len(a)) if a else 0))
        parts.append(tuple((shingles(x, w), w) for x, w in widths if w))
    index = Index([i for i, _, _ in tokens], parts, rules, [w for _, w, _ in tokens], stride=window)
    n, df, mean = totals.n, totals.df, totals.words / max(1, totals.n)
    lists: dict[bytes, list[tuple[int, float]]] = {}
    for k, (_, w, _) in enumerate(tokens):
        weight = {t: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (rules.k1 + 1) / (tf + rules.k1 * (1 - rules.b + rules.b * len(w) / mean)) for t, tf in Counter(w).items()}
        own = sum(weight.values())
        for t, x in weight.items():
            lists.setdefault(t, []).append((k, float(x / own)))
    for t in sorted(lists):
        index.terms[t] = len(index.items)
        impacts = [x for _, x in lists[t]]
        index.items.append([k for k, _ in lists[t]])
        index.impacts.append(impacts)
        index.blocks.append([max(impacts[a : a + BLOCK]) for a in range(0, len(impacts), BLOCK)])
    return index


def block_max_wand(index: Index, query: set[int], threshold: float) -> list[tuple[int, float]]:
    """All (item, score) with a score of at least ``threshold`` for a query of term numbers, by item."""
    end = len(index.ids)
    cursors = [[t, 0, index.items[t][0]] for t in query]  # term, position, item there
    top = {t: max(index.blocks[t]) for t in query}
    slack = threshold - 1e-9
    out = []

    def advance(c: list, to: int) -> None:
        own = index.items[c[0]]
        c[1] = bisect_left(own, to, c[1])
        c[2] = own[c[1]] if c[1] < len(own) else end

    while True:
        cursors = sorted((c for c in cursors if c[2] < end), key=lambda c: c[2])
        bound, pivot = 0.0, None
        for k, c in enumerate(cursors):
            bound += top[c[0]]
            if bound >= slack:
                pivot = k
                break
        if pivot is None:
            return out
        item = cursors[pivot][2]
        while pivot + 1 < len(cursors) and cursors[pivot + 1][2] == item:
            pivot += 1
        shallow, nearest = 0.0, end
        for c in cursors[: pivot + 1]:
            own = index.items[c[0]]
            at = bisect_left(own, item, c[1])
            if at < len(own):
                block = at // BLOCK
                shallow += index.blocks[c[0]][block]
                last = min((block + 1) * BLOCK, len(own)) - 1
                nearest = min(nearest, own[last] + 1)
        if shallow < slack:  # no item up to the nearest block end can reach the threshold
            to = max(item + 1, min(nearest, cursors[pivot + 1][2] if pivot + 1 < len(cursors) else end))
            for c in cursors[: pivot + 1]:
                advance(c, to)
            continue
        for c in cursors[: pivot + 1]:
            advance(c, item)
        score = sum(index.impacts[c[0]][c[1]] for c in cursors if c[2] == item)
        if score >= slack:
            out.append((item, score))
        for c in cursors:
            if c[2] == item:
                advance(c, item + 1)


class _Prepared:
    """An index of one length of window, made ready for batches of documents."""

    def __init__(self, index: Index, vocabulary: dict[bytes, int]) -> None:
        self.index, n = index, len(index.ids)
        limit = index.rules.threshold
        # from the commonest terms on: an item skips terms while what it skips stays below the threshold
        skipped = np.zeros(n)
        essential: list[tuple[int, int, float]] = []
        for t in sorted(range(len(index.items)), key=lambda t: (-len(index.items[t]), t)):
            for k, x in zip(index.items[t], index.impacts[t], strict=True):
                if skipped[k] + x < 0.4 * limit:
                    skipped[k] += x
                else:
                    essential.append((t, k, x))
        essential.sort()
        self.need = limit - skipped - 1e-9
        counts = np.zeros(len(index.items) + 1, dtype=np.int64)
        np.add.at(counts, [t + 1 for t, _, _ in essential], 1)
        self.first = np.cumsum(counts)
        self.item = np.array([k for _, k, _ in essential], dtype=np.int64)
        self.impact = np.array([x for _, _, x in essential])
        # of each word of the shared vocabulary the term number here, or -1 where it is no essential term
        self.term = np.full(len(vocabulary) + 1, -1, dtype=np.int64)
        for w, t in index.terms.items():
            if self.first[t + 1] > self.first[t]:
                self.term[vocabulary[w]] = t

    def _whole(self, k: int, passage: list[bytes]) -> float:
        """The share of the shingles of the whole item that stand in the passage."""
        own = self.index.texts[k]
        width = min(self.index.rules.width, len(own))
        part = shingles(own, width)
        return len(part & shingles(passage, width)) / len(part)

    def leaks(self, tokens: list[list[bytes]], begin: np.ndarray, ids: np.ndarray) -> Iterator[tuple[int, tuple]]:
        """(text, (item id, score, question overlap, answer overlap)) of every passage in which an item leaks."""
        index, rules, window, n = self.index, self.index.rules, self.index.stride, len(self.index.ids)
        term = self.term[ids]
        hit = np.flatnonzero(term >= 0)
        if not len(hit):
            return
        term = term[hit]
        doc = np.searchsorted(begin, hit, side="right") - 1
        windows = np.diff(begin) // window + 2  # one empty stride apart
        base = np.concatenate(([0], np.cumsum(windows)))
        slot = base[doc] + (hit - begin[doc]) // window + 1
        fan = self.first[term + 1] - self.first[term]
        at = np.repeat(self.first[term] - np.concatenate(([0], np.cumsum(fan)[:-1])), fan) + np.arange(int(fan.sum()))
        key = np.repeat(slot, fan) * n + self.item[at]
        key, impact = np.concatenate((key, key - n)), np.concatenate((self.impact[at], self.impact[at]))
        order = np.argsort(key)
        key = key[order]
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        bound, key = np.add.reduceat(impact[order], starts), key[starts]
        get = index.terms.get
        for slot in np.unique(key[bound >= self.need[key % n]] // n).tolist():
            d = int(np.searchsorted(base, slot, side="right")) - 1
            low = max(0, (slot - base[d] - 1) * window)
            passage = tokens[d][low : (slot - base[d] + 1) * window]
            query = {get(w, -1) for w in passage} - {-1}
            for k, score in block_max_wand(index, query, rules.threshold):
                q, a = ([*(len(part & shingles(passage, width)) / len(part) for part, width in index.parts[k]), 1.0])[:2]
                if (q >= rules.question_overlap and a >= rules.answer_overlap) or self._whole(k, passage) >= rules.item_overlap:
                    yield d, (index.ids[k], score, q, a)


class Searcher:
    """Indexes made ready for batches of documents; texts are cut into words once for all of them."""

    def __init__(self, indexes: list[Index]) -> None:
        self.vocabulary: dict[bytes, int] = {}
        for index in indexes:
            for w in index.terms:
                self.vocabulary.setdefault(w, len(self.vocabulary))
        self.parts = [_Prepared(index, self.vocabulary) for index in indexes]

    def leaks(self, texts: list[str | None]) -> list[list[tuple]]:
        """Of each text: (item id, score, question overlap, answer overlap) of the best passage of each leaked item."""
        best: list[dict] = [{} for _ in texts]
        get, unknown = self.vocabulary.get, len(self.vocabulary)
        tokens = [words(t) for t in texts]
        begin = np.concatenate(([0], np.cumsum([len(own) for own in tokens]))).astype(np.int64)
        ids = np.fromiter((get(w, unknown) for own in tokens for w in own), dtype=np.int64, count=int(begin[-1]))
        for part in self.parts:
            for d, x in part.leaks(tokens, begin, ids):
                if x[0] not in best[d] or x[1:] > best[d][x[0]][1:]:
                    best[d][x[0]] = x
        return [[own[i] for i in sorted(own, key=lambda i: (i is not None, i))] for own in best]


@dataclass
class Slice:
    """Items of bounded size, which get indexes of their own; the key tells slices apart by what is in them."""

    items: list[tuple]
    totals: Totals
    key: str


def _searcher(part: Slice, rules: Rules) -> Searcher:
    """Built once in each Python worker for equal slices and rules."""
    return held("benchmark", f"{part.key} {rules}", lambda: Searcher(build(part.items, rules, part.totals)))


def _slices(benchmark: DataFrame, rules: Rules, item_col: str, text_col: str) -> Iterator[Slice]:
    """The items in slices of bounded size, one at a time; all are scored by the totals of the whole benchmark.

    The benchmark is read twice, for its totals (which hold its vocabulary) and for the slices.
    """
    given = benchmark.where(F.length(text_col) > 0).select(item_col, text_col)
    totals = Totals()
    for r in given.select(text_col).toLocalIterator():
        totals.add(words(r[0]))
    items, size = [], 0
    for r in given.toLocalIterator():
        items.append((r[0], r[1]))
        size += len(r[1].encode("utf-8", "surrogatepass"))
        if size >= rules.slice_bytes:
            yield _slice(items, totals.cut(items))
            items, size = [], 0
    if items:
        yield _slice(items, totals.cut(items))


def _slice(items: list[tuple], totals: Totals) -> Slice:
    key = hashlib.sha256()
    for x in (totals.n, totals.words, *sorted(totals.df.items()), *items):
        key.update(f"{x!r}\n".encode("utf-8", "surrogatepass"))
    return Slice(items, totals, key.hexdigest())


def find_leaks(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, score, question_overlap, answer_overlap.

    Clean documents have no row. Null and empty texts, on either side, match nothing; items may have any id, also none
    (items that share one are one item, whose best passage counts); repeated rows of documents are reported
    each; very long texts are read whole, in overlapping windows twice as long as the items searched; an empty
    benchmark or table gives an empty result; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    own = benchmark.schema[item_col].dataType
    schema = StructType([rows.schema["doc_id"], StructField("item_id", own), *[StructField(n, DoubleType()) for n in _SCORES]])
    kind = to_arrow_type(own)
    out = None
    for part in _slices(benchmark, rules, item_col, "text"):
        sent = docs.sparkSession.sparkContext.broadcast(part)  # slice_bytes at most, and one item

        def search(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searcher = _searcher(sent.value, rules)
            for batch in batches:
                for some in slices(batch, 1, rows=256):
                    leaks = searcher.leaks(some.column(1).to_pylist())
                    at = [k for k, found in enumerate(leaks) for _ in found]
                    flat = [x for found in leaks for x in found]
                    yield pa.RecordBatch.from_arrays(
                        [some.column(0).take(pa.array(at, pa.int64())), pa.array([x[0] for x in flat], kind), *[pa.array([x[k] for x in flat], pa.float64()) for k in (1, 2, 3)]],
                        names=["doc_id", "item_id", *_SCORES],
                    )

        here = rows.mapInArrow(search, schema)
        out = here if out is None else out.unionByName(here)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


_SCORES = ("score", "question_overlap", "answer_overlap")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, rules: Rules = Rules(), text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """The rows of ``docs`` without any leaked item, in one pass over them per benchmark slice."""
    at = docs.columns.index(text_col)
    for part in _slices(benchmark, rules, item_col, "text"):
        sent = docs.sparkSession.sparkContext.broadcast(part)

        def keep(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searcher = _searcher(sent.value, rules)
            for batch in batches:
                for some in slices(batch, at, rows=256):
                    yield some.filter(pa.array([not x for x in searcher.leaks(some.column(at).to_pylist())], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
