"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over labelled text of a bounded, documented size. A text is cut
into phrases greedily: each phrase is the longest match of what is left of the text with some substring of the
language's training text. A text needs few, long phrases in its own language. The language with the lowest
``phrases * log2(training length) / text length`` (bits a byte) wins.

Texts are lower-cased UTF-8; every run of anything that is neither a letter nor its mark counts as one separator. The
automata are laid out as dense tables, and all texts of a slice are walked at once, one byte a step, in segments of fixed
length. A segment is first walked from the root, and again from the state in which its predecessor ended, until no end
changes any more; so phrases go on over the borders of segments, as if each text were walked by itself. Two walks that
begin a phrase at the same byte agree from there on, which is why one more round nearly always suffices.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from riskloom.llm.common import held, slices

UNKNOWN = "und"
SEGMENT = 256


@dataclass(frozen=True)
class LanguageModel:
    """Training text by language (cleaned bytes) and the number of labelled documents behind it."""

    samples: tuple[tuple[str, bytes, int], ...]


def _clean_table() -> bytes:
    """Byte map: ASCII letters and the bytes of longer characters stay, what else there is becomes a space."""
    return bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


_CLEAN = _clean_table()


#: Characters beyond ASCII that are no letters: punctuation, digits, symbols, spaces.
_FOREIGN = regex.compile(r"[^\x00-\x7F\p{L}\p{M}]+")


def clean(text: str | None) -> bytes:
    """The text's letters in lower case, with one space for each run of anything else."""
    low = (text or "").lower()
    if not low.isascii():
        low = _FOREIGN.sub(" ", low)
    return b" ".join(low.encode("utf-8", "replace").translate(_CLEAN).split())


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


class Automaton:
    """A suffix automaton as a dense table: ``table[state * width + symbol]`` is the next state times width,
    negated where a new phrase begins with this symbol."""

    def __init__(self, text: bytes) -> None:
        symbols = sorted(set(text))
        self.width = len(symbols) + 2  # 0: padding, last: a byte that the training text lacks
        code = np.full(256, self.width - 1, dtype=np.uint8)
        for i, b in enumerate(symbols):
            code[b] = i + 1
        self.code = code.tobytes()
        nexts, links, lengths, last = [{}], [-1], [0], 0
        for c in text.translate(self.code):
            here = len(nexts)
            nexts.append({})
            lengths.append(lengths[last] + 1)
            links.append(0)
            p = last
            while p != -1 and c not in nexts[p]:
                nexts[p][c] = here
                p = links[p]
            if p != -1:
                q = nexts[p][c]
                if lengths[p] + 1 == lengths[q]:
                    links[here] = q
                else:
                    copy = len(nexts)
                    nexts.append(dict(nexts[q]))
                    lengths.append(lengths[p] + 1)
                    links.append(links[q])
                    while p != -1 and nexts[p].get(c) == q:
                        nexts[p][c] = copy
                        p = links[p]
                    links[q] = links[here] = copy
            last = here
        w, states = self.width, len(nexts)
        table = np.zeros((states + 1, w), dtype=np.int32)  # the last state is the root as left after an unknown byte
        state = np.fromiter((s for s, x in enumerate(nexts) for _ in x), dtype=np.int64)
        symbol = np.fromiter((c for x in nexts for c in x), dtype=np.int64)
        table[state, symbol] = np.fromiter((t for x in nexts for t in x.values()), dtype=np.int64) * w
        root = -table[0]  # negative: a phrase begins
        missing = table == 0
        missing[[0, states]] = True
        table[missing] = np.broadcast_to(root, table.shape)[missing]
        table[:, w - 1] = -states * w  # an unknown byte is a phrase of its own
        table[:, 0] = np.arange(states + 1) * w
        self.table = table.ravel()
        self.bits = float(np.log2(len(text) + 2))

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """The number of phrases of each text."""
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        counts = np.maximum(-(-sizes // SEGMENT), 1)
        first = np.concatenate(([0], np.cumsum(counts)))
        padded = b"".join(t.translate(self.code).ljust(n * SEGMENT, b"\0") for t, n in zip(texts, counts.tolist(), strict=True))
        columns = np.ascontiguousarray(np.frombuffer(padded, dtype=np.uint8).reshape(-1, SEGMENT).T)
        if not len(texts):
            return np.zeros(0, dtype=np.int64)
        end, found = self._walk(columns, np.zeros(columns.shape[1], dtype=np.int32))
        begins = np.zeros_like(end)
        inner = np.ones(len(end), dtype=bool)
        inner[first[:-1]] = False  # the first segments of texts begin at the root
        todo = np.flatnonzero(inner)
        while len(todo):
            todo = todo[end[todo - 1] != begins[todo]]
            if not len(todo):
                break
            begins[todo] = end[todo - 1]
            ends, found[todo] = self._walk(np.ascontiguousarray(columns[:, todo]), begins[todo])
            changed = todo[ends != end[todo]]
            end[todo] = ends
            after = changed + 1
            after = after[after < len(end)]
            todo = after[inner[after]]
        return np.add.reduceat(found.astype(np.int64), first[:-1])

    def _walk(self, columns: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state after each column of bytes, and the phrases that begin in it."""
        state, found, at = begins.copy(), np.zeros_like(begins), np.empty_like(begins)
        for c in columns:
            np.add(state, c, out=at)
            np.take(self.table, at, out=state)
            found -= state >> 31
            np.abs(state, out=state)
        return state, found


def learn(docs: DataFrame, labelled: Column, sample_docs: int = 300, sample_bytes: int = 48_000, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> LanguageModel:
    """Learn from whole documents, in the order of their id's hash, until a language has ``sample_bytes``.

    Of each language, about ``2 * sample_docs`` documents among those ``labelled`` are looked at; longer
    ones than ``sample_bytes`` are passed over, unless all of a language are, which then has the beginning of one. Rows with a
    null or empty text or a null language are not used; repeated rows count as often as they are there. Of a longer text no more
    than twice ``sample_bytes`` characters are fetched, which is enough to see that it is longer, and for its beginning.
    """
    rows = docs.where(labelled & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return LanguageModel(())
    key = F.xxhash64(F.col(id_col))
    # the lower end of the hash range, as wide as to hold that many documents of the language
    limits = [F.when(F.col(lang_col) == lang, F.lit(min(2**63 - 1, int(-(2**63) + min(1.0, (2.0 * sample_docs + 20.0) / n) * (2**64 - 1))))) for lang, n in sizes.items()]
    few = rows.where(key <= F.coalesce(*limits)).select(F.col(lang_col).alias("lang"), key.alias("h"), F.left(F.col(text_col), F.lit(2 * sample_bytes)).alias("text"))
    parts: dict[str, list[bytes]] = {}
    excerpts: dict[str, bytes] = {}
    for r in sorted((tuple(r) for r in few.toLocalIterator()), key=lambda r: r[:2]):
        own, text = parts.setdefault(r[0], []), clean(r[2])
        if text and len(text) <= sample_bytes and sum(map(len, own)) < sample_bytes:
            own.append(text)
        elif len(text) > sample_bytes and not own and r[0] not in excerpts:
            excerpts[r[0]] = text[:sample_bytes].rpartition(b" ")[0] or text[:sample_bytes]
    for lang, text in excerpts.items():
        parts[lang] = parts[lang] or [text]
    return LanguageModel(tuple((lang, b" ".join(own), sizes[lang]) for lang, own in sorted(parts.items()) if own))


def _automata(model: LanguageModel) -> list[Automaton]:
    """Built once in each Python worker."""
    return held("languages", model.samples, lambda: [Automaton(text) for _, text, _ in model.samples])


def identify(texts: list[str | None], model: LanguageModel) -> tuple[list[str], list[float]]:
    """The language and a score from 0 to 1 for each text.

    The score is 2**-a / (2**-a + 2**-b) over 8 times the bits a byte of the best (a) and the next language
    (b): 0.5 for a tie, near 1 where the next is far behind. ``und`` and 0 are given to null texts, texts
    without letters, and where nothing was learned. Ties go to the language with more labelled documents, then to the smaller code.
    """
    langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    use = [i for i, t in enumerate(texts) if has_letter(t)]
    if not use or not model.samples:
        return langs, scores
    cleaned = [clean(texts[i]) for i in use]
    lengths = np.maximum(1, np.fromiter(map(len, cleaned), dtype=np.float64, count=len(cleaned)))
    bits = np.stack([a.phrases(cleaned) * a.bits / lengths for a in _automata(model)])
    order = sorted(range(len(model.samples)), key=lambda k: (-model.samples[k][2], model.samples[k][0]))
    bits = bits[order]
    best = bits.argmin(axis=0)
    lowest = bits.min(axis=0)
    bits[best, np.arange(len(use))] = np.inf
    second = bits.min(axis=0) if len(order) > 1 else np.full(len(use), lowest + 1)
    score = 1.0 / (1.0 + np.exp2(-8.0 * np.minimum(second - lowest, 64.0)))
    for k, i in enumerate(use):
        langs[i], scores[i] = model.samples[order[int(best[k])]][0], float(score[k])
    return langs, scores


def predict(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``; only the text of a row decides them.

    Equal texts get equal values; very long texts are read whole; an empty table stays empty. Columns of these
    two names in ``docs`` are replaced, all others are kept.
    """
    kept = docs.drop("lang_pred", "score")
    schema = StructType([*kept.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    broadcast = docs.sparkSession.sparkContext.broadcast(model)  # languages * sample_bytes at most
    at = kept.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):  # a worker holds the tables of few texts at once
                lang, score = identify(part.column(at).to_pylist(), broadcast.value)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return kept.mapInArrow(run, schema)
