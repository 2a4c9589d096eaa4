"""Exact n-gram Jaccard self-join of documents, returned as connected classes.

A document's set holds its distinct shingles of five words. Two sets link when their intersection is at least
``threshold`` percent of their union. The join is a T-occurrence search by DivideSkip: sets of n shingles
must share T of them, so of a document's inverted lists the L = T - 1 longest are set apart, the short rest is merged, and every
partner turns up in at least T - L = 1 of the short lists. A candidate's count in the short lists is then made whole by binary
search in its long ones, unless it can't reach T any more. The steps:

1. Shingles are hashed in bulk and counted over the whole corpus in hash buckets (packed arrays, so that the
   shuffle moves six bytes a shingle). This gives every list its length.
2. Each document keeps its T - L shortest lists in one global order (length class, then hash). Lists of length
   one are dropped: they have no partner.
3. The short lists are merged by the shuffle (the cluster's heap merge) into pairs. In every list all documents
   meet a few hubs, which is a few pairs a posting; pairs that length or position rule out are dropped.
4. For each pair the shared short lists are counted (T-occurrence). If the long lists can still make up the overlap that the two
   sizes require, the partner is searched in them, which gives the exact overlap.
5. Links are contracted to classes, and steps 3 and 4 go on with other hubs for the lists that still hold several
   classes. When few of the pairs with hubs still link, all pairs of different classes that share a list are
   compared, so no link between classes is lost.

Equal sets are merged before step 2. Overlaps are counted on hashes of 46 bits at every size of the table. Nothing but counts
reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import attach, release, stash

WIDTH = 5
#: Bits of a shingle's hash that lists are told apart by.
KEY_BITS = 46
_CHUNK_DOCS, _CHUNK_BYTES = 2048, 4 << 20
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shifts and odd multiplications."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << 21  # what is kept; longer texts get their own
    if n > size:
        return tuple(np.cumprod(np.full(n, p, dtype=np.uint64)) for p in (_PRIME, _INVERSE))
    if not _POWERS:
        _POWERS[:] = [np.cumprod(np.full(size, p, dtype=np.uint64)) for p in (_PRIME, _INVERSE)]
    return _POWERS[0][:n], _POWERS[1][:n]


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Of each text the sorted distinct 64-bit hashes of its shingles.

    A-Z are lower-cased; words are runs without ASCII white space. A text with fewer words than ``width`` has
    one shingle, all its words; a null text or one without words has none.
    """
    data = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    joined = np.frombuffer(b"\n".join([*data, b""]) or b"\n", dtype=np.uint8)
    space = _SPACE[joined]
    before = np.concatenate(([True], space[:-1]))
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    power, inverse = _powers(len(joined) + width + 8)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * power[: len(joined)])))
    words = _mix((sums[ends] - sums[starts]) * inverse[starts])
    offsets = np.concatenate(([0], np.cumsum([len(d) + 1 for d in data]))) if data else np.zeros(1, dtype=np.int64)
    first = np.searchsorted(starts, offsets)
    grams = np.zeros(max(0, len(words) - width + 1), dtype=np.uint64)
    for k in range(width):
        grams += words[k : k + len(grams)] * power[k + 8]
    grams = _mix(grams)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            own = np.sort(grams[a : b - width + 1])
            if len(own) > 1:
                own = own[np.concatenate(([True], own[1:] != own[:-1]))]
        elif b > a:
            own = _mix((words[a:b] * power[8 : 8 + b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            own = words[:0]
        out.append(own)
    return out


def _counted(width: int):
    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(s) for s in shingle_sets(batch.column(1).to_pylist(), width)]
            none = pa.nulls(len(sizes), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(sizes, pa.int64()), none], names=["doc_id", "n_shingles", "component_id"])

    return counted


def linked(overlap: int, a: int, b: int, threshold: int = 75) -> bool:
    """Whether sets of a and b members that share ``overlap`` link."""
    return a > 0 and b > 0 and 100 * overlap >= threshold * (a + b - overlap)


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t or "")
            if len(ids) >= _CHUNK_DOCS or size >= _CHUNK_BYTES:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _parts(texts: list, size: int = 1 << 20) -> Iterator[list]:
    """Runs of texts of about ``size`` characters; hashing needs some forty bytes a character while it works."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t or "")
        if held >= size:
            yield part
            part, held = [], 0
    if part:
        yield part


_PACKED = "chunk long, bucket int, docs binary, owners binary, lows binary, highs binary"


def steps(numbers: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers as bytes: each is a step from the one before (from 0 at each of ``starts``), 255 standing for a step
    that goes on. Returns the bytes and, of each number, the place behind its last byte."""
    step = np.diff(numbers, prepend=0)
    step[starts] = numbers[starts]
    ends = np.cumsum(step // 255 + 1)
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, dtype=np.uint8)
    out[ends - 1] = step % 255
    return out, ends


def walked(data: bytes, sizes: np.ndarray) -> np.ndarray:
    """The numbers that ``steps`` has packed, of consecutive runs with so many numbers each."""
    raw = np.frombuffer(data, dtype=np.uint8)
    total = np.cumsum(raw, dtype=np.int64)[raw != 255]
    lasts = np.cumsum(sizes)
    before = np.concatenate(([0], total))[(lasts - sizes)]
    return total - np.repeat(before, sizes)


def _pack(bits: int, width: int):
    """Sets by hash bucket: of each chunk of documents one row a bucket, with the further bits of each hash."""
    rest = KEY_BITS - bits

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for k, (ids, texts) in enumerate(_chunks(batches)):
            sets = [x for part in _parts(texts) for x in shingle_sets(part, width)]
            sizes = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
            every = np.concatenate(sets)
            bucket = (every >> np.uint64(64 - bits)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket = bucket[order]
            starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, dtype=np.int64)
            ends = np.concatenate((starts[1:], [len(bucket)])) if len(bucket) else starts
            low = (every[order] >> np.uint64(64 - KEY_BITS)) & np.uint64((1 << rest) - 1)
            highs = (low >> np.uint64(32)).astype(np.uint8)
            lows = low.astype(np.uint32)
            owners, places = steps(np.repeat(np.arange(len(sets), dtype=np.int64), sizes)[order], starts)
            digests = b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets)
            docs = np.array(ids, dtype=np.int64).tobytes() + sizes.tobytes() + digests
            chunk = (TaskContext.get().partitionId() << 32) + k
            # the documents travel with bucket 0, which is there for every chunk
            rows = [(-1, 0, 0)] if not len(bucket) or bucket[0] else []
            rows += list(zip(bucket[starts].tolist(), starts.tolist(), ends.tolist(), strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk] * len(rows), pa.int64()),
                    pa.array([max(b, 0) for b, _, _ in rows], pa.int32()),
                    pa.array([docs if j == 0 else b"" for j in range(len(rows))], pa.binary()),
                    pa.array([owners[places[x - 1] if x else 0 : places[y - 1]].tobytes() if y > x else b"" for _, x, y in rows], pa.binary()),
                    pa.array([lows[x:y].tobytes() for _, x, y in rows], pa.binary()),
                    pa.array([highs[x:y].tobytes() if rest > 32 else b"" for _, x, y in rows], pa.binary()),
                ],
                names=["chunk", "bucket", "docs", "owners", "lows", "highs"],
            )
        release()

    return pack


def _low(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all rows without their bucket, and their number in each row."""
    lows = np.frombuffer(b"".join(rows["lows"]), dtype=np.uint32).astype(np.uint64)
    highs = np.frombuffer(b"".join(rows["highs"]), dtype=np.uint8)
    if len(highs):
        lows |= highs.astype(np.uint64) << np.uint64(32)
    return lows, np.fromiter((len(x) // 4 for x in rows["lows"]), dtype=np.int64, count=len(rows))


def _lengths(rows: pd.DataFrame) -> pd.DataFrame:
    """Within one bucket: the length class of each hash's list, floor(log2(length))."""
    every, sizes = _low(rows)
    order = np.argsort(every)
    ranked = every[order]
    starts = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(every) else np.zeros(0, dtype=np.int64)
    counts = np.diff(np.concatenate((starts, [len(every)])))
    classes = np.empty(len(every), dtype=np.uint8)
    classes[order] = np.repeat(np.floor(np.log2(np.maximum(counts, 1))).astype(np.uint8), counts)
    rows["classes"] = [c.tobytes() for c in np.split(classes, np.cumsum(sizes)[:-1])]
    return rows


_DOCS = "doc_id long, n_shingles long, digest binary, size int, keys array<long>, places array<int>, members binary, shorts binary"


def _shortest(threshold: int, bits: int):
    """Of each document of a chunk the short lists that have partners, and, where it has any, its whole set with a mark on the
    members whose lists are short."""

    def shortest(rows: pd.DataFrame) -> pd.DataFrame:
        head = next(d for d in rows["docs"] if d)
        n = len(head) // 32
        ids, exact = np.frombuffer(head, dtype=np.int64, count=n), np.frombuffer(head, dtype=np.int64, count=n, offset=8 * n)
        digests = [head[16 * n + 16 * i : 16 * n + 16 * i + 16] for i in range(n)]
        low, sizes = _low(rows)
        owner = walked(b"".join(rows["owners"]), sizes).astype(np.uint64)
        key = np.repeat(rows["bucket"].to_numpy().astype(np.uint64), sizes) << np.uint64(KEY_BITS - bits) | low
        classes = np.frombuffer(b"".join(rows["classes"]), dtype=np.uint8).astype(np.uint64)
        ranked = np.sort(owner << np.uint64(52) | classes << np.uint64(KEY_BITS) | key)  # document (12 bits), class (6), hash (46)
        owner = (ranked >> np.uint64(52)).astype(np.int64)
        first = np.searchsorted(owner, np.arange(n + 1))
        size = np.diff(first)
        keep = size - (threshold * size + 99) // 100 + 1
        place = np.arange(len(ranked)) - first[owner]
        key = (ranked & np.uint64((1 << KEY_BITS) - 1)).astype(np.int64)
        short = place < keep[owner]
        shared = short & (((ranked >> np.uint64(KEY_BITS)) & np.uint64(63)) > 0)
        begin = np.concatenate(([0], np.cumsum(shared)))
        keys, places = key[shared], place[shared]
        out = []
        for i in range(n):
            a, b = begin[first[i]], begin[first[i + 1]]
            row = [ids[i], exact[i], digests[i] if size[i] else None, size[i], None, None, None, None]
            if b > a:
                own = slice(first[i], first[i + 1])
                order = np.argsort(key[own])
                row[4:] = keys[a:b], places[a:b], key[own][order].tobytes(), np.packbits(short[own][order]).tobytes()
            out.append(tuple(row))
        return pd.DataFrame(out, columns=["doc_id", "n_shingles", "digest", "size", "keys", "places", "members", "shorts"])

    return shortest


def probe(a: np.ndarray, b: np.ndarray) -> int:
    """The overlap of two sorted sets: the members of the smaller one are searched in the larger."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def occurrences(a: np.ndarray, short: np.ndarray, b: np.ndarray, need: int) -> int:
    """In how many lists of ``a`` the partner ``b`` is: the ``short`` ones are counted, and the long ones are probed if they can
    still make up ``need``; otherwise the count of the short ones is returned, which is then below it."""
    found, rest = probe(a[short], b), a[~short]
    return found + probe(rest, b) if found + len(rest) >= need else found


def _verify(threshold: int):
    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, marks, y in zip(batch.column(2), batch.column(3), batch.column(4), strict=True):
                p, q = np.frombuffer(x.as_buffer(), dtype=np.int64), np.frombuffer(y.as_buffer(), dtype=np.int64)
                short = np.unpackbits(np.frombuffer(marks.as_buffer(), dtype=np.uint8), count=len(p)).astype(bool)
                need = -(-threshold * (len(p) + len(q)) // (100 + threshold))
                keep.append(linked(occurrences(p, short, q, need), len(p), len(q), threshold))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return verify


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list: (node, root), root being the smallest node reachable.

    Large-star and small-star steps alternate until the edges form stars (the number and sum of edges
    stay as they are). A node's neighbours are never gathered in one task.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = attach(both, "a", "b", {"__m": (F.least("a", "b"), "min")})
        if large:
            out = least.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("__m").alias("b"))
        else:
            out = least.select(F.explode(F.array(F.col("a"), F.col("b"))).alias("a"), F.col("__m").alias("b"))
        return out.where(F.col("a") != F.col("b")).distinct()

    links = stash(edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "links")
    was = None
    while True:
        links = stash(star(star(links, large=True), large=False), "links")
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == was:
            break
        was = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _mixed(postings: DataFrame) -> DataFrame:
    """The lists whose documents are of several classes."""
    several = postings.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi").select("key")
    return stash(postings.join(several, "key", "left_semi"), "mixed")


def _hub_pairs(postings: DataFrame, threshold: int, ranks: range) -> DataFrame:
    """Candidate pairs (a < b) of different classes: every document of a list with its hubs, one for each rank.

    Hubs of even rank come from the documents with the fewest rarer shingles, which are the likely originals of
    near copies; all others are drawn from the whole list.
    """
    hubs = {}
    for k in ranks:
        rare = F.floor(F.col("place") * 32 / F.col("size")) if k % 2 == 0 else F.lit(0).cast("long")
        hubs[f"hub{k}"] = (F.struct(rare.alias("r"), F.xxhash64(F.lit(k), "doc").alias("h"), *_POSTING), "min")
    rows = attach(postings.select("key", *_POSTING), "key", "doc", hubs).select(*[F.col(c).alias(f"l_{c}") for c in _POSTING], F.array_distinct(F.array(*[F.col(h).dropFields("r", "h") for h in hubs])).alias("hubs"))
    fit = F.filter("hubs", lambda h: (h["class"] != F.col("l_class")) & _fits(threshold, h["size"], h["place"]))
    return _named(rows.select("l_doc", F.explode(F.transform(fit, lambda h: h["doc"])).alias("r_doc")))


def _list_pairs(postings: DataFrame, threshold: int) -> DataFrame:
    """All pairs of different classes that share a list."""
    left = postings.select("key", *[F.col(c).alias(f"l_{c}") for c in _POSTING])
    right = postings.select("key", *[F.col(c).alias(f"r_{c}") for c in _POSTING])
    return _named(left.join(right, (left["key"] == right["key"]) & (F.col("l_doc") < F.col("r_doc")) & (F.col("l_class") != F.col("r_class")) & _fits(threshold, F.col("r_size"), F.col("r_place"))))


_POSTING = ("doc", "place", "size", "class")


def _named(both: DataFrame) -> DataFrame:
    return both.select(F.least("l_doc", "r_doc").alias("a"), F.greatest("l_doc", "r_doc").alias("b")).distinct()


def _fits(threshold: int, r_size, r_place):
    """What is left of both sets from the shared place on must hold the overlap that their sizes require."""
    t = threshold / (100.0 + threshold)
    left = F.least(F.col("l_size") - F.col("l_place"), r_size - r_place)
    return left >= F.ceil((F.col("l_size") + r_size) * F.lit(t) - F.lit(1e-9))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = 75, width: int = WIDTH, hubs: int = 8) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles and component_id, the smallest id reachable by links.

    Null and empty texts have no shingles and stay alone. Ids should be integers; rows without one link with
    nothing and get no class; rows that repeat an id are copies of one document and share its class. Texts are
    read whole whatever their length; extra columns are ignored; an empty table gives an empty result.
    """
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows, nameless = given.where("doc_id is not null"), given.where("doc_id is null").mapInArrow(_counted(width), "doc_id long, n_shingles long, component_id long")
    # a bucket holds the shingles of about 2,000 documents, up to a quarter of a billion documents, and more of them beyond
    bits = max(6, min(17, (max(1, docs.count()) // 2000).bit_length()))
    packed = rows.mapInArrow(_pack(bits, width), _PACKED)
    ranked = packed.groupBy("bucket").applyInPandas(_lengths, _PACKED + ", classes binary")
    sets = stash(ranked.groupBy("chunk").applyInPandas(_shortest(threshold, bits), _DOCS), "sets")

    firsts = stash(attach(sets.select("doc_id", "n_shingles", "digest"), "digest", "doc_id", {"first": (F.col("doc_id"), "min")}), "firsts").select("doc_id", "n_shingles", F.coalesce("first", "doc_id").alias("first"))
    lone = firsts.where("doc_id = first").select("doc_id").distinct()
    held = sets.where(F.col("keys").isNotNull()).select("doc_id", "size", "keys", "places").join(lone, "doc_id", "left_semi")
    lists = held.select(F.col("doc_id").alias("doc"), "size", F.explode(F.arrays_zip("keys", "places")).alias("z")).select("doc", "size", F.col("z.keys").alias("key"), F.col("z.places").alias("place")).distinct()
    shared = attach(lists.withColumn("one", F.lit(1)), "key", "doc", {"__n": (F.col("one"), "sum")}).where("__n > 1").drop("__n", "one")
    postings = stash(shared.withColumn("class", F.col("doc")), "postings")
    members = sets.where(F.col("keys").isNotNull()).select(F.col("doc_id").alias("doc"), "members", "shorts")

    links, rank, last = None, 0, False
    while True:
        lists = _mixed(postings) if rank else postings
        count = hubs if rank else 1
        pairs = stash(_list_pairs(lists, threshold) if last else _hub_pairs(lists, threshold, range(rank, rank + count)), "pairs")
        rank += count
        left = members.select(F.col("doc").alias("a"), F.col("members").alias("x"), F.col("shorts").alias("marks"))
        right = members.select(F.col("doc").alias("b"), F.col("members").alias("y"))
        full = pairs.join(left, "a").join(right, "b")
        found = stash(full.select("a", "b", "x", "marks", "y").mapInArrow(_verify(threshold), "a long, b long"), "found")
        links = found if links is None else links.unionByName(found)
        grew = found.count()
        if grew:
            roots = components(links)
            links = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
            if not last:
                joined = postings.drop("class").join(roots, F.col("doc") == F.col("node"), "left")
                postings = stash(joined.withColumn("class", F.coalesce("root", "doc")).drop("node", "root"), "postings")
        if last:
            break
        last = 4 * grew <= pairs.count()  # hubs link few of what they meet: the rest is compared in full
    out = firsts.join(links.select(F.col("a").alias("node"), F.col("b").alias("root")), F.col("first") == F.col("node"), "left")
    return out.select("doc_id", "n_shingles", F.coalesce("root", "first").alias("component_id")).unionByName(nameless)
