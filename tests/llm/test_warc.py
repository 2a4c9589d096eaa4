import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm.warc import Layout, chunked, dechunked, member, members, page_records, parse, read_archives, write_archives

PAGES = "page_id long, url string, html string, digest string, number string"


@given(st.binary(max_size=300), st.integers(1, 70))
@settings(max_examples=80, deadline=None)
def test_chunked_round_trip(body, size):
    assert dechunked(chunked(body, size)) == body


def test_dechunked_edges():
    assert dechunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for cut in (b"", b"5\r\nabc", b"3\r\nabc\r\n", b"3\r\nabc\r\n0\r\n", b"3\r\nabc\r\n0\r\nTrailer: x\r\n", b"-3\r\nabc\r\n0\r\n\r\n", b"\r\n\r\n"):
        with pytest.raises(ValueError):
            dechunked(cut)


def test_members_and_records():
    parts = [random.Random(k).randbytes(k * 5000) for k in range(30)]
    assert list(members(b"".join(map(member, parts)), window=1000)) == parts
    with pytest.raises(ValueError):
        list(members(member(b"x" * 1000)[:-9]))
    records = page_records(7, "http://a b/<x>", b"p" * 5000, "d", None, Layout(segment=1000))
    heads = [parse(r)[0] for r in records]
    assert [h["warc-type"] for h in heads] == ["response"] + ["continuation"] * (len(records) - 1)
    assert [int(h["warc-segment-number"]) for h in heads] == list(range(1, len(records) + 1))
    assert int(heads[-1]["warc-segment-total-length"]) == sum(len(parse(r)[1]) for r in records)
    assert heads[0]["warc-target-uri"] == "http://a%20b/%3Cx%3E"


def expected(rows):
    payloads = [(i, (h or "").encode()) for i, _, h, *_ in rows]
    first = {}
    for i, p in sorted((x for x in payloads if x[0] is not None), key=lambda x: x[0]):
        if len(p) >= 100:
            first.setdefault(p, i)
    out = []
    for i, p in payloads:
        refers = first.get(p) if i is not None and first.get(p) != i else None
        out.append((i, len(p), hashlib.sha256(p).hexdigest(), "response" if refers is None else "revisit", refers, True))
    return sorted(out, key=str)


def test_round_trip(spark):
    from riskloom.llm.common import ship

    ship(spark)
    rng = random.Random(1)
    big = "".join(rng.choices("abcdefé<>&\r\n", k=120_000))
    rows = [(i, f"http://h/{i}", "x" * rng.randrange(0, 300) + str(rng.randrange(3)), "clash", "clash") for i in range(80)]
    rows += [(100, None, None, None, None), (101, "u", "", "c", "c"), (102, "u", big, "c", "c"), (99, "u", big, "c", "c"), (103, "u", "y" * 99, "c", "c"), (104, "u", "y" * 99, "c", "c"), (105, "u", "y" * 100, "c", "c"), (106, "u", "y" * 100, "c", "c"), (107, "u", big, "c", "c")]
    rows += [rows[0], rows[0], (102, "u", big, "c", "c"), (None, "u", "z" * 200, "c", "c")]
    pages = spark.createDataFrame(rows, PAGES)
    for layout in (Layout(), Layout(segment=500, chunk=77, batch=20_000)):
        got = read_archives(write_archives(pages, layout)).collect()
        assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.complete) for r in got], key=str) == expected(rows)
    assert max(r.segments for r in got) > 100


def test_lost_segments_are_noticed(spark):
    pages = spark.createDataFrame([(1, "u", "q" * 5000, "", "")], PAGES)
    archives = write_archives(pages, Layout(segment=1000)).collect()
    kept = [tuple(a) for a in archives if a.archive.endswith("a.warc.gz")]
    rest = [tuple(a) for a in archives if a.archive.endswith("b.warc.gz")]
    parts = list(members(rest[0][2]))
    damaged = [*kept, (*rest[0][:2], bytearray(b"".join(map(member, parts[:2] + parts[3:]))))]
    got = read_archives(spark.createDataFrame(damaged, "batch string, archive string, data binary")).collect()
    assert [(r.page_id, r.complete) for r in got] == [(1, False)]
    assert read_archives(write_archives(pages.limit(0))).count() == 0


def test_orphans_and_damage_are_rows(spark):
    from riskloom.llm.warc import salvaged

    pages = spark.createDataFrame([(1, "u", "q" * 5000, "", ""), (2, "u", "short", "", "")], PAGES).coalesce(1)
    archives = {a.archive[-9]: tuple(a) for a in write_archives(pages, Layout(segment=1000)).collect()}
    read = lambda *rows: sorted(((r.page_id, r.record_type, r.complete, r.segments) for r in read_archives(spark.createDataFrame(list(rows), "batch string, archive string, data binary")).collect()), key=str)
    assert read(archives["b"]) == [(1, "continuation", False, 5)]
    parts = list(members(archives["a"][2]))
    assert len(parts) == 3  # warcinfo and two responses
    parts[1:] = sorted(parts[1:], key=lambda p: b"page:1>" not in p)
    for bad in (b"nonsense", parts[1].replace(b"Content-Length: ", b"Content-Length: x"), parts[1].replace(b"WARC-Type: response\r\n", b"")):
        data = bytearray(b"".join(map(member, [parts[0], bad, parts[2]])))
        assert read((*archives["a"][:2], data), archives["b"]) == sorted([(1, "continuation", False, 5), (2, "response", True, 1), (None, "damaged", False, 0)], key=str)
    packed = [member(p) for p in parts]
    flipped = bytearray(packed[1])
    flipped[20] ^= 0xFF
    assert [p is None for p in salvaged(packed[0] + bytes(flipped) + packed[2])][-1] is False
    assert (2, "response", True, 1) in read((*archives["a"][:2], bytearray(packed[0] + bytes(flipped) + packed[2])))
    assert read((*archives["a"][:2], None)) == []
