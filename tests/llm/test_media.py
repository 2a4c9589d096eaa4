import hashlib
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskloom.llm.media import decode, encode, media_of_texts, pad, resolve, sequence, sequences


@given(st.binary(max_size=1000))
@settings(max_examples=80, deadline=None)
def test_media_round_trip(data):
    payload = pad(data)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.rstrip(b"\0") == data.rstrip(b"\0") and decode(encode(payload)) == payload


def test_damage_is_noticed():
    image = bytearray(encode(pad(b"abc" * 100)))
    image[60] ^= 1
    with pytest.raises(ValueError):
        decode(bytes(image))
    with pytest.raises(ValueError):
        decode(b"no image")


def test_sequence_keeps_order_and_captions():
    page = '<p>Before <b>all</b></p><figure><img src="sha256:aa" data-bytes="5"><figcaption>First &amp; best</figcaption></figure>middle<img src="sha256:bb" alt="inline"><img src="http://x/y.png"><script>no</script>end'
    parts = [p for p in sequence(page) if p["url"] != "http://x/y.png"]
    assert [(p["position"], p["kind"], p["text"], p["digest"], p["n_bytes"]) for p in parts] == [
        (0, "text", "Before all", None, None), (1, "media", "First & best", "aa", 5), (2, "text", "middle", None, None), (3, "media", "inline", "bb", None), (5, "text", "end", None, None),
    ]
    assert sequence(page)[4] | {"kind": "media", "url": "http://x/y.png", "digest": None, "text": None} == sequence(page)[4]
    assert sequence(None) == sequence("") == []


def test_sequence_edges():
    texts = lambda page: [p["text"] for p in sequence(page)]
    assert texts("<table><tr><td>one<td>two</table><h4>Head</h4><blockquote>q</blockquote><pre>code</pre>") == ["one", "two", "Head", "q", "code"]
    nested = '<figure><img src="a.png"><figure><img src="b.png"><figcaption>inner <b>one</b></figcaption></figure><img src="c.png"><figcaption>outer</figcaption></figure>'
    assert [(p["url"], p["text"]) for p in sequence(nested)] == [("a.png", "outer"), ("b.png", "inner one"), ("c.png", "outer")]
    odd = sequence('<img src="x" data-bytes="²"><img src="" alt="none"><img alt="none"><img src="y" data-bytes="12"><img src=z data-bytes=99999999999999999999><img srcset="s.png 2x, t.png">')
    assert [(p["url"], p["n_bytes"]) for p in odd] == [("x", None), ("y", 12), ("z", None), ("s.png", None)]
    assert texts("<figure><figcaption>open") == [] and texts('<figure><img src=a alt=b><figcaption>open') == ["open"]
    assert texts("</figure></figcaption></div>x") == ["x"] and len(sequence("<div>" * 20_000 + "deep")) == 1


def test_addresses_find_their_digests(spark):
    from riskloom.llm.common import ship

    ship(spark)
    pages = spark.createDataFrame([(1, '<img src="http://h/a.png"><img src="sha256:bb"><img src="http://h/none.png">')], "page_id long, html string")
    media = spark.createDataFrame([("aa", b"A"), ("bb", b"B")], "digest string, payload binary")
    addresses = spark.createDataFrame([("http://h/a.png", "aa"), ("sha256:bb", "zz")], "url string, digest string")
    got = {r.position: (r.digest, r.payload and bytes(r.payload)) for r in resolve(sequences(pages, "page_id"), media, "page_id", addresses).collect()}
    assert got == {0: ("aa", b"A"), 1: ("bb", b"B"), 2: (None, None)}


def test_resolve_aligns_references(spark):
    from riskloom.llm.common import ship

    ship(spark)
    pages = spark.createDataFrame([(1, '<img src="sha256:aa" alt="one">text<img src="sha256:bb" alt="two"><img src="sha256:aa" alt="again">'), (2, None), (3, '<img src="sha256:zz">')], "page_id long, html string")
    media = spark.createDataFrame([("aa", b"A"), ("bb", b"B")], "digest string, payload binary")
    got = {(r.page_id, r.position): (r.caption, r.digest, r.payload and bytes(r.payload)) for r in resolve(sequences(pages, "page_id"), media, "page_id").collect()}
    assert got == {(1, 0): ("one", "aa", b"A"), (1, 2): ("two", "bb", b"B"), (1, 3): ("again", "aa", b"A"), (3, 0): (None, "zz", None)}


def test_texts_on_mixed_rows(make_docs, mixed_rows):
    got = media_of_texts(make_docs(mixed_rows)).collect()
    assert len(got) == len(mixed_rows)
    expected = {}
    for i, t, *_ in mixed_rows:
        data = (t or "").encode()
        p = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        # the stored form and the features, put together here from the format's definition
        lines = b"".join(b"\0" + p[k : k + 64] for k in range(0, len(p), 64))
        chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
        image = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, len(p) // 64, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines, 1)) + chunk(b"IEND", b"")
        bins = [sum(32 * k <= x < 32 * k + 32 for x in p) for k in range(8)]
        text = f"rows={len(p) // 64};sum={sum(p)};min={min(p)};max={max(p)};distinct={len(set(p))};hist={','.join(map(str, bins))}"
        expected[i] = (len(data), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), hashlib.sha256(image).hexdigest(), len(image), text)
    assert {r.doc_id: (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_sha256, r.media_bytes, r.feature) for r in got} == expected
    assert media_of_texts(make_docs([])).count() == 0
