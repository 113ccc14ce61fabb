import hashlib
import zlib

import pytest
from edge import empty, frame

from sharemill.llm import media


def test_payloads_round_trip(spark, sf):
    docs = frame(spark, sf)
    got = {(r.doc_id, r.payload_sha256): r for r in media.document_media(docs).collect()}
    rows = docs.collect()
    assert media.document_media(docs).count() == len(rows)
    for r in rows:
        raw = (r.text or "").encode()
        payload = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        own = got[r.doc_id, hashlib.sha256(payload).hexdigest()]
        stored = media.png(payload)
        assert (own.n_bytes, own.payload_bytes, own.tail_crc32) == (len(raw), len(payload), zlib.crc32(payload[-64:]))
        assert (own.media_bytes, own.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest()) and own.feature
        lines = [" ".join(x.split()) for x in (r.text or "").split("\n")]
        assert own.pos == 1 + bool(lines[0]) and own.n_items == 2 + sum(map(bool, lines)) and own.caption == f"{len(raw)} bytes"
    assert media.document_media(empty(spark)).count() == 0


def test_pages_hold_the_text_around_its_image(spark, sf):
    from pyspark.sql import functions as F

    docs = frame(spark, sf)
    pages = docs.select("doc_id", "text", media.page_of(F.col("doc_id"), F.col("text")).alias("html")).collect()
    for r in pages:
        got = media.items(r.html)
        lines = [x for x in (" ".join(x.split()) for x in (r.text or "").split("\n")) if x]
        assert [i["text"] for i in got if i["kind"] == "text"] == [str("-" if r.doc_id is None else r.doc_id), *lines]


def test_items_keep_order_and_captions():
    html = "<h1>A &amp; b</h1><p>one<img src='media:AA' alt='x'>two<figure><img src='media:bb'><img src='u.png'><figcaption>cap  <b>t</b></figcaption></figure><script>no</script><p>three"
    got = [(i["pos"], i["kind"], i["text"], i["digest"], i["caption"]) for i in media.items(html)]
    assert got == [
        (0, "text", "A & b", None, None), (1, "text", "one", None, None), (2, "media", "media:AA", "aa", "x"), (3, "text", "two", None, None),
        (4, "media", "media:bb", "bb", "cap t"), (5, "media", "u.png", None, "cap t"), (6, "text", "three", None, None),
    ]
    assert media.items(None) == media.items("") == []


def test_pages_and_damage(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = media.sequences(pages).collect()
    assert len(got) == pages.count()
    assert all([i["pos"] for i in r["items"]] == list(range(len(r["items"]))) for r in got)
    bad = bytearray(media.png(b"x" * 64))
    bad[50] ^= 1
    with pytest.raises(ValueError):
        media.samples(bytes(bad))
