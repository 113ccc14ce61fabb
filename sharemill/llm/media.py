"""Interleaved document sequences: HTML gives ordered structs of text and media references, and a
join on digests resolves the references' payloads. Positions and captions stay aligned."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize, with_value
from .text import slices

#: Samples in a row of a stored image, and the unit that payloads are padded to.
WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
SCHEME = "media:"
ITEM = "struct<pos: int, kind: string, text: string, digest: string, caption: string>"
BREAKS = frozenset("p div section article li tr h1 h2 h3 h4 h5 h6 br figure figcaption table ul ol".split())
STORED = "digest string, media binary"
READ = "digest string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class Items(HTMLParser):
    """Collects ordered items. A figure's caption belongs to the figure's references; one without
    takes its alt text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.words: list[str] = []
        self.skip = 0
        self.figure: list[dict] | None = None
        self.caption: list[str] | None = None

    def cut(self) -> None:
        if text := " ".join("".join(self.words).split()):
            self.items.append({"pos": len(self.items), "kind": "text", "text": text, "digest": None, "caption": None})
        self.words = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.skip += 1
        if tag in BREAKS:
            self.cut()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "video", "audio", "source"):
            found = dict(attrs)
            if src := found.get("src"):
                self.cut()
                digest = src.removeprefix(SCHEME).lower() if src.startswith(SCHEME) else None
                item = {"pos": len(self.items), "kind": "media", "text": src, "digest": digest, "caption": found.get("alt") or None}
                self.items.append(item)
                if self.figure is not None:
                    self.figure.append(item)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        if tag == "figcaption" and self.caption is not None:
            for item in self.figure or []:
                item["caption"] = " ".join("".join(self.caption).split()) or item["caption"]
            self.caption = None
        elif tag in BREAKS:
            self.cut()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if self.caption is not None:
            self.caption.append(data)
        elif not self.skip:
            self.words.append(data)


def items(html: str | None) -> list[dict]:
    p = Items()
    p.feed(html or "")
    p.close()
    p.cut()
    return p.items


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """pages -> (id, items array<struct pos, kind, text, digest, caption>). Null or empty HTML: no
    items; broken HTML: what can be read; ids may be null or repeat; extra columns are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("digest", pa.string()), ("caption", pa.string())]))
        for b in slices(batches, "html"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([items(x) for x in b.column(1).to_pylist()], kind)], names=["id", "items"])

    return pages.select(F.col(id_col).cast("long").alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id long, items array<{ITEM}>")


def png(payload: bytes) -> bytes:
    """A grey image of 8-bit samples, WIDTH to a row."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    out = [SIGNATURE]
    for kind, data in ((b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(raw.tobytes(), 1)), (b"IEND", b"")):
        out += [struct.pack(">I", len(data)), kind, data, struct.pack(">I", zlib.crc32(kind + data))]
    return b"".join(out)


def samples(media: bytes) -> np.ndarray:
    """The samples of an image that png() made, row by row. Raises on damage."""
    if media[:8] != SIGNATURE:
        raise ValueError("not an image of this store")
    at, data, shape = 8, b"", (0, 0)
    while at < len(media):
        (n,) = struct.unpack(">I", media[at : at + 4])
        kind, own = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + own) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("damaged image")
        if kind == b"IHDR":
            shape = struct.unpack(">II", own[:8])
        elif kind == b"IDAT":
            data += own
        at += 12 + n
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(shape[1], shape[0] + 1)[:, 1:]


def pad(raw: bytes) -> bytes:
    return raw + b"\0" * ((-len(raw)) % WIDTH or (0 if raw else WIDTH))


def feature(grey: np.ndarray) -> str:
    """Mean, deviation and the share of samples in each quarter of the range, per mille."""
    flat = grey.reshape(-1)
    quarters = np.bincount(flat >> 6, minlength=4) * 1000 // len(flat)
    return f"mean={flat.mean():.4f};std={flat.std():.4f};quarters={','.join(map(str, quarters))};rows={len(grey)}"


def store(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, media): each text's padded UTF-8 bytes as an image, once for equal texts of a batch.
    Written to the shared folder, as the readers come later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            seen: dict[str, bytes] = {}
            for t in b.column(0).to_pylist():
                payload = pad((t or "").encode("utf-8", "surrogatepass"))
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in seen:
                    seen[digest] = png(payload)
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.binary())], names=["digest", "media"])

    return materialize(docs.select(F.col(text_col).alias("text")).mapInArrow(run, STORED), "media")


def read_back(media: DataFrame) -> DataFrame:
    """Decodes stored images: (digest, payload_bytes, payload_sha256, tail_crc32, media_bytes,
    media_sha256, feature), one row for a digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in READ.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for b in batches:
            out = []
            for digest, stored in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                grey = samples(stored)
                payload = grey.tobytes()
                out.append((digest, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(grey)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=names)

    found = media.mapInArrow(run, READ)
    rest = [x.split(" ")[0] for x in READ.split(", ")][1:]
    return found.groupBy("digest").agg(*(F.first(c).alias(c) for c in rest))


def payload(text: Column) -> Column:
    """The padded bytes of a text column."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    n = F.length(raw)
    more = F.when(n == 0, WIDTH).otherwise(F.pmod(-n, F.lit(WIDTH)))
    return F.concat(raw, F.substring(F.unhex(F.lit("00" * WIDTH)), F.lit(1), more))


def resolve(seqs: DataFrame, media: DataFrame) -> DataFrame:
    """(id, pos, caption, digest, n_items) of every media reference with the columns of `media`;
    references that nothing resolves keep nulls. A digest that many references share is one row of
    `media`; rows of a hot digest are dealt over tasks."""
    refs = seqs.select("id", F.size("items").alias("n_items"), F.explode("items").alias("i")).where("i.kind = 'media'").select("id", "i.pos", "i.caption", "i.digest", "n_items")
    refs = materialize(refs.withColumn("__key", F.coalesce("digest", F.lit(""))), "references")
    table = refs.groupBy("__key").agg(F.count("*").alias("n")).join(media.withColumnRenamed("digest", "__key"), "__key", "left")
    return with_value(refs, materialize(table, "resolved"), "__key", F.struct("id", "pos")).drop("__key")


def escaped(text: Column) -> Column:
    """Text as HTML's character data."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def page_of(doc_id: Column, text: Column) -> Column:
    """A page of a document: its id, its first line, a figure of the text's stored image, its other lines."""
    t = F.coalesce(text, F.lit(""))
    lines = lambda x: F.concat(F.lit("<p>"), F.replace(escaped(x), F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    first = F.substring_index(t, "\n", 1)
    figure = F.concat(F.lit("<figure><img src='media:"), F.sha2(payload(text), 256), F.lit("'><figcaption>"), F.octet_length(t).cast("string"), F.lit(" bytes</figcaption></figure>"))
    return F.concat(F.lit("<article><h1>"), F.coalesce(doc_id.cast("string"), F.lit("-")), F.lit("</h1>"), lines(first), figure, lines(F.substr(t, F.length(first) + 2)), F.lit("</article>"))


def document_media(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, pos, caption, n_items. Every text is stored as an image, and
    shown by a page of its own that has the image between the text's lines: pos is the image's place
    among the page's n_items. Null texts are empty: 64 zero bytes. Equal texts share one stored image;
    ids may be null or repeat; an empty table gives no rows; extra columns are ignored."""
    stored = store(docs)
    pages = docs.select(F.col("doc_id").cast("long").alias("page_id"), page_of(F.col("doc_id").cast("long"), F.col("text")).alias("html"))
    found = resolve(sequences(pages), read_back(stored))
    bytes_ = F.regexp_extract("caption", r"(\d+) bytes", 1).cast("long")
    return found.select(F.col("id").alias("doc_id"), bytes_.alias("n_bytes"), "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "pos", "caption", "n_items")
