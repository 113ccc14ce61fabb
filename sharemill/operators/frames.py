"""Binary messages: headers and vectors as bytes, frames in a stream of chunks, and the way back.

A frame is the header's length and the payload's length, four bytes each, most significant first, the
header as JSON in UTF-8, and the payload. A stream is rows (stream, seq, chunk binary); frames don't
keep to the chunks' borders."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a header and a payload together, at most; bytes of a chunk.
MOST, CHUNK = 64 << 20, 1024
WIDE = 4294967295


def _hex(v: Column, digits: int) -> Column:
    return F.lpad(F.hex(v), digits, "0")


def width(values: Column) -> Column:
    """4 bytes a value where all fit, else 8; an empty vector takes 4."""
    return F.when(F.coalesce(F.array_max(values), F.lit(0)) > WIDE, 8).otherwise(4)


def vector_bytes(values: Column, bytes_each: Column) -> Column:
    """Values from 0 to 2^63 - 1 as unsigned integers, least significant byte first."""

    def little(v: Column) -> Column:
        h = _hex(v, 16)
        return F.concat(*(F.substring(h, 2 * k + 1, 2) for k in range(7, -1, -1)))

    return F.unhex(F.array_join(F.transform(values, lambda v: F.substring(little(v), F.lit(1), 2 * bytes_each)), ""))


def vector_of(payload: Column, bytes_each: Column) -> Column:
    """The vector of a payload; null where its length doesn't fit."""
    h = F.hex(payload)
    n = F.call_function("div", F.length(payload), bytes_each).cast("int")

    def value(k: Column) -> Column:
        parts = [F.when(F.lit(b) < bytes_each, F.substring(h, 2 * (k * bytes_each + b) + 1, F.lit(2))).otherwise("") for b in range(7, -1, -1)]
        return F.conv(F.concat(*parts), 16, 10).cast("long")

    found = F.transform(F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>")), value)
    return F.when(n * bytes_each == F.length(payload), found)


def frame(header: Column, payload: Column) -> Column:
    head = header.cast("binary")
    size = lambda b: F.unhex(_hex(F.length(b).cast("long"), 8))
    return F.concat(size(head), size(payload), head, payload)


def _by_stream(df: DataFrame) -> DataFrame:
    return df.repartition("stream").sortWithinPartitions("stream", "seq")


def chunked(frames: DataFrame, size: int = CHUNK) -> DataFrame:
    """frames(stream, seq, frame) -> (stream, seq, chunk): a stream's frames one after the other, cut into
    chunks of size bytes (the last is shorter). A stream's bytes have an order, so they pass
    through one task, of which it holds a chunk at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, seq = None, bytearray(), 0
        for b in batches:
            out = []
            for stream, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if stream != last:
                    if held:
                        out.append((last, seq, bytes(held)))
                    last, held, seq = stream, bytearray(), 0
                held += raw or b""
                whole = len(held) // size
                out.extend((stream, seq + k, bytes(held[k * size : (k + 1) * size])) for k in range(whole))
                seq += whole
                del held[: whole * size]
            yield _chunks(out)
        if held:
            yield _chunks([(last, seq, bytes(held))])

    return _by_stream(frames).select("stream", "frame").mapInArrow(run, "stream long, seq long, chunk binary")


def _chunks(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["stream", "seq", "chunk"])


SPLIT = "stream long, place long, header string, payload binary, error string"


def split(chunks: DataFrame, most: int = MOST) -> DataFrame:
    """chunks -> (stream, place, header, payload, error): the frames of each stream in order. A frame that
    says it is longer than most, whose header isn't UTF-8, or that the stream ends within is a row with
    an error, and nothing after it can be read. A task holds one frame's bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, place, broken = None, bytearray(), 0, False

        def cut(out: list[tuple]) -> None:
            nonlocal place, broken
            at = 0
            while not broken and len(held) - at >= 8:
                a, b = int.from_bytes(held[at : at + 4], "big"), int.from_bytes(held[at + 4 : at + 8], "big")
                if a + b > most:
                    out.append((last, place, None, None, f"a frame of {a + b} bytes"))
                    broken = True
                    break
                if len(held) - at < 8 + a + b:
                    break
                head = bytes(held[at + 8 : at + 8 + a])
                try:
                    out.append((last, place, head.decode(), bytes(held[at + 8 + a : at + 8 + a + b]), None))
                except UnicodeDecodeError:
                    out.append((last, place, None, None, "a header that isn't UTF-8"))
                    broken = True
                at, place = at + 8 + a + b, place + 1
            del held[:at]

        def ended(out: list[tuple]) -> None:
            if held and not broken:
                out.append((last, place, None, None, f"{len(held)} bytes of a frame that has no end"))

        for batch in batches:
            out: list[tuple] = []
            for stream, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if stream != last:
                    ended(out)
                    last, held, place, broken = stream, bytearray(), 0, False
                if not broken:
                    held += raw or b""
                    cut(out)
            yield _frames(out)
        out = []
        ended(out)
        yield _frames(out)

    return _by_stream(chunks).select("stream", "chunk").mapInArrow(run, SPLIT)


def _frames(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["stream", "place", "header", "payload", "error"])
