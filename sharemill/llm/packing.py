"""Bounded-space online packing: a partition keeps a fixed number of open windows, a piece goes where
it fits best, and where none has room the fullest takes what fits and is emitted. What is left
open in the partitions is merged, in two steps of bounded size."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .store import materialize

WINDOW, OPEN = 1024, 16
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
FIELDS = [x.split(" ")[0] for x in PIECE.split(", ")]
TYPES = [pa.int64()] * 7 + [pa.binary()]


class Windows:
    """Open windows of one partition. Pieces are (doc_id, start, ids, doc_tokens)."""

    def __init__(self, window: int, most_open: int) -> None:
        self.window, self.most_open = window, most_open
        self.open: list[list] = []  # [room, pieces]

    def add(self, doc_id: int | None, start: int, ids: bytes, total: int) -> Iterator[list]:
        """Places a piece and yields the windows that it fills."""
        size = self.window * 4
        while len(ids) >= size:
            yield [(doc_id, start, ids[:size], total)]
            ids, start = ids[size:], start + self.window
        while ids:
            n = len(ids) // 4
            best = min((w for w in self.open if w[0] >= n), key=lambda w: w[0], default=None)
            if best is None and len(self.open) >= self.most_open:
                best = min(self.open, key=lambda w: w[0])  # the fullest: it takes the head and goes
            if best is None:
                best = [self.window, []]
                self.open.append(best)
            k = min(n, best[0])
            best[1].append((doc_id, start, ids[: 4 * k], total))
            best[0] -= k
            ids, start = ids[4 * k :], start + k
            if not best[0]:
                self.open.remove(best)
                yield best[1]


def rows(sequence: int, pieces: list, keep_ids: bool) -> Iterator[tuple]:
    at = 0
    for doc_id, start, ids, total in pieces:
        n = len(ids) // 4
        yield doc_id, start, n, zlib.crc32(ids), total, sequence, at, ids if keep_ids else None
        at += n


def batch(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), TYPES, strict=True)], names=FIELDS)


def flow(pieces: Iterable[tuple], window: int, most_open: int, base: int, last: bool) -> Iterator[pa.RecordBatch]:
    """Packs a partition's pieces. Open windows keep their ids, to be merged; at the last step they
    are cut into sequences whose lengths are powers of two, so nothing is padded there."""
    w, out, k = Windows(window, most_open), [], base
    for piece in pieces:
        for full in w.add(*piece):
            out += rows(k, full, False)
            k += 1
        if len(out) > 20_000:
            yield batch(out)
            out = []
    for _, left in w.open:
        if not last:
            out += rows(k, left, True)
            k += 1
            continue
        for own in powers(left):
            out += rows(k, own, False)
            k += 1
    if out:
        yield batch(out)


def powers(pieces: list) -> Iterator[list]:
    """Cuts a window into parts whose lengths are powers of two, longest first."""
    n = sum(len(p[2]) // 4 for p in pieces)
    todo = list(pieces)
    for bit in reversed(range(n.bit_length())):
        if not n >> bit & 1:
            continue
        want, own = 1 << bit, []
        while want:
            doc_id, start, ids, total = todo.pop(0)
            k = min(want, len(ids) // 4)
            own.append((doc_id, start, ids[: 4 * k], total))
            want -= k
            if 4 * k < len(ids):
                todo.insert(0, (doc_id, start + k, ids[4 * k :], total))
        yield own


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, most_open: int = OPEN, end_id: int = 0) -> DataFrame:
    """docs(doc_id, text, ...) -> a row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset. A null or empty text is the one end id; a null doc_id is carried along;
    repeated rows are packed as often as they come; an empty table gives no rows; extra columns
    are ignored. Sequences have `window` ids or, among the last few, a power of two, so nothing
    is padded. A partition holds at most `most_open` windows, whatever it reads."""
    path = path or bpe.default_path()
    end = end_id.to_bytes(4, "little")

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = bpe.unit_ids(path)

        def pieces() -> Iterator[tuple]:
            for b in batches:
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    own = bpe.encode(ids, text or "") + end
                    yield doc_id, 0, own, len(own) // 4

        yield from flow(pieces(), window, most_open, TaskContext.get().partitionId() << 36, False)

    def merge(level: int, last: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def pieces() -> Iterator[tuple]:
                for b in batches:
                    cols = [b.column(FIELDS.index(c)).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]
                    yield from zip(*cols, strict=True)

            base = (level << 60) + (TaskContext.get().partitionId() << 36)
            yield from flow(pieces(), window, most_open, base, last)

        return run

    done = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(first, PIECE), "packed")
    parts = max(1, done.select(F.countDistinct(F.shiftright("sequence_id", 36))).first()[0])
    open_ = done.where("ids is not null")
    groups = max(1, math.isqrt(parts))
    deal = F.pmod(F.shiftright("sequence_id", 36), F.lit(groups))
    some = materialize(open_.repartition(groups, deal).sortWithinPartitions("sequence_id", "offset").mapInArrow(merge(1, False), PIECE), "merged")
    rest = some.where("ids is not null").coalesce(1).sortWithinPartitions("sequence_id", "offset").mapInArrow(merge(2, True), PIECE)
    whole = done.where("ids is null").union(some.where("ids is null")).union(rest)
    return whole.drop("ids")
