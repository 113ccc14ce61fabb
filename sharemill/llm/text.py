"""Words, shingles and hashes shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SEED = 42


def words(text: str | None) -> list[bytes]:
    """A-Z lower-cased; words are runs of bytes other than 0x20 and 0x09-0x0D. Null: no words."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_hashes(w: list[bytes], n: int) -> np.ndarray:
    """Unsigned XXH64 of each n-word shingle, repeats included; fewer words: the whole sequence."""
    if not w:
        return np.empty(0, np.uint64)
    h = xxhash.xxh64_intdigest
    if len(w) <= n:
        return np.array([h(b" ".join(w), SEED)], np.uint64)
    return np.array([h(b" ".join(z), SEED) for z in zip(*(w[k:] for k in range(n)), strict=False)], np.uint64)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes. Signed, as Spark's LongType holds it."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a slice holds at most `most` bytes of text (or one row)."""
    for b in batches:
        if not b.num_rows:
            continue
        col = b.column(b.schema.get_field_index(text))
        ends = np.cumsum([0 if x is None else len(x) for x in col.cast(pa.large_binary()).to_pylist()]) if b.nbytes > most else None
        if ends is None:
            yield b
            continue
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
            yield b.slice(at, to - at)
            at = to
