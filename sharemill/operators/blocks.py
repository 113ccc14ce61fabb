"""Products of two shared matrices by matrix triples, block by block. A matrix is rows (bi, bj, m): the
block's place, and its entries as bytes. Shares have a column party beside it. What is opened are
blocks of D = X - A and E = Y - B, so values move a block at a time, never as rows of cells."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import limbs
from ..functions.lagrange import basis
from ..spec import FieldSpec

#: Rows and columns of a block, blocks of the contraction that one group multiplies, and partial
#: products that one group adds up.
ROWS, WIDE, CHUNK, MERGE = 512, 64, 4, 32
BLOCK = "bi long, bj long, n int, m binary"


def packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, np.uint64).tobytes()


def unpacked(m: bytes, n: int) -> np.ndarray:
    """n rows."""
    return np.frombuffer(m, np.uint64).reshape(n, -1)


def stream(p: int, shape: tuple[int, int], *key: object) -> np.ndarray:
    """Field elements that follow from a key: a counter-based generator seeded with its SHA-256."""
    seed = int.from_bytes(hashlib.sha256("|".join(map(str, key)).encode()).digest()[:16], "big")
    return np.random.Generator(np.random.Philox(key=seed)).integers(0, p, size=shape, dtype=np.uint64)


def share_of(secret: np.ndarray, party: int, spec: FieldSpec, *key: object) -> np.ndarray:
    """A party's share of a block: masks are whole blocks too."""
    out = secret
    for k in range(1, spec.t + 1):
        out = limbs.add(out, limbs.scaled(stream(spec.p, secret.shape, *key, "mask", k), pow(party, k, spec.p), spec.p), spec.p)
    return out


def table(rows: Sequence[tuple], schema: str) -> pa.Table:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [part.strip().split(" ") for part in schema.split(",")]
    return pa.table({n: pa.array([r[k] for r in rows], types[t]) for k, (n, t) in enumerate(names)})


def batches(t: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from t.combine_chunks().to_batches()


def of_rows(df: DataFrame, row: str, array: str, width: int, spec: FieldSpec, transposed: bool = False) -> DataFrame:
    """df(row long, array<long>) -> blocks of a matrix with a line for each row (or a column, if transposed),
    at the row's number: ROWS of them to a block, so numbers should be dense. Entries of rows that
    repeat add up, first within each task; rows without a number or an array are left out; missing
    entries are zero, and further ones than width an error."""
    p = spec.p

    def combined(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            if not b.num_rows:
                continue
            ids, at = np.unique(b.column(0).to_numpy(), return_inverse=True)
            many = np.diff(b.column(1).offsets.to_numpy())
            if many.max() > width:
                raise ValueError(f"a row of {many.max()} entries in a matrix {width} wide")
            flat = b.column(1).flatten()
            flat = np.where(flat.is_null().to_numpy(zero_copy_only=False), 0, flat.fill_null(0).to_numpy(zero_copy_only=False))
            x = np.zeros((b.num_rows, width), np.uint64)
            x[np.arange(width) < many[:, None]] = np.mod(flat.astype(object) if p > 1 << 62 else flat, p).astype(np.uint64)
            total = np.zeros((len(ids), width), np.uint64)
            order = np.argsort(at, kind="stable")
            place = np.arange(len(order)) - np.searchsorted(at[order], at[order])
            for k in range(int(place.max()) + 1):  # the k-th of each id's rows
                own = order[place == k]
                total[at[own]] = limbs.add(total[at[own]], x[own], p)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([packed(r) for r in total], pa.binary())], names=["row", "m"])

    def block(t: pa.Table) -> pa.Table:
        rows, m = t.column("row").to_numpy(), t.column("m").to_pylist()
        x = np.zeros((ROWS, width), np.uint64)
        for r, own in zip(rows.tolist(), m, strict=True):
            x[r % ROWS] = limbs.add(x[r % ROWS], np.frombuffer(own, np.uint64), p)
        at = int(rows[0]) // ROWS
        out = []
        for k, lo in enumerate(range(0, width, WIDE)):
            own = x[:, lo : lo + WIDE]
            out.append((k, at, own.shape[1], packed(own.T)) if transposed else (at, k, ROWS, packed(own)))
        return table(out, BLOCK)

    own = df.where(F.col(row).isNotNull() & F.col(array).isNotNull() & (F.size(array) > 0)).select(F.col(row).cast("long").alias("row"), F.col(array).cast("array<bigint>").alias("x"))
    one = own.mapInArrow(combined, "row long, m binary")
    return one.groupBy(F.floor(F.col("row") / ROWS).alias("at")).applyInArrow(block, BLOCK)


def shared(blocks: DataFrame, name: str, spec: FieldSpec) -> DataFrame:
    """(bi, bj, n, m, party): a row for each party."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for bi, bj, n, m in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                x = unpacked(m, n)
                yield from batches(table([(bi, bj, n, packed(share_of(x, i, spec, "share", name, bi, bj)), i) for i in spec.parties], SHARES))

    return blocks.mapInArrow(run, SHARES)


SHARES = BLOCK + ", party int"


def masked(shares: DataFrame, name: str, spec: FieldSpec) -> DataFrame:
    """Each party takes its share of the triple's block off its own: only such differences are opened."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for bi, bj, n, m, party in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                x = unpacked(m, n)
                own = share_of(stream(spec.p, x.shape, "triple", name, bi, bj), party, spec, "triple", name, bi, bj)
                yield from batches(table([(bi, bj, n, packed(limbs.sub(x, own, spec.p)), party)], SHARES))

    return shares.mapInArrow(run, SHARES)


def opened(shares: DataFrame, spec: FieldSpec) -> DataFrame:
    """The blocks at 0 from the lowest t + 1 parties, which meet in one group a block."""
    use = spec.parties[: spec.t + 1]
    lam = dict(zip(use, basis(use, 0, spec.p), strict=True))

    def run(t: pa.Table) -> pa.Table:
        out = None
        for party, n, m in zip(*(t.column(c).to_pylist() for c in ("party", "n", "m")), strict=True):
            part = limbs.scaled(unpacked(m, n), lam[party], spec.p)
            out = part if out is None else limbs.add(out, part, spec.p)
        return table([(t.column("bi")[0].as_py(), t.column("bj")[0].as_py(), len(out), packed(out))], BLOCK)

    return shares.where(F.col("party").isin(use)).groupBy("bi", "bj").applyInArrow(run, BLOCK)


def product(x: DataFrame, y: DataFrame, spec: FieldSpec, name: str = "xy") -> DataFrame:
    """Shares (bi, bk, ..., party) of X and (bk, bj, ..., party) of Y -> shares (bi, bj, ..., party) of X Y mod p.

    D and E are opened a block at a time; the blocks of CHUNK places of the contraction meet once, where
    each party adds C + D B + A E + D E from its own shares of the triple; the partial products are
    added up as a tree. Blocks that either side lacks are zero."""
    d = opened(masked(x, f"{name}-a", spec), spec).select("bi", "bj", "n", "m", F.expr(f"bj div {CHUNK}").alias("chunk"))
    e = opened(masked(y, f"{name}-b", spec), spec).select(*(F.col(c).alias(f"e_{c}") for c in ("bi", "bj", "n", "m")), F.expr(f"bi div {CHUNK}").alias("e_chunk"))
    p = spec.p

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        ds = [(bi, bk, unpacked(m, n)) for bi, bk, n, m in zip(*(left.column(c).to_pylist() for c in ("bi", "bj", "n", "m")), strict=True)]
        es = [(bk, bj, unpacked(m, n)) for bk, bj, n, m in zip(*(right.column(f"e_{c}").to_pylist() for c in ("bi", "bj", "n", "m")), strict=True)]
        sums: dict[tuple[int, int, int], np.ndarray] = {}
        a_of = {(bi, bk): stream(p, dm.shape, "triple", f"{name}-a", bi, bk) for bi, bk, dm in ds}
        b_of = {(bk, bj): stream(p, em.shape, "triple", f"{name}-b", bk, bj) for bk, bj, em in es}
        for bi, bk, dm in ds:
            for k, bj, em in es:
                if k != bk:
                    continue
                a, b = a_of[bi, bk], b_of[bk, bj]
                de, c = limbs.matmul(dm, em, p), limbs.matmul(a, b, p)
                for i in spec.parties:
                    own = limbs.add(de, share_of(c, i, spec, "triple", f"{name}-c", bi, bk, bj), p)
                    own = limbs.add(own, limbs.matmul(dm, share_of(b, i, spec, "triple", f"{name}-b", bk, bj), p), p)
                    own = limbs.add(own, limbs.matmul(share_of(a, i, spec, "triple", f"{name}-a", bi, bk), em, p), p)
                    had = sums.get((bi, bj, i))
                    sums[bi, bj, i] = own if had is None else limbs.add(had, own, p)
        chunk = left.column("chunk")[0].as_py() if left.num_rows else 0
        return table([(bi, bj, len(m), packed(m), i, chunk) for (bi, bj, i), m in sums.items()], SHARES + ", chunk long")

    parts = d.groupBy("chunk").cogroup(e.groupBy("e_chunk")).applyInArrow(run, SHARES + ", chunk long")
    return added(parts, (x.agg(F.max("bj")).first()[0] or 0) // CHUNK + 1, p)


def added(parts: DataFrame, chunks: int, p: int) -> DataFrame:
    """Sums of partial blocks (bi, bj, n, m, party, chunk), MERGE of them to a group at a time."""

    def run(t: pa.Table) -> pa.Table:
        out = None
        for m, n in zip(t.column("m").to_pylist(), t.column("n").to_pylist(), strict=True):
            out = unpacked(m, n) if out is None else limbs.add(out, unpacked(m, n), p)
        one = lambda c: t.column(c)[0].as_py()
        return table([(one("bi"), one("bj"), len(out), packed(out), one("party"), one("chunk") // MERGE)], SHARES + ", chunk long")

    while chunks > 1:
        parts = parts.groupBy("bi", "bj", "party", F.expr(f"chunk div {MERGE}").alias("to")).applyInArrow(run, SHARES + ", chunk long")
        chunks = -(-chunks // MERGE)
    return parts.select("bi", "bj", "n", "m", "party")


def cells(blocks: DataFrame) -> DataFrame:
    """(i, j, y) of opened blocks."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for bi, bj, n, m in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                x = unpacked(m, n)
                tall, wide = (WIDE if n < ROWS else ROWS), WIDE
                i, j = np.indices(x.shape)
                yield pa.RecordBatch.from_arrays([pa.array((bi * tall + i).ravel()), pa.array((bj * wide + j).ravel()), pa.array(x.astype(np.int64).ravel())], names=["i", "j", "y"])

    return blocks.mapInArrow(run, "i long, j long, y long")


def plain_product(x: DataFrame, y: DataFrame, spec: FieldSpec) -> DataFrame:
    """Blocks (bi, bk) and (bk, bj) without parties -> blocks of X Y mod p, the same way without a triple."""
    p = spec.p
    left = x.select("bi", "bj", "n", "m", F.expr(f"bj div {CHUNK}").alias("chunk"))
    right = y.select(*(F.col(c).alias(f"e_{c}") for c in ("bi", "bj", "n", "m")), F.expr(f"bi div {CHUNK}").alias("e_chunk"))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        sums: dict[tuple[int, int], np.ndarray] = {}
        own = [(bk, bj, unpacked(m, n)) for bk, bj, n, m in zip(*(b.column(f"e_{c}").to_pylist() for c in ("bi", "bj", "n", "m")), strict=True)]
        for bi, bk, n, m in zip(*(a.column(c).to_pylist() for c in ("bi", "bj", "n", "m")), strict=True):
            for k, bj, em in own:
                if k == bk:
                    part = limbs.matmul(unpacked(m, n), em, p)
                    had = sums.get((bi, bj))
                    sums[bi, bj] = part if had is None else limbs.add(had, part, p)
        chunk = a.column("chunk")[0].as_py() if a.num_rows else 0
        return table([(bi, bj, len(m), packed(m), 0, chunk) for (bi, bj), m in sums.items()], SHARES + ", chunk long")

    parts = left.groupBy("chunk").cogroup(right.groupBy("e_chunk")).applyInArrow(run, SHARES + ", chunk long")
    return added(parts, (x.agg(F.max("bj")).first()[0] or 0) // CHUNK + 1, p).drop("party")
