"""Packed shares of vectors of any length: chunks of k secrets, the last one shorter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.field import modsum
from ..functions.lagrange import basis
from ..spec import FieldSpec
from .sharing import masks, share, weighted, with_masks


def _of_size(chunk: Column, own_masks: Sequence[Column], at: int, spec: FieldSpec) -> Column:
    """The share at a party of a chunk of up to k secrets: its polynomial has as many as there are."""
    arms = [(size, with_masks([F.get(chunk, F.lit(i)) for i in range(size)], at, own_masks, spec)) for size in range(1, spec.k + 1)]
    return F.coalesce(*(F.when(F.size(chunk) == size, y) for size, y in arms))


def share_vector(df: DataFrame, vector: str, key: Sequence[str], spec: FieldSpec, label: str = "chunk") -> DataFrame:
    """A row per chunk and party: (key, chunk, size, party, y) of an array of field elements. Empty and
    null vectors have no chunks. No shuffle; masks are hashed once for all parties."""
    v, k = F.col(vector), spec.k
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / k).cast("int")), lambda c: F.slice(v, c * k + 1, k))
    own = df.where(F.size(v) > 0).select(*key, F.posexplode(chunks).alias("chunk", "_c"))
    own = own.withColumns({f"_m{i}": m for i, m in enumerate(masks(spec, label, *map(F.col, key), F.col("chunk")))})
    marks = [F.col(f"_m{i}") for i in range(spec.t)]
    rows = F.array(*(F.struct(F.lit(p).alias("party"), _of_size(F.col("_c"), marks, p, spec).alias("y")) for p in spec.parties))
    return own.select(*key, "chunk", F.size("_c").alias("size"), F.explode(rows).alias("s")).select(*key, "chunk", "size", "s.party", "s.y")


def _weights(size: int, lane: int, spec: FieldSpec) -> tuple[list[int], int]:
    return spec.parties[: spec.t + size], -(lane + 1)


def _lane(size: int, lane: int, spec: FieldSpec, party: str = "party") -> Column:
    use, target = _weights(size, lane, spec)
    return weighted(F.col("y"), F.col(party), use, target, spec.p)


def reconstruct_vector(shares: DataFrame, key: Sequence[str], spec: FieldSpec) -> DataFrame:
    """(key, idx, secret) of every value, in one aggregation by chunk: a chunk of r secrets is opened
    from t + r shares, and its lanes follow those of the chunks before."""
    lanes = [modsum(F.coalesce(*(F.when(F.col("size") == size, _lane(size, lane, spec)) for size in range(lane + 1, spec.k + 1)), F.lit(0).cast("long")), spec.p) for lane in range(spec.k)]
    own = shares.groupBy(*key, "chunk", "size").agg(F.array(*lanes).alias("v"))
    own = own.select(*key, "chunk", F.posexplode(F.slice("v", F.lit(1), F.col("size"))).alias("lane", "secret"))
    return own.select(*key, (F.col("chunk") * spec.k + F.col("lane")).alias("idx"), "secret")


def to_lanes(shares: DataFrame, key: Sequence[str], spec: FieldSpec, label: str = "unpack") -> DataFrame:
    """(key, idx, party, y): plain shares of every value of packed rows, nothing opened. Each of a
    chunk's t + r first parties re-shares its weighted share of each lane, and receivers add up."""
    parts = F.filter(
        F.array(*(F.struct(F.lit(lane).alias("lane"), F.coalesce(*(F.when(F.col("size") == size, _lane(size, lane, spec, "sender")) for size in range(lane + 1, spec.k + 1))).alias("part")) for lane in range(spec.k))),
        lambda x: x["lane"] < F.col("size"),
    )
    own = shares.withColumnRenamed("party", "sender").where(F.col("sender") <= F.col("size") + spec.t)
    own = own.select(*key, "sender", F.col("chunk"), F.explode(parts).alias("l")).select(*key, "sender", (F.col("chunk") * spec.k + F.col("l.lane")).alias("idx"), F.col("l.part").alias("part"))
    sent = share(own, "part", [*key, "sender", "idx"], spec, label)
    return sent.groupBy(*key, "idx", "party").agg(modsum(F.col("y"), spec.p).alias("y"))


def pack_batch(samples: DataFrame, sample: str, vector: str, spec: FieldSpec, party: int, label: str = "batch") -> DataFrame:
    """(batch, j, y): one party's packed shares of each feature over batches of k samples in order of an
    integer id, the last batch shorter. A batch is k rows, so its arrays are short."""
    own = samples.groupBy(F.expr(f"{sample} div {spec.k}").alias("batch")).agg(F.array_sort(F.collect_list(F.struct(F.col(sample).alias("id"), F.col(vector).alias("x")))).alias("rows"))
    own = own.select("batch", F.explode(F.sequence(F.lit(0), F.size(F.get("rows", F.lit(0))["x"]) - 1)).alias("j"), "rows")
    chunk = own.select("batch", "j", F.transform("rows", lambda r: F.get(r["x"], F.col("j"))).alias("_c"))
    return chunk.select("batch", "j", _of_size(F.col("_c"), masks(spec, label, F.col("batch"), F.col("j")), party, spec).alias("y"))


def basis_rows(size: int, at: int, spec: FieldSpec) -> list[int]:
    """Coefficients of a chunk's secrets and masks in the share at a party."""
    return basis([-j for j in range(1, size + 1)] + list(range(1, spec.t + 1)), at, spec.p)
