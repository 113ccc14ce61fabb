"""The field inverse of a shared value: a random mask hides it while the product is opened."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.field import element, mulmod
from ..spec import FieldSpec
from . import beaver
from .sharing import at_party, masks, reconstruct

#: Masks that are tried: an opened product of 0 means that the mask, or the value, is 0.
TRIES = 5


def inverses(df: DataFrame, column: str, p: int) -> DataFrame:
    """Adds `inverse` of a public field element, null for 0. A modular power is no built-in function, so
    it is taken over Arrow batches."""
    names = [*df.columns, "inverse"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [None if not v else pow(v, -1, p) for v in b.column(names.index(column)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], names=names)

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("inverse", LongType())]))


def inverse_by_mask(shares: DataFrame, key: Sequence[str], spec: FieldSpec, label: str = "inverse") -> DataFrame:
    """shares(key, party, y) -> (key, party, y) of the inverses: r is a shared mask, u = r times the value
    is opened, and each party scales its share of r by the inverse of u. A mask of 0 is replaced by the
    next one of TRIES; y is null where the value is 0."""
    keys = [F.col(k) for k in key]
    mask = F.coalesce(*(F.nullif(element(spec.p, label, *keys, k), F.lit(0).cast("long")) for k in range(TRIES)))
    every = shares.select(*key).distinct().withColumn("_r", mask)
    own = every.withColumns({f"_m{k}": m for k, m in enumerate(masks(spec, label, *keys))})
    parties = F.array(*(F.struct(F.lit(i).alias("party"), at_party(F.col("_r"), i, [F.col(f"_m{k}") for k in range(spec.t)], spec.p).alias("y")) for i in spec.parties))
    r = own.select(*key, F.explode(parties).alias("s")).select(*key, "s.party", "s.y")
    u = inverses(reconstruct(beaver.multiply(shares, r, key, spec), key, spec, out="_u"), "_u", spec.p)
    return r.join(u, list(key)).select(*key, "party", mulmod(F.col("y"), F.col("inverse"), spec.p).alias("y"))
