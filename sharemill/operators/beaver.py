"""Products of shared values from triples (a, b, ab) that follow from keyed hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.field import element, modsum, mulmod, submod
from ..functions.lagrange import basis
from ..spec import FieldSpec
from .sharing import at_party, masks, own_share, weighted


def triple(key: Sequence[Column], spec: FieldSpec) -> tuple[Column, Column, Column]:
    a, b = element(spec.p, "a", *key), element(spec.p, "b", *key)
    return a, b, mulmod(a, b, spec.p)


def triples(df: DataFrame, key: Sequence[str], spec: FieldSpec) -> DataFrame:
    """(key, party, a, b, c): each party's shares of a triple for each row."""
    keys = [F.col(k) for k in key]
    secrets = dict(zip("abc", triple(keys, spec), strict=True))
    own = df.withColumns({f"_{n}": v for n, v in secrets.items() if n != "c"}).withColumn("_c", mulmod(F.col("_a"), F.col("_b"), spec.p))
    own = own.withColumns({f"_m{n}{k}": m for n in "abc" for k, m in enumerate(masks(spec, f"triple_{n}", *keys))})
    rows = F.array(*(F.struct(F.lit(i).alias("party"), *(_at(n, i, spec).alias(n) for n in "abc")) for i in spec.parties))
    return own.withColumn("_t", F.explode(rows)).select(*key, "_t.party", "_t.a", "_t.b", "_t.c")


def _at(n: str, party: int, spec: FieldSpec) -> Column:
    return at_party(F.col(f"_{n}"), party, [F.col(f"_m{n}{k}") for k in range(spec.t)], spec.p)


def multiply(x: DataFrame, y: DataFrame, key: Sequence[str], spec: FieldSpec) -> DataFrame:
    """x(key, party, y), y(key, party, y) -> (key, party, y): shares of the products.

    Each party takes its share of a off its share of x, and of b off that of y; only those
    differences are opened. Both operands and the opening share one shuffle on key."""
    p, use = spec.p, spec.parties[: spec.t + 1]
    keys = [F.col(k) for k in key]
    a, b, _ = triple(keys, spec)
    hidden = lambda own, secret, n, side: own.where(F.col("party").isin(use)).select(
        *key, weighted(submod(F.col("y"), own_share(secret, key, spec, f"triple_{n}"), p), F.col("party"), use, 0, p).alias("_w"), F.lit(side).alias("side")
    )
    both = hidden(x, a, "a", 0).unionByName(hidden(y, b, "b", 1))
    own = both.groupBy(*key).agg(*(modsum(F.when(F.col("side") == s, F.col("_w")).otherwise(0), p).alias(n) for s, n in ((0, "d"), (1, "e"))))
    own = own.withColumns({"_a": a, "_b": b}).withColumn("_c", mulmod(F.col("_a"), F.col("_b"), p))
    own = own.withColumns({f"_m{n}{k}": m for n in "abc" for k, m in enumerate(masks(spec, f"triple_{n}", *keys))})
    parts = F.array(*(F.struct(F.lit(i).alias("party"), *(_at(n, i, spec).alias(n) for n in "abc")) for i in spec.parties))
    own = own.withColumn("_t", F.explode(parts)).withColumn("_de", mulmod(F.col("d"), F.col("e"), p))
    terms = F.col("_t.c") + mulmod(F.col("d"), F.col("_t.b"), p)
    terms = (terms % p + mulmod(F.col("e"), F.col("_t.a"), p)) % p
    return own.select(*key, "_t.party", ((terms + F.col("_de")) % p).alias("y"))


def multiply_rows(df: DataFrame, x: str, y: str, key: Sequence[str], spec: FieldSpec, labels: tuple[str, str] = ("left", "right")) -> DataFrame:
    """df(key, x, y), two secrets of a row -> (key, party, y): shares of their products. What parties send
    each other about a row starts and ends in that row, so the differences are opened within it, every
    hash is taken once, and nothing is shuffled."""
    p, use = spec.p, spec.parties[: spec.t + 1]
    keys = [F.col(k) for k in key]
    a, b, _ = triple(keys, spec)
    own = df.withColumns({"_a": a, "_b": b}).withColumn("_c", mulmod(F.col("_a"), F.col("_b"), p))
    names = {"x": labels[0], "y": labels[1], **{n: f"triple_{n}" for n in "abc"}}
    own = own.withColumns({f"_m{n}{k}": m for n, label in names.items() for k, m in enumerate(masks(spec, label, *keys))})
    held = lambda n, secret, i: at_party(F.col(secret), i, [F.col(f"_m{n}{k}") for k in range(spec.t)], p)

    def opened(n: str, secret: str, mask: str) -> Column:
        parts = [mulmod(submod(held(n, secret, i), held(mask, f"_{mask}", i), p), lam, p) for i, lam in zip(use, basis(use, 0, p), strict=True)]
        out = parts[0]
        for part in parts[1:]:
            out = (out + part) % p
        return out

    own = own.withColumns({"_d": opened("x", x, "a"), "_e": opened("y", y, "b")}).withColumn("_de", mulmod(F.col("_d"), F.col("_e"), p))

    def product(i: int) -> Column:
        terms = (held("c", "_c", i) + mulmod(F.col("_d"), held("b", "_b", i), p)) % p
        return ((terms + mulmod(F.col("_e"), held("a", "_a", i), p)) % p + F.col("_de")) % p

    rows = F.array(*(F.struct(F.lit(i).alias("party"), product(i).alias("y")) for i in spec.parties))
    return own.select(*key, F.explode(rows).alias("_t")).select(*key, "_t.party", "_t.y")
