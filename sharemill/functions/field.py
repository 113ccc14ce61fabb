"""Exact field and fixed-point arithmetic as Column expressions, all within generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..spec import P31, P61, FieldSpec

Number = Column | int


def col(x: Number) -> Column:
    return F.lit(x).cast("long") if isinstance(x, int) else x


def mulmod(a: Number, b: Number, p: int) -> Column:
    """a * b mod p for 0 <= a, b < p, exact. For 2^61 - 1 in 31-bit limbs, so that no decimals are
    needed; small fields multiply as they are; others go through decimals."""
    if isinstance(a, int):
        a, b = b, a
    if p == P61 and isinstance(b, int) and not isinstance(a, int):
        return _by_constant(a, b)
    a, b = col(a), col(b)
    if p <= P31:
        return (a * b) % p
    if p != P61:
        return ((a.cast("decimal(19,0)") * b.cast("decimal(19,0)")) % F.lit(p).cast("decimal(19,0)")).cast("long")
    low = F.lit(P31).cast("long")
    ah, al, bh, bl = F.shiftright(a, 31), a.bitwiseAND(low), F.shiftright(b, 31), b.bitwiseAND(low)
    mid, lo = ah * bl + al * bh, al * bl
    parts = ah * bh * 2 + F.shiftright(mid, 30) + F.shiftleft(mid.bitwiseAND(F.lit((1 << 30) - 1).cast("long")), 31)
    return (parts + lo.bitwiseAND(F.lit(p).cast("long")) + F.shiftright(lo, 61)) % p


def _by_constant(a: Column, b: int) -> Column:
    """a * b mod 2^61 - 1 for a known b: limbs of b that are zero make no code."""
    low = F.lit(P31).cast("long")
    bh, bl = b >> 31, b & P31
    if b < 4:  # the product fits as it is
        return (a * b) % P61
    ah, al = F.shiftright(a, 31), a.bitwiseAND(low)
    mid, lo = ah * bl if not bh else ah * bl + al * bh, al * bl
    parts = F.shiftright(mid, 30) + F.shiftleft(mid.bitwiseAND(F.lit((1 << 30) - 1).cast("long")), 31)
    if bh:
        parts = parts + ah * (2 * bh)
    return (parts + lo.bitwiseAND(F.lit(P61).cast("long")) + F.shiftright(lo, 61)) % P61


def addmod(a: Number, b: Number, p: int) -> Column:
    return (col(a) + col(b)) % p


def submod(a: Number, b: Number, p: int) -> Column:
    return (col(a) - col(b) + p) % p


def field(v: Number, p: int) -> Column:
    """A signed integer as a field element."""
    return F.pmod(col(v), F.lit(p).cast("long"))


def lift(y: Number, p: int) -> Column:
    """A field element as a signed integer: the upper half is negative."""
    y = col(y)
    return F.when(y > p // 2, y - p).otherwise(y)


def fixed(v: Column, scale: int, how: str = "round") -> Column:
    """A real as a scaled integer: trunc(ate), rint (half to even) or round (half away from zero)."""
    x = v.cast("double") * float(scale)
    if how == "trunc":
        return x.cast("long")
    return (F.rint(x) if how == "rint" else F.round(x)).cast("long")


def encode(v: Column, spec: FieldSpec, how: str = "round") -> Column:
    return field(fixed(v, spec.scale, how), spec.p)


def decode(y: Column, spec: FieldSpec) -> Column:
    return lift(y, spec.p) / float(spec.scale)


def rescale(v: Number, d: Number) -> Column:
    """v / d to the nearest integer, halves away from zero; d > 0."""
    v, d = col(v), col(d)
    return F.when(v < 0, F.lit(-1).cast("long")).otherwise(F.lit(1).cast("long")) * quotient(F.abs(v) * 2 + d, d * 2)


def rescale_floor(v: Number, d: int) -> Column:
    """The variant that rounds negatives one too low at the border: floor((v -+ d / 2) / d)."""
    v = col(v)
    x = v + F.when(v < 0, -(d // 2)).otherwise(d // 2)
    return quotient(x - F.pmod(x, F.lit(d).cast("long")), F.lit(d).cast("long"))


def quotient(a: Column, b: Column) -> Column:
    """a div b, towards zero, exact for 64-bit integers."""
    return F.call_function("div", a, b)


def clip(v: Number, lo: int, hi: int) -> Column:
    return F.least(F.greatest(col(v), F.lit(lo).cast("long")), F.lit(hi).cast("long"))


def modsum(y: Column, p: int) -> Column:
    """The sum of a group's field elements mod p; decimals hold it for up to 10^19 rows."""
    return (F.sum(y.cast("decimal(19,0)")) % F.lit(p).cast("decimal(19,0)")).cast("long")


def hash60(*parts: Column | str | int) -> Column:
    """60 bits from a keyed SHA-256: the same everywhere, below every 61-bit prime."""
    own = [x.cast("string") if isinstance(x, Column) else F.lit(str(x)) for x in parts]
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *own).cast("binary"), 256), 1, 15), 16, 10).cast("long")


def element(p: int, *parts: Column | str | int) -> Column:
    """A keyed field element: the hash itself where the field is larger than 60 bits."""
    return hash60(*parts) if p >= 1 << 60 else hash60(*parts) % p
