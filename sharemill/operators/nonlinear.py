"""Comparisons, divisions, exponentials and softmax over fixed-point integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.field import clip, lift, quotient, rescale, submod


def greater(a: Column, b: Column, p: int) -> Column:
    return (lift(submod(a, b, p), p) > 0).cast("int")


def less(a: Column, b: Column, p: int) -> Column:
    return greater(b, a, p)


def equal(a: Column, b: Column, p: int) -> Column:
    return (submod(a, b, p) == 0).cast("int")


def relu(v: Column) -> Column:
    return F.greatest(v, F.lit(0).cast("long"))


def relu_backward(g: Column, z: Column) -> Column:
    return F.when(z > 0, g).otherwise(F.lit(0).cast("long"))


def divide(num: Column, den: Column, scale: int, on_zero: str = "error") -> Column:
    """num / den in fixed point, to the nearest; a zero divisor is an error, null, zero or one."""
    d = {"error": den, "null": F.nullif(den, F.lit(0).cast("long"))}.get(on_zero, F.when(den == 0, F.lit(1).cast("long")).otherwise(den))
    sign = F.when(d < 0, F.lit(-1).cast("long")).otherwise(F.lit(1).cast("long"))
    out = rescale(num * scale * sign, F.abs(d))
    return F.when(den == 0, F.lit(0).cast("long")).otherwise(out) if on_zero == "zero" else out


def exp_taylor5(x: Column, scale: int) -> Column:
    """1 + x + x^2/2 + ... + x^5/120, each power rounded."""
    total, power = x + scale, x
    for n, factorial in ((2, 2), (3, 6), (4, 24), (5, 120)):
        power = rescale(power * x, scale)
        total = total + rescale(power, factorial)
    return total


def exp_pade22(x: Column, scale: int) -> Column:
    """(1 + x/2 + x^2/12) / (1 - x/2 + x^2/12)."""
    square = rescale(rescale(x * x, scale), 12)
    half = rescale(x, 2)
    return rescale((square + half + scale) * scale, square - half + scale)


def log_atanh(x: Column, scale: int, terms: int = 5) -> Column:
    """2 atanh((x - 1) / (x + 1)) by its series, for x > 0. The powers are folded over an array, so
    none is worked out twice."""
    fields = "y bigint, square bigint, power bigint, total bigint"
    first = F.transform(F.array(divide(x - scale, x + scale, scale)), lambda y: F.struct(y.alias("y"), rescale(y * y, scale).alias("square"), y.alias("power"), y.alias("total")))
    start = F.struct(*(F.lit(0).cast("long").alias(n.split(" ")[0]) for n in fields.split(", ")))

    def step(acc: Column, odd: Column) -> Column:
        p = rescale(acc["power"] * acc["square"], scale)
        return F.struct(acc["y"].alias("y"), acc["square"].alias("square"), p.alias("power"), (acc["total"] + rescale(p, odd)).alias("total"))

    powers = F.lit([2 * k + 1 for k in range(1, terms)]).cast("array<bigint>")
    begin = F.coalesce(F.get(first, 0), start)
    return F.aggregate(powers, begin, step, lambda acc: acc["total"] * 2)


def softmax(df: DataFrame, logits: str, classes: int, out: str, scale: int, limit: int = 4, temperature: int = 1) -> DataFrame:
    """Adds out: an array of probabilities that sum to scale, from an array of so many logits.

    Logits are shifted by the maximum, clipped, exponentiated, divided and projected; what rounding
    leaves goes to the largest. Classes are columns of their own while this is worked out, so it
    stays within generated code and no step is done twice."""
    n, keep = range(classes), df.columns
    names = lambda p: [F.col(f"_{p}{i}") for i in n]
    own = df.withColumns({f"_z{i}": rescale(F.get(F.col(logits), F.lit(i)), temperature) if temperature != 1 else F.get(F.col(logits), F.lit(i)) for i in n})
    own = own.withColumn("_m", F.greatest(*names("z")))
    own = own.withColumns({f"_c{i}": clip(F.col(f"_z{i}") - F.col("_m"), -limit * scale, limit * scale) for i in n})
    own = own.withColumns({f"_s{i}": rescale(rescale(F.col(f"_c{i}") * F.col(f"_c{i}"), scale), 12) for i in n})
    own = own.withColumns({f"_h{i}": rescale(F.col(f"_c{i}"), 2) for i in n})
    own = own.withColumns({f"_e{i}": clip(rescale((F.col(f"_s{i}") + F.col(f"_h{i}") + scale) * scale, F.col(f"_s{i}") - F.col(f"_h{i}") + scale), 1, scale * 55) for i in n})
    own = own.withColumn("_t", sum(names("e")[1:], F.col("_e0")))
    own = own.withColumns({f"_q{i}": clip(rescale(F.col(f"_e{i}") * scale, F.col("_t")), 0, scale) for i in n})
    own = own.withColumns({"_r": F.lit(scale).cast("long") - sum(names("q")[1:], F.col("_q0")), "_top": F.greatest(*names("q"))})
    own = own.withColumn("_at", F.coalesce(*(F.when(F.col(f"_q{i}") == F.col("_top"), i) for i in n)))
    return own.select(*[c for c in keep if c != out], F.array(*(F.col(f"_q{i}") + F.when(F.col("_at") == i, F.col("_r")).otherwise(0) for i in n)).alias(out))


#: Fraction bits of the iterations below, and steps that bring their first guesses to the last bit.
BITS, STEPS = 30, 5


def with_rsqrt(df: DataFrame, n: str, out: str) -> DataFrame:
    """Adds out, a struct (y, s): 1 / sqrt(n) is y / 2^30 / 2^(15 + s) to one part in 2^26, for 0 < n < 2^62.

    n is brought to m in [2^28, 2^30) by an even shift; y starts from a line and is improved by
    y (3 - m y^2) / 2 on integers, whose error falls with its square. n of 0 gives 0."""
    one, keep = 1 << BITS, df.columns
    own = df.withColumn("_n", F.greatest(F.col(n), F.lit(1).cast("long")))
    own = own.withColumn("_s", F.floor((F.length(F.bin("_n")) - 29) / 2).cast("int"))
    own = own.withColumn("_m", F.when(F.col("_s") >= 0, F.expr("shiftright(_n, 2 * _s)")).otherwise(F.expr("shiftleft(_n, -2 * _s)")))
    own = own.withColumn("_y", F.lit(11 * one // 5) - quotient(F.col("_m") * 6, F.lit(5)))
    for k in range(STEPS):
        last = "_y" if k == 0 else f"_y{k - 1}"
        own = own.withColumn(f"_q{k}", F.shiftright(F.shiftright(F.col(last) * F.col(last), BITS) * F.col("_m"), BITS))
        own = own.withColumn(f"_y{k}", F.shiftright(F.col(last) * (3 * one - F.col(f"_q{k}")), BITS + 1))
    y = F.when(F.col(n) > 0, F.col(f"_y{STEPS - 1}")).otherwise(0).cast("long")
    return own.select(*[c for c in keep if c != out], F.struct(y.alias("y"), F.col("_s").alias("s")).alias(out))


def clip_norm(df: DataFrame, x: str, limit: int) -> DataFrame:
    """Adds norm_sq and clipped: vectors longer than limit (in the vectors' own units) are scaled down to
    it by a reciprocal square root; others stay. Clipped entries up to 2^24 are within one unit of the
    exact ones: half a unit from rounding, and a part of 2^-26 of the entry from the root."""
    own = df.withColumn("norm_sq", F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v * v))
    own = with_rsqrt(own, "norm_sq", "_root")
    own = own.withColumn("_f", shifted(F.col("_root.y") * limit, F.col("_root.s") + 15))
    small = F.col("norm_sq") <= limit * limit
    return own.withColumn("clipped", F.when(small, F.col(x)).otherwise(F.transform(x, lambda v: rescale(v * F.col("_f"), 1 << BITS)))).drop("_root", "_f")


def shifted(v: Column, bits: Column) -> Column:
    """v / 2^bits, downward, for v >= 0; bits may be negative."""
    return F.when(bits >= 0, F.call_function("shiftright", v, bits)).otherwise(F.call_function("shiftleft", v, -bits))


def with_quotient(df: DataFrame, num: str, den: str, scale: int, out: str) -> DataFrame:
    """Adds out = num * scale / den to the nearest (halves away from zero), by a reciprocal that is
    improved by y (2 - d y) on integers and one correction from the remainder; null for a divisor of 0.
    |num| * scale < 2^61, |den| < 2^30."""
    one, keep = 1 << BITS, df.columns
    own = df.withColumns({"_a": F.abs(F.col(num)) * scale, "_d": F.greatest(F.abs(F.col(den)), F.lit(1).cast("long"))})
    own = own.withColumn("_k", F.length(F.bin("_d")))
    own = own.withColumn("_m", F.expr(f"shiftleft(_d, {BITS} - _k)"))  # d in [1/2, 1)
    own = own.withColumn("_y", F.lit(48 * one // 17) - quotient(F.col("_m") * 32, F.lit(17)))
    for k in range(STEPS - 1):
        last = "_y" if k == 0 else f"_y{k - 1}"
        own = own.withColumn(f"_y{k}", F.shiftright(F.col(last) * (2 * one - F.shiftright(F.col(last) * F.col("_m"), BITS)), BITS))
    y = F.col(f"_y{STEPS - 2}")
    # a * y in two halves, as it has up to 92 bits: the upper one is exact, the lower one loses less than one
    high, low = F.shiftright("_a", 31), F.col("_a").bitwiseAND(F.lit((1 << 31) - 1).cast("long"))
    shift = F.col("_k") + (BITS - 31)
    own = own.withColumn("_q", F.when(shift >= 0, F.call_function("shiftright", high * y, shift)).otherwise(F.call_function("shiftleft", high * y, -shift)) + F.call_function("shiftright", low * y, F.col("_k") + BITS))
    for k in range(2):  # the remainder says how far off the quotient is
        q = "_q" if k == 0 else f"_q{k - 1}"
        own = own.withColumn(f"_r{k}", F.col("_a") - F.col(q) * F.col("_d"))
        own = own.withColumn(f"_q{k}", F.col(q) + F.floor((2 * F.col(f"_r{k}") + F.col("_d")) / (2 * F.col("_d")).cast("double")).cast("long"))
    sign = F.when((F.col(num) < 0) != (F.col(den) < 0), F.lit(-1)).otherwise(F.lit(1)).cast("long")
    return own.select(*[c for c in keep if c != out], F.when(F.col(den) != 0, sign * F.col("_q1")).alias(out))
