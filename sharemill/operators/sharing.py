"""Shamir sharing, plain and packed. Shares are rows (..., party, y); a round of messages between
parties is a shuffle. Masks come from keyed hashes, so a share is the same on every evaluation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.field import element, modsum, mulmod
from ..functions.lagrange import basis, vanishing
from ..spec import FieldSpec


def masks(spec: FieldSpec, label: str, *key: Column) -> list[Column]:
    return [element(spec.p, label, *key, k) for k in range(1, spec.t + 1)]


def at_party(secret: Column, party: int, own_masks: Sequence[Column], p: int) -> Column:
    y = secret
    for k, m in enumerate(own_masks, 1):
        y = (y + mulmod(m, pow(party, k, p), p)) % p
    return y


def polynomial(secret: Column, party: int, spec: FieldSpec, label: str, *key: Column) -> Column:
    """The share of one party: secret + sum of mask_k party^k."""
    return at_party(secret, party, masks(spec, label, *key), spec.p)


def share(df: DataFrame, secret: str, key: Sequence[str], spec: FieldSpec, label: str = "share") -> DataFrame:
    """A row per party: the other columns, party int, y. No shuffle."""
    own = {f"_m{k}": m for k, m in enumerate(masks(spec, label, *(F.col(k) for k in key)))}  # hashed once for all parties
    rows = F.array(*(F.struct(F.lit(i).alias("party"), at_party(F.col(secret), i, [F.col(m) for m in own], spec.p).alias("y")) for i in spec.parties))
    return df.withColumns(own).withColumn("_s", F.explode(rows)).select(*[c for c in df.columns if c != secret], "_s.party", "_s.y")


def weighted(y: Column, party: Column, points: Sequence[int], target: int, p: int) -> Column:
    """A share times its interpolation coefficient; parties outside the points count nothing, and a share
    that is null stays null."""
    out = F.when(~party.isin(list(points)), F.lit(0).cast("long"))
    for x, c in zip(points, basis(points, target, p), strict=True):
        out = out.when(party == x, mulmod(y, c, p))
    return out


def reconstruct(shares: DataFrame, key: Sequence[str], spec: FieldSpec, parties: Sequence[int] | None = None, value: str = "y", out: str = "secret") -> DataFrame:
    """One grouped aggregation: the field element at 0 from the lowest t + 1 parties."""
    use = list(parties or spec.parties[: spec.t + 1])
    if len(use) < spec.t + 1:
        raise ValueError("too few shares")
    return shares.where(F.col("party").isin(use)).groupBy(*key).agg(modsum(weighted(F.col(value), F.col("party"), use, 0, spec.p), spec.p).alias(out))


def with_masks(secrets: Sequence[Column], at: int, own_masks: Sequence[Column], spec: FieldSpec) -> Column:
    """The value at `at` of the polynomial through the secrets at -1..-k and the t masks at 1..t."""
    points = [-j for j in range(1, len(secrets) + 1)] + list(range(1, spec.t + 1))
    out = F.lit(0).cast("long")
    for lam, v in zip(basis(points, at, spec.p), [*secrets, *own_masks], strict=True):
        out = (out + mulmod(v, lam, spec.p)) % spec.p
    return out


def packed_share(df: DataFrame, secrets: Sequence[str], key: Sequence[str], spec: FieldSpec, label: str = "packed") -> DataFrame:
    """A row per party for each row of k secrets: key columns, party, y. Masks are hashed once a row."""
    cols = [F.col(s) for s in secrets]
    own = df.withColumns({f"_m{k}": m for k, m in enumerate(masks(spec, label, *map(F.col, key)))})
    marks = [F.col(f"_m{k}") for k in range(spec.t)]
    rows = F.array(*(F.struct(F.lit(i).alias("party"), with_masks(cols, i, marks, spec).alias("y")) for i in spec.parties))
    return own.withColumn("_s", F.explode(rows)).select(*key, "_s.party", "_s.y")


def packed_reconstruct(shares: DataFrame, key: Sequence[str], spec: FieldSpec, parties: Sequence[int] | None = None) -> DataFrame:
    """(key, lane, secret) of each packed row, from t + k shares: one shuffle for all lanes."""
    use = list(parties or spec.parties[: spec.needed])
    lanes = [modsum(weighted(F.col("y"), F.col("party"), use, -(j + 1), spec.p), spec.p) for j in range(spec.k)]
    wide = shares.where(F.col("party").isin(use)).groupBy(*key).agg(F.array(*lanes).alias("v"))
    return wide.select(*key, F.posexplode("v").alias("lane", "secret"))


def unpack(shares: DataFrame, key: Sequence[str], spec: FieldSpec, label: str = "unpack") -> DataFrame:
    """Packed shares to plain shares of each lane, without opening: each of t + k parties re-shares
    its weighted share, and receivers add up. (key, lane, party, y). A row is summed for all lanes and receivers
    before it is spread, so one shuffle on key serves what follows too."""
    use, keys = spec.parties[: spec.needed], [F.col(k) for k in key]
    own = shares.where(F.col("party").isin(use)).withColumnRenamed("party", "sender")
    marks = {j: masks(spec, label, *keys, F.col("sender"), F.lit(j)) for j in range(spec.k)}
    own = own.withColumns({f"_m{j}_{k}": m for j, v in marks.items() for k, m in enumerate(v)} | {f"_p{j}": weighted(F.col("y"), F.col("sender"), use, -(j + 1), spec.p) for j in marks})
    cells = [(j, i) for j in marks for i in spec.parties]
    wide = own.groupBy(*key).agg(*(modsum(at_party(F.col(f"_p{j}"), i, [F.col(f"_m{j}_{k}") for k in range(spec.t)], spec.p), spec.p).alias(f"_y{j}_{i}") for j, i in cells))
    rows = F.array(*(F.struct(F.lit(j).alias("lane"), F.lit(i).alias("party"), F.col(f"_y{j}_{i}").alias("y")) for j, i in cells))
    return wide.select(*key, F.explode(rows).alias("_s")).select(*key, "_s.lane", "_s.party", "_s.y")


def pack(lanes: DataFrame, key: Sequence[str], spec: FieldSpec, label: str = "pack") -> DataFrame:
    """Plain lane shares to packed shares, without opening: party i sends target j the sum over
    lanes of L_lane(j) y, weighted to the secret, and targets add a mask that vanishes at the
    secrets. (key, party, y) of degree t + k - 1. A row is summed for all targets before it is spread."""
    points, use = [-j for j in range(1, spec.k + 1)], spec.parties[: spec.t + 1]
    own = lanes.where(F.col("party").isin(use)).withColumn("_w", weighted(F.col("y"), F.col("party"), use, 0, spec.p))
    part = {j: F.coalesce(*(F.when(F.col("lane") == m, mulmod(F.col("_w"), c, spec.p)) for m, c in enumerate(basis(points, j, spec.p)))) for j in spec.parties}
    summed = own.groupBy(*key).agg(*(modsum(v, spec.p).alias(f"_y{j}") for j, v in part.items())).withColumn("_h", element(spec.p, label, *map(F.col, key), 1))
    rows = (F.struct(F.lit(j).alias("party"), ((F.col(f"_y{j}") + mulmod(F.col("_h"), vanishing(points, j, spec.p), spec.p)) % spec.p).alias("y")) for j in spec.parties)
    return summed.select(*key, F.explode(F.array(*rows)).alias("_s")).select(*key, "_s.party", "_s.y")


def redistribute(shares: DataFrame, key: Sequence[str], senders: Sequence[int], receivers: Sequence[int], p: int) -> DataFrame:
    """New committee's shares of the same polynomial: sender i sends lambda_i(j) y_i to j, and j adds up."""
    rows = F.array(*(F.struct(F.lit(j).alias("new_party"), weighted(F.col("y"), F.col("party"), senders, j, p).alias("part")) for j in receivers))
    sent = shares.where(F.col("party").isin(list(senders))).withColumn("_r", F.explode(rows)).select(*key, "_r.new_party", "_r.part")
    return sent.groupBy(*key, "new_party").agg(modsum(F.col("part"), p).alias("y"))


def refresh(shares: DataFrame, key: Sequence[str], spec: FieldSpec, label: str = "refresh") -> DataFrame:
    """Proactive refresh: each party's zero polynomial is added to every share, so shares change and
    the secret doesn't. Every delta follows from (key, sender, receiver): no shuffle is needed."""
    y = F.col("y")
    for sender in spec.parties:
        for k in range(1, spec.t + 1):
            power = F.coalesce(*(F.when(F.col("party") == j, F.lit(pow(j, k, spec.p)).cast("long")) for j in spec.parties))
            y = (y + mulmod(element(spec.p, label, *map(F.col, key), sender, k), power, spec.p)) % spec.p
    return shares.withColumn("y", y)


def refresh_messages(keys: DataFrame, key: Sequence[str], spec: FieldSpec, label: str = "refresh") -> DataFrame:
    """What parties send each other for a refresh: (key, sender, party, part), the value of each sender's
    zero polynomial at each receiver. Masks are hashed once for all receivers."""
    sent = keys.select(*key, F.explode(F.lit(spec.parties)).alias("sender"))
    own = sent.withColumns({f"_m{k}": element(spec.p, label, *map(F.col, key), F.col("sender"), k) for k in range(1, spec.t + 1)})
    rows = F.array(*(F.struct(F.lit(j).alias("party"), at_party(F.lit(0).cast("long"), j, [F.col(f"_m{k}") for k in range(1, spec.t + 1)], spec.p).alias("part")) for j in spec.parties))
    return own.select(*key, "sender", F.explode(rows).alias("s")).select(*key, "sender", "s.party", "s.part")


def refresh_received(shares: DataFrame, messages: DataFrame, key: Sequence[str], spec: FieldSpec) -> DataFrame:
    """(key, party, y, complete): each party adds what it received to its share if exactly all parties
    sent, one value each; otherwise it keeps its share. One aggregation."""
    both = shares.select(*key, "party", "y", F.lit(None).cast("int").alias("sender"), F.lit(None).cast("long").alias("part")).unionByName(messages.select(*key, "party", F.lit(None).cast("long").alias("y"), "sender", "part"))
    exact = (F.array_sort(F.collect_set("sender")) == F.lit(spec.parties)) & (F.count("sender") == spec.n)
    own = both.groupBy(*key, "party").agg(F.max("y").alias("_y"), modsum(F.coalesce("part", F.lit(0).cast("long")), spec.p).alias("_d"), exact.alias("complete"))
    return own.select(*key, "party", F.when(F.col("complete"), (F.col("_y") + F.col("_d")) % spec.p).otherwise(F.col("_y")).alias("y"), "complete")


def reshare(shares: DataFrame, key: Sequence[str], spec: FieldSpec, old: Sequence[int], new: Sequence[int]) -> DataFrame:
    """The same committee refreshes; a changed one redistributes from the lowest t + 1 common
    members. (key, party, y)."""
    if sorted(old) == sorted(new):
        return refresh(shares, key, spec)
    both = sorted(set(old) & set(new)) or sorted(old)
    if len(both) < spec.t + 1:
        raise ValueError("too few members stay to redistribute")
    return redistribute(shares, key, both[: spec.t + 1], sorted(new), spec.p).withColumnRenamed("new_party", "party")


def own_share(secret: Column, key: Sequence[str], spec: FieldSpec, label: str) -> Column:
    """The share of the row's own party, as a column: for rows that carry a party already."""
    keys = [F.col(k) for k in key]
    return F.coalesce(*(F.when(F.col("party") == i, polynomial(secret, i, spec, label, *keys)) for i in spec.parties))
