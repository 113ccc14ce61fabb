"""Shares through a chain of committees: what each change does to a vector of shares is a matrix, and the
product of all changes so far is found by a scan over spans of the log. Rows that ask for shares go to
the span of their moment, so that matrices stay where they are made."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import limbs
from ..functions.lagrange import basis
from ..spec import FieldSpec
from ..streaming.streams import shared_dir
from . import membership

JOIN, DROP = "join", "drop"
#: Events aimed at in a span, rows that ask one copy of it at most on average, and rows multiplied at a time.
SPAN_ROWS, ASKED_ROWS, ROWS_AT_ONCE = 1 << 14, 1 << 16, 1 << 9


@functools.lru_cache(1 << 12)
def _weights(senders: tuple[int, ...], spec: FieldSpec) -> np.ndarray:
    """A row for each party: what the senders' shares count in its own."""
    return np.array([basis(senders, j, spec.p) for j in spec.parties], np.uint64)


def members(mask: int, n: int) -> list[int]:
    return [i for i in range(1, n + 1) if mask >> (i - 1) & 1]


def changed(total: np.ndarray, old: int, new: int, spec: FieldSpec, fallback: bool = False) -> np.ndarray:
    """The product `total` after one more change, from committee `old` to `new` (masks): the lowest t + 1
    members who stay send their weighted shares. Fewer of them are an error, as the secrets are lost then,
    or the lowest of those who left send what they kept. Who isn't in the new committee keeps its row."""
    senders = members(old & new, spec.n)[: spec.t + 1]
    if len(senders) <= spec.t:
        if not fallback:
            raise ValueError(f"members {senders} are too few to pass shares on")
        senders = sorted([*senders, *(i for i in spec.parties if i not in senders)][: spec.t + 1])
    at = [i - 1 for i in members(new, spec.n)]
    out = total.copy()
    if at:
        out[at] = limbs.matmul(_weights(tuple(senders), spec)[at], total[[i - 1 for i in senders]], spec.p)
    return out


def products(events: DataFrame, ts: str, order: str, party: str, kind: str, spec: FieldSpec, fallback: bool = False) -> DataFrame:
    """events of parties 1..n (n up to 62; all are members at first), of which joins and drops count ->
    (order, span, place, was, mask, fallback, m binary): an event's place in its span of about SPAN_ROWS events, the
    committee before and after it, and in a span's last row the product of its changes. Later spans start where
    earlier ones end: first by masks of who comes and goes, of which the driver scans two numbers a span."""
    if spec.n > 62:
        raise ValueError("a committee is a mask of up to 62 members")
    counts = F.col(party).between(1, spec.n)
    sign = F.when(counts & (F.col(kind) == JOIN), 1).when(counts & (F.col(kind) == DROP), -1).otherwise(0).cast("int")
    span = membership.spans(events, ts, min(membership.SPAN_ROWS, SPAN_ROWS))
    own = events.select(F.col(order).cast("long").alias("id"), F.col(ts).alias("ts"), F.col(party).cast("int").alias("party"), sign.alias("kind"), span.alias("span"))
    # the last word on each party within a span
    last = own.where("kind <> 0").groupBy("span", "party").agg(F.max_by("kind", F.struct("ts", "id")).alias("kind"))
    bit = F.expr("shiftleft(1L, party - 1)")
    ops = last.groupBy("span").agg(*(F.sum(F.when(F.col("kind") == k, bit).otherwise(0)).alias(n) for k, n in ((1, "come"), (-1, "go"))))
    every = own.select("span").distinct().join(ops, "span", "left").select("span", F.coalesce("come", F.lit(0)), F.coalesce("go", F.lit(0)))
    mask, entry = (1 << spec.n) - 1, {}
    for number, come, go in sorted(tuple(r) for r in every.collect()):  # MOST_SPANS rows at most
        entry[number] = mask
        mask = (mask | come) & ~go

    def fold(t: pa.Table) -> pa.Table:
        t = t.sort_by([("ts", "ascending"), ("id", "ascending")])
        at, total, masks = entry[t.column("span")[0].as_py()], np.eye(spec.n, dtype=np.uint64), []
        masks.append(at)
        for p, k in zip(t.column("party").to_pylist(), t.column("kind").to_pylist(), strict=True):
            new = at | 1 << (p - 1) if k > 0 else at & ~(1 << (p - 1)) if k < 0 else at
            if new != at:
                total, at = changed(total, at, new, spec, fallback), new
            masks.append(at)
        n = t.num_rows
        return pa.table({
            "id": t.column("id"), "span": t.column("span"), "place": pa.array(range(n), pa.int32()), "was": pa.array(masks[:-1], pa.int64()), "mask": pa.array(masks[1:], pa.int64()),
            "fallback": pa.array([fallback] * n), "m": pa.array([*[None] * (n - 1), total.tobytes()], pa.binary()),
        })

    return own.groupBy("span").applyInArrow(fold, "id long, span int, place int, was long, mask long, fallback boolean, m binary").withColumnRenamed("id", order)


def scanned(found: DataFrame, spec: FieldSpec) -> DataFrame:
    """products() with the committee array<int> after each event and, in a span's first row, `before`: the product
    of all changes until then. The spans' own products, a matrix each and MOST_SPANS at most, are multiplied
    up by one group. Events are stored, so that each is folded once for that."""
    spark, path = found.sparkSession, f"{shared_dir(found.sparkSession).rstrip('/')}/chain-{uuid.uuid4().hex}"
    found.write.parquet(path)
    found = spark.read.schema(found.schema).parquet(path)

    def up(t: pa.Table) -> pa.Table:
        t = t.sort_by("s")
        total, before = np.eye(spec.n, dtype=np.uint64), []
        for m in t.column("m").to_pylist():
            before.append(total.tobytes())
            total = limbs.matmul(np.frombuffer(m, np.uint64).reshape(spec.n, -1), total, spec.p)
        return pa.table({"s": t.column("s"), "before": pa.array(before, pa.binary())})

    starts = found.where("m is not null").select(F.col("span").alias("s"), "m").groupBy().applyInArrow(up, "s int, before binary")
    own = found.drop("m").join(F.broadcast(starts), (F.col("span") == F.col("s")) & (F.col("place") == 0), "left").drop("s")
    bits = F.array_compact(F.array(*(F.when(F.shiftright("mask", i - 1).bitwiseAND(F.lit(1).cast("long")) == 1, i) for i in spec.parties)))
    return own.withColumn("committee", bits)


def located(asked: DataFrame, chain: DataFrame, on: str) -> DataFrame:
    """asked with (at_span, at_place): where its event `on` lies in the chain. Rows without an event are left out."""
    return asked.join(chain.select(on, F.col("span").alias("at_span"), F.col("place").alias("at_place")), on)


def moved(first: DataFrame, key: Sequence[str], chain: DataFrame, on: str, spec: FieldSpec) -> DataFrame:
    """first(key, on, shares array<long> of parties 1..n) -> (key, on, party, y): the shares of the
    committee after the event `on`. Rows meet their span, which goes through its changes once more from
    `before`; a span that many rows ask has copies, between which its rows are dealt. first may be located()."""
    names = [*key, on]
    own = first if {"at_span", "at_place"} <= set(first.columns) else located(first, chain, on)
    spans = chain.where("place = 0").count()
    copies = max(1, -(-first.count() // (ASKED_ROWS * max(1, spans))))
    own = own.withColumn("copy", F.pmod(F.xxhash64(*names), F.lit(copies)).cast("int")).select("at_span", "copy", "at_place", "shares", *names)
    states = chain.where("place = 0 or was <> mask").select("span", "place", "was", "mask", "fallback", "before")
    states = states.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))

    def run(state: pa.Table, asked: pa.Table) -> pa.Table:
        asked, state = asked.sort_by("at_place"), state.sort_by("place")
        n = asked.num_rows
        masks, y = np.zeros(n, np.int64), np.zeros((n, spec.n), np.uint64)
        if n and state.num_rows:
            y0 = asked.column("shares").combine_chunks().flatten().to_numpy().reshape(n, spec.n).astype(np.uint64)
            ends = [*np.searchsorted(asked.column("at_place").to_numpy(), state.column("place").to_numpy()[1:]).tolist(), n]
            at, done, totals = 0, 0, []
            total = np.frombuffer(state.column("before")[0].as_py(), np.uint64).reshape(spec.n, -1)
            fallback = state.column("fallback")[0].as_py()
            for was, mask, end in zip(state.column("was").to_pylist(), state.column("mask").to_pylist(), ends, strict=True):
                if was != mask:
                    total = changed(total, was, mask, spec, fallback)
                masks[at:end] = mask
                while at < end:
                    more = min(end - at, ROWS_AT_ONCE - len(totals))
                    totals += [total] * more
                    at += more
                    if len(totals) == ROWS_AT_ONCE or at == n:
                        y[done:at] = limbs.matmul(np.stack(totals), y0[done:at, :, None], spec.p)[..., 0]
                        done, totals = at, []
        row, party = np.nonzero(masks[:, None] >> np.arange(spec.n) & 1)
        out = asked.select(names).take(pa.array(row))
        return out.append_column("party", pa.array(party + 1, pa.int32())).append_column("y", pa.array(y[row, party].astype(np.int64)))

    schema = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in names) + ", party int, y long"
    return states.groupBy("span", "copy").cogroup(own.groupBy("at_span", "copy")).applyInArrow(run, schema)
