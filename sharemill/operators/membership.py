"""Committees, failure detection, membership states and barriers over event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def committee(ids: Column) -> Column:
    """Ascending, each once."""
    return F.array_sort(F.array_distinct(ids))


def active_or_all(ids: Column, n: int, least: int = 1) -> Column:
    """The ids in order, or 1..n where there are fewer than `least`."""
    return F.when(F.size(ids) < least, F.sequence(F.lit(1), F.lit(n))).otherwise(committee(ids))


def placed(members: DataFrame, committee: str, member: str, width: int = 4096) -> DataFrame:
    """(committee, member, place from 1): members once each, ascending. Ids are dealt into ranges of a
    fixed width; a range starts after the number of members in those before it."""
    own = members.select(committee, member).distinct().withColumn("_r", F.floor(F.col(member) / width))
    n = own.groupBy(committee, "_r").count()
    before = n.select(committee, "_r", (F.sum("count").over(Window.partitionBy(committee).orderBy("_r")) - F.col("count")).alias("_n"))
    rank = F.row_number().over(Window.partitionBy(committee, "_r").orderBy(member))
    return own.withColumn("_k", rank).join(before, [committee, "_r"]).select(committee, member, (F.col("_k") + F.col("_n")).alias("place"))


#: Rows aimed at in a span of time, and spans at most.
SPAN_ROWS, MOST_SPANS = 1 << 20, 1 << 14


def spans(df: DataFrame, ts: str, aim: int | None = None) -> Column:
    """A number that rises with ts and splits the rows into about even parts: how many of some quantiles
    of ts lie at or below it. Rows of one instant share a span; nulls come first. aim: rows of a span, if
    not SPAN_ROWS."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    n = min(MOST_SPANS, -(-df.count() // (aim or SPAN_ROWS)))
    found = df.agg(F.percentile_approx(us, [k / n for k in range(1, n)], 4 * n)).first()[0] if n > 1 else None
    cuts = sorted(set(found or []))
    if not cuts:
        return F.lit(0)
    steps, at = F.lit([1 << b for b in reversed(range(len(cuts).bit_length()))]), F.lit(cuts).cast("array<bigint>")
    lower = lambda k, step: F.when((k + step <= len(cuts)) & (F.get(at, k + step - 1) <= us), k + step).otherwise(k)
    return F.aggregate(steps, F.lit(0), lower)


def running_total(df: DataFrame, value: str, span: Column, order: Sequence[str | Column], out: str) -> DataFrame:
    """A running sum over all rows without one task for all: rows are summed within spans of the
    order, and spans start from the sum of those before. Spans are MOST_SPANS at most, and their sums
    are the only rows that meet."""
    own = df.withColumn("_span", span)
    sums = own.groupBy("_span").agg(F.sum(value).alias("_sum"))
    starts = sums.select("_span", F.coalesce(F.sum("_sum").over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    within = F.sum(value).over(Window.partitionBy("_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    joined = own.withColumn("_in", within).join(starts, "_span")
    return joined.withColumn(out, F.col("_in") + F.col("_start")).drop("_span", "_in", "_start")


def failures(beats: DataFrame, node: str, ts: str, timeout_hours: int, end: Column | None = None, grace_end: Column | None = None) -> DataFrame:
    """(node, failed_at, recovered_at): silences longer than the timeout; recovered_at is null for
    nodes that were still silent at the end of the log. Nothing fails before grace_end: who is silent
    then, and long enough, fails at its end."""
    w = Window.partitionBy(node).orderBy(ts)
    gap = F.expr(f"INTERVAL {timeout_hours} HOURS")
    rows = beats.select(node, ts, F.lead(ts).over(w).alias("next"))
    if end is None:
        end = F.lit(beats.agg(F.max(ts)).first()[0]).cast("timestamp_ntz")
    failed = F.col(ts) + gap if grace_end is None else F.greatest(F.col(ts) + gap, grace_end)
    late = F.coalesce(F.col("next"), end) > failed
    return rows.where(late).select(node, failed.alias("failed_at"), F.col("next").alias("recovered_at"))


def timeline(events: DataFrame, ts: str, order: str, node: str, kind: str) -> DataFrame:
    """events of kind join, drop or reshare_complete -> adds n_active, paused and epoch after each.

    A node is active after its last join unless it dropped since; a drop pauses, a completed
    reshare resumes; epochs count joins. Each is a per-node or running sum, by spans of time."""
    mine = Window.partitionBy(node).orderBy(ts, order)
    state = F.when(F.col(kind) == "join", 1).when(F.col(kind) == "drop", 0)
    was = F.coalesce(F.last(state, ignorenulls=True).over(mine.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = events.withColumn("_delta", F.coalesce(state, was) - was)
    return totals(own, ts, order, kind, "_delta").drop("_delta")


def totals(events: DataFrame, ts: str, order: str, kind: str, delta: str) -> DataFrame:
    """Adds n_active, paused and epoch after each event, from what it changes."""
    span = spans(events, ts)
    own = events.withColumn("_join", (F.col(kind) == "join").cast("int"))
    own = running_total(own, delta, span, [ts, order], "n_active")
    own = running_total(own, "_join", span, [ts, order], "epoch")
    sign = F.when(F.col(kind) == "drop", 1).when(F.col(kind) == "reshare_complete", 0)
    return carried(own, sign, span, [ts, order], "paused", 0).drop("_join")


def carried(df: DataFrame, value: Column, span: Column, order: Sequence[str], out: str, first: int | None) -> DataFrame:
    """The last non-null value so far, over all rows, by spans like running_total()."""
    own = df.withColumn("_span", span).withColumn("_v", value)
    at = F.struct(*order)
    ends = own.where("_v is not null").groupBy("_span").agg(F.max_by("_v", at).alias("_end"))
    days = own.select("_span").distinct().join(ends, "_span", "left")
    starts = days.select("_span", F.coalesce(F.last("_end", ignorenulls=True).over(Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(first)).alias("_start"))
    within = F.last("_v", ignorenulls=True).over(Window.partitionBy("_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("_in", within).join(starts, "_span").withColumn(out, F.coalesce("_in", "_start")).drop("_span", "_v", "_in", "_start")


def barriers(messages: DataFrame, tag: str, sender: str, expected: Sequence[str]) -> DataFrame:
    """(tag, got, passed): whether every expected sender came."""
    got = messages.groupBy(tag).agg(F.array_sort(F.collect_set(sender)).alias("got"))
    return got.select(tag, F.array_join("got", ",").alias("got"), (F.size(F.array_except(F.lit(list(expected)), "got")) == 0).alias("passed"))
