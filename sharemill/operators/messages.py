"""Messages between parties as rows: routing, filters, payload widths, mailboxes and thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Words in an error's text that mark it as one that passes.
PASSING = "timeout|temporar|unavailable|reset by peer|connection refused"


def current_epoch(epoch: Column, now: int) -> Column:
    """Messages without an epoch pass, others only in theirs."""
    return epoch.isNull() | (epoch == now)


def active_peer(party: Column, active: Sequence[int], me: int) -> Column:
    return party.isin(list(active)) & (party != me)


def transient(kind: Column, text: Column) -> Column:
    """An error that is worth another try: by its type, or by words of its text."""
    return F.coalesce(kind.isin("timeout", "connection"), F.lit(False)) | F.coalesce(F.lower(text).rlike(PASSING), F.lit(False))


def pair_rows(df: DataFrame, keep: Sequence[str], left: str, right: str) -> DataFrame:
    """(keep, name, v, width): the two vectors of one message apart. Both travel as 4-byte integers if
    all fit, else both as 8."""
    wide = F.array_max(F.concat(left, right)) > 4294967295
    parts = F.array(F.struct(F.lit("d").alias("name"), F.col(left).alias("v")), F.struct(F.lit("e").alias("name"), F.col(right).alias("v")))
    return df.select(*keep, F.explode(parts).alias("p"), F.when(wide, 8).otherwise(4).alias("width")).select(*keep, "p.name", "p.v", "width")


def framed(header: Column, payload_bytes: Column) -> Column:
    """Bytes of a message: a length of 4, the header's text, the payload."""
    return F.octet_length(header) + payload_bytes + 4


def mailbox(messages: DataFrame, context: str, sender: str, order: str) -> DataFrame:
    """(context, appended, senders): shares are appended as they come, repeats too; a reader takes the
    first of each sender."""
    return messages.groupBy(context).agg(F.count("*").alias("appended"), F.countDistinct(sender).alias("senders"), F.min(order).alias("first"))


def first_of_each(messages: DataFrame, context: str, sender: str, order: str) -> DataFrame:
    w = Window.partitionBy(context, sender).orderBy(order)
    return messages.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def enough(messages: DataFrame, context: str, sender: str, least: int) -> DataFrame:
    """(context, parties, ready): contexts are ready once so many different senders came."""
    return messages.groupBy(context).agg(F.countDistinct(sender).alias("parties")).withColumn("ready", F.col("parties") >= least)
