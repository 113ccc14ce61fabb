"""Folds over events that arrive out of order: rows wait in state until the watermark has passed them, and
are then folded in the order of event time. Keys are dealt into buckets by a hash; a bucket's rows are
folded together, so what a call of Python and a visit to the state cost is shared by all of its keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Kinds of the rows that only move time on, one of which ends a replay.
TICK = "tick"
#: Buckets of keys if a caller doesn't say, and microseconds of event time whose rows are one entry of state.
BUCKETS, SLICE_US = 64, 86_400_000_000
#: The bucket of rows without a key, which are one key.
NO_KEY = -1
ROWS = pa.schema([("key", pa.int64()), ("us", pa.int64()), ("id", pa.int64()), ("kind", pa.string()), ("value", pa.string())])


def packed(rows: pd.DataFrame) -> bytes:
    """Rows of ROWS as an Arrow stream."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, ROWS) as to:
        to.write_table(pa.Table.from_pandas(rows[ROWS.names], ROWS, preserve_index=False))
    return out.getvalue().to_pybytes()


def unpacked(parts: list[bytes]) -> pd.DataFrame:
    tables = [pa.ipc.open_stream(bytes(p)).read_all() for p in parts]
    return pa.concat_tables(tables or [ROWS.empty_table()]).to_pandas()


class InOrder(StatefulProcessor):
    """Holds rows (key, us, id, kind, value) of a bucket, in slices of event time, until the watermark passes
    them, then gives them to fold() by (key, us, id). A row that comes again while it is held counts
    once. A timer wakes the bucket for its first row that is held."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "slice long", "first long, rows binary")
        self.start(handle)

    def start(self, handle: StatefulProcessorHandle) -> None:
        """The fold's own state."""

    def fold(self, bucket: int, rows: pd.DataFrame, now: int) -> tuple[pd.DataFrame, int | None]:
        """What the rows bring about, and time alone up to now (us), once the watermark has reached it; and
        when (us) time alone brings about more, if no row comes before."""
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        new = pd.concat(list(rows), ignore_index=True)
        yield from self.released(key[0], new[new["kind"] != TICK], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield from self.released(key[0], None, timerValues.getCurrentWatermarkInMs())

    def released(self, bucket: int, new: pd.DataFrame | None, watermark: int) -> Iterator[pd.DataFrame]:
        now, slices, wake = watermark * 1000, {}, []
        if new is not None and len(new):
            slices = {int(k): [packed(part)] for k, part in new.groupby(new["us"] // SLICE_US)}
        due = []
        for (k,), (first, raw) in list(self.held.iterator()):
            if first < now or k in slices:
                slices.setdefault(int(k), []).insert(0, raw)
            else:
                wake.append(first)
        for k, parts in slices.items():
            own = unpacked(parts).drop_duplicates(["key", "us", "id"], keep="last")
            past = own["us"] < now
            due.append(own[past])
            if past.all():
                self.held.removeKey((k,))
            else:
                rest = own[~past]
                wake.append(int(rest["us"].min()))
                self.held.updateValue((k,), (wake[-1], packed(rest)))
        rows = pd.concat(due) if due else unpacked([])
        out, later = self.fold(bucket, rows.sort_values(["key", "us", "id"], ignore_index=True), now)
        wake += [later] if later is not None else []
        if wake:
            self.handle.registerTimer(min(wake) // 1000 + 1)
        if len(out):
            yield out

    def close(self) -> None:
        pass


def starts_of(keys: np.ndarray) -> np.ndarray:
    """For rows that lie together by key: the place of each row's first of its key."""
    first = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    return np.flatnonzero(first)[np.cumsum(first) - 1]


class Membership(InOrder):
    """Whether a node is active: a row for each event with what it changes (-1, 0 or 1). A node that
    isn't active takes no state."""

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.active = handle.getValueState("active", "nodes binary")

    def fold(self, bucket, rows, now):
        none = np.zeros(0, np.int64)
        if not len(rows):
            return pd.DataFrame(), None
        held = np.frombuffer(bytes(self.active.get()[0]), np.int64) if self.active.exists() else none
        node, at = rows["key"].to_numpy(), np.arange(len(rows))
        state = rows["kind"].map({"join": 1, "drop": 0}).fillna(-1).to_numpy(np.int64)
        begin = starts_of(node)
        decided = np.maximum.accumulate(np.where(state >= 0, at, -1))  # the last join or drop so far
        before = np.r_[-1, decided[:-1]]
        was = np.where(before >= begin, state[before], np.isin(node, held))
        after = np.where(state >= 0, state, was)
        last = np.r_[begin[1:] != begin[:-1], True]
        nodes = np.union1d(np.setdiff1d(held, node), node[last & (after == 1)])
        if len(nodes):
            self.active.update((nodes.tobytes(),))
        elif len(held):
            self.active.clear()
        return pd.DataFrame({"event_id": rows["id"], "us": rows["us"], "kind": rows["kind"], "delta": (after - was).astype(np.int32)}), None


class Mailbox(InOrder):
    """Values by sender, of which the last wins, until they are taken: a take reads all that its context
    holds, once. What waits longer than `hold` after the context's last event is evicted."""

    def __init__(self, hold_us: int):
        self.hold = hold_us

    def start(self, handle: StatefulProcessorHandle) -> None:
        self.box = handle.getValueState("box", "rows binary")

    def fold(self, bucket, rows, now):
        held = unpacked([self.box.get()[0]] if self.box.exists() else [])
        # what a box holds comes before all new rows of its context
        rows = pd.concat([held.assign(old=True), rows.assign(old=False)]).sort_values(["key", "us", "id"], ignore_index=True)
        if not len(rows):
            return rows, None
        key, us, take, old = rows["key"].to_numpy(), rows["us"].to_numpy(), (rows["kind"] == "take").to_numpy(bool), rows["old"].to_numpy(bool)
        first, latest = np.r_[True, key[1:] != key[:-1]], np.r_[key[1:] != key[:-1], True]
        taken, silent = np.r_[False, take[:-1]], np.r_[False, us[1:] > us[:-1] + self.hold]
        box = np.cumsum(first | ~old & (taken | silent))
        # the last box of a context stays if it is neither taken nor past its time
        stay = latest & ~take & (us + self.hold >= now)
        puts = rows.assign(box=box)[~take].drop_duplicates(["box", "kind"], keep="last")
        stays = puts["box"].isin(box[stay])
        if stays.any():
            self.box.update((packed(puts[stays]),))
        elif len(held):
            self.box.clear()
        gone = puts[~stays]
        by = pd.Series(rows["id"].to_numpy()[take], box[take], "Int64").reindex(gone["box"])  # a take ends its box
        context = pd.array([None] * len(gone), "Int64") if bucket == NO_KEY else gone["key"].to_numpy()
        out = {"context": context, "sender": gone["kind"].array, "id": gone["id"].array, "value": gone["value"].array, "how": np.where(by.isna(), "evicted", "taken"), "taken_by": by.array}
        return pd.DataFrame(out), int(us[stay].min()) + self.hold if stay.any() else None


def rows_of(stream: DataFrame, key: str, ts: str, id_: str, kind: Column, value: Column, delay: str, buckets: int) -> DataFrame:
    """The columns that the folds take, with a watermark behind the latest time by delay."""
    own = stream.select(F.col(key).cast("long").alias("_key"), F.col(ts).cast("timestamp").alias("ts"), F.col(id_).cast("long").alias("id"), kind.alias("kind"), value.cast("string").alias("value"))
    own = own.where("kind is not null and ts is not null").withColumn("us", F.unix_micros("ts")).withWatermark("ts", delay)
    own = own.withColumn("bucket", F.when(F.col("_key").isNull(), NO_KEY).otherwise(F.pmod(F.xxhash64("_key"), F.lit(buckets))))
    return own.withColumn("key", F.coalesce("_key", F.lit(0))).drop("_key")


def membership(stream: DataFrame, ts: str, id_: str, node: str, kind: Column, delay: str, buckets: int = BUCKETS) -> DataFrame:
    """(event_id, us, kind, delta) of each join, drop and reshare_complete, in any order of arrival within
    delay: the state is a node's own, so buckets of nodes are folded side by side. Running numbers of all
    nodes follow from the deltas (operators.membership.totals)."""
    own = rows_of(stream, node, ts, id_, kind, F.lit(None), delay, buckets)
    return own.groupBy("bucket").transformWithStateInPandas(Membership(), "event_id long, us long, kind string, delta int", "append", "eventTime")


def mailbox(stream: DataFrame, ts: str, id_: str, context: str, kind: Column, value: Column, delay: str, hold_hours: int, buckets: int = BUCKETS) -> DataFrame:
    """(context, sender, id, value, how, taken_by): what takes read and what was evicted. kind is take, or a
    sender's name for what it puts."""
    own = rows_of(stream, context, ts, id_, kind, value, delay, buckets)
    return own.groupBy("bucket").transformWithStateInPandas(Mailbox(hold_hours * 3_600_000_000), "context long, sender string, id long, value string, how string, taken_by long", "append", "eventTime")
