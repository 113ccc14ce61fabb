"""Streams over several micro-batches against their batch twins and plain loops."""

import datetime

from pyspark.sql import functions as F

from sharemill.plans.catalogue import QUERIES
from sharemill.streaming import folds, streams

DAY = datetime.timedelta(days=1)
START = datetime.datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")


def some(n=240, seed=4):
    import random

    r = random.Random(seed)
    return [(k, START + datetime.timedelta(hours=3 * k, minutes=r.randrange(170)), r.randrange(6), r.choice(["signup", "error", "purchase", "view"]), float(r.randrange(100))) for k in range(n)]


def test_replays_have_a_micro_batch_for_each_file(spark):
    rows = some()
    for mixed in (False, True):
        stream, late = streams.replayed(events(spark, rows), "ts", mixed=mixed)
        assert (int(late.split()[0]) > 86_400) == mixed
        got = streams.run(stream.groupBy("user_id").agg(F.count("*").alias("n")), "counted", "complete").collect()
        assert sum(r.n for r in got) == len(rows)
        batches = [n for n, _ in streams.PROGRESS["counted"] if n]
        assert len(batches) == streams.FILES and sum(batches) == len(rows)


def loop(rows):
    """n_active, paused and epoch after each event, one after the other."""
    active, paused, epoch, out = set(), 0, 0, {}
    for i, _, user, kind, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        if kind == "signup":
            active.add(user)
            epoch += 1
        elif kind == "error":
            active.discard(user)
            paused = 1
        elif kind == "purchase":
            paused = 0
        else:
            continue
        out[i] = (len(active), paused, epoch)
    return out


def written(spark, rows, folder):
    events(spark, rows).write.parquet(f"{folder}/events.parquet")
    return str(folder)


def test_membership_is_folded_in_order_from_files_out_of_order(spark, tmp_path):
    rows = some()
    got = QUERIES["membership_fold_stream"](spark, written(spark, rows, tmp_path)).collect()
    assert {r.event_id: (r.n_active, r.paused, r.epoch) for r in got} == loop(rows)
    progress = streams.PROGRESS["membership_fold"]
    assert sum(n > 0 for n, _ in progress) == streams.FILES + 1 and max(s for _, s in progress) > 10


def test_nodes_that_are_not_active_keep_no_state(spark):
    rows = [(k, START + k * DAY, k % 3, "signup", 0.0) for k in range(9)] + [(9 + k, START + (20 + k) * DAY, k, "error", 0.0) for k in range(3)]
    end = {"event_id": -1, "ts": "2100-01-01", "user_id": -1, "event_type": folds.TICK}
    stream, late = streams.replayed(events(spark, rows), "ts", mixed=True, end=end)
    kind = F.when(F.col("event_type") == "signup", "join").when(F.col("event_type") == "error", "drop").otherwise(F.col("event_type"))
    got = streams.run(folds.membership(stream, "ts", "event_id", "user_id", kind, late), "dropped").collect()
    assert sorted((r.event_id, r.delta) for r in got) == [(k, int(k < 3)) for k in range(9)] + [(9 + k, -1) for k in range(3)]
    assert streams.PROGRESS["dropped"][-1][1] == 0 < max(s for _, s in streams.PROGRESS["dropped"])


def boxes(rows, hold):
    out, box, last = [], {}, {}

    def emptied(user, how, by):
        out.extend((user, sender, i, v, how, by) for sender, (i, v) in sorted(box.pop(user, {}).items()))
        last.pop(user, None)

    for i, ts, user, kind, value in sorted(rows, key=lambda r: (r[1], r[0])):
        if user in last and ts > last[user] + hold:
            emptied(user, "evicted", None)
        if kind == "purchase":
            emptied(user, "taken", i)
        else:
            box.setdefault(user, {})[kind] = (i, value)
            last[user] = ts
    for user in list(last):
        emptied(user, "evicted", None)
    return out


def test_mailbox_is_taken_once_and_evicted_by_time(spark, tmp_path):
    rows = some(seed=9)
    got = QUERIES["mailbox_stream"](spark, written(spark, rows, tmp_path)).collect()
    want = boxes(rows, DAY)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {w[4] for w in want} == {"taken", "evicted"}
    progress = streams.PROGRESS["mailbox"]
    assert progress[-1][1] == 0 < max(s for _, s in progress) and sum(n > 0 for n, _ in progress) == streams.FILES + 1


def test_empty_streams(spark, tmp_path):
    folder = written(spark, [], tmp_path)
    for name in ("membership_fold_stream", "mailbox_stream", "failure_stream"):
        assert QUERIES[name](spark, folder).count() == 0
