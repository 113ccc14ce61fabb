"""Queries on odd rows, against their SQL."""

import duckdb
import pytest

from sharemill.plans.catalogue import ORACLES, QUERIES


def same(spark, folder, name, **tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = QUERIES[name](spark, str(folder))
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(plain(v) for v in r) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == want
    return want


def test_inverses_of_rows_that_share_a_key_or_have_no_value(spark, tmp_path):
    rows = [(1, 5.0), (1, 7.5), (1, 7.5), (2, 0.0), (3, None), (3, 2.0), (4, -3.25)]
    spark.createDataFrame(rows, "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    assert len(same(spark, tmp_path, "secret_inverse", customer=1)) == 7


def test_committees_list_all_members(spark, tmp_path):
    rows = [("view", k % 130) for k in range(400)] + [("buy", None), ("view", None), ("click", 7)]
    spark.createDataFrame(rows, "event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_type: r.members for r in QUERIES["committee"](spark, str(tmp_path)).collect()}
    assert got == {"view": ",".join(map(str, range(130))), "buy": None, "click": "7"}
    same(spark, tmp_path, "committee", events=1)


@pytest.mark.parametrize("name", ["committee", "he_weights", "model_commits", "secret_inverse"])
def test_whole_jobs(spark, sf, name):
    got = QUERIES[name](spark, sf).collect()
    if name == "he_weights":
        assert {(r.layer, r.j) for r in got} >= {("w1", 63), ("w2", 7), ("b1", 0), ("b2", 0)}
    elif name == "model_commits":
        labels = {r.label for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("label").distinct().collect()}
        assert got and {r.label for r in got} <= labels  # a label's commits are one chain
    elif name == "committee":
        assert all(len(r.members.split(",")) == r.n for r in got)


def test_packed_rows_are_shuffled_once(spark, sf):
    plan = QUERIES["lanes_to_packed"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
