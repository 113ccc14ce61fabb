"""The driver's contract, with and without the training-data part."""

import importlib
import sys

import pytest


def fresh():
    sys.modules.pop("__spark_entry__", None)
    return importlib.import_module("__spark_entry__")


def test_entry_has_a_stable_schema(spark):
    df = fresh().entry(spark)
    assert df.columns == ["vec_id", "class", "logit"] and df.count() > 0


def test_oracles_name_queries():
    e = fresh()
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_training_data_part(monkeypatch):
    whole = set(fresh().queries())
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("sharemill.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # as if it were deleted
    e = fresh()
    assert set(e.queries()) == {n for n in whole if n != "pipeline" and not n.startswith("op")}
    assert "pipeline" not in e.oracle_sql()
    sys.modules.pop("__spark_entry__")


@pytest.mark.parametrize("name", ["heartbeat_stream", "membership_stream", "sampler_stream"])
def test_streams_end(spark, sf, name):
    assert fresh().queries()[name](spark, sf).count() > 0
