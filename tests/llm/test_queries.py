import os
import re

import duckdb
import pytest
from edge import empty, frame

from sharemill.llm import mixing, queries

COLUMNS = {
    2: "doc_id fingerprint component_id",
    3: "doc_id held_out n_tokens n_known train_tokens base_score score",
    4: "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    6: "doc_id size text_crc32 law shard slot grown_shard",
    7: "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    8: "doc_id held_out score predicted",
    9: "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    10: "doc_id n_assign n_access n_hex base_sha256 spans",
    11: "doc_id leaf subroot root proof_sha256 folded_root verified",
    12: "vec_id n_links component_id kept",
    13: "vec_id component n deviation whitened explained identity_error",
}


def test_one_query_for_each_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("n", sorted(COLUMNS))
def test_columns_come_first(spark, sf, n):
    (query,) = (q for name, q in queries.QUERIES.items() if name.startswith(f"op{n}_"))
    want = COLUMNS[n].split()
    assert query(spark, sf).columns[: len(want)] == want


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf, t + '.parquet')}')")
    cur = con.execute(queries.ORACLES[name])
    names = [d[0] for d in cur.description]
    plain = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    want = sorted(tuple(map(plain, r)) for r in cur.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in queries.QUERIES[name](spark, sf).collect()) == want


def test_mixing_edges(spark):
    df = frame(spark)
    got = mixing.documents_mixed(df).collect()
    assert len(got) == df.count() and all(0 <= r.probability <= 1 for r in got)
    repeated = [(r.probability, r.kept) for r in got if r.doc_id == 6]
    assert len(repeated) == 2 and len(set(repeated)) == 1
    assert mixing.documents_mixed(empty(spark)).count() == 0
    clash = mixing.mix(df.selectExpr("doc_id", "source", "lang", "'t' as topic", "5L as n_tokens", "kept", "1 as probability"))
    assert sorted(clash.columns) == sorted(["doc_id", "source", "lang", "topic", "n_tokens", "probability", "kept"]) and clash.count() == df.count()
