import numpy as np
import pytest

from sharemill.llm import vector_graph

SCHEMA = "vec_id long, embedding array<float>, label int, node long, n int, shard string, kept string"


def brute(rows):
    """(vec_id, n_links, component_id) by all pairs."""
    fine = [k for k, (_, v) in enumerate(rows) if v and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    width = max((len(rows[k][1]) for k in fine), default=0)
    x = np.array([list(map(float, rows[k][1])) + [0.0] * (width - len(rows[k][1])) for k in fine], np.float64).reshape(len(fine), width)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    hit = x @ x.T >= vector_graph.LINK
    np.fill_diagonal(hit, False)
    label = np.arange(len(fine))
    while True:
        new = np.array([min([label[k], *label[hit[k]]]) for k in range(len(fine))], int)
        if (new == label).all():
            break
        label = new
    out = {k: (i, 0, i) for k, (i, _) in enumerate(rows)}
    for a, k in enumerate(fine):
        ids = [rows[fine[b]][0] for b in np.flatnonzero(label == label[a]) if rows[fine[b]][0] is not None]
        out[k] = (rows[k][0], int(hit[a].sum()), min(ids, default=None))
    return [(*t, t[0] == t[2]) for t in out.values()]


def run(spark, rows):
    df = spark.createDataFrame([(i, v, 1, 2, 3, "s", "k") for i, v in rows], SCHEMA)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, vector_graph.near_duplicates(df).collect()), key=key) == sorted(brute([(i, v) for i, v in rows]), key=key)


def cast(x):
    return [float(np.float32(c)) for c in x]


@pytest.fixture(scope="module")
def planted():
    r = np.random.default_rng(3)
    rows = [r.normal(size=16) for _ in range(500)]
    for k in range(40):
        rows += [rows[k] + r.normal(size=16) * 0.05 * (1 + k % 6) for _ in range(1 + k % 5)]
    rows += [rows[0] * 3.0, rows[0], rows[0], rows[1] * 0.5]
    rows += [rows[7] + r.normal(size=16) * 0.1 for _ in range(300)]  # a third are near copies of one
    rows += [rows[9]] * 200  # and many are copies
    chain = rows[11]
    for _ in range(12):  # a chain whose ends aren't alike
        chain = chain + r.normal(size=16) * 0.2
        rows.append(chain)
    order = r.permutation(len(rows))
    return [(int(i), cast(rows[k])) for i, k in enumerate(order)]


def test_all_links_of_planted_groups(spark, planted):
    run(spark, planted)


def test_small_shards_are_split_and_searches_cross_them(spark, planted, monkeypatch):
    monkeypatch.setattr(vector_graph, "AIM", 64)
    monkeypatch.setattr(vector_graph, "LIMIT", 96)
    monkeypatch.setattr(vector_graph, "ASKS", 50)
    run(spark, planted)


def test_a_shard_that_no_centroid_parts_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "LIMIT", 40)
    r = np.random.default_rng(5)
    base = r.normal(size=8)
    run(spark, [(k, cast(base + r.normal(size=8) * 1e-3)) for k in range(150)])


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0, 0.0]), (1, [2.0, 0.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0, 0.0]), (5, [nan, 1.0, 0.0]), (6, [inf, 0.0, 0.0]), (7, [None, 1.0, 0.0]),
        (8, [1.0]), (None, [1.0, 0.0, 0.0]), (9, [0.0, 1.0, 0.0]), (9, [0.0, 1.0, 0.01]), (10, [1.0, 0.1, 0.0]), (10, [1.0, 0.1, 0.0]), (11, [-1.0, 0.0, 0.0]), (12, [1e-30, 0.0, 0.0]), (13, [1e30, 1e29, 0.0]),
    ]
    run(spark, [(i, v if v is None else [c if c is None else float(np.float32(c)) for c in v]) for i, v in rows])
    run(spark, [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None)])
    run(spark, [])


def test_graph_finds_all_near_ones():
    r = np.random.default_rng(1)
    x = r.normal(size=(3000, 32))
    x[:600] = x[0] + r.normal(size=(600, 32)) * 0.15
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = vector_graph.Graph(x).build()
    ids, cos = g.search(g.x, np.full((len(x), 1), g.medoid, np.int32), vector_graph.FLOOR)
    true = (x @ x.T >= vector_graph.LINK).sum()
    assert (cos >= vector_graph.LINK).sum() >= 0.98 * true
    found = [set(i[c >= vector_graph.LINK].tolist()) for i, c in zip(ids, cos, strict=True)]
    assert all(len(f) == (c >= vector_graph.LINK).sum() for f, c in zip(found, cos, strict=True))  # no node twice


def test_audit_sees_what_is_missing(spark, planted):
    df = spark.createDataFrame([(i, v) for i, v in planted], "vec_id long, embedding array<float>")
    _, classes = vector_graph.directions(df, "vec_id", "embedding")
    none = spark.createDataFrame([], "node long, links long")
    assert vector_graph.audited(classes, none, 1 << 20) == 0.0
    counts, _ = vector_graph.links(vector_graph.united(vector_graph.sharded(classes, 2)))
    assert vector_graph.audited(classes, counts, 1 << 20) >= 0.99
