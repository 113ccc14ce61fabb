import math
import zlib
from collections import Counter

import numpy as np
import pytest
from edge import empty, frame

from sharemill.llm import hpy_lm as H


def base(rows):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    toks = [(r.doc_id, [*(r.text or "").encode().lower().split(), b""]) for r in rows]
    c = Counter(w for i, t in toks if not held(i) for w in t)
    n, v = sum(c.values()), len(c)
    return sorted(((i, held(i), len(t), sum(w in c for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)) for i, t in toks), key=str)


def test_base_scores_match_brute_force(spark, sf):
    docs = frame(spark, sf).repartition(3)
    got = H.score(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == base(docs.collect())
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in got)


def test_chunks_do_not_change_scores(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = {r.doc_id: r.score for r in H.score(docs.coalesce(1)).collect()}
    many = {r.doc_id: r.score for r in H.score(docs.repartition(7)).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-3 for k in one)


def test_empty_and_untrained(spark):
    assert H.score(empty(spark)).count() == 0
    only = spark.createDataFrame([(k, "a b") for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2], "doc_id long, text string")
    (r, *_) = H.score(only).collect()
    assert r.train_tokens == r.n_known == 0 and r.base_score == 0.0


def exact_tables(customers, a, d):
    """The distribution of tables after seating, by the recursion over customers."""
    p = {1: 1.0}
    for k in range(1, customers):
        q = Counter()
        for t, x in p.items():
            up = a / (a + k - d * t)
            q[t + 1] += x * up
            q[t] += x * (1 - up)
        p = q
    return p


@pytest.mark.parametrize("customers", [2, 7, 30, 300])
def test_seating_follows_the_process(customers):
    n, a, d = 20_000, 1.5, 0.6
    w = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    t = H.seated(w, np.zeros(n, np.int64), np.full(n, customers), np.full(n, a), d, 3)
    p = exact_tables(customers, a, d)
    assert abs(t.mean() - sum(k * x for k, x in p.items())) < 0.15
    if customers <= H.SINGLY:
        assert all(abs((t == k).mean() - x) < 0.02 for k, x in p.items())


def words_of(rng, n=50):
    ws = np.unique(rng.integers(1, 1 << 62, n)).astype("<u8")
    sizes = rng.integers(1, 6, len(ws)).astype("<u4")
    ctxs = np.concatenate([np.sort(rng.choice(200, s, replace=False)) for s in sizes]).astype("<u2")
    ns = rng.integers(1, 40, len(ctxs)).astype("<i8")
    return H.Words(*map(H.packed, (ws, sizes, ctxs, ns)))


def test_probabilities_sum_to_one():
    x = words_of(np.random.default_rng(2))
    told = x.totals()
    g = {"V": len(x.w), "C": np.bincount(x.c, x.n, minlength=H.CONTEXTS), "d": 0.6, "d0": 0.5, "T": H.spread(told), "T0": told[H.CONTEXTS]}
    x.sweep(0, g)
    told = x.totals()
    g |= {"T": H.spread(told), "T0": told[H.CONTEXTS]}
    p, up = x.parent(g), H.lift(g)
    none = (H.THETA_PARENT + g["d0"] * g["T0"]) / (g["V"] + 1) / (H.THETA_PARENT + g["T"].sum())
    assert p.sum() + none == pytest.approx(1)
    for c in range(4):
        own = x.c == c
        assert (up[c] * (p.sum() + none) + ((x.n - g["d"] * x.t)[own] / (H.THETA + g["C"][c])).sum()) == pytest.approx(1)


def test_leaving_and_coming_keeps_the_distribution():
    """Tables of 7 customers after many sweeps: by the recursion weighted for the chain's own law."""
    n, a, d, c = 4000, 1.5, 0.6, 7
    tables = np.eye(c, 1, dtype=np.float32).repeat(n, axis=1) * c
    w, rng = np.full(n, a), np.random.default_rng(0)
    for _ in range(30):
        for _ in range(c):
            H.take(tables, rng.random(n))
            H.place(tables, w, d, rng.random(n))
    assert (tables.sum(axis=0) == c).all()
    # stationary weights of a partition into t tables: a^t times the product of (1 - d)(2 - d)... of each
    weight = {1: {1: a}}  # customers -> tables -> weight
    for k in range(1, c):
        weight[k + 1] = {t: weight[k].get(t - 1, 0) * a + weight[k].get(t, 0) * (k - d * t) for t in range(1, k + 2)}
    total = sum(weight[c].values())
    t = (tables > 0).sum(axis=0)
    assert all(abs((t == k).mean() - x / total) < 0.03 for k, x in weight[c].items())


def one(w, c, sweep, step):
    return float(H.uniform(np.array([w], np.uint64), np.array([c]), sweep, step)[0])


def brute_scores(rows):
    """The model with dictionaries and loops, a customer at a time, from the same draws."""
    import xxhash

    key = lambda w: xxhash.xxh64_intdigest(w, 42)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    texts = []
    for i, t in rows:
        toks = [*(t or "").encode().lower().split(), b""]
        texts.append((i, [(key(w), key(toks[k - 1]) >> (64 - H.BITS) if k else H.START) for k, w in enumerate(toks)]))
    n = Counter(p for i, t in texts if not held(i) for p in t)
    of, rest = {}, Counter()
    for (w, c), k in n.items():
        of.setdefault(w, []).append(c)
        rest[c] += k
    tables = {p: [float(k)] + [0.0] * (k - 1) for p, k in n.items()}
    seats, root = dict.fromkeys(n, 1), dict.fromkeys(of, 1)
    count = lambda j, v: sum(x == j for x in v)
    share = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5
    d, d0, v = share(count(1, n.values()), count(2, n.values())), share(count(1, map(len, of.values())), count(2, map(len, of.values()))), len(of)

    def totals():
        t = Counter()
        for (_, c), k in seats.items():
            t[c] += k
        return t, sum(root.values())

    def parent(w, t, t0):
        up = (H.THETA_PARENT + d0 * t0) / (v + 1)
        own = sum(seats[w, c] for c in of[w]) - d0 * root[w] if w in of else 0.0
        return (own + up) / (H.THETA_PARENT + sum(t.values()))

    told, probs = totals(), Counter()
    for j in range(H.BURN + H.SAMPLES):
        t, t0 = told
        for k in range(j * H.LOCAL, (j + 1) * H.LOCAL):
            p = {w: parent(w, t, t0) for w in of}
            for (w, c), own in tables.items():
                new = (H.THETA + d * t[c]) * p[w]
                if len(own) > H.SINGLY:
                    seats[w, c] = int(H.seated(np.array([w], np.uint64), np.array([c]), np.array([n[w, c]]), np.array([new]), d, k)[0])
                    continue
                for step in range(len(own) if len(own) > 1 else 0):
                    leaves, comes = (float(v[0]) for v in H.two_uniform(np.array([w], np.uint64), np.array([c]), k, step))
                    x, at = leaves * sum(own), 0
                    while sum(own[: at + 1]) <= x:
                        at += 1
                    own[at] -= 1
                    weight = [s - d if s else 0.0 for s in own]
                    x, at = comes * (sum(weight) + new), 0
                    while at < len(own) and sum(weight[: at + 1]) <= x:
                        at += 1
                    own[at if at < len(own) else own.index(0.0)] += 1
                seats[w, c] = sum(s > 0 for s in own)
            up = (H.THETA_PARENT + d0 * t0) / (v + 1)
            for w in of:
                size, open_ = sum(seats[w, c] for c in of[w]), 1
                for s in range(1, size if size <= H.SINGLY else 1):
                    open_ += one(w, H.CONTEXTS, k, s) * (up + s - d0 * open_) < up
                if size > H.SINGLY:  # the end token: its seating in blocks has a test of its own
                    open_ = int(H.seated(np.array([w], np.uint64), np.array([H.CONTEXTS]), np.array([size]), np.array([up]), d0, k)[0])
                root[w] = open_
        told = totals()
        if j >= H.BURN:
            t, t0 = told
            for p in {p for _, text in texts for p in text}:
                w, c = p
                lift = (H.THETA + d * t[c]) / (H.THETA + rest[c])
                own = (n[p] - d * seats[p]) / (H.THETA + rest[c]) if p in n else 0.0
                probs[p] += (own + lift * parent(w, t, t0)) / H.SAMPLES
    return sorted(((i, round(sum(math.log10(probs[p]) for p in text), 3)) for i, text in texts), key=str)


def test_scores_match_a_sampler_of_loops(spark, sf):
    """200 texts whose words have too few customers for seated()'s blocks, but for the end token."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(200).collect()
    rows = [(r.doc_id, " ".join(r.text.split()[:8])) for r in docs]
    rows[:4] = [(None, "a b a b a b"), (3, None), (4, ""), (5, "a b a b a")]
    got = H.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sum(zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows if i is not None) > 10
    want = brute_scores(rows)
    got = sorted(((r.doc_id, round(r.score, 3)) for r in got), key=str)
    assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a - b) < 0.002 for (_, a), (_, b) in zip(got, want, strict=True))


def test_scores_match_where_words_have_many_customers(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, " ".join(r.text.split()[:6] + ["the", "same", "end"] * (k % 4))) for k, r in enumerate(docs)]
    got = sorted(((r.doc_id, r.score) for r in H.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    want = brute_scores(rows)
    assert [i for i, _ in got] == [i for i, _ in want] and all(abs(a - b) < 0.002 for (_, a), (_, b) in zip(got, want, strict=True))


def test_a_bucket_has_parts_by_its_own_bytes(spark, monkeypatch):
    monkeypatch.setattr(H, "PART", 100)
    rows = [(c, b, bytes(90 if b else 400)) for c in range(6) for b in range(4)]
    asked = spark.createDataFrame(rows, "chunk long, bucket int, ws binary").selectExpr("*", "ws as sizes", "cast('' as binary) as ctxs", "cast('' as binary) as ns")
    got, _, groups, most = H.dealt(asked)
    assert (most, groups) == (48, 48 + 3 * 11) and got.count() == len(rows)
    assert H.dealt(asked.limit(0))[2:] == (1, 1)


def test_groups_of_chunks_do_not_change_scores(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(7)
    one_ = {r.doc_id: r.score for r in H.score(docs).collect()}
    monkeypatch.setattr(H, "FAN", 2)  # levels of counts
    monkeypatch.setattr(H, "PART", 20_000)  # several groups of chunks to a bucket, more of them to one with frequent words
    two = {r.doc_id: r.score for r in H.score(docs).collect()}
    assert all(abs(one_[k] - two[k]) < 1e-3 for k in one_)


@pytest.mark.parametrize("at_once", [1 << 20, 64])
def test_customers_of_any_number_are_seated_one_at_a_time(monkeypatch, at_once):
    monkeypatch.setattr(H, "AT_ONCE", at_once)
    rng = np.random.default_rng(4)
    customers = np.array([1, 2, 31, 32, 33, 64, 65, 129, 700, 5000, 5000, 40])
    w, c = rng.integers(0, 1 << 63, len(customers)).astype(np.uint64), rng.integers(0, 100, len(customers))
    for d in (0.0, 0.4, 0.9):
        new = rng.uniform(0.01, 60, len(customers))
        got = H.seated(w, c, customers, new, d, 5)
        for i, n in enumerate(customers.tolist()):
            t = 1.0
            for k in range(1, n):
                t += float(H.uniform(w[i : i + 1], c[i : i + 1], 5, k)[0]) * (new[i] + k - d * t) < new[i]
            assert got[i] == t
