import hashlib
import zlib

import pytest
from edge import empty, frame

from sharemill.llm import manifest


def sha(s):
    return hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()


def leaf(r, low=False):
    out = ""
    for c in manifest.FIELDS:
        v = r[c]
        if low and c == "text" and v is not None:
            v = "".join(x.lower() if "A" <= x <= "Z" else x for x in v)
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(out)


def climb(nodes):
    """The root, and for each node the list of its siblings before and after, by plain lists."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, path in enumerate(paths):
            run = at[k] // 8 * 8
            path.append((nodes[run : at[k]], nodes[at[k] + 1 : run + 8]))
            at[k] //= 8
        nodes = [sha("".join(nodes[k : k + 8])) for k in range(0, len(nodes), 8)]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    done = {}
    for name in names:
        own = sorted(groups[name], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        done[name] = (own, *climb([leaf(r) for r in own]))
    root, above = climb([done[n][1] for n in names])
    out = []
    for name, last in zip(names, above, strict=True):
        own, sub, paths = done[name]
        for r, path in zip(own, paths, strict=True):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0
            d, proof = leaf(r, hit), ""
            for before, after in path + last:
                proof += "".join(before + after)
                d = sha("".join([*before, d, *after]))
            out.append((r["doc_id"], leaf(r), sub, root, sha(proof), d, d == root))
    return out


def same(got, want):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_equal_to_plain_lists(spark, sf):
    docs = frame(spark, sf)
    same(manifest.tamper_checked(docs).collect(), brute(docs.select(*manifest.FIELDS).collect()))


@pytest.mark.parametrize("n", [1, 8, 9, 65, 513, 4097])
def test_sizes(spark, n):
    docs = spark.range(n).selectExpr("id * 3 % 5003 as doc_id", "'s' as source", "'x' as lang", "id as n_chars", "concat('Text ', id) as text", "'c' as tree", "1 as at", "2 as digest", "3 as steps", "4 as tie")
    got = manifest.tamper_checked(docs)
    same(got.collect(), brute(docs.collect()))
    if n > 60:
        assert {r.verified for r in got.select("verified").distinct().collect()} == {True, False}


def test_one_row_may_hold_a_third_of_the_table(spark):
    docs = spark.range(1500).selectExpr("if(id % 3 = 0, 7, id) as doc_id", "'s' as source", "if(id % 7 = 0, null, 'x') as lang", "1 as n_chars", "if(id % 3 = 0, 'Same', concat('t', id)) as text")
    same(manifest.tamper_checked(docs).collect(), brute(docs.collect()))


def test_many_groups(spark):
    docs = spark.range(300).selectExpr("id as doc_id", "'s' as source", "concat('g', id % 100, 'é') as lang", "1 as n_chars", "'T' as text")
    same(manifest.tamper_checked(docs).collect(), brute(docs.collect()))


def test_empty(spark):
    assert manifest.tamper_checked(empty(spark)).count() == 0
