import hashlib
import re

from edge import empty, frame

from sharemill.llm import merkle


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def tree(text):
    lines = ["".join(hashlib.md5(p.encode()).hexdigest() for p in re.findall(merkle.PIECE, line)) for line in text.split("\n")]
    sections, own = [], []
    for k, line in enumerate(lines):
        own.append(line)
        if k == len(lines) - 1 or sha(line).startswith("0"):
            sections.append(",".join(own))
            own = []
    nodes = [sha("".join(sha(p) for p in s.split(","))) for s in sections]
    short = re.sub("([0-9a-f]{8})[0-9a-f]{24}", r"\1", ";".join(sections))
    return f"{sha(''.join(nodes))}:{''.join(n[:16] for n in nodes)}:{short}", sections


def likeness(a, b):
    both = set(a) & set(b)
    pa, pb = ({p for s in set(x) - both for p in s.split(",")} for x in (a, b))
    chunk = lambda ps: {"".join(ps)[k : k + 32] for k in range(0, sum(map(len, ps)), 32)}
    la, lb = chunk(sorted(pa - pb)), chunk(sorted(pb - pa))
    n = sum(len(s.replace(",", "")) // 32 for s in both) + sum(len(p) // 32 for p in pa & pb)
    return (n + len(la & lb)) / (n + max(len(la), len(lb))) if n or la or lb else 1.0


def changed(a, b):
    if a == b:
        return ""
    short = min(len(a), len(b))
    head = next((k for k in range(short) if a[k] != b[k]), short)
    tail = min(next((k for k in range(short) if a[-1 - k] != b[-1 - k]), short), short - head)
    return f"{head}:{len(a) - tail}:{len(b) - tail}"


def brute(rows):
    rows = sorted(((r.doc_id is None, r.doc_id or 0, hashlib.md5((r.text or "").encode()).hexdigest(), r.text or "", r.doc_id) for r in rows))
    out = []
    for k, (_, _, _, text, doc_id) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][3]
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[:half]
        (a, sa), (b, sb), (_, sc) = tree(text), tree(edited), tree(nxt)
        out.append((doc_id, len(text), sha(edited), a, b, likeness(sa, sb), likeness(sa, sc), changed(sa, sb)))
    return sorted(out, key=str)


def test_an_early_line_leaves_later_sections_alone(spark):
    text = "\n".join(f"line {k} says {k * k}." for k in range(400))
    docs = spark.createDataFrame([(1, text), (2, "new line here.\n" + text)], "doc_id long, text string")
    (a, sa), (b, sb) = tree(text), tree("new line here.\n" + text)
    got = {r.doc_id: r for r in merkle.trees(docs).collect()}
    assert got[1].sections == sa and got[2].fingerprint == b and len(sa) > 10 and len(set(sa) & set(sb)) >= len(sa) - 1


def test_a_hot_id_is_dealt_over_ranges(spark):
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"text {k % 200}. More of {k}") for k in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, merkle.document_fingerprints(docs).collect()), key=str) == brute(docs.collect())


def test_matches_brute_force(spark, sf):
    docs = frame(spark, sf)
    got = merkle.document_fingerprints(docs)
    assert sorted(map(tuple, got.collect()), key=str) == brute(docs.collect())
    one = frame(spark).where("doc_id = 4")
    assert merkle.document_fingerprints(one).first().near_edited == 1.0
    assert merkle.document_fingerprints(empty(spark)).count() == 0


def test_no_python_in_the_plan(spark, sf):
    plan = merkle.document_fingerprints(frame(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_leaves_that_begin_alike_are_different(spark):
    """These two lines' digests agree in the digits that a fingerprint prints."""
    df = spark.createDataFrame([(1, "line 23768"), (2, "line 40692")], "doc_id long, text string")
    a, b = merkle.document_fingerprints(df).orderBy("doc_id").collect()
    assert a.fingerprint.split(":")[2] == b.fingerprint.split(":")[2] and a.fingerprint != b.fingerprint
    assert a.fingerprint.split(":")[0] != b.fingerprint.split(":")[0] and a.near_next == b.near_next == 0.0
