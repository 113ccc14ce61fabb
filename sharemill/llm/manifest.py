"""Merkle manifest of a dataset: rows are leaves of a tree for each group, eight nodes to a parent, and
the groups' roots are leaves of the tree above. Blocks of leaves are traversed recursively in postorder,
each by a task: a subtree's digest is returned, and its siblings are appended to the leaves that it
contains while the recursion unwinds. The blocks' roots feed the next traversal."""

from __future__ import annotations

import hashlib
import string
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialize, shuffle_partitions

#: Nodes to a parent, and levels to a block: a traversal takes FAN ** LEVELS nodes.
FAN, LEVELS = 8, 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
STEPS = "array<struct<before: string, after: string>>"
#: Blocks up to which their paths are broadcast, some 3 KB each.
MOST_BLOCKS = 8192


def field(value: Column) -> Column:
    """- for null, or the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: list[Column]) -> Column:
    return F.sha2(F.concat(*(field(v) for v in values)).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def levels(n: int) -> int:
    """Levels above n nodes until one remains."""
    k = 0
    while n > 1:
        n, k = -(-n // FAN), k + 1
    return k


def visit(digests: list[str], lo: int, depth: int, paths: list[list[tuple[str, str]]]) -> str:
    """The digest of the subtree of so many levels whose first leaf is lo. Once the branches have
    returned theirs, each leaf's path gets the digests before and after its own branch."""
    if not depth:
        return digests[lo]
    span = FAN ** (depth - 1)
    starts = range(lo, min(lo + FAN * span, len(digests)), span)
    parts = [visit(digests, at, depth - 1, paths) for at in starts]
    for k, at in enumerate(starts):
        step = ("".join(parts[:k]), "".join(parts[k + 1 :]))
        for path in paths[at : at + span]:
            path.append(step)
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with a column tree -> with at (place in its tree, from 0, by order) and n (the tree's rows),
    without one task for a tree: rows are sorted by ranges, counted by range and tree, and offset by
    the counts of the ranges before. Rows that tie in everything are dealt over ranges by their
    place in the input; their places among each other don't matter, since they are equal."""
    spark, names = rows.sparkSession, rows.columns
    own = rows.withColumn("tie", F.monotonically_increasing_id())
    own = own.repartitionByRange(shuffle_partitions(spark), "tree", *order, "tie").sortWithinPartitions("tree", *order, "tie").drop("tie")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), None, 0
        for b in batches:
            places = []
            for tree in b.column(0).to_pylist():
                at, last = (at + 1 if tree == last else 0), tree
                places.append(at)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * b.num_rows, pa.int32()), pa.array(places, pa.int64())], names=[*b.schema.names, "part", "place"])

    own = own.select("tree", *(c for c in names if c != "tree"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema) + ", part int, place long"
    own = materialize(own.mapInArrow(count, schema), "ranked")
    counts = own.groupBy("tree", "part").agg(F.count("*").alias("c"))  # a row for each range and each tree, at most
    before = Window.partitionBy("tree").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("tree", "part", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"), F.sum("c").over(Window.partitionBy("tree")).alias("n"))
    return own.join(counts, ["tree", "part"]).select(*names, (F.col("base") + F.col("place")).alias("at"), "n")


def traversed(nodes: DataFrame) -> DataFrame:
    """nodes(tree, at, n, digest, ...) -> with block, steps (the path within the block) and top: the
    block's digest, on its first node alone."""
    names = nodes.columns

    def block(t: pa.Table) -> pa.Table:
        t = t.sort_by("at")
        digests, n = t.column("digest").to_pylist(), t.column("n")[0].as_py()
        paths: list[list[tuple[str, str]]] = [[] for _ in digests]
        top = visit(digests, 0, min(LEVELS, levels(n)), paths)
        ends = [0]
        for p in paths:
            ends.append(ends[-1] + len(p))
        flat = [s for p in paths for s in p]
        step = pa.StructArray.from_arrays([pa.array([s[0] for s in flat], pa.string()), pa.array([s[1] for s in flat], pa.string())], names=["before", "after"])
        t = t.append_column("steps", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), step))
        return t.append_column("top", pa.array([top] + [None] * (len(digests) - 1), pa.string())).select([*names, "block", "steps", "top"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema) + f", block long, steps {STEPS}, top string"
    return nodes.withColumn("block", F.expr(f"at div {FAN**LEVELS}")).groupBy("tree", "block").applyInArrow(block, schema)


def rooted(nodes: DataFrame) -> DataFrame:
    """nodes(tree, at, n, digest, ...) -> those columns and steps (the path to the tree's root) and
    root. Each round traverses all blocks at once and gives their digests to the next."""
    own = materialize(traversed(nodes), "blocks")
    tops = own.where("top is not null").select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / FAN**LEVELS).alias("n"), F.col("top").alias("digest"))
    count = tops.count()
    if tops.where("n > 1").isEmpty():
        above = tops.select("tree", "at", F.array().cast(STEPS).alias("above"), F.col("digest").alias("root"))
    else:
        above = rooted(tops).select("tree", "at", F.col("steps").alias("above"), "root")
    above = above.select(F.col("tree").alias("up_tree"), F.col("at").alias("up_at"), "above", "root")
    above = F.broadcast(above) if count <= MOST_BLOCKS else above
    joined = own.join(above, (F.col("tree") == F.col("up_tree")) & (F.col("block") == F.col("up_at")))
    return joined.select(*nodes.columns, F.concat("steps", "above").alias("steps"), "root")


def folded(digest: Column, steps: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(steps, digest, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]).cast("binary"), 256))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), "").cast("binary"), 256)


def manifest(docs: DataFrame, fields: list[str] = FIELDS, group: str = "lang", order: str = "doc_id", keep: dict[str, Column] | None = None) -> DataFrame:
    """docs -> the order column, leaf, subroot, root, steps, and the columns of keep, a row for each
    row of docs.

    A leaf is the digest of the fields. Leaves of a group ascend by order, nulls first, equal ones by
    their digests; rows that are equal in all have the same leaf, each its own place. Nulls of the
    group are a group, the first. Empty and very long texts are texts like others; an empty table
    gives no rows; no other column is read, so names can't clash."""
    extra = keep or {}
    own = docs.select(F.coalesce(F.concat(F.lit("="), F.col(group)), F.lit("")).alias("tree"), F.col(order).alias("key"), leaf_digest([F.col(c) for c in fields]).alias("digest"), *(v.alias(f"keep_{k}") for k, v in extra.items()))
    leaves = rooted(ranked(own, ["key", "digest"])).withColumnRenamed("root", "subroot")
    groups = leaves.groupBy("tree").agg(F.min("subroot").alias("digest"))
    groups = groups.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest")
    above = rooted(ranked(groups, ["name"])).select("name", F.col("steps").alias("last"), "root")
    few = F.broadcast(above) if above.count() <= MOST_BLOCKS else above
    out = leaves.join(few, F.col("tree") == F.col("name"))
    return out.select(F.col("key").alias(order), F.col("digest").alias("leaf"), "subroot", "root", F.concat("steps", "last").alias("steps"), *(F.col(f"keep_{k}").alias(k) for k in extra))


def tamper_checked(docs: DataFrame) -> DataFrame:
    """docs(doc_id, source, lang, n_chars, text, ...) -> doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified, as manifest() says. Where 3 divides the id's CRC-32, the root is folded from
    the leaf of a text whose A-Z were lower-cased (null texts and ids stay as they are)."""
    other = [lower_ascii(F.col(c)) if c == "text" else F.col(c) for c in FIELDS]
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    own = manifest(docs, keep={"tampered": F.when(hit, leaf_digest(other))})
    root = folded(F.coalesce("tampered", "leaf"), F.col("steps"))
    return own.select(F.col("doc_id").cast("long"), "leaf", "subroot", "root", proof_digest(F.col("steps")).alias("proof_sha256"), root.alias("folded_root"), (root == F.col("root")).alias("verified"))


#: Levels that the SQL writes out: groups of up to FAN ** 8 rows, and FAN ** 4 groups.
SQL_LEVELS, SQL_ABOVE = 8, 4


def _oracle() -> str:
    one = lambda v: f"coalesce(concat(strlen(CAST({v} AS VARCHAR)), ':', CAST({v} AS VARCHAR)), '-')"
    field_ = lambda v: f"CASE WHEN {v} IS NULL THEN '-' ELSE {one(v)} END"
    leaf = lambda text: "sha256(concat(" + ", ".join(field_(text if c == "text" else c) for c in FIELDS) + "))"
    lower = f"translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    ctes = [
        "crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i))",
        "ids AS (SELECT doc_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents), crc)",
        f"d AS (SELECT doc_id, coalesce('=' || lang, '') AS t, {leaf('text')} AS leaf, CASE WHEN crc % 3 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS other FROM documents d LEFT JOIN ids USING (doc_id))",
        "a0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, row_number() OVER () AS rid FROM d)",
        "n0 AS MATERIALIZED (SELECT t, i AS place, leaf AS h FROM a0)", "p0 AS MATERIALIZED (SELECT rid, t, i AS place, other AS h, '' AS path FROM a0)",
    ]

    def climb(n: str, p: str, many: int) -> None:
        for k in range(many):
            ctes.append(f"g{n}{k} AS MATERIALIZED (SELECT *, sum(len(hs)) OVER (PARTITION BY t) > 1 AS more FROM (SELECT t, place // {FAN} AS up, list(h ORDER BY place) AS hs FROM {n}{k} GROUP BY ALL))")
            ctes.append(f"{n}{k + 1} AS MATERIALIZED (SELECT t, up AS place, CASE WHEN more THEN sha256(array_to_string(hs, '')) ELSE hs[1] END AS h FROM g{n}{k})")
            pos = f"p.place % {FAN}"
            before, after = f"array_to_string(hs[1:{pos}], '')", f"array_to_string(hs[{pos} + 2:], '')"
            ctes.append(f"{p}{k + 1} AS MATERIALIZED (SELECT rid, p.t, up AS place, CASE WHEN more THEN sha256(concat({before}, p.h, {after})) ELSE p.h END AS h, CASE WHEN more THEN concat(path, {before}, {after}) ELSE path END AS path FROM {p}{k} p JOIN g{n}{k} g ON p.t = g.t AND p.place // {FAN} = g.up)")

    climb("n", "p", SQL_LEVELS)
    ctes.append(f"m0 AS MATERIALIZED (SELECT '' AS t, row_number() OVER (ORDER BY t) - 1 AS place, h, t AS name FROM n{SQL_LEVELS})")
    ctes.append(f"q0 AS MATERIALIZED (SELECT rid, '' AS t, m0.place, p.h, path FROM p{SQL_LEVELS} p JOIN m0 ON m0.name = p.t)")
    climb("m", "q", SQL_ABOVE)
    return (
        "WITH " + ",\n".join(ctes) + f"""
SELECT a0.doc_id, a0.leaf, s.h AS subroot, r.h AS root, sha256(path) AS proof_sha256, q.h AS folded_root, q.h = r.h AS verified
FROM a0 JOIN q{SQL_ABOVE} q USING (rid) JOIN n{SQL_LEVELS} s ON s.t = a0.t CROSS JOIN m{SQL_ABOVE} r"""
    )


ORACLE = _oracle()
