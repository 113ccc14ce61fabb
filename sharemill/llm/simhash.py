"""SimHash near-duplicates. Fingerprints are dealt out by vantage-point trees: each node sends a
fingerprint inside or outside its ball. There are radius + 1 trees, each of which measures on its own
part of the bits. Two fingerprints within `radius` bits are equal in one of the parts, so in that tree
they are as far from every vantage point and meet in a shard, and none is sent to both sides. Shards
are searched exactly. The trees grow by levels, each a job that splits the shards which are still
too large."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import columns_of, materialize, shuffle_partitions, unused, with_value
from .text import SEED, shingle_hashes, simhash, slices, words

#: Fingerprints up to which a shard is searched, and fingerprints of a larger one drawn to place the
#: vantage points and radii of its subtree; these affect speed only.
SHARD, SAMPLE = 2048, 8192
#: Drawn fingerprints that a node needs, nodes that a subtree has below its root's level at most (as a
#: depth), the most comparisons that a split may leave of those before, and rows to a task.
LEAST, DEEPEST, SAVING, ROWS_PER_TASK = 8, 10, 0.9, 1 << 20
#: Bands of so many least hashes each that make texts candidates, texts in a block of a large
#: group, and others up to which a text meets them one by one.
BANDS, ROWS, BLOCK, FEW = 16, 4, 1024, 8
#: Bytes of large groups' least texts up to which they are broadcast.
MOST_BYTES = 16 << 20


def fingerprints(docs: DataFrame, ngram: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row. Null and empty texts: 0. Other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fps = [simhash(shingle_hashes(words(t), ngram)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.bitwise_xor(a, b)).astype(np.int16)


def plant(sample: np.ndarray, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a tree in heap order; a radius of -1 ends a branch. A node takes,
    of four points and all radii, those that leave the fewest comparisons on both sides."""
    at, mu = np.zeros(1 << depth, np.uint64), np.full(1 << depth, -1, np.int16)
    todo, rng = [(1, sample)], np.random.default_rng(7)
    while todo:
        node, own = todo.pop()
        if node >= 1 << depth or len(own) < LEAST:
            continue
        best = (SAVING, 0, 0)
        for p in own[rng.integers(0, len(own), 4)]:
            inside = np.cumsum(np.bincount(distance(own, p), minlength=65)) / len(own)
            left, right = inside[:64], 1 - np.r_[np.zeros(radius), inside][:64]
            cost = left**2 + right**2
            m = int(np.argmin(cost))
            best = min(best, (float(cost[m]), m, int(p)))
        if best[0] >= SAVING:
            continue
        _, m, p = best
        d = distance(own, np.uint64(p))
        at[node], mu[node] = p, m
        todo += [(2 * node, own[d <= m]), (2 * node + 1, own[d > m - radius])]
    return at, mu


def route(fps: np.ndarray, at: np.ndarray, mu: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, shard) of every shard that a fingerprint belongs to."""
    idx, node, done = np.arange(len(fps)), np.ones(len(fps), np.int64), []
    while len(idx):
        stop = (node >= len(mu)) | (mu[np.minimum(node, len(mu) - 1)] < 0)
        done.append((idx[stop], node[stop]))
        idx, node = idx[~stop], node[~stop]
        d, m = distance(fps[idx], at[node]), mu[node]
        left, right = d <= m, d > m - radius
        idx, node = np.concatenate([idx[left], idx[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
    return np.concatenate([x for x, _ in done] or [idx]), np.concatenate([x for _, x in done] or [node])


def shard_links(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within a shard: as many links as fingerprints at most."""
    fps = np.unique(fps)
    root = np.arange(len(fps))
    out = []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for lo in range(0, len(fps), 256):
        block = fps[lo : lo + 256]
        i, j = np.nonzero(distance(block[:, None], fps[None, lo:]) <= radius)
        for x, y in zip((i + lo).tolist(), (j + lo).tolist(), strict=True):
            if x < y and (p := find(x)) != (q := find(y)):
                root[max(p, q)] = min(p, q)
                out.append((x, y))
    return [(int(fps[x]), int(fps[y])) for x, y in out]


def parts_of(free: int, radius: int) -> list[int]:
    """Masks of radius + 1 parts, as equal as can be, of the bits that are set in free."""
    bits = [k for k in range(64) if free >> k & 1]
    return [sum(1 << k for k in bits[i :: radius + 1]) for i in range(radius + 1)]


def plant_anew(dealt: DataFrame, radius: int) -> DataFrame:
    """Rows (shard, fp, free, part) of shards that no tree was planted for or whose tree can't split
    them, once for each tree of the next ones. Only pairs that are equal in `part` have to meet, so its
    values part them, and what is left of `free` is parted for the next trees."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, fp, free, part = (b.column(k).to_numpy().view(np.uint64) for k in range(4))
            left = free & ~part
            for own in np.unique(left):
                i = np.flatnonzero(left == own)
                for next_part in parts_of(int(own), radius):
                    columns = shard[i], fp[i], np.full(len(i), own), np.full(len(i), next_part, np.uint64), fp[i] & part[i]
                    yield pa.RecordBatch.from_arrays([pa.array(c.view(np.int64)) for c in columns], names=["shard", "fp", "free", "part", "value"])

    anew = dealt.select("shard", "fp", "free", "part").mapInArrow(deal, "shard long, fp long, free long, part long, value long")
    return anew.select(F.xxhash64("shard", "value", "part").alias("shard"), "fp", "free", "part", F.lit(False).alias("final"))


def split(dealt: DataFrame, large: DataFrame) -> DataFrame:
    """The rows (shard, fp, free, part) of the shards in large(shard, n), dealt on by a subtree of each,
    with `final` true where a subtree couldn't split its shard."""
    rate = F.least(F.lit(1.0), F.lit(float(SAMPLE)) / F.col("n"))
    drawn = dealt.join(large, "shard").where(F.pmod(F.xxhash64(F.lit(99), "fp"), F.lit(1 << 30)) < rate * (1 << 30)).select("shard", F.col("fp").bitwiseAND(F.col("part")).alias("fp"), "n")

    def grow(t: pa.Table) -> pa.Table:
        own, n = np.sort(t.column("fp").to_numpy().view(np.uint64)), t.column("n")[0].as_py()
        depth = max(1, min(DEEPEST, math.ceil(math.log(n / SHARD) / math.log(1 / 0.6))))
        at, mu = plant(own, depth, 0)
        return pa.table({"shard": t.column("shard")[:1], "n": t.column("n")[:1], "at": pa.array([at.tobytes()], pa.binary()), "mu": pa.array([mu.tobytes()], pa.binary())})

    trees = materialize(drawn.groupBy("shard").applyInArrow(grow, "shard long, n long, at binary, mu binary"), "subtrees")
    # a subtree goes ahead of its shard's rows into each task that has some of them
    tasks = F.ceil(F.col("n") / ROWS_PER_TASK).cast("int")
    no_row, no_tree = (F.lit(None).cast("long").alias(c) for c in ("fp", "free", "part")), (F.lit(None).cast("binary").alias(c) for c in ("at", "mu"))
    ahead = trees.select("shard", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("task"), *no_row, "at", "mu")
    rows = dealt.join(trees.select("shard", tasks.alias("tasks")), "shard").select("shard", F.pmod(F.xxhash64("fp"), F.col("tasks")).cast("int").alias("task"), "fp", "free", "part", *no_tree)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = mu = None
        for b in batches:
            of = b.column(0).to_numpy()
            heads = set(np.flatnonzero(b.column(1).is_null().to_numpy(zero_copy_only=False)).tolist())
            borders = sorted({0, b.num_rows} | heads)
            for lo, hi in zip(borders, borders[1:], strict=False):
                if lo in heads:
                    at, mu = np.frombuffer(b.column(4)[lo].as_py(), np.uint64), np.frombuffer(b.column(5)[lo].as_py(), np.int16)
                    lo += 1
                if lo == hi:
                    continue
                fp, free, part = (b.column(k).slice(lo, hi - lo).to_numpy().view(np.uint64) for k in (1, 2, 3))
                i, leaf = route(fp & part, at, mu, 0)
                leaves, inv = np.unique(leaf, return_inverse=True)
                ids = np.array([xxhash.xxh64_intdigest(f"{of[lo]}/{x}".encode(), SEED) for x in leaves.tolist()], np.uint64)
                columns = [pa.array(c.view(np.int64)) for c in (ids[inv], fp[i], free[i], part[i])]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(len(i), mu[1] < 0))], names=["shard", "fp", "free", "part", "final"])

    spread = rows.union(ahead).repartition(shuffle_partitions(dealt.sparkSession), "shard", "task").sortWithinPartitions("shard", "task", F.col("fp").asc_nulls_first())
    return spread.select("shard", "fp", "free", "part", "at", "mu").mapInArrow(deal, "shard long, fp long, free long, part long, final boolean")


def shards(fps: DataFrame, radius: int) -> DataFrame:
    """fps(fp long) of distinct values -> (shard, fp): each pair within `radius` bits shares a shard.
    Above SHARD fingerprints are dealt to radius + 1 trees, whose shards are split level by level. A
    shard that a tree can't split, as it is mostly of one value in the tree's part of the bits, is
    dealt by that value to trees over parts of the other bits. Bits become fewer each time, and so few
    that they tell at most SHARD fingerprints apart end it. So a fingerprint has radius + 1 copies, and
    more only in shards of over SHARD that agree in a part, however large the table is."""
    dealt = materialize(fps.select(F.lit(0).cast("long").alias("shard"), "fp", F.lit(-1).cast("long").alias("free"), F.lit(0).cast("long").alias("part"), F.lit(True).alias("final")), "shards")
    out = None
    while True:
        large = dealt.groupBy("shard").agg(F.count("*").alias("n"), F.max("final").alias("final"), F.max(F.bit_count(F.col("free").bitwiseXOR(F.col("part")))).alias("left"))
        large = materialize(large.where((F.col("n") > SHARD) & (~F.col("final") | (F.col("left") > radius))), "large")
        done = dealt.join(large, "shard", "left_anti").select("shard", "fp")
        out = done if out is None else out.union(done)
        stuck, todo = large.agg(F.count_if("final"), F.count_if(~F.col("final"))).first()
        if not stuck and not todo:
            return out
        anew = plant_anew(dealt.join(large.where("final").select("shard"), "shard"), radius) if stuck else None
        further = split(dealt.where("not final"), large.where("not final").select("shard", "n")) if todo else None
        dealt = materialize(anew.union(further) if stuck and todo else anew if stuck else further, "shards")


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """fps(fp long) of distinct values -> (a, b): links whose components are those of all pairs
    within `radius` bits."""

    def search(t: pa.Table) -> pa.Table:
        own = t.column("fp").to_numpy().view(np.uint64)
        found = np.array(shard_links(own, radius), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return shards(fps, radius).repartition(shuffle_partitions(fps.sparkSession), "shard").groupBy("shard").applyInArrow(search, "a long, b long")


def near_duplicates(docs: DataFrame, ngram: int = 3, radius: int = 2) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, fingerprint, component_id) for every row.

    Nulls and empty texts have fingerprint zero and link like any other; a null doc_id is kept and
    never names a component unless nothing else is there; repeated rows are kept; an empty table
    gives an empty result. Extra columns are ignored."""
    own = materialize(fingerprints(docs, ngram), "fps")
    distinct = materialize(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    parts = connected_components(links(distinct.select("fp"), radius))
    named = parts.join(distinct, parts.node == distinct.fp).groupBy("component").agg(F.min("least").alias("component_id"))
    to = parts.join(named, "component").select(F.col("node").alias("fp"), "component_id")
    class_of = distinct.join(to, "fp", "left").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    return with_value(own, class_of, "fp", F.col("doc_id")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def sketch(hashes: np.ndarray) -> tuple[list[int], bytes]:
    """Band keys and the sorted set of 32-bit shingle hashes."""
    own = np.unique((hashes >> np.uint64(32)).astype(np.uint32))
    if not len(own):
        return [], b""
    k = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        a, b = k * np.uint64(0x9E3779B97F4A7C15) | np.uint64(1), k * np.uint64(0xC2B2AE3D27D4EB4F)
        least = np.full(len(k), np.uint64(0xFFFFFFFFFFFFFFFF))
        for lo in range(0, len(own), 4096):
            x = own[lo : lo + 4096].astype(np.uint64)[:, None] * a + b
            least = np.minimum(least, ((x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0))
    bands = least.reshape(BANDS, ROWS)
    return [xxhash.xxh64_intdigest(bytes([i]) + r.tobytes()) - (1 << 63) for i, r in enumerate(bands)], own.tobytes()


def sketches(docs: DataFrame, ngram: int) -> DataFrame:
    """(doc_id, mark, digest of the words, fp, bands, hashes) for every row."""
    schema = "doc_id long, mark string, digest string, fp long, bands array<long>, hashes binary"
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for doc_id, mark, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(1), strict=True):
                w = words(text.as_py())
                h = shingle_hashes(w, ngram)
                out.append((doc_id, mark, xxhash.xxh3_128_hexdigest(b" ".join(w)), simhash(np.unique(h)), *sketch(h)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=[x.split(" ")[0] for x in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", row_mark().alias("mark")).mapInArrow(run, schema)


def row_mark() -> Column:
    """What tells rows apart: a digest of id and text, equal for rows that repeat."""
    return F.md5(F.concat_ws("|", F.col("doc_id").cast("string"), F.concat(F.lit("|"), F.coalesce("text", F.lit("")))).cast("binary"))


def alike(fps: np.ndarray, sets: list[np.ndarray], similarity: float, comp: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose shingle sets (not empty) are at least so similar. Texts
    that are connected already, as comp may say from the start, aren't compared. A text that has
    few others left meets them by SimHash distance, nearest first; else it meets all at once."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    starts, flat = np.r_[0, np.cumsum(size)], np.concatenate(sets)
    known, place = np.unique(flat), np.empty(len(flat), np.int32)
    for lo in range(0, len(flat), 1 << 20):
        place[lo : lo + (1 << 20)] = np.searchsorted(known, flat[lo : lo + (1 << 20)])
    mark, out = np.zeros(len(known), bool), []
    comp = np.arange(n) if comp is None else np.unique(comp, return_inverse=True)[1]
    for x in range(n - 1):
        rest = slice(x + 1, n)
        fits = (comp[rest] != comp[x]) & (np.minimum(size[x], size[rest]) >= similarity * np.maximum(size[x], size[rest]))
        todo = np.flatnonzero(fits) + x + 1
        if not len(todo):
            continue
        own = place[starts[x] : starts[x + 1]]
        mark[own] = True
        if len(todo) > FEW:
            at = starts[x + 1]
            both = np.add.reduceat(mark[place[at:]], starts[x + 1 : n] - at, dtype=np.int64)[todo - x - 1]
        else:
            todo = todo[np.argsort(distance(fps[todo], fps[x]), kind="stable")]
            both = np.array([np.count_nonzero(mark[place[starts[y] : starts[y + 1]]]) for y in todo])
        mark[own] = False
        for y in todo[both >= similarity * (size[x] + size[todo] - both)].tolist():
            if comp[y] != comp[x]:
                comp[comp == comp[y]] = comp[x]
                out.append((x, y))
    return out


def links_to_least(banded: DataFrame, large: DataFrame, sets: DataFrame, similarity: float) -> DataFrame | None:
    """(a, b): members of large groups that are so similar to their group's least text; None
    without large groups."""
    least = large.select(F.col("least").alias("b")).distinct()
    n = least.count()
    if not n:
        return None
    pairs = banded.join(large.select("band", F.col("least").alias("b")), "band").where("rep <> b").select("rep", "b").distinct()
    to = sets.select(F.col("rep").alias("b"), F.col("hashes").alias("other")).join(least, "b", "left_semi")
    size = to.agg(F.sum(F.length("other"))).first()[0] or 0
    to = F.broadcast(to) if size <= MOST_BYTES else to

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            fits = []
            for x, y in zip(t.column(2), t.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= similarity * max(len(x), len(y)) else 0
                fits.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([t.column(0), t.column(1)], names=["a", "b"]).filter(pa.array(fits, pa.bool_()))

    met = sets.select("rep", "hashes").join(pairs, "rep").join(to, "b").select("rep", "b", "hashes", "other")
    return materialize(met.mapInArrow(keep, "a long, b long"), "star")


def tiles(banded: DataFrame, groups: DataFrame, parts: DataFrame) -> DataFrame:
    """(rep, comp, tile): the tiles in which a group's members meet. In a large group those that are
    connected to its least text are dealt into near blocks and others into far blocks; a tile is
    a near and a far block or two far ones."""
    parts = materialize(parts, "parts")
    homes = groups.join(parts, groups.least == parts.node, "left").select("band", "n", F.when(F.col("n") > BLOCK, F.col("component")).alias("home"))
    members = banded.join(homes, "band").join(parts, F.col("rep") == F.col("node"), "left")
    members = members.select("rep", "band", F.coalesce("component", "rep").alias("comp"), F.coalesce(F.col("component") == F.col("home"), F.lit(False)).alias("near"))
    members = materialize(members, "members")
    count = lambda own: F.ceil(F.count_if(own) / BLOCK).cast("int")
    blocks = members.groupBy("band").agg(count(F.col("near")).alias("nears"), count(~F.col("near")).alias("fars")).where("fars > 0")
    own = members.join(blocks, "band")
    all_of = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    mine = F.pmod(F.xxhash64("rep"), F.when(F.col("near"), F.col("nears")).otherwise(F.col("fars"))).cast("int")
    tile = lambda kind, i, j: F.xxhash64(F.col("band"), F.lit(kind), i, j)
    near = F.transform(all_of("fars"), lambda j: tile("near", F.col("mine"), j))
    far = F.concat(
        F.transform(all_of("nears"), lambda i: tile("near", i, F.col("mine"))),
        F.transform(all_of("fars"), lambda k: tile("far", F.least(F.col("mine"), k), F.greatest(F.col("mine"), k))),
    )
    return own.withColumn("mine", mine).select("rep", "comp", F.explode(F.when(F.col("near"), near).otherwise(far)).alias("tile"))


def by_tree(texts: DataFrame, radius: int) -> DataFrame:
    """(rep, band): texts whose fingerprints the vantage-point tree links, directly or through others, have
    one number. A text without words is like no other, and one that nothing is linked to is left out."""
    own = texts.where(F.size("bands") > 0).select("rep", "fp")
    linked = connected_components(links(own.select("fp").distinct(), radius))
    alone = own.groupBy("fp").count().where("count > 1").select(F.col("fp").alias("node"), F.col("fp").alias("component")).join(linked, "node", "left_anti")
    classes = linked.union(alone)
    return materialize(own.join(classes, own.fp == classes.node).select("rep", F.xxhash64(F.lit("tree"), "component").alias("band")), "near")


def by_bands(texts: DataFrame) -> DataFrame:
    """(rep, band): similar texts beyond the tree's radius have some of these in common."""
    return texts.select("rep", F.explode("bands").alias("band"))


def classed(docs: DataFrame, ngram: int, similarity: float, radius: int) -> tuple[DataFrame, DataFrame]:
    """Sketches of the rows, and the different word sequences (digest, n, least, best, component):
    a component's sequences are connected. The nodes are numbers of sequences, never ids, so texts
    that share an id and texts without one are classed like others."""
    spark = docs.sparkSession
    own = materialize(sketches(docs, ngram).withColumn("place", F.monotonically_increasing_id()), "sketches")
    best = F.min(F.struct(F.col("doc_id").isNull().alias("null_last"), "doc_id", "mark"))
    texts = own.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("least"), best.alias("best"), F.min("place").alias("place"), F.min("fp").alias("fp"), F.min("bands").alias("bands"))
    texts = materialize(texts.withColumn("rep", F.monotonically_increasing_id()), "texts")
    banded = by_tree(texts, radius).union(by_bands(texts))
    groups = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("least"), F.bit_xor(F.xxhash64("rep")).alias("mark")).where("n > 1")
    groups = materialize(groups.groupBy("n", "least", "mark").agg(F.min("band").alias("band")), "groups")  # the same texts meet in many bands
    sets = own.select("place", "digest", "fp", "hashes").join(texts.select("digest", "place", "rep"), ["digest", "place"]).select("rep", "fp", "hashes")
    star = links_to_least(banded, groups.where(F.col("n") > BLOCK), sets, similarity)
    if star is None:
        members = banded.join(groups.select("band"), "band").select("rep", F.col("rep").alias("comp"), F.xxhash64("band").alias("tile"))
    else:
        members = tiles(banded, groups, connected_components(star))
    meet = sets.join(members, "rep")

    def search(t: pa.Table) -> pa.Table:
        reps, first = np.unique(t.column("rep").to_numpy(), return_index=True)
        fps, comp = t.column("fp").to_numpy()[first].view(np.uint64), t.column("comp").to_numpy()[first]
        found = alike(fps, [np.frombuffer(t.column("hashes")[int(k)].as_py(), np.uint32) for k in first], similarity, comp)
        return pa.table({"a": pa.array([int(reps[x]) for x, _ in found], pa.int64()), "b": pa.array([int(reps[y]) for _, y in found], pa.int64())})

    linked = meet.repartition(shuffle_partitions(spark), "tile").groupBy("tile").applyInArrow(search, "a long, b long")
    if star is not None:
        linked = linked.union(star)
    parts = connected_components(linked)
    return own, texts.join(parts, texts.rep == parts.node, "left").select("digest", "n", "least", "best", "rep", F.coalesce("component", "rep").alias("component"))


def similar(docs: DataFrame, ngram: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, component_id) for every row: texts whose sets of n-word
    shingles are at least so similar (Jaccard) are linked, and links are followed.

    Texts whose SimHashes differ in `radius` bits at most meet by the vantage-point tree, none of them lost.
    At this similarity SimHashes differ in up to 17 bits, a radius at which no ball of the tree prunes
    anything, so texts further apart meet by bands of least shingle hashes. In both cases SimHash
    puts near pairs first, and the sets decide. Equal word sequences are one text from the start. Groups larger than BLOCK first meet
    their least text; those connected by that aren't compared with each other, and the rest meets
    all in pairs of blocks. Null and empty texts are alike; a component is named by its least id (null
    only where none of its rows has one); repeated rows are kept; an empty table gives an empty result."""
    own, texts = classed(docs, ngram, similarity, radius)
    named = texts.groupBy("component").agg(F.count("*").alias("n"), F.min("least").alias("component_id"))
    class_of = with_value(texts.select("digest", F.col("n").alias("rows"), "rep", "component"), named, "component", F.col("rep"))
    class_of = class_of.select("digest", F.col("rows").alias("n"), "component_id")
    return with_value(own.select("doc_id", "digest", "place"), class_of, "digest", F.col("place")).select("doc_id", "component_id")


#: Rows up to which a list of their marks is broadcast.
MOST_IDS = 1_000_000


def deduplicated(docs: DataFrame, ngram: int = 5, similarity: float = 0.8, radius: int = 2) -> DataFrame:
    """The rows of docs with exactly one row of each group of similar texts: the least by doc_id (nulls
    last), then by the digest of its words. Different texts that share an id, and texts without one,
    are groups like others, so none of them is lost. Of rows that repeat id and text the least by all
    columns stays. Columns are those of docs, whatever their names."""
    own, texts = classed(docs, ngram, similarity, radius)
    best = texts.select("component", F.struct("best.null_last", "best.doc_id", "digest", "best.mark").alias("best"))
    kept = best.groupBy("component").agg(F.min("best").alias("best")).select("best.mark")
    marks = own.groupBy("mark").agg(F.count("*").alias("n"))
    kept = materialize(marks.join(kept.withColumn("kept", F.lit(True)), "mark", "left"), "kept")
    gone, twice = kept.where("kept is null"), kept.where("kept and n > 1")
    few = lambda t: F.broadcast(t) if t.count() <= MOST_IDS else t
    name, mark = unused("mark", docs.columns), unused("repeats", docs.columns)
    listed = few(gone.select(F.col("mark").alias(name), F.lit(False).alias(mark)).union(twice.select("mark", F.lit(True))))
    met = docs.withColumn(name, row_mark()).join(listed, name, "left")
    once = met.where(F.col(mark).isNull()).select(columns_of(docs))
    if twice.isEmpty():
        return once
    row = F.struct(*columns_of(docs))
    least = met.where(F.col(mark)).groupBy(name).agg(F.min_by(row, F.to_json(row)).alias(mark))
    return once.union(least.select(*(F.col(mark)[c].alias(c) for c in docs.columns)))
