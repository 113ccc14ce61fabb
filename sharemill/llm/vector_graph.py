"""Near-duplicate vectors by a robust-pruned flat graph: overlapping shards around centroids each build
one, the adjacency lists of a vector's shards are united, and range-expanding greedy searches start
from the medoids. A search leaves its shard by the edges that others gave to a vector it has met."""

from __future__ import annotations

import logging
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import materialize, shuffle_partitions, with_value

#: Least cosine of a link, and least cosine at which a search goes on: its range is wider than that of links.
LINK, FLOOR = 0.95, 0.90
#: Neighbours of a node, candidates that are pruned to them, the pruning's slack, and the first beam.
DEGREE, POOL, SLACK, BEAM = 16, 48, 1.2, 24
#: Neighbours that give an edge back without pruning.
TIES = 3
#: Vectors that the first centroids are fitted on (a bounded sample by hash), centroids at most.
SAMPLE, MOST_CENTRES, ROUNDS = 16_384, 1024, 8
#: Vectors to a shard: what is aimed at, and what a larger one is split at, into how many; the part of
#: a split shard's vectors (those nearest to a border) that two of its parts get.
AIM, LIMIT, WAYS, SHARED = 1024, 4096, 8, 0.25
#: Searches to a task's group, vectors that are searched together, and hops between shards at most.
ASKS, TOGETHER, MOST_HOPS = 4096, 512, 40
#: Vectors whose links are counted against all others, in blocks; the recall at which a search is done,
#: and the least that is accepted; shards of a vector, tried in this order.
AUDITED, ENOUGH, LEAST, OVERLAPS = 1024, 0.99, 0.9, (2, 4, 8)
#: Digits of a direction's entries that tell directions apart.
DIGITS = 12


def finite(vector: Column) -> Column:
    v = vector.cast("array<double>")
    return vector.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists(v, lambda c: c != 0)


def directions(df: DataFrame, key: str, vector: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a direction as (id, digest), and classes of equal directions (digest, node, n, least,
    vec): unit vectors in double precision as bytes, shorter ones padded with zeros."""
    own = df.where(finite(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    width = own.agg(F.max(F.size("v"))).first()[0] or 0

    def unit(batches):
        for b in batches:
            flat, ends = b.column(1).flatten().to_numpy(zero_copy_only=False), np.diff(b.column(1).offsets.to_numpy())
            x = np.zeros((b.num_rows, width))
            x[np.arange(width) < ends[:, None]] = flat
            x /= np.abs(x).max(axis=1, keepdims=True)  # neither overflows nor vanishes when squared
            x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
            same = np.round(x, DIGITS) + 0.0
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in same], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "same", "vec"])

    own = own.mapInArrow(unit, "id long, same binary, vec binary").select("id", F.sha2("same", 256).alias("digest"), "vec")
    own = materialize(own, "directions")
    classes = own.groupBy("digest").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.min("vec").alias("vec"))
    return own.select("id", "digest"), materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")


def stacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows)).reshape(len(rows), -1)


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's rounds from k rows spread over x; centroids without rows stay where they were."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([(b @ c.T - 0.5 * (c * c).sum(1)).argmax(1) for b in np.array_split(x, max(1, len(x) // 2048))])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest(x: np.ndarray, c: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The m nearest centroids of each row, nearest first, and twice how far they lie behind the first."""
    score = x @ c.T - 0.5 * (c * c).sum(1)
    m = min(m, len(c))
    top = np.argpartition(-score, m - 1, axis=1)[:, :m]
    top = np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, 1), axis=1, kind="stable"), 1)
    s = np.take_along_axis(score, top, 1)
    return top, s[:, :1] - s


COPY = "node long, n long, vec binary, shard long, home boolean"


def sharded(classes: DataFrame, overlap: int) -> DataFrame:
    """(node, n, vec, shard, home): a copy of a vector for each of its shards, one of them its home. The
    first centroids, MOST_CENTRES at most, go along with the tasks; a shard above LIMIT is split
    around centroids of its own, until none is."""
    count = classes.count()
    rate = min(1.0, SAMPLE / max(1, count))
    dealt = lambda c: F.pmod(F.xxhash64(c, F.lit("fit")), F.lit(1 << 20)) / float(1 << 20)
    x = stacked(pa.array([bytes(r.vec) for r in classes.where(dealt("node") < rate).select("vec").orderBy("vec").limit(2 * SAMPLE).collect()], pa.binary())) if count else np.zeros((0, 1))
    if not len(x):
        x = stacked(pa.array([bytes(r.vec) for r in classes.select("vec").limit(1).collect()], pa.binary()))
    c = centroids(x, min(MOST_CENTRES, math.ceil(count / AIM)))

    def first(batches):
        for b in batches:
            own = stacked(b.column(2))
            top = nearest(own, c, overlap)[0]
            at = np.repeat(np.arange(len(own)), top.shape[1])
            home = np.tile(np.arange(top.shape[1]) == 0, len(own))
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at)) for k in range(3)), pa.array(top.ravel().astype(np.int64)), pa.array(home)], names=["node", "n", "vec", "shard", "home"])

    copies = materialize(classes.select("node", "n", "vec").mapInArrow(first, COPY), "copies")
    for _ in range(MOST_HOPS):
        sizes = copies.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > LIMIT)
        sizes = materialize(sizes, "large")
        if sizes.isEmpty():
            return copies
        few = F.broadcast(sizes.withColumnRenamed("n", "many")) if sizes.count() <= MOST_CENTRES else sizes.withColumnRenamed("n", "many")
        sample = copies.join(few, "shard").where(F.pmod(F.xxhash64("node", "shard"), F.col("many")) < LIMIT // 2)

        def fit(t: pa.Table) -> pa.Table:
            own = stacked(t.sort_by("node").column("vec"))
            mine = centroids(own, WAYS)
            top, gap = nearest(own, mine, 2)
            split = len(np.unique(top[:, 0])) > 1 and np.bincount(top[:, 0]).max() < 0.9 * len(own)
            border = float(np.quantile(gap[:, 1], SHARED)) if split else -1.0
            return pa.table({"shard": t.column("shard")[:1], "fit": pa.array([mine.tobytes()], pa.binary()), "border": pa.array([border])})

        fits = materialize(sample.select("shard", "node", "vec").groupBy("shard").applyInArrow(fit, "shard long, fit binary, border double"), "fits")
        joined = with_value(copies.join(few.select("shard"), "shard", "left_semi"), fits.join(sizes, "shard"), "shard", F.col("node"))

        def split(batches):
            """Children by centroid, those near a border to two; where no centroid parts a shard, its
            vectors are dealt by number, and a part of them goes to the next child too."""
            for b in batches:
                own, out = stacked(b.column(2)), []
                nodes, fits_, borders = b.column(0).to_numpy(), b.column(5).to_pylist(), b.column(6).to_numpy()
                shards = b.column(3).to_numpy()
                for s in np.unique(shards):
                    at = np.flatnonzero(shards == s)
                    if borders[at[0]] >= 0:
                        top, gap = nearest(own[at], np.frombuffer(fits_[at[0]]).reshape(-1, own.shape[1]), 2)
                        kid, next_, twice = top[:, 0], top[:, 1], gap[:, 1] <= borders[at[0]]
                    else:
                        mix = nodes[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                        kid = (mix >> np.uint64(40)).astype(np.int64) % WAYS
                        next_, twice = (kid + 1) % WAYS, (mix >> np.uint64(20)).astype(np.int64) % 1024 < SHARED * 1024
                    out.append((at, kid, np.ones(len(at), bool)))
                    out.append((at[twice], next_[twice], np.zeros(twice.sum(), bool)))
                at, kid, main = (np.concatenate(z) for z in zip(*out, strict=True))
                home = b.column(4).to_numpy(zero_copy_only=False)[at] & main
                # a child's number follows from its parent's, so that a task need not ask others
                shard = ((shards[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + kid.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([*(b.column(k).take(pa.array(at)) for k in range(3)), pa.array(shard), pa.array(home)], names=["node", "n", "vec", "shard", "home"])

        parted = joined.select("node", "n", "vec", "shard", "home", "fit", "border").mapInArrow(split, COPY)
        # two copies of a vector can reach one child
        parted = parted.groupBy("node", "shard").agg(F.first("n").alias("n"), F.first("vec").alias("vec"), F.max("home").alias("home")).select("node", "n", "vec", "shard", "home")
        copies = materialize(copies.join(few.select("shard"), "shard", "left_anti").select("node", "n", "vec", "shard", "home").union(parted), "copies")
    raise RuntimeError(f"shards above {LIMIT} vectors are left")


class Graph:
    """A flat graph over the rows of x (unit vectors): lists of up to DEGREE neighbours, -1 beyond."""

    def __init__(self, x: np.ndarray, lists: np.ndarray | None = None):
        self.x = x.astype(np.float32)
        self.lists = np.full((len(x), DEGREE), -1, np.int32) if lists is None else lists
        mean = self.x.mean(axis=0)
        self.medoid = int((self.x @ mean).argmax())

    def search(self, q: np.ndarray, starts: np.ndarray, floor: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
        """Nodes found for each row of q, nearest first (-1 beyond), and their cosines. Each round, all
        searches expand their nearest open nodes within the beam; then the range expands: every node
        within floor is opened, however many there are, until none is left."""
        m, n = len(self.x), len(q)
        seen = np.zeros((n, m + 1), bool)
        seen[:, m] = True  # where lists end
        rows = np.arange(n)
        none = np.zeros((n, 0))
        ids, cos, done = self._met(q, rows, seen, none.astype(np.int32), none.astype(np.float32), none.astype(bool), starts, floor)
        for picks_at_once, within in ((4, False), (32, True)):
            live = rows
            while len(live):
                open_ = ~done[live] & (ids[live] >= 0)
                open_ &= cos[live] >= floor if within else np.arange(ids.shape[1]) < BEAM
                some = open_.any(axis=1)
                live, open_ = live[some], open_[some]
                if not len(live):
                    break
                picks = np.argsort(~open_, axis=1, kind="stable")[:, :picks_at_once]  # beams are in order: the first open ones
                fits = np.take_along_axis(open_, picks, 1)
                own = done[live]
                np.put_along_axis(own, picks, np.take_along_axis(own, picks, 1) | fits, 1)
                nodes = np.where(fits, np.take_along_axis(ids[live], picks, 1), m)
                new = self.lists[np.minimum(nodes, m - 1)]
                new[nodes == m] = -1
                a, b, c = self._met(q[live], live, seen, ids[live], cos[live], own, new.reshape(len(live), -1), floor)
                if a.shape[1] > ids.shape[1]:
                    more = ((0, 0), (0, a.shape[1] - ids.shape[1]))
                    ids, cos, done = np.pad(ids, more, constant_values=-1), np.pad(cos, more, constant_values=-np.inf), np.pad(done, more)
                ids[live], cos[live], done[live] = a, b, c
        return ids, cos

    def _met(self, q, rows, seen, ids, cos, done, new, floor):
        """Beams joined with the new nodes that weren't seen, in order; room is made for all within floor."""
        m = len(self.x)
        new = np.where(new < 0, m, new)
        fresh = np.empty(new.shape, bool)
        for k in range(new.shape[1]):
            fresh[:, k] = ~seen[rows, new[:, k]]
            seen[rows, new[:, k]] = True
        r, k = np.nonzero(fresh)
        to = new[r, k]
        s = np.einsum("pd,pd->p", q[r], self.x[to])
        many = np.bincount(r, minlength=len(rows))
        place = np.arange(len(r)) - np.repeat(np.cumsum(many) - many, many)
        wide = (len(rows), max(int(many.max(initial=0)), 2 * BEAM - ids.shape[1]))
        more_ids, more_cos = np.full(wide, -1, np.int32), np.full(wide, -np.inf, np.float32)
        more_ids[r, place], more_cos[r, place] = to, s
        ids, cos = np.concatenate([ids, more_ids], axis=1), np.concatenate([cos, more_cos], axis=1)
        done = np.concatenate([done, np.zeros(wide, bool)], axis=1)
        width = max(2 * BEAM, ids.shape[1] - wide[1])
        while int((cos >= floor).sum(axis=1).max(initial=0)) + BEAM > width:
            width *= 2
        if width > ids.shape[1]:
            more = ((0, 0), (0, width - ids.shape[1]))
            ids, cos, done = np.pad(ids, more, constant_values=-1), np.pad(cos, more, constant_values=-np.inf), np.pad(done, more)
        order = np.argsort(-cos, axis=1, kind="stable")[:, :width]
        return tuple(np.take_along_axis(v, order, 1) for v in (ids, cos, done))

    def pruned(self, p: np.ndarray, pool: np.ndarray) -> np.ndarray:
        """Robust pruning: from each pool the nearest stays and removes those that lie SLACK times
        nearer to it than to p, until DEGREE stay."""
        pool = np.where(pool == p[:, None], -1, pool)
        own = self.x[pool]
        near = np.matmul(own, self.x[p][:, :, None])[:, :, 0]
        near[pool < 0] = -np.inf
        order = np.argsort(-near, axis=1, kind="stable")[:, :POOL]
        pool, near = np.take_along_axis(pool, order, 1), np.take_along_axis(near, order, 1)
        own = self.x[pool]
        far = np.maximum(0, 2 - 2 * near)
        among = np.maximum(0, 2 - 2 * np.matmul(own, own.transpose(0, 2, 1)))
        # repeats of a node in a pool lie at distance 0 of each other and go as soon as one stays
        alive, out, rows = np.isfinite(near), np.full((len(p), DEGREE), -1, np.int32), np.arange(len(p))
        for k in range(DEGREE):
            first = alive.argmax(axis=1)
            some = alive[rows, first]
            if not some.any():
                break
            out[some, k] = pool[rows, first][some]
            alive &= ~((SLACK * SLACK * among[rows, first] <= far) & some[:, None])
            alive[rows, first] = False
            alive &= pool != pool[rows, first][:, None]
        return out

    def insert(self, batch: np.ndarray, start: int) -> None:
        """Searches the batch's nodes from start, prunes what they found (and each other) to their lists,
        and adds the edges back, pruning lists that overflow."""
        found = self.search(self.x[batch], np.full((len(batch), 1), start, np.int32))[0][:, :BEAM]
        peers = batch[np.argsort(-(self.x[batch] @ self.x[batch].T), axis=1)[:, : min(9, len(batch))]]
        old = self.lists[batch]
        self.lists[batch] = self.pruned(batch, np.concatenate([found, peers.astype(np.int32), old], axis=1))
        src, dst = np.repeat(batch, DEGREE), self.lists[batch].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        if not len(dst):
            return
        gap = -np.einsum("rd,rd->r", self.x[src], self.x[dst])
        order = np.lexsort((gap, dst))
        src, dst = src[order], dst[order]
        to, first, many = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(first, many)
        room = POOL - DEGREE  # the nearest of them; others keep their own edge to it
        back = np.full((len(to), room), -1, np.int32)
        keep = place < room
        back[np.repeat(np.arange(len(to)), many)[keep], place[keep]] = src[keep]
        self.lists[to] = self.pruned(to, np.concatenate([self.lists[to], back], axis=1))

    def build(self) -> Graph:
        """Two passes over the nodes, in batches as large as what is there already."""
        m = len(self.x)
        order = np.random.default_rng(7).permutation(m)
        order = np.concatenate([[self.medoid], order[order != self.medoid]])
        for _ in range(2):
            lo = 1
            while lo < m:
                hi = min(m, lo + min(TOGETHER, lo))
                self.insert(order[lo:hi], self.medoid)
                lo = hi
        return self.tied()

    def tied(self) -> Graph:
        """Each node gets edges from its TIES nearest neighbours, so that no pruning leaves it out of reach:
        lists grow to twice DEGREE; beyond that a node hangs on the last one that found room."""
        m = len(self.x)
        cos = np.stack([np.where(self.lists[:, k] >= 0, np.einsum("rd,rd->r", self.x, self.x[self.lists[:, k]]), -np.inf) for k in range(DEGREE)], axis=1)
        near = np.argsort(-cos, axis=1, kind="stable")[:, :TIES]
        src = np.repeat(np.arange(m), near.shape[1])
        dst, far = np.take_along_axis(self.lists, near, 1).ravel(), -np.take_along_axis(cos, near, 1).ravel()
        src, dst, far = src[dst >= 0], dst[dst >= 0], far[dst >= 0]
        order = np.lexsort((src, far, dst))
        src, dst = src[order], dst[order]
        _, first, many = np.unique(dst, return_index=True, return_counts=True)
        place = np.arange(len(dst)) - np.repeat(first, many)
        hung = place >= DEGREE
        before = np.concatenate([[0], src[:-1]])
        dst, place = np.where(hung, before, dst), np.where(hung, 0, place)
        wide = np.concatenate([self.lists, np.full((m, DEGREE + 1), -1, np.int32)], axis=1)
        wide[dst[~hung], DEGREE + place[~hung]] = src[~hung]
        wide[dst[hung], 2 * DEGREE] = src[hung]
        self.lists = wide
        return self


def built(copies: DataFrame) -> DataFrame:
    """copies with near (nodes of the shard's own list) from a graph of each shard."""

    def one(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        node = t.column("node").to_numpy()
        lists = Graph(stacked(t.column("vec"))).build().lists
        flat, many = lists[lists >= 0], (lists >= 0).sum(axis=1)
        ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
        return t.select(["node", "shard"]).append_column("near", pa.ListArray.from_arrays(pa.array(ends), pa.array(node[flat], pa.int64())))

    return copies.select("node", "shard", "vec").groupBy("shard").applyInArrow(one, "node long, shard long, near array<long>")


def united(copies: DataFrame) -> DataFrame:
    """copies with near, the united lists of the vector in all of its shards, and doors, those shards.
    A vector has few copies, so its lists are short."""
    lists = built(copies)
    both = lists.groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"), F.array_sort(F.collect_set("shard")).alias("doors"))
    return materialize(copies.join(both, "node"), "graph")


FOUND = "kind string, a long, b long, weight long"


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a[k] and b[k] in label, which holds each place's least member."""
    while (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label[:] = label[label]


def searched(graph: DataFrame, asks: DataFrame) -> DataFrame:
    """Searches of (node, vec, shard, entry) in their shards. Rows of kind count: the vectors (weight) that a
    links with, among those whose home the shard is; star: a and b are connected; hop: a goes on in
    the shard b, entering at the node weight. Large lists of searches are dealt over groups, and the
    shard is copied to each."""
    parts = asks.groupBy("shard").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("parts"))
    left = graph.join(parts, "shard").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    right = asks.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts")

    def run(own: pa.Table, ask: pa.Table) -> pa.Table:
        empty = pa.table({"kind": pa.array([], pa.string()), **{c: pa.array([], pa.int64()) for c in ("a", "b", "weight")}})
        if not own.num_rows or not ask.num_rows:
            return empty
        own, ask = own.sort_by("node"), ask.sort_by("ask_node")
        nodes, x = own.column("node").to_numpy(), stacked(own.column("vec"))
        near = own.column("near").combine_chunks()
        flat, ends = near.flatten().to_numpy(), np.diff(near.offsets.to_numpy())
        at = np.searchsorted(nodes, flat)
        at[at == len(nodes)] = 0
        inside = nodes[at] == flat  # edges that lead out are followed in the shards that gave them
        row = np.repeat(np.arange(len(nodes)), ends)[inside]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        lists = np.full((len(nodes), max(DEGREE, int(place.max(initial=0)) + 1)), -1, np.int32)
        lists[row, place] = at[inside]
        g = Graph(x, lists)
        n, home = own.column("n").to_numpy(), own.column("home").to_numpy(zero_copy_only=False)
        door, doors_of = own.column("doors").combine_chunks().flatten().to_numpy(), np.diff(own.column("doors").combine_chunks().offsets.to_numpy())
        door_at, shard = np.cumsum(doors_of) - doors_of, own.column("shard")[0].as_py()
        who, q, entry = ask.column("ask_node").to_numpy(), stacked(ask.column("ask_vec")), ask.column("ask_entry").to_numpy()
        known = np.union1d(nodes, who)
        label, place_of = np.arange(len(known)), np.searchsorted(known, nodes)
        counts, hops = [], []
        for lo in range(0, len(who), TOGETHER):
            mine = slice(lo, lo + TOGETHER)
            start = np.searchsorted(nodes, entry[mine])
            start = np.where(start < len(nodes), start, 0)
            ok = nodes[start] == entry[mine]
            starts = np.stack([np.full(len(start), g.medoid), np.where(ok & (start != g.medoid), start, -1)], axis=1).astype(np.int32)
            ids, cos = g.search(q[mine].astype(np.float32), starts, FLOOR)
            r, k = np.nonzero((ids >= 0) & (cos >= FLOOR - 1e-3))
            if not len(r):
                continue
            to = ids[r, k]
            exact = np.concatenate([np.einsum("rd,rd->r", q[mine][r[z : z + 65536]], x[to[z : z + 65536]]) for z in range(0, len(r), 65536)])
            link = (exact >= LINK) & (nodes[to] != who[mine][r])
            total = np.bincount(r[link & home[to]], n[to[link & home[to]]], len(ids)).astype(np.int64)
            counts.append((who[mine][total > 0], total[total > 0]))
            joined(label, np.searchsorted(known, who[mine])[r[link]], place_of[to[link]])
            out = (exact >= FLOOR) & (doors_of[to] > 1)
            i, j = r[out], to[out]
            step = np.arange(doors_of[j].sum()) - np.repeat(np.cumsum(doors_of[j]) - doors_of[j], doors_of[j])
            i, j, d = np.repeat(i, doors_of[j]), np.repeat(j, doors_of[j]), door[np.repeat(door_at[j], doors_of[j]) + step]
            i, j, d = i[d != shard], j[d != shard], d[d != shard]
            order = np.lexsort((j, d, i))
            i, j, d = i[order], j[order], d[order]
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1]) | (d[1:] != d[:-1])
            hops.append((who[mine][i[new]], d[new], nodes[j[new]]))
        star = np.flatnonzero(label != np.arange(len(label)))
        zero = np.zeros(0, np.int64)
        made = [("count", a, np.zeros_like(a), w) for a, w in counts] + [("star", known[star], known[label[star]], np.zeros(len(star), np.int64))] + [("hop", a, d, e) for a, d, e in hops]
        kind = [kind for kind, a, _, _ in made for _ in range(len(a))]
        return pa.table({"kind": pa.array(kind, pa.string()), **{c: pa.array(np.concatenate([zero, *(row[k] for row in made)]), pa.int64()) for k, c in ((1, "a"), (2, "b"), (3, "weight"))}})

    left, right = left.select("shard", "part", "node", "n", "vec", "home", "near", "doors"), right.select(*(F.col(c).alias(f"ask_{c}") for c in ("shard", "part", "node", "vec", "entry")))
    return left.groupBy("shard", "part").cogroup(right.groupBy("ask_shard", "ask_part")).applyInArrow(run, FOUND)


def links(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, links) of nodes that have some, and edges (a, b) that connect those that links connect.
    Every copy of a vector is searched for in its shard; vectors met there that lie in other shards
    too take the search along, until none leads to a shard that it hasn't seen."""
    asks = graph.select("node", "vec", "shard", F.col("node").alias("entry"))
    asked, found = graph.select("node", "shard"), None
    vecs = graph.where("home").select("node", "vec")
    for _ in range(MOST_HOPS):
        out = materialize(searched(graph, asks), "found")
        found = out if found is None else found.union(out)
        ahead = out.where("kind = 'hop'").groupBy(F.col("a").alias("node"), F.col("b").alias("shard")).agg(F.min("weight").alias("entry")).join(asked, ["node", "shard"], "left_anti")
        ahead = materialize(ahead, "hops")
        if ahead.isEmpty():
            counts = found.where("kind = 'count'").groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("links"))
            return materialize(counts, "links"), found.where("kind = 'star'").select("a", "b")
        asked = asked.union(ahead.select("node", "shard"))
        asks = ahead.join(vecs, "node").select("node", "vec", "shard", "entry")
    raise RuntimeError(f"searches did not end after {MOST_HOPS} shards")


def audited(classes: DataFrame, counts: DataFrame, most: int = AUDITED) -> float:
    """The part of the links of some vectors (about `most`, by hash) that counts has, against a count over
    all vectors in blocks."""
    part = most / max(1, classes.count())
    picked = classes.where(F.pmod(F.xxhash64("node", F.lit("audit")), F.lit(1 << 30)) < part * (1 << 30)).select("node", "vec").limit(2 * most).collect()
    if not picked:
        return 1.0
    nodes, q = np.array([r.node for r in picked]), np.frombuffer(b"".join(bytes(r.vec) for r in picked)).reshape(len(picked), -1)

    def count(batches):
        total = np.zeros(len(nodes), np.int64)
        for b in batches:
            own, x, n = b.column(0).to_numpy(), stacked(b.column(2)), b.column(1).to_numpy()
            for lo in range(0, len(own), 1024):
                hit = (x[lo : lo + 1024] @ q.T >= LINK) & (own[lo : lo + 1024, None] != nodes)
                total += n[lo : lo + 1024] @ hit
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"node": pa.array(nodes[some], pa.int64()), "true": pa.array(total[some])})

    true = classes.select("node", "n", "vec").mapInArrow(count, "node long, true long").groupBy("node").agg(F.sum("true").alias("true"))
    row = true.join(counts, "node", "left").agg(F.sum("true").alias("t"), F.sum("links").alias("f")).first()
    return (row.f or 0) / row.t if row.t else 1.0


def near_duplicates(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """df(vec_id, embedding, ...) -> vec_id, n_links, component_id, kept, a row for each row.

    Vectors link at a cosine of LINK or more, in double precision; copies of a direction are one node
    with a weight, so they are never paired. All nodes are indexed and searched. The part of true
    links found is measured for AUDITED nodes and logged; below ENOUGH all is done again with more
    shards to a vector, and below LEAST with the most of them an error is raised.

    Vectors that are null, empty, zero or hold null or non-finite entries link with nothing and keep
    their own id. Shorter vectors are padded with zeros. Null ids never name a component unless all of
    its ids are null; repeated rows and ids are vectors like others; an empty table gives no rows;
    other columns aren't read."""
    rows, classes = directions(df.select(F.col(key), F.col(vector)), key, vector)
    alone = df.where(~finite(F.col(vector))).select(F.col(key).cast("long").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col(key).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    if classes.isEmpty():
        return alone
    for overlap in OVERLAPS:
        counts, stars = links(united(sharded(classes, overlap)))
        recall = audited(classes, counts)
        logging.getLogger(__name__).warning("vector graph: audited recall %.4f with %d shards to a vector", recall, overlap)
        if recall >= ENOUGH:
            break
    else:
        if recall < LEAST:
            raise RuntimeError(f"the graph finds {recall:.3f} of the links that it should")
    parts = materialize(connected_components(stars), "components")
    named = parts.join(classes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("name"))
    parts = parts.join(named, "component").select("node", "name")
    whole = classes.select("digest", "n", "node", "least").join(parts, "node", "left").join(counts, "node", "left")
    whole = whole.select("digest", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("name", "least").alias("component_id"))
    out = with_value(rows, whole, "digest", F.col("id"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")).union(alone)


ORACLE = f"""
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
f AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS norm FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(e, lambda c: c <> 0)) > 0),
p AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM f a JOIN f b ON a.vec_id <> b.vec_id AND list_inner_product(a.e, b.e) / (a.norm * b.norm) >= {LINK}),
r AS (WITH RECURSIVE w AS (SELECT vec_id AS a, vec_id AS b FROM f UNION SELECT w.a, p.b FROM w JOIN p ON w.b = p.a) SELECT a, min(b) AS least FROM w GROUP BY a)
SELECT vec_id, CAST((SELECT count(*) FROM p WHERE p.a = v.vec_id) AS BIGINT) AS n_links, coalesce(least, vec_id) AS component_id, coalesce(least, vec_id) = vec_id AS kept
FROM v LEFT JOIN r ON r.a = v.vec_id"""
