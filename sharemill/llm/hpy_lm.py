"""Language-model scores from a hierarchical Pitman-Yor model. A token's restaurant is that of the word
before it; all restaurants share one parent over words, whose base is uniform. Customers are seated
by Gibbs sweeps, and the predictive probabilities of several sweeps are averaged.

Restaurants are 2^16: words whose hashes agree in 16 bits share one, so that what restaurants tell
each other between sweeps has a bound. Texts are coded in chunks against the chunk's own words. What
travels between chunks and the model are arrays of a chunk's words by word bucket: counts one way,
probabilities the other."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, shuffle_partitions
from .text import SEED, words

#: Restaurants: the upper BITS of the hash of the word before; START is that of none.
BITS = 16
CONTEXTS, START = 1 << BITS, 0
#: Bytes of text in a chunk; bytes of all texts to a bucket of words; chunks whose counts meet at a time.
CHUNK, BUCKET, FAN = 24 << 20, 16 << 20, 64
#: Packed bytes that chunks ask of a bucket up to which one group answers them, and buckets up to which
#: their numbers of groups are broadcast.
PART, MOST_BUCKETS = 32 << 20, 1 << 20
#: Rounds before averaging and rounds averaged, after each of which totals are exchanged; sweeps a round.
BURN, SAMPLES, LOCAL = 1, 2, 2
#: Concentrations of the restaurants and of their parent; customers of a word in a restaurant up to
#: which they leave and come again one at a time, with their tables' sizes; draws taken at once for others.
THETA, THETA_PARENT, SINGLY, AT_ONCE = 20.0, 50.0, 32, 1 << 20
END = b""

CODED = "kind int, chunk long, bucket int, doc_id long, held_out boolean, n_tokens int, codes binary, ws binary, at binary, sizes binary, ctxs binary, ns binary"
CODED_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), *[pa.binary()] * 6]
MODEL = "bucket int, part long, ws binary, sizes binary, ctxs binary, ns binary"
MODEL_TYPES = [pa.int32(), pa.int64(), *[pa.binary()] * 4]
ANSWER = "chunk long, at binary, sizes binary, cs binary, logs binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"


def packed(a: np.ndarray) -> bytes:
    """An array's bytes, those of like weight together, which compresses well."""
    planes = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes() if len(a) else b""
    return len(a).to_bytes(8, "little") + (pa.compress(planes, codec="zstd", asbytes=True) if planes else b"")


def unpacked(raw: bytes, dtype: str) -> np.ndarray:
    n, size = int.from_bytes(raw[:8], "little"), np.dtype(dtype).itemsize
    if not n:
        return np.empty(0, dtype)
    planes = pa.decompress(raw[8:], decompressed_size=n * size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(size, n).T).view(dtype)[:, 0]


def all_of(col: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.concatenate([np.empty(0, dtype), *(unpacked(x, dtype) for x in col.to_pylist())])


def names(schema: str) -> list[str]:
    return [x.split(" ")[0] for x in schema.split(", ")]


def record(rows: list[tuple], schema: str, types: list) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in types]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names(schema))


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


class Chunk:
    """Codes texts against their own words until it is full."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {END: 0}
        self.docs: list[tuple[int | None, bool, np.ndarray]] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        known = self.vocabulary
        own = words(text)
        ids = [known.setdefault(w, len(known)) for w in own]
        self.docs.append((doc_id, held_out(doc_id), np.array([*ids, 0], np.uint32)))
        self.bytes += sum(map(len, own)) + len(own) + 8

    def rows(self, chunk: int, buckets: int) -> Iterator[list[tuple]]:
        """Coded documents, whose codes are places in the chunk's list of (word, class before it),
        then that list by word bucket with its counts over training texts."""
        lengths = np.fromiter((len(d[2]) for d in self.docs), np.int64, len(self.docs))
        flat = np.concatenate([d[2] for d in self.docs]).astype(np.int64)
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in self.vocabulary), np.uint64, len(self.vocabulary))
        ctx = np.r_[START, (hashes >> np.uint64(64 - BITS)).astype(np.int64)[flat[:-1]]]
        ctx[np.r_[0, np.cumsum(lengths)[:-1]]] = START
        pairs, inv = np.unique(flat * CONTEXTS + ctx, return_inverse=True)
        train = np.repeat([not d[1] for d in self.docs], lengths)
        n = np.bincount(inv[train], minlength=len(pairs)).astype("<i8")
        inv, ends = inv.astype("<u4"), np.cumsum(lengths)
        out = []
        for (doc_id, held, _), lo, hi in zip(self.docs, np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
            out.append((0, chunk, None, doc_id, held, hi - lo, packed(inv[lo:hi]), *[None] * 5))
            if len(out) >= 2000:
                yield out
                out = []
        yield out
        word, cls = pairs // CONTEXTS, (pairs % CONTEXTS).astype("<u2")
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sizes = np.diff(np.r_[first, len(pairs)]).astype("<u4")
        w = hashes[word[first]]
        bucket = (w % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(bucket, minlength=buckets))]
        out = []
        for b in range(buckets):
            own = order[cuts[b] : cuts[b + 1]]
            if len(own):
                at = ranges(first[own], sizes[own])
                steps = np.diff(np.r_[0, first[own]]).astype("<u4")  # places rise within a bucket
                out.append((1, chunk, b, None, None, None, None, packed(w[own]), packed(steps), packed(sizes[own]), packed(cls[at]), packed(n[at])))
        yield out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, one after the other."""
    sizes = sizes.astype(np.int64)
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts.astype(np.int64) - (ends - sizes), sizes)


def coded(docs: DataFrame, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunk = Chunk(), TaskContext.get().partitionId() << 32
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                own.add(doc_id, text.as_py())
                if own.bytes >= CHUNK:
                    yield from (record(r, CODED, CODED_TYPES) for r in own.rows(chunk, buckets) if r)
                    own, chunk = Chunk(), chunk + 1
        if own.docs:
            yield from (record(r, CODED, CODED_TYPES) for r in own.rows(chunk, buckets) if r)

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, CODED), "coded")


def counted(t: pa.Table) -> pa.Table:
    """Some chunks' words of a bucket, or counts of those: counts by word and restaurant over training
    texts, under the number of the next group that they belong to."""
    ws, sizes = all_of(t.column("ws"), "<u8"), all_of(t.column("sizes"), "<u4")
    w, c, n = np.repeat(ws, sizes), all_of(t.column("ctxs"), "<u2"), all_of(t.column("ns"), "<i8")
    w, c, n = w[n > 0], c[n > 0], n[n > 0]
    order = np.lexsort((c, w))
    w, c, n = w[order], c[order], n[order]
    new = np.flatnonzero(np.r_[True, (w[1:] != w[:-1]) | (c[1:] != c[:-1])]) if len(w) else np.empty(0, np.int64)
    n = np.add.reduceat(n, new) if len(new) else n
    w, c = w[new], c[new]
    first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[first, len(w)]).astype("<u4")
    rows = [(t.column("bucket")[0].as_py(), t.column("part")[0].as_py() // FAN, packed(w[first]), packed(sizes), packed(c), packed(n))]
    return pa.Table.from_batches([record(rows, MODEL, MODEL_TYPES)])


def model_of(asked: DataFrame, groups: int, parts: int) -> DataFrame:
    """One row a bucket: the counts of a bucket's parts first, then FAN of those at a time, so no task
    reads the counts of all chunks."""
    own = asked.select("bucket", "part", "ws", "sizes", "ctxs", "ns")
    while True:
        own = own.repartition(max(groups, shuffle_partitions(asked.sparkSession)), "bucket", "part").groupBy("bucket", "part").applyInArrow(counted, MODEL)
        if parts == 1:
            return materialize(own, "words")
        parts = -(-parts // FAN)


def dealt(asked: DataFrame) -> tuple[DataFrame, DataFrame, int, int]:
    """asked with part, (bucket, parts), and the sum and the most of parts: a bucket has as many parts as
    the bytes that are asked of it need, so only those of frequent words have several."""
    size = F.sum(F.length("ws") + F.length("sizes") + F.length("ctxs") + F.length("ns"))
    parts = materialize(asked.groupBy("bucket").agg(F.greatest(F.lit(1), F.ceil(size / PART)).cast("int").alias("parts")), "parts")
    n, groups, most = parts.agg(F.count("*"), F.sum("parts"), F.max("parts")).first()
    few = F.broadcast(parts) if n <= MOST_BUCKETS else parts
    asked = asked.join(few, "bucket").withColumn("part", F.pmod(F.xxhash64("chunk"), F.col("parts")).cast("long")).drop("parts")
    return asked, few, groups or 1, most or 1


def hashed(w: np.ndarray, c: np.ndarray, sweep: int, step: int | np.ndarray) -> np.ndarray:
    """64 bits for each word and restaurant, the same on any machine and in any order."""
    with np.errstate(over="ignore"):
        x = w ^ (c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ np.asarray((sweep << 40) + (step << 8) + SEED).astype(np.uint64)
        for k, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(k))) * np.uint64(m)
    return x ^ (x >> np.uint64(31))


def uniform(w: np.ndarray, c: np.ndarray, sweep: int, step: int | np.ndarray) -> np.ndarray:
    """A number in [0, 1) for each."""
    return (hashed(w, c, sweep, step) >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def two_uniform(w: np.ndarray, c: np.ndarray, sweep: int, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers in [0, 1) for each, of 32 bits."""
    x = hashed(w, c, sweep, step)
    return (x >> np.uint64(32)).astype(np.float64) / (1 << 32), x.astype(np.uint32).astype(np.float64) / (1 << 32)


def seated(w: np.ndarray, c: np.ndarray, customers: np.ndarray, new: np.ndarray, discount: float, sweep: int) -> np.ndarray:
    """Tables after the customers of a dish left and came again, one at a time. new: weight of a new table,
    all else given. Customer k opens a table if its draw is below new / (new + k - discount * tables). Of
    later customers, in blocks of doubling length, only those are looked at whose draw is below what it
    could be with as many tables as can be open by then; the others sit down at tables that there are."""
    tables = np.minimum(customers, 1).astype(np.float64)
    live = np.flatnonzero(customers > 1)
    for k in range(1, SINGLY):
        if not len(live):
            return tables
        t, a = tables[live], new[live]
        tables[live] += uniform(w[live], c[live], sweep, k) * (a + k - discount * t) < a
        live = live[customers[live] > k + 1]
    lo = SINGLY
    while len(live):
        n = (np.minimum(customers[live], 2 * lo) - lo).astype(np.int64)
        ends = np.cumsum(n)
        for first, last in slices(ends, AT_ONCE):
            own, size = live[first:last], n[first:last]
            for start in range(0, int(size.max()), AT_ONCE):  # a longer block of one dish in parts
                come(tables, own, np.clip(size - start, 0, AT_ONCE), lo + start, w, c, new, discount, sweep)
        lo *= 2
        live = live[customers[live] > lo]
    return tables


def slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of items whose sizes, of which ends are the running sums, make up `most`, or one item each."""
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, to
        at = to


def come(tables: np.ndarray, own: np.ndarray, size: np.ndarray, lo: int, w: np.ndarray, c: np.ndarray, new: np.ndarray, discount: float, sweep: int) -> None:
    """The customers lo, lo + 1, ..., so many of each of `own`, come in turn."""
    of = np.repeat(np.arange(len(own)), size)
    k = ranges(np.full(len(own), lo), size)
    a, before = new[own], tables[own]
    u = uniform(w[own][of], c[own][of], sweep, k)
    can = np.flatnonzero(u * (a[of] + k - discount * (before[of] + (k - lo))) < a[of])
    of, k, u = of[can], k[can], u[can]
    left = np.bincount(of, minlength=len(own))
    at = np.cumsum(left) - left
    todo, i = np.flatnonzero(left), 0
    while len(todo):  # the i-th of each dish's that are looked at
        j, t = at[todo] + i, tables[own[todo]]
        tables[own[todo]] += u[j] * (a[todo] + k[j] - discount * t) < a[todo]
        i += 1
        todo = todo[left[todo] > i]


def take(tables: np.ndarray, u: np.ndarray) -> None:
    """A customer leaves each column of table sizes, all customers alike."""
    cum = np.cumsum(tables, axis=0)
    j = np.minimum((cum <= u * cum[-1]).sum(axis=0), len(tables) - 1)
    tables[j, np.arange(tables.shape[1])] -= 1


def place(tables: np.ndarray, new: np.ndarray, discount: float, u: np.ndarray) -> None:
    """A customer comes to each column: to a table by its size less the discount, or to a new one."""
    cum = np.cumsum(np.where(tables > 0, tables - discount, 0.0), axis=0)
    j = (cum <= u * (cum[-1] + new)).sum(axis=0)
    opens = np.flatnonzero(j == len(tables))
    j[opens] = np.argmin(tables[:, opens], axis=0)
    tables[j, np.arange(tables.shape[1])] += 1


class Words:
    """A bucket's words with their seating: pairs of word and restaurant, and words in the parent."""

    def __init__(self, ws: bytes, sizes: bytes, ctxs: bytes, ns: bytes) -> None:
        self.w = unpacked(ws, "<u8")
        self.sizes = unpacked(sizes, "<u4").astype(np.int64)
        self.c, self.n = unpacked(ctxs, "<u2").astype(np.int64), unpacked(ns, "<i8")
        self.of = np.repeat(np.arange(len(self.w)), self.sizes)
        self.pair_w = self.w[self.of]
        self.t = np.ones(len(self.n))
        self.root = np.ones(len(self.w))
        order = np.argsort(self.n, kind="stable")
        cuts = np.searchsorted(self.n[order], np.arange(2, SINGLY + 2))
        #: Pairs of each number of customers with the sizes of their tables; all sit at one at first.
        self.few = [(order[lo:hi], np.eye(k, 1, dtype=np.float32).repeat(hi - lo, axis=1) * k) for k, lo, hi in zip(range(2, SINGLY + 1), cuts, cuts[1:], strict=False) if hi > lo]
        self.many = order[cuts[-1] :]

    def customers(self) -> np.ndarray:
        return np.bincount(self.of, self.t, minlength=len(self.w))

    def parent(self, g: dict) -> np.ndarray:
        """The parent's probability of each word, given totals."""
        return (self.customers() - g["d0"] * self.root + (THETA_PARENT + g["d0"] * g["T0"]) / (g["V"] + 1)) / (THETA_PARENT + g["T"].sum())

    def sweep(self, k: int, g: dict) -> None:
        """Each customer of a word with few in its restaurant leaves and comes again, one at a time;
        restaurants' totals and the parent's probabilities are those of the last exchange and sweep.
        Of words with many all leave first and come again in turn by seated(), and so in the parent."""
        new = (THETA + g["d"] * g["T"][self.c]) * self.parent(g)[self.of]
        for own, tables in self.few:
            w, c, a = self.pair_w[own], self.c[own], new[own]
            for step in range(len(tables)):
                leaves, comes = two_uniform(w, c, k, step)
                take(tables, leaves)
                place(tables, a, g["d"], comes)
            self.t[own] = (tables > 0).sum(axis=0)
        m = self.many
        self.t[m] = seated(self.pair_w[m], self.c[m], self.n[m], new[m], g["d"], k)
        up = np.full(len(self.w), (THETA_PARENT + g["d0"] * g["T0"]) / (g["V"] + 1))
        self.root = seated(self.w, np.full(len(self.w), CONTEXTS), self.customers(), up, g["d0"], k)

    def round(self, j: int, g: dict) -> None:
        for k in range(LOCAL):
            self.sweep(j * LOCAL + k, g)

    def totals(self) -> dict[int, float]:
        """Tables by restaurant, under CONTEXTS those of the parent."""
        t = np.bincount(self.c, self.t, minlength=CONTEXTS)
        at = np.flatnonzero(t)
        return dict(zip([*at.tolist(), CONTEXTS], [*t[at].tolist(), float(self.root.sum())], strict=True))


def lift(g: dict) -> np.ndarray:
    """What each restaurant hands to its parent."""
    return (THETA + g["d"] * g["T"]) / (THETA + g["C"])


def added(model: DataFrame, tell) -> dict[int, float]:
    """Sums by key of what tell(words) says of each bucket; keys are restaurants and a few more, so
    the driver gets as many numbers as those, whatever the data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                said = tell(Words(*row))
                yield pa.RecordBatch.from_arrays([pa.array(list(said), pa.int32()), pa.array(list(said.values()), pa.float64())], names=["k", "v"])

    sums = model.select("ws", "sizes", "ctxs", "ns").mapInArrow(run, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).toArrow()
    return dict(zip(sums.column(0).to_pylist(), sums.column(1).to_pylist(), strict=True))


def spread(found: dict[int, float], base: int = 0) -> np.ndarray:
    """Values by restaurant, from those under keys from base on."""
    out = np.zeros(CONTEXTS)
    at = [k for k in found if base <= k < base + CONTEXTS]
    out[np.array(at, np.int64) - base] = [found[k] for k in at]
    return out


def statistics(model: DataFrame) -> dict:
    """Training tokens, distinct words, customers by restaurant and discounts, over all buckets."""

    def tell(x: Words) -> dict[int, float]:
        k, c = x.customers(), np.bincount(x.c, x.n, minlength=CONTEXTS)
        at = np.flatnonzero(c)
        counts = {-1: len(x.w), -2: (x.n == 1).sum(), -3: (x.n == 2).sum(), -4: (k == 1).sum(), -5: (k == 2).sum()}
        return x.totals() | dict(zip((at + 2 * CONTEXTS).tolist(), c[at].tolist(), strict=True)) | {a: float(b) for a, b in counts.items()}

    s = added(model, tell)
    v, n1, n2, m1, m2 = (s.get(-k, 0.0) for k in range(1, 6))
    share = lambda a, b: min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5
    c = spread(s, 2 * CONTEXTS)
    return {"N": int(c.sum()), "V": int(v), "C": c, "d": share(n1, n2), "d0": share(m1, m2), "T": spread(s), "T0": s.get(CONTEXTS, 0.0)}


def sampled(model: DataFrame) -> list[dict]:
    """Totals before and after each round. A round takes others' totals as they were after the last
    one; words hold nothing between jobs: seatings follow from counts, totals and hashes, so they
    are made again and a lost executor costs no more than its share."""
    known = [statistics(model)]
    for _ in range(BURN + SAMPLES):

        def tell(x: Words, so_far=tuple(known)) -> dict[int, float]:
            for j, g in enumerate(so_far):
                x.round(j, g)
            return x.totals()

        s = added(model, tell)
        known.append(known[0] | {"T": spread(s), "T0": s.get(CONTEXTS, 0.0)})
    return known


def answers(known: list[dict]):
    """For a bucket: the chunks' words with their training counts and log10 probabilities."""

    def run(asked: pa.Table, model: pa.Table) -> pa.Table:
        row = [model.column(k)[0].as_py() if model.num_rows else bytes(8) for k in ("ws", "sizes", "ctxs", "ns")]
        x = Words(*row)
        seen, parent = np.zeros(len(x.n)), []
        for j in range(BURN + SAMPLES):
            x.round(j, known[j])
            if j >= BURN:
                g = known[j + 1]
                p, up = x.parent(g), lift(g)
                parent.append((p, up, (THETA_PARENT + g["d0"] * g["T0"]) / (g["V"] + 1) / (THETA_PARENT + g["T"].sum())))
                seen += ((x.n - g["d"] * x.t) / (THETA + g["C"][x.c]) + up[x.c] * p[x.of]) / SAMPLES
        total = np.bincount(x.of, x.n, minlength=len(x.w)).astype(np.int64)
        keys, out = x.of * CONTEXTS + x.c, []
        for chunk, ws, at, sizes, ctxs in zip(*(asked.column(k).to_pylist() for k in ("chunk", "ws", "at", "sizes", "ctxs")), strict=True):
            w, c, n = unpacked(ws, "<u8"), unpacked(ctxs, "<u2").astype(np.int64), unpacked(sizes, "<u4")
            place_ = np.minimum(np.searchsorted(x.w, w), max(0, len(x.w) - 1))
            known_word = x.w[place_] == w if len(x.w) else np.zeros(len(w), bool)
            pair, has = np.repeat(place_, n), np.repeat(known_word, n)
            prob = np.zeros(len(c))
            for p, up, none in parent:
                prob += up[c] * (np.where(has, p[pair], none) if len(p) else none) / SAMPLES
            if len(keys):
                k = np.minimum(np.searchsorted(keys, pair * CONTEXTS + c), len(keys) - 1)
                hit = has & (keys[k] == pair * CONTEXTS + c)
                prob[hit] = seen[k[hit]]
            counts = np.where(known_word, total[place_], 0) if len(total) else np.zeros(len(w), np.int64)
            out.append((chunk, at, sizes, packed(counts.astype("<i8")), packed(np.log10(prob).astype("<f4"))))
        return pa.Table.from_batches([record(out, ANSWER, [pa.int64(), *[pa.binary()] * 4])])

    return run


def scores(n_train: int, n_distinct: int):
    """For a chunk: its documents' scores from the answers to its words."""

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        sizes = all_of(told.column("sizes"), "<u4")
        first = np.concatenate([np.empty(0, np.int64), *(np.cumsum(unpacked(x, "<u4"), dtype=np.int64) for x in told.column("at").to_pylist())])
        at = ranges(first, sizes)
        logs, counts = np.zeros(len(at)), np.zeros(len(at), np.int64)
        logs[at], counts[at] = all_of(told.column("logs"), "<f4"), np.repeat(all_of(told.column("cs"), "<i8"), sizes)
        base = np.log10((counts + 1) / (n_train + n_distinct + 1))
        out = []
        for doc_id, held, n, codes in zip(*(docs.column(k).to_pylist() for k in ("doc_id", "held_out", "n_tokens", "codes")), strict=True):
            own = unpacked(codes, "<u4")
            total = float(logs[own].sum())
            out.append((doc_id, held, n, int((counts[own] > 0).sum()), n_train, float(base[own].sum()), total, float(10 ** min(300.0, -total / n))))
        return pa.Table.from_batches([record(out, SCORED, [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 3])])

    return run


def score(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score,
    score, perplexity, for every row.

    Words are compared by 64-bit hashes. A null or empty text is one end token; a null doc_id is
    trained on; repeated rows count as often as they come; if nothing is trained on, all words
    are unknown; an empty table gives no rows; extra columns are ignored."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(shuffle_partitions(docs.sparkSession), -(-size // BUCKET))
    whole = coded(docs, buckets)
    asked, parts, groups, most = dealt(whole.where("kind = 1"))
    chunks = max(1, asked.select("chunk").distinct().count())
    model = model_of(asked, groups, most)
    known = sampled(model)
    each = model.drop("part").join(parts, "bucket").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).drop("parts")
    # as many tasks as groups of bounded size, however few partitions a shuffle has by default
    deal = lambda df, n, *by: df.repartition(max(n, shuffle_partitions(docs.sparkSession)), *by).groupBy(*by)
    words_asked = asked.select("bucket", "part", "chunk", "ws", "at", "sizes", "ctxs")
    told = deal(words_asked, groups, "bucket", "part").cogroup(deal(each, groups, "bucket", "part")).applyInArrow(answers(known), ANSWER)
    texts = whole.where("kind = 0").select("chunk", "doc_id", "held_out", "n_tokens", "codes")
    return deal(texts, chunks, "chunk").cogroup(deal(told, chunks, "chunk")).applyInArrow(scores(known[0]["N"], known[0]["V"]), SCORED)
