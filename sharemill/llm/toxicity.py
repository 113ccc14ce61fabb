"""Toxicity: a bidirectional gated recurrent network with attention pooling over word and character
inputs, trained in numpy on a bounded sample, scoring all overlapping windows of every text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .text import slices

#: Labelled rows fitted on: the first of each label by a hash of doc_id, with their whole texts.
#: These bound the classifier's training alone; scoring reads every text whole.
MOST_TOXIC, MOST_CLEAN = 1000, 2000
#: Words in a window, and from one window's start to the next one's.
WINDOW, STRIDE = 40, 20
HIDDEN, ATTENTION, WORD_DIM, CHAR_DIM, CHAR_BUCKETS = 8, 8, 4, 4, 1 << 17
#: Folds of the sample: a row trains on the odds of words and characters in the other folds, so that
#: it doesn't see its own label. Share of learnt word inputs left out in training, and the weight decay.
FOLDS, DROPOUT, DECAY = 5, 0.5, 0.02
#: Bytes in a piece of ^word$.
GRAMS = (3, 4, 5, 6)
#: Inputs that are counted, not learnt: a word's odds, and the sum and extreme of its pieces' odds.
FIXED = 3
#: Odds count keys of so many documents, with so many more rows in between, less so many errors.
LEAST, PRIOR, CAREFUL = 3, 6.0, 1.5
#: Passes over the sample, more where it is small so that there are at least STEPS steps.
#: The learnt inputs join after the FIRST part of the passes, when the network reads the odds well.
EPOCHS, FIRST, STEPS, BATCH, RATE, SEED, THRESHOLD = 5, 0.6, 96, 128, 0.01, 5, 0.7
#: Words whose inputs a worker remembers, and words whose pieces are taken at a time.
REMEMBERED, BLOCK = 200_000, 1 << 14
WORD = re.compile(r"[^\W_]+(?:['-][^\W_]+)*")


def tokens(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the pieces of ^word$, and the number of pieces of each word."""
    raw = [b"^" + w.encode("utf-8", "surrogatepass") + b"$" for w in words]
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    b = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    word = np.repeat(np.arange(len(raw)), sizes)
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(b))  # bytes to the word's end
    out, of = [], []
    for n in GRAMS:
        size = max(0, len(b) - n + 1)
        h = np.full(size, n, np.uint64)
        for k in range(n):
            h = (h * np.uint64(1099511628211)) ^ b[k : k + size]
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        fits = room[: len(h)] >= n
        out.append((h[fits] >> np.uint64(40)).astype(np.int64) % CHAR_BUCKETS)
        of.append(word[: len(h)][fits])
    ids, of_word = np.concatenate(out), np.concatenate(of)
    order = np.argsort(of_word, kind="stable")
    return ids[order], np.bincount(of_word, minlength=len(raw))


def summed(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of rows, divided by the root of their length."""
    out = np.zeros((len(counts), rows.shape[1]), np.float32)
    has = counts > 0
    if has.any():
        starts = np.r_[0, np.cumsum(counts[has])[:-1]]
        out[has] = np.add.reduceat(rows, starts, axis=0) / np.sqrt(counts[has])[:, None]
    return out


def largest(rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The row of a run that is farthest from zero; zero for empty runs."""
    out = np.zeros((len(counts), rows.shape[1]), np.float32)
    has = counts > 0
    if has.any():
        starts = np.r_[0, np.cumsum(counts[has])[:-1]]
        top, low = np.maximum.reduceat(rows, starts, axis=0), np.minimum.reduceat(rows, starts, axis=0)
        out[has] = np.where(top > -low, top, low)
    return out


def windows(n: int) -> list[tuple[int, int]]:
    """All windows over n words; every word lies in one, most in two. No words: one empty window."""
    return [(s, min(n, s + WINDOW)) for s in range(0, max(1, n - WINDOW + STRIDE), STRIDE)]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters as float32 arrays, with the passes over batches of windows."""

    def __init__(self, vocabulary: dict[str, int], word_odds: np.ndarray, char_odds: np.ndarray, p: dict[str, np.ndarray]) -> None:
        self.vocabulary, self.word_odds, self.char_odds, self.p = vocabulary, word_odds, char_odds, p
        self.scale, self.shift = 1.0, 0.0

    @staticmethod
    def start(vocabulary: dict[str, int], word_odds: np.ndarray, char_odds: np.ndarray) -> Network:
        """word_odds: (folds, words + 1); char_odds: (folds, buckets); the last row is of all folds."""
        rng = np.random.default_rng(SEED)
        d, h = FIXED + WORD_DIM + CHAR_DIM, HIDDEN
        draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        p = {"Ew": np.zeros((len(vocabulary) + 1, WORD_DIM)), "Ec": np.zeros((CHAR_BUCKETS, CHAR_DIM))}
        for way in "fb":
            p |= {f"W{way}": draw(d, 3 * h), f"c{way}": np.zeros(3 * h), f"U{way}": draw(h, 3 * h)}
        p |= {"Wa": draw(2 * h, ATTENTION), "ca": np.zeros(ATTENTION), "va": draw(ATTENTION), "wo": draw(2 * h), "co": np.full(1, -1.0)}
        return Network(vocabulary, word_odds.astype(np.float32), char_odds.astype(np.float32), {k: v.astype(np.float32) for k, v in p.items()})

    def inputs(self, words: list[str], fold: np.ndarray | int = -1, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of words, each with a fold whose labels its odds don't know (-1: all are
        known), with the word rows and character buckets that they come from. keep: a factor for
        the learnt inputs of each word, 0 where they are dropped."""
        wid = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        ids, counts = grams(words) if words else (np.empty(0, np.int64), np.empty(0, np.int64))
        piece = self.char_odds[np.repeat(fold, counts) if isinstance(fold, np.ndarray) else fold, ids][:, None]
        e = self.p["Ew"][wid]
        fixed = [self.word_odds[fold, wid][:, None], summed(piece, counts), largest(piece, counts)]
        return np.concatenate([*fixed, *(x if keep is None else x * keep for x in (e, summed(self.p["Ec"][ids], counts)))], axis=1).astype(np.float32), wid, ids, counts

    def calibrate(self, logit: np.ndarray, y: np.ndarray) -> None:
        """Fits the scale and shift of document logits, the least and greatest targets drawn in by the
        number of rows of each label."""
        pos = y.sum()
        goal = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (len(y) - pos + 2))
        a, b = 1.0, 0.0
        for _ in range(50):
            p = sigmoid(a * logit + b)
            r, v = p - goal, np.maximum(p * (1 - p), 1e-9)
            h = np.array([[(v * logit * logit).sum() + 1e-3, (v * logit).sum()], [(v * logit).sum(), v.sum() + 1e-3]])
            da, db = np.linalg.solve(h, [(r * logit).sum(), r.sum()])
            a, b = a - np.clip(da, -1, 1), b - np.clip(db, -1, 1)
        self.scale, self.shift = float(max(a, 0.1)), float(b)

    def projected(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([x @ self.p["Wf"] + self.p["cf"], x @ self.p["Wb"] + self.p["cb"]], axis=1)

    def table(self, words: list[str], fold: np.ndarray) -> np.ndarray:
        """Projected inputs of many words, some at a time since a word has a dozen pieces or more."""
        out = np.empty((len(words), 6 * HIDDEN), np.float32)
        for lo in range(0, len(words), BLOCK):
            out[lo : lo + BLOCK] = self.projected(self.inputs(words[lo : lo + BLOCK], fold[lo : lo + BLOCK])[0])
        return out

    def run(self, table: np.ndarray, idx: np.ndarray, length: np.ndarray, keep: bool = False):
        """Window logits. table: projected inputs by row; idx: (windows, steps) rows; length: words."""
        n, steps, h = len(idx), idx.shape[1], HIDDEN
        states = np.zeros((n, steps, 2 * h), np.float32)
        trace: dict = {"f": {}, "b": {}}
        live = np.arange(steps)[None, :] < length[:, None]
        for k, way in enumerate("fb"):
            u, s = self.p[f"U{way}"], np.zeros((n, h), np.float32)
            for t in range(steps) if way == "f" else reversed(range(steps)):
                x = table[idx[:, t], 3 * h * k : 3 * h * (k + 1)]
                hu = s @ u
                zr = sigmoid(x[:, : 2 * h] + hu[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * hu[:, 2 * h :])
                new = c + z * (s - c)
                m = live[:, t, None]
                if keep:
                    trace[way][t] = (s, z, r, c, hu[:, 2 * h :])
                s = np.where(m, new, s)
                states[:, t, h * k : h * (k + 1)] = new
        a = np.tanh(states @ self.p["Wa"] + self.p["ca"])
        e = np.where(live, a @ self.p["va"], -1e9)
        e = np.exp(e - e.max(axis=1, keepdims=True)) * live
        w = e / np.maximum(e.sum(axis=1, keepdims=True), 1e-9)
        pooled = (states * w[:, :, None]).sum(axis=1)
        logit = pooled @ self.p["wo"] + self.p["co"][0]
        return (logit, (states, trace, live, a, w, pooled)) if keep else logit

    def gradients(self, words: list[str], idx: np.ndarray, length: np.ndarray, y: np.ndarray, fold: np.ndarray | int = -1, keep: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Cross-entropy and its gradients for a batch of windows over the given words (see inputs())."""
        h, p = HIDDEN, self.p
        x, wid, ids, counts = self.inputs(words, fold, keep)
        table = self.projected(x)
        logit, (states, trace, live, a, w, pooled) = self.run(table, idx, length, keep=True)
        prob = sigmoid(logit)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        d = (prob - y).astype(np.float32) / len(y)
        g["wo"], g["co"][0] = d @ pooled, d.sum()
        dp = d[:, None] * p["wo"]
        ds = w[:, :, None] * dp[:, None, :]
        dw = (states * dp[:, None, :]).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=1, keepdims=True))
        g["va"] = (a * de[:, :, None]).sum(axis=(0, 1))
        da = de[:, :, None] * p["va"] * (1 - a * a)
        g["Wa"], g["ca"] = np.tensordot(states, da, ((0, 1), (0, 1))), da.sum(axis=(0, 1))
        ds += da @ p["Wa"].T
        ds *= live[:, :, None]
        dtable = np.zeros_like(table)
        for k, way in enumerate("fb"):
            u, carry = p[f"U{way}"], np.zeros((len(idx), h), np.float32)
            order = range(idx.shape[1]) if way == "b" else reversed(range(idx.shape[1]))
            for t in order:
                s, z, r, c, hn = trace[way][t]
                m = live[:, t, None]
                dn = (ds[:, t, h * k : h * (k + 1)] + carry) * m
                dz, dc = dn * (s - c) * z * (1 - z), dn * (1 - z) * (1 - c * c)
                dr = dc * hn * r * (1 - r)
                dhu = np.concatenate([dz, dr, dc * r], axis=1)
                g[f"U{way}"] += s.T @ dhu
                carry = np.where(m, dn * z + dhu @ u.T, carry)
                np.add.at(dtable[:, 3 * h * k : 3 * h * (k + 1)], idx[:, t], np.concatenate([dz, dr, dc], axis=1))
        dx = np.zeros_like(x)
        for k, way in enumerate("fb"):
            own = dtable[:, 3 * h * k : 3 * h * (k + 1)]
            g[f"W{way}"], g[f"c{way}"] = x.T @ own, own.sum(axis=0)
            dx += own @ p[f"W{way}"].T
        dx = dx[:, FIXED:] if keep is None else dx[:, FIXED:] * keep
        np.add.at(g["Ew"], wid, dx[:, :WORD_DIM])
        g["Ew"][0] = 0
        np.add.at(g["Ec"], ids, np.repeat(dx[:, WORD_DIM:] / np.sqrt(np.maximum(counts, 1))[:, None], counts, axis=0))
        loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
        return loss, g


def shrunken(t: np.ndarray, c: np.ndarray, pos: int, neg: int) -> np.ndarray:
    """Half the log-odds of counts with label 1 and 0 against the labels' own, as if PRIOR more were
    seen, moved to zero by CAREFUL standard errors."""
    share = (pos + 0.5) / (pos + neg + 1)
    a, b = t + PRIOR * share, c + PRIOR * (1 - share)
    x = np.log(a / b) - np.log(share / (1 - share))
    return np.sign(x) * np.maximum(0, np.abs(x) - CAREFUL * np.sqrt(1 / a + 1 / b)) / 2


def fold_odds(docs: list[np.ndarray], y: np.ndarray, fold: np.ndarray, size: int, least: int) -> np.ndarray:
    """(FOLDS + 1, size): odds of the keys, given as each document's distinct ones, without the rows of
    a fold; then of all rows. Keys in fewer documents than `least` have none."""
    seen = np.zeros((FOLDS, 2, size), np.float32)
    for d, label, f in zip(docs, y.astype(int).tolist(), fold.tolist(), strict=True):
        seen[f, label, d] += 1
    rows = np.array([[((fold == f) & (y == label)).sum() for label in (0, 1)] for f in range(FOLDS)])
    out = []
    for f in [*range(FOLDS), None]:
        own, n = seen.sum(axis=0), rows.sum(axis=0)
        if f is not None:
            own, n = own - seen[f], n - rows[f]
        out.append(np.where(own.sum(axis=0) >= least, shrunken(own[1], own[0], n[1], n[0]), 0))
    return np.array(out, np.float32)


def laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, lengths, document) of all windows of documents given as rows of a table."""
    spans = [(k, s, e) for k, d in enumerate(docs) for s, e in windows(len(d))]
    of = np.fromiter((k for k, _, _ in spans), np.int64, len(spans))
    lengths = np.fromiter((e - s for _, s, e in spans), np.int64, len(spans))
    sizes = np.fromiter(map(len, docs), np.int64, len(docs))
    base = np.r_[0, np.cumsum(sizes)[:-1]]
    flat = np.concatenate([*docs, np.zeros(WINDOW + 1, np.int64)])
    starts = base[of] + np.fromiter((s for _, s, _ in spans), np.int64, len(spans))
    return flat[np.minimum(starts[:, None] + np.arange(WINDOW), len(flat) - 1)].astype(np.int32), lengths, of


def window_logits(net: Network, table: np.ndarray, idx: np.ndarray, length: np.ndarray, block: int = 2048) -> np.ndarray:
    out = np.empty(len(idx), np.float32)
    order = np.argsort(-length, kind="stable")
    for lo in range(0, len(order), block):
        own = order[lo : lo + block]
        steps = max(1, int(length[own[0]]))
        out[own] = net.run(table, idx[own, :steps], length[own])
    return out


def fit(texts: list[str], labels: list[int]) -> Network:
    """Multiple-instance training: a document's label is learnt at its highest window so far, and
    for label 0 at another one too. Odds of words and characters are those of the other folds, so
    a row's own label isn't among its inputs and scores of the sample are close to those of new
    rows; a logistic fit to them then sets what the scores mean. Without both labels the network
    stays near the given share."""
    y = np.array(labels, np.float32)
    own = [tokens(t) for t in texts]
    seen = Counter(w for d in own for w in set(d))
    words = sorted(seen)
    at = {w: k for k, w in enumerate(words)}
    docs = [np.fromiter((at[w] for w in d), np.int64, len(d)) for d in own]
    del own, at
    some = [(x.astype(np.int32), n) for x, n in (grams(words[lo : lo + BLOCK]) for lo in range(0, len(words), BLOCK))]
    ids = np.concatenate([np.empty(0, np.int32), *(x for x, _ in some)])
    counts = np.concatenate([np.empty(0, np.int64), *(n for _, n in some)])
    ends = np.cumsum(counts)
    del some
    keys = [k for k, w in enumerate(words) if seen[w] >= LEAST]
    row = np.zeros(len(words), np.int64)
    row[keys] = np.arange(1, len(keys) + 1)
    vocabulary = {words[k]: n + 1 for n, k in enumerate(keys)}
    fold = np.zeros(len(y), np.int64)
    for label in (0, 1):
        fold[y == label] = np.arange((y == label).sum()) % FOLDS
    word_odds = fold_odds([np.setdiff1d(row[d], 0) for d in docs], y, fold, len(keys) + 1, LEAST)
    pieces = [np.unique(np.concatenate([ids[ends[w] - counts[w] : ends[w]] for w in np.unique(d)])).astype(np.int32) if len(d) else np.empty(0, np.int32) for d in docs]
    char_odds = fold_odds(pieces, y, fold, CHAR_BUCKETS, LEAST)
    del pieces, ids, counts, ends, seen
    net = Network.start(vocabulary, word_odds, char_odds)
    if not len(y) or y.min() == y.max():
        net.p["wo"][:] = 0
        net.p["co"][0] = 3.0 if len(y) and y.min() else -3.0
        return net
    # a word in the texts of several folds has an input vector for each
    docs = [d * FOLDS + f for d, f in zip(docs, fold.tolist(), strict=True)]
    pairs, inverse = np.unique(np.concatenate(docs), return_inverse=True)
    docs = np.split(inverse, np.cumsum([len(d) for d in docs])[:-1])
    pair_words, pair_fold = [words[k] for k in (pairs // FOLDS).tolist()], pairs % FOLDS
    idx, length, of = laid_out(docs)
    rng = np.random.default_rng(SEED)
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    step, epochs = 0, max(EPOCHS, -(-STEPS * BATCH // (2 * len(y))))
    for epoch in range(epochs):
        logit = window_logits(net, net.table(pair_words, pair_fold), idx, length)
        top = np.array([s + int(np.argmax(logit[s:e])) for s, e in zip(starts, np.r_[starts[1:], len(of)], strict=True)])
        spare = rng.integers(0, len(of), len(top))
        pick = np.concatenate([top, spare[y[of[spare]] == 0]])
        rng.shuffle(pick)
        for lo in range(0, len(pick), BATCH):
            b = pick[lo : lo + BATCH]
            used, inv = np.unique(idx[b], return_inverse=True)
            keep = (rng.random((len(used), 1)) >= DROPOUT).astype(np.float32) / (1 - DROPOUT)
            _, g = net.gradients([pair_words[k] for k in used], inv.reshape(len(b), -1), length[b], y[of[b]], pair_fold[used], keep)
            step += 1
            rate = RATE * min(1.0, 2 * (1 - epoch / epochs))
            for k, v in g.items():
                if k in ("Ew", "Ec") and epoch < FIRST * epochs:
                    continue
                m, s = moment[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-7)
                if k in ("Ew", "Ec"):
                    net.p[k] *= 1 - rate * DECAY
    logit = window_logits(net, net.table(pair_words, pair_fold), idx, length)
    net.calibrate(np.maximum.reduceat(logit, starts).astype(np.float64), y)
    net.word_odds, net.char_odds = net.word_odds[-1:], net.char_odds[-1:]
    return net


class Scorer:
    """Scores texts in a worker, remembering the projected inputs of words."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.forget()

    def forget(self) -> None:
        self.rows: dict[str, int] = {}
        self.table = np.zeros((0, 6 * HIDDEN), np.float32)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if len(self.rows) > REMEMBERED:
            self.forget()
        own, rows = [tokens(t) for t in texts], self.rows
        first = len(rows)
        docs = [np.fromiter((rows.setdefault(w, len(rows)) for w in d), np.int64, len(d)) for d in own]
        if len(rows) > first or not first:
            new = list(rows)[first:] or [""]
            self.table = np.concatenate([self.table[:first], self.net.projected(self.net.inputs(new)[0])])
        idx, length, of = laid_out(docs)
        logit = window_logits(self.net, self.table, idx, length)
        best = np.full(len(texts), -np.inf)
        np.maximum.at(best, of, logit)
        return sigmoid(self.net.scale * best + self.net.shift)


_scorers: dict[int, Scorer] = {}


def sample(docs: DataFrame, labels: DataFrame, learn) -> tuple[list[str], list[int]]:
    """The bounded training sample: labelled rows for which learn(doc_id) holds."""
    known = labels.where(F.col("toxic").isNotNull() & learn(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    turn = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("toxic = 1").orderBy(*turn).limit(MOST_TOXIC).unionByName(known.where("toxic = 0").orderBy(*turn).limit(MOST_CLEAN))
    rows = docs.select(F.col("doc_id").cast("long"), "text").where("text is not null").join(F.broadcast(some), "doc_id").select("doc_id", "text", "toxic")
    # however many rows share an id: tasks keep so many at most, which meet in one that isn't the driver
    rows = materialize(rows.orderBy("doc_id", "text").limit(MOST_TOXIC + MOST_CLEAN), "sample")
    rows = sorted(rows.collect(), key=lambda r: (r["doc_id"], r["text"]))
    return [r["text"] for r in rows], [int(r["toxic"]) for r in rows]


def score(docs: DataFrame, net: Network, name: str = "score", slice_rows: int = 200) -> DataFrame:
    """docs(text, ...) with every column kept, and a double of the given name from the whole text. A
    column of that name is replaced."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)  # bounded: embeddings of the sample's words and buckets
    cols = [c for c in docs.columns if c != name]
    schema = docs.select(*cols).schema.add(name, "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        if id(own) not in _scorers:
            _scorers.clear()
            _scorers[id(own)] = Scorer(own)
        scorer = _scorers[id(own)]
        for b in slices(batches):
            texts = b.column(cols.index("text"))
            out = [scorer(texts.slice(k, slice_rows).to_pylist()) for k in range(0, b.num_rows, slice_rows)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else [], pa.float64())], names=[*cols, name])

    return docs.select(*cols).mapInArrow(run, schema)


def learnt(doc_id) -> object:
    """Rows whose labels may be learnt: crc32 of doc_id as text, mod 3, is not 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def documents_scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """-> doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts have one empty window, which scores low; a null doc_id isn't held out;
    repeated rows repeat; an empty table or one without labels of both kinds gets constant scores;
    labels of unknown documents and null labels are ignored; extra columns are ignored."""
    net = fit(*sample(docs, labels, learnt))
    own = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), net)
    held = F.coalesce(~learnt(F.col("doc_id")), F.lit(False))
    return own.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below the threshold, with the columns of docs, whatever their names.

    Null and empty texts and null ids stay as their (low) score says; rows that repeat share their
    fate; an empty table stays empty."""
    net = fit(*sample(docs, labels, learnt))
    return score(docs, net, "__toxicity").where(F.col("__toxicity") < THRESHOLD).select(*docs.columns)
