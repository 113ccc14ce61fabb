"""Edit-aware token counts: a document keeps a segment tree over its pre-token units. An edit
re-encodes the leaves that hold the units it touches and those beside its borders; leaves split and
merge where they are, and only the sums above them change."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .text import slices

#: Units up to which a node is a leaf, and up to which two leaves become one.
MOST, FEW = 64, 16
PARTS = ["node_chars", "node_tokens", "node_units", "node_left", "node_right"]
COUNTS = ["n_units", "n_tokens", "edited_chars", "edited_tokens", "reencoded_chars", "updated_nodes"]


def measured(ids: bpe.UnitIds, text: str) -> tuple[list[int], list[int]]:
    """Running totals, from 0, of the characters and tokens of the text's units."""
    own = [u for u in bpe.units(text) if u]
    return [0, *accumulate(map(len, own))], [0, *accumulate(len(ids[u]) // 4 for u in own)]


class Tree:
    """Nodes as parallel lists, the root first: characters, tokens and units below, and the two
    children (-1 in leaves)."""

    def __init__(self, *parts: list[int]) -> None:
        self.chars, self.tokens, self.units, self.left, self.right = parts or ([0], [0], [0], [-1], [-1])
        self.updated = 0

    @staticmethod
    def of(ids: bpe.UnitIds, text: str) -> Tree:
        tree = Tree()
        c, t = measured(ids, text)
        tree.fill(0, c, t, 0, len(c) - 1)
        return tree

    def fill(self, node: int, c: list[int], t: list[int], lo: int, hi: int) -> None:
        """Makes the node hold units lo to hi of running totals, halved until a leaf has few enough."""
        todo = [(node, lo, hi)]
        while todo:
            node, lo, hi = todo.pop()
            self.updated += 1
            self.chars[node], self.tokens[node], self.units[node] = c[hi] - c[lo], t[hi] - t[lo], hi - lo
            if hi - lo <= MOST:
                self.left[node] = self.right[node] = -1
                continue
            a, b, mid = len(self.chars), len(self.chars) + 1, (lo + hi) // 2
            for part in (self.chars, self.tokens, self.units):
                part += [0, 0]
            self.left += [-1, -1]
            self.right += [-1, -1]
            self.left[node], self.right[node] = a, b
            todo += [(a, lo, mid), (b, mid, hi)]

    def leaf_at(self, place: int) -> tuple[int, int]:
        """Where the leaf that holds this character starts and ends (the last one beyond the text)."""
        node, start = 0, 0
        while self.left[node] >= 0:
            a = self.left[node]
            if place < start + self.chars[a] or not self.chars[self.right[node]]:
                node = a
            else:
                node, start = self.right[node], start + self.chars[a]
        return start, start + self.chars[node]

    def replace(self, start: int, stop: int, c: list[int], t: list[int]) -> None:
        """Deals units to the leaves that made up characters start to stop, and mends the sums above."""
        own, inner, todo = [], [], [(0, 0)]
        while todo:
            node, at = todo.pop()
            if at >= stop or at + self.chars[node] <= start:
                continue
            if self.left[node] < 0:
                own.append(node)
                continue
            inner.append(node)
            todo += [(self.right[node], at + self.chars[self.left[node]]), (self.left[node], at)]
        n = len(c) - 1
        for k, node in enumerate(own):
            self.fill(node, c, t, k * n // len(own), (k + 1) * n // len(own))
        for node in reversed(inner):  # children come after their parents
            a, b = self.left[node], self.right[node]
            self.updated += 1
            for part in (self.chars, self.tokens, self.units):
                part[node] = part[a] + part[b]
            if self.units[node] <= FEW and self.left[a] < 0 and self.left[b] < 0:
                self.left[node] = self.right[node] = -1

    def columns(self) -> list[list[int]]:
        """The parts, without nodes that merging cut off."""
        order = [0]
        for node in order:
            if self.left[node] >= 0:
                order += [self.left[node], self.right[node]]
        to = {-1: -1} | {node: k for k, node in enumerate(order)}
        return [*([p[k] for k in order] for p in (self.chars, self.tokens, self.units)), *([to[p[k]] for k in order] for p in (self.left, self.right))]


def edit(ids: bpe.UnitIds, text: str, tree: Tree, at: int, drop: int, insert: str) -> tuple[str, int]:
    """The text after `drop` characters at `at` give way to `insert`, and how many characters of it
    were encoded; the tree follows. Context: a unit ends where white space begins, so the leaves
    with the characters just before and just after the edit are encoded again."""
    at = max(0, min(at, len(text)))
    drop = max(0, min(drop, len(text) - at))
    new = text[:at] + insert + text[at + drop :]
    tree.updated = 0
    if not text:
        c, t = measured(ids, new)
        tree.fill(0, c, t, 0, len(c) - 1)
        return new, len(new)
    start, by = tree.leaf_at(max(0, at - 1))[0], len(insert) - drop
    stop = tree.leaf_at(min(at + drop, len(text) - 1))[1]
    # a leaf's border is a unit's border, and stays one as long as the character before it isn't
    # white space and the one after is
    while stop < len(text) and (stop + by <= start or new[stop + by - 1].isspace() or not new[stop + by].isspace()):
        stop = tree.leaf_at(stop)[1]
    c, t = measured(ids, new[start : stop + by])
    tree.replace(start, stop, c, t)
    return new, stop + by - start


def build(docs: DataFrame, path: str | None = None) -> DataFrame:
    """docs(doc_id, text, ...) -> doc_id, text, n_units, n_tokens and the tree's PARTS.

    Null texts count as empty, with no tokens; repeated rows and null ids are kept; an empty table
    gives no rows; extra columns, whatever their names, are dropped."""
    path = path or bpe.default_path()
    schema = "doc_id long, text string, n_units long, n_tokens long, " + ", ".join(f"{p} array<int>" for p in PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = bpe.unit_ids(path)
        for b in slices(batches):
            made = [Tree.of(ids, t or "") for t in b.column(1).to_pylist()]
            counts = [pa.array([x.units[0] for x in made], pa.int64()), pa.array([x.tokens[0] for x in made], pa.int64())]
            parts = [pa.array(p, pa.list_(pa.int32())) for p in zip(*((x.chars, x.tokens, x.units, x.left, x.right) for x in made), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *counts, *parts], names=["doc_id", "text", "n_units", "n_tokens", *PARTS])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def apply_edits(trees: DataFrame, path: str | None = None, keep_trees: bool = False) -> DataFrame:
    """trees as build() gives them, with edit_at, edit_drop (int) and edit_insert (string) -> doc_id
    and COUNTS: units and tokens before, characters and tokens after, characters encoded again, and
    nodes whose sums were set. With keep_trees also text and PARTS after the edit, for further ones.

    A null place is no edit; a null length or insertion is none of it; places beyond the text are
    moved to its end; a null text is empty; an empty table gives no rows; other columns are dropped."""
    path = path or bpe.default_path()
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + (", text string, " + ", ".join(f"{p} array<int>" for p in PARTS) if keep_trees else "")
    names = ["doc_id", *COUNTS, *(["text", *PARTS] if keep_trees else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = bpe.unit_ids(path)
        for b in slices(batches):
            out = []
            for doc_id, text, at, drop, insert, *parts in zip(*(x.to_pylist() for x in b.columns), strict=True):
                tree, text = Tree(*parts), text or ""
                counts, again = (tree.units[0], tree.tokens[0]), 0
                if at is not None:
                    text, again = edit(ids, text, tree, at, drop or 0, insert or "")
                out.append((doc_id, *counts, len(text), tree.tokens[0], again, tree.updated, *([text, *tree.columns()] if keep_trees else [])))
            types = [pa.int64()] * 7 + ([pa.string(), *[pa.list_(pa.int32())] * 5] if keep_trees else [])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return trees.select("doc_id", "text", "edit_at", "edit_drop", "edit_insert", *PARTS).mapInArrow(run, schema)
