import random
import zlib
from collections import defaultdict

import numpy as np
from edge import empty, frame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sharemill.llm import bpe, packing, token_counts


def reference(text, tokenizer=Tokenizer.from_file(bpe.default_path())):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def test_every_id_once_and_no_padding(spark, sf):
    docs = frame(spark, sf).repartition(5)
    docs.cache()
    got = packing.pack(docs).collect()
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(reference(r.text) + [0])
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for doc_id, all_ids in texts.items():
        assert sorted(p.doc_tokens for p in pieces[doc_id] if p.start == 0) == sorted(map(len, all_ids))
        if len(all_ids) == 1:
            own = sorted(pieces[doc_id], key=lambda p: p.start)
            at = 0
            for p in own:
                assert p.start == at and zlib.crc32(np.array(all_ids[0][at : at + p.length], "<u4").tobytes()) == p.ids_crc32
                at += p.length
            assert at == len(all_ids[0]) == own[0].doc_tokens
    seqs = defaultdict(list)
    for r in got:
        seqs[r.sequence_id].append((r.offset, r.length))
    for own in seqs.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024 and at & (at - 1) == 0
    assert packing.pack(empty(spark)).count() == 0


def test_windows_stay_bounded_and_fit_best():
    w = packing.Windows(8, 2)
    assert list(w.add(1, 0, b"0000" * 5, 5)) == [] and list(w.add(2, 0, b"0000" * 6, 6)) == []
    assert [x[0] for x in w.open] == [3, 2]
    full = list(w.add(3, 0, b"0000" * 2, 2))  # fits both, best where 2 are left
    assert [p[0] for p in full[0]] == [2, 3]
    list(w.add(4, 0, b"0000" * 4, 4))
    (done,) = w.add(5, 0, b"0000" * 5, 5)  # fits none: the fullest takes its head
    assert [p[0] for p in done] == [1, 5] and [x[0] for x in w.open] == [2]


EDITS = ((0, 0, "new words "), (3, 5, ""), (10**9, 4, " tail"), (200, 90, "  x\n"), (50, 0, "y"), (None, 3, "no"), (4, None, None), (7, 2, "<|endoftext|>"))


def test_counts_match_a_full_encoding(spark, sf):
    docs = frame(spark, sf)
    texts = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    for at, drop, insert in EDITS:
        trees = token_counts.build(docs).withColumns({"edit_at": F.lit(at).cast("int"), "edit_drop": F.lit(drop).cast("int"), "edit_insert": F.lit(insert)})
        got = sorted(map(tuple, token_counts.apply_edits(trees).select("doc_id", "n_tokens", "edited_chars", "edited_tokens").collect()), key=str)
        want = []
        for doc_id, t in texts:
            new = t if at is None else t[: min(at, len(t))] + (insert or "") + t[min(at, len(t)) + (drop or 0) :]
            want.append((doc_id, len(reference(t)), len(new), len(reference(new))))
        assert got == sorted(want, key=str)
    assert token_counts.build(empty(spark)).count() == 0
    none = token_counts.build(empty(spark)).withColumns({"edit_at": F.lit(1), "edit_drop": F.lit(1), "edit_insert": F.lit("x")})
    assert token_counts.apply_edits(none).count() == 0


def test_edits_follow_each_other(spark):
    edits = {"edit_at": F.lit(5), "edit_drop": F.lit(3), "edit_insert": F.lit(" more words " * 40)}
    trees = token_counts.apply_edits(token_counts.build(frame(spark)).withColumns(edits), keep_trees=True)
    for r in token_counts.apply_edits(trees.withColumns(edits), keep_trees=True).collect():
        assert r.edited_tokens == len(reference(r.text)) == r.node_tokens[0] and r.node_chars[0] == r.edited_chars == len(r.text)


def test_random_edits_keep_the_tree_right():
    ids, rng = bpe.unit_ids(bpe.default_path()), random.Random(4)
    pieces = ["word", " ", "  ", "\n", "don't ", "é", "1 2 3", "x" * 40, " a b c d e f g h" * 12]
    text = "".join(rng.choices(pieces, k=600))
    tree = token_counts.Tree.of(ids, text)
    for _ in range(400):
        at, drop, insert = rng.randrange(len(text) + 5), rng.choice([0, 1, 7, 500]), "".join(rng.choices(pieces, k=rng.choice([0, 1, 4])))
        text, _ = token_counts.edit(ids, text, tree, at, drop, insert)
        assert tree.tokens[0] == len(reference(text)) and tree.chars[0] == len(text) and tree.units[0] == len([u for u in bpe.units(text) if u])
    tree = token_counts.Tree(*tree.columns())
    leaves = [k for k in range(len(tree.chars)) if tree.left[k] < 0]
    assert max(tree.units[k] for k in leaves) <= token_counts.MOST and sum(tree.tokens[k] for k in leaves) == tree.tokens[0]


def test_an_edit_touches_few_characters_and_sums():
    ids = bpe.unit_ids(bpe.default_path())
    text = " ".join(f"word{k}" for k in range(20_000))
    tree = token_counts.Tree.of(ids, text)
    new, again = token_counts.edit(ids, text, tree, 70_000, 6, "another one and some more")
    assert again < 1000 and tree.updated < 40 and tree.tokens[0] == len(reference(new))


def test_unit_borders_are_token_borders():
    ids = bpe.unit_ids(bpe.default_path())
    for t in ("a  b", "a \n b", " lead", "trail ", "tab\tx", "  x", "x\x1cy \x85 z", "don't stop  '", "1 2  3\n\n\n4", "日本 語  です", "x <|endoftext|> y", "a<|endoftext|>b  <|endoftext|>", "<|endof text|>  "):
        assert np.frombuffer(bpe.encode(ids, t), "<u4").tolist() == reference(t), t
