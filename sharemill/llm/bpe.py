"""Byte-pair encoding in tasks, with a bounded memory of units that were encoded before.

A unit is a run of white space and the run of other characters after it. The vocabulary's own
split never joins the two sides of a unit's border, so a text's ids are those of its units."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterable

import numpy as np

DEFAULT = "byte_bpe_50k.json"
#: Units remembered by a worker; beyond that its memory starts afresh.
REMEMBERED = 400_000
UNIT = re.compile(r"\s*\S+|\s+")
ADJACENT = re.compile(r"\s\s")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


class UnitIds(dict):
    """unit -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        ranks = path.removesuffix(".json") + ".tiktoken"
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = self.by_tokenizer
        if path.endswith(".json") and os.path.exists(ranks):  # the same vocabulary, as ranks: faster
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                own = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own, special_tokens={}).encode_ordinary

    def by_tokenizer(self, unit: str) -> list[int]:
        return self.tokenizer.encode(unit, add_special_tokens=False).ids

    def encode(self, unit: str) -> list[int]:
        """The tokenizer's ids. Its added tokens hold no white space, so they lie within units, and
        units that hold one are left to it."""
        return (self.by_tokenizer if any(x in unit for x in self.added) else self.plain)(unit)

    def __missing__(self, unit: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        out = np.asarray(self.encode(unit), "<u4").tobytes()
        if len(unit) <= 64:
            self[unit] = out
        return out


_made: dict[str, UnitIds] = {}


def unit_ids(path: str) -> UnitIds:
    """One per worker process and vocabulary."""
    if path not in _made:
        _made[path] = UnitIds(path)
    return _made[path]


def units(text: str) -> Iterable[str]:
    """The units, in order; where no two white-space characters meet, one space or line break at a
    time is enough to cut at, which is faster."""
    if ADJACENT.search(text) or "\x01" in text:
        return UNIT.findall(text)
    return text.replace("\n", "\x01\n").replace(" ", "\x01 ").split("\x01")


def encode(ids: UnitIds, text: str) -> bytes:
    return b"".join(map(ids.__getitem__, units(text)))
