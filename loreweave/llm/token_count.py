"""Operator 1: token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import bpe
from .common import map_texts

#: Words that a worker remembers the count of, and the longest that it remembers.
REMEMBERED, LONGEST = 1 << 19, 64
#: How byte-level vocabularies cut a text; white space as Unicode has it.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


class Counts(dict):
    """Tokens of a piece: its starting symbols less its merges.  Bounded; no ids are made."""

    def __init__(self, pairs: bpe.PairTable):
        super().__init__()
        self.pairs = pairs

    def __missing__(self, piece: str) -> int:
        raw = piece.encode("utf-8")
        n = len(raw)
        if n > 1:
            n -= self.pairs.merge(self.pairs.symbols(raw))[1]
        if len(raw) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


_counters: dict[str, tuple] = {}


def counter(path: str):
    """A function from text to token count, kept for the life of the worker."""
    if path not in _counters:
        pairs = bpe.load(path)
        special = regex.compile("|".join(regex.escape(s) for s in sorted(pairs.special, key=len, reverse=True))) if pairs.special else None
        _counters[path] = (Counts(pairs), regex.compile(PIECES), special)
    known, pieces, special = _counters[path]

    def count(text: str) -> int:
        parts = special.split(text) if special else [text]
        return len(parts) - 1 + sum(sum(map(known.__getitem__, pieces.findall(p))) for p in parts)

    return count


def count_tokens(
    df: DataFrame, vocabulary: str, text_col: str = "text", limit: int = 1024, drop: tuple[str, ...] = ()
) -> DataFrame:
    """Add ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) to each row.

    ``vocabulary`` is the path of a byte-level ``.json`` file at every worker.  Its
    special strings inside a text are one token each.  A null or empty text has 0
    bytes and 0 tokens.  Every row keeps its other columns, repeated rows stay
    repeated, an empty table gives an empty one, and columns of the three names
    are replaced.  A text is handled whole by one task; nothing is shuffled.
    """

    def run(texts: list[str]) -> list[pa.Array]:
        count = counter(vocabulary)
        n = [count(t) for t in texts]
        return [
            pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()),
            pa.array(n, pa.int64()),
            pa.array([x > limit for x in n], pa.bool_()),
        ]

    return map_texts(df, run, "n_bytes long, n_tokens long, over_limit boolean", text_col, drop)
