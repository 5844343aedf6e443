"""Operator 6: BPE encoding and decoding, speculate and verify."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import bpe
from .common import map_texts

REMEMBERED, LONGEST = 1 << 19, 64
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\p{White_Space}\p{L}\p{N}]+"
NEVER = np.int64(1) << 40


def normalise(text: str) -> str:
    """NFC and lower case, a character at a time; the word pattern passes over white space of any kind."""
    text = unicodedata.normalize("NFC", text)
    return "".join(c.lower() for c in text) if "Σ" in text else text.lower()


class Codec:
    """Words to ids for one vocabulary whose words end in a suffix."""

    def __init__(self, path: str):
        self.pairs = bpe.load(path)
        special = sorted(self.pairs.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.words = regex.compile(WORDS)
        self.strings = [""] * self.pairs.size
        for s, i in [*self.pairs.vocab.items(), *self.pairs.special.items()]:
            self.strings[i] = s
        self.longest = max(len(s) for s in self.pairs.vocab)
        self.whole: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}

    def exact(self, word: str) -> list[int]:
        return [i for i in self.pairs.merge(self.pairs.symbols(word.encode("utf-8")))[0] if i >= 0]

    def guess(self, word: str) -> list[int]:
        """Greedy longest match over the word's byte signs; the last token carries the suffix."""
        vocab, end = self.pairs.vocab, self.pairs.end
        signs = "".join([self.pairs.signs[b] for b in word.encode("utf-8")])
        out, at, n = [], 0, len(signs)
        while at < n:
            rest = n - at
            if rest <= self.longest and (found := vocab.get(signs[at:] + end)) is not None:
                out.append(found)
                break
            size = min(rest - 1, self.longest)
            while (found := vocab.get(signs[at : at + size])) is None:
                size -= 1
            out.append(found)
            at += size
        return out

    def is_whole(self, token: int) -> bool:
        """Whether the merges of the token's own string give the token."""
        if token not in self.whole:
            s = self.strings[token]
            cut = s[: -len(self.pairs.end)] if self.pairs.end and s.endswith(self.pairs.end) else s
            ids = [self.pairs.vocab[c] for c in cut]
            if cut is not s:
                ids[-1] = self.pairs.vocab[cut[-1] + self.pairs.end]
            self.whole[token] = sum(i >= 0 for i in self.pairs.merge(ids)[0]) == 1
        return self.whole[token]

    def compatible(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """For each pair of neighbours, whether no merge crosses from one into the other.

        Both tokens are taken apart again, the latest merge first; at each moment
        the symbols on either side of the border must have no merge that comes
        before the ones that used them up.
        """
        p = self.pairs
        good = np.ones(len(x), bool)
        x, y = x.copy(), y.copy()
        until_x = np.full(len(x), NEVER)
        until_y = until_x.copy()
        live = np.arange(len(x))
        while len(live):
            a, b = x[live], y[live]
            key = a << bpe.SHIFT | b
            at = np.minimum(np.searchsorted(p.keys, key), len(p.keys) - 1)
            rank = np.where(p.keys[at] == key, p.key_ranks[at], NEVER)
            crossed = (rank < until_x[live]) & (rank <= until_y[live]) & (rank < NEVER)
            good[live[crossed]] = False
            ra, rb = p.rank[a], p.rank[b]
            left = ra > rb
            go = ~crossed & ((ra >= 0) | (rb >= 0))
            l, r = live[go & left], live[go & ~left]
            until_x[l], x[l] = p.rank[x[l]], p.right[x[l]]
            until_y[r], y[r] = p.rank[y[r]], p.left[y[r]]
            live = live[go]
        return good

    def learn(self, words: list[str]) -> None:
        """Encode words not seen before: guess all, test all pairs at once, merge what fails."""
        guesses = [self.guess(w) for w in words]
        flat = np.fromiter((i for g in guesses for i in g), np.int64)
        owner = np.repeat(np.arange(len(words)), [len(g) for g in guesses])
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        keys, back = np.unique(flat[inner] << bpe.SHIFT | flat[inner + 1], return_inverse=True)
        good = self.compatible(keys >> bpe.SHIFT, keys & ((1 << bpe.SHIFT) - 1))[back] if len(keys) else np.ones(0, bool)
        bad = set(owner[inner[~good]].tolist())
        tokens, back = np.unique(flat, return_inverse=True)
        whole = np.array([self.is_whole(t) for t in tokens.tolist()], bool)
        bad.update(owner[~whole[back]].tolist())
        for i, (w, g) in enumerate(zip(words, guesses)):
            self.known[w] = self.exact(w) if i in bad else g

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = []
        for text in texts:
            parts = self.special.split(text) if self.special else [text]
            cut.append([p if i % 2 else self.words.findall(normalise(p)) for i, p in enumerate(parts)])
        fresh = dict.fromkeys(w for parts in cut for p in parts[::2] for w in p)
        fresh = [w for w in fresh if w not in self.known]
        if len(self.known) + len(fresh) > REMEMBERED:  # what follows must not lose words of this batch
            self.known.clear()
            fresh = list(dict.fromkeys(w for parts in cut for p in parts[::2] for w in p))
        for at in range(0, len(fresh), REMEMBERED // 4):
            self.learn(fresh[at : at + REMEMBERED // 4])
        known, out = self.known, []
        for parts in cut:
            ids: list[int] = []
            for i, p in enumerate(parts):
                if i % 2:
                    ids.append(self.pairs.special[p])
                else:
                    for w in p:
                        ids += known[w]
            out.append(ids)
        for w in fresh:
            if len(w) > LONGEST:
                known.pop(w, None)
        if len(known) > REMEMBERED:
            known.clear()
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings with a blank between them, as a vocabulary file without a decoder gives them."""
        return " ".join([self.strings[i] for i in ids])

    def text_of(self, ids: list[int]) -> str:
        """The normalised words that the ids stand for: bytes again, a blank at each word's end."""
        back = {c: b for b, c in enumerate(self.pairs.signs)}
        raw = bytearray()
        for i in ids:
            s = self.strings[i]
            if i in self.pairs.special.values():
                raw += s.encode()
                continue
            ends = bool(self.pairs.end) and s.endswith(self.pairs.end)
            raw += bytes(back[c] for c in (s[: -len(self.pairs.end)] if ends else s)) + b" " * ends
        return raw.decode("utf-8", "replace").rstrip(" ")


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


#: Characters that are encoded at a time, so that a batch of long texts stays small in memory.
BLOCK = 4_000_000


def encode(df: DataFrame, vocabulary: str, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``ids`` (array of int) and ``decoded`` (the tokens' strings, a blank between) to each row.

    ``vocabulary`` is the path of a ``.json`` file at every worker; its special
    strings inside a text become their ids.  A null, empty or blank text has no
    ids and decodes to the empty string.  Other columns and repeated rows stay, an
    empty table gives an empty one, and columns of the two names are replaced.
    A text is handled whole by one task; nothing is shuffled.
    """

    def run(texts: list[str]) -> list[pa.Array]:
        c = codec(vocabulary)
        values, sizes, decoded, block, held = [], [0], [], [], 0
        for i, t in enumerate(texts):
            block.append(t)
            held += len(t)
            if held >= BLOCK or i == len(texts) - 1:
                for ids in c.encode(block):
                    values.append(np.array(ids, np.int32))
                    sizes.append(sizes[-1] + len(ids))
                    decoded.append(c.decode(ids))
                block, held = [], 0
        flat = np.concatenate(values) if values else np.zeros(0, np.int32)
        return [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat)), pa.array(decoded, pa.string())]

    return map_texts(df, run, "ids array<int>, decoded string", text_col, drop)
