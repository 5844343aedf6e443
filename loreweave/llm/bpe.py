"""Byte-pair tables and the exact merge that token counting and encoding share."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np

push, pop = heapq.heappush, heapq.heappop
#: Ids take this many bits in a packed pair of symbols.
SHIFT = 20


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in the vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {b: chr(b) for b in shown}
    for i, b in enumerate(b for b in range(256) if b not in signs):
        signs[b] = chr(256 + i)
    return [signs[b] for b in range(256)]


class PairTable:
    """The merges of one vocabulary file, by rank."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.end = model.get("end_of_word_suffix") or ""
        self.signs = byte_alphabet()
        self.size = max([*self.vocab.values(), *self.special.values()]) + 1
        self.left = np.full(self.size, -1, np.int64)
        self.right = np.full(self.size, -1, np.int64)
        self.rank = np.full(self.size, -1, np.int64)
        self.ranks: list[dict[int, int]] = [{} for _ in range(self.size)]
        self.made: list[int] = []
        for r, merge in enumerate(model["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            x, y, made = self.vocab[a], self.vocab[b], self.vocab[a + b]
            self.ranks[x][y] = r
            self.made.append(made)
            if self.rank[made] < 0:
                self.left[made], self.right[made], self.rank[made] = x, y, r
        self.plain = [self.vocab[c] for c in self.signs]
        self.final = [self.vocab[c + self.end] for c in self.signs]
        found = np.array([(x << SHIFT | y, r) for x, row in enumerate(self.ranks) for y, r in row.items()], np.int64)
        self.keys, self.key_ranks = found[np.argsort(found[:, 0])].T.copy()

    def symbols(self, word: bytes) -> list[int]:
        """The starting symbols of a word that is not empty."""
        out = [self.plain[b] for b in word]
        out[-1] = self.final[word[-1]]
        return out

    def merge(self, ids: list[int]) -> tuple[list[int], int]:
        """Merge the lowest-rank adjacent pair, the leftmost of equals, until none is left.

        A heap holds the pairs and two arrays link the living symbols; a popped
        pair whose symbols have changed since is passed over.  Returns the symbol
        slots (dead ones are -1) and the number of merges.
        """
        ranks, made, n = self.ranks, self.made, len(ids)
        heap, x = [], ids[0]
        for i, y in enumerate(ids[1:]):
            if (r := ranks[x].get(y)) is not None:
                heap.append(r << 32 | i)
            x = y
        if not heap:
            return ids, 0
        heapq.heapify(heap)
        after, before, merges = [*range(1, n + 1)], [*range(-1, n - 1)], 0
        while heap:
            top = pop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            x = ids[i]
            if x < 0 or (j := after[i]) >= n or ranks[x].get(ids[j]) != r:
                continue
            x = ids[i] = made[r]
            ids[j] = -1
            merges += 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := ranks[x].get(ids[k])) is not None:
                    push(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := ranks[ids[h]].get(x)) is not None:
                push(heap, r << 32 | h)
        return ids, merges


@lru_cache(maxsize=4)
def load(path: str) -> PairTable:
    """One table for each worker process and file."""
    return PairTable(path)
