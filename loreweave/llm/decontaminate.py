"""Operator 10: benchmark decontamination by size-partitioned MinHash containment search."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import fresh, map_texts, stored

SHINGLE, THRESHOLD = 5, 0.8
#: Words are runs of ASCII letters and digits and of any characters beyond ASCII, in lower case.
WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")
#: Bytes of benchmark text that are sent to the workers at once; a larger benchmark is searched in blocks of this size.
INDEX_BYTES = 8 << 20
#: Bytes of documents that are hashed at a time.
BLOCK = 2 << 20
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

IN_WORD = np.zeros(256, bool)
IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64."""
    inverse = pow(int(MULTIPLIER), -1, 1 << 64)
    up = np.full(n, MULTIPLIER)
    down = np.full(n, np.uint64(inverse))
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * MIX
    return h ^ (h >> np.uint64(29))


class Hasher:
    """Hashes of all word shingles of many texts at once."""

    def __init__(self):
        self.up, self.down = powers(1 << 16)

    def shingles(self, texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of the text) of every shingle of ``size`` words, repeats included."""
        raws = [t.lower().encode("utf-8", "replace") for t in texts]
        joined = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
        if len(joined) > len(self.up):
            self.up, self.down = powers(len(joined) * 5 // 4)
        inside = IN_WORD[joined]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        if len(starts) < size:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        sums = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * self.up[: len(joined)], out=sums[1:])
        words = mixed((sums[ends] - sums[starts]) * self.down[starts])
        owner = np.searchsorted(np.cumsum([len(r) + 1 for r in raws]), starts, side="right")
        n = len(words) - size + 1
        out = np.zeros(n, np.uint64)
        for j in range(size):
            out = out * MULTIPLIER + words[j : j + n]
        whole = owner[:n] == owner[size - 1 :]
        return mixed(out[whole]), owner[:n][whole]


def shingle_set(text: str, size: int = SHINGLE) -> set[str]:
    words = WORD.findall(text.lower())
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def size_of(text: str) -> int:
    """The words of an item's shingles: five, or all of a shorter item's; 0 for an item without words."""
    return min(SHINGLE, sum(1 for _ in itertools.islice(WORD.finditer(text.lower()), SHINGLE)))


class Index:
    """MinHash sketches of test items, by size.

    Items with 2^c to 2^(c+1)-1 different shingles are one partition.  If at least
    ``threshold`` of an item's n shingles are in a document, fewer than
    ``(1 - threshold) n + 1`` are not, so of that many with the least hashes one is:
    the sketch of each item holds as many as its partition's largest size needs, and no
    contained item is missed, however long the document.
    """

    def __init__(self, items: list[tuple[object, str]], threshold: float = THRESHOLD, size: int = SHINGLE):
        hasher = Hasher()
        self.threshold, self.size, self.items = threshold, size, {}
        owners, hashes = [], []
        found, at = hasher.shingles([t for _, t in items], size)
        order = np.lexsort((found, at))
        found, at = found[order], at[order]
        cuts = np.searchsorted(at, np.arange(len(items) + 1))
        for k, (item, text) in enumerate(items):
            own = np.unique(found[cuts[k] : cuts[k + 1]])
            if not len(own):
                continue
            largest = (1 << len(own).bit_length()) - 1
            sketch = own[: min(len(own), int((1 - threshold) * largest + 1e-9) + 1)]
            self.items[k] = (item, text)
            hashes.append(sketch)
            owners.append(np.full(len(sketch), k))
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        order = np.argsort(self.hashes, kind="stable")
        self.hashes, self.owners = self.hashes[order], self.owners[order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.hashes & np.uint64((1 << 20) - 1)] = True
        self.sets: dict[int, set[str]] = {}

    def search(self, hasher: Hasher, texts: list[str]) -> list[list[tuple[object, int, int]]]:
        """For each text: (item, its shingles, those in the text) of the items that the text contains."""
        out: list[list[tuple[object, int, int]]] = [[] for _ in texts]
        if not len(self.hashes):
            return out
        found, at = hasher.shingles(texts, self.size)
        likely = self.maybe[found & np.uint64((1 << 20) - 1)]
        found, at = found[likely], at[likely]
        lo, hi = np.searchsorted(self.hashes, found, "left"), np.searchsorted(self.hashes, found, "right")
        pairs: dict[int, set[int]] = {}
        for i in np.flatnonzero(hi > lo).tolist():
            pairs.setdefault(int(at[i]), set()).update(self.owners[lo[i] : hi[i]].tolist())
        for text, items in pairs.items():
            held = shingle_set(texts[text], self.size)
            for k in sorted(items):
                if k not in self.sets:
                    self.sets[k] = shingle_set(self.items[k][1], self.size)
                own = self.sets[k]
                both = len(own & held)
                if own and both >= self.threshold * len(own) - 1e-9:
                    out[text].append((self.items[k][0], len(own), both))
        return out


def indexes(items: list[tuple[object, str]], threshold: float) -> list[Index]:
    """One index for each size of shingle that the items have; usually five words alone."""
    sizes = [size_of(t) for _, t in items]
    return [Index([i for i, s in zip(items, sizes) if s == size], threshold, size) for size in sorted(set(sizes) - {0})]


def blocks_of(items: DataFrame, id_col: str, text_col: str) -> tuple[int, Iterator[list[tuple[object, str]]]]:
    """How many blocks of bounded size the benchmark has, and the blocks one after the other; a usual benchmark is one."""
    named = items.select(F.col(f"`{id_col}`").alias("i"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("t")).distinct()
    size = named.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-size // INDEX_BYTES))
    return n, ([(r.i, r.t) for r in named.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()] for k in range(n))


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    threshold: float = THRESHOLD,
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """Add ``leaks``: an array of (item, shingles, found), the test items of which ``threshold`` or more is in the row's text.

    Shingles are five words; an item of fewer words is one shingle, an item without
    words is never found.  Null and empty texts contain nothing, rows of ``items`` that
    repeat count once, and an empty benchmark gives empty arrays.  Item ids keep their type.  Other columns and repeated rows stay, an
    empty table gives an empty one, and a column named ``leaks`` is replaced.  The
    benchmark goes to the workers in blocks of at most ``INDEX_BYTES``, each against
    all rows; the driver holds one block at a time, as what a block finds is stored
    before the next one is read.  Documents are not shuffled.
    """
    id_type = items.schema[item_id_col].dataType
    item = pa.struct([("item", to_arrow_type(id_type)), ("shingles", pa.int32()), ("found", pa.int32())])
    rest = docs.select(*[f"`{c}`" for c in docs.columns if c != "leaks"])

    def searched(df: DataFrame, block: list[tuple[object, str]], column: str, drop: tuple[str, ...]) -> DataFrame:
        state: dict[str, object] = {}

        def run(texts: list[str]) -> list[pa.Array]:
            if not state:
                state.update(indexes=indexes(block, threshold), hasher=Hasher())
            rows, part, held = [], [], 0
            for i, t in enumerate(texts):
                part.append(t)
                held += len(t)
                if held >= BLOCK or i == len(texts) - 1:
                    found = [index.search(state["hasher"], part) for index in state["indexes"]]
                    rows += [[dict(zip(("item", "shingles", "found"), p)) for f in found for p in f[k]] for k in range(len(part))]
                    part, held = [], 0
            return [pa.array(rows, pa.list_(item))]

        return map_texts(df, run, f"`{column}` array<struct<item:{id_type.simpleString()},shingles:int,found:int>>", text_col, drop)

    n, blocks = blocks_of(items, item_id_col, item_text_col)
    out, names = rest, []
    for k, block in enumerate(blocks):
        names.append(fresh(out, f"leaks{k}"))
        out = searched(out, block, names[-1], drop if k == n - 1 else ())
        if n > 1:
            out = stored(out)
    kept = [f"`{c}`" for c in rest.columns if c not in drop]
    return out.select(*kept, F.array_sort(reduce(F.concat, [F.col(c) for c in names])).alias("leaks"))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows that contain no test item, with all their columns; repeated rows, nulls and empty texts stay, an empty table gives an empty one."""
    names = docs.columns
    own = docs.withColumnRenamed("leaks", fresh(docs, "leaks_")) if "leaks" in names else docs
    found = contained_items(own, items, text_col, **options).where(F.size("leaks") == 0)
    return found.select(*[F.col(f"`{o}`").alias(c) for o, c in zip(own.columns, names)])
