"""Operator 8: near duplicates by SimHash, with bit-sliced comparison of fingerprints."""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, stored
from .components import components

SEED, BITS, RADIUS = 42, 64, 4
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
#: Bits of the six pieces of a fingerprint; two that differ in four bits at most share two pieces whole.
PIECES = (11, 11, 11, 11, 10, 10)
#: Fingerprints of a bucket that one task compares with each other; larger buckets are cut into parts of this size.
PART = 2048
#: Fingerprints that are compared with one block of 64-bit words at a time.
BLOCK = 512


def hashes(text: str, shingle: int = 4) -> np.ndarray:
    """The hashes of a text's shingles in order, repeats included; a text of fewer words is one shingle, one of none has none."""
    text = text.translate(LOWER) if not text.isascii() else text.lower()
    words = WORD.findall(text)
    if not words:
        return np.zeros(0, np.uint64)
    raw = " ".join(words).encode("utf-8")
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(raw, SEED)], np.uint64)
    ends = np.flatnonzero(np.frombuffer(raw + b" ", np.uint8) == 32).tolist()
    starts = [0, *[e + 1 for e in ends[:-shingle]]]
    digest, view = xxhash.xxh64_intdigest, memoryview(raw)
    return np.array([digest(view[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :])], np.uint64)


def voted(found: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it; none give 0."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(found), 1 << 15):
        counts += np.unpackbits(found[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(found), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str, shingle: int = 4) -> int:
    """A bit is 1 if more than half of the shingles' hashes have it; no words give 0."""
    return voted(hashes(text, shingle))


def with_fingerprints(df: DataFrame, text_col: str = "text", drop: tuple[str, ...] = (), shingle: int = 4) -> DataFrame:
    """Add ``simhash`` (long, the 64 bits) to each row; a null text counts as empty and has 0."""

    def run(texts: list[str]) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64))]

    return map_texts(df, run, "simhash long", text_col, drop)


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes: row b holds bit b of every value, 64 values to a word."""
    n = -len(values) % 64
    bits = np.unpackbits(np.append(values, np.zeros(n, np.uint64)).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near(query: int, sliced: np.ndarray, alive: np.ndarray) -> np.ndarray:
    """A mask, 64 values to a word, of those of ``sliced`` at RADIUS or fewer bits from ``query``.

    Each plane's differences go into bitwise counters (ones, twos, fours) by
    carry-save addition; a value whose counter passes the radius is lost, and the
    comparison ends as soon as all are.
    """
    ones = np.zeros_like(alive)
    twos, fours, lost = ones.copy(), ones.copy(), ~alive
    for b in range(0, BITS, 8):
        for c in range(b, b + 8):
            d = ~sliced[c] if query >> c & 1 else sliced[c]
            carry = ones & d
            ones = ones ^ d
            more = twos & carry
            twos = twos ^ carry
            lost = lost | (fours & more)
            fours = fours ^ more
            lost = lost | (fours & (ones | twos))  # five or more
        if not (~lost).any():
            break
    return ~lost


def links(a: np.ndarray, b: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of rows that span, as a forest, all links of ``a``, or those between ``a`` and ``b``.

    A link inside a tree that is known already is not needed for the components.
    """
    own = b is None
    other = a if own else b
    n, m = len(a), len(other)
    parent = list(range(n if own else n + m))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for at in range(0, m, BLOCK):
        part = other[at : at + BLOCK]
        sliced = planes(part)
        full = np.zeros(len(sliced[0]) * 64, np.uint8)
        full[: len(part)] = 1
        for i in range(min(n, at + len(part)) if own else n):
            mask = full.copy()
            if own:
                mask[: max(0, i + 1 - at)] = 0  # each pair once
            hit = near(int(a[i]), sliced, np.packbits(mask, bitorder="little").view(np.uint64))
            if not hit.any():
                continue
            for j in np.flatnonzero(np.unpackbits(hit.view(np.uint8), bitorder="little")).tolist():
                k = at + j if own else n + at + j
                x, y = top(i), top(k)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((i, at + j))
    return out


def keys_of(column: str) -> F.Column:
    """All choices of two pieces of a fingerprint, as (choice, bits) in one long."""
    at, ends = 0, []
    for width in PIECES:
        ends.append((at, width))
        at += width
    values = []
    for i, ((s, w), (t, v)) in enumerate(combinations(ends, 2)):
        values.append(f"shiftleft({i}L, 32) | shiftleft(shiftrightunsigned({column}, {s}) & {(1 << w) - 1}, 16) | (shiftrightunsigned({column}, {t}) & {(1 << v) - 1})")
    return F.expr("array(" + ", ".join(values) + ")")


def fingerprint_links(prints: DataFrame) -> DataFrame:
    """(a, b): edges between fingerprints (column ``simhash``, all different) that connect all within the radius.

    Fifteen keys a fingerprint bring every linked pair into a bucket.  Buckets of
    one row are dropped before anything is sent to Python; buckets of more than
    ``PART`` rows are cut into parts and each pair of parts is a task's work of its own.
    """
    keyed = prints.select("simhash", F.explode(keys_of("simhash")).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keyed.join(sizes, "key").withColumn("parts", F.ceil(F.col("n") / PART).cast("int"))
    # a part meets itself and every other part: (lower, upper) of the two names the work
    placed = shared.withColumn("part", F.expr("cast(pmod(xxhash64(simhash), parts) as int)")).select(
        "key", "simhash", "part", F.explode(F.expr("sequence(0, parts - 1)")).alias("other")
    ).select("key", "simhash", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    dealt = placed.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "simhash")

    def compare(batches):
        held, name = [], None

        def done():
            prints = np.concatenate([h[0] for h in held]).view(np.uint64)
            part = np.concatenate([h[1] for h in held])
            lo, hi = name[1:]
            if lo == hi:
                a, pairs = prints, links(prints)
                b = a
            else:
                a, b = prints[part == lo], prints[part == hi]
                pairs = links(a, b) if len(a) and len(b) else []
            if pairs:
                x, y = map(list, zip(*pairs))
                return pa.RecordBatch.from_arrays([pa.array(a[x].view(np.int64)), pa.array(b[y].view(np.int64))], names=["a", "b"])
            return None

        for batch in batches:
            cols = [batch.column(c).to_numpy() for c in ("key", "lo", "hi", "simhash", "part")]
            k = np.stack(cols[:3])
            cuts = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(cuts, cuts[1:]):
                if s == e:
                    continue
                this = tuple(k[:, s].tolist())
                if held and this != name:
                    if (out := done()) is not None:
                        yield out
                    held = []
                name = this
                held.append((cols[3][s:e], cols[4][s:e]))
        if held and (out := done()) is not None:
            yield out

    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, simhash, component): each row's fingerprint and the smallest id of its component.

    Rows of one fingerprint are one class, whatever their number; only different
    fingerprints are compared.  Fingerprints link at four or fewer differing bits,
    and components follow links of links.  Null, empty and blank texts have
    fingerprint 0, which links like any other.  A repeated row comes back as often;
    rows with a null id link as others do, but the smallest id is of those that
    have one (null if none).  An empty table gives an empty one.
    """
    prints = stored(with_fingerprints(df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), drop=("text",)))
    classes = stored(prints.groupBy("simhash").agg(F.min("id").alias("least")))
    found = components(fingerprint_links(classes.select("simhash")))
    named = classes.join(found, classes.simhash == found.node, "left").select(
        classes.simhash, F.coalesce("component", classes.simhash).alias("root"), "least"
    )
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    labelled = named.join(least, "root").select("simhash", "component")
    return prints.join(labelled, "simhash").select("id", "simhash", "component")
