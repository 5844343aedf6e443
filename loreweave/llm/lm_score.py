"""Operator 9: language-model scoring by online logistic context mixing, beside a unigram base."""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, pieces, stored

FOLDS, HELD_OUT = 10, 0
#: Common tokens whose counts are sent to the workers (bounded); the others meet their counts in a join.
COMMON = 1 << 17
#: Bytes of context that the two predictors with counts from the corpus look at.
ORDERS = (2, 4)
#: Their slots, as powers of two: so many bits fewer than the number of training bytes has, within these bounds.
FEWER_BITS, LEAST_BITS, MOST_BITS = 8, 18, 24
#: A table is made in parts that the leading bits of a context's hash pick.
PART_BITS = 8
#: Steps of a stretched probability in a table: a byte holds log odds of up to 8.
STEPS, CLIP = 16, 7.9
#: Bytes of a text that are coded one after the other, and blocks that go side by side.
BLOCK, LANES = 2048, 4096
#: Slots of the predictor that a block fills itself, as a power of two, and its rate.
OWN_BITS, OWN_RATE = 10, 0.3
#: First weights of the predictors (corpus, corpus, own) and the rate at which errors move them.
WEIGHTS, RATE = (0.5, 0.5, 0.3), 0.02
#: Cells of the refinement, over half steps of the mix's log odds, and its rate.
CELLS, REFINE_RATE = 33, 0.02
#: Different (context, byte) pairs that a task holds before it sends them on.
HELD = 1 << 21
#: The end of a text among the tokens; no word holds a blank.
END = b" "


def tokens(raw: bytes) -> list[bytes]:
    """Words, lowered, and the end; of bytes, ``lower`` changes A-Z alone and ``split`` knows the six blanks alone."""
    return [*raw.lower().split(), END]


def scattered(v: np.ndarray) -> np.ndarray:
    """A 32-bit mixing of unsigned numbers."""
    v = v * np.uint32(0x9E3779B1)
    v ^= v >> np.uint32(15)
    v *= np.uint32(0x85EBCA6B)
    v ^= v >> np.uint32(13)
    return v


def tree_paths(weights: list[int]) -> list[list[tuple[int, int]]]:
    """For each byte its (node, bit) steps down a Huffman tree for the weights."""
    heap = [(w, b, (b,)) for b, w in enumerate(weights)]
    heapq.heapify(heap)
    paths: list[list[tuple[int, int]]] = [[] for _ in weights]
    node = 0
    while len(heap) > 1:
        (w, _, xs), (v, _, ys) = heapq.heappop(heap), heapq.heappop(heap)
        for bit, part in ((0, xs), (1, ys)):
            for c in part:
                paths[c].append((node, bit))
        heapq.heappush(heap, (w + v, 256 + node, xs + ys))
        node += 1
    return [p[::-1] for p in paths]


class Codes:
    """Binary codes for a byte after each byte (Huffman by pair counts): the decisions that predictors are asked for.

    ``start`` and ``length`` of a pair (before << 8 | byte) point into ``node``: hashes
    of tree nodes whose lowest bit is the branch taken and whose leading
    ``PART_BITS`` are free for the context's.
    """

    def __init__(self, pairs: np.ndarray):
        single = pairs.sum(0)
        start, length, nodes, bits, roots = [], [], [], [], []
        for before in range(256):
            # a byte not seen here is coded by its share of all bytes; none is impossible
            paths = tree_paths((pairs[before] * 256 + single * 255 // max(1, single.sum()) + 1).tolist())
            for p in paths:
                start.append(len(nodes))
                length.append(len(p))
                nodes += [before << 8 | n for n, _ in p]
                bits += [b for _, b in p]
            roots.append(nodes[start[-1]])
        self.start, self.length = np.array(start, np.int32), np.array(length, np.int32)
        free = np.uint32((1 << (32 - PART_BITS)) - 2)
        self.node = scattered(np.array(nodes, np.uint32)) & free | np.array(bits, np.uint32)
        self.root = scattered(np.array(roots, np.uint32)) & free


def contexts(buf: np.ndarray) -> np.ndarray:
    """The four bytes before each place as a number, the nearest one lowest; the first four places have no whole one."""
    out = np.zeros(len(buf), np.uint32)
    wide = buf.astype(np.uint32)
    for j in range(1, 5):
        out[4:] |= wide[4 - j : len(buf) - j] << np.uint32(8 * (j - 1))
    return out


def context_hash(key: np.ndarray, order: int) -> np.ndarray:
    return scattered(key + np.uint32(order * 0x3C6EF372 & 0xFFFFFFFF))


def stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log odds in ``STEPS`` as bytes; 0 is kept for what was not seen."""
    cells = np.clip(np.rint(np.log((ones + 0.4) / (zeros + 0.4)) * STEPS), -127, 127).astype(np.int8)
    cells[(cells == 0) & (zeros + ones > 0)] = 1
    return cells


class Mixer:
    """Bit predictors mixed by gated weights and refined, all of which move after every byte.

    A text is coded in blocks of ``BLOCK`` bytes.  Each starts with the corpus's
    tables, the first weights and an even refinement, and sees the bytes before
    it.  For each bit of a byte's code: two predictors by hashed contexts from the
    corpus and one that the block fills itself give log odds; weights picked by which
    of the corpus's contexts are known mix them; cells by the mix's log odds refine it, and the
    mean of both is the bit's chance.  Then errors move all three.  Blocks are worked
    on side by side, a byte of each at a time; no block sees another.
    """

    def __init__(self, codes: Codes, tables: list[np.ndarray]):
        self.codes, self.tables = codes, [t.view(np.uint8) for t in tables]
        self.shift = np.uint32(33 - len(tables[0]).bit_length())
        self.signs = np.array([-1, 1], np.float32)
        self.odds = np.arange(256, dtype=np.uint8).view(np.int8) * np.float32(1 / STEPS)

    def bits(self, raws: list[bytes]) -> list[float]:
        """The bits that each text costs."""
        blocks = [(b"\0\0\0\0" + raw[max(0, at - 4) : at])[-4:] + raw[at : at + BLOCK] for raw in raws for at in range(0, len(raw), BLOCK)]
        owner = [i for i, raw in enumerate(raws) for _ in range(0, len(raw), BLOCK)]
        order = sorted(range(len(blocks)), key=lambda j: -len(blocks[j]))
        cost = [0.0] * len(raws)
        for at in range(0, len(order), LANES):
            lanes = order[at : at + LANES]
            for j, c in zip(lanes, self.side_by_side([blocks[j] for j in lanes]).tolist()):
                cost[owner[j]] += c
        return cost

    def side_by_side(self, blocks: list[bytes]) -> np.ndarray:
        """The bits of each block; blocks come with four bytes of history, the longest first."""
        width = len(blocks[0])
        padded = np.frombuffer(b"".join(b.ljust(width, b"\0") for b in blocks), np.uint8).reshape(-1, width)
        rows = np.ascontiguousarray(padded.T)  # a row holds a byte of every block
        sizes = np.array([len(b) for b in blocks]) - 4
        n_lanes = len(blocks)
        lane = np.arange(n_lanes)
        state = (
            [np.full(n_lanes << len(ORDERS), w, np.float32) for w in WEIGHTS],
            np.zeros(n_lanes << OWN_BITS, np.float32),
            np.tile((1 / (1 + np.exp((CELLS // 2 - np.arange(CELLS)) / 2)) - 0.5).astype(np.float32), n_lanes),
        )
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left").tolist()
        cost, t = np.zeros(n_lanes), 0
        while t < len(active):
            # what depends on the corpus alone is looked up for some steps at once
            to = min(len(active), t + max(1, (1 << 13) // active[t]))
            n_at = np.array(active[t:to])
            there = lane[: active[t]] < n_at[:, None]
            wide = rows[t : to + 4, : active[t]].astype(np.uint32)
            history = wide[3:-1] | wide[2:-2] << np.uint32(8) | wide[1:-3] << np.uint32(16) | wide[:-4] << np.uint32(24)
            own = np.broadcast_to(lane[: active[t]], there.shape)[there]
            self.steps(wide[4:][there], history[there], own, [0, *np.cumsum(n_at).tolist()], state, cost)
            t = to
        return cost

    def steps(self, byte: np.ndarray, history: np.ndarray, own: np.ndarray, steps: list[int], state: tuple, cost: np.ndarray) -> None:
        weights, filled, cells = state
        codes = self.codes
        before = history & np.uint32(255)
        pair = (before << np.uint32(8) | byte).astype(np.intp)
        length = codes.length.take(pair)
        ends = np.cumsum(length)
        starts = ends - length
        rep = np.repeat(np.arange(len(byte)), length)
        node = codes.node.take((codes.start.take(pair) - starts).take(rep) + np.arange(ends[-1]))
        sign = self.signs.take(node & np.uint32(1))
        push = sign * np.float32(REFINE_RATE / 2)
        lane = own.take(rep)
        gate, inputs = own << len(ORDERS), []
        for k, (order, table) in enumerate(zip(ORDERS, self.tables)):
            c = context_hash(history & np.uint32((1 << 8 * order) - 1), order)
            gate += (table.take((c ^ codes.root.take(before)) >> self.shift) != 0).astype(np.intp) << k
            h = c.take(rep)
            h ^= node
            inputs.append(self.odds.take(table.take(h >> self.shift)))
            if k == 0:
                h >>= np.uint32(1)
                h &= np.uint32((1 << OWN_BITS) - 1)
                place = lane << OWN_BITS
                place += h
        row = lane * CELLS
        row += CELLS // 2
        chance = np.empty(len(rep), np.float32)
        limit, rate, own_rate, fade = np.float32(CLIP), np.float32(RATE), np.float32(OWN_RATE), np.float32(1 - REFINE_RATE)
        for b, e in zip(steps[:-1], steps[1:]):
            f, to = starts[b], ends[e - 1]
            s, g, place_s, y = lane[f:to], gate[b:e], place[f:to], sign[f:to]
            own_s = filled.take(place_s)
            ins = [*(x[f:to] for x in inputs), own_s]
            ws = [w.take(g) for w in weights]
            mix = ws[0].take(s)
            mix *= ins[0]
            for w, x in zip(ws[1:], ins[1:]):
                part = w.take(s)
                part *= x
                mix += part
            np.maximum(mix, -limit, out=mix)
            np.minimum(mix, limit, out=mix)
            np.add(mix, mix, out=part)
            np.rint(part, out=part)
            cell = part.astype(np.intp)
            cell += row[f:to]
            mix *= y
            err = np.exp(mix)
            err += 1
            np.reciprocal(err, out=err)  # how far the mix is from the bit that comes
            refined = cells.take(cell)
            np.multiply(refined, y, out=part)
            part -= err
            chance[f:to] = part  # twice the bit's chance, less one and a half
            refined *= fade
            refined += push[f:to]
            cells[cell] = refined
            err *= y
            np.multiply(err, own_rate, out=part)
            part += own_s
            filled[place_s] = part
            err *= rate
            at_byte = starts[b:e] - f
            for w, old, x in zip(weights, ws, ins):
                np.multiply(x, err, out=part)
                old += np.add.reduceat(part, at_byte)
                w[g] = old
        chance += np.float32(1.5)
        np.log(chance, out=chance)
        per_byte = np.add.reduceat(chance, starts) * (1 / math.log(2))
        cost += np.bincount(own, length - per_byte, minlength=len(cost))


def pair_counts(training: DataFrame) -> DataFrame:
    """(part, key, n) from all rows: how often a byte follows a context; a task sums its own rows first, so keys repeat.

    A key is the context's bytes and the byte; ``part`` tells the predictor and the
    part of its table.  Nothing is hashed or left out, so these rows grow with the corpus.
    """

    def merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        keys, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        return keys[at], np.add.reduceat(n[order], at)

    def rows(held):
        longest, n_longest = merged(held)
        for k, o in enumerate(ORDERS):
            # a shorter context's counts are sums over the longer ones that end in it
            keys, n = (longest, n_longest) if o == 4 else merged([(longest & np.uint64((1 << 8 * (o + 1)) - 1), n_longest)])
            c = (keys >> np.uint64(8)).astype(np.uint32)
            part = (context_hash(c, o) >> np.uint32(32 - PART_BITS)).astype(np.int32) + np.int32(k << PART_BITS)
            for i in range(0, len(part), 1 << 16):
                cut = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(part[cut]), pa.array(keys[cut].view(np.int64)), pa.array(n[cut])], names=["part", "key", "n"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for piece in pieces(batch, "text"):
                raws = [t.encode("utf-8") for t in piece.column("text").to_pylist() if t]
                if not raws:
                    continue
                joined = np.frombuffer(b"".join(b"\0\0\0\0" + r for r in raws), np.uint8)
                sizes = np.array([len(r) + 4 for r in raws])
                own = np.ones(len(joined), bool)
                for k in range(4):
                    own[np.cumsum(sizes) - sizes + k] = False
                keys = contexts(joined).astype(np.uint64)
                keys <<= np.uint64(8)
                keys |= joined
                keys = keys[own]
                keys.sort()
                cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                held.append((keys[cuts], np.diff(np.append(cuts, len(keys)))))
                size += len(cuts)
                if size > HELD:
                    yield from rows(held)
                    held, size = [], 0
        if held:
            yield from rows(held)

    return training.select("text").mapInArrow(run, "part int, key long, n long")


def slot_tables(pairs: DataFrame, codes: Codes, bits: int) -> list[np.ndarray]:
    """Each predictor's table of log odds; executors count and shrink it to a byte a slot, the driver gets ``1 << bits`` bytes for each."""
    low = bits - PART_BITS

    def run(batches):
        zeros: dict[int, np.ndarray] = {}
        ones: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            part, keys, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(3))
            hashes = np.empty(len(keys), np.uint32)
            for k, order in enumerate(ORDERS):
                of = part >> PART_BITS == k
                hashes[of] = context_hash((keys[of] >> 8).astype(np.uint32), order)
            pair = keys & 0xFFFF
            length = codes.length[pair]
            rep = np.repeat(np.arange(len(keys)), length)
            node = codes.node[np.repeat(codes.start[pair] - (np.cumsum(length) - length), length) + np.arange(len(rep))]
            slot = ((hashes[rep] ^ node) >> np.uint32(32 - bits)).astype(np.int64) & ((1 << low) - 1)
            found, which = np.unique(part, return_inverse=True)
            cell = which[rep] << low | slot
            one = (node & np.uint32(1)).astype(bool)
            for into, side in ((zeros, ~one), (ones, one)):
                sums = np.bincount(cell[side], n[rep[side]], minlength=len(found) << low).reshape(len(found), -1)
                for p, row in zip(found.tolist(), sums):
                    into[p] = into[p] + row if p in into else row.copy()
        for p in zeros:
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([stretched(zeros[p], ones[p]).tobytes()], pa.binary())], names=["part", "cells"])

    tables = np.zeros((len(ORDERS), 1 << PART_BITS, 1 << low), np.int8)
    for r in pairs.repartition(64, "part").mapInArrow(run, "part int, cells binary").collect():
        tables[r.part >> PART_BITS, r.part & ((1 << PART_BITS) - 1)] = np.frombuffer(r.cells, np.int8)
    return list(tables.reshape(len(ORDERS), -1))


def fit(training: DataFrame) -> Mixer:
    """A mixer from all training texts; its tables grow with them up to ``1 << MOST_BITS`` slots."""
    pairs = stored(pair_counts(training))
    by_pair = pairs.where(f"part < {1 << PART_BITS}").groupBy(F.expr("cast(key & 65535 as int)").alias("pair")).agg(F.sum("n").alias("n")).toPandas()  # at most 65,536 rows
    counts = np.zeros(1 << 16, np.int64)
    counts[by_pair["pair"].to_numpy(int)] = by_pair["n"].to_numpy(np.int64)
    codes = Codes(counts.reshape(256, 256))
    bits = min(MOST_BITS, max(LEAST_BITS, int(counts.sum()).bit_length() - FEWER_BITS))
    return Mixer(codes, slot_tables(pairs, codes, bits))


def token_counts(training: DataFrame) -> DataFrame:
    """(token, c): the words of all rows, lowered; a task counts its own rows first."""

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                counts.update((t or "").encode("utf-8").lower().split())
                if len(counts) > HELD:
                    yield made(counts)
                    counts = Counter()
        yield made(counts)

    def made(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())], names=["token", "c"])

    return training.select("text").mapInArrow(run, "token string, c long").groupBy("token").agg(F.sum("c").alias("c"))


def commonest(counts: DataFrame, size: int) -> tuple[list[tuple[str, int]], bool]:
    """Up to ``size`` tokens that come most often, and whether those are all.

    Classes of like counts (sixteen to a doubling, so a few hundred) are counted
    first; the tokens of the highest classes that fit together are taken.
    """
    classed = counts.withColumn("class", F.floor(F.log2("c") * 16).cast("int"))
    sizes = sorted(((r["class"], r["n"]) for r in classed.groupBy("class").agg(F.count("*").alias("n")).collect()), reverse=True)
    least, n = None, 0
    for c, k in sizes:
        if n + k > size:
            return ([(r.token, r.c) for r in classed.where(F.col("class") >= least).collect()] if least is not None else []), False
        least, n = c, n + k
    return [(r.token, r.c) for r in counts.collect()], True


def score_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", common_size: int = COMMON) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) for every row.

    Rows whose crc32 of the id as text is 0 modulo 10 are held out; all others
    train both models.  Tokens are words, A-Z lowered, and one end for each text; a
    null text is empty and has the end alone.  A null id counts as the empty
    string.  ``base_score`` sums log10((c + 0.1) / (N + 0.1 (V + 1))), and ``score``
    is the mixer's log10 probability of the text's bytes (0 for no bytes, whose
    ``bits_per_byte`` is null).  Repeated rows come back as often; an empty table
    gives an empty one.  Other columns of ``df``, whatever their names, are not used.

    Counts of up to ``common_size`` common tokens go to the workers, where a row is
    scored; its other tokens, one row for each, meet their counts in a join.
    """
    own = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    own = own.withColumn("held_out", F.crc32(F.coalesce(F.col("id").cast("string"), F.lit(""))) % FOLDS == HELD_OUT)
    training = own.where("not held_out")
    counts = stored(token_counts(training))
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n_train = training.count()
    n_all, v = totals[0] + n_train, totals[1] + (n_train > 0)
    top, whole = commonest(counts, common_size)
    mixer = fit(training)
    bottom = math.log10(n_all + 0.1 * (v + 1))
    known = {t.encode("utf-8"): math.log10(c + 0.1) - bottom for t, c in top}
    if n_train:
        known[END] = math.log10(n_train + 0.1) - bottom
    unknown = math.log10(0.1) - bottom if whole else None

    def run(texts: list[str]) -> list[pa.Array]:
        raws = [t.encode("utf-8") for t in texts]
        n, n_known, base, rare_words, rare_counts, sizes = [], [], [], [], [], [0]
        for raw in raws:
            words = tokens(raw)
            rest: Counter = Counter()
            score = 0.0
            found = list(map(known.get, words))
            if hits := len(words) - found.count(None):
                score = math.fsum(s for s in found if s is not None) if hits < len(words) else math.fsum(found)
            if hits < len(words):
                rest = Counter(w for w, s in zip(words, found) if s is None)
                sure = rest.total() if unknown is not None else rest[END]
                score += sure * (math.log10(0.1) - bottom)
                if unknown is not None:
                    rest.clear()
                del rest[END]
            n.append(len(words))
            n_known.append(hits)
            base.append(score)
            rare_words += rest.keys()
            rare_counts += rest.values()
            sizes.append(len(rare_words))
        where = pa.array(sizes, pa.int32())
        bits = mixer.bits(raws)
        return [
            pa.array(n, pa.int64()),
            pa.array(n_known, pa.int64()),
            pa.array(base, pa.float64()),
            pa.array([-b * math.log10(2) for b in bits], pa.float64()),
            pa.array([b / len(r) if r else None for b, r in zip(bits, raws)], pa.float64()),
            pa.ListArray.from_arrays(where, pa.array(rare_words, pa.binary()).cast(pa.string())),
            pa.ListArray.from_arrays(where, pa.array(rare_counts, pa.int64())),
        ]

    fields = "n_tokens long, n_known long, base_score double, score double, bits_per_byte double, rare array<string>, times array<bigint>"
    keyed = own.withColumn("mark", F.xxhash64("text"))  # with the id it tells rows apart, but for repeated ones
    scored = stored(map_texts(keyed, run, fields, drop=("text",)))
    shown = ["id", "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score", "bits_per_byte"]
    if unknown is not None:
        return scored.select(*shown)
    loose = scored.select("id", "mark", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("id", "mark", "r.rare", "r.times")
    met = (
        loose.join(counts, loose.rare == counts.token, "left")
        .groupBy("id", "mark")
        .agg(
            F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * (F.log10(F.coalesce("c", F.lit(0)) + 0.1) - bottom)).alias("more_base"),
        )
    )
    rows = scored.groupBy("id", "mark").agg(F.count("*").alias("rows"))  # repeated rows have put their tokens in as often
    more = met.join(rows, met.id.eqNullSafe(rows.id) & (met.mark == rows.mark)).select(
        met.id.alias("of"), met.mark.alias("by"), (F.col("more_known") / F.col("rows")).alias("more_known"), (F.col("more_base") / F.col("rows")).alias("more_base")
    )
    return (
        scored.join(more, scored.id.eqNullSafe(more.of) & (scored.mark == more.by), "left")
        .withColumn("n_known", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long"))
        .withColumn("base_score", F.col("base_score") + F.coalesce("more_base", F.lit(0.0)))
        .select(*shown)
    )
