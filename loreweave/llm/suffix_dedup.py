"""Operator 7: removal of byte strings that occur twice, by deep-shallow sorting of suffixes at anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chat import groups
from .common import pieces, stored
from .decontaminate import mixed, powers

#: Bytes of a string that must not occur twice, and of the grams that anchors are chosen by.
LENGTH, GRAM = 400, 64
SPAN = LENGTH - GRAM + 1
#: Bytes of a text that are worked on at a time (positions fit in the low bits of a key).
BLOCK, LOW = 1 << 18, 20
#: Depth that multikey quicksort sorts to before blind tries take over.
SHALLOW = 24
#: Different contexts of an anchor that one task sorts; the windows of an anchor with more are counted by their hashes.
MOST = 512

_tables: list[np.ndarray] = []


def window_minima(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every run of ``width`` keys, by minima from both ends of blocks of that width."""
    n = len(keys)
    rows = -(-n // width)
    full = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = keys
    grid = full.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(gram hash, first window, windows, anchor offset in the first): runs of windows that share an anchor.

    A window of LENGTH bytes has as its anchor the gram in it with the least hash,
    the first of equals, so equal windows have equal anchors at equal offsets.
    """
    if not _tables:
        _tables.extend(powers(BLOCK + LENGTH))
    up, down = _tables
    out = []
    for base in range(0, len(raw) - LENGTH + 1, BLOCK):
        part = np.frombuffer(raw[base : base + BLOCK + LENGTH - 1], np.uint8)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], out=sums[1:])
        n = len(part) - GRAM + 1
        hashes = mixed((sums[GRAM:] - sums[:n]) * down[:n])
        keys = (hashes >> np.uint64(LOW)) << np.uint64(LOW) | np.arange(n, dtype=np.uint64)
        at = (window_minima(keys, SPAN) & np.uint64((1 << LOW) - 1)).astype(np.int64)
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1, [len(at)]])
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            a = int(at[s])
            out.append((int(hashes[a].view(np.int64)), base + s, e - s, a - s))
    return out


def common(a: bytes, b: bytes) -> int:
    """The length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def blind_trie(strings: list[bytes], ids: list[int]) -> list[int]:
    """``ids`` in the order of their strings, by a trie that keeps only branching depths and bytes.

    A string goes down the trie blindly to some leaf, is compared with that leaf's
    string once, and is put in where the two part.
    """
    root: object = ids[0]
    char = lambda s, d: s[d] if d < len(s) else -1
    for i in ids[1:]:
        s, node = strings[i], root
        while isinstance(node, tuple):
            depth, kids = node
            node = kids.get(char(s, depth)) if char(s, depth) in kids else next(iter(kids.values()))
        leaf = node[0] if isinstance(node, list) else node
        other = strings[leaf]
        at = common(s, other)
        parent, node = None, root
        equal = at == len(s) == len(other)
        while isinstance(node, tuple) and node[0] < at + equal:
            parent, node = node, node[1][char(s, node[0])]
        if equal:
            new: object = [*(node if isinstance(node, list) else [node]), i]
        elif isinstance(node, tuple) and node[0] == at:
            node[1][char(s, at)] = i
            continue
        else:
            new = (at, {char(other, at): node, char(s, at): i})
        if parent is None:
            root = new
        else:
            parent[1][char(s, parent[0])] = new
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, tuple):
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
        elif isinstance(node, list):
            out += node
        else:
            out.append(node)
    return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """The order of strings: multikey quicksort to a shallow depth, then blind tries for what is still equal."""
    out, stack = [], [(list(range(len(strings))), 0)]
    while stack:
        ids, depth = stack.pop()
        if len(ids) < 2:
            out += ids
        elif depth >= SHALLOW:
            out += blind_trie(strings, ids)
        else:
            chars = [strings[i][depth] if depth < len(strings[i]) else -1 for i in ids]
            pivot = sorted((chars[0], chars[len(ids) // 2], chars[-1]))[1]
            less = [i for i, c in zip(ids, chars) if c < pivot]
            same = [i for i, c in zip(ids, chars) if c == pivot]
            more = [i for i, c in zip(ids, chars) if c > pivot]
            stack += [(more, depth)] if more else []
            if pivot < 0:  # ended strings: equal, and before all others
                out += same
            else:
                stack.append((same, depth + 1))
                stack += [(less, depth)] if less else []
    return out


def ranked(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The order of strings, and for each place the prefix it shares with the one before."""
    order = deep_shallow(strings)
    shared = [0] + [common(strings[a], strings[b]) for a, b in zip(order, order[1:])]
    return np.array(order), np.array(shared)


def repeated_windows(contexts: list[bytes], offsets: list[int], windows: list[int]) -> list[list[tuple[int, int]]]:
    """Of contexts around one anchor: for each, runs (first window, windows) that another context has too.

    A window begins d bytes before the anchor.  Two contexts share it if the d bytes
    to the left and the LENGTH - d bytes to the right agree, so both sides are
    sorted once and d goes through the depths at which either grouping changes.
    """
    right, shared_right = ranked([c[o:] for c, o in zip(contexts, offsets)])
    left, shared_left = ranked([c[:o][::-1] for c, o in zip(contexts, offsets)])
    off, n = np.array(offsets), np.array(windows)
    low, high = off - n + 1, off
    m = len(contexts)
    edges = np.unique(np.concatenate([[0, SPAN], LENGTH - shared_right, shared_left + 1, low, high + 1]))
    edges = edges[(edges >= 0) & (edges <= SPAN)]
    out: list[list[tuple[int, int]]] = [[] for _ in range(m)]
    r, l = np.zeros(m, np.int64), np.zeros(m, np.int64)
    for d, end in zip(edges[:-1].tolist(), edges[1:].tolist()):
        r[right] = np.cumsum(shared_right < LENGTH - d)
        l[left] = np.cumsum(shared_left < d)
        inside = np.flatnonzero((low <= d) & (d <= high))
        if len(inside) < 2:
            continue
        _, back, count = np.unique(r[inside] * (m + 1) + l[inside], return_inverse=True, return_counts=True)
        for i in inside[count[back] > 1].tolist():
            out[i].append((offsets[i] - (end - 1), end - d))
    return out


def runs_of(docs: DataFrame) -> DataFrame:
    """(id, mark, gram, hi, lo, first, windows, offset): the runs of every text, with a 128-bit hash of their bytes."""
    names = ["id", "mark", "gram", "hi", "lo", "first", "windows", "offset"]

    def run(batches):
        for batch in batches:
            kinds = [batch.schema.field("id").type, *[pa.int64()] * 4, *[pa.int32()] * 3]
            cols: list[list] = [[] for _ in names]
            made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)  # noqa: E731, B023
            for piece in pieces(batch, "text"):
                for i, mark, text in zip(*(piece.column(c).to_pylist() for c in range(3))):
                    raw = (text or "").encode("utf-8")
                    if len(raw) < LENGTH:
                        continue
                    for gram, first, windows, offset in anchors(raw):
                        d = xxhash.xxh3_128_digest(raw[first : first + windows + LENGTH - 1])
                        for c, v in zip(cols, (i, mark, gram, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), first, windows, offset)):
                            c.append(v)
                        if len(cols[0]) > 100_000:
                            yield made()
                            cols = [[] for _ in names]
            yield made()

    schema = f"id {docs.schema['id'].dataType.simpleString()}, mark long, gram long, hi long, lo long, first int, windows int, offset int"
    return docs.select("id", "mark", "text").mapInArrow(run, schema)


def with_runs(docs: DataFrame, runs: DataFrame, how: str) -> DataFrame:
    """Documents with the array of their runs; a text's runs are no more than its bytes."""
    gathered = runs.groupBy("id", "mark").agg(F.collect_list(F.struct(*[c for c in runs.columns if c not in ("id", "mark")])).alias("runs"))
    gathered = gathered.select(F.col("id").alias("of"), F.col("mark").alias("by"), "runs")
    return docs.join(gathered, docs.id.eqNullSafe(gathered.of) & (docs.mark == gathered.by), how).drop("of", "by")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(id, mark, first, windows): windows whose LENGTH bytes also start elsewhere."""
    runs = stored(runs_of(docs))
    same = stored(
        runs.groupBy("gram", "hi", "lo").agg(F.count("*").alias("n"), F.min(F.struct("id", "mark", "first", "windows", "offset")).alias("one"))
    )
    whole = runs.join(same.where("n > 1").select("gram", "hi", "lo"), ["gram", "hi", "lo"], "left_semi").select("id", "mark", "first", "windows")
    # anchors that stand in different contexts, one of which at least occurs once: these need a closer look
    odd = same.groupBy("gram").agg(F.count("*").alias("contexts"), F.count_if(F.col("n") == 1).alias("single")).where("contexts > 1 and single > 0")
    near = same.join(odd, "gram").select("one.*", "gram", "n", "contexts")
    looked = stored(contexts_of(docs, near))

    id_type = docs.schema["id"].dataType.simpleString()

    def compare(batches):
        for g in groups(batches, ["gram"]):
            contexts, offsets, windows = (g.column(c).to_pylist() for c in ("context", "offset", "windows"))
            found = repeated_windows(contexts, offsets, windows)
            ids, marks, firsts, n = (g.column(c).to_pylist() for c in ("id", "mark", "first", "n"))
            rows = [(ids[k], marks[k], firsts[k] + p, size) for k, own in enumerate(found) if n[k] == 1 for p, size in own]
            if rows:
                kinds = (g.schema.field("id").type, pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["id", "mark", "first", "windows"])

    dealt = looked.where(f"contexts <= {MOST}").repartition("gram").sortWithinPartitions("gram", "id", "mark", "first")
    sorted_out = dealt.mapInArrow(compare, f"id {id_type}, mark long, first int, windows int")

    def hashed(batches):
        for batch in batches:
            for i in range(batch.num_rows):  # a context has at most SPAN windows
                c, w = batch.column("context")[i].as_py(), batch.column("windows")[i].as_py()
                digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(c[k : k + LENGTH]) for k in range(w)), ">i8").astype(np.int64).reshape(-1, 2)
                own = [pa.repeat(batch.column(x)[i], w) for x in ("id", "mark", "n")]
                first = pa.array(np.arange(w, dtype=np.int32) + batch.column("first")[i].as_py())
                yield pa.RecordBatch.from_arrays([*own[:2], first, own[2], pa.array(digests[:, 0]), pa.array(digests[:, 1])], names=["id", "mark", "first", "n", "hi", "lo"])

    # the windows of very common anchors: counted within tasks first, so that no task gets a common one's rows
    each = looked.where(f"contexts > {MOST}").mapInArrow(hashed, f"id {id_type}, mark long, first int, n long, hi long, lo long")
    shared = each.groupBy("hi", "lo").agg(F.count("*").alias("k")).where("k > 1").select("hi", "lo")
    counted = each.where("n = 1").join(shared, ["hi", "lo"], "left_semi").select("id", "mark", "first", F.lit(1).alias("windows"))
    return whole.unionByName(sorted_out).unionByName(counted)


def contexts_of(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """``runs`` with the bytes of their windows."""

    names = ["id", "mark", "first", "windows", "offset", "gram", "n", "contexts"]

    def run(batches):
        for batch in batches:
            id_kind = batch.schema.field("runs").type.value_type.field("id").type
            kinds = [id_kind, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            for piece in pieces(batch, "text"):
                for text, own in zip(piece.column("text").to_pylist(), piece.column("runs").to_pylist()):
                    raw = (text or "").encode("utf-8")
                    made = [raw[r["first"] : r["first"] + r["windows"] + LENGTH - 1] for r in own]
                    cols = [pa.array([r[c] for r in own], k) for c, k in zip(names, kinds)]
                    yield pa.RecordBatch.from_arrays([*cols, pa.array(made, pa.binary())], names=[*names, "context"])

    keyed = runs.withColumns({"own_id": F.col("id"), "own_mark": F.col("mark")})
    held = with_runs(docs, keyed, "inner").select("text", F.expr("transform(runs, r -> named_struct('id', r.own_id, 'mark', r.own_mark, 'first', r.first, 'windows', r.windows, 'offset', r.offset, 'gram', r.gram, 'n', r.n, 'contexts', r.contexts))").alias("runs"))
    id_type = docs.schema["id"].dataType.simpleString()
    return held.mapInArrow(run, f"id {id_type}, mark long, first int, windows int, offset int, gram long, n long, contexts long, context binary")


def removed_spans(size: int, runs: list[dict]) -> list[tuple[int, int]]:
    """The union of the windows' bytes as maximal spans."""
    out: list[list[int]] = []
    for first, end in sorted((r["first"], r["first"] + r["windows"] + LENGTH - 1) for r in runs):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, min(end, size)])
    return [(s, e) for s, e in out]


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, removed, kept): each text's size, the spans to go (start, end) and the bytes that stay.

    A byte goes if some string of 400 bytes over it also starts anywhere else, in
    the same text or another; strings are judged on the input.  Of repeated
    strings none stays.  A null, empty or shorter text keeps all its bytes.  A
    repeated row is another place, so it loses all if it is long enough, and comes
    back as often.  An empty table gives an empty one.

    Texts are cut at anchors; runs of windows around one are compared by a 128-bit
    hash first.  Only contexts that differ around a shared anchor are sorted,
    an anchor's in one task up to ``MOST`` of them; beyond, windows are counted by hash.
    """
    # ids need not be numbers, and rows may share one: a hash of the text goes with it
    own = df.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("mark"), F.col(f"`{text_col}`").alias("text"))
    found = with_runs(own, repeated_runs(own), "left")
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text"):
                texts, runs = piece.column("text").to_pylist(), piece.column("runs").to_pylist()
                sizes, spans, kept = [], [], []
                for t, r in zip(texts, runs):
                    raw = (t or "").encode("utf-8")
                    cut = removed_spans(len(raw), r or [])
                    sizes.append(len(raw))
                    spans.append([{"start": s, "end": e} for s, e in cut])
                    ends = [0, *(e for _, e in cut)]
                    kept.append(b"".join(raw[a:b] for a, b in zip(ends, [*(s for s, _ in cut), len(raw)])))
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["id", "n_bytes", "removed", "kept"])

    id_type = df.schema[id_col].dataType.simpleString()
    return found.select("id", "text", "runs").mapInArrow(run, f"id {id_type}, n_bytes long, removed array<struct<start:bigint,end:bigint>>, kept binary")
