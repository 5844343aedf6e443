"""Operator 13: documents whose word n-grams overlap, joined by prefixes of tokens and of token combinations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, stored
from .components import components
from .simhash import SEED, WORD, fingerprint_links, hashes, voted  # noqa: F401

SHINGLE, SIMILARITY = 5, 80
#: A prefix holds one token in so many beyond what single tokens need; combinations may use up no more than these.
EXTRA = 20
#: A token of more sets' prefixes than this is frequent and is indexed in pairs.
RARE = 64
#: Sets of a bucket that one task holds against others, and their shingles; larger buckets are cut.
PART, PART_TOKENS = 256, 1 << 18
#: Sets whose names are sent to all workers to fetch their texts; more are joined.
FEW = 1 << 20
#: Bitmaps of a bucket that one task compares; a bitmap takes a sixty-fourth to a thirty-second of its set.
PART_BITS = 1024
#: Columns of the overlap matrix at a time.
STEP = 4096
MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """The hashes of a text's shingles, each once and sorted; a text of fewer words is one shingle, one of none has none."""
    return np.unique(hashes(text, shingle))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * MIX
    return x ^ (x >> np.uint64(32))


def needed(size: int, similarity: int = SIMILARITY) -> int:
    """The first so many tokens of a set, in any order, hold one of every set that is similar to it."""
    return size - -(-similarity * size // 100) + 1


def prefix_length(size: int, similarity: int = SIMILARITY) -> int:
    """The length of the extended prefix: what single tokens need and the tokens that combinations may use up."""
    return min(size, needed(size, similarity) + size // EXTRA)


def families(size: int, similarity: int = SIMILARITY) -> list[int]:
    """Powers of two whose sizes a set may meet a similar one in: that of its own size and, near its lower end, the one below."""
    own = size.bit_length() - 1
    return [own, own - 1] if own and similarity * size < 100 << own else [own]


def signatures(tokens: np.ndarray, counts: np.ndarray, size: int, similarity: int = SIMILARITY) -> np.ndarray:
    """What a set is indexed by: its rare prefix tokens, and pairs of frequent ones that fall into one group.

    A family has as many groups as its smallest sets have extra tokens.  Two similar sets share more prefix tokens
    than there are groups, so that they share a rare token or two frequent ones of one group; a family without
    groups indexes frequent tokens alone.
    """
    rare = counts <= RARE
    out, often = [tokens[rare]], tokens[~rare]
    if not len(often):
        return out[0]
    for family in families(size, similarity):
        groups = (1 << family) // EXTRA
        if not groups:
            out.append(often)
            continue
        group = (mixed(often) % np.uint64(groups)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        held, group = often[order], group[order]
        cuts = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1).tolist(), len(group)]
        for s, e in zip(cuts, cuts[1:]):
            if e - s > 1:
                i, j = np.triu_indices(e - s, 1)
                out.append(mixed(mixed(held[s:e][i]) + held[s:e][j] * MIX + np.uint64(family)))
    return np.unique(np.concatenate(out))


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """The number of shingles that each of ``a`` shares with each of ``b`` (of ``a``, if not given)."""
    own = b is None
    sets = a if own else [*a, *b]
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = n[column] > 1
    rows, column = rows[shared], column[shared]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((len(a), len(a) if own else len(b)), np.float32)
    for at in range(0, column[-1] + 1 if len(column) else 0, STEP):
        s, e = np.searchsorted(column, [at, at + STEP])
        block = np.zeros((len(sets), STEP), np.float32)
        block[rows[s:e], column[s:e] - at] = 1
        out += block @ block.T if own else block[: len(a)] @ block[len(a) :].T
    return out


def similar(shared: np.ndarray, n: np.ndarray, m: np.ndarray, similarity: int) -> np.ndarray:
    return 100 * shared >= similarity * (n + m - shared)


def bitmap(tokens: np.ndarray) -> np.ndarray:
    """A bit for each hash slot, one if an odd number of tokens fall into it; there are more slots than tokens, 64 at least.

    Two sets differ in as many tokens as their bitmaps do in bits, or more.
    """
    slots = 1 << max(6, len(tokens).bit_length())
    odd = np.bincount((mixed(tokens ^ MIX) & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bits: np.ndarray) -> np.ndarray:
    """Bitmaps of half as many slots."""
    half = bits.shape[-1] // 2
    return bits[..., :half] ^ bits[..., half:]


def forest(bits: list[np.ndarray], sizes: np.ndarray, side: np.ndarray | None, similarity: int) -> list[tuple[int, int]]:
    """Pairs that span, as a forest, all pairs of sets that their bitmaps allow to be similar, or those of different ``side``."""
    width = np.array([len(b) for b in bits])
    here, half, open_ = {}, {}, {}
    for w in np.unique(width).tolist():
        open_[w] = np.flatnonzero(width == w)
        here[w] = np.stack([bits[i] for i in open_[w]])
        half[w] = folded(here[w]) if w > 1 else None
    place = {int(i): k for w in open_ for k, i in enumerate(open_[w])}
    free = np.ones(len(bits), bool)
    out = []
    for seed in range(len(bits)):
        if not free[seed]:
            continue
        free[seed] = False
        queue = [seed]
        for i in queue:
            w, k = int(width[i]), place[i]
            for v, mine, theirs in ((w, here[w][k], here), (2 * w, here[w][k], half), (w // 2, half[w][k] if w > 1 else None, here)):
                if v not in open_ or mine is None or theirs[v] is None:
                    continue
                js = open_[v]
                kept = np.flatnonzero(free[js] if side is None else free[js] & (side[js] != side[i]))
                if not len(kept):
                    continue
                apart = np.bitwise_count(theirs[v][kept] ^ mine).sum(1, dtype=np.int64)
                js = js[kept]
                n, m = sizes[i], sizes[js]
                hit = js[((100 + similarity) * apart <= (100 - similarity) * (n + m)) & (100 * np.minimum(n, m) >= similarity * np.maximum(n, m))]
                free[hit] = False
                out += [(i, int(j)) for j in hit]
                queue += hit.tolist()
    return out


def with_prefixes(df: DataFrame, shingle: int, similarity: int, prints: bool = False) -> DataFrame:
    """(id, lw_copy, lw_set, lw_size, lw_bits, lw_prefix) of (id, text): a hash of the text, one of its set (null if empty), its bitmap and least tokens.

    With ``prints`` also lw_print, the SimHash of the text's shingles.
    """

    def run(texts: list[str]) -> list[pa.Array]:
        every = [hashes(t, shingle) for t in texts]
        sets = [np.unique(h) for h in every]
        names = [int(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64)) if len(s) else None for s in sets]
        prefixes = [s[: prefix_length(len(s), similarity)].view(np.int64) for s in sets]
        bits = [bitmap(s).tobytes() if len(s) else None for s in sets]
        out = [pa.array(names, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array(bits, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))]
        return [*out, pa.array(np.array([voted(h) for h in every], np.uint64).view(np.int64))] if prints else out

    hashed = df.withColumn("lw_copy", F.xxhash64("text"))
    fields = "lw_set long, lw_size int, lw_bits binary, lw_prefix array<long>" + ", lw_print long" * prints
    return map_texts(hashed, run, fields, drop=("text",))


def spread(df: DataFrame) -> DataFrame:
    """``df``, to be sent to all workers if it has few rows."""
    return F.broadcast(df) if df.count() <= FEW else df


def fingerprint_pairs(sets: DataFrame) -> DataFrame:
    """(a, b): pairs of sets that connect all whose fingerprints (column ``print``) SimHash links, those of one fingerprint too."""
    least = stored(sets.groupBy("print").agg(F.min("set").alias("least"), F.count("*").alias("n")))
    one, other = (least.select(F.col("print").alias(p), F.col("least").alias(s)) for p, s in (("a", "x"), ("b", "y")))
    near = fingerprint_links(least.select(F.col("print").alias("simhash"))).distinct().join(one, "a").join(other, "b").select("x", "y")
    several = spread(stored(least.where("n > 1").select("print", "least")))
    same = sets.select("print", "set").join(several, "print").where("set <> least").select(F.col("least").alias("x"), F.col("set").alias("y"))
    return near.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def unlinked(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components of ``known`` (node, component)."""
    known = spread(known)
    for end in ("a", "b"):
        pairs = pairs.join(known.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    return pairs.where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")


def indexed(rows: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """(sig, set, size): the signatures of the sets that share as many prefix tokens with others as a similar set would.

    Tokens are counted with partial aggregation; only those of two sets at least go on.
    """
    tokens = rows.where("lw_set is not null").select(F.explode("lw_prefix").alias("token"), F.col("lw_set").alias("set"))
    ends = tokens.groupBy("token").agg(F.min("set").alias("lo"), F.max("set").alias("hi")).where("lo <> hi").select("token")
    shared = stored(tokens.join(ends, "token").groupBy("set", "token").agg(F.lit(1).alias("one")).select("set", "token"))
    counts = shared.groupBy("token").agg(F.count("*").alias("n"))
    lists = shared.join(counts, "token").groupBy("set").agg(F.collect_list("token").alias("tokens"), F.collect_list(F.col("n")).alias("counts"))
    # of the similar sets' prefixes, the one that ends first has so many tokens in common with the other
    enough = F.expr(f"size(tokens) > ({similarity} * size + 99) div 100 div {EXTRA}")
    kept = lists.join(sets.select("set", "size"), "set").where(enough)

    def run(batches):
        for batch in batches:
            names, sizes = batch.column("set").to_numpy(), batch.column("size").to_numpy()
            tokens, counts = batch.column("tokens"), batch.column("counts")
            made = [
                signatures(np.asarray(tokens[i].values, np.int64).view(np.uint64), np.asarray(counts[i].values), int(sizes[i]), similarity).view(np.int64)
                for i in range(batch.num_rows)
            ]
            n = [len(x) for x in made]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(made)), pa.array(np.repeat(names, n)), pa.array(np.repeat(sizes, n))], names=["sig", "set", "size"]
            )

    return kept.mapInArrow(run, "sig long, set long, size int")


def with_tokens(docs: DataFrame, sets: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(set, tokens): the shingles of each set of ``wanted``, made anew from one of its texts.

    The names of the texts go to all workers if they are few, else texts are joined to them.
    """
    names = spread(stored(sets.join(wanted, "set").select("set", "lw_copy")))
    texts = docs.select("text", F.xxhash64("text").alias("lw_copy")).join(names, "lw_copy").select("set", "text")

    def run(batch: list[str]) -> list[pa.Array]:
        return [pa.array([shingles(t, shingle).view(np.int64) for t in batch], pa.list_(pa.int64()))]

    made = map_texts(texts, run, "tokens array<long>", drop=("text",))
    return made.dropDuplicates(["set"])


def verified(pairs: DataFrame, tokens: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) of sets that are similar; an a of more than ``PART`` pairs is dealt to several tasks."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.expr("cast(pmod(xxhash64(b), parts) as int)").alias("part"))
    heads = dealt.select("a", "part").distinct().select("a", "part", F.col("a").alias("b"), F.lit(0).alias("side"))
    named = heads.unionByName(dealt.select("a", "part", "b", F.lit(1).alias("side")))
    full = named.join(tokens, named.b == tokens.set).select("a", "part", "side", "b", "tokens")
    ordered = full.repartition("a", "part").sortWithinPartitions("a", "part", "side")

    def check(batches):
        own = None
        for batch in batches:
            a, b, tokens, out = batch.column("a").to_pylist(), batch.column("b").to_pylist(), batch.column("tokens"), []
            for i, side in enumerate(batch.column("side").to_pylist()):
                other = np.asarray(tokens[i].values, np.int64)
                if side == 0:
                    own = other
                    continue
                both = len(np.intersect1d(own, other, assume_unique=True))
                if similar(both, len(own), len(other), similarity):
                    out.append((a[i], b[i]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], names=["a", "b"])

    return ordered.mapInArrow(check, "a long, b long")


def across(mixed_sets: DataFrame, tokens: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) between sets of one cluster (sig, set, size, root) whose components differ, enough to join what is linked.

    A cluster is cut into parts: a component of ``PART`` sets or more has parts of its own, which never meet each other;
    the rest share parts.  Two parts are one task's work, done as an overlap matrix; only links come out of it.
    """
    weight = F.greatest(F.ceil(F.count("*") / PART), F.ceil(F.sum("size") / PART_TOKENS)).cast("int")
    by_root = mixed_sets.groupBy("sig", "root").agg(F.count("*").alias("n"), F.sum("size").alias("w"), weight.alias("parts"))
    large = F.col("parts") > 1
    small = by_root.groupBy("sig").agg(
        F.greatest(F.ceil(F.sum(F.when(~large, F.col("n"))) / PART), F.ceil(F.sum(F.when(~large, F.col("w"))) / PART_TOKENS), F.lit(1)).cast("int").alias("small")
    )
    own = F.when(large, F.col("root"))
    planned = by_root.join(small, "sig").select("sig", "root", own.alias("only"), F.when(large, F.col("parts")).otherwise(F.col("small")).alias("cut"))
    part = F.when(F.col("only").isNotNull(), F.xxhash64("only", F.expr("pmod(xxhash64(set), cut)"))).otherwise(F.expr("pmod(xxhash64(root, 7), cut)"))
    placed = mixed_sets.join(planned, ["sig", "root"]).select("sig", "set", "root", "only", part.alias("part"))
    there = placed.groupBy("sig", "part").agg(F.first("only").alias("only")).groupBy("sig").agg(F.collect_list(F.struct("part", "only")).alias("all"))
    met = placed.join(there, "sig").select("sig", "set", "root", "part", "only", F.explode("all").alias("other"))
    met = met.where("other.only is null or only is null or other.only <> only").select(
        "sig", "set", "root", "part", F.least("part", "other.part").alias("lo"), F.greatest("part", "other.part").alias("hi")
    )
    dealt = met.join(tokens, "set").repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi", "set")

    def compare(batches):
        held, name = [], None

        def done():
            one, two = name[1:]
            names = np.array([h[0] for h in held])
            roots = np.array([h[1] for h in held])
            sets = [h[3] for h in held]
            n = np.array([len(s) for s in sets])
            if one == two:
                left = right = np.arange(len(held))
                shared = overlaps(sets)
            else:
                part = np.array([h[2] for h in held])
                left, right = np.flatnonzero(part == one), np.flatnonzero(part == two)
                if not len(left) or not len(right):
                    return None
                shared = overlaps([sets[i] for i in left], [sets[i] for i in right])
            hit = similar(shared, n[left][:, None], n[right][None, :], similarity) & (roots[left][:, None] != roots[right][None, :])
            i, j = np.nonzero(np.triu(hit) if one == two else hit)
            if not len(i):
                return None
            # one link between two components is enough
            ends = np.sort(np.stack([roots[left[i]], roots[right[j]]]), axis=0)
            _, first = np.unique(ends, axis=1, return_index=True)
            return pa.RecordBatch.from_arrays([pa.array(names[left[i[first]]]), pa.array(names[right[j[first]]])], names=["a", "b"])

        for batch in batches:
            sig, lo, hi, sets, roots, parts = (batch.column(c).to_pylist() for c in ("sig", "lo", "hi", "set", "root", "part"))
            tokens = batch.column("tokens")
            for i in range(batch.num_rows):
                this = (sig[i], lo[i], hi[i])
                if held and this != name:
                    if (out := done()) is not None:
                        yield out
                    held = []
                name = this
                held.append((sets[i], roots[i], parts[i], np.asarray(tokens[i].values, np.int64)))
        if held and (out := done()) is not None:
            yield out

    return dealt.mapInArrow(compare, "a long, b long")


def candidates(met: DataFrame, similarity: int) -> DataFrame:
    """(a, b): of the buckets (sig, set, size, bits), pairs that connect all sets that may be similar by their bitmaps.

    A bucket of more than ``PART_BITS`` sets is cut; two parts are one task's work.  What comes out is a forest.
    """
    sizes = met.groupBy("sig").agg(F.ceil(F.count("*") / PART_BITS).cast("int").alias("parts"))
    placed = met.join(sizes, "sig").withColumn("part", F.expr("cast(pmod(xxhash64(set), parts) as int)"))
    placed = placed.select("sig", "set", "size", "bits", "part", F.explode(F.expr("sequence(0, parts - 1)")).alias("other"))
    placed = placed.select("sig", "set", "size", "bits", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    dealt = placed.repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi", "set")

    def compare(batches):
        held, name = [], None

        def done():
            part = np.array([h[2] for h in held])
            pairs = forest([np.frombuffer(h[3], np.uint64) for h in held], np.array([h[1] for h in held]), part if name[1] != name[2] else None, similarity)
            if not pairs:
                return None
            ends = [sorted((held[i][0], held[j][0])) for i, j in pairs]
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*ends)], names=["a", "b"])

        for batch in batches:
            sig, lo, hi, *rest = (batch.column(c).to_pylist() for c in ("sig", "lo", "hi", "set", "size", "part", "bits"))
            for this, row in zip(zip(sig, lo, hi), zip(*rest)):
                if held and this != name:
                    if (out := done()) is not None:
                        yield out
                    held = []
                name = this
                held.append(row)
        if held and (out := done()) is not None:
            yield out

    return dealt.mapInArrow(compare, "a long, b long").distinct()


def left_over(clusters: DataFrame, found: DataFrame, sets: DataFrame, tokens: DataFrame, similarity: int) -> DataFrame:
    """Links (a, b) across the components of ``found`` that a cluster (set, sig) holds, where it holds several."""
    root = components(found).withColumnRenamed("node", "set")
    placed = clusters.join(sets.select("set", "size"), "set").join(root, "set", "left").withColumn("root", F.coalesce("component", "set")).drop("component")
    several = placed.groupBy("sig").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("sig")
    rest = stored(placed.join(several, "sig"))
    return across(rest, tokens, similarity)


def links(signed: DataFrame, docs: DataFrame, sets: DataFrame, shingle: int, similarity: int, near: DataFrame | None = None) -> DataFrame:
    """(a, b): similar sets, enough of them to connect all that are linked.

    Pairs of ``near``, if given, are verified before all others, and what they connect is not verified again.  They are
    a forest of what fingerprints propose; a group of it that then holds several components is compared across those,
    so that all proposed pairs are decided.

    Buckets of the same members count once.  Bitmaps tell in each bucket which sets may be similar; what they connect is
    a cluster, and no link leaves one.  The pairs that made the clusters are verified first, which settles nearly all of
    them; a cluster that then still holds several components is compared across those.
    """
    member = F.sum(F.xxhash64("set").cast("decimal(38,0)"))
    buckets = signed.groupBy("sig").agg(F.count("*").alias("n"), member.alias("f")).where("n > 1")
    once = buckets.groupBy("n", "f").agg(F.min("sig").alias("sig")).select("sig")
    met = signed.join(once, "sig").join(sets.select("set", "bits"), "set")
    pairs = stored(candidates(met, similarity))
    clusters = stored(components(pairs).withColumnRenamed("node", "set").withColumnRenamed("component", "sig"))
    wanted = clusters.select("set")
    if near is not None:
        wanted = wanted.unionByName(near.select(F.explode(F.array("a", "b")).alias("set"))).distinct()
    tokens = stored(with_tokens(docs, sets, wanted, shingle))
    if near is None:
        found = stored(verified(pairs, tokens, similarity))
    else:
        first = stored(verified(near, tokens, similarity))
        groups = stored(components(near).withColumnRenamed("node", "set").withColumnRenamed("component", "sig"))
        first = stored(first.unionByName(left_over(groups, first, sets, tokens, similarity)))
        left = unlinked(pairs, stored(components(first)))
        found = stored(first.unionByName(verified(left, tokens, similarity)))
    return found.unionByName(left_over(clusters, found, sets, tokens, similarity))


def classes(rows: DataFrame, docs: DataFrame, shingle: int, similarity: int) -> tuple[DataFrame, DataFrame]:
    """The different sets of ``rows`` with their least id, and (set, root) of each: equal for all that links connect.

    If the rows have fingerprints, SimHash finds the first links.
    """
    prints = [F.min("lw_print").alias("print")] if "lw_print" in rows.columns else []
    by_set = rows.where("lw_set is not null").groupBy(F.col("lw_set").alias("set"))
    sets = stored(by_set.agg(F.min("lw_size").alias("size"), F.min("lw_copy").alias("lw_copy"), F.min("lw_bits").alias("bits"), F.min("id").alias("least"), *prints))
    near = stored(fingerprint_pairs(sets)) if prints else None
    signed = stored(indexed(rows, sets, similarity))
    found = components(links(signed, docs, sets, shingle, similarity, near))
    return sets, sets.join(found, sets.set == found.node, "left").select("set", F.coalesce("component", "set").alias("root"))


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """(id, size, component): each row's number of distinct shingles and the smallest id that links reach from it.

    Documents link if of all shingles of both, ASCII letters in lower case, ``similarity`` in a hundred are shared.
    A text of fewer than ``shingle`` words is one shingle.  Null, empty and blank texts have none; they link with
    nothing, and each is its own component.  Shingles and sets are told apart by 64-bit hashes.  Equal sets are one
    set whatever their number; the join is between different sets and loses no link between them.  A repeated row
    comes back as often; a null id links like another, but the smallest is of those that are not null (null if
    none).  An empty table gives an empty one.  Sets of any size are handled whole.
    """
    docs = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = stored(with_prefixes(docs, shingle, similarity))
    sets, named = classes(rows, docs, shingle, similarity)
    named = named.join(sets.select("set", "least"), "set")
    least = named.groupBy("root").agg(F.min("least").alias("component"))
    labelled = named.join(least, "root").select(F.col("set").alias("lw_set"), "component")
    joined = rows.select("id", F.col("lw_size").cast("long").alias("size"), "lw_set").join(labelled, "lw_set", "left")
    return joined.select("id", "size", F.when(F.col("lw_set").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: int = SIMILARITY) -> DataFrame:
    """The rows that keep one document of each component of similar ones: the one with the smallest id.

    Documents link as in ``similar_documents``, but texts without words are copies of each other here.  Of rows that
    share the smallest id one text stays, and one of equal rows; rows whose id is null stay all, as nothing tells them
    apart.  An empty table gives an empty one; all columns stay, whatever their names.

    SimHash comes first: of sets whose fingerprints differ in four bits at most, all that are similar by their shingles
    are linked; what links connect already is not verified again.  The join of shingles then finds the links that
    fingerprints miss.

    Only ids and hashes of texts are shuffled: what goes is taken out of ``df`` by an anti join.
    """
    names = df.columns
    df = df.toDF(*[f"in_{i}" for i in range(len(names))])  # so that no column clashes with those made here
    id_col, text_col = (f"in_{names.index(c)}" for c in (id_col, text_col))
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = stored(with_prefixes(docs, shingle, similarity, prints=True))
    _, named = classes(rows, docs, shingle, similarity)
    rooted = rows.where("id is not null").select("id", "lw_copy", F.col("lw_set").alias("set")).join(named, "set", "left")
    copies = stored(rooted.groupBy("root", "id", "lw_copy").agg(F.count("*").alias("n")))
    first = copies.groupBy(F.col("root").alias("r")).agg(F.min(F.struct("id", "lw_copy")).alias("first"))
    # rows that go, and those of which one of several equal ones stays
    marked = copies.join(first, F.col("root").eqNullSafe(F.col("r"))).where("n > 1 or not (struct(id, lw_copy) <=> first)")
    marked = stored(marked.select(F.col("id").alias("lw_id"), "lw_copy", F.expr("struct(id, lw_copy) <=> first").alias("lw_one")))
    marked = spread(marked)
    copy = F.xxhash64(F.col(text_col))
    here = (F.col(id_col) == F.col("lw_id")) & (copy == F.col("lw_copy"))
    kept = df.join(marked, here, "left_anti")
    one = df.join(marked.where("lw_one"), here).dropDuplicates(["lw_id", "lw_copy"]).select(*df.columns)
    return kept.unionByName(one).toDF(*names)
