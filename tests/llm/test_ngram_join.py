"""The n-gram join against all pairs, with rare and frequent tokens, and on hard small inputs."""

import random

import numpy as np
import pytest

from loreweave.llm import ngram_join

SCHEMA = "doc_id long, text string"


def by_all_pairs(docs):
    """n_shingles and component of each row, by comparing every two texts."""
    sets = []
    for _, t in docs:
        w = ngram_join.WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(docs)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                top[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(s), least.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(docs, sets))), key=str)


def near_copies(rng, n):
    """Texts of all lengths with copies at all distances, and passages that many share."""
    words = [f"w{i}" for i in range(400)]
    passages = [[rng.choice(words) for _ in range(rng.randint(8, 60))] for _ in range(4)]
    made = []
    while len(made) < n:
        w = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 6, 9, 30, 80, 200, 500]))]
        if rng.random() < 0.5:
            w[:0] = rng.choice(passages)
        for _ in range(rng.choice([1, 2, 8])):
            c = list(w)
            for _ in range(rng.randint(0, max(1, len(c) // 40))):
                at = rng.randrange(len(c))
                c[at : at + rng.choice([0, 1])] = [rng.choice(words).upper()]
            made.append(" ".join(c))
            w = rng.choice([w, c])
    return list(enumerate(made[:n]))


def found(spark, docs):
    df = spark.createDataFrame(docs, SCHEMA)
    return sorted((tuple(r) for r in ngram_join.similar_documents(df).collect()), key=str)


@pytest.mark.parametrize("seed,rare,part,few", [(1, 64, 256, 1 << 20), (2, 2, 4, 0), (3, 1, 256, 1 << 20)])
def test_equals_all_pairs(spark, monkeypatch, seed, rare, part, few):
    monkeypatch.setattr(ngram_join, "RARE", rare)
    monkeypatch.setattr(ngram_join, "PART", part)
    monkeypatch.setattr(ngram_join, "PART_BITS", 2 * part)
    monkeypatch.setattr(ngram_join, "FEW", few)
    docs = near_copies(random.Random(seed), 300)
    assert found(spark, docs) == by_all_pairs(docs)


def test_no_similar_pair_without_a_signature():
    """Pairs just above the threshold share a signature whether their tokens are rare or frequent."""
    rng = np.random.default_rng(5)
    for _ in range(400):
        n = int(rng.integers(1, 400))
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        drop, add = int(rng.integers(0, len(a) // 8 + 1)), int(rng.integers(0, len(a) // 8 + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        p, q = (x[: ngram_join.prefix_length(len(x))] for x in (a, b))
        common = np.intersect1d(p, q)
        for x in (a, b):
            assert len(common) > -(-80 * len(x) // 100) // ngram_join.EXTRA
        for many in (1, 1000):  # frequent for all, as counts are global
            s, t = (ngram_join.signatures(common, np.full(len(common), many), len(x)) for x in (a, b))
            assert len(np.intersect1d(s, t))


def test_odd_rows(spark):
    docs = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One  TWO"), (5, "one two"), (6, "a b c d e"), (7, "a b c d e"),
        (None, "a b c d e"), (None, "only here"), (8, "ab " * 5000), (9, "AB " * 700), (10, "É b c d e"), (11, "é b c d e"),
    ]
    assert found(spark, docs) == by_all_pairs(docs)
    assert found(spark, [(None, "same text"), (None, "same text")]) == [(None, 1, None)] * 2
    assert found(spark, []) == []


def test_overlaps_equal_intersections(monkeypatch):
    monkeypatch.setattr(ngram_join, "STEP", 7)
    rng = np.random.default_rng(3)
    a = [np.unique(rng.integers(0, 60, n)) for n in (0, 5, 30, 30)]
    b = [np.unique(rng.integers(0, 60, n)) for n in (1, 40)]
    own = ngram_join.overlaps(a)  # but for the diagonal, which nothing reads
    assert all(own[i, j] == len(np.intersect1d(a[i], a[j])) for i in range(4) for j in range(4) if i != j)
    assert ngram_join.overlaps(a, b).tolist() == [[len(np.intersect1d(x, y)) for y in b] for x in a]


def test_bitmaps_lose_no_similar_pair():
    """The forest connects what all similar pairs connect, whatever the sizes and their halves."""
    rng = np.random.default_rng(9)
    sets = []
    for n in (1, 4, 20, 60, 70, 250, 260, 1000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        for _ in range(6):
            sets.append(np.unique(np.concatenate([rng.permutation(a)[n // 12 :], rng.integers(0, 1 << 63, n // 12, np.uint64)])))
    bits, sizes = [ngram_join.bitmap(s) for s in sets], np.array([len(s) for s in sets])
    pairs = ngram_join.forest(bits, sizes, None, 80)
    top = list(range(len(sets)))
    for i, j in pairs:
        top = [top[i] if t == top[j] else t for t in top]
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                assert top[i] == top[j]
    assert len(pairs) < len(sets) and len(set(top)) >= 8
    side = np.arange(len(sets)) % 2
    assert all(side[i] != side[j] for i, j in ngram_join.forest(bits, sizes, side, 80))
