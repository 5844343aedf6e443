"""Near copies against brute force."""

import random

import numpy as np
import pytest
import xxhash

import corpus_pipeline
from loreweave.llm import ngram_join, simhash

SCHEMA = "doc_id long, text string"


def plain(rows, shingle=5, similarity=0.8):
    """The smallest id of each component, all pairs compared."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))} if w else set())
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or len(a & b) >= similarity * len(a | b):
                x, y = label[i], label[j]
                label = [y if l == x else l for l in label]
    return sorted(min(i for (i, _), m in zip(rows, label) if m == l) for l in set(label))


@pytest.mark.parametrize("changes", [(1, 1), (2, 5), (0, 12)])
def test_near_copies_equal_brute_force(spark, changes):
    r = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = [(0, None), (1, " "), (2, "the end"), (3, "The  end"), (4, "the other end")]
    for _ in range(25):
        text = [r.choice(words) for _ in range(r.choice([60, 300]))]
        for _ in range(6):
            copy = list(text)
            for at in r.sample(range(len(copy)), r.randint(*changes)):
                copy[at] = r.choice(words)
            rows.append((len(rows), " ".join(copy)))
    r.shuffle(rows)
    got = sorted(x.doc_id for x in ngram_join.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == plain(rows)


def test_one_changed_word_in_a_long_text_is_a_copy(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART", 3)
    r = random.Random(8)
    text = [f"w{r.randrange(3000)}" for _ in range(300)]
    rows = [(i, " ".join([*text[: 20 * i], "changed", *text[20 * i + 1 :]])) for i in range(12)] + [(None, "no id"), (None, "no id")]
    got = ngram_join.deduplicate(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [x.doc_id for x in got if x.doc_id is not None] == [0] and len(got) == 3


def test_fingerprints_find_links_that_shingles_verify(spark, monkeypatch):
    """Without the join of shingles the links of SimHash are there, and texts of one fingerprint that share few shingles stay apart."""
    nothing = "sig long, set long, size int"
    monkeypatch.setattr(ngram_join, "indexed", lambda rows, sets, similarity: spark.createDataFrame([], nothing))
    r = random.Random(9)
    text = [f"w{r.randrange(3000)}" for _ in range(3000)]
    loop = "a b c d e f g " * 400
    tails = [" ".join(f"{c}{k}" for k in range(30)) for c in "xy"]
    rows = [(i, " ".join([*text[: 200 * i], "changed", *text[200 * i + 1 :]])) for i in range(6)]
    rows += [(10 + i, loop + tail) for i, tail in enumerate(tails)] + [(20, " ".join(text[::-1]))]
    prints = [simhash.fingerprint(t, 5) for _, t in rows[6:8]]
    assert (prints[0] ^ prints[1]).bit_count() <= simhash.RADIUS
    got = sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    assert got == plain(rows) == [0, 10, 11, 20]


def test_fingerprint_pairs_equal_brute_force(spark):
    """Sets of one fingerprint are paired too; pairs connect what is within the radius and nothing else."""
    r = random.Random(4)
    prints = [r.getrandbits(64) for _ in range(40)]
    prints += [p ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for p in prints[:20]] + prints[:10] + prints[:10]
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    sets = spark.createDataFrame([(i, signed(p)) for i, p in enumerate(prints)], "set long, print long")
    pairs = [(x.a, x.b) for x in ngram_join.fingerprint_pairs(sets).collect()]
    near = [[j for j, q in enumerate(prints) if (p ^ q).bit_count() <= simhash.RADIUS] for p in prints]
    label = list(range(len(prints)))
    for _ in range(10):
        label = [min(label[j] for j in own) for own in near]
    found = list(range(len(prints)))
    for _ in range(10):
        for a, b in pairs:
            found = [min(found[a], found[b]) if f in (found[a], found[b]) else f for f in found]
    assert found == label and all(a < b for a, b in pairs)


def test_a_proposed_pair_beside_failed_ones_is_verified(spark, monkeypatch):
    """A third text of their fingerprint may take both pairs of the forest from two copies; the copies are linked still."""
    monkeypatch.setattr(ngram_join, "indexed", lambda rows, sets, similarity: spark.createDataFrame([], "sig long, set long, size int"))
    texts = ["a b c d e f g " * 400 + " ".join(f"{c}{k}" for k in range(30)) for c in "pqrstuvwxyz"]
    name = lambda t: np.uint64(xxhash.xxh64_intdigest(ngram_join.shingles(t).tobytes(), simhash.SEED)).view(np.int64)
    third, one = sorted(texts, key=name)[0], sorted(texts, key=name)[-1]
    copy = next(t for t in (f"{one}{k}" for k in range(99)) if name(t) > name(third))  # the last word is another
    rows = [(0, one), (1, copy), (2, third)]
    assert len({simhash.fingerprint(t, 5) for _, t in rows}) == 1
    got = sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "").collect())
    assert got == plain(rows) == [0, 2]
