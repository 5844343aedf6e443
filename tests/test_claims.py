"""Bibliographies against a reading entry by entry."""

import random

import pytest

from loreweave.operators import records, resolve


def one_by_one(entries, sources):
    title = lambda t: "".join(c for c in (t or "").lower() if c.isalnum())
    by_doi, by_ty, by_title, by_key, by_id = {}, {}, {}, {}, {}
    for s in sorted(sources):
        i, doi, t, y, key = s
        by_id[str(i)] = i
        if key:
            by_key[key.lower()] = i
        if doi:
            by_doi[doi.lower()] = i
        if len(title(t)) >= 4:
            by_ty[title(t), y] = i
            by_title[title(t)] = None if title(t) in by_title else i
    out, seen = set(), set()
    for i, doi, t, y, key, ref in sorted(entries):
        src = by_id.get(ref) or by_key.get((key or "").lower()) or by_doi.get((doi or "").lower()) or by_ty.get((title(t), y)) or by_title.get(title(t))
        if src and src not in seen:
            seen.add(src)
            out.add((i, src))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_matches_equal_a_reading_in_order(spark, seed):
    rng = random.Random(seed)
    doi = lambda: rng.choice([None, *(f"10.1234/X{k}" for k in range(8))])
    name = lambda: rng.choice(["Deep nets", "deep  NETS!", "Graph theory", "On logic", "abc", None, *(f"Paper number {k}" for k in range(5))])
    key = lambda: rng.choice([None, "", *(f"Key{k}" for k in range(30))])
    sources = [(100 + k, doi(), name(), rng.choice([1999, 2000, None]), key()) for k in range(12)]
    entries = [(k, doi(), name(), rng.choice([1999, 2000, None]), key(), rng.choice([None] * 6 + [str(100 + rng.randrange(20))])) for k in range(25)]
    e = spark.createDataFrame(entries, "id long, doi string, title string, year int, key string, ref string")
    s = spark.createDataFrame(sources, "id long, doi string, title string, year int, key string")
    assert {(r.entry_id, r.source_id) for r in resolve.bib_match(e, s).collect()} == one_by_one(entries, sources)


def test_a_later_entry_of_a_source_is_passed_over(spark):
    columns = "id long, doi string, title string, year int"
    sources = spark.createDataFrame([(1, "10.1234/a", "First paper", 2000), (2, None, "Second paper", 2001)], columns)
    entries = spark.createDataFrame([(1, None, "First paper", 2000), (2, "10.1234/A", "Second paper", 2001)], columns)
    assert [tuple(r) for r in resolve.bib_match(entries, sources).collect()] == [(1, 1, "title-year")]


def synced(ours, theirs):
    items = {t[0]: t for t in sorted(theirs)}
    low = lambda x: str(x).strip().lower() if x is not None else ""
    by_doi, by_ty = {}, {}
    for k, doi, t, y, _ in sorted(theirs):
        if low(doi):
            by_doi.setdefault(low(doi), k)
        if low(t) and low(y):
            by_ty.setdefault((low(t), low(y)), k)
    claimed, out = {o[1] for o in ours if o[1]}, set()
    linked = set()
    for i, link, doi, t, y, stamp, since in sorted(ours):
        if link:
            v = items[link][4] if link in items else None
            out.add((i, link, "unlink" if v is None else "update local" if v > since else "update remote" if stamp > since else "same"))
            linked.add(link)
            continue
        key = by_doi.get(low(doi)) or by_ty.get((low(t), low(y)))
        if key and key not in claimed:
            claimed.add(key)
            linked.add(key)
            out.add((i, key, "link"))
        else:
            out.add((i, None, "create"))
    return out | {(None, k, "remote only") for k in items if k not in linked}


@pytest.mark.parametrize("seed", range(3))
def test_sync_equals_a_reading_in_order(spark, seed):
    rng = random.Random(seed)
    doi, name, year = lambda: rng.choice([None, "", *(f"10.1/X{k}" for k in range(6))]), lambda: rng.choice([None, "Deep nets", " deep nets", "Logic"]), lambda: rng.choice([None, 1, 2])
    theirs = [(f"Z{k}", doi(), name(), year(), rng.randrange(6)) for k in range(10)]
    links = rng.sample([f"Z{k}" for k in range(14)], 5)
    ours = [(k, links[k] if k < 5 else None, doi(), name(), year(), rng.randrange(6), 3) for k in range(20)]
    a = spark.createDataFrame(ours, "id long, link string, doi string, title string, year int, stamp int, synced int")
    b = spark.createDataFrame(theirs, "key string, doi string, title string, year int, version int")
    assert {tuple(r) for r in records.remote_plan(a, b).collect()} == synced(ours, theirs)
