"""Boxes and writing against all pairs."""

import random

import pytest

from loreweave.operators import ink, records

SCHEMA = "group int, id int, x double, y double, w double, h double"


def pages(seed, n=160):
    """Words in lines on three pages, one box as wide as the page, and stray marks."""
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        line, word = rng.randrange(12), rng.randrange(14)
        rows.append((k % 3, k, 30 + 40 * word + rng.uniform(-4, 4), 40 + rng.choice([22, 30, 60]) * line + rng.uniform(-3, 3), rng.uniform(2, 34), rng.uniform(2, 22)))
    return [*rows, (0, 9000, 0.0, 100.0, 700.0, 3.0), (1, 9001, 5.0, 5.0, 0.0, 0.0)]


@pytest.mark.parametrize("gap", [0.0, 12.0, 200.0])
def test_near_boxes_of_all_sizes(spark, gap):
    rows = pages(1)
    apart = lambda p, s, q, t: max(0.0, p - q - t, q - p - s)
    want = {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and apart(a[2], a[4], b[2], b[4]) <= gap and apart(a[3], a[5], b[3], b[5]) <= gap}
    assert {(r.a, r.b) for r in records.near_boxes(spark.createDataFrame(rows, SCHEMA), gap).collect()} == want


def grouped(rows):
    """Lines and blocks by union-find over all pairs of a page."""
    out = {}
    for page in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == page]
        marks = sorted(m for m in (max(h, w / 2) for _, _, _, _, w, h in own if max(w, h) <= 150) if m > 3)
        xh = (marks[(len(marks) - 1) // 2] + marks[len(marks) // 2]) / 2 if marks else 0
        lh = max(xh, 10)

        def union(items, alike):
            top = {i: i for i in items}
            find = lambda i: i if top[i] == i else find(top[i])  # noqa: E731, B023
            for a in items:
                for b in items:
                    if a < b and alike(items[a], items[b]):
                        x, y = find(a), find(b)
                        top[max(x, y)] = min(x, y)
            return {i: find(i) for i in items}

        gap = lambda p, s, q, t: max(0.0, p - q - t, q - p - s)

        def same(a, b):
            (x, y, w, h), (u, v, s, t) = a, b
            hi, hj = max(h, lh / 2), max(t, lh / 2)
            shared = min(y + h / 2 + hi / 2, v + t / 2 + hj / 2) - max(y + h / 2 - hi / 2, v + t / 2 - hj / 2)
            return shared / min(hi, hj) >= 0.3 and gap(x, w, u, s) <= max(20, lh * 1.3)

        line = union({r[1]: r[2:] for r in own}, same)
        boxes = {}
        for _, i, x, y, w, h in own:
            b = boxes.get(line[i], (x, y, x + w, y + h))
            boxes[line[i]] = (min(b[0], x), min(b[1], y), max(b[2], x + w), max(b[3], y + h))
        boxes = {k: (x, y, u - x, v - y) for k, (x, y, u, v) in boxes.items()}
        block = union(boxes, lambda a, b: gap(a[1], a[3], b[1], b[3]) <= lh * 0.9 and min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]) > -lh / 2)
        out |= {i: (line[i], block[line[i]]) for i in line}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_writing_equals_union_find(spark, seed):
    rows = pages(seed)
    got = {r.id: (r.line, r.block) for r in ink.writing(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == grouped(rows)


def test_a_long_chain_and_nothing(spark):
    nodes = spark.range(400).selectExpr("cast(id as int) id")
    edges = spark.range(399).selectExpr("cast((id * 7) % 400 as int) a", "cast(((id + 1) * 7) % 400 as int) b")
    assert {r.label for r in ink.connected(nodes, edges).collect()} == {0}
    assert ink.writing(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("most", [0, 53])
def test_large_and_small_pages_are_read_alike(spark, monkeypatch, most):
    """Pages above the limit, or all of them, by grids and labels; no page and null coordinates make no difference."""
    monkeypatch.setattr(ink, "SMALL", most)
    rows = pages(4)
    odd = [(None, 9100, 5.0, 5.0, 9.0, 9.0), (None, 9101, 6.0, 5.0, 9.0, 9.0), (2, 9102, None, 100.0, 9.0, 9.0)]
    got = {r.id: (r.line, r.block) for r in ink.writing(spark.createDataFrame(rows + odd, SCHEMA)).collect()}
    assert got == grouped(rows) | {i: (i, i) for _, i, *_ in odd}


def test_small_pages_shuffle_their_strokes_alone(spark, monkeypatch):
    """Boxes of small pages meet inside a row, not by cells and rounds of labels (F15)."""
    monkeypatch.setattr(ink, "connected", None)
    rows = pages(5)
    assert {r.id: (r.line, r.block) for r in ink.writing(spark.createDataFrame(rows, SCHEMA)).collect()} == grouped(rows)
    odd = [(7, 9102, None, 100.0, 9.0, 9.0), (7, 9103, 5.0, 100.0, 9.0, 9.0)]
    assert {(r.id, r.line, r.block) for r in ink.writing(spark.createDataFrame(odd, SCHEMA)).collect()} == {(9102, 9102, 9102), (9103, 9103, 9103)}
