"""Strokes against plain readings on random points."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loreweave.functions import strokes


def strokes_of(seed, n=40):
    rng = random.Random(seed)
    out = [[], [(1.0, 2.0)], [(3.0, 3.0)] * 4, [(0.0, 0.0), (10.0, 0.0)]]
    for _ in range(n):
        x, y, s = rng.uniform(0, 100), rng.uniform(0, 100), []
        for _ in range(rng.randint(2, 40)):
            x, y = x + rng.choice([0, rng.uniform(-9, 9)]), y + rng.choice([0, rng.uniform(-9, 9)])
            s.append((round(x, 2), round(y, 2)))
        out.append(s)
    return out


def apply(spark, rows, expr, fields="x:double,y:double"):
    df = spark.createDataFrame(list(enumerate(rows)), f"i int, p array<struct<{fields}>>")
    return [[tuple(q) for q in r.o] for r in df.select("i", F.expr(expr).alias("o")).orderBy("i").collect()]


def close(a, b):
    return len(a) == len(b) and all(math.dist(p, q) < 1e-6 for p, q in zip(a, b))


@pytest.mark.parametrize("n", [1, 2, 3, 16])
def test_even_spacing(spark, n):
    for s, got in zip(strokes_of(1), apply(spark, strokes_of(1), strokes.resampled("p", n))):
        assert len(got) == (n if s else 0)
        if not s:
            continue
        total = [0.0]
        for a, b in zip(s, s[1:]):
            total.append(total[-1] + math.dist(a, b))
        want = []
        for k in range(n):
            goal = total[-1] * k / (n - 1) if n > 1 else 0
            i = next((i for i in range(1, len(s)) if total[i] >= goal and total[i] > total[i - 1]), None)
            t = (goal - total[i - 1]) / (total[i] - total[i - 1]) if i else 0
            want.append((s[i - 1][0] + t * (s[i][0] - s[i - 1][0]), s[i - 1][1] + t * (s[i][1] - s[i - 1][1])) if i else s[0])
        assert close(got, want)


@pytest.mark.parametrize("epsilon", [0.5, 3.0, 50.0])
def test_simplified(spark, epsilon):
    def off(p, a, b):
        w = math.dist(a, b) ** 2
        t = max(0, min(1, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / w)) if w else 0
        return math.dist(p, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))

    def keep(s, lo, hi):
        best = max(range(lo + 1, hi), key=lambda i: (off(s[i], s[lo], s[hi]), -i), default=None)
        return keep(s, lo, best) | keep(s, best, hi) if best is not None and off(s[best], s[lo], s[hi]) > epsilon else {lo, hi}

    for s, got in zip(strokes_of(2), apply(spark, strokes_of(2), strokes.simplified("p", epsilon))):
        assert got == (s if len(s) < 3 else [s[i] for i in sorted(keep(s, 0, len(s) - 1))])


def test_hulls(spark):
    for s, got in zip(strokes_of(3), apply(spark, strokes_of(3), strokes.hull("p"))):
        points = sorted(set(s))
        if len(points) < 3:
            assert got == points
            continue
        cross = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
        corners = [a for a in points if any(all(cross(a, b, c) > 1e-9 or (abs(cross(a, b, c)) <= 1e-9 and math.dist(a, c) <= math.dist(a, b) and (c[0] - a[0]) * (b[0] - a[0]) + (c[1] - a[1]) * (b[1] - a[1]) >= 0) for c in points if c not in (a, b)) for b in points if b != a)]
        assert set(got) == set(corners) and got[0] == points[0]
        assert len(got) < 3 or all(cross(a, b, c) > 0 for a, b, c in zip(got, got[1:] + got[:1], got[2:] + got[:2]))


def test_one_euro(spark):
    rng = random.Random(4)
    rows = []
    for s in strokes_of(5):
        t, timed = 0.0, []
        for x, y in s:
            timed.append((x, y, t))
            t += rng.choice([0.0, 1.0, 8.0, 16.0, 120.0])
        rows.append(timed)
    alpha = lambda c, dt: 1 / (1 + 1 / (2 * math.pi * c) / dt)
    for s, got in zip(rows, apply(spark, rows, strokes.smoothed("p"), "x:double,y:double,t:double")):
        want = []
        for axis in (0, 1):
            value = speed = last = None
            for p in s:
                v, t = p[axis], p[2]
                if value is None:
                    value, speed = v, 0.0
                elif t <= last:
                    value = 0.5 * v + 0.5 * value
                else:
                    dt = max(4, t - last) / 1000
                    speed = alpha(1.0, dt) * (v - value) / dt + (1 - alpha(1.0, dt)) * speed
                    a = alpha(2.5 + 0.04 * abs(speed), dt)
                    value = a * v + (1 - a) * value
                last = t
                want.append(value)
        assert close(got, list(zip(want[: len(s)], want[len(s) :])))


def test_quantized(spark):
    rows = [[(0.04, 0.05, 0.5), (0.0, 0.1, 0.7), (0.0, 0.1, 2.0), (1.26, -1.26, -1.0)], []]
    assert apply(spark, rows, strokes.quantized("p"), "x:double,y:double,p:double") == [[(0.0, 0.1, 1.0), (1.3, -1.3, 0.0)], []]
