"""Strokes as Spark SQL: even spacing, simplification, hulls and smoothing as folds over arrays of points (x, y)."""

from __future__ import annotations

import math

POINTS = "array<struct<x:double,y:double>>"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _apart(a: str, b: str) -> str:
    return f"sqrt(pow({a}.x - {b}.x, 2) + pow({a}.y - {b}.y, 2))"


def lengths(points: str) -> str:
    """SQL for the length of a stroke up to each point, 0 at the first."""
    step = f"if(i = 0, 0D, {_apart('p[i]', 'p[i - 1]')})"
    return _let(points, "p", f"aggregate(sequence(0, size(p) - 1), cast(array() as array<double>), (a, i) -> array_append(a, if(i = 0, 0D, a[i - 1] + {step})))")


def resampled(points: str, n: int) -> str:
    """SQL for a stroke as ``n`` points at even distances along it; one without length repeats its first, an empty one stays empty."""
    point = "struct({0} as x, {1} as y)"
    along = "if(p[i].x is null, null, " + point.format("p[i - 1].x + t * (p[i].x - p[i - 1].x)", "p[i - 1].y + t * (p[i].y - p[i - 1].y)") + ")"
    at = _let("array_position(transform(l, v -> v >= goal), true) - 1", "i", _let("(goal - l[int(i) - 1]) / (l[int(i)] - l[int(i) - 1])", "t", along.replace("[i", "[int(i)").replace("int(i) - 1]", "int(i) - 1]")))
    inner = f"transform(sequence(1, {n - 2}), k -> {_let(f'k * l[size(l) - 1] / {n - 1}', 'goal', at)})" if n > 2 else f"cast(array() as {POINTS})"
    whole = f"concat(array(p[0]), {inner}, array(p[size(p) - 1]))" if n > 1 else "array(p[0])"
    still = f"transform(sequence(1, {max(1, n)}), k -> p[0])"
    return _let(points, "p", f"if(size(p) = 0, p, {_let(lengths('p'), 'l', f'if(size(p) = 1 or l[size(l) - 1] = 0, {still}, {whole})')})")


def simplified(points: str, epsilon: float) -> str:
    """SQL for the points that keep a stroke within ``epsilon``: between kept ones the farthest is kept too, until none is farther.

    A round splits all stretches at once; strokes that are done pass the other rounds over.
    """
    t = "greatest(0D, least(1D, if(w = 0, 0D, ((p[i].x - a.x) * (b.x - a.x) + (p[i].y - a.y) * (b.y - a.y)) / w)))"
    far = _let(f"named_struct('t', {_let('pow(b.x - a.x, 2) + pow(b.y - a.y, 2)', 'w', t)})", "u", "sqrt(pow(p[i].x - (a.x + u.t * (b.x - a.x)), 2) + pow(p[i].y - (a.y + u.t * (b.y - a.y)), 2))")
    best = _let("p[s]", "a", _let("p[e]", "b", f"array_max(transform(sequence(s + 1, e - 1), i -> struct({far} as far, -i as i)))"))
    more = _let("k", "q", f"filter(transform(sequence(1, size(q) - 1), j -> {_let('q[j - 1]', 's', _let('q[j]', 'e', f'if(e - s < 2, null, {best})'))}), m -> m is not null and m.far > {float(epsilon)}D)")
    round_ = _let(more, "m", "if(size(m) = 0, struct(a_.k as k, true as done), struct(array_sort(concat(a_.k, transform(m, v -> -v.i))) as k, false as done))")
    fold = f"aggregate(sequence(1, size(p)), struct(array(0, size(p) - 1) as k, false as done), (a_, r) -> if(a_.done, a_, {_let('a_.k', 'k', round_)}), a_ -> transform(a_.k, i -> p[i]))"
    return _let(points, "p", f"if(size(p) < 3, p, {fold})")


def hull(points: str) -> str:
    """SQL for the corners of the convex hull, from the leftmost on; points on its sides are no corners."""
    turn = "((h[m - 1].x - h[m - 2].x) * (q.y - h[m - 2].y) - (h[m - 1].y - h[m - 2].y) * (q.x - h[m - 2].x))"
    # the stack is cut back to its longest part that the new point turns from
    push = _let("h_", "h", f"array_append(slice(h, 1, array_max(filter(sequence(0, size(h)), m -> m < 2 or {turn} > 0))), q)")
    chain = lambda s: f"aggregate({s}, cast(array() as {POINTS}), (h_, q) -> {push})"
    both = _let(chain("s"), "lo", _let(chain("reverse(s)"), "up", "concat(slice(lo, 1, size(lo) - 1), slice(up, 1, size(up) - 1))"))
    return _let(f"array_sort(array_distinct(transform({points}, v -> struct(v.x as x, v.y as y))))", "s", f"if(size(s) < 3, s, {both})")


def smoothed(points: str, slowest: float = 2.5, beta: float = 0.04, derivative: float = 1.0) -> str:
    """SQL for points (x, y, t in milliseconds) after a one-euro filter: slow ones are smoothed a lot, fast ones hardly."""
    share = lambda cutoff: f"(1 / (1 + 1 / (2 * {math.pi!r}D * {cutoff}) / dt))"
    axes = []
    for c in "xy":
        speed = f"(({share(f'{derivative}D')}) * (q.{c} - a.{c}) / dt + (1 - {share(f'{derivative}D')}) * a.d{c})"
        cut = share(f"({slowest}D + {beta}D * abs(s{c}))")
        axes.append((c, speed, f"{cut} * q.{c} + (1 - {cut}) * a.{c}"))
    (x, sx, fx), (y, sy, fy) = axes
    moving = _let("greatest(4D, q.t - a.t) / 1000", "dt", _let(sx, "sx", _let(sy, "sy", f"struct({fx} as x, {fy} as y, sx as dx, sy as dy, cast(q.t as double) as t, true as begun)")))
    still = "struct(0.5D * q.x + 0.5D * a.x as x, 0.5D * q.y + 0.5D * a.y as y, a.dx as dx, a.dy as dy, cast(q.t as double) as t, true as begun)"
    first = "struct(cast(q.x as double) as x, cast(q.y as double) as y, 0D as dx, 0D as dy, cast(q.t as double) as t, true as begun)"
    state = f"if(not a.begun, {first}, if(q.t <= a.t, {still}, {moving}))"
    step = _let("o.a", "a", _let(state, "n", "struct(n as a, array_append(o.out, struct(n.x as x, n.y as y)) as out)"))
    return f"aggregate({points}, struct(struct(0D as x, 0D as y, 0D as dx, 0D as dy, 0D as t, false as begun) as a, cast(array() as {POINTS}) as out), (o, q) -> {step}, o -> o.out)"


def quantized(points: str) -> str:
    """SQL for points (x, y, pressure) to a tenth and a hundredth; of points in one place, one after the other, the hardest stays."""
    tenth = "floor(q.{0} * 10 + 0.5D) / 10"
    rounded = f"transform({points}, q -> struct({tenth.format('x')} as x, {tenth.format('y')} as y, floor(least(1D, greatest(0D, q.p)) * 100 + 0.5D) / 100 as p))"
    last = "a[size(a) - 1]"
    step = f"if(size(a) > 0 and {last}.x = q.x and {last}.y = q.y, array_append(slice(a, 1, size(a) - 1), struct(q.x as x, q.y as y, greatest(q.p, {last}.p) as p)), array_append(a, q))"
    return f"aggregate({rounded}, cast(array() as array<struct<x:double,y:double,p:double>>), (a, q) -> {step})"
