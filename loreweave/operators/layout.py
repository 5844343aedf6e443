"""Reading order of a page's text runs: bands, gutters and columns, then lines with raised and lowered text.

Pages are dealt out by their number; a page's runs are few and are laid out in one piece.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from statistics import median
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Shares of a font's size, and how raised and lowered characters are written.
SMALL, DEEP, TABLE_CELL, TABLE_ROWS, NARROW = 0.88, 8, 18, 0.8, 0.55
RAISED = dict(zip("0123456789+-−=()ni*†‡,", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁻⁼⁽⁾ⁿⁱ*†‡,"))
LOWERED = dict(zip("0123456789+-−=()aeoxhklmnpstijruv", "₀₁₂₃₄₅₆₇₈₉₊₋₋₌₍₎ₐₑₒₓₕₖₗₘₙₚₛₜᵢⱼᵣᵤᵥ"))


class Run(NamedTuple):
    """A text run: its place from the top left, its size, and what it says."""

    id: int
    x: float
    y: float
    w: float
    h: float
    size: float
    str: str

    @property
    def right(self) -> float:
        return self.x + self.w

    @property
    def bottom(self) -> float:
        return self.y + self.h

    @property
    def base(self) -> float:
        return self.y + 0.8 * self.h


Span = tuple[float, float]


def letters(text: str) -> int:
    return len(re.sub(r"\s+", "", text))


def body_size(runs: list[Run]) -> float:
    """The size, to a half, that half of all characters have at most."""
    sized = sorted((round(r.size * 2) / 2, letters(r.str)) for r in runs if r.size > 0)
    half, seen = sum(n for _, n in sized) / 2, 0
    for size, n in sized:
        seen += n
        if seen and seen >= half:
            return size
    return 10.0


def joined(spans: list[Span], gap: float) -> list[Span]:
    """Spans as few, those within ``gap`` of each other in one."""
    out: list[Span] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + gap:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


class Page:
    """The layout of one page, or of a column of it, as blocks that are read one after the other."""

    def __init__(self, body: float):
        self.body, self.gutter = body, max(6.0, 0.9 * body)

    def bands(self, runs: list[Run]) -> list[list[Run]]:
        """Runs between blank strips; only the core of a run's box counts, so that tight lines come apart, but all of a small one's."""
        core = lambda r: (r.y, r.bottom) if r.size < SMALL * self.body else (r.y + 0.15 * r.h, r.y + 0.88 * r.h)
        out: list[list[Run]] = []
        edge = float("-inf")
        for r in sorted(runs, key=lambda r: (core(r)[0], r.x, r.id)):
            top, bottom = core(r)
            if top > edge:
                out.append([])
            out[-1].append(r)
            edge = max(edge, bottom)
        return out

    def taken(self, band: list[Run]) -> list[Span]:
        return joined([(r.x, r.right) for r in band], min(self.gutter / 2, 0.4 * self.body))

    def gap(self, taken: list[Span]) -> Span | None:
        """The gap that a band would be cut at: a wide one near its middle."""
        gaps = [(a, b) for (_, a), (b, _) in zip(taken, taken[1:]) if b - a >= self.gutter]
        left, width = taken[0][0], max(1.0, taken[-1][1] - taken[0][0])
        return max(gaps, key=lambda g: (g[1] - g[0]) * (1 - abs((g[0] + g[1] - 2 * left - width) / 2) / width), default=None)

    def left_free(self, gutter: Span | None, taken: list[Span]) -> Span | None:
        """What a band leaves of a gutter; None if it stands in it, reaches far into it from the right, or closes it."""
        if gutter is None:
            return None
        a, b = gutter
        met = [s for s in taken if s[0] < b and s[1] > a]
        before = [s for s in met if s[0] <= a + 1]
        after = [s for s in met if s[0] > a + 1 and s[1] >= b - 1]
        if len(before) + len(after) < len(met) or any(b - s[0] > 2.5 * self.body for s in after):
            return None
        a, b = max([a, *(s[1] for s in before)]), min([b, *(s[0] for s in after)])
        return (a, b) if b - a >= 0.6 * self.gutter else None

    def blocks(self, runs: list[Run], depth: int = 0) -> list[list[Run]]:
        if len(runs) < 2 or depth > DEEP:
            return [runs]
        bands = [(band, self.taken(band)) for band in self.bands(runs)]
        width = max(t[-1][1] for _, t in bands) - min(t[0][0] for _, t in bands)
        parts: list[tuple[Span | None, list[list[Run]]]] = []
        waiting: list[tuple[list[Run], list[Span]]] = []  # narrow bands, which may be a column's beginning

        def whole(more: list[list[Run]]) -> None:
            if more and parts and parts[-1][0] is None:
                parts[-1][1].extend(more)
            elif more:
                parts.append((None, more))

        for band, taken in bands:
            if not waiting and parts and (kept := self.left_free(parts[-1][0], taken)):
                parts[-1] = (kept, [*parts[-1][1], band])
                continue
            cut = self.gap(taken)
            if cut is None and taken[-1][1] - taken[0][0] < NARROW * width:
                waiting.append((band, taken))
                continue
            kept = cut
            for _, t in waiting:
                kept = self.left_free(kept, t)
            if kept:
                parts.append((kept, [*(b for b, _ in waiting), band]))
            else:
                whole([b for b, _ in waiting])
                if cut:
                    parts.append((cut, [band]))
                else:
                    whole([band])
            waiting = []
        whole([b for b, _ in waiting])

        out: list[list[Run]] = []
        for cut, held in parts:
            every = [r for band in held for r in band]
            middle = (cut[0] + cut[1]) / 2 if cut else 0.0
            left, right = ([r for r in every if (r.x + r.w / 2 < middle) == side] for side in (True, False))
            if cut is None or not left or not right or self.is_table(held, middle):
                out.append(every)
            else:
                out += self.blocks(left, depth + 1) + self.blocks(right, depth + 1)
        return out

    def is_table(self, bands: list[list[Run]], middle: float) -> bool:
        """Short cells side by side in nearly all rows are read by rows."""
        cells = [(sum(letters(r.str) for r in b if r.x + r.w / 2 < middle), sum(letters(r.str) for r in b if r.x + r.w / 2 >= middle)) for b in bands]
        both = sum(l > 0 < r for l, r in cells)
        short = lambda k: median([c[k] for c in cells if c[k]] or [0]) <= TABLE_CELL
        return len(bands) > 1 and both >= TABLE_ROWS * len(bands) and short(0) and short(1)


def lines(runs: list[Run]) -> list[list[Run]]:
    """Runs as lines from top to bottom: large ones first, small ones join the line that they overlap most."""
    out: list[list] = []  # runs, top, bottom
    for r in sorted(runs, key=lambda r: (-r.size, r.base, r.x, r.id)):
        best, most = None, 0.0
        for line in out:
            shared, low = min(line[2], r.bottom) - max(line[1], r.y), min(line[2] - line[1], r.h)
            least = 0.25 if low < SMALL * max(line[2] - line[1], r.h) else 0.5
            if shared > 0 and shared / low >= least and shared / low > most:
                best, most = line, shared / low
        if best is None:
            out.append([[r], r.y, r.bottom])
        else:
            best[0].append(r)
            best[1:] = min(best[1], r.y), max(best[2], r.bottom)
    return sorted((line[0] for line in out), key=lambda rs: median(r.base for r in rs))


def line_text(runs: list[Run]) -> tuple[float, str]:
    """A line's size, by its characters, and its text: blanks where runs stand apart, raised and lowered text as such."""
    weight: dict[float, int] = {}
    for r in runs:
        weight[round(r.size * 2) / 2] = weight.get(round(r.size * 2) / 2, 0) + max(1, letters(r.str))
    size = max(weight, key=lambda s: (weight[s], s))
    base = median([r.base for r in runs if abs(r.size - size) <= 0.1 * size] or [r.base for r in runs])
    said: list[list] = []  # level, text
    before = None
    for r in sorted(runs, key=lambda r: (r.x, -r.y, r.id)):
        if before and before.str == r.str and max(abs(before.x - r.x), abs(before.y - r.y)) < 0.3 * r.size:
            continue  # drawn twice to look bold
        level = 0 if r.size >= SMALL * size else 1 if r.base < base - 0.18 * size else -1 if r.base > base + 0.1 * size else 0
        apart = before is not None and r.x - before.right > 0.15 * min(before.size, r.size)
        text = r.str
        if apart and level == 0 and not re.match(r"\s", text) and not (said[-1][0] == 0 and re.search(r"\s$", said[-1][1])):
            text = " " + text
        if said and said[-1][0] == level:
            said[-1][1] += text
        else:
            said.append([level, text])
        before = r

    def shown(level: int, text: str) -> str:
        text = re.sub(r"\s+", " ", text)
        if level == 0:
            return text
        signs, inner = RAISED if level > 0 else LOWERED, text.strip()
        if all(c in signs for c in inner):
            return "".join(signs[c] for c in inner)
        return f"<sup>{inner}</sup>" if level > 0 else f"<sub>{inner}</sub>"

    return size, "".join(shown(*s) for s in said).strip()


def paged(items: DataFrame, page: str, fields: str, rows_of: Callable[[list[Run]], Iterator[tuple]]) -> DataFrame:
    """(page, fields): the rows that ``rows_of`` makes of the runs of each page.

    Items have id, x, y, w, h, size, str and may have an angle.  Blank items, and those without a place, a height or
    upright, are left out.  Pages come in a stream sorted by page, many to a batch, and a page is held at a time.
    """
    angle = F.col("angle") if "angle" in items.columns else F.lit(0.0)
    turned = F.abs(F.pmod(F.coalesce(angle, F.lit(0.0)) + 180, F.lit(360)) - 180)
    sound = items.where((F.trim("str") != "") & (F.col("w") >= 0) & (F.col("h") > 0) & (F.abs("x") < float("inf")) & (F.abs("y") < float("inf"))).where(turned <= 10)
    dealt = sound.select(page, "id", "x", "y", "w", "h", "size", "str").repartition(page).sortWithinPartitions(page)
    schema = T.StructType([dealt.schema[page], *T._parse_datatype_string(fields.format(id=dict(items.dtypes)["id"]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, runs, at, out = None, [], None, []

        def done() -> pa.RecordBatch:
            columns = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

        for batch in batches:
            types = types or [batch.schema.field(page).type, *(to_arrow_type(f.dataType) for f in schema.fields[1:])]
            columns = [batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in Run._fields]
            for this, row in zip(batch.column(page).to_pylist(), zip(*columns)):
                if runs and this != at:
                    out.extend((at, *r) for r in rows_of(runs))
                    runs = []
                at = this
                runs.append(Run(*row))
            if out:
                yield done()
                out = []
        out.extend((at, *r) for r in rows_of(runs)) if runs else None
        if out:
            yield done()

    return dealt.mapInArrow(run, schema)


def page_lines(items: DataFrame, page: str = "doc_id") -> DataFrame:
    """(page, block, line, ids, x, y, right, size, text): the lines of each page in the order they are read.

    Columns are read one after the other, as far as wide text does not cross them; tables row by row.
    """

    def laid_out(runs: list[Run]) -> Iterator[tuple]:
        for b, block in enumerate(Page(body_size(runs)).blocks(runs)):
            for k, line in enumerate(lines(block)):
                size, text = line_text(line)
                yield b, k, [r.id for r in sorted(line, key=lambda r: (r.x, r.id))], min(r.x for r in line), min(r.y for r in line), max(r.right for r in line), size, text

    return paged(items, page, "block int, line int, ids array<{id}>, x double, y double, right double, size double, text string", laid_out)


def reading_order(items: DataFrame, page: str = "doc_id") -> DataFrame:
    """(page, id, place): the items of each page in the order they are read, from 1."""

    def placed(runs: list[Run]) -> Iterator[tuple]:
        read = (r for block in Page(body_size(runs)).blocks(runs) for line in lines(block) for r in sorted(line, key=lambda r: (r.x, r.id)))
        return ((r.id, k) for k, r in enumerate(read, 1))

    return paged(items, page, "id {id}, place int", placed)


def page_text(items: DataFrame, page: str = "doc_id") -> DataFrame:
    """(page, text): the lines of each page, blocks a blank line apart."""
    made = page_lines(items, page).groupBy(page, "block").agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("l"))
    joined_ = made.select(page, "block", F.array_join(F.transform("l", lambda s: s["text"]), "\n").alias("t"))
    return joined_.groupBy(page).agg(F.array_sort(F.collect_list(F.struct("block", "t"))).alias("b")).select(page, F.array_join(F.transform("b", lambda s: s["t"]), "\n\n").alias("text"))
