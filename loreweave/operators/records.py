"""Citations, files, layout and geometry as joins, windows and aggregations."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def file_kind(content: str, name: str) -> Column:
    """What a file is by its first bytes, and by its name where they leave that open."""
    head = F.hex(F.substring(content, 1, 64))
    return (
        F.when(head.startswith("25504446"), "pdf")
        .when(head.startswith("D0CF11E0"), F.when(F.col(name).rlike(r"(?i)\.pptx?$"), "ppt"))
        .when(head.startswith("504B") & (head.contains(b"mimetypeapplication/epub+zip".hex().upper()) | F.col(name).rlike(r"(?i)\.epub$")), "epub")
        .when(head.startswith("504B") & F.col(name).rlike(r"(?i)\.pptx$"), "pptx")
    )


def contents(entries: DataFrame, depth: int = 6, most: int = 2000) -> DataFrame:
    """A document's outline (doc_id, i, level, title) up to a depth and a number of entries; both limits are the feature's own."""
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    return entries.where(F.col("level") < depth).withColumn("place", place).where(F.col("place") <= most)


def is_landscape(pages: DataFrame, sample: int = 8) -> DataFrame:
    """(doc_id, slides): whether two thirds of a document's first pages are wider than high by a quarter."""
    first = pages.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("page"))).where(F.col("k") <= sample)
    return first.groupBy("doc_id").agg((F.avg((F.col("w") / F.col("h") >= 1.25).cast("double")) >= 2 / 3 - 1e-12).alias("slides"))


def budgeted(files: DataFrame, budget: int) -> DataFrame:
    """(repo, path): the files that a commit takes: in order, each that still fits; one too large is passed over.

    What fits depends on all files before, so a repository's sizes are folded in order; they are few for a commit.
    """
    start = "named_struct('used', 0L, 'taken', cast(array() as array<string>))"
    step = f"if(a.used + x.size <= {budget}, named_struct('used', a.used + x.size, 'taken', concat(a.taken, array(x.path))), a)"
    gathered = files.groupBy("repo").agg(F.array_sort(F.collect_list(F.struct("ord", "path", "size"))).alias("f"))
    return gathered.select("repo", F.explode(F.expr(f"aggregate(f, {start}, (a, x) -> {step}).taken")).alias("path"))


def islands(df: DataFrame, group: list[str], at: str, gap, name: str, *ties: str) -> DataFrame:
    """Rows with the number of their cluster along one axis: a step over ``gap`` begins a new one."""
    order = Window.partitionBy(*group).orderBy(at, *ties)
    new = (F.col(at) - F.lag(at).over(order) > gap).cast("int")
    return df.withColumn("lw_new", F.coalesce(new, F.lit(0))).withColumn(name, F.sum("lw_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("lw_new")


def bands(items: DataFrame) -> DataFrame:
    """Items (doc_id, id, x, y, w, h) with ``band``: one begins where an item's top is under all bottoms before it."""
    order = Window.partitionBy("doc_id").orderBy("y", "x", "id")
    under = F.max(F.col("y") + F.col("h")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = items.withColumn("lw_new", F.coalesce((F.col("y") >= under).cast("int"), F.lit(0)))
    return marked.withColumn("band", F.sum("lw_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("lw_new")


def lines(items: DataFrame) -> DataFrame:
    """(doc_id, band, y, size, text): the items of a band from left to right as a line."""
    gathered = bands(items).groupBy("doc_id", "band").agg(F.min("y").alias("y"), F.max("h").alias("size"), F.array_sort(F.collect_list(F.struct("x", "id", "str"))).alias("i"))
    return gathered.select("doc_id", "band", "y", "size", F.array_join(F.transform("i", lambda s: s["str"]), " ").alias("text"))


def paragraphs(made: DataFrame) -> DataFrame:
    """(doc_id, para, heading, text): lines joined while the step down is at most one and a half of the line's size and the size stays.

    A heading is half as large again as the document's median line.
    """
    order = Window.partitionBy("doc_id").orderBy("y", "band")
    before_y, before_size = F.lag("y").over(order), F.lag("size").over(order)
    new = (F.col("y") - before_y > 1.5 * F.col("size")) | (before_size != F.col("size"))
    numbered = made.withColumn("lw_new", F.coalesce(new.cast("int"), F.lit(0))).withColumn("para", F.sum("lw_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    body = made.groupBy("doc_id").agg(F.expr("percentile(size, 0.5)").alias("body"))
    joined = numbered.groupBy("doc_id", "para").agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("y", "band", "text"))).alias("l"))
    text = F.array_join(F.transform("l", lambda s: s["text"]), " ")
    return joined.join(body, "doc_id").select("doc_id", "para", (F.col("size") >= 1.5 * F.col("body")).alias("heading"), text.alias("text"))


def page_markdown(paras: DataFrame) -> DataFrame:
    """(doc_id, markdown): headings with a mark, paragraphs in order with an empty line between."""
    shown = F.when(F.col("heading"), F.concat(F.lit("# "), "text")).otherwise(F.col("text"))
    gathered = paras.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para", shown.alias("t")))).alias("p"))
    return gathered.select("doc_id", F.array_join(F.transform("p", lambda s: s["t"]), "\n\n").alias("markdown"))


def title_guess(made: DataFrame, share: float = 0.6) -> DataFrame:
    """(doc_id, title): the largest line in the upper part of a document; of equals the upper one."""
    height = made.groupBy("doc_id").agg((F.max("y") * share).alias("limit"))
    upper = made.join(height, "doc_id").where("y <= limit")
    return upper.groupBy("doc_id").agg(F.min_by("text", F.struct(-F.col("size"), "y", "band")).alias("title"))


def inside(points: DataFrame, corners: list[tuple[float, float]]) -> DataFrame:
    """The points (x, y) inside a polygon: its box first, then the crossings of a ray with its edges."""
    xs, ys = zip(*corners)
    edges = ", ".join(f"named_struct('ax', {ax}D, 'ay', {ay}D, 'bx', {bx}D, 'by', {by}D)" for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]]))
    crossed = "filter(array({}), e -> (e.ay > y) <> (e.by > y) and x < (e.bx - e.ax) * (y - e.ay) / (e.by - e.ay) + e.ax)"
    return points.where(F.col("x").between(min(xs), max(xs)) & F.col("y").between(min(ys), max(ys))).where(f"size({crossed.format(edges)}) % 2 = 1")


def near_boxes(boxes: DataFrame, gap: float | str) -> DataFrame:
    """(a, b): pairs of boxes (group, id, x, y, w, h) of a group that lie within ``gap``, a number or a column's name.

    Boxes meet by cells of grids.  Each box lies in the grid whose cells are just as wide as it and the gap, a power of
    two, and looks for others in its own grid and in the coarser ones that its group has.  So a box as wide as the page
    meets the small ones, but does not make them meet each other.
    """
    reach = F.col(gap) if isinstance(gap, str) else F.lit(float(gap))
    placed = boxes.select("group", "id", "x", "y", "w", "h", reach.alias("lw_gap"))
    placed = placed.withColumn("level", F.ceil(F.log2(F.greatest(F.col("w") + F.col("lw_gap"), F.col("h") + F.col("lw_gap"), F.lit(1e-9)))).cast("int"))
    levels = placed.groupBy(F.col("group").alias("of")).agg(F.collect_set("level").alias("levels"))  # at most as many as sizes have powers of two
    span = lambda at, size, low, high: F.expr(f"explode(sequence(floor(({at} - {low}) / pow(2D, {size})), floor(({at} + {high}) / pow(2D, {size}))))")
    lying = placed.withColumn("cx", span("x", "level", "0", "w")).withColumn("cy", span("y", "level", "0", "h"))
    looks = placed.join(levels, F.col("group") == F.col("of")).withColumn("at", F.explode(F.expr("filter(levels, l -> l >= level)")))
    looks = looks.withColumn("cx", span("x", "at", "lw_gap", "w + lw_gap")).withColumn("cy", span("y", "at", "lw_gap", "h + lw_gap"))
    a, b = looks.alias("a"), lying.alias("b")
    cell = (F.col("a.group") == F.col("b.group")) & (F.col("a.at") == F.col("b.level")) & (F.col("a.cx") == F.col("b.cx")) & (F.col("a.cy") == F.col("b.cy"))
    met = a.join(b, cell & ((F.col("a.level") < F.col("b.level")) | (F.col("a.id") < F.col("b.id"))))
    apart = [F.greatest(F.lit(0.0), F.col(f"a.{p}") - F.col(f"b.{p}") - F.col(f"b.{s}"), F.col(f"b.{p}") - F.col(f"a.{p}") - F.col(f"a.{s}")) for p, s in (("x", "w"), ("y", "h"))]
    near = met.where((apart[0] <= F.col("a.lw_gap")) & (apart[1] <= F.col("a.lw_gap")))
    return near.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct()


def remote_plan(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(id, key, action): what a sync with a remote library does, its records read in the order of their ids.

    Records (id, link, doi, title, year, stamp, synced) and items (key, doi, title, year, version) meet by link.  A record
    without one looks for the first item of its DOI, else of its title and year; if another has that item already, by a
    link or as an earlier record, it looks no further.  A linked record whose item is newer than ``synced`` is updated
    here, one that is newer itself there; a record that meets nothing is created there, an item that meets nothing is
    remote only, and a link to nothing is undone.
    """
    linked = ours.where("link is not null").join(theirs.withColumnRenamed("key", "link"), "link", "left").select("id", F.col("link").alias("key"), F.col("version"), "stamp", "synced")
    action = F.when(F.col("version").isNull(), "unlink").when(F.col("version") > F.col("synced"), "update local").when(F.col("stamp") > F.col("synced"), "update remote").otherwise("same")
    done = linked.select("id", "key", action.alias("action"))
    loose, wanted = ours.where("link is null"), None
    for rank, names in enumerate((["doi"], ["title", "year"])):
        keys = {f"k{i}": F.lower(F.trim(F.col(n).cast("string"))) for i, n in enumerate(names)}
        named = lambda d: d.withColumns(keys).where(" and ".join(f"{k} <> ''" for k in keys))  # noqa: B023, E731
        first = named(theirs).groupBy(*keys).agg(F.min("key").alias("key"))
        met = named(loose).join(first, [*keys]).select("id", F.struct(F.lit(rank).alias("rank"), "key").alias("way"))
        wanted = met if wanted is None else wanted.unionByName(met)
    chosen = wanted.groupBy("id").agg(F.min("way").alias("way")).select("id", "way.key")
    free = chosen.join(done.select("key"), "key", "left_anti")
    links = free.groupBy("key").agg(F.min("id").alias("id")).select("id", "key", F.lit("link").alias("action"))
    new = loose.join(links.select("id"), "id", "left_anti").select("id", F.lit(None).cast("string").alias("key"), F.lit("create").alias("action"))
    kept = done.unionByName(links)
    rest = theirs.join(kept.where("action <> 'unlink'").select("key"), "key", "left_anti")
    return kept.unionByName(new).unionByName(rest.select(F.lit(None).cast(ours.schema["id"].dataType).alias("id"), "key", F.lit("remote only").alias("action")))


FIELD = re.compile(r"\s*([A-Za-z][\w-]*)\s*=\s*")


def bibtex_entries(text: str) -> list[tuple[str, str, dict[str, str]]]:
    """(type, key, fields) of a BibTeX text: braces, quotes, ``@string`` names and ``#``; a broken entry is passed over up to the next @."""
    out, strings, at = [], {}, 0
    while (at := text.find("@", at)) >= 0:
        head = re.compile(r"@\s*([A-Za-z]+)\s*[{(]\s*").match(text, at)
        if not head:
            at += 1
            continue
        kind, p, fields, key = head[1].lower(), head.end(), {}, ""
        if kind in ("comment", "preamble"):
            at = p
            continue
        if kind != "string":
            m = re.compile(r"([^,\s{}@=]*)\s*,?").match(text, p)
            key, p = m[1], m.end()
        while m := FIELD.match(text, p):
            value, p = _value(text, m.end(), strings)
            fields[m[1].lower()] = value
            while p < len(text) and text[p] in ", \t\r\n":
                p += 1
        if kind == "string":
            strings.update(fields)
        elif key:
            out.append((kind, key, fields))
        at = max(p, at + 1)
    return out


def _value(text: str, p: int, strings: dict[str, str]) -> tuple[str, int]:
    parts = []
    while p < len(text):
        if text[p] in '{"':
            depth, start, quoted = 0, p + 1, text[p] == '"'
            p += quoted
            while p < len(text):
                if text[p] == "{":
                    depth += 1
                elif text[p] == "}":
                    depth -= 1
                    if depth == 0 and not quoted:
                        break
                elif quoted and text[p] == '"' and depth == 0:
                    break
                p += 1
            parts.append(text[start:p])
            p += 1
        else:
            m = re.compile(r"[^\s,#}]+").match(text, p)
            if not m:
                break
            parts.append(strings.get(m[0].lower(), m[0]))
            p = m.end()
        m = re.compile(r"\s*#\s*").match(text, p)
        if not m:
            break
        p = m.end()
    return re.sub(r"\s+", " ", "".join(parts)).strip(), p


def parse_bibtex(files: DataFrame) -> DataFrame:
    """(file_id, type, key, fields): the entries of BibTeX files (file_id, text)."""

    def run(batches):
        for b in batches:
            rows = [(i, *e) for i, t in zip(b["file_id"], b["text"]) for e in bibtex_entries(t or "")]
            yield pd.DataFrame(rows, columns=["file_id", "type", "key", "fields"])

    return files.select("file_id", "text").mapInPandas(run, "file_id long, type string, key string, fields map<string,string>")
