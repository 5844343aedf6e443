"""Handwriting: strokes near each other grouped to lines and blocks, without looking at all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import scratch
from . import records

ROUNDS = 60
#: Strokes of a page that is read as one row; larger pages meet by grids and labels.
SMALL = 64


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, label): the least node that each of ``nodes`` (id) reaches over ``edges`` (a, b).

    In each round a node takes the least label of its neighbours and then the label of that; the labels are written
    out, so that no plan grows and a lost executor loses nothing.  Rounds grow with the logarithm of the longest way.
    """
    spark = nodes.sparkSession
    path = scratch.folder(spark)
    edges.write.parquet(f"{path}/edges")
    way = spark.read.parquet(f"{path}/edges")
    way = way.unionByName(way.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nodes.select("id", F.col("id").alias("label")).distinct().write.parquet(f"{path}/0")
    for n in range(1, ROUNDS):
        label = spark.read.parquet(f"{path}/{n - 1}")
        near = way.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("least"))
        # a label's own label goes along, so that trees grow flat
        hooks = label.join(near, "id").where("least < label").groupBy(F.col("label").alias("id")).agg(F.min("least").alias("hook"))
        hooked = label.join(near, "id", "left").join(hooks, "id", "left").select("id", F.least("label", "least", "hook").alias("label"))
        above = hooked.select(F.col("id").alias("label"), F.col("label").alias("higher"))
        hooked.join(above, "label", "left").select("id", F.least("label", "higher").alias("label")).write.parquet(f"{path}/{n}")
        new = spark.read.parquet(f"{path}/{n}")
        if new.join(label.withColumnRenamed("label", "was"), "id").where("label <> was").isEmpty():
            return new
    raise RuntimeError(f"labels did not settle in {ROUNDS} rounds")


def labelled(boxes: str, link: Callable[[str, str], str]) -> str:
    """SQL for the least ids that the boxes of a small page reach, in their order; ``link`` says when two boxes meet."""
    whole = lambda b: " and ".join(f"{b}.{c} is not null" for c in ("x", "y", "w", "h"))
    at, p, q = f"sequence(0, size({boxes}) - 1)", f"{boxes}[i]", f"{boxes}[j]"
    pairs = f"flatten(transform({at}, i -> transform(filter({at}, j -> i < j and {whole(p)} and {whole(q)} and {link(p, q)}), j -> struct(i as i, j as j))))"
    merge = "if(l[e.i] = l[e.j], l, transform(l, v -> if(v = greatest(l[e.i], l[e.j]), least(l[e.i], l[e.j]), v)))"
    return f"aggregate({pairs}, transform({boxes}, b -> b.id), (l, e) -> {merge})"


def beside(p: str, q: str) -> str:
    """SQL for whether two strokes are of one line."""
    high = {b: f"greatest({b}.h, lh * 0.5D)" for b in (p, q)}
    mid = {b: f"({b}.y + {b}.h / 2)" for b in (p, q)}
    top, end = (f"({mid[b]} - {high[b]} / 2)" for b in (p, q)), (f"({mid[b]} + {high[b]} / 2)" for b in (p, q))
    shared = f"(least({', '.join(end)}) - greatest({', '.join(top)}))"
    return f"greatest(0D, {p}.x - {q}.x - {q}.w, {q}.x - {p}.x - {p}.w) <= greatest(20D, lh * 1.3D) and {shared} / least({high[p]}, {high[q]}) >= 0.3D"


def under(p: str, q: str) -> str:
    """SQL for whether two lines are of one block."""
    return f"greatest(0D, {p}.y - {q}.y - {q}.h, {q}.y - {p}.y - {p}.h) <= lh * 0.9D and least({p}.x + {p}.w, {q}.x + {q}.w) - greatest({p}.x, {q}.x) > lh * -0.5D"


def small_writing(strokes: DataFrame) -> DataFrame:
    """As ``large_writing``, for pages of at most ``SMALL`` strokes: each is a row, so only its strokes are shuffled."""
    mark = "greatest(h, w * 0.5D)"
    scale = F.expr(f"percentile({mark}, 0.5) filter (where greatest(w, h) <= 150 and {mark} > 3)")
    page = strokes.groupBy("group").agg(F.collect_list(F.struct("id", "x", "y", "w", "h")).alias("s"), scale.alias("xh"))
    sized = page.select("group", "s", F.greatest(F.coalesce("xh", F.lit(0.0)), F.lit(10.0)).alias("lh"))
    lined = sized.select("*", F.expr(labelled("s", beside)).alias("line"))
    least, most = (lambda c: f"array_min(transform(g.m, b -> b.{c}))"), (lambda c, d: f"array_max(transform(g.m, b -> b.{c} + b.{d}))")
    box = f"struct(g.n as id, {least('x')} as x, {least('y')} as y, {most('x', 'w')} - {least('x')} as w, {most('y', 'h')} - {least('y')} as h)"
    members = "transform(array_distinct(line), n -> struct(n as n, filter(s, (b, k) -> line[k] = n) as m))"
    boxed = lined.select("*", F.expr(f"transform({members}, g -> {box})").alias("boxes"))
    done = boxed.select("group", "s", "line", "boxes", F.expr(labelled("boxes", under)).alias("label"))
    each = done.select("group", "boxes", "label", F.explode(F.arrays_zip("s", "line")).alias("z"))
    block = F.expr("element_at(label, cast(array_position(transform(boxes, b -> b.id), z.line) as int))")
    return each.select("group", F.col("z.s.id").alias("id"), F.col("z.line").alias("line"), block.alias("block"))


def writing(strokes: DataFrame) -> DataFrame:
    """(group, id, line, block) of all pages, by the rules of ``large_writing``; small pages are rows whose boxes meet inside."""
    sizes = strokes.groupBy(F.col("group").alias("of")).agg(F.count("*").alias("n"))
    few = sizes.where(f"of is not null and n <= {SMALL}")
    small = small_writing(strokes.join(few, F.col("group") == F.col("of"), "left_semi"))
    if sizes.where(f"of is null or n > {SMALL}").isEmpty():
        return small
    return small.unionByName(large_writing(strokes.join(few, F.col("group") == F.col("of"), "left_anti")))


def large_writing(strokes: DataFrame) -> DataFrame:
    """(group, id, line, block): the writing of each page (group, id, x, y, w, h), ids unique over all pages.

    A line is what overlaps in height by three tenths of the lower stroke and lies within a blank's width; a block is
    lines that follow closely and overlap in width.  Both scales are the page's: the median height of its marks, wide
    ones by half their width.  Labels are the least ids.
    """
    mark = F.greatest("h", F.col("w") * 0.5)
    page = strokes.where(F.greatest("w", "h") <= 150).where(mark > 3).groupBy(F.col("group").alias("of")).agg(F.expr("percentile(greatest(h, w * 0.5), 0.5)").alias("xh"))
    sized = strokes.join(page, F.col("group") == F.col("of"), "left").withColumn("lh", F.greatest(F.coalesce("xh", F.lit(0.0)), F.lit(10.0))).drop("of")
    pairs = records.near_boxes(sized.withColumn("reach", F.greatest(F.lit(20.0), F.col("lh") * 1.3)), "reach")
    side = lambda name: sized.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("x", "y", "w", "h", "lh")])
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    high = lambda n: F.greatest(F.col(f"{n}_h"), F.col("a_lh") * 0.5)
    mid = lambda n: F.col(f"{n}_y") + F.col(f"{n}_h") / 2
    shared = F.least(mid("a") + high("a") / 2, mid("b") + high("b") / 2) - F.greatest(mid("a") - high("a") / 2, mid("b") - high("b") / 2)
    aside = F.greatest(F.lit(0.0), F.col("a_x") - F.col("b_x") - F.col("b_w"), F.col("b_x") - F.col("a_x") - F.col("a_w"))
    same = met.where((shared / F.least(high("a"), high("b")) >= 0.3) & (aside <= F.greatest(F.lit(20.0), F.col("a_lh") * 1.3)))
    lines = connected(strokes.select("id"), same.select("a", "b")).withColumnRenamed("label", "line")
    held = sized.join(lines, "id")
    box = held.groupBy("group", F.col("line").alias("id")).agg(
        F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h"), F.first("lh").alias("lh")
    )
    close = records.near_boxes(box.withColumn("reach", F.col("lh") * 0.9), "reach")
    end = lambda name: box.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("x", "y", "w", "h", "lh")])
    stacked = close.join(end("a"), "a").join(end("b"), "b")
    over = F.least(F.col("a_x") + F.col("a_w"), F.col("b_x") + F.col("b_w")) - F.greatest("a_x", "b_x")
    down = F.greatest(F.lit(0.0), F.col("a_y") - F.col("b_y") - F.col("b_h"), F.col("b_y") - F.col("a_y") - F.col("a_h"))
    blocks = connected(box.select("id"), stacked.where((down <= F.col("a_lh") * 0.9) & (over > F.col("a_lh") * -0.5)).select("a", "b"))
    return held.join(blocks.select(F.col("id").alias("line"), F.col("label").alias("block")), "line").select("group", "id", "line", "block")
