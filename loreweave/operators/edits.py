"""Edits as functions from tables to tables, and lookups by name: the same input gives the same output however often it runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def find_by_title(names: DataFrame) -> DataFrame:
    """(norm, page_id) of ``names`` (norm, page_id, priority, ord): ids made from the title first, then titles and aliases in page order."""
    return names.groupBy("norm").agg(F.min_by("page_id", F.struct("priority", "ord")).alias("page_id"))


def patch(table: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """The table with each field of ``changes`` that is not null; an empty string clears a field; changed rows take ``updated_at``."""
    new = changes.select(key, *[F.col(f).alias(f"new_{f}") for f in fields], F.col("updated_at").alias("new_at"))
    value = lambda f: F.when(F.col(f"new_{f}").isNull(), F.col(f)).when(F.col(f"new_{f}") != "", F.col(f"new_{f}")).alias(f)
    return table.join(new, key, "left").select(key, *map(value, fields), F.coalesce("new_at", "updated_at").alias("updated_at"))


def flag(table: DataFrame, ids: DataFrame, key: str, name: str) -> DataFrame:
    """The table with a flag that is set for the given ids."""
    return table.join(ids.select(key, F.lit(True).alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def throttle(touches: DataFrame, key: str, at: str, seconds: int) -> DataFrame:
    """The touches that count: each at least ``seconds`` after the one before it that counted.

    A gap as long as that always ends a wait, so touches are cut there first and
    only the runs between gaps are gathered and folded.
    """
    w = Window.partitionBy(key).orderBy(at)
    us = F.unix_micros(at)
    start = F.coalesce((us - F.lag(us).over(w) >= seconds * 1000000).cast("int"), F.lit(1))
    runs = touches.select(key, us.alias("us"), start.alias("start")).withColumn("run", F.sum("start").over(Window.partitionBy(key).orderBy("us")))
    step = f"(a, x) -> if(size(a) = 0 or x - element_at(a, -1) >= {seconds * 1000000}L, array_append(a, x), a)"
    kept = runs.groupBy(key, "run").agg(F.expr(f"aggregate(array_sort(collect_list(us)), cast(array() as array<bigint>), {step})").alias("kept"))
    return kept.select(key, F.explode("kept").alias("us")).select(key, F.timestamp_micros("us").alias(at))


def renumber(blocks: DataFrame, *order: str) -> DataFrame:
    """(page_id, block_id, ord): places from 0 in the given order; of an id that stands twice the first place counts."""
    first = blocks.groupBy("page_id", "block_id").agg(F.min(F.struct(*order)).alias("place"))
    return first.select("page_id", "block_id", (F.row_number().over(Window.partitionBy("page_id").orderBy("place")) - 1).alias("ord"))


def delete_blocks(blocks: DataFrame, gone: DataFrame) -> DataFrame:
    return renumber(blocks.join(gone.select("page_id", "block_id"), ["page_id", "block_id"], "left_anti"), "ord")


def insert_blocks(blocks: DataFrame, new: DataFrame) -> DataFrame:
    """Blocks with those of ``new`` (page_id, block_id, at, i) before the block that stands at ``at``, in the order of ``i``."""
    old = blocks.select("page_id", "block_id", F.col("ord").alias("at"), F.lit(1).alias("side"), F.lit(0).alias("i"))
    return renumber(old.unionByName(new.select("page_id", "block_id", "at", F.lit(0).alias("side"), "i")), "at", "side", "i")


def move_blocks(blocks: DataFrame, moves: DataFrame) -> DataFrame:
    """Blocks with those of ``moves`` (page_id, block_id, at, i) taken out, then put in at a place of what is left."""
    return insert_blocks(delete_blocks(blocks, moves), moves)


def notebook(decks: DataFrame) -> DataFrame:
    """(source_id, ord, type, page): a slide and an ink block for every page of a deck."""
    page = F.explode(F.expr("if(page_count > 0, sequence(1, page_count), cast(array() as array<int>))"))
    each = decks.select("source_id", page.alias("page"))
    pair = F.explode(F.expr("array(struct(2 * page - 2 as ord, 'slide' as type, page as at), struct(2 * page - 1 as ord, 'ink' as type, cast(null as int) as at))"))
    return each.select("source_id", pair.alias("b")).select("source_id", "b.ord", "b.type", F.col("b.at").alias("page"))


def without_dismissed(pairs: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Pairs (a, b) that nobody has dismissed, in whichever order."""
    key = [F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")]
    return pairs.select("a", "b", *key).join(dismissed.select(*key).distinct(), ["x", "y"], "left_anti").select("a", "b")


def index_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(page_id, ord, change): blocks added, removed or changed, by the signature ``sig`` of their content."""
    met = before.select("page_id", "ord", F.col("sig").alias("old")).join(after.select("page_id", "ord", F.col("sig").alias("new")), ["page_id", "ord"], "full_outer")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
    return met.where("not (old <=> new)").select("page_id", "ord", change.alias("change"))


def leeches(states: DataFrame, threshold: int = 4, suspend: bool = False) -> DataFrame:
    """Card states with ``leech``, and ``suspended`` if leeches are to be: cards with as many lapses as the threshold."""
    leech = F.col("lapses") >= threshold
    return states.withColumn("leech", leech).withColumn("suspended", leech & F.lit(suspend))


def missing_fields(ours: DataFrame, theirs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, missing): the names of the fields that we have and they lack; an empty field is a missing one."""
    lacks = [F.expr(f"if(nullif(o.{f}, '') is not null and nullif(t.{f}, '') is null, '{f}', null)") for f in fields]
    return ours.alias("o").join(theirs.alias("t"), key).select(key, F.array_join(F.array_compact(F.array(*lacks)), ",").alias("missing")).where("missing <> ''")


def equal_records(ours: DataFrame, theirs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, equal): whether all fields are alike; empty and missing are the same."""
    same = " and ".join(f"nullif(o.{f}, '') <=> nullif(t.{f}, '')" for f in fields)
    return ours.alias("o").join(theirs.alias("t"), key).select(key, F.expr(same).alias("equal"))


def body_size(lines: DataFrame) -> DataFrame:
    """(page_id, size): the median font size by characters, in half points, of lines (page_id, size, n)."""
    counted = lines.where("n > 0 and size > 0").groupBy("page_id", F.floor(F.col("size") * 2 + 0.5).alias("half")).agg(F.sum("n").alias("n"))
    w = Window.partitionBy("page_id")
    run = counted.withColumn("upto", F.sum("n").over(w.orderBy("half"))).withColumn("total", F.sum("n").over(w))
    return run.where("2 * upto >= total").groupBy("page_id").agg((F.min("half") / 2.0).alias("size"))


def outline(points: DataFrame) -> DataFrame:
    """(stroke_id, points, left, top, right, bottom, path, area): box, length and enclosed area of strokes (stroke_id, i, x, y)."""
    w = Window.partitionBy("stroke_id").orderBy("i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in "xy")
    last = F.lead("i").over(w).isNull()
    stepped = points.select("stroke_id", "x", "y", nx.alias("nx"), ny.alias("ny"), last.alias("last"))
    return stepped.groupBy("stroke_id").agg(
        F.count("*").alias("points"), F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom"),
        F.round(F.sum(F.when(F.col("last"), 0.0).otherwise(F.hypot(F.col("nx") - F.col("x"), F.col("ny") - F.col("y")))), 3).alias("path"),
        F.round(F.abs(F.sum(F.col("x") * F.col("ny") - F.col("nx") * F.col("y"))) / 2, 1).alias("area"),
    )
