"""The knowledge graph: names, backlinks, concepts, edges and neighbourhoods as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def name_map(titles: DataFrame) -> DataFrame:
    """(norm, page_id): the page that owns each normalised title; the first writer wins."""
    norm = F.lower(F.trim(F.regexp_replace("title", r"\s+", " ")))
    return titles.where("title is not null and trim(title) <> ''").groupBy(norm.alias("norm")).agg(F.min("page_id").alias("page_id"))


def display_name(refs: DataFrame) -> DataFrame:
    """(norm, spelling): the first spelling seen of each name."""
    return refs.groupBy("norm").agg(F.min_by("spelling", F.struct("page_id", "ord")).alias("spelling"))


def resolve_name(refs: DataFrame, names: DataFrame) -> DataFrame:
    """``refs`` with the page that the name leads to, null where no page has it."""
    return refs.join(names.withColumnRenamed("page_id", "target"), "norm", "left")


def backlinks(refs: DataFrame, names: DataFrame) -> DataFrame:
    """(target, page_id, ord): the blocks that refer to a page's name, but for the page's own; each block once."""
    met = refs.join(names.withColumnRenamed("page_id", "target"), "norm")
    return met.where("target <> page_id").select("target", "page_id", "ord").distinct()


def pages_linking_to(refs: DataFrame) -> DataFrame:
    """(norm, page_id): the pages that refer to a name, the page of that name too."""
    return refs.select("norm", "page_id").distinct()


def blocks_referencing(refs: DataFrame, wanted: list[str]) -> DataFrame:
    """(page_id, ord): the blocks that refer to any of a few names."""
    return refs.where(F.col("norm").isin(wanted)).select("page_id", "ord").distinct()


def concepts(refs: DataFrame, names: DataFrame, system: tuple[str, ...] = ("flashcard", "flashcards")) -> DataFrame:
    """(norm, blocks, page_id): how many blocks refer to each concept; pages nobody refers to count 0."""
    counted = refs.groupBy("norm").agg(F.countDistinct("page_id", "ord").alias("blocks"))
    every = counted.join(names, "norm", "full_outer")
    return every.where(~F.col("norm").isin(*system)).select("norm", F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"), "page_id")


def outgoing(refs: DataFrame) -> DataFrame:
    """(page_id, norm, blocks): the blocks of each page that refer to each name."""
    return refs.groupBy("page_id", "norm").agg(F.countDistinct("ord").alias("blocks"))


def graph_edges(refs: DataFrame, names: DataFrame) -> DataFrame:
    """(src, dst, weight): page to page, or to ``concept:<name>`` where no page has the name; no loops."""
    found = resolve_name(refs, names)
    dst = F.coalesce(F.concat(F.lit("page:"), F.col("target").cast("string")), F.concat(F.lit("concept:"), "norm"))
    ends = found.select(F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("src"), dst.alias("dst"), "page_id", "ord")
    return ends.where("src <> dst").groupBy("src", "dst").agg(F.countDistinct("page_id", "ord").alias("weight"))


def graph_nodes(edges: DataFrame) -> DataFrame:
    """(node, weight): one and the weights of all edges at the node."""
    sides = edges.select(F.col("src").alias("node"), "weight").unionByName(edges.select(F.col("dst").alias("node"), "weight"))
    return sides.groupBy("node").agg((F.sum("weight") + 1).alias("weight"))


def k_hop(edges: DataFrame, seeds: list[str], hops: int = 2) -> DataFrame:
    """(node, hop): the nodes within a few steps of the seeds, either way along edges."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b")))
    reached = both.sparkSession.createDataFrame([(s, 0) for s in seeds], "node string, hop int")
    for hop in range(1, hops + 1):
        step = reached.where(F.col("hop") == hop - 1).join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node"), F.lit(hop).alias("hop"))
        reached = reached.unionByName(step.distinct()).groupBy("node").agg(F.min("hop").alias("hop"))
    return reached


def sort_blocks(blocks: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks by their page's last change, newest first, then page and place."""
    return blocks.join(pages, "page_id").orderBy(F.desc("updated_at"), "page_id", "ord")


def previous_text(blocks: DataFrame) -> DataFrame:
    """Blocks with the text of the last block before them on the page that is not blank: an as-of lookup."""
    before = Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    filled = F.when(F.trim("text") != "", F.substring("text", 1, 300))
    return blocks.withColumn("context", F.last(filled, ignorenulls=True).over(before))
