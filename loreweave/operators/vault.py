"""The vault's own tables: scans, filters, edits as table functions, the update log, and exports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def latest(log: DataFrame, key: str, *order: str) -> DataFrame:
    """Last writer wins: the newest row of each key, by an aggregate that combines within tasks."""
    rest = [c for c in log.columns if c != key]
    newest = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return newest.select(key, "row.*")


def compact(log: DataFrame, doc: str = "doc_id", threshold: int = 128) -> DataFrame:
    """(doc, rows, first_seq, last_seq, compacted): logs with as many rows as the threshold become one row."""
    return log.groupBy(doc).agg(F.count("*").alias("rows"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).withColumn("compacted", F.col("rows") >= threshold)


def manifest_diff(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(doc_id, ours, theirs): documents whose digests differ, or that one side lacks."""
    a, b = ours.withColumnRenamed("digest", "ours"), theirs.withColumnRenamed("digest", "theirs")
    return a.join(b, "doc_id", "full_outer").where(~F.col("ours").eqNullSafe(F.col("theirs")))


def tree_diff(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """The (path, sha) rows to push: those that the other side does not have as they are."""
    return ours.join(theirs, ["path", "sha"], "left_anti")


def ordered_blocks(order: DataFrame) -> DataFrame:
    """Blocks in their page's order: of an id that stands twice the first place counts."""
    first = order.groupBy("page_id", "block_id").agg(F.min("pos").alias("pos"))
    return first.withColumn("ord", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))).select("page_id", "block_id", "ord")


def empty_pages(blocks: DataFrame) -> DataFrame:
    """(page_id): pages of blank blocks only."""
    return blocks.groupBy("page_id").agg(F.every(F.trim("text") == "").alias("blank")).where("blank").select("page_id")


def fill_gaps(ours: DataFrame, theirs: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Our rows with each empty field taken from theirs."""
    other = theirs.select(key, *[F.col(f).alias(f"their_{f}") for f in fields])
    return ours.join(other, key, "left").select(key, *[F.coalesce(F.nullif(f, F.lit("")), f"their_{f}").alias(f) for f in fields])


def cascade_delete(removed: DataFrame, *tables: DataFrame, key: str = "source_id") -> list[DataFrame]:
    """Each table without the rows of removed sources."""
    return [t.join(removed.select(key), key, "left_anti") for t in tables]


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the rows put in, over those of the same key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def create_missing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The table with the rows whose key it lacks; rows it has stay as they are."""
    return table.unionByName(rows.join(table.select(key), key, "left_anti"))


def put_blobs(stored: DataFrame, blobs: DataFrame) -> DataFrame:
    """(blob_id, content) to append: content-addressed, each once, and only if it is not there."""
    named = blobs.select(F.sha2("content", 256).alias("blob_id"), "content").dropDuplicates(["blob_id"])
    return named.join(stored.select("blob_id"), "blob_id", "left_anti")


def markdown(blocks: DataFrame, titles: DataFrame) -> DataFrame:
    """(page_id, markdown): the title as a heading, then the page's blocks in order."""
    body = blocks.groupBy("page_id").agg(F.array_join(F.expr("transform(array_sort(collect_list(struct(ord, text))), b -> b.text)"), "\n\n").alias("body"))
    return titles.join(body, "page_id").select("page_id", F.concat(F.lit("# "), "title", F.lit("\n\n"), "body", F.lit("\n")).alias("markdown"))


def html_to_text(html: str) -> str:
    """SQL for a page's text: head, scripts and styles go, block tags end lines, entities are resolved, blanks collapse."""
    out = html
    for pattern, said in (
        (r"(?is)<(head|script|style)[^>]*>.*?</\\1>", " "),
        (r"(?i)</?(p|div|br|li|h[1-6]|tr|ul|ol|table|section|article)[^>]*>", "\\n"),
        ("<[^>]*>", ""),
        ("&nbsp;", " "),
        ("&lt;", "<"),
        ("&gt;", ">"),
        ("&quot;", '"'),
        ("&amp;", "&"),
        (r"[ \\t]+", " "),
        (r" ?\\n[ \\n]*", "\\n"),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{said}')"
    return f"trim(both ' \\n' from {out})"


# ---- filters of blocks: each is a condition that is never null, so that any may be negated


def has_word(word: str, prefix: bool = True):
    """Blocks with a word, or with a word that begins so."""
    words = r"regexp_extract_all(lower(text), r'[\p{L}\p{N}\p{M}]+', 0)"
    test = "startswith(w, {0})" if prefix else "w = {0}"
    return F.coalesce(F.expr(f"exists({words}, w -> {test.format(repr(word.lower()))})"), F.lit(False))


def has_phrase(phrase: str):
    """Blocks with the words side by side."""
    return F.coalesce(F.regexp_replace(F.lower("text"), r"\s+", " ").contains(" ".join(phrase.lower().split())), F.lit(False))


def of_type(kind: str):
    return F.coalesce(F.col("type") == kind, F.lit(False))


def all_of(*conditions):
    return reduce(lambda a, b: a & b, conditions)


def any_of(*conditions):
    return reduce(lambda a, b: a | b, conditions)
