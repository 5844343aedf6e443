"""The vault's tables, as they are derived from the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def search_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, boost): every document, and the page titles of the corpus with boost 3.

    A page title has the id ``-1 - page_id``, so that the two kinds never meet.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.lit(1.0).alias("boost"))
    titles = page_titles(spark, sf_dir).select((-1 - F.col("page_id")).alias("doc_id"), F.col("title").alias("text"), F.lit(3.0).alias("boost"))
    return docs.unionByName(titles)


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, title): the first title element of each page."""
    return table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, ord, type, text): every line of every document is a block of its page."""
    docs = table(spark, sf_dir, "documents")
    lines = F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n"))
    return docs.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("type"), lines.alias("ord", "text")).select("page_id", "ord", "type", "text")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, ord, spelling, norm): the links of every page, in order; a link's place is its block."""
    hrefs = F.posexplode(F.expr(r"regexp_extract_all(html, r'href=\"/([^\"]*)\"', 1)"))
    return (
        table(spark, sf_dir, "pages")
        .select("page_id", hrefs.alias("ord", "spelling"))
        .withColumn("norm", F.lower(F.trim(F.regexp_replace("spelling", r"\s+", " "))))
    )


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(card_id, at, rating, seq): the events of a user as the answers for one card, rated by their type: errors 1, views 2, clicks 3, others 4."""
    rating = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "view", 2).when(F.col("event_type") == "click", 3).otherwise(4)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("card_id"), F.col("ts").cast("timestamp").alias("at"), rating.alias("rating"), F.col("event_id").alias("seq")
    )
