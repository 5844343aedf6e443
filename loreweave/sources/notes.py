"""A vault of notes with markup, derived from the tables at hand: its text is made from their values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, title, kind, updated_at, aliases, source_id): every part is a page; one in three comes from a source."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("page_id"),
        F.concat(F.lit("Widget "), F.col("p_partkey").cast("string")).alias("title"),
        F.expr("case when p_size % 5 = 0 then 'concept' when p_size % 5 = 1 then 'daily' when p_size % 5 = 2 then 'sidequest' else 'note' end").alias("kind"),
        F.expr("p_partkey * 7919 % 10007").alias("updated_at"),
        F.expr("if(p_partkey % 2 = 0, array('W-' || p_partkey, 'gadget  ' || p_partkey), array())").alias("aliases"),
        F.expr("if(p_size % 3 = 0, 'src-' || p_size, cast(null as string))").alias("source_id"),
    )


#: A block's text by the line number of its item; {s} is a supplier's number, {o} an order's, {q} a quantity.
TEXTS = {
    1: "'We use [[widget  ' || {s} || ']] here, and [[Ghost ' || {q} || '|a ghost]]'",
    2: "'Also #W-' || {s} || ' and #[[Gadget ' || {s} || ']], see ((b' || {o} || '))'",
    3: "'plain **key ' || {q} || '** words on Widget ' || {s} || ' alone'",
    4: "'![[Widget ' || {s} || '#^b' || {o} || ']] embed #draft #123'",
    5: "'code `[[Widget 1]]` and $x #tag$ at https://a.b/#c Widget ' || {s}",
    6: "'The {{{{c1::answer ' || {q} || '}}}} of {{{{c2::part ' || {s} || '::hint}}}} #flashcard'",
    7: "'What is widget ' || {s} || ':: part ' || {q} || ' #flashcards'",
}


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, id, ord, type, text, anchor_source_id, created_at): every ordered item is a block of its part's page."""
    values = {"s": "string(l_suppkey)", "o": "string(l_orderkey)", "q": "string(cast(l_quantity as int))"}
    text = "case l_linenumber " + " ".join(f"when {k} then {t.format(**values)}" for k, t in TEXTS.items()) + " else '' end"
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("page_id"),
        F.expr("'b' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey").alias("id"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
        F.expr("case when l_linenumber % 4 = 0 then 'math' when l_linenumber = 5 then 'code' else 'text' end").alias("type"),
        F.expr(text).alias("text"),
        F.expr("if(l_returnflag = 'R', 'src-' || l_suppkey % 10, cast(null as string))").alias("anchor_source_id"),
        F.col("l_shipdate").cast("date").alias("created_at"),
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, file_name, bib_key, tags): every supplier is a source."""
    return table(spark, sf_dir, "supplier").select(
        F.expr("'src-' || s_suppkey").alias("id"),
        F.col("s_name").alias("title"),
        F.expr("'paper_' || s_suppkey || '__draft.pdf'").alias("file_name"),
        F.expr("'smith' || (1990 + s_nationkey)").alias("bib_key"),
        F.expr("array('Widget ' || s_suppkey, 'gadget ' || s_suppkey, 'topic ' || s_nationkey)").alias("tags"),
    )


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, state, due, created_at, suspended, leech): every order is a card."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.expr("case substring(o_orderpriority, 1, 1) when '1' then 'new' when '2' then 'learning' when '3' then 'relearning' else 'review' end").alias("state"),
        F.expr("o_orderdate + make_dt_interval(0, 0, o_custkey % 60)").alias("due"),
        F.col("o_orderdate").alias("created_at"),
        F.expr("o_orderstatus = 'P'").alias("suspended"),
        F.expr("o_custkey % 11 = 0").alias("leech"),
    )
