"""Queries of the knowledge graph: links of web pages, lines of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..sources.tables import blocks, page_titles, references, table

ASKED = ["the", "is", "de"]


def names_of(spark, sf_dir):
    """Page names: the first word of the title, as links have it."""
    return graph.name_map(page_titles(spark, sf_dir).select("page_id", F.regexp_extract("title", r"^(\S+)", 1).alias("title")))


def name_map(spark, sf_dir):
    return graph.name_map(page_titles(spark, sf_dir))


def display_name(spark, sf_dir):
    return graph.display_name(references(spark, sf_dir))


def resolve_name(spark, sf_dir):
    return graph.resolve_name(references(spark, sf_dir), names_of(spark, sf_dir)).select("page_id", "ord", "norm", "target")


def web_backlinks(spark, sf_dir):
    return graph.backlinks(references(spark, sf_dir), names_of(spark, sf_dir))


def pages_linking_to(spark, sf_dir):
    return graph.pages_linking_to(references(spark, sf_dir))


def blocks_referencing(spark, sf_dir):
    return graph.blocks_referencing(references(spark, sf_dir), ASKED)


def web_concepts(spark, sf_dir):
    return graph.concepts(references(spark, sf_dir), names_of(spark, sf_dir))


def web_outgoing(spark, sf_dir):
    return graph.outgoing(references(spark, sf_dir))


def graph_edges(spark, sf_dir):
    return graph.graph_edges(references(spark, sf_dir), names_of(spark, sf_dir))


def graph_nodes(spark, sf_dir):
    return graph.graph_nodes(graph_edges(spark, sf_dir))


def k_hop(spark, sf_dir):
    return graph.k_hop(graph_edges(spark, sf_dir), ["page:0", "page:7"], 2)


def sort_blocks(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("page_id"), F.col("turn").alias("ord"), "role")
    pages = turns.select("page_id", (F.col("page_id") % 17).alias("updated_at")).distinct()
    return graph.sort_blocks(turns, pages)


def flashcard_context(spark, sf_dir):
    return graph.previous_text(blocks(spark, sf_dir)).select("page_id", "ord", "context")


REFS = r"""refs as (select page_id, (i - 1)::int ord, spelling, lower(trim(regexp_replace(spelling, '\s+', ' ', 'g'))) norm
  from (select page_id, regexp_extract_all(html, 'href="/([^"]*)"', 1) l from pages), lateral (select unnest(l) spelling, generate_subscripts(l, 1) i))"""
NAMES = r"""names as (select lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) norm, min(page_id) page_id
  from (select page_id, regexp_extract(regexp_extract(html, '<title>([^<]*)</title>', 1), '^(\S+)', 1) title from pages) where trim(title) <> '' group by 1)"""
EDGES = """edges as (select src, dst, count(distinct (page_id, ord)) weight from (select 'page:' || r.page_id src, coalesce('page:' || n.page_id, 'concept:' || r.norm) dst, r.page_id, ord
  from refs r left join names n on r.norm = n.norm) where src <> dst group by 1, 2)"""
BLOCKS = """blocks as (select page_id, (i - 1)::int ord, text from (select doc_id page_id, string_split(coalesce(text, ''), chr(10)) l from documents),
  lateral (select unnest(l) text, generate_subscripts(l, 1) i))"""

QUERIES = {
    f.__name__: f
    for f in (
        name_map, display_name, resolve_name, web_backlinks, pages_linking_to, blocks_referencing, web_concepts, web_outgoing, graph_edges, graph_nodes,
        k_hop, sort_blocks, flashcard_context,
    )
}
SQL = {
    "name_map": r"""select lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) norm, min(page_id) page_id
      from (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) title from pages) where trim(title) <> '' group by 1""",
    "display_name": f"with {REFS} select norm, arg_min(spelling, (page_id, ord)) spelling from refs group by 1",
    "resolve_name": f"with {REFS}, {NAMES} select r.page_id, ord, norm, n.page_id target from refs r left join names n using (norm)",
    "web_backlinks": f"with {REFS}, {NAMES} select distinct n.page_id target, r.page_id, ord from refs r join names n using (norm) where n.page_id <> r.page_id",
    "pages_linking_to": f"with {REFS} select distinct norm, page_id from refs",
    "blocks_referencing": f"with {REFS} select distinct page_id, ord from refs where norm in ('the', 'is', 'de')",
    "web_concepts": f"""with {REFS}, {NAMES}, c as (select norm, count(distinct (page_id, ord)) blocks from refs group by 1)
      select coalesce(c.norm, n.norm) norm, coalesce(blocks, 0)::bigint blocks, page_id from c full join names n on c.norm = n.norm
      where coalesce(c.norm, n.norm) not in ('flashcard', 'flashcards')""",
    "web_outgoing": f"with {REFS} select page_id, norm, count(distinct ord) blocks from refs group by 1, 2",
    "graph_edges": f"with {REFS}, {NAMES}, {EDGES} select * from edges",
    "graph_nodes": f"with {REFS}, {NAMES}, {EDGES} select node, (sum(weight) + 1)::bigint weight from (select src node, weight from edges union all select dst, weight from edges) group by 1",
    "k_hop": f"""with recursive {REFS}, {NAMES}, {EDGES}, b as (select src a, dst b from edges union select dst, src from edges),
      r as (select * from (values ('page:0', 0), ('page:7', 0)) v(node, hop) union select b.b, hop + 1 from r join b on node = a where hop < 2)
      select node, min(hop)::int hop from r group by 1""",
    "sort_blocks": "select conv_id page_id, turn ord, role, conv_id % 17 updated_at from conversations",
    "flashcard_context": f"""with {BLOCKS} select page_id, ord, last_value(case when trim(text) <> '' then substr(text, 1, 300) end ignore nulls)
      over (partition by page_id order by ord rows between unbounded preceding and 1 preceding) context from blocks""",
}
