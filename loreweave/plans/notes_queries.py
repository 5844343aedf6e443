"""Queries over the vault of notes with markup: references, lenses, renaming, snippets, cards and the study queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cloze, markup
from ..operators import notes
from ..sources.notes import blocks, cards, pages, sources

NOW = "1998-03-10 12:00:00"
LENSES = {
    "lens_find": '[[Widget 3]] OR source:"Supplier#000000004" OR (widget -type:math -is:flashcard before:1995-06-01)',
    "lens_tag": 'tag:"gadget 4"',
    "lens_page": 'page:"gadget 8" -type:math',
    "lens_source": "source:src-6",
    "lens_type": "type:math",
    "lens_is_flashcard": "is:flashcard",
    "lens_has_anchor": "has:anchor -tag:draft",
    "lens_text_word": "ans part",
}


def _refs(spark, sf_dir):
    return notes.references(blocks(spark, sf_dir))


def _names(spark, sf_dir):
    return notes.names(pages(spark, sf_dir))


def parse_refs(spark, sf_dir):
    return _refs(spark, sf_dir).select("page_id", "id", "ord", "kind", "norm", "block")


def plain_text(spark, sf_dir):
    return blocks(spark, sf_dir).select("page_id", "id", "ord", F.expr(markup.plain("text")).alias("plain"))


def mask_with(spark, sf_dir):
    return blocks(spark, sf_dir).where("type = 'code'").select("id", "ord", F.expr(markup.masked("text")).alias("masked"))


def backlinks(spark, sf_dir):
    return notes.backlinks(_refs(spark, sf_dir), _names(spark, sf_dir))


def concepts(spark, sf_dir):
    return notes.concepts(_refs(spark, sf_dir), pages(spark, sf_dir), _names(spark, sf_dir))


def outgoing(spark, sf_dir):
    return notes.outgoing(_refs(spark, sf_dir), _names(spark, sf_dir))


def unlinked_mentions(spark, sf_dir):
    named = _names(spark, sf_dir)
    return notes.mentions(blocks(spark, sf_dir), named, notes.backlinks(_refs(spark, sf_dir), named))


def block_references(spark, sf_dir):
    return notes.block_references(_refs(spark, sf_dir))


def blocks_for_source(spark, sf_dir):
    return blocks(spark, sf_dir).where("anchor_source_id = 'src-7'").select("page_id", "id", "ord", "text")


def _lens(name):
    def query(spark, sf_dir):
        found = notes.lens(LENSES[name], blocks(spark, sf_dir), notes.references(blocks(spark, sf_dir), once=False), pages(spark, sf_dir), _names(spark, sf_dir), sources(spark, sf_dir))
        return found.select("page_id", "id", "ord", "text")

    query.__name__ = name
    return query


def lens_group_results(spark, sf_dir):
    return notes.grouped_results(blocks(spark, sf_dir).where("type = 'code'").distinct(), pages(spark, sf_dir))


def rename_page(spark, sf_dir):
    after, changed = notes.rename_page(pages(spark, sf_dir), blocks(spark, sf_dir), "Widget 3", "Big Thing")
    return after.select(F.lit("page").alias("what"), F.col("page_id").cast("string").alias("id"), F.col("title").alias("value")).unionByName(changed.select(F.lit("block").alias("what"), "id", F.col("text").alias("value")))


def merge_concepts(spark, sf_dir):
    after, changed = notes.merge_concepts(pages(spark, sf_dir), blocks(spark, sf_dir), "Widget 4", "Widget 5")
    show = [F.lit("page").alias("what"), F.col("page_id").cast("string").alias("id"), F.concat_ws("|", "title", F.array_join("aliases", ","), F.col("trashed").cast("string")).alias("value")]
    return after.select(*show).unionByName(changed.select(F.lit("block").alias("what"), "id", F.concat_ws("|", "page_id", "ord", "text").alias("value")))


def link_mention(spark, sf_dir):
    return blocks(spark, sf_dir).select("page_id", "id", "ord", F.expr(notes.link_mention("text", "Widget 3")).alias("text"))


def tag_list_replace(spark, sf_dir):
    return sources(spark, sf_dir).select("id", F.array_join(F.expr(notes.retagged("tags", "widget 3", "Gadget 3")), "|").alias("tags"))


def snippet(spark, sf_dir):
    from ..sources.tables import table

    texts = table(spark, sf_dir, "documents").select("doc_id", F.expr("regexp_replace(coalesce(text, ''), r'\\s+', ' ')").alias("text"))
    found = texts.where(r"lower(text) rlike r'(?<![\p{L}\p{N}])(erwh|über)'").select("doc_id", F.expr(notes.snippet("text", ["erwh", "uber"])).alias("s"))
    return found.select("doc_id", "s.snippet", F.expr("array_join(transform(s.highlights, h -> concat_ws('-', h)), ',')").alias("highlights"))


def generate_cards(spark, sf_dir):
    return notes.generate_cards(blocks(spark, sf_dir))


def sync_cards(spark, sf_dir):
    made = generate_cards(spark, sf_dir).select("card_id", "id", "front", "back")
    stored = made.where("substring_index(id, '-', -1) % 4 <> 0").select("card_id", F.expr("if(substring_index(id, '-', -1) % 4 = 1, front || '!', front)").alias("front"), "back")
    wanted = made.where("substring_index(id, '-', -1) % 4 <> 3").select("card_id", "front", "back")
    return notes.sync_cards(stored, wanted)


def build_queue(spark, sf_dir):
    return notes.study_queue(cards(spark, sf_dir), 5, NOW)


def review_counts(spark, sf_dir):
    return notes.card_stats(cards(spark, sf_dir), NOW)


def set_card_flags(spark, sf_dir):
    return cards(spark, sf_dir).selectExpr("id", "if(id % 3 = 0, not suspended, suspended) as suspended", "if(id % 5 = 0, not leech, leech) as leech")


def palette_recent(spark, sf_dir):
    return pages(spark, sf_dir).where("kind <> 'sidequest'").orderBy(F.desc("updated_at"), "page_id").limit(6).select("page_id", "title")


def palette_sources(spark, sf_dir):
    found = sources(spark, sf_dir).where("contains(lower(title), '00001')")
    return found.orderBy(F.desc(F.col("title").startswith("00001")), "title").limit(5).select("id", "title")


def match_nodes(spark, sf_dir):
    from ..functions.text import fold

    return pages(spark, sf_dir).where(F.expr(fold("title")).contains("get 1")).select("page_id", "title")


def scan_sources(spark, sf_dir):
    return sources(spark, sf_dir).select("id", "title", "file_name", "bib_key")


def highlights_for(spark, sf_dir):
    return blocks(spark, sf_dir).where("anchor_source_id = 'src-3'").orderBy("created_at", "id").select("id", "created_at", "text")


def snapshot_block(spark, sf_dir):
    from ..sources.tables import table

    fields = F.expr("from_json(props, 'k int, done boolean')")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.coalesce("event_type", F.lit("text")).alias("type"), fields["k"].alias("k"), F.coalesce(fields["done"], F.lit(False)).alias("done"))


def get_block(spark, sf_dir):
    return blocks(spark, sf_dir).where("page_id = 7 and ord < 3000").select("id", "ord", "text")


def get_source(spark, sf_dir):
    return sources(spark, sf_dir).where("id = 'src-7'").select("id", "title")


def resolve_link_target(spark, sf_dir):
    """A link's page, and the block that its fragment names if that stands on the page."""
    return notes.link_targets(_refs(spark, sf_dir), _names(spark, sf_dir), blocks(spark, sf_dir))


def set_block_text(spark, sf_dir):
    changed = F.when(F.col("ord") % 5 == 0, F.concat(F.lit("new "), "text")).otherwise(F.col("text"))
    return blocks(spark, sf_dir).select("page_id", "id", "ord", changed.alias("text"))


def insert_after(spark, sf_dir):
    """A block after every cloze block: half a place on, then places are counted anew."""
    from ..operators.edits import renumber

    own = blocks(spark, sf_dir).dropDuplicates(["page_id", "id"]).select("page_id", F.col("id").alias("block_id"), F.col("ord").cast("double").alias("at"))
    new = own.where("block_id like '%-6-%'").select("page_id", F.concat("block_id", F.lit("+")).alias("block_id"), (F.col("at") + 0.5).alias("at"))
    return renumber(own.unionByName(new), "at", "block_id").select("page_id", "block_id", "ord")


def srs_options(spark, sf_dir):
    """Options with their defaults where a field is missing or out of range."""
    given = cards(spark, sf_dir).selectExpr("id", "if(id % 3 = 0, null, id % 60 - 5) as new_per_day", "if(id % 4 = 0, null, (id % 110) / 100.0) as retention")
    return given.selectExpr("id", "cast(if(new_per_day >= 0, new_per_day, 20) as int) as new_per_day", "cast(round(if(retention between 0.7 and 0.99, retention, 0.9), 2) as double) as retention")


def flashcard_tag(spark, sf_dir):
    return blocks(spark, sf_dir).where(F.expr(markup.has_card_tag("text"))).select("id", "ord", F.expr(markup.without_card_tag("text")).alias("text"))


def parse_clozes(spark, sf_dir):
    each = blocks(spark, sf_dir).select("id", "ord", F.explode(F.expr(f"filter({cloze.segments('text')}, s -> s.number > 0)")).alias("c"))
    return each.select("id", "ord", F.col("c.number").cast("string").alias("number"), "c.answer", F.coalesce("c.hint", F.lit("")).alias("hint"))


def render_cloze(spark, sf_dir):
    """Both sides of each cloze of each block, the others' answers shown, without the card tag."""
    asked = blocks(spark, sf_dir).where("contains(text, '{{c')").select("id", "ord", F.expr(markup.without_card_tag("text")).alias("t"))
    cut = asked.select("id", "ord", F.expr(cloze.segments("t")).alias("cut"))  # a text is read once for all of its sides
    each = cut.select("id", "ord", "cut", F.explode(F.expr("array_sort(array_distinct(transform(filter(cut, s -> s.number > 0), s -> s.number)))")).alias("number"))
    return each.select("id", "ord", "number", F.expr(cloze.side("t", "number", cloze.HIDDEN, cut="cut")).alias("front"), F.expr(cloze.side("t", "number", cloze.REVEALED, cut="cut")).alias("back"))


def split_clozes(spark, sf_dir):
    return blocks(spark, sf_dir).select("id", "ord", F.posexplode(F.expr(cloze.split("text"))).alias("place", "text"))


def heuristic_cloze(spark, sf_dir):
    made = cloze.with_heuristic_clozes(blocks(spark, sf_dir).select("id", "ord", "text"), "text", "clozed")
    return made.select("id", "ord", "clozed")


def block_cards(spark, sf_dir):
    asked = blocks(spark, sf_dir).where(F.expr(markup.has_card_tag("text"))).join(pages(spark, sf_dir).select("page_id", "title"), "page_id")
    return notes.block_cards(asked.select("id", "type", "text", "title", F.lit(None).cast("string").alias("context")).dropDuplicates(["id", "text"]))


def format_tag(spark, sf_dir):
    name = F.explode(F.expr("array(title, 'w' || page_id, page_id || '', 'a-' || page_id, 'abc' || page_id)"))
    each = pages(spark, sf_dir).select("page_id", name.alias("name"))
    return each.select("name", F.expr(markup.tag("name")).alias("tag"))


def escape_latex(spark, sf_dir):
    return blocks(spark, sf_dir).select("id", "ord", F.expr(markup.escaped_latex("text")).alias("latex"))


def _in_order(own, body):
    """(page_id, body): what the different blocks of each page have become, in order; a block is dealt out once."""
    shown = F.expr("array_join(transform(array_sort(collect_list(b)), x -> x.t), '\n\n')").alias("body")
    each = own.repartition("page_id").dropDuplicates().select("page_id", F.struct("ord", "id", "text", body.alias("t")).alias("b"))
    return each.groupBy("page_id").agg(shown)


def sink_latex(spark, sf_dir):
    """A page as LaTeX: its title as a section, its blocks in order, code verbatim and mathematics as it stands."""
    body = F.expr(f"case type when 'math' then '$$' || text || '$$' when 'code' then '\\\\begin{{verbatim}}' || text || '\\\\end{{verbatim}}' else {markup.escaped_latex(markup.plain('text'))} end")
    lines = _in_order(blocks(spark, sf_dir), body)
    title = F.concat(F.lit("\\section{"), F.expr(markup.escaped_latex("title")), F.lit("}\n\n"))
    return pages(spark, sf_dir).join(lines, "page_id").select("page_id", F.concat(title, "body").alias("latex"))


def clean_markdown(spark, sf_dir):
    return blocks(spark, sf_dir).select("id", "ord", F.expr(markup.cleaned("text")).alias("text"))


def sink_markdown(spark, sf_dir):
    """A page as Markdown: its title, then its blocks in order, code fenced and mathematics set apart."""
    body = F.expr(f"case type when 'math' then '$$\n' || text || '\n$$' when 'code' then '```\n' || text || '\n```' else {markup.cleaned('text')} end")
    lines = _in_order(blocks(spark, sf_dir), body)
    return pages(spark, sf_dir).join(lines, "page_id").select("page_id", F.concat(F.lit("# "), "title", F.lit("\n\n"), "body").alias("markdown"))


# The same by hand for DuckDB.  RE2 has no look-behind, so a mark before a tag is matched with it.
PAGES = """pages_ as (select p_partkey page_id, 'Widget ' || p_partkey title, case p_size % 5 when 0 then 'concept' when 1 then 'daily' when 2 then 'sidequest' else 'note' end kind,
  p_partkey * 7919 % 10007 updated_at, case when p_partkey % 2 = 0 then ['W-' || p_partkey, 'gadget  ' || p_partkey] else []::varchar[] end aliases,
  case when p_size % 3 = 0 then 'src-' || p_size end source_id from part)"""
BLOCKS = """blocks_ as (select l_partkey page_id, 'b' || l_orderkey || '-' || l_linenumber || '-' || l_suppkey id, l_orderkey * 8 + l_linenumber ord,
  case when l_linenumber % 4 = 0 then 'math' when l_linenumber = 5 then 'code' else 'text' end as "type",
  case l_linenumber when 1 then 'We use [[widget  ' || l_suppkey || ']] here, and [[Ghost ' || l_quantity::int || '|a ghost]]'
    when 2 then 'Also #W-' || l_suppkey || ' and #[[Gadget ' || l_suppkey || ']], see ((b' || l_orderkey || '))'
    when 3 then 'plain **key ' || l_quantity::int || '** words on Widget ' || l_suppkey || ' alone'
    when 4 then '![[Widget ' || l_suppkey || '#^b' || l_orderkey || ']] embed #draft #123'
    when 5 then 'code `[[Widget 1]]` and $x #tag$ at https://a.b/#c Widget ' || l_suppkey
    when 6 then 'The {{c1::answer ' || l_quantity::int || '}} of {{c2::part ' || l_suppkey || '::hint}} #flashcard'
    when 7 then 'What is widget ' || l_suppkey || ':: part ' || l_quantity::int || ' #flashcards' else '' end as text,
  case when l_returnflag = 'R' then 'src-' || l_suppkey % 10 end anchor_source_id, l_shipdate::date created_at from lineitem)"""
SOURCES = """sources_ as (select 'src-' || s_suppkey id, s_name title, 'paper_' || s_suppkey || '__draft.pdf' file_name, 'smith' || (1990 + s_nationkey) bib_key,
  ['Widget ' || s_suppkey, 'gadget ' || s_suppkey, 'topic ' || s_nationkey] tags from supplier)"""
CARDS = """cards_ as (select o_orderkey id, case left(o_orderpriority, 1) when '1' then 'new' when '2' then 'learning' when '3' then 'relearning' else 'review' end state,
  o_orderdate::timestamp + (o_custkey % 60) * interval 1 minute due, o_orderdate created_at, o_orderstatus = 'P' suspended, o_custkey % 11 = 0 leech from orders)"""
NORM = r"lower(trim(regexp_replace({}, '\s+', ' ', 'g')))"
MASKED = r"""masked_ as (select *, regexp_replace(text, '(?s)```.*?(?:```|$)|`[^`\n]+`|\$\$.*?\$\$|\$[^$\n]+\$|\b(?:https?|ftp|file)://[^\s<>"''`\])]+', ' ', 'g') m from blocks_)"""
REFS = rf"""br as (select page_id, id, ord, unnest(regexp_extract_all(m, '(?:#|!)?\[\[[^\[\]\n]+?\]\]')) r from masked_),
  refs_ as (select distinct page_id, id, ord, kind, block, {NORM.format('t')} norm from (
    select page_id, id, ord, case left(r, 1) when '#' then 'tag' when '!' then 'embed' else 'link' end kind,
      split_part(split_part(regexp_extract(r, '\[\[(.*)\]\]', 1), '|', 1), '#^', 1) t,
      nullif(split_part(split_part(regexp_extract(r, '\[\[(.*)\]\]', 1), '|', 1), '#^', 2), '') block from br
    union all select page_id, id, ord, 'block', unnest(regexp_extract_all(m, '\(\(([A-Za-z0-9_-]+)\)\)', 1)), null from masked_
    union all select page_id, id, ord, 'tag', t, null from (select page_id, id, ord,
      unnest(regexp_extract_all(regexp_replace(m, '(?:#|!)?\[\[[^\[\]\n]+?\]\]', ']', 'g'), '(?:^|[\s(\[{{,;:!?"''*_~>|])#([\p{{L}}\p{{N}}_]+(?:[-/.][\p{{L}}\p{{N}}_]+)*)', 1)) t from masked_)
      where not regexp_full_match(t, '\d+') and not (regexp_full_match(t, '(?i)[0-9a-f]{{3}}|[0-9a-f]{{4}}|[0-9a-f]{{6}}|[0-9a-f]{{8}}') and regexp_matches(t, '\d'))) where t <> '')"""
NAMES = rf"""names_ as (select norm, arg_min(page_id, (rank, page_id)) target from (select {NORM.format('title')} norm, 0 rank, page_id from pages_
  union all select {NORM.format('a')}, 1, page_id from (select page_id, unnest(aliases) a from pages_)) group by 1)"""
ALL = f"with {PAGES}, {BLOCKS}, {SOURCES}, {MASKED}, {REFS}, {NAMES}"
BACK = "back_ as (select distinct n.target, r.page_id, id, ord from refs_ r join names_ n using (norm) where kind <> 'block' and n.target <> r.page_id)"
# What is read of each kind of text, and what other readers of Markdown get, written out by the line number that made it.
PLAIN = r"""plain_ as (select *, case ord % 8 when 1 then 'We use widget ' || s || ' here, and a ghost' when 2 then 'Also W-' || s || ' and Gadget ' || s || ', see'
    when 3 then 'plain key ' || regexp_extract(text, 'key (\d+)', 1) || ' words on Widget ' || s || ' alone' when 4 then 'Widget ' || s || ' embed draft 123'
    when 5 then 'code [[Widget 1]] and x #tag at https://a.b/#c Widget ' || s when 6 then 'The answer ' || regexp_extract(text, 'answer (\d+)', 1) || ' of part ' || s || ' flashcard'
    when 7 then 'What is widget ' || s || ':: part ' || regexp_extract(text, 'part (\d+)', 1) || ' flashcards' else '' end p from (select *, split_part(id, '-', 3) s from blocks_))"""
CLEANED = r"""case ord % 8 when 1 then 'We use widget  ' || split_part(id, '-', 3) || ' here, and a ghost'
    when 2 then 'Also #W-' || split_part(id, '-', 3) || ' and Gadget ' || split_part(id, '-', 3) || ', see' || case when length(split_part(id, '-', 1)) < 6 then ' ((' || split_part(id, '-', 1) || '))' else '' end
    when 4 then '*(see: Widget ' || split_part(id, '-', 3) || ')* embed #draft #123' when 5 then replace(text, '[[Widget 1]]', 'Widget 1')
    when 6 then 'The answer ' || regexp_extract(text, 'answer (\d+)', 1) || ' of part ' || split_part(id, '-', 3) else text end"""
HAS_CARD = r"regexp_matches(text, '(?i)(?:^|[ \t])#flashcards?(?:[^\w/-]|$)')"
STRIPPED = r"""trim(regexp_replace(regexp_replace(text, '(?i)(^|[ \t]+)#flashcards?\b', '\1', 'g'), '[ \t]+', ' ', 'g'))"""
MADE = rf"""asked as (select distinct page_id, id, ord, {STRIPPED} t from blocks_ where {HAS_CARD}),
  one as (select id, t from asked group by all),
  made as (select id || ':' || k card_id, id, 'cloze' kind, k as number,
      regexp_replace(regexp_replace(t, '\{{\{{c' || k || '::.*?\}}\}}', '[...]', 'g'), '\{{\{{c\d+::(.*?)(?:::[^}}]*)?\}}\}}', '\1', 'g') front, regexp_replace(t, '\{{\{{c\d+::(.*?)(?:::[^}}]*)?\}}\}}', '\1', 'g') back
      from one, (values (1), (2)) v(k) where contains(t, '{{{{c' || k || '::')
    union all select id || ':0', id, 'qa', 0, split_part(t, '::', 1), trim(split_part(t, '::', 2)) from one where not contains(t, '{{{{c'))"""
SQL = {
    "parse_refs": f"{ALL} select page_id, id, ord, kind, norm, block from refs_",
    "plain_text": f"with {BLOCKS}, {PLAIN} select page_id, id, ord, p plain from plain_",
    "mask_with": f"""with {BLOCKS} select id, ord, 'code ' || repeat(' ', 14) || ' and ' || repeat(' ', 8) || ' at ' || repeat(' ', 14) || ' Widget ' || split_part(id, '-', 3) masked from blocks_ where "type" = 'code'""",
    "backlinks": f"{ALL}, {BACK} select * from back_",
    "concepts": f"""{ALL}, t as (select page_id, {NORM.format('title')} title, kind from pages_),
      c as (select coalesce(t.title, r.norm) concept, count(distinct (r.page_id, r.id, r.ord)) blocks from refs_ r left join names_ n using (norm) left join t on t.page_id = n.target where r.kind in ('link', 'tag') group by 1)
      select coalesce(c.concept, o.title) concept, coalesce(blocks, 0)::bigint blocks from c full join (select distinct title from t where kind = 'concept') o on o.title = c.concept
      where coalesce(c.concept, o.title) not in ('flashcard', 'flashcards')""",
    "outgoing": f"{ALL} select r.page_id, coalesce(n.target::varchar, r.norm) goal, count(distinct (id, ord)) blocks from refs_ r left join names_ n using (norm) where kind <> 'block' group by 1, 2",
    "unlinked_mentions": rf"""{ALL}, {BACK}, s as (select page_id, id, ord, ' ' || array_to_string(regexp_extract_all(lower(regexp_replace(regexp_replace(m, '(?:#|!)?\[\[[^\[\]\n]+?\]\]', ' ] ', 'g'), '#[\w/.-]+|\(\([\w-]+\)\)', ' ] ', 'g')), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]'), ' ') || ' ' s from masked_),
      n as (select distinct target, array_to_string(regexp_extract_all(norm, '[\p{{L}}\p{{N}}_]+'), ' ') run from names_)
      select distinct n.target, s.page_id, id, ord from s join n on s.s like '%' || ' ' || split_part(n.run, ' ', 1) || ' %' and contains(s.s, ' ' || n.run || ' ') where n.target <> s.page_id
      and not exists (select 1 from back_ b where b.target = n.target and b.page_id = s.page_id and b.id = s.id and b.ord = s.ord)""",
    "block_references": f"{ALL} select distinct case kind when 'block' then norm else block end block, page_id, id, ord from refs_ where kind = 'block' or block is not null",
    "blocks_for_source": f"with {BLOCKS} select page_id, id, ord, text from blocks_ where anchor_source_id = 'src-7'",
    "lens_find": f"""{ALL} select page_id, id, ord, text from blocks_ b where exists (select 1 from refs_ r where r.page_id = b.page_id and r.id = b.id and r.ord = b.ord and r.kind <> 'block'
        and r.norm in (select norm from names_ where target = 3))
      or anchor_source_id = 'src-4' or page_id in (select page_id from pages_ where source_id = 'src-4')
      or (regexp_matches(lower(text), '(^|[^a-z0-9])widget') and "type" <> 'math' and not {HAS_CARD} and created_at < date '1995-06-01')""",
    "lens_tag": f"""{ALL} select page_id, id, ord, text from blocks_ b where exists (select 1 from refs_ r where r.page_id = b.page_id and r.id = b.id and r.ord = b.ord and r.kind = 'tag' and r.norm in ('gadget 4', 'w-4', 'widget 4'))""",
    "lens_page": f"""with {BLOCKS} select page_id, id, ord, text from blocks_ where page_id = 8 and "type" <> 'math'""",
    "lens_source": f"with {PAGES}, {BLOCKS} select page_id, id, ord, text from blocks_ where anchor_source_id = 'src-6' or page_id in (select page_id from pages_ where source_id = 'src-6')",
    "lens_type": f"""with {BLOCKS} select page_id, id, ord, text from blocks_ where "type" = 'math'""",
    "lens_is_flashcard": f"with {BLOCKS} select page_id, id, ord, text from blocks_ where {HAS_CARD}",
    "lens_has_anchor": f"with {BLOCKS} select page_id, id, ord, text from blocks_ where anchor_source_id <> '' and not contains(text, '#draft')",
    "lens_text_word": f"with {BLOCKS}, {PLAIN} select page_id, id, ord, text from plain_ where regexp_matches(lower(p), '(^|[^a-z0-9])ans') and regexp_matches(lower(p), '(^|[^a-z0-9])part')",
    "lens_group_results": f"""with {PAGES}, {BLOCKS}, r as (select distinct b.page_id, b.ord, b.id, p.updated_at, b.text, b.anchor_source_id, b.created_at from blocks_ b join pages_ p using (page_id) where b."type" = 'code'),
      t as (select * from r order by updated_at desc, page_id, ord, id limit 400) select page_id, string_agg(id, ',' order by ord, id) blocks from t group by 1""",
    "rename_page": rf"""with {PAGES}, {BLOCKS} select 'page' what, page_id::varchar id, case when page_id = 3 then 'Big Thing' else title end as value from pages_
      union all select 'block', id, regexp_replace(text, '(?i)(\[\[\s*)widget\s+3(\]\]|#\^|\|)', '\1Big Thing\2', 'g') from blocks_""",
    "merge_concepts": rf"""with {PAGES}, {BLOCKS}, l as (select coalesce(max(ord) + 1, 0) after from blocks_ where page_id = 5)
      select 'page' what, page_id::varchar id, title || '|' || case when page_id = 5 then 'Widget 4,W-4,gadget  4' else array_to_string(aliases, ',') end || '|' || (page_id = 4)::varchar as value from pages_
      union all select 'block', id, case when page_id = 4 then 5 else page_id end || '|' || case when page_id = 4 then ord + after else ord end || '|' || regexp_replace(text, '(?i)(\[\[\s*)widget\s+4(\]\]|#\^|\|)', '\1Widget 5\2', 'g') from blocks_, l""",
    "link_mention": rf"""with {BLOCKS} select page_id, id, ord, case when ord % 8 in (3, 5, 7) then regexp_replace(text, '(?i)\b(widget\s+3)\b', '[[\1]]') else text end as text from blocks_""",
    "tag_list_replace": f"with {SOURCES} select id, array_to_string(case when id = 'src-3' then ['Gadget 3', 'topic ' || split_part(tags[3], ' ', 2)] else tags end, '|') tags from sources_",
    "snippet": r"""with t as (select doc_id, regexp_replace(coalesce(text, ''), '\s+', ' ', 'g') x from documents), h as (select *, length(regexp_extract(lower(strip_accents(x)), '(?s)^(.*?(?:^|[^\p{L}\p{N}]))(?:erwh|uber)', 1)) hit from t where regexp_matches(lower(x), '(?:^|[^\p{L}\p{N}])(?:erwh|über)')),
      r as (select *, greatest(0, hit - 60) raw from h), b as (select *, strpos(reverse(x[:raw + 1]), ' ') back from r), s as (select *, case when raw = 0 then 0 when back between 1 and 20 then raw - back + 2 else raw end st from b),
      e as (select *, strpos(reverse(x[:st + 181]), ' ') cut from s), f as (select *, case when st + 180 >= length(x) then length(x) when cut > 0 and cut - 1 < 90 then st + 181 - cut else st + 180 end en from e),
      g as (select doc_id, case when st > 0 then '…' else '' end || substr(x, st + 1, en - st) || case when length(x) > en then '…' else '' end snippet, length(x) from f), l as (select *, lower(strip_accents(snippet)) y from g)
      select doc_id, snippet, array_to_string(list_transform(list_filter(range(length(y)), lambda i: regexp_matches(substr(y, i + 1), '^(erwh|uber)') and (i = 0 or not regexp_matches(substr(y, i, 1), '[\p{L}\p{N}]'))),
        lambda i: i || '-' || (i + length(regexp_extract(substr(y, i + 1), '^[\p{L}\p{N}]+')))), ',') highlights from l""",
    "generate_cards": f"with {BLOCKS}, {MADE} select card_id, id, kind, number::int number, front, back from made",
    "sync_cards": f"""with {BLOCKS}, {MADE}, m as (select distinct card_id, split_part(id, '-', 3)::int % 4 k from made)
      select card_id, case k when 0 then 'new' when 1 then 'changed' when 2 then 'kept' else 'gone' end change from m""",
    "build_queue": f"""with {CARDS}, q as (select *, case when state in ('learning', 'relearning') then case when due <= timestamp '{NOW}' then 0 when due <= timestamp '{NOW}' + interval 20 minute then 3 end
        when state = 'review' then case when due < timestamp '1998-03-11 04:00:00' then 1 end else 2 end bucket from cards_ where not suspended),
      p as (select bucket, id, row_number() over (partition by bucket order by case bucket when 2 then created_at else due end, id) place from q where bucket is not null)
      select bucket::int bucket, place::int place, id from p where bucket in (0, 3) or (bucket = 1 and place <= 200) or (bucket = 2 and place <= 15)""",
    "review_counts": f"""with {CARDS}, d as (select *, greatest(0, date_diff('day', date '1998-03-10', (due - interval 4 hour)::date)) k from cards_)
      select 'total' what, count(*) n from d having n > 0 union all select state, count(*) from d group by 1 union all select 'suspended', count(*) from d where suspended having count(*) > 0 union all select 'leeches', count(*) from d where leech having count(*) > 0
      union all select 'day ' || k, count(*) from d where not suspended and state <> 'new' and k < 7 group by 1""",
    "set_card_flags": f"with {CARDS} select id, suspended <> (id % 3 = 0) suspended, leech <> (id % 5 = 0) leech from cards_",
    "palette_recent": f"with {PAGES} select page_id, title from pages_ where kind <> 'sidequest' order by updated_at desc, page_id limit 6",
    "palette_sources": f"with {SOURCES} select id, title from sources_ where title like '%00001%' order by title limit 5",
    "match_nodes": f"with {PAGES} select page_id, title from pages_ where title ilike '%get 1%'",
    "scan_sources": f"with {SOURCES} select id, title, file_name, bib_key from sources_",
    "highlights_for": f"with {BLOCKS} select id, created_at, text from blocks_ where anchor_source_id = 'src-3'",
    "snapshot_block": """select event_id id, event_type as "type", (props::json->>'k')::int k, false done from events""",
    "get_block": f"with {BLOCKS} select id, ord, text from blocks_ where page_id = 7 and ord < 3000",
    "get_source": "select 'src-7' id, s_name title from supplier where s_suppkey = 7",
    "resolve_link_target": f"""{ALL} select distinct r.id, r.ord, r.norm, n.target page, exists (select 1 from blocks_ b where b.page_id = n.target and split_part(b.id, '-', 1) = r.block) block_found
      from refs_ r left join names_ n using (norm) where kind in ('link', 'embed')""",
    "set_block_text": f"with {BLOCKS} select page_id, id, ord, case when ord % 5 = 0 then 'new ' else '' end || text as text from blocks_",
    "insert_after": f"""with {BLOCKS}, o as (select page_id, id, min(ord) pos from blocks_ group by 1, 2), u as (select page_id, id block_id, pos::double pos from o union all select page_id, id || '+', pos + 0.5 from o where id like '%-6-%')
      select page_id, block_id, (row_number() over (partition by page_id order by pos, block_id) - 1)::int ord from u""",
    "srs_options": """with g as (select o_orderkey id, case when o_orderkey % 3 <> 0 then o_orderkey % 60 - 5 end n, case when o_orderkey % 4 <> 0 then (o_orderkey % 110) / 100.0 end r from orders)
      select id, (case when n >= 0 then n else 20 end)::int new_per_day, round(case when r between 0.7 and 0.99 then r else 0.9 end, 2)::double retention from g""",
    "flashcard_tag": f"with {BLOCKS} select id, ord, {STRIPPED} as text from blocks_ where {HAS_CARD}",
    "parse_clozes": """select 'b' || l_orderkey || '-6-' || l_suppkey id, l_orderkey * 8 + 6 ord, k::varchar number, case k when 1 then 'answer ' || l_quantity::int else 'part ' || l_suppkey end answer, case k when 1 then '' else 'hint' end hint
      from lineitem, (values (1), (2)) v(k) where l_linenumber = 6""",
    "render_cloze": """select 'b' || l_orderkey || '-6-' || l_suppkey id, l_orderkey * 8 + 6 ord, k as number,
        'The ' || case k when 1 then '<span class="cloze cloze-hidden">[...]</span> of part ' || l_suppkey else 'answer ' || l_quantity::int || ' of <span class="cloze cloze-hidden">[hint]</span>' end front,
        'The ' || case k when 1 then '<mark class="cloze cloze-revealed">answer ' || l_quantity::int || '</mark> of part ' || l_suppkey else 'answer ' || l_quantity::int || ' of <mark class="cloze cloze-revealed">part ' || l_suppkey || '</mark>' end back
      from lineitem, (values (1), (2)) v(k) where l_linenumber = 6""",
    "split_clozes": """select 'b' || l_orderkey || '-6-' || l_suppkey id, l_orderkey * 8 + 6 ord, k - 1 place,
        case k when 1 then 'The {{c1::answer ' || l_quantity::int || '}} of part ' || l_suppkey else 'The answer ' || l_quantity::int || ' of {{c1::part ' || l_suppkey || '::hint}}' end || ' #flashcard' as text
      from lineitem, (values (1), (2)) v(k) where l_linenumber = 6""",
    "heuristic_cloze": f"""with {BLOCKS}, n as (select *, split_part(id, '-', 3) s, split_part(id, '-', 1) b, case ord % 8 when 3 then regexp_extract(text, 'key (\\d+)', 1) when 6 then regexp_extract(text, 'answer (\\d+)', 1)
        when 7 then regexp_extract(text, ':: part (\\d+)', 1) end q from blocks_), m as (select *, length(s) > 1 s2, length(q) > 1 q2 from n),
      w as (select *, case when s2 then '{{{{c3::Widget}}}} {{{{c2::' || s || '}}}}' else '{{{{c2::Widget}}}} ' || s end named,
        case when q2 then '{{{{c1::' || q || '}}}}' else q end first, case when s2 and s <> q then '{{{{c' || case when q2 then 2 else 1 end || '::' || s || '}}}}' else s end other from m)
      select id, ord, case ord % 8 when 1 then 'We use {{{{c1::widget  ' || s || '}}}} here, and {{{{c2::a ghost}}}}'
        when 2 then 'Also #' || case when s2 then 'W-{{{{c2::' || s || '}}}}' else '{{{{c2::W-' || s || '}}}}' end || ' and #{{{{c1::Gadget ' || s || '}}}}, see ((' || b || '))'
        when 3 then 'plain **{{{{c1::key ' || q || '}}}}** words on ' || named || ' alone' when 4 then '!{{{{c1::Widget ' || s || '#^' || b || '}}}} embed #draft #{{{{c2::123}}}}'
        when 5 then 'code `[[Widget 1]]` and {{{{c1::$x #tag$}}}} at https://a.b/#c ' || named
        when 6 then case when q2 or (s2 and s <> q) then 'The {{{{c1::answer ' || first || '}}}} of {{{{c2::part ' || other || '::hint}}}} #flashcard' end
        when 7 then case when s2 and q2 and s = q then 'What is widget {{{{c1::' || s || '}}}}:: part ' || q || ' #flashcards'
          when s2 then 'What is widget {{{{c1::' || s || '}}}}:: part ' || case when q2 then '{{{{c2::' || q || '}}}}' else q end || ' #flashcards'
          when q2 then 'What is widget ' || s || ':: part {{{{c1::' || q || '}}}} #flashcards' else 'What is {{{{c1::widget ' || s || ':: part ' || q || ' #flashcards}}}}' end end clozed from w""",
    "block_cards": f"""with {BLOCKS}, n as (select distinct id, ord % 8 l, split_part(id, '-', 3) s, text from blocks_ where {HAS_CARD}),
      m as (select id, l, s, case l when 6 then regexp_extract(text, 'answer (\\d+)', 1) else regexp_extract(text, ':: part (\\d+)', 1) end q from n),
      f as (select *, case when l = 6 then 'The {{{{c1::answer ' || q || '}}}} of {{{{c2::part ' || s || '::hint}}}}'
        when length(s) > 1 then 'What is widget {{{{c1::' || s || '}}}}:: part ' || case when length(q) > 1 and q <> s then '{{{{c2::' || q || '}}}}' else q end
        when length(q) > 1 then 'What is widget ' || s || ':: part {{{{c1::' || q || '}}}}' else 'What is {{{{c1::widget ' || s || ':: part ' || q || '}}}}' end front from m)
      select distinct id || ':' || k card_id, id, 'cloze' kind, k as number, front, null::varchar back from f, (values (1), (2)) v(k) where contains(front, '{{{{c' || k || '::')""",
    "format_tag": r"""with n as (select unnest(['Widget ' || p_partkey, 'w' || p_partkey, p_partkey || '', 'a-' || p_partkey, 'abc' || p_partkey]) as name from part)
      select name, case when name like '% %' or regexp_full_match(name, '\d+') or (regexp_full_match(name, '(?i)[0-9a-f]+') and length(name) in (3, 4, 6, 8)) then '#[[' || name || ']]' else '#' || name end tag from n""",
    "escape_latex": rf"""with {BLOCKS} select id, ord, replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '#', '\#'), '$', '\$'), '_', '\_'), '{{', '\{{'), '}}', '\}}'), '%', '\%'), '&', '\&'), '~', '\textasciitilde{{}}'), '^', '\textasciicircum{{}}') latex from blocks_""",
    "clean_markdown": f"with {BLOCKS} select id, ord, {CLEANED} as text from blocks_",
    "sink_markdown": f"""with {PAGES}, {BLOCKS}, b as (select distinct page_id, ord, id, text, anchor_source_id, created_at, case "type" when 'math' then '$$' || chr(10) || text || chr(10) || '$$' when 'code' then '```' || chr(10) || text || chr(10) || '```' else {CLEANED} end t from blocks_)
      select page_id, '# ' || any_value(title) || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) order by ord, id, text) markdown from b join pages_ using (page_id) group by 1""",
    "sink_latex": rf"""with {PAGES}, {BLOCKS}, {PLAIN}, b as (select distinct page_id, ord, id, text, anchor_source_id, created_at, case "type" when 'math' then '$$' || text || '$$' when 'code' then '\begin{{verbatim}}' || text || '\end{{verbatim}}' else replace(p, '_', '\_') end t from plain_)
      select page_id, '\section{{' || any_value(title) || '}}' || chr(10) || chr(10) || string_agg(t, chr(10) || chr(10) order by ord, id, text) latex from b join pages_ using (page_id) group by 1""",
}
QUERIES = {
    f.__name__: f
    for f in (
        parse_refs, plain_text, mask_with, backlinks, concepts, outgoing, unlinked_mentions, block_references, blocks_for_source, *map(_lens, LENSES), lens_group_results, rename_page,
        merge_concepts, link_mention, tag_list_replace, snippet, generate_cards, sync_cards, build_queue, review_counts, set_card_flags, palette_recent, palette_sources, match_nodes, scan_sources,
        highlights_for, snapshot_block, get_block, get_source, resolve_link_target, set_block_text, insert_after, srs_options, flashcard_tag, parse_clozes, render_cloze, split_clozes, heuristic_cloze, block_cards, format_tag, escape_latex, sink_latex, clean_markdown, sink_markdown,
    )
}
