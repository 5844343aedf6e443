"""Queries of citations, files, layout and geometry: formats are written from rows and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import markup, scalars, strokes
from ..operators import ghost, ink, layout, records, resolve
from ..sources import notes as notes_source
from ..sources.tables import search_docs, table
from .notes_queries import BLOCKS, PAGES, PLAIN
from .search_queries import SQL as SEARCH_SQL
from .search_queries import bm25_search


def detect_kind(spark, sf_dir):
    heads = "case page_id % 6 when 0 then unhex('255044462D312E37') when 1 then unhex('D0CF11E0A1B11AE1') when 2 then concat(unhex('504B0304'), cast('mimetypeapplication/epub+zip' as binary)) when 3 then unhex('504B0304') when 4 then unhex('504B0304') else cast(html as binary) end"
    names = "case page_id % 6 when 1 then if(page_id % 4 = 1, 'a.PPT', 'a.doc') when 3 then 'deck.pptx' when 4 then 'x.zip' else 'file' end"
    return table(spark, sf_dir, "pages").select("page_id", F.expr(heads).alias("content"), F.expr(names).alias("name")).select("page_id", records.file_kind("content", "name").alias("kind"))


def _outline(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("i"), F.expr("cast(o_orderkey % 9 as int)").alias("level"), F.col("o_orderpriority").alias("title"))


def pdf_toc(spark, sf_dir):
    return records.contents(_outline(spark, sf_dir), most=5).select("doc_id", "i", "level", "title")


def landscape_ratio(spark, sf_dir):
    sheets = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("page"), F.col("l_quantity").alias("w"), F.lit(15.0).alias("h"))
    return records.is_landscape(sheets)


def pdf_page_texts(spark, sf_dir):
    """The text of a range of pages (ten lines each), lines in order."""
    from ..sources.tables import blocks

    lines = blocks(spark, sf_dir).select(F.col("page_id").alias("doc_id"), F.floor(F.col("ord") / 10).cast("int").alias("page"), "ord", "text").where("page between 1 and 3")
    return lines.groupBy("doc_id", "page").agg(F.expr("array_join(transform(array_sort(collect_list(struct(ord, text))), s -> s.text), '\n')").alias("text"))


def deck_text(spark, sf_dir):
    slides = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("deck"), "o_orderkey", F.concat_ws("\n", "o_orderpriority", F.concat(F.lit("Status "), "o_orderstatus")).alias("t"))
    return slides.groupBy("deck").agg(F.expr("substring(array_join(transform(array_sort(collect_list(struct(o_orderkey, t))), s -> s.t), '\n\n'), 1, 20000)").alias("text"))


def _xml(spark, sf_dir):
    names = "replace(replace(p_name, '&', '&amp;'), '<', '&lt;')"
    doc = f"'<entry><id>http://host/abs/' || p_partkey || 'v2</id><title>' || {names} || ' &amp; co</title><author><name>A ' || p_brand || '</name></author><author><name>B ' || p_type || '</name></author><published>' || (1990 + p_size) || '-05-01T00:00:00Z</published><nav src=\"c' || p_size || '.html#s\"/></entry>'"
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(doc).alias("xml"))


def xml_parse(spark, sf_dir):
    return _xml(spark, sf_dir).selectExpr("p_partkey", "xpath_string(xml, 'entry/title') as title", "xpath_int(xml, 'count(entry/author)') as authors")


def arxiv_atom(spark, sf_dir):
    """An entry's title, authors, year and number, read in one pass over the entry."""
    shape = "id string, title string, author array<struct<name:string>>, published string"
    read = _xml(spark, sf_dir).select("p_partkey", F.from_xml("xml", shape, {"ignoreSurroundingSpaces": "false"}).alias("e"))
    return read.selectExpr(
        "p_partkey", "coalesce(e.title, '') as title", "coalesce(array_join(e.author.name, '; '), '') as authors",
        "cast(substring(e.published, 1, 4) as int) as year", "regexp_extract(coalesce(e.id, ''), r'abs/(.+?)(?:v[0-9]+)?$', 1) as arxiv",
    )


def epub_nav_ncx(spark, sf_dir):
    return _xml(spark, sf_dir).selectExpr("p_partkey", "substring_index(xpath_string(xml, 'entry/nav/@src'), '#', 1) as file", "xpath_string(xml, 'entry/title') as label")


def crossref_json(spark, sf_dir):
    work = table(spark, sf_dir, "part").select("p_partkey", F.expr(
        "to_json(named_struct('title', array(p_name), 'subtitle', if(p_size % 2 = 0, array(p_type), array()), 'issued', named_struct('date-parts', if(p_size % 3 = 0, null, array(array(1950 + p_size)))), "
        "'published-print', named_struct('date-parts', array(array(1900 + p_size, 5))), 'container-title', array(p_brand), 'DOI', '10.1/' || p_partkey))"
    ).alias("j"))
    shape = "title array<string>, subtitle array<string>, issued struct<`date-parts`:array<array<int>>>, `published-print` struct<`date-parts`:array<array<int>>>, `container-title` array<string>, DOI string"
    read = work.select("p_partkey", F.from_json("j", shape).alias("w"))
    return read.selectExpr("p_partkey", "w.title[0] || coalesce(': ' || get(w.subtitle, 0), '') as title", "coalesce(w.issued.`date-parts`[0][0], w.`published-print`.`date-parts`[0][0]) as year", "w.`container-title`[0] as venue", "lower(w.DOI) as doi")


def _bib(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "'key' || s_suppkey as bib_key", "s_name as title", "array('Ada Lovelace', 'Jan van der Berg ' || s_nationkey) as authors", "1990 + s_nationkey as year")


def sink_bibtex(spark, sf_dir):
    authors = f"array_join(transform(authors, a -> {scalars.bibtex_name('a')}), ' and ')"
    return _bib(spark, sf_dir).select("id", F.expr(f"'@article{{' || bib_key || ',\n  title = {{' || title || '}},\n  author = {{' || {authors} || '}},\n  year = {{' || year || '}}\n}}\n'").alias("bibtex"))


def bibtex_parse(spark, sf_dir):
    made = sink_bibtex(spark, sf_dir).select(F.col("id").alias("file_id"), F.concat(F.lit("% note\n@string{x = {unused}}\n"), "bibtex", F.lit("@broken{\n")).alias("text"))
    return records.parse_bibtex(made).selectExpr("file_id", "type", "key", "fields['title'] as title", "fields['author'] as author", "cast(fields['year'] as int) as year")


def bib_to_meta(spark, sf_dir):
    names = f"transform(split(author, ' and '), a -> {scalars.display_name('a')})"
    return bibtex_parse(spark, sf_dir).select("file_id", F.lower("key").alias("bib_key"), "title", F.array_join(F.expr(names), "; ").alias("authors"), "year")


def import_bib(spark, sf_dir):
    """Entries meet records by key: fields that are there win, records that none meets stay, entries that meet none are new."""
    ours = _bib(spark, sf_dir).where("id % 3 <> 0").selectExpr("bib_key", "title", "if(id % 2 = 0, null, year) as year")
    entries = bib_to_meta(spark, sf_dir).where("file_id % 3 <> 1").select("bib_key", F.upper("title").alias("new_title"), F.col("year").alias("new_year"))
    return ours.join(entries, "bib_key", "full_outer").selectExpr("bib_key", "coalesce(new_title, title) as title", "coalesce(new_year, year) as year", "title is null as added")


def export_bib(spark, sf_dir):
    """The whole library as one text a venue, entries by key."""
    each = sink_bibtex(spark, sf_dir).join(table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "s_nationkey as venue"), "id")
    return each.groupBy("venue").agg(F.expr("array_join(transform(array_sort(collect_list(struct(id, bibtex))), s -> s.bibtex), '\n')").alias("bibtex"))


def refresh_citation(spark, sf_dir):
    remote = _bib(spark, sf_dir).where("id % 2 = 0").selectExpr("id", "array('New ' || title) as new_authors", "if(id % 4 = 0, null, 2000) as new_year")
    return _bib(spark, sf_dir).join(remote, "id", "left").selectExpr("id", "title", "array_join(coalesce(new_authors, authors), '; ') as authors", "cast(coalesce(new_year, year) as int) as year")


def _remote(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    ours = part.selectExpr("p_partkey as id", "if(p_partkey % 4 = 0, 'Z' || p_partkey, null) as link", "if(p_partkey % 4 = 1, '10.1/' || p_partkey, null) as doi", "p_name || ' ' || p_partkey as title", "p_size as year", "p_partkey % 7 as stamp", "3L as synced")
    theirs = part.where("p_partkey % 5 <> 0").selectExpr("'Z' || p_partkey as key", "if(p_partkey % 2 = 1, '10.1/' || p_partkey, null) as doi", "upper(p_name) || ' ' || p_partkey as title", "if(p_partkey % 3 = 0, 1, p_size) as year", "p_partkey % 6 as version")
    return ours, theirs


def zotero_plan(spark, sf_dir):
    return records.remote_plan(*_remote(spark, sf_dir))


def zotero_match(spark, sf_dir):
    return zotero_plan(spark, sf_dir).where("id is not null and key is not null and action <> 'unlink'").select("id", "key")


def zotero_to_meta(spark, sf_dir):
    item = "named_struct('creators', array(named_struct('creatorType', if(p_size % 2 = 0, 'author', 'editor'), 'name', p_brand)), 'date', 'May ' || (1950 + p_size), 'publicationTitle', if(p_size % 3 = 0, '', p_type), 'conferenceName', 'Conf ' || p_size, 'extra', 'note\nDOI: 10.1/' || p_partkey || '\nCitation Key: k' || p_partkey)"
    read = table(spark, sf_dir, "part").select("p_partkey", F.from_json(F.expr(f"to_json({item})"), "creators array<struct<creatorType:string,name:string>>, date string, publicationTitle string, conferenceName string, extra string").alias("z"))
    return read.selectExpr(
        "p_partkey", "coalesce(get(filter(z.creators, c -> c.creatorType = 'author'), 0).name, get(filter(z.creators, c -> c.creatorType = 'editor'), 0).name) as author", "cast(regexp_extract(z.date, r'([0-9]{4})', 1) as int) as year",
        "coalesce(nullif(z.publicationTitle, ''), z.conferenceName) as venue", "regexp_extract(z.extra, r'(?im)^DOI:\\s*(\\S+)', 1) as doi", "regexp_extract(z.extra, r'(?im)^Citation Key:\\s*(\\S+)', 1) as bib_key",
    )


def meta_to_zotero(spark, sf_dir):
    """Item types by kind; a DOI goes to Extra where the type has no field for it, once."""
    kind = "case p_size % 3 when 0 then 'journalArticle' when 1 then 'book' else 'thesis' end"
    extra = "if(p_size % 3 = 0, old, if(contains(old, 'DOI: '), old, trim(BOTH '\n' FROM old || '\nDOI: 10.1/' || p_partkey)))"
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size", "if(p_partkey % 4 = 0, 'DOI: 10.1/' || p_partkey, if(p_partkey % 4 = 1, 'x', '')) as old").selectExpr("p_partkey", f"{kind} as item_type", "if(p_size % 3 = 0, '10.1/' || p_partkey, '') as doi", f"{extra} as extra")


def _ghosts(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "array('Alpha', 'Beta ' || s_nationkey) as tags", "array('alpha', 'Gamma', 'Delta ' || s_nationkey) as ghosts")


def confirm_ghost(spark, sf_dir):
    return _ghosts(spark, sf_dir).selectExpr("id", "array_join(if(exists(tags, t -> lower(t) = 'gamma'), tags, concat(tags, array('Gamma'))), '|') as tags", "array_join(filter(ghosts, g -> lower(g) <> 'gamma'), '|') as ghosts")


def dismiss_ghost(spark, sf_dir):
    return _ghosts(spark, sf_dir).selectExpr("id", "array_join(tags, '|') as tags", "array_join(filter(ghosts, g -> lower(g) <> 'delta ' || (id % 25)), '|') as ghosts")


def uniq_norm(spark, sf_dir):
    both = _ghosts(spark, sf_dir).select("id", F.expr("concat(tags, ghosts)").alias("l"))
    return both.selectExpr("id", "array_join(transform(array_distinct(transform(l, t -> lower(t))), n -> filter(l, t -> lower(t) = n)[0]), '|') as tags")


def update_source(spark, sf_dir):
    return table(spark, sf_dir, "supplier").selectExpr("s_suppkey as id", "if(s_suppkey % 3 = 0, upper(s_name), s_name) as title", "if(s_suppkey % 3 = 0, 1, 0) as updated_at")


def restore_source(spark, sf_dir):
    """Sources taken back: all of the trash whose page still refers to them, and nothing twice."""
    trash = table(spark, sf_dir, "supplier").where("s_suppkey % 4 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    kept = table(spark, sf_dir, "supplier").where("s_suppkey % 4 <> 0 or s_suppkey % 8 = 0").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"))
    return kept.unionByName(trash.join(kept, "id", "left_anti").join(table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_suppkey").alias("id")), "id", "left_semi"))


def digest(spark, sf_dir):
    state = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("writer")).agg(F.count("*").alias("n"), F.max("event_id").alias("clock"))
    return state.groupBy((F.col("writer") % 10).alias("doc")).agg(F.expr("md5(array_join(transform(array_sort(collect_list(struct(writer, n, clock))), s -> s.writer || ':' || s.n || ':' || s.clock), ';'))").alias("digest"))


def _concepts(spark, sf_dir):
    """(title, count, aliases): the vault's pages as concepts; a part's size stands for how often one is used."""
    named = notes_source.pages(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.col("p_size").alias("count")), "page_id")
    return named.select("title", "count", "aliases")


def _noted(spark, sf_dir):
    """(doc_id, text): every block's plain text; a block may come twice."""
    return notes_source.blocks(spark, sf_dir).select(F.concat_ws(":", "page_id", "id").alias("doc_id"), F.expr(markup.plain("text")).alias("text"))


def concept_df(spark, sf_dir):
    """(word, df): in how many concepts' names each word stands."""
    return ghost.word_df(_concepts(spark, sf_dir))


def ghost_tags(spark, sf_dir):
    return ghost.suggestions(_noted(spark, sf_dir), _concepts(spark, sf_dir)).drop("rank")


def ghost_tags_merge_ai(spark, sf_dir):
    """Own tags and those of an answer in words, which every block has: a concept in the plural, and a name that is none."""
    noted = _noted(spark, sf_dir)
    answers = noted.select("doc_id", F.expr("concat('Sure: ```[\"#widgets ', substring_index(doc_id, '-', -1), '\", {\"tag\": \"[[Topic ', length(doc_id), ']]\"}]```')").alias("answer"))
    return ghost.with_answers(ghost.suggestions(noted, _concepts(spark, sf_dir), most=16), answers, _concepts(spark, sf_dir))


def rank_ghost(spark, sf_dir):
    """The best two tags of every block."""
    return ghost.suggestions(_noted(spark, sf_dir), _concepts(spark, sf_dir), most=2)


def search_pages(spark, sf_dir):
    """Hits of the ranked search with their page's title and a score that an exact title doubles."""
    docs = search_docs(spark, sf_dir).select("doc_id", "text", "boost")
    title = F.when(F.col("boost") == 3.0, F.col("text")).otherwise(F.concat(F.lit("Document "), F.col("doc_id").cast("string")))
    hits = docs.join(F.broadcast(bm25_search(spark, sf_dir)), "doc_id")  # twenty hits a query
    return hits.select("query_id", "doc_id", title.alias("title"), F.when(F.lower("text") == "the", F.col("score") * 2).otherwise(F.col("score")).alias("score"))


def background_merge_scan(spark, sf_dir):
    found = resolve_candidates(spark, sf_dir)
    return found.where("score >= 0.9").orderBy(F.desc("score"), *[c for c in found.columns if c != "score"]).limit(5)


def resolve_candidates(spark, sf_dir):
    from .resolve_queries import merge_candidates

    return merge_candidates(spark, sf_dir)


def commit_budget(spark, sf_dir):
    files = table(spark, sf_dir, "orders").selectExpr("o_custkey as repo", "o_orderkey as ord", "'p' || o_orderkey as path", "cast(o_totalprice as long) as size")
    return records.budgeted(files, 300_000)


def _items(spark, sf_dir):
    """Text items: an order's lines on the page of its customer."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_custkey as doc_id", "o_orderkey as id", "cast(o_orderkey % 100 as double) as x", "cast(o_orderkey * 37 % 797 as double) as y", "20D as w", "if(o_orderkey % 13 = 0, 18D, 10D) as h", "o_orderpriority as str"
    )


def _two_columns(spark, sf_dir):
    """Text runs: a customer's orders on a page of two columns, left and right in turn."""
    from pyspark.sql.window import Window

    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    placed = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", k.alias("k"))
    return placed.selectExpr(
        "o_custkey as doc_id", "o_orderkey as id", "if(k % 2 = 0, 54D, 315D) as x", "100D + 12 * (k div 2) as y", "200D as w", "10D as h", "10D as size", "'Order ' || o_orderkey || ' of the customer ' || o_custkey as str"
    )


def reading_order(spark, sf_dir):
    return layout.reading_order(_two_columns(spark, sf_dir))


def build_line(spark, sf_dir):
    return layout.page_lines(_two_columns(spark, sf_dir)).select("doc_id", "block", "line", "y", "size", "text")


def _strokes(spark, sf_dir):
    """A user's events as a stroke: their value and number make a point, their time its time."""
    point = F.struct("event_id", F.coalesce("value", F.lit(0.0)).alias("x"), (F.col("event_id") * 7 % 97).cast("double").alias("y"), F.unix_millis(F.col("ts").cast("timestamp")).cast("double").alias("t"))
    gathered = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.array_sort(F.collect_list(point)).alias("p"))
    return gathered.select("id", F.expr("transform(p, q -> struct(q.x, q.y))").alias("p"), F.expr("transform(p, q -> struct(q.x, q.y, q.t))").alias("timed"))


def _points(df):
    each = df.select("id", F.posexplode("o").alias("k", "q"))
    return each.select("id", "k", F.round("q.x", 6).alias("x"), F.round("q.y", 6).alias("y"))


def stroke_resample(spark, sf_dir):
    return _points(_strokes(spark, sf_dir).select("id", F.expr(strokes.resampled("p", 8)).alias("o")))


def stroke_simplify(spark, sf_dir):
    return _points(_strokes(spark, sf_dir).select("id", F.expr(strokes.simplified("p", 5.0)).alias("o")))


def stroke_hull(spark, sf_dir):
    return _points(_strokes(spark, sf_dir).select("id", F.expr(strokes.hull("p")).alias("o")))


def stroke_smooth(spark, sf_dir):
    return _points(_strokes(spark, sf_dir).select("id", F.expr(strokes.smoothed("timed")).alias("o")))


def cluster_strokes(spark, sf_dir):
    """Writing: a customer's orders as strokes on a page, in lines and blocks."""
    marks = table(spark, sf_dir, "orders").selectExpr(
        "cast(o_custkey as int) as group", "cast(o_orderkey as int) as id", "cast(o_orderkey % 40 * 20 as double) as x", "cast(o_orderkey * 37 % 23 * 14 as double) as y", "cast(6 + o_orderkey % 17 as double) as w", "cast(4 + o_orderkey % 13 as double) as h"
    )
    return ink.writing(marks)


def line_bands(spark, sf_dir):
    return records.bands(_items(spark, sf_dir)).select("doc_id", "id", F.col("band").cast("long"))


def group_lines(spark, sf_dir):
    return records.lines(_items(spark, sf_dir)).select("doc_id", F.col("band").cast("long"), "text")


def paragraphs(spark, sf_dir):
    return records.paragraphs(records.lines(_items(spark, sf_dir))).select("doc_id", F.col("para").cast("long"), "heading", "text")


def items_to_markdown(spark, sf_dir):
    return records.page_markdown(records.paragraphs(records.lines(_items(spark, sf_dir))))


def items_to_text(spark, sf_dir):
    made = records.lines(_items(spark, sf_dir)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("band", "text"))).alias("l"))
    return made.select("doc_id", F.array_join(F.transform("l", lambda s: s["text"]), "\n").alias("text"))


def title_authors_guess(spark, sf_dir):
    return records.title_guess(records.lines(_items(spark, sf_dir)))


def reading_labels(spark, sf_dir):
    from pyspark.sql.window import Window

    return _items(spark, sf_dir).select("doc_id", "id", F.row_number().over(Window.partitionBy("doc_id").orderBy("y", "x", "id")).alias("label"))


def cluster_1d(spark, sf_dir):
    return records.islands(_items(spark, sf_dir), ["doc_id"], "x", 8, "cluster", "id").select("doc_id", "id", F.col("cluster").cast("long"))


def align_shapes(spark, sf_dir):
    """Shapes of a row take its mean: rows are clusters along y."""
    rows = records.islands(_items(spark, sf_dir), ["doc_id"], "y", 12, "row", "id")
    mean = rows.groupBy("doc_id", "row").agg(F.round(F.avg("y"), 6).alias("mean"))
    return rows.join(mean, ["doc_id", "row"]).select("doc_id", "id", "mean")


def centroid(spark, sf_dir):
    return _items(spark, sf_dir).groupBy("doc_id").agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"), F.min("x").alias("left"), F.max(F.col("x") + F.col("w")).alias("right"))


POLYGON = [(10.0, 50.0), (90.0, 30.0), (70.0, 700.0), (40.0, 300.0), (15.0, 650.0)]


def items_in_polygon(spark, sf_dir):
    return records.inside(_items(spark, sf_dir), POLYGON).select("doc_id", "id")


def near_strokes(spark, sf_dir):
    return records.near_boxes(_items(spark, sf_dir).withColumnRenamed("doc_id", "group"), 15.0)


def connector_snap(spark, sf_dir):
    """The shape nearest to each line's end within a page, up to 200 away; of equals the lower id."""
    items = _items(spark, sf_dir)
    ends = items.where("id % 13 = 0").select("doc_id", F.col("id").alias("line"), F.col("x").alias("ex"), F.col("y").alias("ey"))
    far = F.round(F.hypot(F.col("x") - F.col("ex"), F.col("y") - F.col("ey")), 6)
    return ends.join(items.where("id % 13 <> 0"), "doc_id").select("line", "id", far.alias("d")).where("d <= 200").groupBy("line").agg(F.min_by("id", F.struct("d", "id")).alias("shape"))


def title_from_file(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(scalars.title_from_file("if(p_partkey % 10 = 0, '_.pdf', replace(p_name, ' ', '__') || '_v' || p_size || '.PDF')")).alias("title"))


def format_interval(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(scalars.format_interval("(pow(2D, o_orderkey % 41) * 997D)")).alias("shown"))


def parse_pdf_date(spark, sf_dir):
    written = "case o_orderkey % 4 when 0 then 'D:' || date_format(o_orderdate, 'yyyyMMdd') || '120000Z' when 1 then date_format(o_orderdate, 'yyyyMM') when 2 then 'D:' || year(o_orderdate) else 'none' end"
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr(scalars.pdf_date(f"({written})")).alias("day"))


def add_days(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.expr("date_format(date_add(o_orderdate, cast(o_custkey % 400 as int) - 200), 'yyyy-MM-dd')").alias("day"))


GARBAGE = ["Microsoft Word - x", "paper_final_v3", "Untitled 2", "doi:10.1/x", "slide 12", "On the Origin", "12", "ms123456", "Main results", "thesis.tex", "arXiv preprint", None]


def is_garbage_title(spark, sf_dir):
    titles = "array(" + ", ".join("cast(null as string)" if g is None else f"'{g}'" for g in GARBAGE) + ", p_name)"
    each = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.expr(titles)).alias("title"), F.expr("if(p_partkey % 5 = 0, p_name || '.pdf', 'f.pdf')").alias("f"))
    return each.select("p_partkey", "title", F.expr(scalars.is_garbage_title("title", "f")).alias("garbage"))


def join_lines(spark, sf_dir):
    made = "p_name || ' infor-\nmation of the COVID-\n19 and Anglo-\nSaxon ' || p_type || '  \n\n  end'"
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(scalars.joined_lines(f"({made})")).alias("text"))


def parse_name(spark, sf_dir):
    names = "array(p_name, 'Ada Lovelace', 'van der Waals, Johannes', 'King, Jr., Martin Luther', 'Plato', 'Jan van der Berg ' || p_size)"
    each = table(spark, sf_dir, "part").select("p_partkey", F.explode(F.expr(names)).alias("name"))
    return each.select("p_partkey", "name", F.expr(scalars.display_name("name")).alias("spoken"), F.expr(scalars.bibtex_name("name")).alias("filed"))


def extract_json(spark, sf_dir):
    prose = "case event_id % 3 when 0 then props when 1 then 'Here:\n```json\n' || props || '\n```\nbye' else 'The answer is ' || props || ', I think.' end"
    return table(spark, sf_dir, "events").select("event_id", F.expr(scalars.json_in(f"({prose})", "k")).cast("int").alias("k"))


def hash32(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(scalars.fnv32("p_name")).alias("hash"))


def hash64(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(scalars.hash64("p_name")).alias("hash"))


def seeded_random(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(F.expr(scalars.seeded_random("(p_name || p_partkey)")), 9).alias("x"))


ITEMS = """items_ as (select o_custkey doc_id, o_orderkey id, (o_orderkey % 100)::double x, (o_orderkey * 37 % 797)::double y, 20.0::double w, case when o_orderkey % 13 = 0 then 18.0 else 10.0 end::double h, o_orderpriority str from orders)"""
BANDS = f"""{ITEMS}, b_ as (select *, max(y + h) over (partition by doc_id order by y, x, id rows between unbounded preceding and 1 preceding) under from items_),
  bands_ as (select *, sum((coalesce(y >= under, false))::int) over (partition by doc_id order by y, x, id rows unbounded preceding) band from b_),
  lines_ as (select doc_id, band, min(y) y, max(h) size, string_agg(str, ' ' order by x, id) as text from bands_ group by 1, 2)"""
PARAS = f"""{BANDS}, p_ as (select *, y - lag(y) over o > 1.5 * size or lag(size) over o <> size fresh from lines_ window o as (partition by doc_id order by y, band)),
  q_ as (select *, sum(coalesce(fresh, false)::int) over (partition by doc_id order by y, band rows unbounded preceding) para from p_),
  paras_ as (select doc_id, para, max(q_.size) >= 1.5 * any_value(body) heading, string_agg(text, ' ' order by y, band) as text from q_ join (select doc_id, median(size) body from lines_ group by 1) using (doc_id) group by 1, 2)"""
EDGES = ", ".join(f"({ax}, {ay}, {bx}, {by})" for (ax, ay), (bx, by) in zip(POLYGON, [*POLYGON[1:], POLYGON[0]]))
BIB = """bib_ as (select s_suppkey id, 'key' || s_suppkey bib_key, s_name title, 'Lovelace, Ada and van der Berg ' || s_nationkey || ', Jan' filed, 'Ada Lovelace; Jan van der Berg ' || s_nationkey spoken, 1990 + s_nationkey as year, s_nationkey venue from supplier),
  tex_ as (select *, '@article{' || bib_key || ',' || chr(10) || '  title = {' || title || '},' || chr(10) || '  author = {' || filed || '},' || chr(10) || '  year = {' || year || '}' || chr(10) || '}' || chr(10) bibtex from bib_)"""
REMOTE = """o_ as (select p_partkey k, p_size sz, p_partkey % 4 = 0 linked, p_partkey % 4 = 1 has_doi, p_partkey % 5 <> 0 there, p_partkey % 2 = 1 their_doi, case when p_partkey % 3 = 0 then 1 else p_size end their_year, p_partkey % 7 stamp, p_partkey % 6 as version from part),
  plan_ as (select k id, 'Z' || k as key, case when not there then 'unlink' when version > 3 then 'update local' when stamp > 3 then 'update remote' else 'same' end as action from o_ where linked
    union all select k, 'Z' || k, 'link' from o_ where not linked and there and ((has_doi and their_doi) or sz = their_year)
    union all select k, null, 'create' from o_ where not linked and not (there and ((has_doi and their_doi) or sz = their_year))
    union all select null, 'Z' || k, 'remote only' from o_ where there and not linked and not ((has_doi and their_doi) or sz = their_year))"""
TERMS = SEARCH_SQL["bm25_search"]
GHOST = rf"""{PAGES}, {BLOCKS}, {PLAIN}, t_ as (select distinct page_id || ':' || id doc_id, regexp_extract_all(lower(p), '[a-z0-9]+') t from plain_),
  i_ as (select doc_id, t, unnest(range(1, len(t) + 1)) i from t_), f_ as (select p_partkey n, 'widget' w, p_size c from part union all select p_partkey, unnest(['w', 'gadget']), p_size from part where p_partkey % 2 = 0),
  d_ as (select w, count(*) df from f_ group by 1), m_ as (select a.doc_id, f.n, f.w, f.c, count(*) filter (b.i = a.i + 1) exact, bool_or(abs(b.i - a.i) <= 3) near
    from i_ a join i_ b on a.doc_id = b.doc_id and a.t[a.i] in ('widget', 'w', 'gadget') and regexp_full_match(b.t[b.i], '[0-9]+') join f_ f on f.w = a.t[a.i] and f.n = b.t[b.i]::bigint group by all),
  r_ as (select doc_id, 'Widget ' || n tag, max((1 + ln(greatest(exact, 1))) * (ln(1 + p / df) + ln(1 + p)) / 2 * 1.25 * (1 + 0.3 * ln(1 + c)) * case when exact > 0 then 1 else 0.6 end) raw
    from m_ join d_ using (w), (select count(*)::double p from part) where exact > 0 or near group by all),
  g_ as (select doc_id, tag, round(raw / (raw + 2.5), 3) score, row_number() over (partition by doc_id order by round(raw / (raw + 2.5), 3) desc, tag) k from r_)"""
SQL = {
    "detect_kind": "select page_id, case page_id % 6 when 0 then 'pdf' when 1 then case when page_id % 4 = 1 then 'ppt' end when 2 then 'epub' when 3 then 'pptx' end kind from pages",
    "pdf_toc": "select o_custkey doc_id, o_orderkey i, (o_orderkey % 9)::int \"level\", o_orderpriority title from orders where o_orderkey % 9 < 6 qualify row_number() over (partition by o_custkey order by o_orderkey) <= 5",
    "landscape_ratio": """select doc_id, 3 * count(*) filter (w >= 18.75) >= 2 * count(*) slides from (select l_suppkey doc_id, l_quantity w from lineitem qualify row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey) <= 8) group by 1""",
    "pdf_page_texts": """with b as (select doc_id, (i - 1)::int ord, text from (select doc_id, string_split(coalesce(text, ''), chr(10)) l from documents), lateral (select unnest(l) text, generate_subscripts(l, 1) i))
      select doc_id, (ord // 10)::int page, string_agg(text, chr(10) order by ord) as text from b where ord // 10 between 1 and 3 group by 1, 2""",
    "deck_text": "select o_custkey deck, substr(string_agg(o_orderpriority || chr(10) || 'Status ' || o_orderstatus, chr(10) || chr(10) order by o_orderkey), 1, 20000) as text from orders group by 1",
    "xml_parse": "select p_partkey, p_name || ' & co' title, 2 authors from part",
    "arxiv_atom": "select p_partkey, p_name || ' & co' title, 'A ' || p_brand || '; B ' || p_type authors, 1990 + p_size as year, p_partkey::varchar arxiv from part",
    "epub_nav_ncx": "select p_partkey, 'c' || p_size || '.html' file, p_name || ' & co' label from part",
    "crossref_json": "select p_partkey, p_name || case when p_size % 2 = 0 then ': ' || p_type else '' end title, case when p_size % 3 = 0 then 1900 else 1950 end + p_size as year, p_brand venue, '10.1/' || p_partkey doi from part",
    "sink_bibtex": f"with {BIB} select id, bibtex from tex_",
    "bibtex_parse": f"with {BIB} select id file_id, 'article' as \"type\", bib_key as key, title, filed author, year::int as year from bib_",
    "bib_to_meta": f"with {BIB} select id file_id, bib_key, title, spoken authors, year::int as year from bib_",
    "import_bib": f"""with {BIB} select bib_key, case when id % 3 <> 1 then upper(title) else title end title, case when id % 3 <> 1 or id % 2 <> 0 then year end::int as year, id % 3 = 0 added from bib_""",
    "export_bib": f"with {BIB} select venue, string_agg(bibtex, chr(10) order by id) bibtex from tex_ group by 1",
    "refresh_citation": f"with {BIB} select id, title, case when id % 2 = 0 then 'New ' || title else spoken end authors, case when id % 4 = 2 then 2000 else year end::int as year from bib_",
    "zotero_plan": f"with {REMOTE} select id, key, action from plan_",
    "zotero_match": f"with {REMOTE} select id, key from plan_ where id is not null and key is not null and action <> 'unlink'",
    "zotero_to_meta": "select p_partkey, p_brand author, 1950 + p_size as year, case when p_size % 3 = 0 then 'Conf ' || p_size else p_type end venue, '10.1/' || p_partkey doi, 'k' || p_partkey bib_key from part",
    "meta_to_zotero": """select p_partkey, case p_size % 3 when 0 then 'journalArticle' when 1 then 'book' else 'thesis' end item_type, case when p_size % 3 = 0 then '10.1/' || p_partkey else '' end doi,
      case p_partkey % 4 when 0 then 'DOI: 10.1/' || p_partkey when 1 then 'x' || case when p_size % 3 <> 0 then chr(10) || 'DOI: 10.1/' || p_partkey else '' end else case when p_size % 3 <> 0 then 'DOI: 10.1/' || p_partkey else '' end end extra from part""",
    "confirm_ghost": "select s_suppkey id, 'Alpha|Beta ' || s_nationkey || '|Gamma' tags, 'alpha|Delta ' || s_nationkey ghosts from supplier",
    "dismiss_ghost": "select s_suppkey id, 'Alpha|Beta ' || s_nationkey tags, 'alpha|Gamma' || case when s_suppkey % 25 = s_nationkey then '' else '|Delta ' || s_nationkey end ghosts from supplier",
    "uniq_norm": "select s_suppkey id, 'Alpha|Beta ' || s_nationkey || '|Gamma|Delta ' || s_nationkey tags from supplier",
    "update_source": "select s_suppkey id, case when s_suppkey % 3 = 0 then upper(s_name) else s_name end title, (s_suppkey % 3 = 0)::int updated_at from supplier",
    "restore_source": "select s_suppkey id, s_name title from supplier where s_suppkey % 4 <> 0 or s_suppkey % 8 = 0 or s_suppkey in (select l_suppkey from lineitem where l_quantity > 45)",
    "digest": "with s as (select user_id w, count(*) n, max(event_id) c from events group by 1) select w % 10 doc, md5(string_agg(w || ':' || n || ':' || c, ';' order by w)) digest from s group by 1",
    "concept_df": "select 'widget' word, count(*) df from part union all select unnest(['w', 'gadget']), count(*) from part where p_partkey % 2 = 0 union all select p_partkey::varchar, 1 from part",
    "ghost_tags": f"with {GHOST} select doc_id, tag, score from g_ where k <= 8",
    "ghost_tags_merge_ai": f"""with {GHOST}, s_ as (select doc_id, 'Widget ' || split_part(doc_id, '-', 3) tag, 0.55 score from t_ union all select doc_id, 'Topic ' || length(doc_id), 0.38 from t_),
      u_ as (select doc_id, tag, case when g.tag is null then s.score else least(1.0, g.score + case when s.tag is null then 0 else 0.2 end) end score, case when g.tag is null then 'ai' when s.tag is null then 'graph' else 'both' end origin,
        tag like 'Widget %' existing from (select * from g_ where k <= 16) g full join s_ s using (doc_id, tag))
      select doc_id, tag, round(score, 3) score, origin, existing from u_ qualify row_number() over (partition by doc_id order by round(score, 3) desc, tag) <= 8""",
    "rank_ghost": f"""with {GHOST} select doc_id, tag, score, k::int as "rank" from g_ where k <= 2""",
    "search_pages": f"""with hits as ({TERMS}), d as (select doc_id, text, false page from documents union all select -1 - page_id, regexp_extract(html, '<title>([^<]*)</title>', 1), true from pages)
      select query_id, doc_id, case when page then text else 'Document ' || doc_id end title, case when lower(text) = 'the' then score * 2 else score end score from hits join d using (doc_id)""",
    "commit_budget": """with recursive o as (select o_custkey repo, 'p' || o_orderkey path, o_totalprice::decimal(20, 2) p, row_number() over (partition by o_custkey order by o_orderkey) k from orders), z as (select repo, path, k, trunc(p)::bigint size from o),
      f as (select repo, path, k, case when size <= 300000 then size else 0 end used, size <= 300000 taken from z where k = 1 union all select z.repo, z.path, z.k, f.used + case when f.used + z.size <= 300000 then z.size else 0 end, f.used + z.size <= 300000 from f join z on z.repo = f.repo and z.k = f.k + 1)
      select repo, path from f where taken""",
    "line_bands": f"with {BANDS} select doc_id, id, band::bigint band from bands_",
    "group_lines": f"with {BANDS} select doc_id, band::bigint band, text from lines_",
    "paragraphs": f"with {PARAS} select doc_id, para::bigint para, heading, text from paras_",
    "items_to_markdown": f"with {PARAS} select doc_id, string_agg(case when heading then '# ' else '' end || text, chr(10) || chr(10) order by para) markdown from paras_ group by 1",
    "items_to_text": f"with {BANDS} select doc_id, string_agg(text, chr(10) order by band) as text from lines_ group by 1",
    "title_authors_guess": f"with {BANDS}, m as (select doc_id, max(y) * 0.6 lim from lines_ group by 1) select doc_id, arg_min(text, (-size, y, band)) title from lines_ join m using (doc_id) where y <= lim group by 1",
    "reading_labels": f"with {ITEMS} select doc_id, id, row_number() over (partition by doc_id order by y, x, id)::int label from items_",
    "cluster_1d": f"with {ITEMS}, l as (select *, x - lag(x) over (partition by doc_id order by x, id) gap from items_) select doc_id, id, sum(coalesce(gap > 8, false)::int) over (partition by doc_id order by x, id rows unbounded preceding)::bigint as \"cluster\" from l",
    "align_shapes": f"""with {ITEMS}, l as (select *, y - lag(y) over (partition by doc_id order by y, id) gap from items_), c as (select *, sum(coalesce(gap > 12, false)::int) over (partition by doc_id order by y, id rows unbounded preceding) r from l)
      select doc_id, id, round(avg(y) over (partition by doc_id, r), 6) mean from c""",
    "centroid": f"with {ITEMS} select doc_id, round(avg(x), 6) x, round(avg(y), 6) y, min(x) \"left\", max(x + w) \"right\" from items_ group by 1",
    "items_in_polygon": f"with {ITEMS}, e as (select * from (values {EDGES}) v(ax, ay, bx, by_)) select doc_id, id from items_, e group by 1, 2 having count(*) filter ((ay > y) <> (by_ > y) and x < (bx - ax) * (y - ay) / (by_ - ay) + ax) % 2 = 1",
    "near_strokes": f"with {ITEMS} select a.id a, b.id b from items_ a join items_ b on a.doc_id = b.doc_id and a.id < b.id where greatest(a.x - b.x - b.w, b.x - a.x - a.w) <= 15 and greatest(a.y - b.y - b.h, b.y - a.y - a.h) <= 15",
    "connector_snap": f"with {ITEMS}, d as (select a.id line, b.id, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 6) d from items_ a join items_ b using (doc_id) where a.id % 13 = 0 and b.id % 13 <> 0) select line, arg_min(id, (d, id)) shape from d where d <= 200 group by 1",
    "title_from_file": "select p_partkey, case when p_partkey % 10 = 0 then 'Untitled' else p_name || ' v' || p_size end title from part",
    "format_interval": """with m as (select o_orderkey, pow(2.0, o_orderkey % 41) * 997 / 60000 m from orders) select o_orderkey, case when m < 60 then greatest(1, round(m)::int) || 'm' when m < 1440 then round(m / 60)::int || 'h' when m < 43200 then round(m / 1440)::int || 'd'
      when m < 525600 then regexp_replace(printf('%.1f', round(m / 43830, 1)), '\\.0$', '') || 'mo' else regexp_replace(printf('%.1f', round(m / 525960, 1)), '\\.0$', '') || 'y' end shown from m""".replace("\\\\", "\\"),
    "parse_pdf_date": "select o_orderkey, case o_orderkey % 4 when 0 then o_orderdate::date when 1 then date_trunc('month', o_orderdate)::date when 2 then date_trunc('year', o_orderdate)::date end \"day\" from orders",
    "add_days": "select o_orderkey, strftime(o_orderdate::date + (o_custkey % 400 - 200)::int, '%Y-%m-%d') \"day\" from orders",
    "is_garbage_title": "select p_partkey, t.title, t.g or (t.title is not null and p_partkey % 5 = 0 and t.title = p_name) garbage from part, lateral (select * from (values "
    + ", ".join(f"({'null' if g is None else repr(g)}, {str(g not in ('On the Origin', 'Main results')).lower()})" for g in GARBAGE)
    + ", (p_name, false)) v(title, g)) t",
    "join_lines": "select p_partkey, p_name || ' information of the COVID-19 and Anglo-Saxon ' || p_type || ' end' as text from part",
    "parse_name": """select p_partkey, n.* from part, lateral (select * from (values (p_name, p_name, split_part(p_name, ' ', 2) || ', ' || split_part(p_name, ' ', 1)), ('Ada Lovelace', 'Ada Lovelace', 'Lovelace, Ada'), ('van der Waals, Johannes', 'Johannes van der Waals', 'van der Waals, Johannes'),
      ('King, Jr., Martin Luther', 'Martin Luther King Jr.', 'King, Jr., Martin Luther'), ('Plato', 'Plato', 'Plato'), ('Jan van der Berg ' || p_size, 'Jan van der Berg ' || p_size, 'van der Berg ' || p_size || ', Jan')) v(name, spoken, filed)) n""",
    "extract_json": "select event_id, (props::json->>'k')::int k from events",
    "hash32": """with recursive h as (select p_partkey, p_name s, 1 i, 2166136261::bigint h from part union all select p_partkey, s, i + 1, (xor(h, ascii(s[i])::bigint) * 16777619) & 4294967295 from h where i <= length(s))
      select p_partkey, h hash from h where i = length(s) + 1""",
    "hash64": """with recursive h as (select p_partkey, p_name s, 1 i, 2166136261::hugeint a, 3421674724::hugeint b from part
        union all select p_partkey, s, i + 1, (xor(a, ascii(s[i])::hugeint) * 16777619) % 4294967296, (xor(b, ascii(s[i])::hugeint) * 268435891) % 4294967296 from h where i <= length(s))
      select p_partkey, lower(to_base(a::bigint, 36) || to_base(b::bigint, 36)) hash from h where i = length(s) + 1""",
    "reading_order": """with k as (select *, row_number() over (partition by o_custkey order by o_orderkey) - 1 k from orders)
      select o_custkey doc_id, o_orderkey id, row_number() over (partition by o_custkey order by k % 2, k)::int place from k""",
    "build_line": """with k as (select *, row_number() over (partition by o_custkey order by o_orderkey) - 1 k from orders)
      select o_custkey doc_id, (k % 2)::int as "block", (k // 2)::int line, 100.0::double + 12 * (k // 2) y, 10.0::double size, 'Order ' || o_orderkey || ' of the customer ' || o_custkey as text from k""",
    "cluster_strokes": """with recursive s as (select o_custkey::int g, o_orderkey::int id, (o_orderkey % 40 * 20)::double x, (o_orderkey * 37 % 23 * 14)::double y, (6 + o_orderkey % 17)::double w, (4 + o_orderkey % 13)::double h from orders),
      m as (select g, greatest(coalesce(median(greatest(h, w * 0.5)) filter (greatest(h, w * 0.5) > 3 and greatest(w, h) <= 150), 0), 10) lh from s group by 1), p as (select * from s join m using (g)),
      e as (select a.id a, b.id b from p a join p b on a.g = b.g and a.id <> b.id
        where (least(a.y + a.h / 2 + greatest(a.h, a.lh / 2) / 2, b.y + b.h / 2 + greatest(b.h, a.lh / 2) / 2) - greatest(a.y + a.h / 2 - greatest(a.h, a.lh / 2) / 2, b.y + b.h / 2 - greatest(b.h, a.lh / 2) / 2))
            / least(greatest(a.h, a.lh / 2), greatest(b.h, a.lh / 2)) >= 0.3 and greatest(0, a.x - b.x - b.w, b.x - a.x - a.w) <= greatest(20, a.lh * 1.3)),
      r as (select id a, id b from p union select r.a, e.b from r join e on r.b = e.a), l as (select a id, min(b) line from r group by 1),
      x as (select g, line id, min(x) x, min(y) y, max(x + w) - min(x) w, max(y + h) - min(y) h, any_value(lh) lh from p join l using (id) group by 1, 2),
      f as (select a.id a, b.id b from x a join x b on a.g = b.g and a.id <> b.id where greatest(0, a.y - b.y - b.h, b.y - a.y - a.h) <= a.lh * 0.9 and least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) > -a.lh * 0.5),
      q as (select id a, id b from x union select q.a, f.b from q join f on q.b = f.a), k as (select a line, min(b) block from q group by 1)
      select g as "group", id, line, "block" from p join l using (id) join k using (line)""",
    "stroke_resample": """with e as (select user_id id, list({'x': coalesce(value, 0), 'y': (event_id * 7 % 97)::double} order by event_id) p from events group by 1),
      c as (select id, p, list_transform(range(1, len(p) + 1), lambda i: coalesce(list_sum(list_transform(range(2, i + 1), lambda j: sqrt(pow(p[j].x - p[j - 1].x, 2) + pow(p[j].y - p[j - 1].y, 2)))), 0)) l from e),
      k as (select id, p, l, k, case when k = 7 then l[len(l)] else l[len(l)] * k / 7 end goal from c, range(8) r(k)),
      s as (select *, case when k in (0, 7) then null else list_position(list_transform(l, lambda v: v >= goal), true) end i from k)
      select id, k::int k, round(case when l[len(l)] = 0 or k = 0 then p[1].x when k = 7 then p[len(p)].x else p[i - 1].x + (goal - l[i - 1]) / (l[i] - l[i - 1]) * (p[i].x - p[i - 1].x) end, 6) x,
        round(case when l[len(l)] = 0 or k = 0 then p[1].y when k = 7 then p[len(p)].y else p[i - 1].y + (goal - l[i - 1]) / (l[i] - l[i - 1]) * (p[i].y - p[i - 1].y) end, 6) y from s""",
    "seeded_random": """with recursive h as (select p_partkey, p_name || p_partkey s, 1 i, 2166136261::hugeint a from part union all select p_partkey, s, i + 1, (xor(a, ascii(s[i])::hugeint) * 16777619) % 4294967296 from h where i <= length(s)),
      m0 as (select p_partkey, (a + 1831565813) % 4294967296 t from h where i = length(s) + 1), m1 as (select p_partkey, (xor(t, t >> 15) * (t | 1)) % 4294967296 t from m0),
      m2 as (select p_partkey, xor(t, (t + (xor(t, t >> 7) * (t | 61)) % 4294967296)) % 4294967296 t from m1) select p_partkey, round(xor(t, t >> 14)::double / 4294967296, 9) x from m2""",
}
#: Stacks and recurrences; tests hold them against plain readings.
ROWS_ONLY = ("background_merge_scan", "stroke_simplify", "stroke_hull", "stroke_smooth")
QUERIES = {
    f.__name__: f
    for f in (
        detect_kind, pdf_toc, landscape_ratio, pdf_page_texts, deck_text, xml_parse, arxiv_atom, epub_nav_ncx, crossref_json, sink_bibtex, bibtex_parse, bib_to_meta, import_bib, export_bib, refresh_citation, zotero_plan,
        zotero_match, zotero_to_meta, meta_to_zotero, confirm_ghost, dismiss_ghost, uniq_norm, update_source, restore_source, digest, concept_df, ghost_tags, ghost_tags_merge_ai, rank_ghost, search_pages,
        background_merge_scan, commit_budget, line_bands, group_lines, paragraphs, items_to_markdown, items_to_text, title_authors_guess, reading_labels, cluster_1d, align_shapes, centroid, items_in_polygon, near_strokes,
        connector_snap, reading_order, build_line, cluster_strokes, stroke_resample, stroke_simplify, stroke_hull, stroke_smooth, title_from_file, format_interval, parse_pdf_date, add_days, is_garbage_title, join_lines, parse_name, extract_json, hash32, hash64, seeded_random,
    )
}
