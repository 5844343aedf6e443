"""Queries of the vault's tables, filters, logs and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vault
from ..sources.tables import blocks, page_titles, table


def scan_pages(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("toxic") == 1).alias("trashed"))
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "lang", "source").join(labels, "page_id", "left")
    return pages.where(~F.coalesce("trashed", F.lit(False))).drop("trashed")


def scan_page_blocks(spark, sf_dir):
    order = table(spark, sf_dir, "events").select(F.col("user_id").alias("page_id"), F.col("event_type").alias("block_id"), F.col("event_id").alias("pos"))
    return vault.ordered_blocks(order)


def scan_all_blocks(spark, sf_dir):
    return blocks(spark, sf_dir).select("page_id", "ord", "text")


def get_updates(spark, sf_dir):
    return table(spark, sf_dir, "events").where("user_id = 7").selectExpr("event_id as seq", "event_type as data")


def list_doc_ids(spark, sf_dir):
    return table(spark, sf_dir, "events").selectExpr("user_id as doc_id").distinct()


def lww_meta(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return vault.latest(log, "user_id", "ts", "event_id").select("user_id", "event_id", "event_type", "value")


def compaction(spark, sf_dir):
    log = table(spark, sf_dir, "events").selectExpr("user_id as doc_id", "event_id as seq")
    return vault.compact(log, threshold=64)


def dedup_remote(spark, sf_dir):
    return table(spark, sf_dir, "events").select("user_id", "event_type", "value").dropDuplicates(["user_id", "event_type", "value"])


def manifest_diff(spark, sf_dir):
    log = table(spark, sf_dir, "events")
    digest = lambda d: d.groupBy(F.col("user_id").alias("doc_id")).agg(F.concat(F.count("*"), F.lit(":"), F.max("event_id")).alias("digest"))
    return vault.manifest_diff(digest(log), digest(log.where("event_id % 7 <> 0 and user_id % 5 <> 0")))


def git_push(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    tree = docs.select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha"))
    return vault.tree_diff(tree, docs.select((F.col("doc_id") + 1).alias("path"), F.sha2("text", 256).alias("sha")))


def put_blob(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    there = docs.where("source = 'src0'").select(F.sha2("text", 256).alias("blob_id"))
    return vault.put_blobs(there, docs.select(F.col("text").cast("binary").alias("content"))).select("blob_id", F.octet_length("content").alias("size"))


def is_empty_page(spark, sf_dir):
    """Orders are pages, and items that were neither returned nor accepted yet are blank blocks."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page_id"), F.expr("if(l_returnflag = 'N', ' ', l_returnflag)").alias("text"))
    return vault.empty_pages(rows)


def merge_bib(spark, sf_dir):
    ours = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).otherwise("").alias("title"), F.lit(None).cast("string").alias("venue"))
    theirs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.col("p_brand").alias("venue"))
    return vault.fill_gaps(ours, theirs, "id", ["title", "venue"])


def remove_source(spark, sf_dir):
    gone = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("source_id"))
    held = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("source_id"))
    return vault.cascade_delete(gone, held)[0]


def put_source(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return vault.upsert(nation, nation.where("n_nationkey < 5").withColumn("n_name", F.lower("n_name")), "n_nationkey")


def create_page(spark, sf_dir):
    pages = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"))
    return vault.create_missing(pages, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), "id")


def lines_markdown(spark, sf_dir):
    titles = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.concat(F.lit("Page "), "doc_id").alias("title"))
    return vault.markdown(blocks(spark, sf_dir), titles)


def html_to_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.expr(vault.html_to_text("html")).alias("text"))


def page_titles_of(spark, sf_dir):
    return page_titles(spark, sf_dir)


def lens_query(spark, sf_dir):
    found = vault.all_of(
        vault.any_of(vault.has_word("there"), vault.has_phrase("of the")), ~vault.of_type("de"), ~vault.all_of(vault.of_type("fr"), vault.has_word("le", prefix=False))
    )
    return blocks(spark, sf_dir).where(found).select("page_id", "ord", "type")


def lens_not(spark, sf_dir):
    return blocks(spark, sf_dir).where(~vault.has_word("the", prefix=False)).select("page_id", "ord")


def lens_before_after(spark, sf_dir):
    at = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").where((at >= F.lit("1995-03-01").cast("timestamp")) & (at < F.lit("1996-03-01").cast("timestamp"))).select("o_orderkey", "o_custkey")


def library_filter(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where(F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type")).contains("brand#1")).orderBy(F.desc("p_partkey")).select("p_partkey", "p_name")


def palette_pages(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.where(F.lower("p_name").contains("a")).orderBy(F.lower("p_name").startswith("a").desc(), F.desc("p_retailprice"), "p_partkey").limit(8).select("p_partkey", "p_name")


def stream_days(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).where("day <= date'1996-01-01'")
    return days.groupBy("day").agg(F.count("*").alias("n")).orderBy(F.desc("day"))


def corpus_median(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.median("n_chars").alias("median_chars"))


def merge_intervals(spark, sf_dir):
    """One-dimensional intervals joined over gaps: order days of a customer, 30 days wide."""
    from pyspark.sql.window import Window

    spans = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("s"), F.date_add(F.to_date("o_orderdate"), 30).alias("e"))
    w = Window.partitionBy("o_custkey").orderBy("s", "e")
    reach = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.when(F.col("s") > reach, 1).otherwise(0)).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("o_custkey", "island").agg(F.min("s").alias("first_day"), F.max("e").alias("last_day")).drop("island")


BLOCKS = """blocks as (select page_id, (i - 1)::int ord, type, text from (select doc_id page_id, lang type, string_split(coalesce(text, ''), chr(10)) l from documents),
  lateral (select unnest(l) text, generate_subscripts(l, 1) i))"""
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}]+')"
TEXT = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(
  regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head[^>]*>.*?</head>', ' ', 'g'), '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'),
  '(?i)</?(p|div|br|li|h[1-6]|tr|ul|ol|table|section|article)[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'),
  '[ \t]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"""
DIGEST = "(select user_id doc_id, count(*) || ':' || max(event_id) digest from events {} group by 1)"
QUERIES = {
    f.__name__: f
    for f in (
        scan_pages, scan_page_blocks, scan_all_blocks, get_updates, list_doc_ids, lww_meta, compaction, dedup_remote, manifest_diff, git_push, put_blob,
        is_empty_page, merge_bib, remove_source, put_source, create_page, lines_markdown, html_to_text, page_titles_of, lens_query, lens_not,
        lens_before_after, library_filter, palette_pages, stream_days, corpus_median, merge_intervals,
    )
}
SQL = {
    "scan_pages": "select d.doc_id page_id, lang, source from documents d left join labels l using (doc_id) where coalesce(toxic, 0) <> 1",
    "scan_page_blocks": """select page_id, block_id, (row_number() over (partition by page_id order by pos))::int ord
      from (select user_id page_id, event_type block_id, min(event_id) pos from events group by 1, 2)""",
    "scan_all_blocks": f"with {BLOCKS} select page_id, ord, text from blocks",
    "get_updates": "select event_id seq, event_type data from events where user_id = 7",
    "list_doc_ids": "select distinct user_id doc_id from events",
    "lww_meta": "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "compaction": "select user_id doc_id, count(*) as rows, min(event_id) first_seq, max(event_id) last_seq, count(*) >= 64 compacted from events group by 1",
    "dedup_remote": "select distinct user_id, event_type, value from events",
    "manifest_diff": f"""select coalesce(a.doc_id, b.doc_id) doc_id, a.digest ours, b.digest theirs from {DIGEST.format('')} a
      full join {DIGEST.format('where event_id % 7 <> 0 and user_id % 5 <> 0')} b on a.doc_id = b.doc_id where a.digest is distinct from b.digest""",
    "git_push": "select doc_id path, sha256(text) sha from documents d where not exists (select 1 from documents e where e.doc_id + 1 = d.doc_id and e.text = d.text)",
    "put_blob": "select distinct sha256(text) blob_id, strlen(text)::int size from documents where text not in (select text from documents where source = 'src0')",
    "is_empty_page": "select l_orderkey page_id from lineitem group by 1 having bool_and(l_returnflag = 'N')",
    "merge_bib": """select s_suppkey id, coalesce(nullif(case when s_suppkey % 3 > 0 then s_name else '' end, ''), p_name) title, p_brand venue
      from supplier left join part on p_partkey = s_suppkey""",
    "remove_source": "select c_custkey, c_nationkey source_id from customer where c_nationkey not in (select n_nationkey from nation where n_regionkey = 1)",
    "put_source": "select n_nationkey, case when n_nationkey < 5 then lower(n_name) else n_name end n_name from nation",
    "create_page": "select c_custkey id, c_name title from customer union all select p_partkey, p_name from part where p_partkey not in (select c_custkey from customer)",
    "lines_markdown": f"""with {BLOCKS} select page_id, '# Page ' || page_id || chr(10) || chr(10) || string_agg(text, chr(10) || chr(10) order by ord) || chr(10) markdown from blocks group by 1""",
    "html_to_text": f"select page_id, {TEXT} as text from pages",
    "page_titles_of": "select page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) title from pages",
    "lens_query": f"""with {BLOCKS} select page_id, ord, type from blocks where (len(list_filter({WORDS}, lambda w: starts_with(w, 'there'))) > 0
      or contains(regexp_replace(lower(text), '\\s+', ' ', 'g'), 'of the')) and type <> 'de' and not (type = 'fr' and list_contains({WORDS}, 'le'))""",
    "lens_not": f"with {BLOCKS} select page_id, ord from blocks where not list_contains({WORDS}, 'the')",
    "lens_before_after": "select o_orderkey, o_custkey from orders where o_orderdate >= timestamp '1995-03-01' and o_orderdate < timestamp '1996-03-01'",
    "library_filter": "select p_partkey, p_name from part where contains(lower(p_name || ' ' || p_brand || ' ' || p_type), 'brand#1')",
    "palette_pages": "select p_partkey, p_name from part where contains(lower(p_name), 'a') order by starts_with(lower(p_name), 'a') desc, p_retailprice desc, p_partkey limit 8",
    "stream_days": "select o_orderdate::date as day, count(*) n from orders where o_orderdate::date <= date '1996-01-01' group by 1",
    "corpus_median": "select lang, median(n_chars) median_chars from documents group by 1",
    "merge_intervals": """with s as (select o_custkey, o_orderdate::date s, o_orderdate::date + 30 e from orders),
      i as (select *, case when s > max(e) over (partition by o_custkey order by s, e rows between unbounded preceding and 1 preceding) then 1 else 0 end nw from s),
      g as (select *, sum(nw) over (partition by o_custkey order by s, e rows unbounded preceding) isl from i)
      select o_custkey, min(s) first_day, max(e) last_day from g group by o_custkey, isl""",
}
