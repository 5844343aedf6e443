"""Queries of edits, lookups, filters by reference, citations and outlines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS
from ..operators import edits, graph, review, vault
from ..sources.tables import blocks, references, review_log, table
from .graph_queries import EDGES, NAMES, REFS, graph_nodes, names_of
from .review_queries import WITH, _fold
from .vault_queries import BLOCKS, WORDS


def get_page(spark, sf_dir):
    return table(spark, sf_dir, "customer").where("c_custkey = 7").selectExpr("c_custkey as page_id", "c_name as title")


def page_blocks(spark, sf_dir):
    return blocks(spark, sf_dir).where("page_id = 7").select("ord", "text").orderBy("ord")


def find_page_by_title(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    named = F.explode(F.array(F.struct(F.lower("p_name").alias("norm"), F.lit(1).alias("priority")), F.struct(F.lower("p_brand").alias("norm"), F.lit(1).alias("priority"))))
    return edits.find_by_title(part.select(F.col("p_partkey").alias("page_id"), F.col("p_partkey").alias("ord"), named.alias("n")).select("page_id", "ord", "n.*"))


def resolve_page(spark, sf_dir):
    names = table(spark, sf_dir, "orders").select(F.expr("if(o_orderkey % 2 = 0, date_format(o_orderdate, 'yyyy-MM-dd'), o_orderpriority)").alias("name")).distinct()
    return names.select("name", F.when(F.col("name").rlike(r"^\d{4}-\d{2}-\d{2}$"), "daily").otherwise("concept").alias("kind"))


def ensure_daily(spark, sf_dir):
    day = F.date_format("ts", "yyyy-MM-dd")
    pages = table(spark, sf_dir, "events").select(F.concat(F.lit("daily-"), day).alias("id"), day.alias("title"), "event_type")
    return vault.create_missing(pages.where("event_type = 'signup'").drop("event_type").distinct(), pages.drop("event_type").distinct(), "id")


def ensure_concept(spark, sf_dir):
    refs = references(spark, sf_dir)
    return graph.display_name(refs).join(names_of(spark, sf_dir), "norm", "left_anti").select(F.concat(F.lit("concept:"), "norm").alias("id"), F.col("spelling").alias("title"))


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", F.lit(0).alias("updated_at"))


def update_page(spark, sf_dir):
    change = _customers(spark, sf_dir).where("c_custkey % 3 = 0")
    change = change.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.upper("c_name")).alias("c_name"), F.when(F.col("c_custkey") % 5 == 0, "").alias("c_mktsegment"), F.lit(1).alias("updated_at"))
    return edits.patch(_customers(spark, sf_dir), change, "c_custkey", ["c_name", "c_mktsegment"])


def trash_page(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("page_id"))
    return edits.flag(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "lang"), gone, "page_id", "trashed")


def touch_page(spark, sf_dir):
    return edits.throttle(table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", 6 * 3600)


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").selectExpr("conv_id as page_id", "turn as block_id", "turn as ord")


def delete_block(spark, sf_dir):
    return edits.delete_blocks(_turns(spark, sf_dir), _turns(spark, sf_dir).where("block_id % 3 = 1"))


def insert_blocks(spark, sf_dir):
    return edits.insert_blocks(_turns(spark, sf_dir), _turns(spark, sf_dir).where("block_id = 1").selectExpr("page_id", "block_id + 1000 as block_id", "ord as at", "0 as i"))


def move_block(spark, sf_dir):
    return edits.move_blocks(_turns(spark, sf_dir), _turns(spark, sf_dir).where("block_id = 1").selectExpr("page_id", "block_id", "0L as at", "0 as i"))


def convert_block(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", F.when(F.col("role") == "system", "note").otherwise(F.col("role")).alias("type"))


def seminar_notebook(spark, sf_dir):
    return edits.notebook(table(spark, sf_dir, "part").selectExpr("p_partkey as source_id", "p_size as page_count"))


def dismissed_pairs(spark, sf_dir):
    pairs = table(spark, sf_dir, "orders").selectExpr("o_custkey as a", "o_orderkey as b")
    return edits.without_dismissed(pairs, pairs.where("b % 4 = 0").selectExpr("b as a", "a as b"))


def incremental_index(spark, sf_dir):
    held = blocks(spark, sf_dir).select("page_id", "ord", F.sha2("text", 256).alias("sig"))
    after = held.where("ord <> 1").withColumn("sig", F.expr("if(page_id % 5 = 0, concat(sig, '+'), sig)"))
    return edits.index_delta(held.where("page_id % 7 <> 0"), after)


def index_batches(spark, sf_dir):
    """The stored index after three batches: two thirds of the documents, every fifth gone, the last third; what it holds."""
    from ..sources import scratch
    from ..streaming import store

    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("seq"), F.coalesce("text", F.lit("")).alias("text"), F.lit(1.0).alias("boost"))
    path = scratch.folder(spark)
    gone = docs.where("doc_id % 5 = 0").withColumn("text", F.lit(None).cast("string"))
    for number, batch in enumerate((docs.where("doc_id % 3 <> 0"), gone, docs.where("doc_id % 3 = 0"))):
        store.index_batch(batch, number, path)
    store.merge_index(spark, path)
    posts, stats = store.read_index(spark, path)
    found = posts.agg(F.count("*").alias("postings"), F.sum("tf").alias("tokens"))
    return stats.join(F.broadcast(found)).select("n_docs", F.round("avgdl", 6).alias("avgdl"), "postings", "tokens")  # one row each


def log_compaction(spark, sf_dir):
    """The stored log after three batches and a compaction: long documents keep the newest row of each key."""
    from ..sources import scratch
    from ..streaming import store

    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("key"), "value")
    path = scratch.folder(spark)
    for number in range(3):
        store.append(rows.where(F.col("seq") % 3 == number), number, path)
    newest = lambda df: df.groupBy("doc_id", "key").agg(F.max_by(F.struct("seq", "value"), "seq").alias("s")).select("doc_id", "s.seq", "key", "s.value")
    store.compact(spark, path, newest, threshold=64)
    return store.read_log(spark, path)


def answer(spark, sf_dir):
    return edits.leeches(review.fsrs_fold(review_log(spark, sf_dir)), suspend=True).select("card_id", "lapses", "leech", "suspended")


def read_log(spark, sf_dir):
    rated = table(spark, sf_dir, "events").select(F.expr("if(event_type = 'error', null, user_id)").alias("card_id"), F.col("ts").alias("at"))
    return rated.where("card_id is not null and at is not null")


def session_review_day(spark, sf_dir):
    return review_log(spark, sf_dir).groupBy(review.review_day("at").alias("day")).agg(F.count("*").alias("answers"))


def _records(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    ours = part.select("p_partkey", "p_name", F.expr("if(p_partkey % 3 = 0, '', p_brand)").alias("p_brand"), "p_type")
    return ours, part.select("p_partkey", F.expr("if(p_partkey % 2 = 0, null, p_name)").alias("p_name"), F.expr("if(p_partkey % 5 = 0, '', p_brand)").alias("p_brand"), "p_type")


def missing_fields(spark, sf_dir):
    return edits.missing_fields(*_records(spark, sf_dir), "p_partkey", ["p_name", "p_brand", "p_type"])


def bib_equal(spark, sf_dir):
    return edits.equal_records(*_records(spark, sf_dir), "p_partkey", ["p_name", "p_brand", "p_type"])


def body_font_size(spark, sf_dir):
    lines = blocks(spark, sf_dir).select("page_id", (8 + (F.length("text") % 9) / 4.0).alias("size"), F.length(F.regexp_replace("text", " ", "")).alias("n"))
    return edits.body_size(lines)


def stroke_outline(spark, sf_dir):
    return edits.outline(table(spark, sf_dir, "events").selectExpr("user_id as stroke_id", "event_id as i", "cast(event_id % 997 as double) as x", "value as y"))


def label_min_weight(spark, sf_dir):
    return graph_nodes(spark, sf_dir).select("weight").orderBy(F.desc("weight")).limit(31).agg(F.greatest(F.min("weight"), F.lit(2)).alias("weight"))


def lens_ref(spark, sf_dir):
    asked = names_of(spark, sf_dir).where("page_id % 5 = 0").select("norm")
    return references(spark, sf_dir).join(asked, "norm", "left_semi").select("page_id", "ord").distinct()


def lens_page_ids(spark, sf_dir):
    held = blocks(spark, sf_dir)
    return held.join(table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("page_id")), "page_id", "left_semi").select("page_id", "ord")


def lens_or(spark, sf_dir):
    return blocks(spark, sf_dir).where(vault.any_of(vault.of_type("de"), vault.has_word("the", prefix=False))).select("page_id", "ord")


def lens_text_phrase(spark, sf_dir):
    return blocks(spark, sf_dir).where(vault.has_phrase("of the")).select("page_id", "ord")


def lens_prefix(spark, sf_dir):
    return blocks(spark, sf_dir).where(vault.has_word("ther")).select("page_id", "ord")


def tag_name_filter(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.explode(F.expr("array(cast(p_partkey as string), hex(p_partkey * 4099 + 11259375), p_name)")).alias("name")).distinct()
    return names.where(r"not name rlike '^[0-9]+$' and not (name rlike '(?i)^([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})$' and name rlike '[0-9]')")


TURNS = "t as (select conv_id page_id, turn block_id, turn ord from conversations)"
RECORDS = """o as (select p_partkey, p_name, nullif(case when p_partkey % 3 = 0 then '' else p_brand end, '') p_brand, p_type from part),
  t as (select p_partkey, case when p_partkey % 2 <> 0 then p_name end p_name, nullif(case when p_partkey % 5 = 0 then '' else p_brand end, '') p_brand, p_type from part)"""
STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
QUERIES = {
    f.__name__: f
    for f in (
        get_page, page_blocks, find_page_by_title, resolve_page, ensure_daily, ensure_concept, update_page, trash_page, touch_page, delete_block, insert_blocks,
        move_block, convert_block, seminar_notebook, dismissed_pairs, incremental_index, index_batches, log_compaction, answer, read_log, session_review_day, missing_fields, bib_equal,
        body_font_size, stroke_outline, label_min_weight, lens_ref, lens_page_ids, lens_or, lens_text_phrase, lens_prefix, tag_name_filter,
    )
}
SQL = {
    "get_page": "select c_custkey page_id, c_name title from customer where c_custkey = 7",
    "page_blocks": f"with {BLOCKS} select ord, text from blocks where page_id = 7",
    "find_page_by_title": "select norm, min(p_partkey) page_id from (select lower(p_name) norm, p_partkey from part union all select lower(p_brand), p_partkey from part) group by 1",
    "resolve_page": r"""select distinct name, case when regexp_full_match(name, '\d{4}-\d{2}-\d{2}') then 'daily' else 'concept' end kind
      from (select case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%d') else o_orderpriority end name from orders)""",
    "ensure_daily": "select distinct 'daily-' || strftime(ts, '%Y-%m-%d') id, strftime(ts, '%Y-%m-%d') title from events",
    "ensure_concept": f"with {REFS}, {NAMES} select 'concept:' || norm id, arg_min(spelling, (page_id, ord)) title from refs where norm not in (select norm from names) group by norm",
    "update_page": """select c_custkey, case when c_custkey % 6 = 0 then upper(c_name) else c_name end c_name, case when c_custkey % 15 = 0 then null else c_mktsegment end c_mktsegment,
      (c_custkey % 3 = 0)::int updated_at from customer""",
    "trash_page": "select doc_id page_id, lang, coalesce(toxic = 1, false) trashed from documents left join labels using (doc_id)",
    "touch_page": """with recursive e as (select user_id, ts::timestamp ts from events), r as (select user_id, min(ts) ts from e group by 1
      union all select r.user_id, min(e.ts) from r join e on e.user_id = r.user_id and e.ts >= r.ts + interval 6 hour group by r.user_id) select user_id, ts from r""",
    "delete_block": f"with {TURNS} select page_id, block_id, (row_number() over (partition by page_id order by ord) - 1)::int ord from t where block_id % 3 <> 1",
    "insert_blocks": f"""with {TURNS}, u as (select page_id, block_id, ord as "at", 1 side from t union all select page_id, block_id + 1000, ord, 0 from t where block_id = 1)
      select page_id, block_id, (row_number() over (partition by page_id order by "at", side) - 1)::int ord from u""",
    "move_block": f"with {TURNS} select page_id, block_id, (row_number() over (partition by page_id order by block_id <> 1, ord) - 1)::int ord from t",
    "convert_block": "select conv_id, turn, case role when 'system' then 'note' else role end as type from conversations",
    "seminar_notebook": """select p_partkey source_id, i::int ord, case i % 2 when 0 then 'slide' else 'ink' end as type, case i % 2 when 0 then (i // 2 + 1)::int end page
      from part, lateral (select unnest(range(2 * p_size)) i)""",
    "dismissed_pairs": """with p as (select o_custkey a, o_orderkey b from orders) select a, b from p where not exists
      (select 1 from p q where q.b % 4 = 0 and least(q.a, q.b) = least(p.a, p.b) and greatest(q.a, q.b) = greatest(p.a, p.b))""",
    "index_batches": rf"""with d as (select doc_id, list_filter(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[\p{{L}}\p{{N}}\p{{M}}]+'), lambda x: length(x) between 2 and 40 and x not in ({STOP})) w
      from documents where doc_id % 5 <> 0 or doc_id % 3 = 0)
      select count(*) n_docs, round(avg(len(w)), 6) avgdl, sum(len(list_distinct(w)))::bigint postings, sum(len(w))::bigint tokens from d""",
    "log_compaction": """select user_id doc_id, event_id seq, event_type as "key", value from events
      qualify count(*) over (partition by user_id) < 64 or row_number() over (partition by user_id, event_type order by event_id desc) = 1""",
    "incremental_index": f"""with {BLOCKS} select page_id, ord, case when page_id % 7 = 0 then 'added' when ord = 1 then 'removed' else 'changed' end change
      from blocks where not (page_id % 7 = 0 and ord = 1) and (page_id % 7 = 0 or ord = 1 or page_id % 5 = 0)""",
    "answer": f"{WITH}, {_fold()} select card_id, lapses, lapses >= 4 leech, lapses >= 4 suspended from st",
    "read_log": "select user_id card_id, ts as \"at\" from events where event_type <> 'error' and user_id is not null and ts is not null",
    "session_review_day": f"""{WITH} select ("at" - interval 4 hour)::date as day, count(*) answers from log group by 1""",
    "missing_fields": f"""with {RECORDS} select p_partkey, missing from (select p_partkey, concat_ws(',', case when o.p_name is not null and t.p_name is null then 'p_name' end,
      case when o.p_brand is not null and t.p_brand is null then 'p_brand' end, case when o.p_type is not null and t.p_type is null then 'p_type' end) missing from o join t using (p_partkey)) where missing <> ''""",
    "bib_equal": f"""with {RECORDS} select p_partkey, o.p_name is not distinct from t.p_name and o.p_brand is not distinct from t.p_brand and o.p_type is not distinct from t.p_type equal
      from o join t using (p_partkey)""",
    "body_font_size": f"""with {BLOCKS}, c as (select page_id, floor((8 + (length(text) % 9) / 4.0) * 2 + 0.5) half, sum(length(replace(text, ' ', ''))) n from blocks
      where length(replace(text, ' ', '')) > 0 group by 1, 2),
      r as (select *, sum(n) over (partition by page_id order by half) upto, sum(n) over (partition by page_id) total from c)
      select page_id, min(half) / 2.0 as size from r where 2 * upto >= total group by 1""",
    "stroke_outline": """with p as (select user_id s, event_id i, (event_id % 997)::double x, value y from events),
      n as (select *, lead(x) over w lx, lead(y) over w ly, first(x) over w fx, first(y) over w fy from p window w as (partition by s order by i))
      select s stroke_id, count(*) points, min(x) "left", min(y) top, max(x) "right", max(y) bottom, round(coalesce(sum(sqrt((lx - x) ** 2 + (ly - y) ** 2)), 0), 3) path,
      round(abs(sum(x * coalesce(ly, fy) - coalesce(lx, fx) * y)) / 2, 1) area from n group by 1""",
    "label_min_weight": f"""with {REFS}, {NAMES}, {EDGES}, n as (select (sum(weight) + 1)::bigint weight from (select src node, weight from edges union all select dst, weight from edges) group by node)
      select greatest(min(weight), 2)::bigint weight from (select weight from n order by weight desc limit 31)""",
    "lens_ref": f"with {REFS}, {NAMES} select distinct page_id, ord from refs where norm in (select norm from names where page_id % 5 = 0)",
    "lens_page_ids": f"with {BLOCKS} select page_id, ord from blocks where page_id in (select doc_id from labels where quality = 1)",
    "lens_or": f"with {BLOCKS} select page_id, ord from blocks where coalesce(type = 'de', false) or list_contains({WORDS}, 'the')",
    "lens_text_phrase": rf"with {BLOCKS} select page_id, ord from blocks where contains(regexp_replace(lower(text), '\s+', ' ', 'g'), 'of the')",
    "lens_prefix": f"with {BLOCKS} select page_id, ord from blocks where len(list_filter({WORDS}, lambda w: starts_with(w, 'ther'))) > 0",
    "tag_name_filter": """select distinct name from (select unnest([p_partkey::varchar, hex(p_partkey * 4099 + 11259375), p_name]) as name from part)
      where not regexp_full_match(name, '[0-9]+') and not (regexp_full_match(lower(name), '[0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8}') and regexp_matches(name, '[0-9]'))""",
}
