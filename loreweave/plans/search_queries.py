"""Queries of ranked search over documents and page titles."""

from __future__ import annotations

from ..functions import text as tx
from ..operators import search
from ..sources import scratch
from ..sources.tables import search_docs, table

#: Words, an open prefix, a closed word, a misspelt word and one that is nowhere.
ASKED = ["thereou onthe", "onre", "heedha the ", "idoit", "queen zzzz"]


def term_freq(spark, sf_dir):
    return search.postings(search_docs(spark, sf_dir)).select("term", "doc_id", "tf", "dl")


def doc_freq(spark, sf_dir):
    return search.doc_freq(search.postings(search_docs(spark, sf_dir)))


def corpus_stats(spark, sf_dir):
    return search.corpus_stats(search_docs(spark, sf_dir)).selectExpr("n_docs", "round(avgdl, 6) as avgdl")


def bm25_search(spark, sf_dir):
    return search.bm25_search(search_docs(spark, sf_dir), ASKED)


def match_all(spark, sf_dir):
    return search.match_all(search_docs(spark, sf_dir), ["the on", "heed"])


def expand_terms(spark, sf_dir):
    freq = search.doc_freq(search.postings(search_docs(spark, sf_dir)))
    return search.expansions(freq, search.query_tokens(spark, ASKED))


STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
INDEX = rf"""
docs as (select doc_id, coalesce(text, '') t, 1.0::double boost from documents
  union all select -1 - page_id, regexp_extract(html, '<title>([^<]*)</title>', 1), 3.0::double from pages),
idx as (select doc_id, boost, list_filter(regexp_extract_all(strip_accents(lower(t)), '[\p{{L}}\p{{N}}\p{{M}}]+'), lambda x: length(x) between 2 and 40 and x not in ({STOP})) w from docs),
posts as (select term, doc_id, dl, boost, count(*) tf from (select doc_id, boost, len(w)::int dl, unnest(w) term from idx) group by all),
freq as (select term, count(*) df from posts group by 1)"""


def _tokens(queries, last_open=True):
    import regex

    rows = []
    for q, query in enumerate(queries):
        words = list(dict.fromkeys(search.fold(w) for w in regex.findall(tx.WORD, query)))[:12]
        for g, w in enumerate(words):
            rows.append(f"({q}, {g}, '{w}', {str(not query[-1].isspace() and g == len(words) - 1).lower()}, {len(words)})")
    return "(values " + ", ".join(rows) + ") v(query_id, grp, token, as_prefix, n_groups)"


EXPANDED = f"""
kinds as (select query_id, grp, term, df, case when term = token then 1 when as_prefix and starts_with(term, token) then 2
    when length(token) >= 5 and damerau_levenshtein(term, token) <= 1 then 3 end kind from freq, {_tokens(ASKED)}),
ranked as (select *, min(kind) over (partition by query_id, grp) better, row_number() over (partition by query_id, grp, kind order by df desc, term) place
  from kinds where kind is not null),
wanted as (select query_id, grp, term, case kind when 1 then 1.0 when 2 then 0.7 else 0.5 end::double weight, df from ranked
  where place <= case kind when 1 then 1 when 2 then 48 else 8 end and (kind < 3 or better = 3))"""



def search_stored(spark, sf_dir):
    """The same searches against an index that is written first: its dictionary tells the terms, and those go into the scan."""
    path = scratch.folder(spark)
    search.write_index(search_docs(spark, sf_dir), path)
    return search.search_stored(spark, path, ASKED)


QUERIES = {f.__name__: f for f in (term_freq, doc_freq, corpus_stats, bm25_search, search_stored, match_all, expand_terms)}
SQL = {
    "term_freq": f"with {INDEX} select term, doc_id, tf, dl from posts",
    "doc_freq": f"with {INDEX} select * from freq",
    "corpus_stats": f"with {INDEX} select count(*) n_docs, round(avg(len(w)), 6) avgdl from idx",
    "expand_terms": f"with {INDEX}, {EXPANDED} select * from wanted",
    "match_all": f"""with {INDEX} select query_id::int query_id, doc_id from posts, (select * from {_tokens(["the on", "heed"])}) v
      where term = token or (length(token) >= 2 and starts_with(term, token)) group by query_id, doc_id, n_groups having count(distinct grp) = n_groups""",
    "bm25_search": f"""with {INDEX}, {EXPANDED},
    s as (select count(*) n, avg(len(w)) avgdl from idx),
    g as (select query_id, max(n_groups) n_groups from {_tokens(ASKED)} group by 1),
    sc as (select query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * boost) score, count(distinct grp) matched
      from posts join wanted using (term), s group by 1, 2),
    k as (select *, max((matched = n_groups)::int) over (partition by query_id) anyw from sc join g using (query_id)),
    r as (select query_id, doc_id, round(score * matched / n_groups, 6) score, matched, n_groups from k where anyw = 0 or matched = n_groups)
    select query_id, rank::int rank, doc_id, score, matched from (select *, row_number() over (partition by query_id order by score desc, doc_id) rank from r) where rank <= 20""",
}
SQL["search_stored"] = SQL["bm25_search"]
