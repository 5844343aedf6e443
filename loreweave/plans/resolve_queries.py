"""Queries of resolution, suggestions and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cite
from ..functions import text as tx
from ..operators import resolve
from ..sources.tables import search_docs, table


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def ngram_counts(spark, sf_dir):
    return resolve.ngram_counts(docs(spark, sf_dir))


def keyphrases(spark, sf_dir):
    return resolve.keyphrases(docs(spark, sf_dir))


def summarize(spark, sf_dir):
    return resolve.summarize(docs(spark, sf_dir))


def merge_candidates(spark, sf_dir):
    words = table(spark, sf_dir, "pages").select(F.explode(F.expr(r"regexp_extract_all(html, r'href=\"/([^\"]*)\"', 1)")).alias("title"))
    return resolve.merge_candidates(words.unionByName(table(spark, sf_dir, "part").select(F.col("p_name").alias("title"))).distinct())


def records(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_partkey").alias("id"), F.col("p_type").alias("last"), F.col("p_size").alias("year"), F.concat(F.lit("The "), "p_name").alias("title"))


def cite_keys(spark, sf_dir):
    return resolve.cite_keys(records(spark, sf_dir))


def bib_match(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    entry = part.select(F.col("p_partkey").alias("id"), F.expr("if(p_partkey % 3 = 0, concat('https://doi.org/10.1234/P', p_partkey), null)").alias("doi"), F.col("p_name").alias("title"), F.col("p_size").alias("year"))
    source = part.where("p_partkey % 2 = 0").select((F.col("p_partkey") + 10000000).alias("id"), F.expr("if(p_partkey % 4 = 0, concat('DOI: 10.1234/p', p_partkey), null)").alias("doi"), F.upper("p_name").alias("title"), F.col("p_size").alias("year"))
    return resolve.bib_match(entry, source)


def normalize_doi(spark, sf_dir):
    made = F.expr("case p_partkey % 4 when 0 then concat('https://doi.org/10.1000/AB', p_partkey) when 1 then concat('doi: 10.55/', p_name) when 2 then concat('10.1234/x.', p_partkey) else 'none' end")
    return table(spark, sf_dir, "part").select("p_partkey", made.alias("doi")).select("p_partkey", F.expr(cite.normalize_doi("doi")).alias("doi"))


def title_year_key(spark, sf_dir):
    return records(spark, sf_dir).select("id", F.expr(f"concat({cite.title_key('title')}, '|', year)").alias("title_year"))


def find_identifiers(spark, sf_dir):
    made = F.expr("concat('see doi:10.', 1000 + p_partkey, '/Ab.', p_size, '). and arXiv:', 1000 + p_partkey, '.', 10000 + p_size, ' (', p_name, ')')")
    t = table(spark, sf_dir, "part").select("p_partkey", made.alias("t"))
    return t.select("p_partkey", F.expr(cite.find_doi("t")).alias("doi"), F.expr(cite.find_arxiv("t")).alias("arxiv"), F.expr(cite.arxiv_year(cite.find_arxiv("t"))).alias("year"))


def concept_tokens(spark, sf_dir):
    return search_docs(spark, sf_dir).where("doc_id < 0").select("doc_id", F.expr(f"array_join({resolve.concept_tokens('text')}, ' ')").alias("concept"))


STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
KEYSTOP = ", ".join(f"'{w}'" for w in cite.KEY_STOP_WORDS)
TERMS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}\p{{M}}]+')"
NGRAMS = f"""w as (select doc_id, list_transform({TERMS.format("coalesce(text, '')")}, lambda x: case when x in ({STOP}) or length(x) < 2 then null else x end) w from documents),
  g as (select doc_id, w[i : i + k - 1] g from w, range(1, 4) t(k), lateral (select unnest(range(1, greatest(1, (len(w) - k + 2)::bigint))) i)),
  c as (select doc_id, array_to_string(g, ' ') phrase, len(g) size, count(*) n from g where len(g) > 0 and list_count(g) = len(g) group by all)"""
KEY = r"regexp_replace(strip_accents(lower({0})), '[^a-z0-9]', '', 'g')"
DOI = r"lower(regexp_replace(trim({0}), '(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', ''))"
PART = """p as (select * from part),
  e as (select p_partkey id, case when p_partkey % 3 = 0 then '10.1234/p' || p_partkey end doi, p_name t, p_size y from p),
  s as (select p_partkey + 10000000 id, case when p_partkey % 4 = 0 then '10.1234/p' || p_partkey end doi, p_name t, p_size y from p where p_partkey % 2 = 0)"""
SING = "case " + " ".join(f"when w = '{k}' then '{v}'" for k, v in resolve.IRREGULAR.items()) + """ when length(w) <= 3 then w when regexp_matches(w, 'ies$') and length(w) > 4 then left(w, length(w) - 3) || 'y' when regexp_matches(w, '(sses|(x|ch|sh|zz)es)$') then left(w, length(w) - 2)
  when regexp_matches(w, '(ss|us|is|ics)$') then w when regexp_matches(w, 's$') then left(w, length(w) - 1) else w end"""
QUERIES = {f.__name__: f for f in (ngram_counts, keyphrases, summarize, merge_candidates, cite_keys, bib_match, normalize_doi, title_year_key, find_identifiers, concept_tokens)}
#: Titles are resolved by a scorer that SQL lacks (no boost threshold); tests hold it against all pairs.
ROWS_ONLY = ("merge_candidates",)
SQL = {
    "ngram_counts": f"with {NGRAMS} select doc_id, phrase, n from c",
    "keyphrases": f"""with {NGRAMS}, x as (select doc_id, phrase, size, n, unnest(string_split(phrase, ' ')) word from c where n > 1),
      m as (select x.doc_id, x.phrase, x.n, x.size, avg(s.n) mean from x join c s on s.doc_id = x.doc_id and s.size = 1 and s.phrase = x.word group by all),
      r as (select doc_id, phrase, round(n * (1 + 0.6 * (size - 1)) + 0.3 * mean - case when size = 1 and length(phrase) < 5 then 1 else 0 end, 6) score from m),
      k as (select *, row_number() over (partition by doc_id order by score desc, length(phrase) desc, phrase) as rank from r) select doc_id, rank::int as rank, phrase, score from k where rank <= 5""",
    "summarize": rf"""with p as (select doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'), '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g') t from documents),
      l as (select doc_id, list_filter(string_split(regexp_replace(t, '([.!?]) ([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: length(s) > 1) l from p),
      s as (select doc_id, unnest(l) s, generate_subscripts(l, 1) - 1 i from l),
      w as (select doc_id, i, unnest(list_filter({TERMS.format('s')}, lambda x: length(x) > 2 and x not in ({STOP}))) w from s),
      tf as (select doc_id, w, count(*) tf, max(count(*)) over (partition by doc_id) m from w group by 1, 2),
      g as (select doc_id, i, sum(tf / m) / sqrt(count(*)) g from w join tf using (doc_id, w) group by 1, 2),
      r as (select doc_id, i, s, round(coalesce(g, 0) + case when i = 0 then 0.25 when i < 3 then 0.1 else 0 end, 6) sc from s left join g using (doc_id, i)),
      k as (select *, row_number() over (partition by doc_id order by sc desc, i) k from r)
      select doc_id, string_agg(s, ' ' order by i) summary from k where k <= 3 group by 1""",
    "cite_keys": rf"""with b as (select p_partkey id, {KEY.format('p_type')} || lpad(p_size::varchar, 4, '0') ||
        coalesce(list_filter(string_split_regex(strip_accents(lower('The ' || p_name)), '[^a-z0-9]+'), lambda w: w <> '' and w not in ({KEYSTOP}))[1], '') base from part),
      n as (select *, row_number() over (partition by base order by id)::int n from b)
      select id, base || case when n = 1 then '' when n <= 27 then chr(95 + n) else chr(97 + ((n - 28) // 26)) || chr(97 + ((n - 28) % 26)) end cite_key from n""",
    "bib_match": f"""with {PART}, k as (select id, doi, t, y from e),
      f as (select e.id entry_id, max(s.id) source_id, 'doi' how, 1 rk from e join s on e.doi = s.doi group by 1
        union all select e.id, max(s.id), 'title-year', 2 from e join s on e.t = s.t and e.y = s.y group by 1
        union all select e.id, max(s.id), 'title', 3 from e join s on e.t = s.t group by 1 having count(*) = 1),
      o as (select * from f qualify row_number() over (partition by entry_id order by rk) = 1)
      select entry_id, source_id, how from o qualify row_number() over (partition by source_id order by entry_id) = 1""",
    "normalize_doi": rf"""select p_partkey, case when regexp_matches(d, '^10\.\d{{4,9}}/\S+$') then d end doi from (select p_partkey, {DOI.format("case p_partkey % 4 when 0 then 'https://doi.org/10.1000/AB' || p_partkey when 1 then 'doi: 10.55/' || p_name when 2 then '10.1234/x.' || p_partkey else 'none' end")} d from part)""",
    "title_year_key": f"select p_partkey id, {KEY.format(chr(39) + 'The ' + chr(39) + ' || p_name')} || '|' || p_size title_year from part",
    "find_identifiers": """select p_partkey, '10.' || (1000 + p_partkey) || '/ab.' || p_size doi, case when p_partkey < 9000 then (1000 + p_partkey) || '.' || (10000 + p_size) end arxiv,
      case when p_partkey < 9000 then (2000 + left((1000 + p_partkey)::varchar, 2)::int)::int end as year from part""",
    "concept_tokens": rf"""select -1 - page_id doc_id, array_to_string(list_transform({TERMS.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")}, lambda w: {SING}), ' ') concept from pages""",
}
