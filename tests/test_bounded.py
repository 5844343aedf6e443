"""Queries whose shuffles grew with all pairs of words and documents: the same results with repeated ids, and what is dealt out."""

import pytest
from pyspark.sql import functions as F

from loreweave.functions import markup
from loreweave.operators import resolve, search
from loreweave.plans import notes_queries, record_queries

SF = "/root/testdata/sf0.001"

DOCS = "doc_id long, text string"
ROWS = [(1, "Alpha beta alpha beta. The gamma rays Alpha beta!"), (2, "Delta delta delta. No more"), (2, "Delta wave and delta wave. New"), (3, None), (None, "lost lost words")]


def exchanged(df):
    """The plan's exchanges, as text."""
    return [x for x in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning" in x]


def test_phrases_of_repeated_ids_count_together(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    got = {(r.doc_id, r.phrase): r.n for r in resolve.ngram_counts(docs).collect()}
    assert got[1, "alpha beta"] == 3 and got[2, "delta"] == 5 and got[2, "delta wave"] == 2 and got[None, "lost"] == 2
    assert (1, "beta the gamma") not in got and not any(p == "" for _, p in got)
    best = {(r.doc_id, r.phrase): (r["rank"], r.score) for r in resolve.keyphrases(docs).collect()}
    assert best[2, "delta"] == (1, 6.5) and {d for d, _ in best} == {1, 2}


def test_summary_takes_the_commonest_words(spark):
    docs = spark.createDataFrame([(1, "One two. Apple pie apple. Apple pie. Zebra."), (2, ""), (3, None)], DOCS)
    assert [tuple(r) for r in resolve.summarize(docs, 2).collect()] == [(1, "Apple pie apple. Apple pie.")]


@pytest.mark.parametrize("f", [resolve.ngram_counts, resolve.keyphrases, resolve.summarize])
def test_no_phrase_or_word_is_dealt_out(spark, f):
    df = f(spark.createDataFrame(ROWS, DOCS))
    assert all("doc_id" in x and "phrase" not in x for x in exchanged(df)) and "Window" not in df._jdf.queryExecution().executedPlan().toString()


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name,text,expected", [("Widget 3", "[[widget  3]] [[Widget 31]] `[[Widget 3]]`", "[[New]] [[Widget 31]] `[[Widget 3]]`"), ("ΟΔΟΣ", "[[οδος]] #ΟΔΟΣ'x", "[[New]] #New'x")])
def test_renaming_passes_texts_without_the_name_over(spark, name, text, expected):
    df = spark.createDataFrame([(text,), ("[[Other]]",)], "t string").select(F.expr(markup.renamed("t", name, "New")).alias("t"))
    assert [r.t for r in df.collect()] == [expected, "[[Other]]"]
    assert ("lower(" in plan(df) and "RLIKE" in plan(df)) if name.isascii() else True


def test_an_entry_of_a_feed_is_read_once(spark):
    df = record_queries.arxiv_atom(spark, SF)
    assert "xpath" not in plan(df) and df.where("p_partkey = 7 and authors like 'A %; B %' and arxiv = '7' and title like '% & co'").count() == 1


def test_a_cloze_is_read_once_for_all_its_sides(spark):
    df = notes_queries.render_cloze(spark, SF)
    assert plan(df).count("aggregate(regexp_extract_all") == 1


def test_blocks_of_a_page_are_dealt_out_once(spark):
    for f in (notes_queries.sink_latex, notes_queries.sink_markdown):
        assert not any("created_at" in x.split("hashpartitioning")[1] for x in exchanged(f(spark, SF)))


def test_search_over_repeated_documents(spark):
    """Equal rows of a document count together, as in its postings; no posting of another word is made."""
    docs = spark.createDataFrame([(1, "graph theory", 1.0), (1, "graph graph", 1.0), (2, "theory of graphs", 1.0), (None, "graph", 2.0), (3, None, 1.0)], "doc_id long, text string, boost double")
    asked = ["graph theo", "theory"]
    key = lambda df: sorted(map(str, df.collect()))
    assert key(search.bm25_search(docs, asked)) == key(search.search_index(search.postings(docs), search.corpus_stats(docs), asked))
    assert "term IN" in plan(search.bm25_search(docs, asked)) or "INSET" in plan(search.bm25_search(docs, asked)) or " IN (" in plan(search.bm25_search(docs, asked))


def test_postings_of_rows(spark):
    docs = spark.createDataFrame([(1, "graph theory graph", 1.0), (2, "", 1.0), (3, None, 2.0)], "doc_id long, text string, boost double")
    got = search.row_postings(search.indexed(docs))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, search.postings(docs).select(*got.columns).collect())) and not exchanged(got)
