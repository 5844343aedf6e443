"""Literal cases of notes: lenses, backlinks, cards, queues, BibTeX and budgets."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loreweave.operators import notes, records

BLOCKS = "page_id long, id string, ord int, type string, text string, anchor_source_id string, created_at date"
PAGES = "page_id long, title string, kind string, updated_at long, aliases array<string>, source_id string"
DAY = dt.date(2024, 5, 1)


@pytest.fixture(scope="module")
def vault(spark):
    rows = [
        (1, "a0", 0, "text", "RL intro #[[Reinforcement Learning]]", None), (1, "a1", 1, "text", "value function basics", None), (1, "a2", 2, "math", r"V(s) = \max_a Q(s,a)", None),
        (2, "b0", 0, "text", "Paper A claim", "src-a"), (2, "b1", 1, "text", "Paper B claim #draft", "src-b"), (2, "b2", 2, "text", "Paper C claim", "src-c"),
        (2, "b3", 3, "text", "links [[reinforcement learning]] #flashcard", None),
    ]
    blocks = spark.createDataFrame([(*r, DAY) for r in rows], BLOCKS)
    pages = spark.createDataFrame([(1, "Old page", "note", 1000, [], None), (2, "Recent page", "note", 2000, [], None)], PAGES)
    sources = spark.createDataFrame([("src-a", "Paper A", "a.pdf", "smith2024"), ("src-b", "Paper B", "b.pdf", None), ("src-c", "Paper C", None, None)], "id string, title string, file_name string, bib_key string")
    return blocks, notes.references(blocks), pages, notes.names(pages), sources


@pytest.mark.parametrize(
    "query,expected",
    [
        ('[[Reinforcement Learning]] OR source:"Paper A" OR source:"Paper B"', {"a0", "b0", "b1", "b3"}),
        ("value func", {"a1"}), ('"function basics"', {"a1"}), ('"basics function"', set()), ('tag:"reinforcement learning"', {"a0"}), ("type:math", {"a2"}), ("is:flashcard", {"b3"}),
        ("has:anchor -tag:draft", {"b0", "b2"}), ("source:smith2024", {"b0"}), ("source:src-c", {"b2"}), ('page:"old page" -type:math', {"a0", "a1"}),
        ('claim (-source:"Paper A" -source:"Paper B")', {"b2"}), ("before:2000-01-01", set()), ("after:2000-01-01", {"a0", "a1", "a2", "b0", "b1", "b2", "b3"}), ("", set()), ("-", set()), ("(value OR", {"a1"}),
    ],
)
def test_lens(vault, query, expected):
    assert {r.id for r in notes.lens(query, *vault).collect()} == expected


def test_grouped_results_come_by_newest_page(vault):
    blocks, _, pages, _, _ = vault
    assert {(r.page_id, r.blocks) for r in notes.grouped_results(blocks, pages, cap=5).collect()} == {(2, "b0,b1,b2,b3"), (1, "a0")}


def test_backlinks_by_alias_and_embed_but_not_from_the_page(spark):
    rows = [(1, "c", 0, "Self ref [[Reinforcement Learning]]"), (2, "p0", 0, "We use [[reinforcement  learning]] here"), (2, "p1", 1, "unrelated"), (2, "p2", 2, "Also #RL"), (2, "p3", 3, "and #[[Reinforcement Learning]]"), (3, "o0", 0, "plain RL"), (3, "o1", 1, "![[Reinforcement Learning]]"), (3, "o2", 2, "`[[RL]]` $#RL$ https://x.y/#RL #12 #ffff1f")]
    blocks = spark.createDataFrame([(p, i, o, "text", t, None, DAY) for p, i, o, t in rows], BLOCKS)
    pages = spark.createDataFrame([(1, "Reinforcement Learning", "concept", 1, ["RL"], None), (2, "Paper notes", "note", 2, [], None), (3, "Other", "note", 3, [], None)], PAGES)
    refs, named = notes.references(blocks), notes.names(pages)
    linked = notes.backlinks(refs, named)
    assert {(r.target, r.id) for r in linked.collect()} == {(1, "p0"), (1, "p2"), (1, "p3"), (1, "o1")}
    assert {(r.target, r.id) for r in notes.mentions(blocks, named, linked).collect()} == {(1, "o0")}
    assert {(r.concept, r.blocks) for r in notes.concepts(refs, pages, named).collect()} == {("reinforcement learning", 4)}


def test_mentions_of_long_titles_and_marks(spark):
    blocks = spark.createDataFrame([(2, "x", 0, "text", "see a very long title of seven words, and C++ too", None, DAY)], BLOCKS)
    pages = spark.createDataFrame([(1, "A very long title of seven words", "note", 1, [], None), (3, "title of six", "note", 1, [], None)], PAGES)
    named = notes.names(pages)
    none = notes.backlinks(notes.references(blocks), named)
    assert [r.target for r in notes.mentions(blocks, named, none).collect()] == [1]


def test_clozes_give_a_card_each_and_no_question_gives_a_recall(spark):
    rows = [("c", "{{c1::Paris}} is in {{c2::France::where}} #flashcard"), ("q", "Why:: because #flashcard"), ("b", "It is **bold** here #flashcard"), ("r", "one two three four #flashcard"), ("n", "nothing asked")]
    blocks = spark.createDataFrame([(1, i, k, "text", t, None, DAY) for k, (i, t) in enumerate(rows)], BLOCKS)
    made = {r.card_id: (r.kind, r.front, r.back) for r in notes.generate_cards(blocks).collect()}
    assert made == {
        "c:1": ("cloze", "[...] is in France", "Paris is in France"), "c:2": ("cloze", "Paris is in [...]", "Paris is in France"), "q:0": ("qa", "Why", "because"),
        "b:0": ("bold", "It is [...] here", "It is **bold** here"), "r:0": ("recall", "one two three …", "one two three four"),
    }


def test_study_queue(spark):
    at = lambda h, d=10: dt.datetime(2026, 3, d, h)
    soon = dt.datetime(2026, 3, 10, 12, 10)
    rows = [
        ("l1", "learning", at(11), at(1), False), ("l2", "learning", soon, at(1), False), ("l3", "learning", at(14), at(1), False), ("r1", "review", at(5), at(1), False), ("r2", "review", at(3, 9), at(1), False),
        ("r3", "review", at(3, 11), at(1), False), ("r4", "review", at(4, 11), at(1), False), ("n1", "new", at(1), at(5), False), ("n2", "new", at(1), at(4), False), ("n3", "new", at(1), at(6), False), ("s", "review", at(1), at(1), True),
    ]
    cards = spark.createDataFrame(rows, "id string, state string, due timestamp, created_at timestamp, suspended boolean")
    out = notes.study_queue(cards, 18, "2026-03-10 12:00:00").orderBy("bucket", "place").collect()
    assert [r.id for r in out] == ["l1", "r2", "r1", "r3", "n2", "n1", "l2"]


def test_bibtex_with_strings_joins_and_broken_entries():
    text = """@string{jan = "January"} @comment{x} @article{key1, title = {A {B} c}, month = jan # " 1", year = 2001, }
      @broken{ @book{k2, author = "Knuth, Donald and Lovelace, Ada", title = "T" }"""
    assert records.bibtex_entries(text) == [("article", "key1", {"title": "A {B} c", "month": "January 1", "year": "2001"}), ("book", "k2", {"author": "Knuth, Donald and Lovelace, Ada", "title": "T"})]


def test_budget_passes_over_what_does_not_fit(spark):
    files = spark.createDataFrame([(1, k, p, s) for k, (p, s) in enumerate([("a", 60), ("b", 50), ("c", 30), ("d", 10), ("e", 1)])], "repo int, ord int, path string, size long")
    assert {r.path for r in records.budgeted(files, 100).collect()} == {"a", "c", "d"}


def test_merged_concepts_and_renamed_pages(spark):
    blocks = spark.createDataFrame([(1, "x", 0, "text", "[[Old name|x]] #[[old  name]] [[Older name]] #other", None, DAY), (3, "y", 0, "text", "own", None, DAY)], BLOCKS)
    pages = spark.createDataFrame([(2, "New", "concept", 1, ["n"], None), (3, "Old name", "concept", 1, ["o"], None)], PAGES)
    after, changed = notes.merge_concepts(pages, blocks, "Old name", "New")
    assert {(r.page_id, tuple(r.aliases), r.trashed) for r in after.collect()} == {(2, ("n", "Old name", "o"), False), (3, ("o",), True)}
    assert {(r.page_id, r.id, r.text) for r in changed.collect()} == {(1, "x", "[[New|x]] #[[New]] [[Older name]] #other"), (2, "y", "own")}


def test_near_boxes_equal_all_pairs(spark):
    import random

    r = random.Random(2)
    rows = [(k % 3, k, r.uniform(-50, 300), r.uniform(-50, 300), r.uniform(1, 40), r.uniform(1, 40)) for k in range(120)]
    out = {(x.a, x.b) for x in records.near_boxes(spark.createDataFrame(rows, "group int, id int, x double, y double, w double, h double"), 12.0).collect()}
    far = lambda p, s, q, t: max(0, p - q - t, q - p - s)
    assert out == {(a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1] and far(a[2], a[4], b[2], b[4]) <= 12 and far(a[3], a[5], b[3], b[5]) <= 12}


def test_names_count_as_they_are_written(spark):
    texts = ["vitamin c is good", "the A-B test", "state of the art", "C++ it is", "not C++x nor xC++", "`C++` [[C++]] #c", "a  b and A-B-C", "O'Brien said US$ 5"]
    blocks = spark.createDataFrame([(9, f"b{i}", i, "text", t, None, DAY) for i, t in enumerate(texts)] + [(9, "n", 99, "text", None, None, DAY)], BLOCKS)
    titles = ["C++", "A-B", "state-of-the-art", "O'Brien", "US$ 5", "A b"]
    pages = spark.createDataFrame([(i, t, "note", 1, [], None) for i, t in enumerate(titles)], PAGES)
    none = blocks.selectExpr("page_id as target", "page_id", "id", "ord").limit(0)
    found = {(titles[r.target], r.id) for r in notes.mentions(blocks, notes.names(pages), none).collect()}
    assert found == {("A-B", "b1"), ("C++", "b3"), ("A b", "b6"), ("A-B", "b6"), ("O'Brien", "b7"), ("US$ 5", "b7")}
    assert notes.mentions(blocks, notes.names(pages.limit(0)), none).count() == 0


def test_mentions_without_a_list_of_first_words(spark, monkeypatch):
    monkeypatch.setattr(notes, "FIRST_WORDS", 1)
    blocks = spark.createDataFrame([(9, "x", 0, "text", "a one two and Three four", None, DAY)], BLOCKS)
    pages = spark.createDataFrame([(i, t, "note", 1, [], None) for i, t in enumerate(["one two", "three Four", "two three"])], PAGES)
    none = blocks.selectExpr("page_id as target", "page_id", "id", "ord").limit(0)
    assert {r.target for r in notes.mentions(blocks, notes.names(pages), none).collect()} == {0, 1}


def test_lens_over_nulls_accents_and_marks(spark):
    rows = [("a", "text", "Café au lait", None, DAY), ("b", None, None, None, None), ("c", "math", "cafe C++ it's", "src-a", dt.date(2020, 1, 1))]
    blocks = spark.createDataFrame([(1, i, k, t, x, s, d) for k, (i, t, x, s, d) in enumerate(rows)], BLOCKS)
    pages = spark.createDataFrame([(1, "P's \\ \"page\"", "note", 1, [], None)], PAGES)
    sources = spark.createDataFrame([("src-a", "It's 100% \\d", None, None)], "id string, title string, file_name string, bib_key string")
    find = lambda q: {r.id for r in notes.lens(q, blocks, notes.references(blocks), pages, notes.names(pages), sources).collect()}
    for query, expected in (
        ("café", "ac"), ("CAFE", "ac"), ('"café AU"', "a"), ("-type:math", "ab"), ("-cafe", "b"), ("-is:flashcard", "abc"), ("-before:2021-01-01", "ab"), ("before:2021-01-01", "c"), ("after:2020-01-01", "ac"),
        ("before:abc", ""), ("type:nonsense", ""), ("is:x cafe", "ac"), ("has:anchor", "c"), ("-has:anchor", "ab"), ("source:\"it's 100% \\d\"", "c"), ("src:src-a OR type:text", "ac"), ("(-(cafe))", "b"), ("--cafe", "b"), ("c++", "ac"),
        ("foo:bar", ""), ("it's", "c"),
    ):
        assert "".join(sorted(find(query))) == expected, query


def test_what_is_wrong_with_a_lens():
    wrong = lambda q: notes.parse_lens(q)[1]
    assert wrong('(#rl OR #[[deep rl]]) "value function" after:2026-01-01 -(is:flashcard has:anchor)') == []
    assert notes.parse_lens('[[RL]] OR source:"Paper A" -tag:draft type:Math')[0] == ("or", ("term", "ref", "RL"), ("and", ("term", "source", "Paper A"), ("not", ("term", "tag", "draft")), ("term", "type", "math")))
    assert notes.parse_lens("foo:bar") == (("term", "word", "foo:bar"), ['Unknown filter "foo:" (searching it as text)'])
    assert notes.parse_lens("") == (None, [])
    for query, error in (
        ("type:foo", "Unknown block type"), ("before:yesterday", "Invalid date"), ("after:2026-02-30", "Invalid date"), ("(a", 'Missing ")"'), ("a)", 'Unmatched ")"'), ("tag:", "Missing value"), ('"open', "Unclosed quote"),
        ("[[open", "Unclosed [["), ("a OR", "OR without"), ("is:x", "Unknown filter is:x"), ("((a)", 'Missing ")"'),
    ):
        assert any(e.startswith(error) for e in wrong(query)), query
    assert notes.parse_lens("a-b -c - d") == (("and", ("term", "word", "a-b"), ("not", ("term", "word", "c")), ("term", "word", "-"), ("term", "word", "d")), [])


def test_snippets_over_many_words(spark):
    show = lambda text, words, **kw: spark.createDataFrame([(text,)], "t string").select(F.expr(notes.snippet("t", words, **kw)).alias("s")).first().s
    got = show("Über café, cafés and C++ here", ["uber", "cafe"])
    assert got.snippet == "Über café, cafés and C++ here" and got.highlights == [[0, 4], [5, 9], [11, 16]]
    assert show("Über café, cafés", ["cafe"], whole=True).highlights == [[5, 9]]
    long = "word " * 40 + "needle " + "tail " * 60
    got = show(long, ["needle"])
    assert got.snippet.startswith("…") and got.snippet.endswith("…") and [got.snippet[a:b] for a, b in got.highlights] == ["needle"] and len(got.snippet) <= 182
    assert not got.snippet.strip("…").startswith(" ") and got.snippet.strip("…").split() == [w for w in got.snippet.strip("…").split() if w in ("word", "needle", "tail")]
    assert show("nothing (here", ["c++", "x.*"]).highlights == [] and show("", []).snippet == ""
    assert show("e\u0301cole", ["ecole"]).highlights == [[0, 6]]


def test_renaming_with_marks_in_names(spark):
    blocks = spark.createDataFrame([(1, "x", 0, "text", "[[O'Brien]] #[[us$ 5]] `[[O'Brien]]` O'Brien", None, DAY)], BLOCKS)
    pages = spark.createDataFrame([(2, "O'Brien", "note", 1, [], None), (3, "US$ 5", "concept", 1, [], None), (4, "x\\\\1", "concept", 1, [], None)], PAGES)
    after, changed = notes.rename_page(pages, blocks, "o'brien", "A $1 \\\\ b")
    assert changed.first().text == "[[A $1 \\\\ b]] #[[us$ 5]] `[[O'Brien]]` O'Brien" and {r.title for r in after.collect()} == {"A $1 \\\\ b", "US$ 5", "x\\\\1"}
    after, changed = notes.merge_concepts(pages, blocks, "US$ 5", "x\\\\1")
    assert changed.first().text.startswith("[[O'Brien]] #[[x\\\\1]]") and {r.page_id for r in after.where("trashed").collect()} == {3}
    tags = spark.createDataFrame([(["It's", "b"],)], "t array<string>").select(F.expr(notes.retagged("t", "it's", "B"))).first()[0]
    assert tags == ["B"]
    linked = blocks.select(F.expr(notes.link_mention("text", "o'brien"))).first()[0]
    assert linked == "[[O'Brien]] #[[us$ 5]] `[[O'Brien]]` [[O'Brien]]"


def test_versions_of_a_card_are_one_card(spark):
    """In whatever order they come, the same versions on both sides are kept."""
    stored = spark.createDataFrame([("a", "x", "1"), ("a", "y", "2"), ("b", "x", "1"), ("g", "x", "1"), ("n", None, "1")], "card_id string, front string, back string")
    wanted = spark.createDataFrame([("a", "y", "2"), ("a", "x", "1"), ("b", "w", "1"), ("b", "x", "1"), ("m", "x", "1"), ("n", None, "1")], "card_id string, front string, back string")
    assert sorted(tuple(r) for r in notes.sync_cards(stored, wanted).collect()) == [("a", "kept"), ("b", "changed"), ("g", "gone"), ("m", "new"), ("n", "kept")]


def test_links_without_fragment_do_not_meet_in_one_task(spark):
    """Targets and fragments of links; the many that have neither share no partition of the join with the blocks (F24)."""
    refs = [(1, f"b{i}-1", i, "link", f"Ghost {i % 3}", None, f"ghost {i % 3}") for i in range(400)]
    refs += [(1, "b9-2", 1, "embed", "W", "b9", "w"), (1, "b9-2", 2, "embed", "W", "b8", "w"), (1, "b9-3", 3, "link", "W", None, "w"), (1, "b9-4", 4, "tag", "W", None, "w")]
    refs = spark.createDataFrame(refs, "page_id long, id string, ord long, kind string, name string, block string, norm string")
    named = spark.createDataFrame([("w", 7)], "norm string, target long")
    blocks = spark.createDataFrame([(7, "b9-1"), (7, "b9-5"), (6, "b8-1")], "page_id long, id string")
    got = notes.link_targets(refs.unionByName(refs), named, blocks)
    assert sorted(tuple(r)[1:] for r in got.collect() if r.page) == [(1, "w", 7, True), (2, "w", 7, False), (3, "w", 7, False)] and got.where("page is null and not block_found").count() == 400
    spread = notes.fragments_dealt(refs.select("id", "ord", "block", F.lit(None).cast("long").alias("page"))).repartition(8, "page", "block", "dealt")
    assert spread.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 150
