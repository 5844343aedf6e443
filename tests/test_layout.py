"""Reading order and lines on the literal pages."""

import random

import pytest

from loreweave.operators import layout

SCHEMA = "doc_id int, id int, x double, y double, w double, h double, size double, str string, angle double"
LEFT, RIGHT = 54, 315


def item(text, x, y, size=10.0, angle=0.0):
    return (text, float(x), float(y), len(text) * size * 0.5, float(size), float(size), angle)


def column(texts, x, y, lead=12):
    return [item(t, x, y + i * lead) for i, t in enumerate(texts)]


def read(spark, items, shuffle=False):
    rows = [(1, i, x, y, w, h, s, t, a) for i, (t, x, y, w, h, s, a) in enumerate(items)]
    if shuffle:
        random.Random(1).shuffle(rows)
    got = layout.page_lines(spark.createDataFrame(rows, SCHEMA)).orderBy("block", "line").collect()
    return [r.text for r in got]


def two_columns():
    return [
        item("Semantic Reading Order for Notebooks", 150, 60, 18), item("Ada Lovelace, Alan Turing", 240, 88, 11), item("1 Introduction", LEFT, 120, 12),
        *column(["Researchers read many papers and the act of", "excerpting a passage should preserve its infor-", "mation rather than flatten it into a picture.", "Local-first software keeps data on the device."], LEFT, 138),
        *column(["A second paragraph begins after a gap and", "continues on the next line of the column."], LEFT, 200), item("2 Method", RIGHT, 120, 12),
        *column(["We cluster items into columns by detecting a", "wide vertical gutter between the two columns", "and then read each column from top to bottom."], RIGHT, 138),
    ]


def test_two_columns_under_a_title(spark):
    got = read(spark, two_columns())
    assert got[:3] == ["Semantic Reading Order for Notebooks", "Ada Lovelace, Alan Turing", "1 Introduction"]
    assert got.index("continues on the next line of the column.") < got.index("2 Method") and got[-1].startswith("and then read each")
    assert read(spark, two_columns(), shuffle=True) == got and len(got) == 13


def test_a_figure_between_columns(spark):
    items = [
        *column(["Left top line one of the text body here", "Left top line two of the text body here"], LEFT, 100), *column(["Right top line one of the text body now", "Right top line two of the text body now"], RIGHT, 100),
        item("Figure 1: A caption that spans the entire width of the page body text", 60, 160), *column(["Left bottom line of the paper body text"], LEFT, 200), *column(["Right bottom line of the paper body text"], RIGHT, 200),
    ]
    assert [t.split(" ")[0] + t.split(" ")[1] for t in read(spark, items)] == ["Lefttop", "Lefttop", "Righttop", "Righttop", "Figure1:", "Leftbottom", "Rightbottom"]


def test_three_columns(spark):
    items = [i for c in range(3) for i in column([f"column {c} line {k} of text here" for k in range(5)], 50 + 180 * c, 100)]
    assert [t[:15] for t in read(spark, items, shuffle=True)] == [f"column {c} line {k}" for c in range(3) for k in range(5)]


def test_a_table_is_read_by_rows(spark):
    items = [item(t, x, y) for y, row in ((100, ("Model", "Score")), (112, ("GPT", "0.91")), (124, ("BERT", "0.88"))) for t, x in zip(row, (72, 260))]
    assert read(spark, items) == ["Model Score", "GPT 0.91", "BERT 0.88"]


def test_words_make_a_line_and_banners_go(spark):
    x, items = 72, []
    for w in ("The", "quick", "brown", "fox"):
        items.append(item(w, x, 100))
        x += len(w) * 5 + 2.5
    assert read(spark, [*items, item("arXiv:2101.00001v2 [cs.LG]", 20, 300, 20, angle=90.0), item("  ", 72, 120), item("twice", 72, 140), item("twice", 72.5, 140.2)]) == ["The quick brown fox", "twice"]


@pytest.mark.parametrize(
    "items,text",
    [
        ([item("Energy is E = mc", 72, 100), item("2", 152, 96, 7), item(" and water is H", 155.5, 100), item("2", 230.5, 104, 7), item("O.", 234, 100)], "Energy is E = mc² and water is H₂O."),
        ([item("See note", 72, 100), item("abc", 112, 96, 6)], "See note<sup>abc</sup>"),
    ],
)
def test_raised_and_lowered_text(spark, items, text):
    assert read(spark, items) == [text]


def test_order_of_items_and_odd_ones(spark):
    rows = [(1, 5, 300.0, 10.0, 40.0, 10.0, 10.0, "b words that are long", None), (1, 6, 10.0, 10.0, 40.0, 10.0, 10.0, "a words that are long", None), (2, 1, 0.0, 0.0, -1.0, 1.0, 1.0, "x", None), (2, 2, float("nan"), 0.0, 1.0, 1.0, 1.0, "x", None), (2, 3, 1.0, 1.0, 1.0, 1.0, 0.0, "x", None), (3, 1, 1.0, 1.0, 1.0, 1.0, 1.0, None, None)]
    got = sorted((r.doc_id, r.place, r.id) for r in layout.reading_order(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, 1, 6), (1, 2, 5), (2, 1, 3)]
    assert layout.page_text(spark.createDataFrame(rows, SCHEMA).where("doc_id = 1")).first().text == "a words that are long\n\nb words that are long"


def test_pages_come_whole_over_batches(spark):
    """Pages that begin in one batch and end in another, a page without a number; runs are dealt out once."""
    rows = [(d, 100 * i + (d or 0), 54.0, 100.0 + 12 * i, 200.0, 10.0, 10.0, f"run {i}") for i in range(7) for d in (None, *range(9))]
    items = spark.createDataFrame(rows, "doc_id long, id long, x double, y double, w double, h double, size double, str string")
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        got = layout.reading_order(items)
        assert got._jdf.queryExecution().sparkPlan().toString().count("RepartitionByExpression") + got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert sorted((r.doc_id or -1, r.place, r.id) for r in got.where("doc_id is null or doc_id > 0").collect()) == sorted((d or -1, i + 1, 100 * i + (d or 0)) for i in range(7) for d in (None, *range(1, 9)))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
