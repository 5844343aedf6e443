"""Clozes: braces of any depth, mathematics, sides, heuristics, and the cards of blocks."""

import random
import re

import pytest
from pyspark.sql import functions as F

from loreweave.functions import cloze
from loreweave.operators import notes


def sql(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(F.expr(expr)).first()[0]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("The {{c1::mitochondria}} is the {{c2::powerhouse::metaphor}} of the {{c1::cell}}", [(1, "mitochondria", None), (2, "powerhouse", "metaphor"), (1, "cell", None)]),
        (r"Root: {{c1::$\sqrt{\frac{a}{b}}$}} done", [(1, r"$\sqrt{\frac{a}{b}}$", None)]),
        ("{{c1::$a::b$}}", [(1, "$a::b$", None)]),
        ("{{c1::a {{b}} c}} x", [(1, "a {{b}} c", None)]),
        ("{{c12::" + "{" * 30 + "x" + "}" * 30 + "::h}}", [(12, "{" * 30 + "x" + "}" * 30, "h")]),
        (r"{{c1::a \} b}} {{c2::a\::b}}", [(1, r"a \} b", None), (2, r"a\::b", None)]),
        ("{{c1::a}b}} and {{c2::never closed {{c3::x}}", [(1, "a}b", None)]),
        ("{{c1::a $5 b}} {{c2::c::  }}", [(1, "a $5 b", None), (2, "c", None)]),
        (r"\{{c1::x}} $ {{c2::y::{z::}::h}}", [(1, "x", None), (2, "y", "{z::}::h")]),
        ("no cloze {{x}} }} ::", []), ("", []),
    ],
)
def test_parse(spark, text, expected):
    found = sql(spark, text, cloze.segments("t"))
    assert [(s.number, s.answer, s.hint) for s in found if s.number] == expected
    assert "".join(s.raw for s in found) == text


def test_sides_and_splits(spark):
    t = "The {{c1::mitochondria}} is the {{c2::powerhouse::metaphor}}"
    assert sql(spark, t, cloze.side("t", "1", cloze.HIDDEN)) == 'The <span class="cloze cloze-hidden">[...]</span> is the powerhouse'
    assert sql(spark, t, cloze.side("t", "2", cloze.HIDDEN)) == 'The mitochondria is the <span class="cloze cloze-hidden">[metaphor]</span>'
    assert sql(spark, t, cloze.side("t", "1", cloze.REVEALED)) == 'The <mark class="cloze cloze-revealed">mitochondria</mark> is the powerhouse'
    assert sql(spark, "{{c3::a}} {{c1::b::h}} {{c3::c}}", cloze.numbers("t")) == [1, 3]
    assert sql(spark, "{{c1::a}} and {{c2::b::h}}", cloze.split("t")) == ["{{c1::a}} and b", "a and {{c1::b::h}}"]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("The **Carnot cycle** is the most efficient heat engine cycle.", "The **{{c1::Carnot cycle}}** is the most efficient heat engine cycle."),
        ("Entropy is a measure of disorder in a system.", "{{c1::Entropy}} is a measure of disorder in a system."),
        ("See [[Boltzmann constant]]: $k_B = 1.380649 \\times 10^{-23}$ J/K, measured in 2019 with 99% accuracy.",
         "See {{c1::Boltzmann constant}}: {{c2::$k_B = 1.380649 \\times 10^{-23}$}} J/K, measured in {{c3::2019}} with 99% accuracy."),
        ("It is fine.", None), ("1. use `x = 42` here", None), ("remember this", None), ("", None), (None, None),
        ("It is the ratio between heat flow and temperature.", "It is {{c1::the ratio between heat flow and temperature}}."),
        ("The **Krebs cycle** produces 2 ATP and happens in the [[mitochondria|cell]].", "The **{{c1::Krebs cycle}}** produces 2 {{c3::ATP}} and happens in the {{c2::cell}}."),
        ("12. in 1,250 cases, 3.5 % of 7 and 1,250", "12. in {{c1::1,250}} cases, {{c2::3.5 %}} of 7 and 1,250"),
        ("Seen by Marie Curie. Then by The Noble Committee and Bob", "Seen by {{c1::Marie Curie}}. Then by The {{c2::Noble Committee}} and {{c3::Bob}}"),
    ],
)
def test_heuristics(spark, text, expected):
    df = spark.createDataFrame([(text, "kept")], "t string, lw_code string")
    out = cloze.with_heuristic_clozes(df.drop("lw_code"), "t", "out")
    assert out.columns == ["t", "out"] and out.first().out == expected


def test_cards_of_blocks(spark):
    rows = [
        ("a", "text", "{{c1::Heat}} flows from {{c2::hot}} to cold {{c1::bodies}} #flashcard"), ("b", "text", "What is the first law? :: Energy is conserved #flashcard"),
        ("c", "math", "dS = x"), ("d", "text", "remember this #flashcard"), ("e", "text", "Why so?\nBecause. #flashcard"), ("f", "text", "#flashcard"), ("g", "ink", None), ("h", "text", "Entropy is a measure of disorder. #flashcard"),
    ]
    df = spark.createDataFrame([(*r, " Thermo ", "Clausius:" if r[0] == "c" else None) for r in rows], "id string, type string, text string, title string, context string")
    made = {r.card_id: (r.kind, r.front, r.back) for r in notes.block_cards(df).collect()}
    heat = "{{c1::Heat}} flows from {{c2::hot}} to cold {{c1::bodies}}"
    assert made == {
        "a:1": ("cloze", heat, None), "a:2": ("cloze", heat, None), "b:0": ("basic", "What is the first law?", "Energy is conserved"), "c:0": ("basic", "Recall: **Thermo**\n\nClausius:", "$$\ndS = x\n$$"),
        "d:0": ("basic", "Recall: **Thermo**", "remember this"), "e:0": ("basic", "Why so?", "Because."), "g:0": ("basic", "Recall: **Thermo**", ""),
        "h:1": ("cloze", "{{c1::Entropy}} is a measure of disorder.", None),
    }


def test_cards_of_blocks_are_not_filtered_by_guesses(spark):
    """An empty text gives no card, and no filter makes the guesses a second time."""
    asked = spark.createDataFrame([("a", "text", "#flashcard"), ("b", "math", "#flashcard"), ("c", "text", "Tea is warm. #flashcard")], "id string, type string, text string").selectExpr("*", "'T' as title", "cast(null as string) as context")
    made = notes.block_cards(asked)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Filter" in line and "lambda" in line for line in plan.splitlines())
    assert {r.id for r in made.collect()} == {"b", "c"}


def test_spans_equal_plain_matches_whatever_the_text_holds(spark):
    """Places of all matches as Python finds them, also in a text that holds the character which cuts are made at; patterns cut no text without their sign (F25)."""
    r = random.Random(25)
    texts = ["", "a", "1", cloze.EDGE, f"1{cloze.EDGE}2"] + ["".join(r.choices([cloze.EDGE, "1", "20", "3,000", " ", "x", "é", "𝔸", "$0", "\\", "**"], k=12)) for _ in range(60)]
    pattern = r"(?<![\w.,$\\])(?:\d{1,3}(?:,\d{3})+|\d+)(?!\w)"
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for sql in (cloze.spans("t", pattern), cloze.signed_spans("t", "t rlike '[0-9]'", pattern)):
        for row in df.selectExpr("t", f"{sql} as s").collect():
            assert [tuple(x) for x in row.s] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, row.t, re.ASCII)], row.t
    assert [x.s for x in df.selectExpr(f"{cloze.signed_spans('t', 'false', pattern)} as s").collect()] == [[]] * len(texts)
