"""Words of texts: folding, dense scripts, and the same for values at hand."""

import pytest
from pyspark.sql import functions as F

from loreweave.functions import text as tx
from loreweave.operators import search


@pytest.mark.parametrize(
    "value,expected",
    [
        ("Schrödinger's Équation \\frac{a}", ["schrodinger", "s", "equation", "frac", "a"]),
        ("東京都 is tall", ["東京", "京都", "is", "tall"]),
        ("a東b 漢", ["a", "東", "b", "漢"]),
        ("Ａｂ１ Ελλάδα Йод école", ["ab1", "ελλαδα", "иод", "ecole"]),
        ("日本語テキスト", ["日本", "本語", "語テ", "テキ", "キス", "スト"]),
        ("plain ASCII 42", ["plain", "ascii", "42"]),
        ("", []),
    ],
)
def test_terms(spark, value, expected):
    got = spark.createDataFrame([(value,)], "t string").select(F.expr(tx.terms("t"))).first()[0]
    assert got == expected == tx.terms_of(value)


def test_index_terms_keep_single_dense_characters(spark):
    got = spark.createDataFrame([("The 漢 x of " + "y" * 41,)], "t string").select(F.expr(tx.index_terms("t"))).first()[0]
    assert got == ["漢"]


def test_search_in_dense_scripts(spark):
    docs = spark.createDataFrame([(1, "東京都の天気", 1.0), (2, "京都の歴史", 1.0), (3, "weather", 1.0)], "doc_id long, text string, boost double")
    assert [r.doc_id for r in search.bm25_search(docs, ["東京"]).collect()] == [1]
    assert {r.doc_id for r in search.match_all(docs, ["京都"]).collect()} == {1, 2}
