"""Disguised identifiers that hold plain ones, and disguises of several kinds at once."""

import pytest

from loreweave.llm import pii


@pytest.mark.parametrize(
    "found, kind",
    [
        ("jоhn@example.com", "email"), ("john@example.cоm", "email"), ("jo​hn@example.com", "email"), ("192.168.1.2５", "ip"), ("+1 202 555 010１", "phone"),
        ("john (at) example dot com", "email"), ("john at example (dot) com", "email"), ("john@example dot com", "email"), ("jоhn (at) mail dot example [dot] com", "email"),
        ("john dot smith at example (dot) com", "email"), ("192 (dot) 168 dot 1.20", "ip"), ("４ (dot) ３ dot 2 point １", "ip"), ("jоhn at example dot com", "email"),
    ],
)
def test_whole_span_is_found(found, kind):
    text = f"say, {found}, yes"
    assert (kind, 5, 5 + len(found)) in pii.find(text)[1]
    assert pii.redacted(text) == f"say, [{kind}], yes"


def test_prose_and_plain_identifiers_stay():
    for text in ("we met at example.com today", "look at this。Then go", "a (dot) here, at home.now", "naïve – twenty one, two dots"):
        assert pii.find(text) == ([], [])
    assert pii.find("é bob@x.org (at) home") [1] == []
    text = "４ bob@x.org, 10.0.0.1"
    assert pii.find(text)[1] == [] and pii.redacted(text) == "４ [email], [ip]"


def test_composed_offsets():
    text = "​а​ [at] ｂ (dot) c​om x"
    assert [text[s:e] for _, s, e in pii.find(text)[1]] == ["а​ [at] ｂ (dot) c​om"]
