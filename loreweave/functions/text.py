"""Text functions of the vault as Spark SQL: folding, terms and index terms."""

from __future__ import annotations

import unicodedata

import regex

#: Words that the search index leaves out.
STOP_WORDS = (
    "a an and are as at be been but by can do does for from had has have he her his i if in into is it its "
    "me my no not of on or our she so such than that the their them then there these they this those to "
    "us was we were what when where which while who will with would you your"
).split()
WORD = r"[\p{L}\p{N}\p{M}]+"
#: Scripts without blanks between words.
DENSE = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
#: No character below is of those scripts; a range is told far faster than a script.
HIGH = r"[\x{2e80}-\x{10ffff}]"
MAX_TERM = 40
#: Letters that are folded to one letter: Latin, Greek, Cyrillic, and the wide forms of ASCII.
RANGES = ((0xC0, 0x250), (0x370, 0x500), (0x1E00, 0x2000), (0xFF10, 0xFF5B))


def _plain_letters() -> tuple[str, str]:
    """Small letters with marks or of other widths, and the letters they are made from, by their decompositions."""
    marked, plain = [], []
    for c in (chr(i) for a, b in RANGES for i in range(a, b)):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base != c and len(base) == 1 and c == c.lower() and base.isalnum():
            marked.append(c)
            plain.append(base)
    return "".join(marked), "".join(plain)


MARKED, PLAIN = _plain_letters()


def fold(text: str) -> str:
    """SQL for lower case without the marks of Latin letters."""
    return rf"regexp_replace(translate(lower({text}), '{MARKED}', '{PLAIN}'), r'\p{{M}}', '')"


def folded(value: str) -> str:
    """The same of a value at hand."""
    return "".join(c for c in unicodedata.normalize("NFD", value.lower().translate(str.maketrans(MARKED, PLAIN))) if not unicodedata.combining(c))


def spelt(term: str) -> str:
    """A pattern that finds a folded word in a text as it is written: letters with any marks, in any case."""
    marked = {p: "".join(m for m, q in zip(MARKED, PLAIN) if q == p) for p in set(PLAIN)}
    return "".join((f"[{c}{marked[c]}]" if c in marked else c if c.isalnum() else f"\\x{{{ord(c):x}}}") + r"\p{M}*+" for c in term)


def terms(text: str) -> str:
    """SQL for all folded words of a text, in order; a text of ASCII alone needs no folding and a plain pattern.

    Runs of scripts that put no blanks between words give their pairs of neighbours, a single character itself.
    """
    cut = rf"regexp_extract_all({fold(text)}, r'[{DENSE}]+|(?:(?![{DENSE}])[\p{{L}}\p{{N}}\p{{M}}])+', 0)"
    pairs = f"flatten(transform({cut}, t -> if(t rlike r'^[{DENSE}]{{2}}', transform(sequence(1, length(t) - 1), i -> substring(t, i, 2)), array(t))))"
    rest = f"if({text} rlike r'{HIGH}' and {text} rlike r'[{DENSE}]', {pairs}, regexp_extract_all({fold(text)}, r'{WORD}', 0))"
    return rf"if(octet_length({text}) = length({text}), regexp_extract_all(lower({text}), r'[a-z0-9]+', 0), {rest})"


def terms_of(value: str) -> list[str]:
    """The same of a value at hand."""
    dense = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]+|[^\p{Han}\p{Hiragana}\p{Katakana}]+")
    runs = [r for w in regex.findall(WORD, value) for r in dense.findall(w)]
    each = [[r[i : i + 2] for i in range(max(1, len(r) - 1))] if regex.match(r"[\p{Han}\p{Hiragana}\p{Katakana}]", r) else [folded(r)] for r in runs]
    return [t for ts in each for t in ts if t]


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" for v in values)


def index_terms(text: str) -> str:
    """SQL for the words worth indexing: no stop words, no single letters but of dense scripts, none over 40 characters."""
    return f"filter({terms(text)}, t -> (length(t) between 2 and {MAX_TERM} or t rlike r'^[{DENSE}]$') and t not in ({quoted(STOP_WORDS)}))"
