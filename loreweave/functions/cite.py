"""Identifiers and keys of bibliographic records as Spark SQL."""

from __future__ import annotations

from .text import MARKED, PLAIN, quoted

#: Words that a cite key passes over.
KEY_STOP_WORDS = (
    "a an the on of in for and or to with at by from towards toward is are was were be via using into over about as "
    "its it this that these those how what why when which who do does can we our your their not no vs versus "
    "der die das des dem den ein eine und von zu le la les l un une du de et el los las y del il lo gli"
).split()


def ascii_fold(s: str) -> str:
    return f"translate(lower({s}), '{MARKED}', '{PLAIN}')"


def normalize_doi(s: str) -> str:
    """SQL for a DOI without its address, in lower case; null if it is none."""
    bare = rf"lower(regexp_replace(trim({s}), r'(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)', ''))"
    return rf"case when {bare} rlike r'^10\.\d{{4,9}}/\S+$' then {bare} end"


def find_doi(s: str) -> str:
    """SQL for the first DOI in a text, without the punctuation after it."""
    return rf"nullif(regexp_replace(lower(regexp_extract({s}, r'(?i)\b(10\.\d{{4,9}}/[^\s<>]+)', 1)), r'[.,;:)\]]+$', ''), '')"


def find_arxiv(s: str) -> str:
    return rf"nullif(regexp_extract({s}, r'(?i)arxiv[:\s]*(\d{{4}}\.\d{{4,5}})', 1), '')"


def arxiv_year(s: str) -> str:
    return f"2000 + cast(substr({s}, 1, 2) as int)"


def title_key(s: str) -> str:
    """SQL for the letters and digits of a title; null if there are fewer than four."""
    k = rf"regexp_replace({ascii_fold(s)}, '[^a-z0-9]', '')"
    return f"case when length({k}) >= 4 then {k} end"


def title_word(s: str) -> str:
    """SQL for the first word of a title that says something."""
    words = f"split({ascii_fold(s)}, '[^a-z0-9]+')"
    return f"coalesce(get(filter({words}, w -> w <> '' and w not in ({quoted(KEY_STOP_WORDS)}) and (length(w) > 1 or w rlike '[0-9]')), 0), '')"


def base_key(last: str, year: str, title: str) -> str:
    """SQL for a cite key before it is made unique: last name, year and word, or what there is of them."""
    name, y, w = rf"regexp_replace({ascii_fold(f'coalesce({last}, {chr(39)*2})')}, '[^a-z0-9]', '')", f"coalesce(lpad(cast({year} as string), 4, '0'), '')", title_word(title)
    return f"case when {name} <> '' then concat({name}, {y}, {w}) when {w} <> '' then concat({w}, {y}) else concat('ref', {y}) end"
