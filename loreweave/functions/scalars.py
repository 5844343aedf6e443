"""Scalar rules of the vault as Spark SQL: file names, dates, intervals, titles, names, joined lines, hashes and JSON in prose."""

from __future__ import annotations


def title_from_file(name: str) -> str:
    return rf"coalesce(nullif(trim(regexp_replace(regexp_replace(regexp_replace({name}, r'(?i)\.[a-z0-9]+$', ''), '_+', ' '), r'\s+', ' ')), ''), 'Untitled')"


def format_interval(ms: str) -> str:
    """SQL for milliseconds as minutes, hours, days, months or years, one decimal for the last two."""
    short = "regexp_replace(cast(cast(round({0}, 1) as decimal(12, 1)) as string), r'\\.0$', '')"
    return (
        f"case when {ms} < 3600000 then cast(greatest(1, round({ms} / 60000D)) as int) || 'm' when {ms} < 86400000 then cast(round({ms} / 3600000D) as int) || 'h' "
        f"when {ms} < 2592000000 then cast(round({ms} / 86400000D) as int) || 'd' when {ms} < 31536000000 then {short.format(f'{ms} / 86400000D / 30.4375D')} || 'mo' "
        f"else {short.format(f'{ms} / 86400000D / 365.25D')} || 'y' end"
    )


def pdf_date(text: str) -> str:
    """SQL for the day of a date as PDF files write it: D:YYYYMMDD..., month and day may be missing."""
    part = lambda g: rf"regexp_extract({text}, r'^(?:D:)?(\d{{4}})(\d{{2}})?(\d{{2}})?', {g})"
    return f"try_to_date({part(1)} || '-' || coalesce(nullif({part(2)}, ''), '01') || '-' || coalesce(nullif({part(3)}, ''), '01'), 'yyyy-MM-dd')"


#: Words that name a program, a file's ending, or nothing; each list is one kind of title that tells nothing.
PROGRAMS = "word powerpoint excel".split()
ENDINGS = "doc docx tex dvi pdf indd ppt pptx key rtf odt qxd ps eps txt md htm html".split()
PLACEHOLDERS = "title paper draft main manuscript article pdf none null unknown untitled".split() + ["no title"]


def title_faults(title: str, file_name: str) -> dict[str, str]:
    """What may be wrong with a title, by name: SQL conditions of a title and the name of its file."""
    t, any_of = f"trim({title})", "|".join
    bare = f"lower(trim(regexp_replace({file_name}, r'\\.[^.]+$', '')))".replace("\\\\", "\\")
    return {
        "none": f"{title} is null or length({t}) < 3",
        "no letters": rf"not {t} rlike r'\p{{L}}'",
        "made by a program": rf"{t} rlike r'(?i)^(?:microsoft\s+(?:{any_of(PROGRAMS)})|word|powerpoint)\s*-'",
        "a file's name": rf"{t} rlike r'(?i)\.(?:{any_of(ENDINGS)})$' or {t} rlike r'^[\w-]+$' and {t} rlike r'_|\d{{3,}}' or lower({t}) = {bare}",
        "a placeholder": rf"{t} rlike r'(?i)^(?:{any_of(PLACEHOLDERS)})$' or {t} rlike r'(?i)^(?:document|presentation)\d*$' or {t} rlike r'(?i)^(?:slide|layout|paper)\s*\d*$' or {t} rlike r'(?i)^untitled\b'",
        "an identifier": rf"{t} rlike r'(?i)^(?:doi|arxiv)[:\s]'",
    }


def title_fault(title: str, file_name: str) -> str:
    """SQL for the first thing that is wrong with a title, null for one that tells something."""
    return "case " + " ".join(f"when {c} then {n!r}" if "'" not in n else f'when {c} then "{n}"' for n, c in title_faults(title, file_name).items()) + " end"


def is_garbage_title(title: str, file_name: str) -> str:
    """SQL for titles that tell nothing."""
    return f"({title_fault(title, file_name)} is not null)"


def joined_lines(text: str) -> str:
    """SQL for lines as one: a word cut at a hyphen before a small letter is whole again, a capital keeps the hyphen, other ends become blanks."""
    lines = rf"trim(regexp_replace({text}, r'[ \t]*\n\s*', '\n'))"
    cut = rf"regexp_replace({lines}, r'(?<![-\p{{L}}])(\p{{L}}*\p{{Ll}})-\n(?=\p{{Ll}})', '$1')"
    return rf"replace(regexp_replace({cut}, r'(\p{{L}})-\n', '$1-'), '\n', ' ')"


def display_name(name: str) -> str:
    """SQL for "Last, First" and "von Last, Jr, First" as they are spoken; other names stay."""
    return rf"trim(case size(split({name}, r'\s*,\s*')) when 2 then regexp_replace({name}, r'^(.*?)\s*,\s*(.*)$', '$2 $1') when 3 then regexp_replace({name}, r'^(.*?)\s*,\s*(.*?)\s*,\s*(.*)$', '$3 $1 $2') else {name} end)"


def bibtex_name(name: str) -> str:
    """SQL for "First von Last" as "von Last, First": the last name begins at the first small word after the first."""
    small = rf"r'^(\S.*?) (\p{{Ll}}\S* .+)$'"
    return rf"case when {name} like '%,%' or {name} not like '% %' then {name} when {name} rlike {small} then regexp_replace({name}, {small}, '$2, $1') else regexp_replace({name}, r'^(.*) (\S+)$', '$2, $1') end"


def json_in(text: str, field: str) -> str:
    """SQL for a field of the JSON object in a text: the text itself, a fenced part, or the first braces."""
    places = (text, rf"regexp_extract({text}, r'(?s)```(?:json)?\s*(.*?)```', 1)", rf"regexp_extract({text}, r'(?s)\{{[^{{}}]*\}}', 0)")
    return "coalesce(" + ", ".join(f"get_json_object({p}, '$.{field}')" for p in places) + ")"


def product32(a: str, b: str) -> str:
    """SQL for the product of two 32-bit numbers modulo 2^32, without leaving 64 bits."""
    return f"((({a}) * (({b}) & 65535L) + ((({a}) * shiftright({b}, 16) & 65535L) * 65536L)) & 4294967295L)"


def fnv32(text: str, start: int = 0x811C9DC5, prime: int = 0x01000193) -> str:
    """SQL for the 32-bit FNV-1a hash of an ASCII text."""
    step = product32("(h ^ c)", f"{prime}L")
    return f"aggregate(transform(filter(split({text}, ''), c -> c <> ''), c -> cast(ascii(c) as long)), {start}L, (h, c) -> {step})"


def hash64(text: str) -> str:
    """SQL for two FNV passes with different starts and primes, to base 36."""
    return f"lower(conv({fnv32(text)}, 10, 36) || conv({fnv32(text, 0xCBF29CE4, 0x100001B3)}, 10, 36))"


def seeded_random(text: str) -> str:
    """SQL for the number between 0 and 1 that a seed gives: its hash, moved on and mixed in 32 bits."""
    first = f"transform(array(({fnv32(text)} + 1831565813L) & 4294967295L), t -> {product32('t ^ shiftright(t, 15)', 't | 1L')})[0]"
    second = f"transform(array({first}), t -> (t ^ (t + {product32('t ^ shiftright(t, 7)', 't | 61L')})) & 4294967295L)[0]"
    return f"transform(array({second}), t -> (t ^ shiftright(t, 14)) / 4294967296D)[0]"
