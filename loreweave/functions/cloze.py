"""Cloze deletions as Spark SQL: reading them by a fold that counts braces, showing a side, and choosing what to hide."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The syntax of clozes, what is never cut by one, and what is worth hiding.
TOKEN = r"(?s)\{\{c\d+::|::|[{}\\$]|[^{}:\\$]++|:"
SEGMENT = "array<struct<number:int,answer:string,hint:string,raw:string>>"
CODE, DESTINATION, HTML = r"`[^`\n]+`", r"\]\([^)\s]*\)", r"<[^>\n]+>"
BOLD = r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1"
LINK = r"\[\[([^\]\n|]+)(?:\|([^\]\n]+))?\]\]"
MATH = r"(?<![\\$])\$(?!\s)([^$\n]+?)(?<![\s\\])\$(?!\$)"
NUMBER = r"(?<![\w.,$\\])(?:\d{1,3}(?:,\d{3})+|\d+(?:\.\d+)?)(?:\s?%)?(?!\w)"
NAMED = r"\b[A-Z][\p{L}\p{N}\x27-]*(?:\s+[A-Z][\p{L}\p{N}\x27-]*){0,2}"
SENTENCE = r"[^.!?\n]+[.!?]?"
DEFINES = r"is defined as|is known as|is called|are called|refers to|refer to|denotes|denote|means|is|are"
DEFINITION = rf"(?i)^(\s*(?:(?:the|a|an)\s+)?)(.+?)\s+(?:{DEFINES})\s+(.+?)[.!]?\s*$"
PRONOUN = r"(?i)^(?:it|this|that|these|those|there|he|she|they|we|you|i|which|what|who|here|one)\b"
#: Clozes that a text gets at most: a setting of the feature.
MOST = 3


def segments(text: str) -> str:
    """SQL for a text as array of (number, answer, hint, raw) that make it up in order; plain parts have number 0.

    Inside a cloze braces nest to any depth, a backslash hides the character after it, and mathematics is opaque: two
    colons part the hint only outside of all these.  A cloze that never closes is plain, and so is all that follows it.
    """
    plain = "struct(0 as number, {0} as answer, cast(null as string) as hint, {0} as raw)"
    fields = ("segs", "plain", "open", "raw", "answer", "hint", "sep", "depth", "skip", "math", "half", "left")
    start = dict(zip(fields, (f"cast(array() as {SEGMENT})", "''", "0", "''", "''", "''", "false", "0", "false", "false", "false", f"size(filter(regexp_extract_all({text}, r'{TOKEN}', 0), d -> d = '$'))")))
    opens, pre = "t like '{{c%'", "if(a.half, '}', '')"
    left = "a.left - if(t = '$', 1, 0)"

    def state(**new: str) -> str:
        return "named_struct(" + ", ".join(f"'{f}', {new.get(f, 'a.' + f)}" for f in fields) + ")"

    def inside(add: str = f"concat({pre}, t)", **new: str) -> str:
        text_ = {"answer": f"if(a.sep, a.answer, concat(a.answer, {add}))", "hint": f"if(a.sep, concat(a.hint, {add}), a.hint)"}
        return state(**{"raw": "concat(a.raw, t)", "left": left, "half": "false"} | text_ | new)

    ways = (
        (f"a.open = 0 and {opens}", state(
            segs=f"if(a.plain = '', a.segs, array_append(a.segs, {plain.format('a.plain')}))", plain="''", open=r"cast(regexp_extract(t, r'(\d+)', 1) as int)",
            raw="t", answer="''", hint="''", sep="false", depth="0", skip="false", math="false", half="false")),
        ("a.open = 0", state(plain="concat(a.plain, t)", left=left)),
        ("a.math", inside("t", math="t <> '$'")),
        ("a.skip", inside("t", skip="false", depth=f"a.depth + if({opens}, 1, 0)")),
        ("a.half and t = '}'", state(segs="array_append(a.segs, struct(a.open as number, a.answer as answer, nullif(trim(a.hint), '') as hint, concat(a.raw, t) as raw))", open="0", half="false", raw="''")),
        (r"t = '\\'", inside(skip="true")),
        (f"t = '$' and {left} > 0", inside(math="true")),
        (f"t = '{{' or {opens}", inside(depth="a.depth + if(t = '{', 1, 2)")),
        ("t = '}' and a.depth > 0", inside(depth="a.depth - 1")),
        ("t = '}'", inside("''", half="true")),
        ("t = '::' and a.depth = 0 and not a.sep", inside(pre, sep="true")),
    )
    merge = "case " + " ".join(f"when {c} then {s}" for c, s in ways) + f" else {inside()} end"
    rest = "if(a.open > 0, a.raw, a.plain)"
    finish = f"if({rest} = '', a.segs, array_append(a.segs, {plain.format(rest)}))"
    return f"aggregate(regexp_extract_all({text}, r'{TOKEN}', 0), {state(**start)}, (a, t) -> {merge}, a -> {finish})"


def numbers(text: str) -> str:
    """SQL for the different numbers of a text's clozes, ascending."""
    return f"array_sort(array_distinct(transform(filter({segments(text)}, s -> s.number > 0), s -> s.number)))"


def side(text: str, number: str, hidden: str = "'[...]'", revealed: str = "s.answer", cut: str | None = None) -> str:
    """SQL for a text whose clozes of one number are ``hidden`` and the others show their answers; ``cut`` may hold its segments."""
    return f"array_join(transform({cut or segments(text)}, s -> if(s.number = {number}, {hidden}, if(s.number > 0, {revealed}, s.raw))), '')"


#: How a side is shown in a reader.
HIDDEN = "concat('<span class=\"cloze cloze-hidden\">[', coalesce(s.hint, '...'), ']</span>')"
REVEALED = "concat('<mark class=\"cloze cloze-revealed\">', s.answer, '</mark>')"


def shown(text: str) -> str:
    """SQL for a text with all clozes' answers in place."""
    return side(text, "-1")


def split(text: str) -> str:
    """SQL for a text as one text for each number, in which that cloze alone is left, as the first."""
    one = "concat('{{c1::', s.answer, coalesce(concat('::', s.hint), ''), '}}')"
    return f"transform({numbers(text)}, n -> {side(text, 'n', one)})"


#: A character put around matches to cut a text there; a text that holds it is cut by the pattern itself.
EDGE = "\x01"


def spans(text: str, pattern: str) -> str:
    """SQL for the matches of a pattern, none of them empty: array of (start, stop, found), places from 0.

    ``split`` makes its pattern anew for every row unless it is a single character, ``regexp_replace`` once.
    """
    slow = f"flatten(zip_with(split({text}, r'{pattern}', -1), regexp_extract_all({text}, r'{pattern}', 0), (g, h) -> if(h is null, array(g), array(g, h))))"
    cut = f"if(contains({text}, '{EDGE}'), {slow}, split(regexp_replace({text}, r'{pattern}', '{EDGE}$0{EDGE}'), '{EDGE}', -1))"
    one = "struct(a.at as start, a.at + length(p) as stop, p as found)"
    return (
        f"aggregate({cut}, named_struct('at', 0, 'hit', false, 'out', cast(array() as array<struct<start:int,stop:int,found:string>>)), "
        f"(a, p) -> named_struct('at', a.at + length(p), 'hit', not a.hit, 'out', if(a.hit, array_append(a.out, {one}), a.out)), a -> a.out)"
    )


def signed_spans(text: str, sign: str, pattern: str) -> str:
    """As ``spans``, for a pattern that matches only in texts where the condition ``sign`` holds; others are not cut."""
    return f"if({sign}, {spans(text, pattern)}, cast(array() as array<struct<start:int,stop:int,found:string>>))"


def with_heuristic_clozes(df: DataFrame, text_col: str, out_col: str) -> DataFrame:
    """Add the text with up to three clozes where something is worth hiding, null where nothing is.

    Best first: words in bold, what a sentence defines, links, mathematics, numbers, names, then what is said of the
    defined.  Candidates don't overlap, don't repeat an answer, and don't cut code, links, addresses or mathematics.
    """
    t = f"`{text_col}`"
    # no pattern is tried on a text that lacks the signs its matches have; most texts lack most of them
    has = lambda *signs: "(" + " or ".join(f"contains({t}, '{s}')" for s in signs) + ")"
    patterns = (
        ("code", has("`"), CODE), ("dest", has("]("), DESTINATION), ("html", has("<"), HTML), ("bold", has("**", "__"), BOLD), ("link", has("[["), LINK), ("math", has("$"), MATH),
        ("number", f"{t} rlike '[0-9]'", NUMBER), ("named", f"{t} rlike '[A-Z]'", NAMED), ("sent", rf"{t} rlike r'(?i)\s(?:{DEFINES})\s'", SENTENCE),
    )
    found = df.select("*", *[F.expr(signed_spans(t, sign, p)).alias(f"lw_{n}") for n, sign, p in patterns])
    made = lambda start, stop, answer, rank: f"struct(cast({rank} as double) as rank, {start} as start, {stop} as stop, {answer} as answer)"
    line = f"substring_index(substring({t}, 1, x.start), '\\n', -1)"
    listed = f"(trim({line}) = '' and substring({t}, x.start + 1) rlike r'^\\d+[.)]\\s')"
    small = r"(x.found not like '%\%' and x.found not like '%.%' and length(replace(x.found, ',', '')) < 2)"
    article = r"length(regexp_extract(x.found, r'^(?:The|A|An)\s+', 0))"
    begins = rf"(substring({t}, 1, x.start) rlike r'(?:^|[.!?:\n])\s*$')"
    part = lambda g: f"regexp_extract(x.found, r'{DEFINITION}', {g})"
    subject = rf"regexp_replace({part(2)}, r'[\s,:;]+$', '')"
    is_subject = rf"(length({subject}) >= 2 and size(split(trim({subject}), r'\s+')) <= 6 and not {subject} rlike r'{PRONOUN}' and not {subject} rlike r'[,;]')"
    words = rf"split({part(3)}, r'\s+')"
    is_said = rf"(size({words}) <= 8 and size(filter({words}, w -> length(regexp_replace(w, r'\W', '')) > 3)) >= 2)"
    said_at = f"(x.start + length(x.found) - locate(reverse({part(3)}), reverse(x.found)) + 1 - length({part(3)}))"
    several = (
        f"transform(lw_bold, x -> {made('x.start + 2', 'x.stop - 2', 'substring(x.found, 3, length(x.found) - 4)', 1)})",
        f"transform(filter(lw_sent, x -> x.found rlike r'{DEFINITION}' and {is_subject}), x -> {made(f'x.start + length({part(1)})', f'x.start + length({part(1)}) + length({subject})', subject, 2)})",
        f"transform(lw_link, x -> {made('x.start', 'x.stop', 'trim(substring_index(substring(x.found, 3, length(x.found) - 4), ' + repr('|') + ', -1))', 3)})",
        f"transform(lw_math, x -> {made('x.start', 'x.stop', 'x.found', 4)})",
        f"transform(filter(lw_number, x -> not {listed} and not {small}), x -> {made('x.start', 'x.stop', 'x.found', 5)})",
        f"transform(filter(lw_named, x -> length(x.found) - {article} >= 3 and ({article} > 0 or not {begins})), x -> {made(f'x.start + {article}', 'x.stop', f'substring(x.found, {article} + 1)', 5.5)})",
        f"transform(filter(lw_sent, x -> x.found rlike r'{DEFINITION}' and not {is_subject} and {is_said}), x -> {made(said_at, f'{said_at} + length({part(3)})', part(3), 6)})",
    )
    ranked = found.withColumn("lw_kept", F.expr("concat(lw_code, lw_dest, lw_html, lw_bold, lw_link, lw_math)")).withColumn("lw_wanted", F.expr(f"array_sort(concat({', '.join(several)}))"))
    cuts = "exists(lw_kept, p -> p.start < c.stop and c.start < p.stop and not (p.start <= c.start and p.stop >= c.stop) and not (c.start <= p.start and c.stop >= p.stop))"
    in_code = "exists(lw_code, p -> p.start < c.stop and c.start < p.stop)"
    swallows = "(c.rank in (2, 6) and exists(lw_kept, p -> c.start <= p.start and c.stop >= p.stop))"
    key = "lower(trim(c.answer))"
    good = f"(size(a) < {MOST} and {key} <> '' and not exists(a, o -> lower(trim(o.answer)) = {key} or o.start < c.stop and c.start < o.stop) and not {cuts} and not {in_code} and not {swallows})"
    chosen = f"aggregate(lw_wanted, cast(array() as array<struct<start:int,stop:int,answer:string,number:int>>), (a, c) -> if({good}, array_append(a, struct(c.start, c.stop, c.answer, size(a) + 1 as number)), a))"
    write = (
        "aggregate(array_sort(lw_chosen), named_struct('at', 0, 'out', ''), (a, c) -> named_struct('at', c.stop, 'out', "
        f"concat(a.out, substring({t}, a.at + 1, c.start - a.at), '{{{{c', c.number, '::', c.answer, '}}}}')), a -> concat(a.out, substring({t}, a.at + 1)))"
    )
    done = ranked.withColumn("lw_chosen", F.expr(chosen)).withColumn(out_col, F.expr(f"if(size(lw_chosen) > 0, {write}, null)"))
    return done.drop(*[c for c in done.columns if c.startswith("lw_") and c not in df.columns])
