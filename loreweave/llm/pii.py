"""Operator 3: personal data, also in disguise, by offset-preserving deobfuscation."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_texts

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Letters of other scripts that look like Latin ones, and the words and signs that disguise characters.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "к": "k", "м": "m", "т": "t", "в": "b",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "τ": "t", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " ", "​": "", "‌": "", "‍": "", "⁠": "", "﻿": "", "­": "",
}
LOOKALIKES |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}  # full-width forms
DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

STRANGE = re.compile("[" + "".join(map(re.escape, LOOKALIKES)) + "]")
BRACKETED = re.compile(r"[\x20\t]*[\[({<][\x20\t]*(at|dot|@|\.)[\x20\t]*[\])}>][\x20\t]*", re.I)
SPELLED = re.compile(r"\b(?:" + "|".join(DIGIT_WORDS) + r")(?:[\x20,-]{1,2}(?:plus|dot|point|dash|" + "|".join(DIGIT_WORDS) + r"|[0-9]+)\b){2,}", re.I)
SPOKEN = re.compile(r"(?<![^\s<(\[:;,\"'])([A-Za-z0-9_%+-]++(?:(?:\x20dot\x20|\.)[A-Za-z0-9_%+-]++)*+)(\x20at\x20|@)([A-Za-z0-9-]++(?:(?:\x20dot\x20|\.)[A-Za-z0-9-]++)++)", re.I)
SPOKEN_IP = re.compile(r"[0-9]{1,3}(?:(?:\x20(?:dot|point)\x20|\.)[0-9]{1,3}){3}", re.I)
SAID_DOT, SAID_POINT = re.compile(r"\x20dot\x20", re.I), re.compile(r"\x20(?:dot|point)\x20", re.I)
WORD = re.compile(r"[A-Za-z]+|[0-9]+")
#: What a text must hold for any transducer to change it.
HINT = re.compile(r"[^\x00-\x7f]|[\[({<][\x20\t]*(?:at|dot|@|\.)[\x20\t]*[\])}>]|\x20(?:dot|point)\x20|\b(?:" + "|".join(DIGIT_WORDS) + r")[\x20,-]{1,2}(?:" + "|".join(DIGIT_WORDS) + r"|[0-9])", re.I)

Span = tuple[str, int, int]


def digits(s: str) -> str:
    return "".join(DIGIT.findall(s))


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ to the left as far as the pattern goes, then the domain: linear in any text."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.fullmatch(text, start - 1, start):
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def detect(text: str) -> list[Span]:
    """The base spans, by kind and start."""
    out: list[Span] = [("email", *m) for m in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p) <= 255 for p in (q.lstrip("0") or "0" for q in m[0].split("."))):
                out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(n := digits(m[0])) <= 19 and luhn(n):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= len(digits(m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


Change = tuple[int, int, str]


def spelled(text: str) -> list[Change]:
    found = []
    for m in SPELLED.finditer(text):
        if text[max(0, m.start() - 5) : m.start()].lower() == "plus ":
            found.append((m.start() - 5, m.start(), "+"))
        last = m.start()
        for w in WORD.finditer(text, *m.span()):
            said = DIGIT_WORDS.get(w[0].lower()) or {"plus": "+", "dot": ".", "point": ".", "dash": "-"}.get(w[0].lower(), w[0])
            found.append((last, w.end(), said))
            last = w.end()
    return found


def spoken(text: str, dots: set[int]) -> list[Change]:
    """Spoken signs of addresses; a plain `` at `` needs a dot that was spoken or, at ``dots``, bracketed, as prose has it too."""
    found = []
    for m in SPOKEN.finditer(text):
        said = [d.span() for part in (1, 3) for d in SAID_DOT.finditer(text, *m.span(part))]
        if m[2] == "@":
            found += [(*d, ".") for d in said]
        elif any(d[0] > m.end(2) for d in said) or any(p in dots for p in range(*m.span(3))):
            found += [(*m.span(2), "@"), *[(*d, ".") for d in said]]
    return found


class Reading:
    """A text as it is read after changes; each changed piece keeps the source span that it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.marks: list[tuple[int, int, int, int]] = []  # begin and end here, start and stop in the source
        self.begins: list[int] = []
        self.ends: list[int] = []

    def back(self, p: int, last: bool) -> int:
        """The source offset of one of this reading."""
        k = bisect_right(self.ends, p - last)
        if k < len(self.marks) and self.begins[k] <= p - last:
            return self.marks[k][3] if last else self.marks[k][2]
        return self.marks[k - 1][3] + p - self.ends[k - 1] if k else p

    def change(self, found: list[Change]) -> list[int]:
        """Apply changes of this reading, the first and longest of those that overlap; where each of them now begins."""
        if not found:
            return []
        parts, marks, at, size, k, new = [], [], 0, 0, 0, []
        for start, stop, said in sorted(found, key=lambda x: (x[0], -x[1])):
            if start < at:
                continue
            while k < len(self.marks) and self.ends[k] <= start:
                marks.append((self.begins[k] + size - at, self.ends[k] + size - at, *self.marks[k][2:]))
                k += 1
            while k < len(self.marks) and self.begins[k] < stop:
                k += 1  # the new change stands for what the old one did
            parts += [self.text[at:start], said]
            size += start - at
            new.append(size)
            marks.append((size, size + len(said), self.back(start, False), self.back(stop, True)))
            size += len(said)
            at = stop
        marks += [(b + size - at, e + size - at, s, t) for b, e, s, t in self.marks[k:]]
        parts.append(self.text[at:])
        self.text, self.marks = "".join(parts), marks
        self.begins, self.ends = [m[0] for m in marks], [m[1] for m in marks]
        return new


def read(text: str) -> Reading:
    """``text`` through all transducers, each on the output of the one before."""
    r = Reading(text)
    if not text.isascii():
        r.change([(m.start(), m.end(), LOOKALIKES[m[0]]) for m in STRANGE.finditer(text)])
    at = r.change([(*m.span(), {"at": "@", "dot": "."}.get(m[1].lower(), m[1])) for m in BRACKETED.finditer(r.text)])
    r.change(spoken(r.text, {p for p in at if r.text[p] == "."}))
    r.change(spelled(r.text))
    r.change([(*d.span(), ".") for m in SPOKEN_IP.finditer(r.text) for d in SAID_POINT.finditer(r.text, *m.span())])
    return r


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans found only after normalising, mapped back to the text; those that equal or lie inside a base span are dropped.

    A match maps back from the start of its first character to the end of its last.
    One that is larger than the base span it meets stays: the base pattern has then
    seen a plain piece of it only.
    """
    if not HINT.search(text):
        return []
    r = read(text)
    spans = detect(r.text) if r.marks else []
    if not spans:
        return []
    taken = sorted((s, e) for _, s, e in base)
    reach = list(accumulate((e for _, e in taken), max))
    out = []
    for kind, s, e in spans:
        k = bisect_right(r.ends, s)
        if k >= len(r.marks) or r.begins[k] >= e:
            continue  # nothing in it was disguised
        source = (r.back(s, False), r.back(e, True))
        k = bisect_right(taken, source[0], key=lambda x: x[0])
        if k and reach[k - 1] >= source[1]:
            continue
        out.append((kind, *source))
    return out


def find(text: str) -> tuple[list[Span], list[Span]]:
    base = detect(text)
    return base, disguised(text, base)


def find_pii(df: DataFrame, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """Add ``pii``: an array of (kind, start, end, disguised), by kind as listed and then start.

    Offsets count code points and the end is exclusive.  A null or empty text has
    an empty array.  Other columns and repeated rows stay, an empty table gives an
    empty one, and a column named ``pii`` is replaced.  Each pattern is anchored so
    that its work is linear in the text; nothing is shuffled.
    """
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("disguised", pa.bool_())])

    def run(texts: list[str]) -> list[pa.Array]:
        rows = []
        for t in texts:
            base, more = find(t)
            spans = [(*s, False) for s in base] + [(*s, True) for s in more]
            spans.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
            rows.append([dict(zip(("kind", "start", "end", "disguised"), s)) for s in spans])
        return [pa.array(rows, pa.list_(item))]

    return map_texts(df, run, "pii array<struct<kind:string,start:int,end:int,disguised:boolean>>", text_col, drop)


def redacted(text: str) -> str:
    """``text`` with each identifier replaced by its kind in brackets; overlapping ones become one."""
    base, more = find(text)
    merged: list[list] = []
    for kind, s, e in sorted([*base, *more], key=lambda x: (x[1], -x[2])):
        if merged and s < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], e)
        else:
            merged.append([kind, s, e])
    out, at = [], 0
    for kind, s, e in merged:
        out += [text[at:s], f"[{kind}]"]
        at = e
    return "".join([*out, text[at:]])


def redact_pii(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Replace every identifier in the text by ``[email]``, ``[ip]``, ``[card]`` or ``[phone]``.

    A null text stays null, an empty one empty; all rows, repeated ones too, and all
    columns stay, whatever their names, and an empty table gives an empty one.
    """
    names, made = df.columns, fresh(df, "redacted")
    done = map_texts(df, lambda texts: [pa.array([redacted(t) for t in texts], pa.string())], f"`{made}` string", text_col)
    return done.withColumn(text_col, F.when(F.col(f"`{text_col}`").isNotNull(), F.col(made))).select(*[f"`{c}`" for c in names])
