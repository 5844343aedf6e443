"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import quality


def _quality() -> str:
    word = r"'[^\x20\x09-\x0D]+'"
    blank = r"'[\x20\x09-\x0D]+'"
    lacking = lambda c: f"length(regexp_replace(t, {c}, '', 'g'))"
    quote = lambda c: "'" + c.replace("'", "''") + "'"
    row = lambda values: "[" + ", ".join(map(str, values)) + "]"
    by = lambda values: "case lang " + " ".join(f"when '{k}' then {v}" for k, v in values.items()) + " end"
    refs = quality.REFERENCES
    classes = by({k: row(v[0]) for k, v in refs.items()})
    words = by({k: row([*v[1].values(), 1 - sum(v[1].values())]) for k, v in refs.items()})
    lists = by({k: "[" + ", ".join(f"'{w}'" for w in v[1]) + "]" for k, v in refs.items()})
    half = "case when {0} > 0 then {0} * log2(2 * {0} / (x[1] + x[2])) else 0 end"
    js = lambda p, q: f"sqrt(greatest(0, list_sum(list_transform(list_zip({p}, {q}), lambda x: 0.5 * ({half.format('x[1]')} + {half.format('x[2]')})))))"
    share = lambda c, n: f"list_transform(list_append({c}, {n} - list_sum({c})), lambda c: c::double / {n})"
    return f"""
with d as (select row_number() over () rid, doc_id, lang, coalesce(text, '') t from documents),
w as (select *, regexp_extract_all(t, {word}) w, length(t) n from d),
win as (select rid, i, array_to_string(w[i : i + 7], ' ') s from w, unnest(range(1, len(w) - 6)) u(i)),
rep as (select rid, i from (select *, count(*) over (partition by rid, s) c from win) where c > 1),
cov as (select rid, count(distinct i + j) c from rep, range(0, 8) r(j) group by rid),
f as (
  select rid, doc_id, lang, n, len(w)::bigint n_words, {lacking(blank)}::bigint word_chars,
    (n - {lacking(quote(quality.SYMBOLS))})::bigint n_symbols,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, {word})) lines,
    [{", ".join(f"n - {lacking(quote(c))}" for c in quality.CLASSES)}] classes,
    list_transform({lists}, lambda c: len(list_filter(w, lambda x: lower(trim(x, {quote(quality.MARKS)})) = c))) common
  from w),
g as (
  select doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::bigint n_dup_lines, coalesce(c, 0)::bigint n_repeat_words,
    n_words < 20 or 100 * coalesce(c, 0) > 30 * n_words base_failed,
    case when n >= {quality.MIN_CHARS} then {js(share('classes', 'n'), classes)} end cd,
    case when n_words >= {quality.MIN_WORDS} then {js(share('common', 'n_words'), words)} end wd
  from f left join cov using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not coalesce(cd > {quality.MAX_CLASS_DISTANCE}, false) and not coalesce(wd > {quality.MAX_WORD_DISTANCE}, false) kept
from g"""


DECONTAMINATE = r"""
with words as (select 'd' side, doc_id id, regexp_extract_all(lower(coalesce(text, '')), '(?:[a-z0-9]|[^\x00-\x7F])+') w from documents
  union all select distinct 'b', item_id, regexp_extract_all(lower(coalesce(text, '')), '(?:[a-z0-9]|[^\x00-\x7F])+') from benchmark),
sizes as (select distinct least(5, len(w)) k from words where side = 'b' and len(w) > 0),
sh as (select distinct side, id, k, array_to_string(w[i : i + k - 1], ' ') s from words, sizes, unnest(range(1, len(w) - k + 2)) u(i) where side = 'd' or k = least(5, len(w))),
items as (select *, count(*) over (partition by id) n from sh where side = 'b')
select d.id doc_id, b.id item_id, n n_shingles, count(*) n_found from items b join sh d on d.side = 'd' and d.s = b.s and d.k = b.k
group by 1, 2, 3 having count(*) >= 0.8 * n"""

def _conversations() -> str:
    """Damage by a crc32 made of its table, then a fold over each conversation's turns that keeps, for every last role, the best edits so far."""
    say = lambda q, role, text: f"st[{q}].said || case when st[{q}].said = '' then '' else chr(10) end || {role} || ':' || {text}"
    edit = lambda q, cost, name, said: f"{{'c': st[{q}].c + {cost}, 'a': st[{q}].a || '{name}', 'said': {said}}}"
    insert = lambda q, role: edit(q, 5, "I", say(q, f"'{role}'", "''"))
    least = lambda ways: f"list_sort([{', '.join(ways)}])[1]"
    stay = lambda q: f"st[{q}]"
    inserted = f"[{stay(1)}, {stay(2)}, {least([stay(3), insert(1, 'user'), insert(2, 'user'), insert(4, 'user')])}, {least([stay(4), insert(3, 'assistant')])}]"
    closed = lambda st: f"list_transform(list_transform([{st}], lambda st: {inserted}), lambda st: {inserted})[1]"
    worst = "1000000000"
    lost = f"{{'c': {worst}, 'a': '', 'said': ''}}"
    keep = lambda q, initial: f"case when x.gone or left(x.role, 1) <> '{initial}' then {lost} else {edit(q, 'x.cut', 'K', say(q, 'x.role', 'x.txt'))} end"
    name = lambda q, role: f"case when x.gone then {lost} else {edit(q, '1 + x.cut', 'R', say(q, repr(role), 'x.txt'))} end"
    drop = lambda q: edit(q, 2, "D", f"st[{q}].said")
    user = [f(q, *more) for q in (1, 2, 4) for f, more in ((keep, "u"), (name, ["user"]))]
    read = f"[{drop(1)}, {least([drop(2), keep(1, 's')])}, {least([drop(3), *user])}, {least([drop(4), keep(3, 'a'), name(3, 'assistant')])}]"
    begin = f"{{'role': '', 'txt': '', 'gone': false, 'cut': 0, 'st': [{{'c': 0, 'a': '', 'said': ''}}, {lost}, {lost}, {lost}]}}"
    fold = (
        "list_reduce(turns, lambda acc, x: {'role': '', 'txt': '', 'gone': false, 'cut': 0, 'st': "
        f"list_transform([{closed('acc.st')}], lambda st: {read})[1]}}, {begin})"
    )
    blanks = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
with crc as (select list(c order by i) t from (
    select i, list_reduce(range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, i) c from range(256) r(i))),
n as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') txt, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') name from conversations),
w as (select *, xor(list_reduce(list_transform(string_split(name, ''), lambda x: ascii(x)::bigint),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295::bigint), 4294967295::bigint) % 20 way from n, crc),
d as (select conv_id, turn, case when way = 4 then 'user' else role end role,
    case way when 1 then '' when 2 then translate(txt, '.!?', '') else txt end txt
  from w, unnest(range(case way when 0 then 0 when 3 then 2 else 1 end)) u(copy)),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(txt)) i, right(rtrim(txt, {blanks}), 1) ending from d),
f as (select *, ending = '' blank, row_number() over (partition by conv_id, role, txt order by i) > 1 again, ending not in ('.', '!', '?') cut,
    coalesce(lag(left(role, 1)) over (partition by conv_id order by i) || left(role, 1) not in ('su', 'ua', 'au'), false) illegal from o),
c as (select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint gaps, count(*) filter (blank) blank,
    count(*) filter (again and not blank) duplicate, count(*) filter (cut and not again and not blank) truncated, count(*) filter (illegal) illegal,
    list({{'role': role, 'txt': txt, 'gone': blank or again, 'cut': case when cut then 5 else 0 end, 'st': null::struct(c integer, a varchar, said varchar)[]}} order by i) turns
  from f group by conv_id),
b as (select *, list_sort(list_transform([{closed("r.st")}], lambda st: [st[1], st[4]])[1])[1] best from (select *, {fold} r from c)),
every as (select distinct conv_id from conversations)
select e.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
  coalesce(best.c, 0)::bigint cost, coalesce(best.a, '') audit, sha256(coalesce(best.said, '')) repaired_sha256
from every e left join b on e.conv_id is not distinct from b.conv_id"""


SQL = {"op2_quality_rules": _quality(), "op10_decontaminate": DECONTAMINATE, "op12_conversation_repair": _conversations()}
