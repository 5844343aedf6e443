"""Notes with markup: references, backlinks with aliases and embeds, lenses by query text, renaming and merging, snippets, cards."""

from __future__ import annotations

import datetime as dt
import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import cloze, markup
from ..functions.text import fold, folded, quoted, spelt

BLOCK = ("page_id", "id", "ord")


def references(blocks: DataFrame, once: bool = True) -> DataFrame:
    """(page_id, id, ord, kind, name, block, norm): every different reference of every block; nothing inside code, mathematics or addresses counts.

    Without ``once`` a block's repeated references come back as often, and nothing is shuffled.
    """
    found = blocks.select(*BLOCK, F.explode(F.expr(markup.refs("text"))).alias("r")).select(*BLOCK, "r.kind", F.col("r.target").alias("name"), "r.block")
    normed = found.withColumn("norm", F.expr(markup.norm("name")))
    return normed.dropDuplicates([*BLOCK, "kind", "norm", "block"]) if once else normed


def names(pages: DataFrame) -> DataFrame:
    """(norm, target): the page of each title and alias; titles come before aliases, then the lower page id."""
    each = pages.select("page_id", F.explode(F.expr("concat(array(struct(0 as rank, title as name)), transform(aliases, a -> struct(1 as rank, a as name)))")).alias("n"))
    normed = each.select(F.expr(markup.norm("n.name")).alias("norm"), F.struct("n.rank", "page_id").alias("first"))
    return normed.where("norm <> ''").groupBy("norm").agg(F.min("first").alias("first")).select("norm", F.col("first.page_id").alias("target"))


def backlinks(refs: DataFrame, named: DataFrame) -> DataFrame:
    """(target, page_id, id, ord): blocks that refer to a page by its title or an alias, as link, tag or embed; the page's own do not count."""
    met = refs.where("kind <> 'block'").join(named, "norm")
    return met.where("target <> page_id").select("target", *BLOCK).distinct()


def concepts(refs: DataFrame, pages: DataFrame, named: DataFrame, system: tuple[str, ...] = ("flashcard", "flashcards")) -> DataFrame:
    """(concept, blocks): how many blocks refer to each concept, a page's aliases counted with its title; concept pages without any count 0."""
    titles = pages.select(F.col("page_id").alias("target"), F.expr(markup.norm("title")).alias("title"), "kind")
    counted = (
        refs.where("kind in ('link', 'tag')").join(named, "norm", "left").join(titles, "target", "left")
        .withColumn("concept", F.coalesce("title", "norm")).groupBy("concept").agg(F.countDistinct(*BLOCK).alias("blocks"))
    )
    own = titles.where("kind = 'concept'").select(F.col("title").alias("concept")).distinct()
    every = counted.join(own, "concept", "full_outer").where(~F.col("concept").isin(*system))
    return every.select("concept", F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"))


def outgoing(refs: DataFrame, named: DataFrame) -> DataFrame:
    """(page_id, goal, blocks): blocks of a page that link, tag or embed each goal, a page's number or a name without page."""
    goal = F.coalesce(F.col("target").cast("string"), F.col("norm"))
    met = refs.where("kind <> 'block'").join(named, "norm", "left").withColumn("goal", goal)
    return met.groupBy("page_id", "goal").agg(F.countDistinct("id", "ord").alias("blocks"))


def fragments_dealt(refs: DataFrame) -> DataFrame:
    """``refs`` with ``dealt``, a third key beside page and block: of both where both are there, else of the reference."""
    return refs.withColumn("dealt", F.expr("if(page is null or block is null, xxhash64(id, ord), xxhash64(page, block))"))


def link_targets(refs: DataFrame, named: DataFrame, blocks: DataFrame) -> DataFrame:
    """(id, ord, norm, page, block_found): the page of every different link and embed, and whether the block that its fragment names stands there.

    References without a page or a fragment find nothing, and are dealt out by their block: by the null that they have
    in common they would all meet in one task.  ``refs`` may hold references as often as they occur.
    """
    met = refs.where("kind in ('link', 'embed')").join(named.withColumnRenamed("target", "page"), "norm", "left").select("id", "ord", "norm", "page", "block")
    there = blocks.select(F.col("page_id").alias("page"), F.expr("substring_index(id, '-', 1)").alias("block")).distinct()
    there = there.select("page", "block", F.xxhash64("page", "block").alias("dealt"), F.lit(True).alias("there"))
    return fragments_dealt(met).join(there, ["page", "block", "dealt"], "left").select("id", "ord", "norm", "page", F.coalesce("there", F.lit(False)).alias("block_found")).distinct()


#: Words, blanks and single marks: what a text and a name are compared by.
TOKEN = r"[\p{L}\p{N}_]+|\s+|[^\p{L}\p{N}_\s]"
WORDS = r"^[\p{L}\p{N}_]"
#: First words of names that go along with the plan; more are joined instead.
FIRST_WORDS = 1000


def mentions(blocks: DataFrame, named: DataFrame, linked: DataFrame) -> DataFrame:
    """(target, page_id, id, ord): blocks in which a page's title or alias stands outside all regions and references, and which do not refer to the page.

    A name counts as it is written, marks and all, in any case and with any blanks, between word borders.  Only runs
    of as many tokens as some name has are tried, and only those that begin with a name's first token: the runs are
    made inside the row, so that what is exploded and joined is one short string for each try.
    """
    tokens = lambda c: F.expr(f"transform(regexp_extract_all({c}, r'{TOKEN}', 0), t -> if(t rlike r'^\\s', ' ', t))")
    parts = named.select("target", tokens("norm").alias("w")).where("size(w) > 0").select("target", F.col("w")[0].alias("first"), F.size("w").alias("n"), F.array_join("w", "").alias("run")).distinct()
    sizes = [r.n for r in parts.select("n").distinct().orderBy("n").collect()]  # no more than lengths of names there are
    if not sizes:
        return linked.limit(0)
    firsts = [r.first for r in parts.select("first").distinct().limit(FIRST_WORDS + 1).collect()]
    begins = f"w[p] in ({quoted(firsts)})" if len(firsts) <= FIRST_WORDS else "w[p] <> ' '"
    bare = F.expr(f"lower(regexp_replace(text, r'{markup.LINKED}', '{markup.HOLE}'))")
    heads = blocks.select(*BLOCK, bare.alias("bare")).select(*BLOCK, tokens("bare").alias("w"))
    border = f"((w[p] rlike r'{WORDS}' or p = 0 or not w[p - 1] rlike r'{WORDS}') and (w[p + n - 1] rlike r'{WORDS}' or p + n = size(w) or not w[p + n] rlike r'{WORDS}'))"
    at = f"filter(sequence(0, size(w) - 1), p -> {begins})"
    runs = f"flatten(transform({at}, p -> transform(filter(array({', '.join(map(str, sizes))}), n -> p + n <= size(w) and {border}), n -> array_join(slice(w, p + 1, n), ''))))"
    tried = heads.where("size(w) > 0").select(*BLOCK, F.explode(F.array_distinct(F.expr(runs))).alias("run"))
    met = tried.join(parts.select("target", "run"), "run").where("target <> page_id").select("target", *BLOCK).distinct()
    return met.join(linked, ["target", *BLOCK], "left_anti")


def block_references(refs: DataFrame) -> DataFrame:
    """(block, page_id, id, ord): blocks that refer to a block, by its id or by an embed's fragment."""
    wanted = F.when(F.col("kind") == "block", F.col("name")).otherwise(F.col("block"))
    return refs.select(wanted.alias("block"), *BLOCK).where("block is not null").distinct()


# ------------------------------------------------------------------ lenses

LEXEMES = re.compile(
    r'''\s*(?:(?P<not>(?<![^\s(])-(?=\S))|(?P<open>\()|(?P<close>\))|(?P<tag>\#?)\[\[(?P<name>.*?)(?:\]\]|(?P<cut>$))|"(?P<phrase>[^"]*)(?:"|(?P<unquoted>$))
    |\#(?P<bare>(?=\w)[^\s()]+)|(?P<key>(?i:tag|page|source|src|type|is|has|before|after)):(?:"(?P<quoted>[^"]*)(?:"|(?P<uncut>$))|\[\[(?P<inner>.*?)(?:\]\]|$)|(?P<value>[^\s()]*))|(?P<word>[^\s()]+))''',
    re.S | re.X,
)
TYPES = ("text", "math", "code", "ink", "image", "slide", "embed")


def lens_term(found: re.Match, errors: list[str]) -> tuple | None:
    """A ('term', kind, value) of what one lexeme says; None, and what is wrong, if it says nothing."""
    if found["name"] is not None:
        if found["cut"] is not None:
            errors.append("Unclosed [[")
        kind, value = "tag" if found["tag"] else "ref", found["name"].strip()
    elif found["phrase"] is not None:
        if found["unquoted"] is not None:
            errors.append("Unclosed quote")
        kind, value = "phrase", found["phrase"].strip()
    elif found["bare"]:
        kind, value = "tag", found["bare"]
    elif found["key"]:
        if found["uncut"] is not None:
            errors.append("Unclosed quote")
        kind, value = found["key"].lower().replace("src", "source"), (found["quoted"] or found["inner"] or found["value"] or "").strip()
        if not value:
            errors.append(f"Missing value for {found['key']}:")
    else:
        kind, value = "word", found["word"]
        if unknown := re.match("([A-Za-z]+):", value):
            errors.append(f'Unknown filter "{unknown[1]}:" (searching it as text)')
    if not value:
        return None
    if kind in ("before", "after"):
        try:
            dt.date.fromisoformat(value if re.fullmatch(r"\d{4}-\d\d-\d\d", value) else "")
        except ValueError:
            errors.append(f'Invalid date "{value}" (use YYYY-MM-DD)')
            return None
    allowed = {"type": TYPES, "is": ("flashcard", "card"), "has": ("anchor",)}.get(kind)
    if allowed and value.lower() not in allowed:
        errors.append(f'Unknown block type "{value}" (use {", ".join(TYPES)})' if kind == "type" else f"Unknown filter {kind}:{value} (use {kind}:{allowed[0]})")
        return None
    return ("term", kind, value.lower() if allowed else value)


def parse_lens(query: str) -> tuple[tuple | None, list[str]]:
    """A query as nested ('or' | 'and' | 'not' | 'term', ...) tuples, None if it says nothing, and what is wrong with it.

    Terms side by side are all wanted and bind closer than OR; ``-`` negates.  A term that can't be read is left out.
    """
    tokens, errors, place = list(LEXEMES.finditer(query)), [], 0

    def joint(name: str) -> bool:
        word = tokens[place]["word"] if place < len(tokens) else None
        return word in {"or": ("OR", "|", "||"), "and": ("AND", "&&")}[name]

    def joined(name: str, parts: list) -> tuple | None:
        parts = [p for p in parts if p]
        return (name, *parts) if len(parts) > 1 else parts[0] if parts else None

    def either():
        nonlocal place
        parts = [both()]
        while joint("or"):
            place += 1
            parts.append(both())
            if not parts[-1]:
                errors.append("OR without a right-hand side")
        return joined("or", parts)

    def both():
        nonlocal place
        parts = []
        while place < len(tokens) and not joint("or") and not tokens[place]["close"]:
            if joint("and"):
                place += 1
            else:
                parts.append(single())
        return joined("and", parts)

    def single():
        nonlocal place
        negated = False
        while place < len(tokens) and tokens[place]["not"]:
            negated, place = not negated, place + 1
        if place == len(tokens):
            errors.append('Dangling "-"')
            return None
        found, place = tokens[place], place + 1
        if found["open"]:
            inner = either()
            if place < len(tokens) and tokens[place]["close"]:
                place += 1
            else:
                errors.append('Missing ")"')
        else:
            inner = None if found["close"] or found["word"] in ("OR", "|", "||", "AND", "&&") else lens_term(found, errors)
        return ("not", inner) if negated and inner else inner

    whole = []
    while place < len(tokens):
        whole.append(either())
        if place < len(tokens) and tokens[place]["close"]:
            errors.append('Unmatched ")"')
            place += 1
    return joined("and", whole), errors


def lens(query: str, blocks: DataFrame, refs: DataFrame, pages: DataFrame, named: DataFrame, sources: DataFrame) -> DataFrame:
    """The blocks that a lens query finds; a query that says nothing finds none, and ``parse_lens`` tells what is wrong with one.

    The references of all terms are gathered in one pass to a bit mask a block, and the pages to another; each meets the
    blocks in one join, whatever the number of terms, and the rest are conditions of the row.  A condition that a null
    leaves open does not hold, so that its negation does.
    """
    tree, _ = parse_lens(query)
    if tree is None:
        return blocks.where("false")
    terms: list[tuple] = []

    def gather(node: tuple) -> None:
        if node[0] == "term":
            terms.append(node)
        else:
            for n in node[1:]:
                gather(n)

    gather(tree)
    spark = blocks.sparkSession
    names = [t for t in dict.fromkeys(terms) if t[1] in ("tag", "ref", "page")]
    origins = [t for t in dict.fromkeys(terms) if t[1] == "source"]
    df, bit = blocks, {}

    def mask(found: DataFrame, on: list[str], name: str) -> DataFrame:
        """A column of the numbers of the terms that hold for a row of ``found``."""
        return found.groupBy(*on).agg(F.collect_set("term").alias(name))  # no more than terms there are

    if names:
        wanted = spark.createDataFrame([(i, markup.normed(t[2]), t[1]) for i, t in enumerate(names)], "term int, norm string, kind string")
        pages_of = named.join(F.broadcast(wanted), "norm").select("term", "kind", "target")  # as many rows as terms, at most
        alike = named.join(F.broadcast(pages_of), "target").select("term", "kind", "norm").union(wanted.select("term", "kind", "norm")).distinct()
        by_ref = refs.where("kind <> 'block'").withColumnRenamed("kind", "of").join(F.broadcast(alike), "norm").where("kind = 'ref' or kind = 'tag' and of = 'tag'")
        df = df.join(mask(by_ref, list(BLOCK), "lens_refs"), list(BLOCK), "left")
        by_page = pages_of.where("kind = 'page'").select(F.col("target").alias("page_id"), "term")
        df = df.join(F.broadcast(mask(by_page, ["page_id"], "lens_pages")), "page_id", "left")
        bit |= {t: F.array_contains("lens_pages" if t[1] == "page" else "lens_refs", i) for i, t in enumerate(names)}
    if origins:
        ids = [source_ids(sources, t[2]).withColumn("term", F.lit(i)) for i, t in enumerate(origins)]
        ids = functools.reduce(DataFrame.unionByName, ids)
        df = df.join(mask(ids.withColumnRenamed("id", "anchor_source_id"), ["anchor_source_id"], "lens_sources"), "anchor_source_id", "left")
        made = pages.join(ids.withColumnRenamed("id", "source_id"), "source_id")
        df = df.join(mask(made, ["page_id"], "lens_made"), "page_id", "left")
        bit |= {t: F.coalesce(F.array_contains("lens_sources", i), F.lit(False)) | F.coalesce(F.array_contains("lens_made", i), F.lit(False)) for i, t in enumerate(origins)}

    def holds(node: tuple) -> Column:
        _, kind, value = node
        if node in bit:
            return bit[node]
        if kind == "type":
            return F.col("type") == value
        if kind == "is":
            return F.expr(markup.has_card_tag("text"))
        if kind == "has":
            return F.col("anchor_source_id") != ""
        if kind in ("before", "after"):
            day = F.lit(dt.date.fromisoformat(value))
            return F.col("created_at") < day if kind == "before" else F.col("created_at") >= day
        text = F.expr(fold(markup.plain("text")))
        words = re.findall(r"\w+", folded(value))
        out = F.lit(bool(words))
        for w in words:
            out = out & text.rlike(rf"(?<![\p{{L}}\p{{N}}\p{{M}}]){w}" + ("" if kind == "word" else r"(?![\p{L}\p{N}\p{M}])"))
        return out & F.regexp_replace(text, r"\s+", " ").contains(" ".join(folded(value).split())) if kind == "phrase" else out

    def condition(node: tuple) -> Column:
        if node[0] == "not":
            return ~condition(node[1])
        if node[0] == "term":
            return F.coalesce(holds(node), F.lit(False))
        return functools.reduce((lambda a, b: a | b) if node[0] == "or" else (lambda a, b: a & b), map(condition, node[1:]))

    return df.where(condition(tree)).select(*blocks.columns)


def source_ids(sources: DataFrame, value: str) -> DataFrame:
    """(id): sources whose id, key, title or file name is ``value``; if none is, those whose title holds it (three characters or more)."""
    wanted = F.lit(markup.normed(value))
    normed = [F.expr(markup.norm(c)) for c in ("title", "bib_key", "file_name")]
    exact = (F.col("id") == value) | (normed[0] == wanted) | (normed[1] == wanted) | (normed[2] == wanted)
    rank = F.when(exact, 0).when((F.length(wanted) >= 3) & normed[0].contains(wanted), 1)
    ranked = sources.select("id", rank.alias("rank")).where("rank is not null")
    best = ranked.agg(F.min("rank").alias("best"))
    return ranked.join(F.broadcast(best), F.col("rank") == F.col("best")).select("id")  # one row is broadcast


def grouped_results(found: DataFrame, pages: DataFrame, cap: int = 400) -> DataFrame:
    """(page_id, blocks): the first results in order, newest page first, gathered by page; the cap is the feature's own."""
    ranked = found.join(pages.select("page_id", "updated_at"), "page_id").orderBy(F.desc("updated_at"), "page_id", "ord", "id").limit(cap)
    return ranked.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda s: s.id), ",").alias("blocks"))


# ------------------------------------------------------------------ edits of names


def rename_page(pages: DataFrame, blocks: DataFrame, old: str, new: str) -> tuple[DataFrame, DataFrame]:
    """Pages and blocks after a page has been renamed: its title, and all references that spell the old one."""
    is_old = F.expr(markup.norm("title")) == markup.normed(old)
    return pages.withColumn("title", F.when(is_old, F.lit(new)).otherwise(F.col("title"))), blocks.withColumn("text", F.expr(markup.renamed("text", old, new)))


def merge_concepts(pages: DataFrame, blocks: DataFrame, gone: str, kept: str) -> tuple[DataFrame, DataFrame]:
    """Pages and blocks after one concept has become another.

    References are rewritten, the kept page takes the other's title and aliases, its
    blocks follow the kept page's, and the page that is gone is marked as trash.
    """
    norm = F.expr(markup.norm("title"))
    gone_norm, kept_norm = markup.normed(gone), markup.normed(kept)
    old = pages.where(norm == gone_norm).select(F.col("page_id").alias("old_id"), F.concat(F.array("title"), "aliases").alias("old_names"))
    new = pages.where(norm == kept_norm).select(F.col("page_id").alias("new_id"))
    pair = F.broadcast(old.crossJoin(new))  # one row: a title has one page
    met = pages.join(pair, F.col("page_id") == F.col("new_id"), "left")
    more = F.array_distinct(F.concat("aliases", F.coalesce("old_names", F.array())))
    after = met.withColumn("aliases", more).drop("old_id", "old_names", "new_id").withColumn("trashed", norm == gone_norm)
    last = blocks.join(pair, F.col("page_id") == F.col("new_id"), "left_semi").agg(F.coalesce(F.max("ord") + 1, F.lit(0)).alias("after"))
    moved = blocks.join(pair, F.col("page_id") == F.col("old_id"), "left").join(F.broadcast(last)).withColumn("ord", F.when(F.col("new_id").isNull(), F.col("ord")).otherwise(F.col("ord") + F.col("after")))
    moved = moved.withColumn("page_id", F.coalesce("new_id", "page_id")).drop("old_id", "old_names", "new_id", "after")
    return after, moved.withColumn("text", F.expr(markup.renamed("text", gone, kept)))


def link_mention(text: str, name: str) -> str:
    """SQL for a text whose first mention of a name outside regions and references is made a link."""
    return markup.link_first(text, name)


def retagged(tags: str, old: str, new: str) -> str:
    """SQL for a list of tags with one replaced; of tags that are alike the first spelling stays."""
    swapped = f"transform({tags}, t -> if({markup.norm('t')} = {markup.literal(markup.normed(old))}, {markup.literal(new)}, t))"
    return f"transform(array_distinct(transform({swapped}, t -> {markup.norm('t')})), n -> filter({swapped}, t -> {markup.norm('t')} = n)[0])"


# ------------------------------------------------------------------ snippets


def snippet(text: str, words: list[str], width: int = 180, whole: bool = False) -> str:
    """SQL for the part of a text around the first of the folded ``words``, or words that begin so: (snippet, highlights).

    A third of the width stands before it, cut at blanks, with ellipses; without a hit it is the beginning.  Each
    highlight is [start, end) in the snippet.  Places are counted in the text as it is written, marks included.
    """
    letters = r"\p{L}\p{N}\p{M}"
    end = rf"(?![{letters}])" if whole else rf"[{letters}]*+"
    hit = rf"(?iu)(?<![{letters}])(?:{'|'.join(map(spelt, words)) or '(?!)'}){end}"
    before = f"if({text} rlike r'{hit}', length(regexp_extract({text}, r'(?s)^(.*?){hit}', 1)), 0)"
    third = width // 3
    back = f"locate(' ', reverse(substring(s.t, 1, s.at - {third} + 1)))"
    begin = f"if(s.at <= {third}, 0, s.at - {third} - if({back} between 1 and 20, {back} - 2, 0))"
    last = f"locate(' ', reverse(substring(b.t, 1, b.start + {width} + 1)))"
    stop = f"if(b.start + {width} >= length(b.t), length(b.t), b.start + {width} - if({last} > 0 and {last} - 1 < {width} / 2, {last} - 1, 0))"
    made = "concat(if(e.start > 0, '…', ''), substring(e.t, e.start + 1, e.stop - e.start), if(e.stop < length(e.t), '…', ''))"
    gaps, hits = f"split(x, r'{hit}', -1)", f"regexp_extract_all(x, r'{hit}', 0)"
    marks = (
        f"aggregate(zip_with({gaps}, {hits}, (g, h) -> named_struct('gap', g, 'hit', h)), named_struct('at', 0, 'out', cast(array() as array<array<int>>)), "
        "(a, z) -> named_struct('at', a.at + length(z.gap) + coalesce(length(z.hit), 0), 'out', if(z.hit is null, a.out, array_append(a.out, array(a.at + length(z.gap), a.at + length(z.gap) + length(z.hit))))), a -> a.out)"
    )
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    inner = let(made, "x", f"named_struct('snippet', x, 'highlights', {marks})")
    placed = let(f"named_struct('t', b.t, 'start', b.start, 'stop', {stop})", "e", inner)
    begun = let(f"named_struct('t', s.t, 'start', {begin})", "b", placed)
    return let(f"named_struct('t', {text}, 'at', {before})", "s", begun)


# ------------------------------------------------------------------ cards


def generate_cards(blocks: DataFrame) -> DataFrame:
    """(card_id, id, kind, number, front, back): cards of the blocks that ask for some.

    Clozes give a card for each number; else ``question:: answer`` gives one; else
    the first words in bold are hidden; else the text itself is to be recalled.
    """
    asked = blocks.where(F.expr(markup.has_card_tag("text"))).select("page_id", "id", "ord", F.expr(markup.without_card_tag("text")).alias("t")).dropDuplicates(["id", "t"])
    kinds = asked.withColumn("numbers", F.expr(markup.cloze_numbers("t"))).withColumn(
        "kind", F.expr(r"case when size(numbers) > 0 then 'cloze' when t rlike r'^.+?\S::\s+\S' then 'qa' when t rlike r'\*\*[^*]+\*\*' then 'bold' else 'recall' end")
    )
    each = kinds.withColumn("number", F.explode(F.expr("if(kind = 'cloze', numbers, array(0))")))
    front = f"""case kind when 'cloze' then {cloze.side('t', 'number')} when 'qa' then trim(regexp_extract(t, r'^(.+?)::', 1))
      when 'bold' then regexp_replace(t, r'\\*\\*[^*]+\\*\\*', '[...]') else substring_index(t, ' ', 3) || ' …' end"""
    back = f"""case kind when 'cloze' then {cloze.shown('t')} when 'qa' then trim(regexp_extract(t, r'::\\s+(.*)$', 1)) else t end"""
    return each.select(F.concat_ws(":", "id", "number").alias("card_id"), "id", "kind", "number", F.expr(front).alias("front"), F.expr(back).alias("back"))


def block_cards(asked: DataFrame) -> DataFrame:
    """(card_id, id, kind, number, front, back) of (id, type, text, title, context): the cards that a note's blocks ask for.

    Clozes give a card for each number, ``question :: answer`` or a question and the lines below it one.  Else the text
    is clozed where something is worth hiding, and else it is to be recalled from the page's title, as every block is
    that is no text.  An empty text gives none.
    """
    base = asked.select("id", "type", F.expr(markup.without_card_tag("coalesce(text, '')")).alias("t"), F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit("Untitled")).alias("title"), F.expr(markup.without_card_tag("coalesce(context, '')")).alias("about"))
    made = cloze.with_heuristic_clozes(base, "t", "guess").withColumn("numbers", F.expr(cloze.numbers("t")))
    question = r"regexp_extract(t, r'(?s)^(.+?)\s::\s', 1)"
    answer = r"regexp_extract(t, r'(?s)^.+?\s::\s(.*)$', 1)"
    asks = r"(trim(substring_index(t, '\n', 1)) like '%?' and locate('\n', t) > 1 and trim(substring(t, locate('\n', t) + 1)) <> '')"
    kind = F.expr(f"case when type <> 'text' then 'recall' when size(numbers) > 0 then 'cloze' when trim({question}) <> '' and trim({answer}) <> '' then 'qa' when {asks} then 'lines' when t = '' then null when guess is not null then 'guess' else 'recall' end")
    # no card where there is no way to ask: a filter on that would be pushed down and make all guesses again
    each = made.withColumn("how", kind).withColumn("number", F.explode(F.expr(f"case when how = 'cloze' then numbers when how = 'guess' then {cloze.numbers('guess')} when how is not null then array(0) end")))
    recalled = "concat('Recall: **', title, '**', if(about = '', '', concat('\n\n', about)))"
    front = f"case how when 'cloze' then t when 'guess' then guess when 'qa' then trim({question}) when 'lines' then trim(substring_index(t, '\n', 1)) else {recalled} end"
    back = f"case how when 'qa' then trim({answer}) when 'lines' then trim(substring(t, locate('\n', t) + 1)) when 'recall' then case when t = '' then '' when type = 'math' then concat('$$\n', t, '\n$$') when type = 'code' then concat('```\n', t, '\n```') else t end end"
    return each.select(F.concat_ws(":", "id", "number").alias("card_id"), "id", F.expr("if(how in ('cloze', 'guess'), 'cloze', 'basic')").alias("kind"), "number", F.expr(front).alias("front"), F.expr(back).alias("back"))


def sync_cards(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """(card_id, change): what brings stored cards (card_id, front, back) in line with wanted ones: new, changed, gone or kept.

    Of several versions of a card the least counts on either side.
    """
    version = F.min(F.struct("front", "back"))
    a = stored.groupBy("card_id").agg(version.alias("was"))
    b = wanted.groupBy("card_id").agg(version.alias("is"))
    change = F.expr("case when was is null then 'new' when is is null then 'gone' when was = is then 'kept' else 'changed' end")
    return a.join(b, "card_id", "full_outer").select("card_id", change.alias("change"))


def study_queue(cards: DataFrame, introduced: int, now: str, new_cap: int = 20, review_cap: int = 200, ahead_minutes: int = 20, day_hour: int = 4) -> DataFrame:
    """(bucket, place, id): what to study now: 0 learning steps due, 1 reviews of the day, 2 new cards, 3 steps due soon.

    Suspended cards stay out.  New cards go by age up to the day's allowance, which
    ``introduced`` ones have used; reviews go by date up to their cap.  Each bucket with
    a cap is an ordered limit, so that no task holds a whole bucket; a place is counted
    after the caps, and steps due within minutes are few.
    """
    at = F.to_timestamp(F.lit(now))
    tomorrow = F.date_trunc("day", at - F.expr(f"interval {day_hour} hours")) + F.expr(f"interval 1 day {day_hour} hours")
    live = cards.where("not suspended")
    steps = live.where(F.col("state").isin("learning", "relearning"))
    due = steps.where(F.col("due") <= at).select(F.lit(0).alias("bucket"), "id", F.col("due").alias("by"))
    soon = steps.where((F.col("due") > at) & (F.col("due") <= at + F.expr(f"interval {ahead_minutes} minutes"))).select(F.lit(3).alias("bucket"), "id", F.col("due").alias("by"))
    reviews = live.where((F.col("state") == "review") & (F.col("due") < tomorrow)).orderBy("due", "id").limit(review_cap).select(F.lit(1).alias("bucket"), "id", F.col("due").alias("by"))
    new = live.where("state = 'new'").orderBy("created_at", "id").limit(max(0, new_cap - introduced)).select(F.lit(2).alias("bucket"), "id", F.col("created_at").alias("by"))
    every = due.unionByName(reviews).unionByName(new).unionByName(soon)
    return every.withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("by", "id"))).select("bucket", "place", "id")


def card_stats(cards: DataFrame, now: str, day_hour: int = 4) -> DataFrame:
    """(what, n): cards by state, suspended ones, leeches, and those due on each of the next seven review days, overdue ones on the first."""
    today = F.to_date(F.to_timestamp(F.lit(now)) - F.expr(f"interval {day_hour} hours"))
    day = F.greatest(F.lit(0), F.datediff(F.to_date(F.col("due") - F.expr(f"interval {day_hour} hours")), today))
    due = F.when(~F.col("suspended") & (F.col("state") != "new") & (day < 7), F.concat(F.lit("day "), day.cast("string")))
    what = F.array(F.lit("total"), F.col("state"), F.when(F.col("suspended"), F.lit("suspended")), F.when(F.col("leech"), F.lit("leeches")), due)
    return cards.select(F.explode(F.filter(what, lambda w: w.isNotNull())).alias("what")).groupBy("what").agg(F.count("*").alias("n"))
