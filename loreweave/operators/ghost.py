"""Tags that a text suggests itself: many concepts matched against many texts at once, at several levels, and scored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources.scratch import folder
from .resolve import MINOR, concept_tokens, singular, stem

#: How far a match counts by its kind, and what is never suggested.
COVERED, LOOSE, FUZZY, SQUASH = 0.3, 0.6, 0.5, 2.5
NEVER = ("flashcard",)
#: Words that a fuzzy match needs, of this length at least.
LONG = 6
#: Words of names of one kind that go along with the plan; with more of them, all words of a text are looked up.
FIRST_WORDS = 1000


def word_df(concepts: DataFrame) -> DataFrame:
    """(word, df): in how many concepts (title, aliases) each word stands, folded and singular."""
    names = concepts.select("title", F.explode(F.expr("concat(array(title), coalesce(aliases, array()))")).alias("name"))
    words = names.select("title", F.explode(F.expr(concept_tokens("name"))).alias("word")).distinct()
    return words.groupBy("word").agg(F.count("*").alias("df"))


def forms(concepts: DataFrame, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(form, concept, title, tokens, n, run, acronym, initials, rarest, common, weight): every name of (title, count, aliases) that can be matched.

    ``form`` is the order in which forms claim words, longer ones first.  ``weight`` is what a single, exact match counts:
    how rare the name's words are among all concepts, its length, and how often the concept is used.  ``rarest`` and
    ``common`` are the words of a name that fewest and most concepts have; stop words only where there are no others.
    """
    numbered = concepts.select(F.xxhash64("title").alias("concept"), "title", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    every = numbered.select("concept", "title", "count", F.posexplode(F.expr("concat(array(title), aliases)")).alias("at", "name"))
    shaped = every.select("concept", "title", "count", "at", "name", F.expr(concept_tokens("name")).alias("tokens")).where("size(tokens) > 0")
    words = word_df(concepts).withColumnRenamed("word", "t")
    total = numbered.agg(F.count("*").alias("total"))
    stop = f"t in ({tx.quoted(tx.STOP_WORDS)})"
    idf = F.when(F.expr(stop), 0.0).otherwise(F.log(1 + F.col("total") / F.col("df")))
    rare = (
        shaped.select("concept", "at", F.size("tokens").alias("n"), F.explode("tokens").alias("t")).join(words, "t").join(F.broadcast(total))  # one row
        .groupBy("concept", "at", "n").agg((F.sum(idf) / F.first("n")).alias("specificity"), F.min_by("t", F.struct(F.expr(stop), "df", "t")).alias("rarest"), F.max_by("t", F.struct(~F.expr(stop), "df", "t")).alias("common"))
    )
    compact = F.regexp_replace("name", r"[^\p{L}\p{N}]", "")
    acronym = F.when((F.size("tokens") == 1) & compact.rlike(r"^\p{Lu}[\p{Lu}\p{N}]{1,7}s?$"), F.regexp_replace(compact, "s$", ""))
    initials = F.expr(f"if(size(tokens) > 1, upper(array_join(transform(filter(tokens, t -> t not in ({tx.quoted(MINOR)})), t -> left(t, 1)), '')), '')")
    run = F.array_join("tokens", " ")
    named = shaped.withColumn("run", run).withColumn("acronym", acronym).withColumn("initials", initials)
    spark = concepts.sparkSession
    out = spark.createDataFrame([(x,) for x in (*NEVER, *exclude)], "name string").select(F.array_join(F.expr(concept_tokens("name")), " ").alias("run"))
    usable = named.join(F.broadcast(out), "run", "left_anti").where(f"exists(tokens, t -> not {stop}) and (acronym is not null or size(tokens) > 1 or length(tokens[0]) >= 3)")
    weight = F.col("specificity") * (1 + 0.25 * (F.col("n") - 1)) * (1 + 0.3 * F.log1p("count"))
    ranked = usable.join(rare, ["concept", "at"]).withColumn("weight", weight)
    # the order need only be total: length, then the name itself
    form = F.struct((-F.col("n")).alias("short"), "title", "at")
    return ranked.select(form.alias("form"), "concept", "title", "tokens", "n", "run", "acronym", "initials", "rarest", "common", "weight")


def text_tokens(text: str) -> str:
    """SQL for the words of a text, folded and singular; a text of ASCII alone needs no folding and a plain pattern."""
    plain = f"transform(regexp_extract_all(lower({text}), r'[a-z0-9]+', 0), w -> {singular('w')})"
    return f"if(octet_length({text}) = length({text}), {plain}, transform(regexp_extract_all({text}, r'{tx.WORD}', 0), w -> {stem('w')}))"


def held(df: DataFrame) -> DataFrame:
    """``df`` written to a shared folder and read again: what several steps read is made once."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def few(df: DataFrame, column: str) -> list[str] | None:
    """The different values of a column, or none if they are more than go along with the plan."""
    found = [r[0] for r in df.select(column).distinct().limit(FIRST_WORDS + 1).collect()]
    return found if len(found) <= FIRST_WORDS else None


def looked_up(known: DataFrame) -> tuple[DataFrame, str]:
    """The names with the ``key`` that they are looked up by, and SQL for a text's keys by its words w and capitals.

    A name of several words has its rarest and its commonest word as one key, which a text has if they stand near each
    other; a single word is its own key, and names in capitals are marked.  Where the commonest words are too many to
    go along with the plan, the rarest word alone is the key.
    """
    phrases, capital = known.where("acronym is null"), known.where("acronym is not null")
    single, several = phrases.where("n = 1"), phrases.where("n > 1")
    reach = 1 + (several.agg(F.max("n")).first()[0] or 0)
    common, words, acronyms = few(several, "common"), few(single, "run"), few(capital, "acronym")
    every = "w"
    if common is not None:
        rare = {r[0] for r in several.where(F.col("rarest").isin(common)).select("rarest").distinct().collect()} if common else set()
        never = [*tx.STOP_WORDS, *(c for c in common if c not in rare)]  # words that are no name's rarest
        around = f"slice(w, greatest(q - {reach}, 0) + 1, q + {reach} + 1 - greatest(q - {reach}, 0))"
        near = f"flatten(transform(filter(sequence(0, size(w) - 1), q -> w[q] in ({tx.quoted(common)})), q -> transform(filter({around}, x -> x not in ({tx.quoted(never)})), x -> concat(x, ' ', w[q]))))"
        alone = "w" if words is None else f"filter(w, x -> x in ({tx.quoted(words)}))" if words else "array()"
        every = f"concat({near}, {alone})" if common else alone
    marked = "capitals" if acronyms is None else f"filter(capitals, x -> x in ({tx.quoted(acronyms)}))" if acronyms else "array()"
    pair = "rarest" if common is None else "concat(rarest, ' ', common)"
    key = F.expr(f"case when acronym is not null then concat('#', acronym) when n = 1 then run else {pair} end")
    return known.withColumn("key", key), f"if(size(w) > 0, array_distinct(concat({every}, transform({marked}, x -> concat('#', x)))), cast(array() as array<string>))"


def suggestions(texts: DataFrame, concepts: DataFrame, most: int = 8, least: float = 0.25, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, tag, score, rank): the best tags for each (doc_id, text), by the concepts that it names.

    A name counts where its words stand side by side; words that a longer name holds already count for little.  A name
    of several words that does not occur so may have them all within a window of two more; its initials count with it.
    A name in capitals is looked for as it is written.  A single long word may differ by one letter.  Repeats count
    with their logarithm.  Null and empty texts get no tags; an id with several texts gets the best of each tag.

    Equal texts (told apart by 64-bit hashes) are read once.  Nothing is compared pairwise: names meet texts by a key of
    two of their words, and single letters are forgiven between the two vocabularies, not between texts and names.
    """
    known = held(forms(concepts, exclude))
    named, keys = looked_up(known)
    docs = held(texts.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    capitals = r"transform(filter(regexp_extract_all(text, r'[\p{L}\p{N}]+', 0), x -> x rlike r'^[\p{Lu}\p{N}]+s?$'), x -> regexp_replace(x, 's$', ''))"
    own = docs.select("text").distinct().select(F.xxhash64("text").alias("u"), F.expr(text_tokens("text")).alias("w"), F.expr(capitals).alias("capitals"))
    own = held(own)

    info = F.struct("concept", "initials", "weight").alias("info")  # what a form is worth goes with it
    hits = own.select("u", F.explode(F.expr(keys)).alias("key")).join(named.select("key", "form", "tokens", "n", "acronym", info), "key").drop("key")
    met = hits.join(own, "u")
    exact = "if(acronym is null and size(w) >= n, filter(sequence(0, size(w) - n), i -> w[i] = tokens[0] and slice(w, i + 1, n) = tokens), cast(array() as array<int>))"
    extra = "if(acronym is not null or length(info.initials) >= 2, size(filter(capitals, x -> x = coalesce(acronym, info.initials))), 0)"
    window = "(n + 2)"
    loosely = f"aggregate(sequence(0, size(w) - 1), struct(0 as next, 0 as n), (a, i) -> if(i >= a.next and array_contains(tokens, w[i]) and size(array_except(tokens, slice(w, i + 1, {window}))) = 0, struct(i + {window} as next, a.n + 1 as n), a), a -> a.n)"
    met = met.withColumn("ats", F.expr(exact)).withColumn("extra", F.expr(extra))
    met = met.withColumn("loose", F.expr(f"case when size(ats) > 0 then 0 when acronym is not null then extra when n > 1 then {loosely} else 0 end"))
    spots = "if(size(ats) > 0, flatten(transform(ats, a -> transform(sequence(a, a + n - 1), p -> struct(a as at, p as place)))), if(loose > 0, array(struct(cast(null as int) as at, cast(null as int) as place)), cast(array() as array<struct<at:int,place:int>>)))"
    words = met.select("u", "form", "info", "loose", "extra", F.expr("acronym is not null").alias("short"), F.explode(F.expr(spots)).alias("s")).select("u", "form", "info", "loose", "extra", "short", "s.*")
    # a word belongs to the first form that claims it; a match none of whose words is its own is covered
    owned = words.withColumn("free", F.col("place").isNotNull() & (F.col("form") == F.min("form").over(Window.partitionBy("u", "place"))))
    by_place = owned.groupBy("u", "form", "info", "loose", "extra", "short", "at").agg(F.max("free").cast("long").alias("free"))
    found = by_place.groupBy("u", "form", "info", "loose", "extra", "short").agg(F.count("at").alias("all"), F.sum("free").alias("free"))
    occ = F.expr("case when short then loose when all = 0 then loose + extra when free > 0 then free + extra else all + extra end").alias("occ")
    quality = F.expr(f"case when short then 1D when all = 0 then {LOOSE}D when free > 0 then 1D else {COVERED}D end").alias("quality")
    found = found.select("u", "form", "info", occ, quality)

    long_ones = known.where(f"acronym is null and n = 1 and length(run) >= {LONG}")
    if long_ones.head(1):
        found = held(found)
        single = long_ones.select("form", info, F.col("run").alias("name"))
        spelt = own.select(F.explode(F.expr(f"array_distinct(filter(w, x -> length(x) >= {LONG}))")).alias("word")).distinct()
        less = lambda c: f"concat(array({c}), transform(sequence(1, length({c})), i -> concat(left({c}, i - 1), substring({c}, i + 1))))"
        near = spelt.select("word", F.explode(F.array_distinct(F.expr(less("word")))).alias("key")).join(single.select("form", "info", "name", F.explode(F.array_distinct(F.expr(less("name")))).alias("key")), "key")
        swapped = "exists(sequence(1, length(word) - 1), i -> concat(left(word, i - 1), substring(word, i + 1, 1), substring(word, i, 1), substring(word, i + 2)) = name)"
        near = near.where(f"word <> name and (levenshtein(word, name) <= 1 or length(word) = length(name) and {swapped})").select("word", "form", "info").distinct()
        place = own.select("u", F.posexplode("w").alias("at", "word")).where(f"length(word) >= {LONG}").join(near, "word").groupBy("u", "form", "info", "word").agg(F.min("at").alias("at"), F.count("*").alias("times"))
        fuzzy = place.groupBy("u", "form", "info").agg(F.min_by("times", "at").alias("occ")).join(found.select("u", "form"), ["u", "form"], "left_anti").withColumn("quality", F.lit(FUZZY))
        found = found.unionByName(fuzzy)

    raw = F.max((1 + F.log(F.col("occ").cast("double"))) * F.col("info.weight") * F.col("quality"))
    best = found.groupBy("u", "info.concept", F.col("form.title").alias("tag")).agg(raw.alias("raw"))
    scored = best.withColumn("score", F.col("raw") / (F.col("raw") + SQUASH)).where(F.col("score") >= least).withColumn("score", F.round("score", 3))
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "tag"))
    listed = scored.withColumn("rank", place("u")).where(F.col("rank") <= most).groupBy("u").agg(F.collect_list(F.struct("tag", "score")).alias("tags"))
    # lists go back to the ids of their texts; an id that comes with several texts has several
    given = docs.select("doc_id", F.xxhash64("text").alias("u")).join(listed, "u").select("doc_id", "tags").repartition("doc_id")
    each = given.select("doc_id", F.explode("tags").alias("t")).groupBy("doc_id", "t.tag").agg(F.max("t.score").alias("score"))
    return each.withColumn("rank", place("doc_id")).where(F.col("rank") <= most).select("doc_id", "tag", "score", "rank")


def tag_list(answer: str) -> str:
    """SQL for the tags of an answer in free words around a JSON array of names or of objects with a tag; bad ones are left out."""
    inside = f"regexp_extract({answer}, r'(?s)(\\[.*\\])', 1)"
    tags = f"transform(from_json({inside}, 'array<string>'), x -> if(x rlike r'^\\s*\\{{', get_json_object(x, '$.tag'), if(x rlike r'^-?[0-9.]+$', null, x)))"
    trimmed = f"transform({tags}, x -> trim(regexp_replace(regexp_replace(x, '^#', ''), r'^\\[\\[|\\]\\]$', '')))"
    return f"coalesce(filter({trimmed}, x -> length(x) between 1 and 80 and not x rlike r'[\\[\\]|\\n]'), cast(array() as array<string>))"


def with_answers(own: DataFrame, answers: DataFrame, concepts: DataFrame, most: int = 8, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, tag, score, origin, existing): tags found here and those of an answer (doc_id, answer), which may name concepts.

    What both have gains 0.2; what only the answer has starts at 0.55 if it is a concept, at 0.4 if not, and loses 0.02
    for each place.  Answers that can't be read add nothing.  Equal answers (told apart by 64-bit hashes) are read once,
    and a row that comes twice counts once.
    """
    norm = lambda c: F.array_join(F.expr(concept_tokens(c)), " ")
    names = concepts.select("title", F.posexplode(F.expr("concat(array(title), coalesce(aliases, array()))")).alias("at", "name")).select("title", "at", norm("name").alias("norm"))
    names = names.where("norm <> ''").groupBy("norm").agg(F.min_by("title", F.struct("at", "title")).alias("title"))
    spark = own.sparkSession
    out = spark.createDataFrame([(x,) for x in (*NEVER, *exclude)], "name string").select(norm("name").alias("key"))
    given = answers.select("doc_id", "answer").where("answer is not null").withColumn("a", F.xxhash64("answer"))
    said = given.select("a", "answer").distinct().select("a", F.posexplode(F.expr(tag_list("answer"))).alias("place", "said")).withColumn("norm", norm("said")).join(names, "norm", "left")
    said = said.select("a", "place", F.coalesce("title", "said").alias("tag"), F.col("title").isNotNull().alias("existing")).withColumn("key", norm("tag"))
    said = said.where("key <> ''").join(F.broadcast(out), "key", "left_anti")
    first = said.groupBy("a", "key").agg(F.min(F.struct("place", "tag", "existing")).alias("s"), F.count("*").alias("n"))
    listed = first.groupBy("a").agg(F.collect_list(F.struct("key", "s", "n")).alias("list"))
    theirs = given.select("doc_id", "a").repartition("a").distinct().join(listed, "a").select("doc_id", "list")
    # lists come to their ids before they are opened; what an id has of one key is put together there
    theirs = theirs.repartition("doc_id").select("doc_id", F.explode("list").alias("l")).select("doc_id", "l.key", "l.s", "l.n", F.lit(None).cast("string").alias("own"), F.lit(None).cast("double").alias("score"))
    ours = own.select("doc_id", norm("tag").alias("key"), F.lit(None).cast(first.schema["s"].dataType).alias("s"), F.lit(0).cast("long").alias("n"), F.col("tag").alias("own"), "score")
    by_key = Window.partitionBy("doc_id", "key").orderBy(F.desc_nulls_last("own"))
    all_of = by_key.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    both = ours.unionByName(theirs).select("doc_id", "own", "score", F.min("s").over(all_of).alias("s"), F.sum("n").over(all_of).alias("n"), F.row_number().over(by_key).alias("at"))
    both = both.where("own is not null or at = 1").select("doc_id", "own", "score", "s.*", "n")
    begin = F.when(F.col("existing"), 0.55).otherwise(0.4) - 0.02 * F.col("place")
    # a name that an answer repeats gains again, as if found
    score = F.when(F.col("own").isNull(), F.least(F.lit(1.0), begin + 0.2 * (F.col("n") - 1))).when(F.col("place").isNull(), F.col("score")).otherwise(F.least(F.lit(1.0), F.col("score") + 0.2 * F.col("n")))
    origin = F.expr("case when own is null then if(n > 1, 'both', 'ai') when place is null then 'graph' else 'both' end")
    every = both.select("doc_id", F.coalesce("own", "tag").alias("tag"), F.round(score, 3).alias("score"), origin.alias("origin"), (F.col("own").isNotNull() | F.coalesce("existing", F.lit(False))).alias("existing"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "tag"))
    return every.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
