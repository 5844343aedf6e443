"""Entity resolution and suggestions: concept candidates, bibliographic matches, keyphrases, summaries."""

from __future__ import annotations

import math
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions import cite
from ..functions import text as tx

#: Words that do not count in an acronym, and a plural's ending.
MINOR = "of the a an and for in on to with by at from".split()
#: Plurals that follow no rule, and words that only look like one.
IRREGULAR = dict(
    matrices="matrix", indices="index", vertices="vertex", analyses="analysis", hypotheses="hypothesis", theses="thesis", axes="axis", criteria="criterion",
    phenomena="phenomenon", children="child", people="person", mice="mouse", men="man", women="woman", series="series", species="species", bias="bias", alias="alias",
    atlas="atlas", canvas="canvas", gas="gas",
)
#: Rows of a block that are all compared; a larger block is compared with its nearest neighbours in order.
WHOLE_BLOCK, NEAR = 120, 12


def singular(w: str) -> str:
    """SQL for a word without its English plural."""
    known = "map(" + ", ".join(f"'{k}', '{v}'" for k, v in IRREGULAR.items()) + ")"
    return (
        f"if({w} in ({tx.quoted(IRREGULAR)}), {known}[{w}], case when length({w}) <= 3 or not {w} like '%s' then {w} when {w} rlike 'ies$' and length({w}) > 4 then concat(left({w}, length({w}) - 3), 'y') "
        f"when {w} rlike '(sses|(x|ch|sh|zz)es)$' then left({w}, length({w}) - 2) when {w} rlike '(ss|us|is|ics)$' then {w} else left({w}, length({w}) - 1) end)"
    )


def stem(w: str) -> str:
    """SQL for a word folded, without its plural; folded once, as ``singular`` reads its word many times."""
    return f"transform(array({tx.fold(w)}), f_ -> {singular('f_')})[0]"


def concept_tokens(title: str) -> str:
    """SQL for the words of a name as names are compared: folded, singular; the plural of capitals loses its s alone."""
    capitals = r"w rlike r'^[\p{Lu}\p{N}]*\p{Lu}[\p{Lu}\p{N}]*s$' and length(w) >= 3"
    word = f"if({capitals}, {tx.fold('left(w, length(w) - 1)')}, {stem('w')})"
    return f"transform(regexp_extract_all({title}, r'{tx.WORD}', 0), w -> {word})"


def jaro_winkler(a: str, b: str) -> float:
    """Shared characters within half a length, less transpositions, with credit for a shared start of up to four."""
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, found = set(), []
    for i, c in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if j not in used and b[j] == c), None)
        if j is not None:
            used.add(j)
            found.append(c)
    if not found:
        return 0.0
    moved = sum(x != b[j] for x, j in zip(found, sorted(used))) / 2
    m = len(found)
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    start = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        start += 1
    return jaro + 0.1 * start * (1 - jaro)


def token_set_similarity(a: list[str], b: list[str]) -> float:
    """The share of words that two names have in common; long words may be spelt alike, each is used once, in order."""
    if not a or not b:
        return 0.0
    free, shared = list(b), 0
    for x in a:
        alike = next((y for y in free if x == y or min(len(x), len(y)) >= 4 and jaro_winkler(x, y) >= 0.92), None)
        if alike is not None:
            free.remove(alike)
            shared += 1
    return shared / (len(a) + len(b) - shared)


@F.pandas_udf(T.StructType().add("jw", T.DoubleType()).add("words", T.DoubleType()))
def likeness(a: pd.Series, b: pd.Series, x: pd.Series, y: pd.Series) -> pd.DataFrame:
    """Of two names and their words: how alike they are as a whole, and by words."""
    whole = [jaro_winkler(p, q) for p, q in zip(a, b)]
    return pd.DataFrame({"jw": whole, "words": [token_set_similarity(list(p), list(q)) for p, q in zip(x, y)]}).astype("float64")


def merge_candidates(concepts: DataFrame, min_score: float = 0.85) -> DataFrame:
    """(a, b, reason, score): pairs of concept titles that may mean the same, each pair once.

    Titles meet in blocks: a token's first three letters, the sorted tokens, the
    initials.  Blocks of up to 120 are compared whole and larger ones with eleven
    neighbours each, so no block makes pairs with the square of its size.
    """
    shaped = (
        concepts.select("title", F.expr(concept_tokens("title")).alias("tokens"))
        .where("size(tokens) > 0")
        .select(
            "title",
            "tokens",
            F.array_join("tokens", " ").alias("norm"),
            F.array_join(F.array_sort("tokens"), " ").alias("bag"),
            F.expr(f"array_join(transform(filter(tokens, t -> t not in ({tx.quoted(MINOR)})), t -> left(t, 1)), '')").alias("initials"),
            F.expr("regexp_replace(title, '[^0-9]', '')").alias("digits"),
            F.expr(r"size(tokens) = 1 and regexp_replace(title, r'[^\p{L}\p{N}]', '') rlike r'^[\p{Lu}\p{N}]{2,8}s?$' and title rlike r'\p{Lu}'").alias("short"),
        )
    )
    keys = "concat(transform(tokens, t -> concat('p:', left(t, 3))), array(concat('s:', bag)), if(size(tokens) > 1, array(concat('a:', initials)), array()), if(short, array(concat('a:', norm)), array()))"
    placed = shaped.select("*", F.explode(F.array_distinct(F.expr(keys))).alias("key"))
    of = Window.partitionBy("key")
    placed = placed.withColumns({"n": F.count("*").over(of), "place": F.row_number().over(of.orderBy("norm", "title"))})
    # neighbours by place: an equi-join on the place keeps large blocks linear
    reach = F.when(F.col("n") <= WHOLE_BLOCK, F.col("n")).otherwise(NEAR)
    ahead = placed.select("*", F.explode(F.expr(f"sequence(place + 1, place + if(n <= {WHOLE_BLOCK}, n - place, {NEAR - 1}))")).alias("other")).where(
        (F.col("place") < F.col("n")) & (F.col("other") <= F.col("n")) & (F.col("other") > F.col("place")) & reach.isNotNull()
    )
    cols = ["title", "tokens", "norm", "bag", "initials", "digits", "short"]
    b = placed.select(F.col("key").alias("bkey"), F.col("place").alias("bplace"), *[F.col(c).alias(f"b_{c}") for c in cols])
    pairs = ahead.join(b, (F.col("key") == F.col("bkey")) & (F.col("other") == F.col("bplace"))).where("digits = b_digits")
    pairs = pairs.select(*cols, *[f"b_{c}" for c in cols]).dropDuplicates(["title", "b_title"])
    acronym = (F.col("short") & (F.col("norm") == F.col("b_initials"))) | (F.col("b_short") & (F.col("b_norm") == F.col("initials")))
    reason = F.when(F.col("norm") == F.col("b_norm"), "variant").when(F.col("bag") == F.col("b_bag"), "word-order").when(acronym, "acronym")
    pairs = pairs.withColumn("reason", reason).withColumn("least", F.least(F.length("norm"), F.length("b_norm")))
    named = pairs.where("reason is not null").select("title", "b_title", "reason", F.when(F.col("reason") == "variant", 1.0).when(F.col("reason") == "word-order", 0.95).otherwise(0.9).alias("score"))
    # only what is left is compared letter by letter, and only where the lengths allow it
    same_size = F.size("tokens") == F.size("b_tokens")
    left = pairs.where(F.col("reason").isNull() & (F.col("least") >= 4) & (same_size | (F.col("least") >= 0.6 * F.greatest(F.length("norm"), F.length("b_norm")))))
    left = left.withColumn("like", likeness("norm", "b_norm", "tokens", "b_tokens")).select("*", "like.jw", "like.words")
    typo = (F.col("least") >= 5) & (F.col("jw") >= 0.94) & same_size & (F.levenshtein("norm", "b_norm") <= 1)
    close = (F.col("jw") >= F.when(F.col("least") < 7, 0.96).otherwise(0.92)) & (F.col("words") >= 0.5)
    score = F.when(typo, 0.9).when(close, F.least(F.lit(0.89), 0.6 * F.col("jw") + 0.4 * F.col("words"))).when((F.col("words") >= 0.99) & same_size, 0.88)
    spelt = left.withColumn("score", score).select("title", "b_title", F.when(typo, "typo").otherwise("similar").alias("reason"), "score")
    return (
        named.unionByName(spelt).withColumn("score", F.round("score", 6))
        .where(F.col("score") >= min_score)
        .select(F.least("title", "b_title").alias("a"), F.greatest("title", "b_title").alias("b"), "reason", "score")
        .where("a <> b")
        .dropDuplicates(["a", "b"])
    )


def without_dismissed(pairs: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Candidate pairs but for those that were turned down, in either order."""
    gone = dismissed.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return pairs.join(gone, ["a", "b"], "left_anti")


def cite_keys(records: DataFrame) -> DataFrame:
    """(id, cite_key): base keys made unique by a, b, … in the order of ids; the first keeps the bare key."""
    based = records.select("id", F.expr(cite.base_key("last", "year", "title")).alias("base"))
    n = F.row_number().over(Window.partitionBy("base").orderBy("id"))
    letter = F.expr("case when n = 1 then '' when n <= 27 then char(95 + n) else concat(char(96 + cast((n - 28) div 26 as int) + 1), char(97 + cast((n - 28) % 26 as int))) end")
    return based.withColumn("n", n).select("id", F.concat("base", letter).alias("cite_key"))


def bib_match(entries: DataFrame, sources: DataFrame) -> DataFrame:
    """(entry_id, source_id, how): the source that each entry of a bibliography names, read in the order of their ids.

    An entry names the source of its own id (``ref``), else of its cite key in any case, of its DOI, of its title and
    year, or the only one of its title; of several sources the last counts.  An entry whose source an earlier one has
    named is passed over: it does not look further.  Both tables have id, doi, title and year; entries may have ref and
    key, sources key.
    """
    doi, title = cite.normalize_doi("doi"), cite.title_key("title")
    has = lambda d, c: F.col(c) if c in d.columns else F.lit(None).cast("string")
    shape = lambda d: d.select(
        "id", F.expr(doi).alias("doi"), F.expr(title).alias("tk"), F.expr(f"concat({title}, '|', coalesce(cast(year as string), ''))").alias("ty"),
        F.lower(has(d, "key")).alias("key"), has(d, "ref").cast("string").alias("ref"),
    )
    e, s = shape(entries), shape(sources).withColumn("ref", F.col("id").cast("string"))
    ways = (("ref", "id"), ("key", "cite key"), ("doi", "doi"), ("ty", "title-year"), ("tk", "title"))
    found = None
    for rank, (column, how) in enumerate(ways):
        last = s.where(f"{column} <> ''").groupBy(column).agg(F.max("id").alias("source_id"), F.count("*").alias("n")).where("n = 1" if column == "tk" else "true")
        met = e.join(last, column).select(F.col("id").alias("entry_id"), F.struct(F.lit(rank).alias("rank"), "source_id", F.lit(how).alias("how")).alias("way"))
        found = met if found is None else found.unionByName(met)
    first = found.groupBy("entry_id").agg(F.min("way").alias("way"))
    return first.groupBy(F.col("way.source_id").alias("source_id")).agg(F.min(F.struct("entry_id", "way.how")).alias("e")).select("e.entry_id", "source_id", "e.how")


#: Rows that a worker sends back at a time.
BATCH = 100_000
#: Repeated ids that go along with the plan; more are joined.
FEW = 500_000


def by_document(docs: DataFrame) -> DataFrame:
    """(doc_id, texts): the texts of each id; only ids that come more than once are gathered, so other texts are not shuffled."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    again = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("of"))
    again = F.broadcast(again) if again.limit(FEW + 1).count() <= FEW else again
    same = F.col("doc_id").eqNullSafe(F.col("of"))
    several = docs.join(again, same, "left_semi").groupBy("doc_id").agg(F.collect_list("text").alias("texts"))
    return docs.join(again, same, "left_anti").select("doc_id", F.array("text").alias("texts")).unionByName(several)


def phrase_counts(texts: list[str]) -> Counter:
    """How often one to three words stand side by side in texts of words with a blank between, where an empty word parts."""
    counts: Counter = Counter()
    for t in texts:
        w = t.split(" ")
        counts.update(filter(None, w))
        counts.update([f"{a} {b}" for a, b in zip(w, w[1:]) if a and b])
        counts.update([f"{a} {b} {c}" for a, b, c in zip(w, w[1:], w[2:]) if a and b and c])
    return counts


def with_words(docs: DataFrame) -> DataFrame:
    """(doc_id, words): for each text of a document its words with a blank between, stop words and single letters empty."""
    kept = f"array_join(transform({tx.terms('t')}, w -> if(w in ({tx.quoted(tx.STOP_WORDS)}) or length(w) < 2, '', w)), ' ')"
    return by_document(docs).select("doc_id", F.expr(f"transform(texts, t -> {kept})").alias("words"))


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, phrase, n): one to three words side by side with no stop word between; a document is counted where it is read."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            ids, words = batch.columns
            at, counts = [], []
            for i in range(batch.num_rows):
                counts.append(phrase_counts(words[i].as_py()))
                at += [i] * len(counts[-1])
                if len(at) > BATCH or i + 1 == batch.num_rows:
                    phrases, n = (pa.array([x for c in counts for x in getattr(c, side)()], t) for side, t in (("keys", pa.string()), ("values", pa.int64())))
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), phrases, n], names=["doc_id", "phrase", "n"])
                    at, counts = [], []

    return with_words(docs).mapInArrow(run, f"doc_id {kind}, phrase string, n long")


def keyphrases(docs: DataFrame, top: int = 5) -> DataFrame:
    """(doc_id, rank, phrase, score): a document's best phrases by count, length and how common their words are."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = pa.list_(pa.struct([("phrase", pa.string()), ("n", pa.int64()), ("size", pa.int64()), ("total", pa.int64())]))

    def run(batches):
        for batch in batches:
            ids, words = batch.columns
            for at in range(0, batch.num_rows, 256):
                rows = []
                for w in words[at : at + 256]:
                    counts = phrase_counts(w.as_py())
                    parts = ((p, n, p.split(" ")) for p, n in counts.items() if n > 1)
                    rows.append([{"phrase": p, "n": n, "size": len(own), "total": sum(counts[x] for x in own)} for p, n, own in parts])
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), pa.array(rows, found)], names=["doc_id", "found"])

    counted = with_words(docs.where("doc_id is not null")).mapInArrow(run, f"doc_id {kind}, found array<struct<phrase:string,n:bigint,size:bigint,total:bigint>>")

    def ranked(p):
        score = p["n"] * (1 + 0.6 * (p["size"] - 1)) + 0.3 * (p["total"] / p["size"]) - F.when((p["size"] == 1) & (F.length(p["phrase"]) < 5), 1).otherwise(0)
        return F.struct((-F.round(score, 6)).alias("score"), (-F.length(p["phrase"])).alias("length"), p["phrase"].alias("phrase"))

    best = counted.select("doc_id", F.posexplode(F.slice(F.array_sort(F.transform("found", ranked)), 1, top)).alias("at", "p"))
    return best.select("doc_id", (F.col("at") + 1).alias("rank"), "p.phrase", (0 - F.col("p.score")).alias("score"))


def summarize(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, summary): the sentences with the commonest words, early ones favoured, in the text's order."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = r"filter(split(regexp_replace(t, r'\s+', ' '), r'(?<=[.!?])\s+(?=[A-Z0-9])'), s -> length(s) > 1)"
    told = f"array_join(filter({tx.terms('p.s')}, w -> length(w) > 2 and w not in ({tx.quoted(tx.STOP_WORDS)})), ' ')"
    parts = by_document(docs).select("doc_id", F.expr(f"flatten(transform(texts, t -> transform({cut}, (s, i) -> struct(i, s))))").alias("parts"))
    parts = parts.where("size(parts) > 0").select("doc_id", "parts", F.expr(f"transform(parts, p -> {told})").alias("words"))

    def weights(places: list[int], words: list[list[str]]) -> list[float]:
        tf = Counter(x for w in words for x in w)
        most, sums, sizes = max(tf.values(), default=0), Counter(), Counter()
        for i, w in zip(places, words):
            sums[i] += sum(tf[x] / most for x in w)
            sizes[i] += len(w)
        return [sums[i] / math.sqrt(sizes[i]) if sizes[i] else 0.0 for i in places]

    def run(batches):
        for batch in batches:
            ids, own, words = batch.columns
            for at in range(0, batch.num_rows, 256):
                made = [weights([p["i"] for p in o.as_py()], [t.split() for t in w.as_py()]) for o, w in zip(own[at : at + 256], words[at : at + 256])]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 256), own.slice(at, 256), pa.array(made, pa.list_(pa.float64()))], names=["doc_id", "parts", "weights"])

    weighed = parts.mapInArrow(run, f"doc_id {kind}, parts array<struct<i:int,s:string>>, weights array<double>")
    early = "case when p.i = 0 then 0.25D when p.i < 3 then 0.1D else 0D end"
    scored = f"zip_with(parts, weights, (p, w) -> struct(-round(if(doc_id is null, 0D, w) + {early}, 6) as score, p.i as i, p.s as s))"
    best = F.expr(f"array_sort(transform(slice(array_sort({scored}), 1, {n}), x -> struct(x.i as i, x.s as s)))")
    return weighed.select("doc_id", F.array_join(F.transform(best, lambda x: x["s"]), " ").alias("summary"))
