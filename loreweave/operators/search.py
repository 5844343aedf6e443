"""Ranked full-text search: postings, expansions and BM25 as joins and aggregations."""

from __future__ import annotations

import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx
from ..sources import scratch

#: BM25 and the weights and bounds of expansions.
K1, B = 1.2, 0.75
EXACT, PREFIX, FUZZY = 1.0, 0.7, 0.5
MAX_TOKENS, MAX_PREFIX, MAX_FUZZY, FUZZY_FROM = 12, 48, 8, 5


def fold(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c)).lower()


def indexed(docs: DataFrame, *more: str) -> DataFrame:
    """(doc_id, boost, dl, tokens) and ``more`` columns: the index terms of each document; documents without any stay, with length 0."""
    own = docs.select("doc_id", "boost", *more, F.expr(tx.index_terms("coalesce(text, '')")).alias("tokens"))
    return own.select("doc_id", "boost", F.size("tokens").alias("dl"), "tokens", *more)


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl, boost): term frequencies, summed within each task before they are shuffled."""
    return (
        indexed(docs)
        .select("doc_id", "boost", "dl", F.explode("tokens").alias("term"))
        .groupBy("term", "doc_id", "dl", "boost")
        .agg(F.count("*").alias("tf"))
    )


#: Postings that a worker sends back at a time, and repeated or outdated documents that go along with a plan.
BATCH, FEW = 100_000, 500_000


def few(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has few rows."""
    return F.broadcast(df) if df.limit(FEW + 1).count() <= FEW else df


def row_postings(held: DataFrame) -> DataFrame:
    """(term, doc_id, tf, dl, boost) of (doc_id, boost, dl, tokens), each document in one row: counted where it is read, nothing is shuffled."""
    kind = held.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            own, words = batch.select(["doc_id", "dl", "boost"]), batch.column("words")
            at, terms, n = [], [], []
            for i in range(batch.num_rows):
                counts = Counter(words[i].as_py().split())
                at += [i] * len(counts)
                terms += counts.keys()
                n += counts.values()
                if len(at) > BATCH or i + 1 == batch.num_rows:
                    rows = own.take(pa.array(at, pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), rows.column(0), pa.array(n, pa.int64()), rows.column(1), rows.column(2)], names=["term", "doc_id", "tf", "dl", "boost"])
                    at, terms, n = [], [], []

    words = F.array_join("tokens", " ").alias("words")  # no term holds a blank
    return held.select("doc_id", "dl", "boost", words).mapInArrow(run, f"term string, doc_id {kind}, tf long, dl int, boost {held.schema['boost'].dataType.simpleString()}")


def kept(df: DataFrame) -> DataFrame:
    """``df`` written to a folder of its own and read again."""
    path = scratch.folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def doc_freq(posts: DataFrame) -> DataFrame:
    """(term, df)."""
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(docs: DataFrame) -> DataFrame:
    """One row: the number of documents and their mean length."""
    return indexed(docs).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


TERMS_A_FILE = 200_000
#: Terms that go into the scan as a filter; with more of them the postings are joined whole.
PUSHED = 10_000


def write_index(docs: DataFrame, path: str) -> None:
    """Postings, the dictionary and corpus statistics as tables under ``path``.

    Postings are dealt out by ranges of terms and sorted, so that the row groups of other terms are not read; the
    dictionary has each term's number of documents, so that no search counts them anew.
    """
    by_term = postings(docs).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
    by_term.write.mode("overwrite").parquet(f"{path}/postings")
    spark = docs.sparkSession
    stored = spark.read.parquet(f"{path}/postings")
    # every search looks through the dictionary: a file for each core at least, and of so many terms at most
    files = max(spark.sparkContext.defaultParallelism, stored.agg(F.approx_count_distinct("term")).first()[0] // TERMS_A_FILE + 1)
    doc_freq(stored).repartitionByRange(files, "term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
    corpus_stats(docs).write.mode("overwrite").parquet(f"{path}/stats")


def read_index(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats")


def search_stored(spark, path: str, queries: list[str], limit: int = 20, prefix: bool = True, fuzzy: bool = True) -> DataFrame:
    """As ``search_index`` over the index under ``path``: the queries' terms are looked up first and then go into the scan of the postings."""
    posts, stats = read_index(spark, path)
    tokens = query_tokens(spark, queries, prefix, fuzzy)
    found = expansions(spark.read.parquet(f"{path}/terms"), tokens)
    rows = found.limit(PUSHED + 1).collect()  # at most 12 x 57 rows a query
    if len(rows) <= PUSHED:
        found = spark.createDataFrame(rows, found.schema)
        posts = posts.where(F.col("term").isin(sorted({r.term for r in rows})))
    return _ranked(posts, stats, found, tokens, limit)


def query_tokens(spark, queries: list[str], prefix: bool = True, fuzzy: bool = True) -> DataFrame:
    """(query_id, grp, token, as_prefix, as_fuzzy): at most twelve different words a query.

    The last word may be a prefix unless white space follows it.
    """
    rows = []
    for q, query in enumerate(queries):
        words = list(dict.fromkeys(tx.terms_of(query)))[:MAX_TOKENS]
        open_end = bool(query) and not query[-1].isspace()
        for g, w in enumerate(words):
            rows.append((q, g, w, prefix and open_end and g == len(words) - 1, fuzzy and len(w) >= FUZZY_FROM))
    return spark.createDataFrame(rows, "query_id int, grp int, token string, as_prefix boolean, as_fuzzy boolean")


def expansions(freq: DataFrame, tokens: DataFrame) -> DataFrame:
    """(query_id, grp, term, weight, df): the terms that each word stands for.

    The words come from a list of queries at the driver, twelve a query, so they
    are broadcast; the dictionary is read once and never collected.
    """
    token = F.col("token")
    # one edit leaves the first or the last half as it is, which is told faster than a distance
    half = "(length(token) - 1) div 2"
    near = (F.abs(F.length("term") - F.length(token)) <= 1) & F.expr(f"left(term, {half}) = left(token, {half}) or right(term, {half}) = right(token, {half})") & F.levenshtein("term", "token", 2).between(0, 2)
    found = freq.join(
        F.broadcast(tokens),
        (F.col("term") == token) | (F.col("as_prefix") & F.col("term").startswith(token)) | (F.col("as_fuzzy") & near),
    ).withColumn(
        "kind",
        F.when(F.col("term") == token, 1).when(F.col("as_prefix") & F.col("term").startswith(token), 2).when(one_edit("term", "token"), 3),
    )
    of = Window.partitionBy("query_id", "grp")
    ranked = (
        found.where("kind is not null")
        .withColumn("better", F.min("kind").over(of))
        .withColumn("place", F.row_number().over(Window.partitionBy("query_id", "grp", "kind").orderBy(F.desc("df"), "term")))
    )
    bound = F.when(F.col("kind") == 2, MAX_PREFIX).when(F.col("kind") == 3, MAX_FUZZY).otherwise(1)
    return ranked.where((F.col("place") <= bound) & ((F.col("kind") < 3) | (F.col("better") == 3))).select(
        "query_id", "grp", "term", F.when(F.col("kind") == 1, EXACT).when(F.col("kind") == 2, PREFIX).otherwise(FUZZY).alias("weight"), "df"
    )


def one_edit(a: str, b: str):
    """One insertion, deletion, substitution or exchange of neighbours apart, or equal."""
    swapped = F.expr(
        f"length({a}) = length({b}) and exists(sequence(1, greatest(1, length({a}) - 1)), i -> "
        f"concat(substr({a}, 1, i - 1), substr({a}, i + 1, 1), substr({a}, i, 1), substr({a}, i + 2)) = {b})"
    )
    return (F.levenshtein(a, b) <= 1) | swapped


def bm25_search(docs: DataFrame, queries: list[str], limit: int = 20, prefix: bool = True, fuzzy: bool = True) -> DataFrame:
    """(query_id, rank, doc_id, score, matched): the best documents of each query, from the documents themselves.

    Texts are cut to terms once.  The dictionary is summed up within each task before it is shuffled, and only the terms
    that the queries stand for become postings.
    """
    held, key = kept(indexed(docs)), ["doc_id", "dl", "boost"]
    # rows alike in these are one document to the postings
    again = few(held.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*[F.col(k).alias(f"of_{k}") for k in key]))
    same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in key]
    several = held.join(again, same, "left_semi").groupBy(*key).agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    each = held.join(again, same, "left_anti").select(*key, "tokens").unionByName(several)
    freq = each.select(F.explode(F.array_distinct("tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    tokens = query_tokens(docs.sparkSession, queries, prefix, fuzzy)
    found = expansions(freq, tokens)
    rows = found.limit(PUSHED + 1).collect()  # at most 12 x 57 rows a query
    if len(rows) <= PUSHED:
        found = docs.sparkSession.createDataFrame(rows, found.schema)
        each = each.withColumn("tokens", F.filter("tokens", lambda t: t.isin(sorted({r.term for r in rows}))))
    posts = each.select(*key, F.explode("tokens").alias("term")).groupBy("term", *key).agg(F.count("*").alias("tf"))
    return _ranked(posts, held.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl")), found, tokens, limit)


def search_index(posts: DataFrame, stats: DataFrame, queries: list[str], limit: int = 20, prefix: bool = True, fuzzy: bool = True) -> DataFrame:
    """(query_id, rank, doc_id, score, matched): the best documents of each query, from postings and statistics.

    Documents that match every word count alone if there are any; otherwise a score
    is cut to the share of words matched, words that the index lacks included.
    """
    tokens = query_tokens(posts.sparkSession, queries, prefix, fuzzy)
    return _ranked(posts, stats, expansions(doc_freq(posts), tokens), tokens, limit)


def _ranked(posts: DataFrame, stats: DataFrame, wanted: DataFrame, tokens: DataFrame, limit: int) -> DataFrame:
    n_groups = tokens.groupBy("query_id").agg(F.count("*").alias("n_groups"))
    scored = (
        posts.join(F.broadcast(wanted), "term")  # at most 12 x 57 rows a query
        .join(F.broadcast(stats))  # one row
        .withColumn("idf", F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("weight"))
        .withColumn(
            "part",
            F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl"))) * F.col("boost"),
        )
        .groupBy("query_id", "doc_id")
        .agg(F.sum("part").alias("score"), F.bit_count(F.bit_or(F.expr("shiftleft(1, grp)"))).cast("long").alias("matched"))
        .join(F.broadcast(n_groups), "query_id")
    )
    # whole matches first: then the limit holds within each task, before a query's hits meet, and only the best meet
    best = Window.partitionBy("query_id").orderBy(F.desc("whole"), F.desc("score"), "doc_id")
    return (
        scored.withColumn("whole", F.col("matched") == F.col("n_groups"))
        .withColumn("score", F.round(F.col("score") * F.col("matched") / F.col("n_groups"), 6))
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= limit)
        .withColumn("any_whole", F.max("whole").over(Window.partitionBy("query_id")))
        .where("whole or not any_whole")
        .select("query_id", "rank", "doc_id", "score", "matched")
    )


def match_all(docs: DataFrame, queries: list[str]) -> DataFrame:
    """(query_id, doc_id): documents with every word of the query, each exact or, from two letters on, as a prefix."""
    rows = []
    for q, query in enumerate(queries):
        words = list(dict.fromkeys(tx.terms_of(query)))[:32]
        rows += [(q, g, w, len(words)) for g, w in enumerate(words)]
    tokens = docs.sparkSession.createDataFrame(rows, "query_id int, grp int, token string, n_groups int")
    found = (F.col("term") == F.col("token")) | ((F.length("token") >= 2) & F.col("term").startswith(F.col("token")))
    posts = postings(docs)
    # words meet the dictionary, each term once; the postings meet the terms found in an equi-join
    terms = posts.select("term").distinct().join(F.broadcast(tokens), found)
    return (
        posts.join(terms, "term")
        .groupBy("query_id", "doc_id", "n_groups")
        .agg(F.countDistinct("grp").alias("matched"))
        .where("matched = n_groups")
        .select("query_id", "doc_id")
    )
