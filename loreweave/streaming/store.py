"""Tables that a stream keeps up to date: parts are only ever added, and one manifest says which of them count.

A manifest is a small file under a number of its own, written aside and renamed; readers take the highest.  So a reader
sees what was there before a batch or a compaction, or all that is there after it, and a batch that comes twice, by its
number, changes nothing.  A table has one writer at a time: of two, the second's rename fails.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search

#: Parts of the log by document, and the rows of a document from which it is compacted.
BUCKETS, THRESHOLD = 64, 128


def _files(spark: SparkSession, path: str):
    """The file system of a path, whatever it is, and the path in its terms."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, where = _files(spark, path)
    return sorted(f.getPath().getName() for f in fs.listStatus(where)) if fs.exists(where) else []


def current(spark: SparkSession, path: str) -> dict:
    """The newest manifest: its number, the last batch in it, and the parts of each table or bucket."""
    found = [n for n in _names(spark, f"{path}/manifests") if n.endswith(".json")]
    if not found:
        return {"number": 0, "batch": -1, "parts": {}}
    return json.loads(spark.read.text(f"{path}/manifests/{found[-1]}", wholetext=True).first()[0])


def publish(spark: SparkSession, path: str, held: dict, **changed) -> dict:
    """The manifest that follows ``held``; raises if another writer has made one meanwhile."""
    new = held | changed | {"number": held["number"] + 1}
    fs, to = _files(spark, f"{path}/manifests/{new['number']:012d}.json")
    _, aside = _files(spark, f"{path}/manifests/{new['number']:012d}.tmp")
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(new).encode()))
    out.close()
    if fs.exists(to) or not fs.rename(aside, to):
        raise RuntimeError(f"{path} has another writer: manifest {new['number']} is there already")
    return new


def vacuum(spark: SparkSession, path: str) -> None:
    """Remove the manifests before the newest, and parts that it does not name; for when no reader is left on those."""
    held = current(spark, path)
    kept = {p.split("/")[0] for parts in held["parts"].values() for p in parts}
    for folder, keep in (("manifests", {f"{held['number']:012d}.json"}), ("parts", kept)):
        for name in _names(spark, f"{path}/{folder}"):
            if name not in keep:
                fs, where = _files(spark, f"{path}/{folder}/{name}")
                fs.delete(where, True)


# ------------------------------------------------------------------ the update log


def append(batch: DataFrame, number: int, path: str, doc: str = "doc_id", buckets: int = BUCKETS) -> None:
    """A batch of updates as a part of the log, by buckets of documents; for ``foreachBatch``."""
    spark, held = batch.sparkSession, current(batch.sparkSession, path)
    if number <= held["batch"]:
        return
    part = f"b{number:012d}"
    # a bucket with far more rows than others is written by several tasks
    batch.withColumn("bucket", F.expr(f"cast(pmod(xxhash64({doc}), {buckets}) as int)")).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/parts/{part}")
    parts = dict(held["parts"])
    for name in _names(spark, f"{path}/parts/{part}"):
        if name.startswith("bucket="):
            bucket = name.removeprefix("bucket=")
            parts[bucket] = [*parts.get(bucket, []), f"{part}/{name}"]
    publish(spark, path, held, batch=number, parts=parts)


def read_log(spark: SparkSession, path: str, buckets: list[str] | None = None) -> DataFrame | None:
    """The rows of the log, or of some buckets; None if there are none.  Parts that are replaced later stay readable."""
    parts = current(spark, path)["parts"]
    paths = [f"{path}/parts/{p}" for b in (parts if buckets is None else buckets) for p in parts.get(b, [])]
    return spark.read.parquet(*paths) if paths else None


def compact(spark: SparkSession, path: str, merge: Callable[[DataFrame], DataFrame], doc: str = "doc_id", threshold: int = THRESHOLD, buckets: int = BUCKETS) -> int:
    """Rewrite the buckets that hold documents of ``threshold`` rows or more, those merged by ``merge``; how many documents were.

    Other documents of such a bucket keep their rows, and other buckets their parts.
    """
    held, log = current(spark, path), read_log(spark, path)
    if log is None:
        return 0
    long = log.groupBy(doc).agg(F.count("*").alias("rows")).where(F.col("rows") >= threshold).select(doc)
    place = F.expr(f"cast(pmod(xxhash64({doc}), {buckets}) as string)")
    found = long.groupBy(place.alias("bucket")).agg(F.count("*").alias("n")).collect()  # a row a bucket
    if not found:
        return 0
    touched, part = [r.bucket for r in found], f"c{held['number'] + 1:012d}"
    rows = read_log(spark, path, touched)
    merged = merge(rows.join(long, doc, "left_semi")).unionByName(rows.join(long, doc, "left_anti"))
    merged.withColumn("bucket", place.cast("int")).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/parts/{part}")
    written = {n.removeprefix("bucket=") for n in _names(spark, f"{path}/parts/{part}") if n.startswith("bucket=")}
    parts = held["parts"] | {b: [f"{part}/bucket={b}"] if b in written else [] for b in touched}
    publish(spark, path, held, parts=parts)
    return sum(r.n for r in found)


# ------------------------------------------------------------------ the search index


def index_batch(batch: DataFrame, number: int, path: str) -> None:
    """Bring the index in line with a batch of changed documents (doc_id, seq, text, boost); a null text is a document that is gone.

    Only the newest change of a document counts, and only if its signature differs from the stored one.  Postings carry
    the batch as their version; a document's newest version is the one that counts, so nothing is rewritten.
    """
    spark, held = batch.sparkSession, current(batch.sparkSession, path)
    if number <= held["batch"]:
        return
    # changes that are alone need no choice; only the others are gathered
    again = search.few(batch.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("of")))
    same = F.col("doc_id").eqNullSafe(F.col("of"))
    several = batch.join(again, same, "left_semi").groupBy("doc_id").agg(F.max_by(F.struct("text", "boost"), "seq").alias("d")).select("doc_id", "d.*")
    newest = batch.join(again, same, "left_anti").select("doc_id", "text", "boost").unionByName(several)
    signed = newest.withColumn("sig", F.when(F.col("text").isNotNull(), F.md5(F.concat_ws("|", "boost", "text"))))
    known = documents(spark, path, held)
    if known is not None:
        was = known.select("doc_id", F.col("sig").alias("was"), F.lit(True).alias("there"))
        signed = signed.join(was, "doc_id", "left").where("not (sig <=> was)").drop("was", "there")
    else:
        signed = signed.where("sig is not null")
    part = f"b{number:012d}"
    version = F.lit(number).cast("long").alias("version")
    # a text is cut to terms once, and counted once before the postings are dealt out by ranges
    own = search.kept(search.indexed(signed, "sig"))
    own.select("doc_id", "boost", "dl", "sig", version).write.mode("overwrite").parquet(f"{path}/parts/{part}/documents")
    posts = search.kept(search.row_postings(own.where("sig is not null"))).select("*", version)
    posts.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/parts/{part}/postings")
    publish(spark, path, held, batch=number, parts={t: [*held["parts"].get(t, []), f"{part}/{t}"] for t in ("documents", "postings")})


def documents(spark: SparkSession, path: str, held: dict | None = None) -> DataFrame | None:
    """(doc_id, boost, dl, sig, version): the newest version of each document that is in the index; gone ones have no sig."""
    parts = (held or current(spark, path))["parts"].get("documents", [])
    if not parts:
        return None
    every = spark.read.parquet(*[f"{path}/parts/{p}" for p in parts])
    return every.groupBy("doc_id").agg(F.max_by(F.struct("boost", "dl", "sig", "version"), "version").alias("d")).select("doc_id", "d.*")


def counting(spark: SparkSession, path: str, held: dict) -> DataFrame:
    """The postings (with their version) that count: not those of a version that a newer one of its document has replaced."""
    read = lambda t: spark.read.parquet(*[f"{path}/parts/{p}" for p in held["parts"][t]])
    every = read("documents").select("doc_id", "version")
    newest = every.groupBy("doc_id").agg(F.max("version").alias("newest"))
    old = search.few(every.join(newest, "doc_id").where("version < newest").select("doc_id", "version"))
    return read("postings").join(old, ["doc_id", "version"], "left_anti")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, statistics) of the index as it stands, for ``search.search_index``."""
    held = current(spark, path)
    live = documents(spark, path, held).where("sig is not null")
    return counting(spark, path, held).drop("version"), live.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))


def merge_index(spark: SparkSession, path: str) -> None:
    """Put all parts of the index into one, without versions that count no more."""
    held = current(spark, path)
    if not held["parts"]:
        return
    part = f"c{held['number'] + 1:012d}"
    documents(spark, path, held).where("sig is not null").write.mode("overwrite").parquet(f"{path}/parts/{part}/documents")
    posts = counting(spark, path, held)
    posts.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/parts/{part}/postings")
    publish(spark, path, held, parts={t: [f"{part}/{t}"] for t in ("documents", "postings")})
