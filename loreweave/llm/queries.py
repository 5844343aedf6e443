"""The query of each operator over its whole table, by the name it is registered under."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, chat, decontaminate, lm_score, ngram_join, pii, quality, secret_scan, simhash, structure, suffix_dedup, token_count, whitening
from .common import table


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def spans(column: str, keep: str = "true") -> F.Column:
    """The digest of an array of spans: kind:start:end, comma-joined."""
    return F.expr(f"array_join(transform(filter({column}, s -> {keep}), s -> concat_ws(':', s.kind, s.start, s.end)), ',')")


def counted(column: str, kind: str, keep: str) -> F.Column:
    return F.expr(f"size(filter({column}, s -> s.kind = '{kind}' and {keep}))").cast("long").alias(f"n_{kind}")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), drop=("text",))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality.quality_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(documents(spark, sf_dir), drop=("text",))
    base = "not s.disguised"
    return found.select(
        "doc_id",
        *[counted("pii", k, base) for k in pii.KINDS],
        F.sha2(spans("pii", base), 256).alias("base_sha256"),
        spans("pii").alias("spans"),
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(documents(spark, sf_dir), drop=("text",))
    base = "s.kind <> 'model'"
    return found.select(
        "doc_id",
        *[counted("secrets", k, base) for k in secret_scan.KINDS],
        F.sha2(spans("secrets", base), 256).alias("base_sha256"),
        spans("secrets").alias("spans"),
    )


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.repair_roles(turns).drop("text")


def op6_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_codec.encode(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), drop=("text",))
    return digests(coded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def digests(coded: DataFrame) -> DataFrame:
    return (
        coded.withColumn("n_tokens", F.size("ids").cast("long"))
        .withColumn("ids_sha256", F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256))
        .withColumn("decoded_sha256", F.sha2("decoded", 256))
        .drop("ids", "decoded")
    )


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return cut.select(
        F.col("id").alias("doc_id"),
        "n_bytes",
        F.expr("aggregate(removed, 0L, (n, s) -> n + s.end - s.start)").alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("simhash"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_documents(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"), drop=("text",))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select(
        "doc_id",
        F.col("leak.item").alias("item_id"),
        F.col("leak.shingles").cast("long").alias("n_shingles"),
        F.col("leak.found").cast("long").alias("n_found"),
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return found.select("id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")).select(
        F.col("id").alias("vec_id"), F.expr("at + 1").alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error"
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = structure.repair_structure(structure.damaged(turns))
    every = turns.select("conv_id").groupBy("conv_id").agg(F.lit(1).alias("one")).join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    gaps = F.when(F.col("audit").isNull(), F.lit(0).cast("long")).otherwise(F.col("gaps")).alias("gaps")
    return every.select("conv_id", gaps, *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similar_documents(documents(spark, sf_dir))
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_quality_rules,
        op3_pii,
        op4_secret_scan,
        op5_chat_format,
        op6_bpe_codec,
        op7_suffix_dedup,
        op8_simhash,
        op9_lm_score,
        op10_decontaminate,
        op11_whitening,
        op12_conversation_repair,
        op13_ngram_join,
    )
}
