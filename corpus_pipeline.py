"""The corpus pipeline: from raw documents to encoded ones, a stage at a time."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loreweave.llm import bpe_codec, decontaminate, ngram_join, pii, quality
from loreweave.llm.common import discard, n_stored, stored, table
from loreweave.llm.queries import digests


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays.

    Pairs that SimHash proposes are verified by their shingles first; it misses most near copies at its radius, so a
    join of the shingles themselves adds the rest and loses none.
    """
    return ngram_join.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers in the texts give way to their kind in brackets."""
    return pii.redact_pii(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    coded = bpe_codec.encode(docs.select("doc_id", "text", "lang", "source"), public_tokenizers.path("word_bpe_49k.json"), drop=("text",))
    return digests(coded)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("encoding", encoding),
]
#: Fingerprints, redaction and encoding are not SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage has written on its way goes as soon as its result is written."""
    docs, mark = table(spark, sf_dir, "documents"), n_stored()
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
            discard(spark, mark)
    return docs
