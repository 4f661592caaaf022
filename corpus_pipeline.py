"""Cleaning and packing of a corpus: each stage applies one operator of labelflow.llm to what the
stage before it kept; the results are written as Parquet and read again in between."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelflow.llm import language, minhash, packing, spans, suffix
from labelflow.llm.common import documents, shared_table, text_or_empty
from labelflow.llm.exact_dedup import exact_dedup


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the rows with a language and drops texts that no learnt language explains."""
    return language.keep(docs, language.learn(language.training_rows(docs)))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row with the largest doc_id stays."""
    kept = exact_dedup(docs).where("kept").select("doc_id", "text_sha256").alias("k")
    rows = docs.withColumn("_sha", F.sha2(text_or_empty(), 256)).alias("d")
    same = F.expr("d._sha = k.text_sha256 AND CAST(d.doc_id AS BIGINT) <=> k.doc_id")
    return rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "_sha"]).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (similarity 0.8 or more) the smallest id stays."""
    kept = minhash.near_duplicates(docs, 5, 80, 100).where("kept").select(F.col("rid").alias("_kept_rid"))
    rows = docs.withColumn("_rid", F.xxhash64(F.col("doc_id").cast("long"), text_or_empty()))
    return rows.join(kept, F.col("_rid") == F.col("_kept_rid"), "left_semi").select(*docs.columns)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that start in a smaller document too are cut out of the text."""
    return spans.rewrite(docs, suffix.repeated_spans(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language", language_stage), ("exact dedup", exact_stage), ("near dedup", near_stage),
          ("substring dedup", substring_stage), ("packing", packing_stage)]
ORACLE_SQL = None  # language models and tokenising are beyond SQL; tests/llm has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), f"stage_{name.replace(' ', '_')}")
    return STAGES[-1][1](spark, docs, sf_dir)
