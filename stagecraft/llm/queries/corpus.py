"""Queries over ``documents``: packing, deduplication and mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stagecraft.llm import bestfit, exact_dedup, mixing, ngram, packing, simhash, substrings, toxicity
from stagecraft.llm.queries.registry import query
from stagecraft.llm.util import hex64, id_crc
from stagecraft.runtime import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

EXACT_SQL = f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""


@query("op1_pack_sequences")
def pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), added=True).select(
        F.col("id").alias("doc_id"), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query("op4_exact_dedup", EXACT_SQL)
def exact_groups(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


@query("op9_simhash_near_dedup")
def near_groups(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_groups(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), hex64(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query("op10_mix_sources")
def mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op2_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    grammar = toxicity.fit_labels(docs, table(spark, folder, "labels"), held_out=toxicity.is_held_out())
    scored = toxicity.score_documents(docs, grammar)
    return scored.select(F.col("id").alias("doc_id"), toxicity.is_held_out("id").alias("held_out"), "score", "predicted")


@query("op5_lm_scores")
def lm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return ngram.score_documents(table(spark, folder, "documents"), id_crc("doc_id") % 10 == 0).withColumnRenamed("id", "doc_id")


@query("op3_substring_dedup")
def substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


@query("op12_best_fit_packing")
def best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return bestfit.pack(table(spark, folder, "documents")).select(
        F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")
