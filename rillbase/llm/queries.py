"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rillbase.llm import chunk_store, cotraining, decontaminate, line_rules, ngram, packing, simhash, suffixes, token_counts, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op10_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.quality_rules(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op3_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_store.round_trip(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram.score_texts(table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_packing, op3_cotraining, op4_chunk_store, op5_decontaminate, op6_ngram_scores, op7_simhash, op8_token_counts, op9_warc, op10_line_rules)}
ORACLE_SQL: dict[str, str] = {"op10_line_rules": line_rules.ORACLE}
