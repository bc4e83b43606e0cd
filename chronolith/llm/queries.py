"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import op1_toxicity, op2_lm, op3_quality, op4_ngram_join, op5_langid, op6_exact, op7_shards, op8_warc, op9_packing, op10_mix
from .common import read


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_quality.assess(read(spark, sf_dir, "documents"), with_text=False)


def op1_toxicity_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_lm.score_documents(read(spark, sf_dir, "documents"))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_ngram_join.join_classes(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_langid.identify(read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_exact.dedup(read(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op7_shards.shard_documents(read(spark, sf_dir, "documents"))


def op8_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_warc.round_trip(read(spark, sf_dir, "pages"))


def op9_length_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_packing.pack(read(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_mix.mix(read(spark, sf_dir, "documents")).drop("source")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity_restored, op2_lm_scoring, op3_quality_rules, op4_ngram_jaccard_join, op5_language_id, op6_exact_dedup, op7_sharding, op8_warc_normaliser, op9_length_packing, op10_mixing)}
SQL: dict[str, str] = {"op3_quality_rules": op3_quality.SQL, "op4_ngram_jaccard_join": op4_ngram_join.SQL, "op6_exact_dedup": op6_exact.SQL, "op8_warc_normaliser": op8_warc.SQL, "op10_mixing": op10_mix.SQL}
