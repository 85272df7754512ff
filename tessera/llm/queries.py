"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, codes, convs, jaccard, license, mil, mixing, neardup, private, rules, shard, spans, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.assign(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digest(bpe.encode(_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mil.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_warc_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.drill(_table(spark, sf_dir, "pages"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.embedding_near_dedup(_table(spark, sf_dir, "embeddings"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.substring_dedup(_table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(_table(spark, sf_dir, "documents"))


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private.personal_data(_table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.vector_codes(_table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convs.conversation_repair(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {
        "op1_sharding": op1_sharding,
        "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
        "op3_mixing": op3_mixing,
        "op4_quality_rules": op4_quality_rules,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_warc_fixity_audit": op7_warc_fixity_audit,
        "op8_embedding_near_dedup": op8_embedding_near_dedup,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_license_scan": op10_license_scan,
        "op11_personal_data": op11_personal_data,
        "op12_vector_codes": op12_vector_codes,
        "op13_conversation_repair": op13_conversation_repair,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_sharding": shard.SQL,
        "op2_ngram_jaccard_join": jaccard.SQL,
        "op3_mixing": mixing.SQL,
        "op4_quality_rules": rules.SQL,
        "op7_warc_fixity_audit": warc.SQL,
        "op8_embedding_near_dedup": neardup.SQL,
        "op10_license_scan": license.SQL,
        "op12_vector_codes": codes.SQL,
        "op13_conversation_repair": convs.SQL,
    }
