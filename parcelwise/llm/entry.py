"""The queries of this package, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelwise.llm import byte_bpe, filter_audit, jaccard_join, language_id, line_dedup, media_columns, merkle_manifest, packing, quality_classifier, quality_rules, substring_dedup, token_counts, warc

BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = token_counts.encoded_lengths(_documents(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN)
    return token_counts.suffix_sums(token_counts.length_histogram(lengths))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_spread_lines(_documents(spark, sf_dir), count_col="removed_lines").select("doc_id", "text", "removed_lines")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_documents(spark, sf_dir))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns.digests(media_columns.store(_documents(spark, sf_dir)))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are the sources, and the paths of a source its languages."""
    docs, good = _documents(spark, sf_dir), (F.col("quality") == 1) & (F.col("toxic") == 0)
    model = quality_classifier.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), good)
    return quality_classifier.classify(docs, model, F.col("source"), F.col("lang"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return language_id.predict(docs, language_id.fit(docs))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir), spans_col="removed").select("doc_id", "text", "removed")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality_rules.apply(docs, quality_rules.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), WORD_BPE)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(_documents(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN)


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(_documents(spark, sf_dir))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_line_dedup": op2_line_dedup,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_media_columns": op4_media_columns,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_language_id": op6_language_id,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_quality_rules": op8_quality_rules,
        "op9_packing": op9_packing,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_warc": op11_warc,
        "op12_merkle_manifest": op12_merkle_manifest,
        "op13_filter_audit": op13_filter_audit,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.SQL, "op11_warc": warc.SQL, "op12_merkle_manifest": merkle_manifest.SQL, "op13_filter_audit": filter_audit.SQL}
