"""The subpackage's queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kartoteka.llm import _common as C
from kartoteka.llm import align, bpe, hardneg, langid, licenses, lm, media, neardup, packing, pieces, quality, substrings, toxicity


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_of_documents(C.documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(C.documents(spark, sf_dir)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.licenses_of_documents(C.documents(spark, sf_dir))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(C.documents(spark, sf_dir), k=2)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(C.documents(spark, sf_dir))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_words(C.documents(spark, sf_dir))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(C.documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_of_documents(C.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.with_features(C.documents(spark, sf_dir))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(C.documents(spark, sf_dir))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hardneg.hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment_of_documents(C.documents(spark, sf_dir))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(C.documents(spark, sf_dir))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_license_scan": op3_license_scan,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_toxicity": op8_toxicity,
    "op9_media_columns": op9_media_columns,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_token_alignment": op12_token_alignment,
    "op13_sentencepiece": op13_sentencepiece,
}

ORACLE: dict[str, str] = {
    "op3_license_scan": licenses.oracle(),
    "op11_hard_negatives": hardneg.oracle(),
}
