"""Queries of this subpackage, one per operator, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aspectra.llm.ctw import score_texts
from aspectra.llm.divergence import divergences
from aspectra.llm.fingerprints import fingerprints
from aspectra.llm.language import identify_languages
from aspectra.llm.middle import digests
from aspectra.llm.mixing import mix_sources
from aspectra.llm.neighbours import near_duplicates
from aspectra.llm.packing import pack
from aspectra.llm.personal import find_personal_data
from aspectra.llm.pieces import encoding_digests
from aspectra.llm.quality import score_quality
from aspectra.llm.search import top_inner_products
from aspectra.llm.substrings import remove_repeats


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir), 35)


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), words=2, percent=80)


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(_documents(spark, sf_dir))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), 1024)


def op5_context_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_documents(spark, sf_dir))


def op6_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_kd_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=5, divisor=50)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir), (5, 2, 1), 150, 2)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(_documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_documents(spark, sf_dir))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_digests(_documents(spark, sf_dir))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_documents(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(_documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_packing": op4_packing,
    "op5_context_tree_scoring": op5_context_tree_scoring,
    "op6_quality_nbsvm": op6_quality_nbsvm,
    "op7_kd_tree_search": op7_kd_tree_search,
    "op8_source_mixing": op8_source_mixing,
    "op9_personal_data": op9_personal_data,
    "op10_language_id": op10_language_id,
    "op11_sentencepiece": op11_sentencepiece,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_source_divergence": op13_source_divergence,
}
