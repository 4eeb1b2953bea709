"""The registered queries of the operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chats, decontam, lang_crf, lexical, licenses, merkle, mixing, quality_crf, simhash, substring, tokens, topk, url_lists
from .common import documents


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_to_targets(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.read_token_files(tokens.write_token_files(documents(spark, sf_dir), tokenizer_path()))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeats(documents(spark, sf_dir))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_crf.predict_held_out(documents(spark, sf_dir))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return url_lists.judge(url_lists.derived_captures(pages), url_lists.derived_entries(pages))


def op7_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chats.maximal_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.embeddings_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op9_mixing": op9_mixing,
    "op10_token_output": op10_token_output,
    "op6_simhash": op6_simhash,
    "op4_substring": op4_substring,
    "op3_language_id": op3_language_id,
    "op1_decontamination": op1_decontamination,
    "op5_licenses": op5_licenses,
    "op2_url_filters": op2_url_filters,
    "op7_chats": op7_chats,
    "op8_top_k": op8_top_k,
    "op11_lexical": lexical.benchmark_search,
    "op12_quality": quality_crf.documents_quality,
    "op13_merkle": merkle.documents_manifest,
}
ORACLES: dict[str, str] = {"op2_url_filters": url_lists.ORACLE, "op7_chats": chats.ORACLE, "op8_top_k": topk.ORACLE, "op11_lexical": lexical.ORACLE, "op13_merkle": merkle.ORACLE}
