"""The corpus pipeline: documents go through five stages, each over all that the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the shared folder and reads it back
as the next stage's documents. All stages but the last return the columns of documents. Stages bound the session's Arrow batches by bytes
(small_batches), unless it has a limit of its own. SQL cannot express the pipeline: the CRF,
the SimHash components, the alignment, the budget fit and the tokenizer are tested against brute-force versions instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusgraph.llm import decontam, lang_crf, mixing, simhash, tokens
from corpusgraph.llm.common import small_batches, write_table
from corpusgraph.llm.queries import tokenizer_path

#: Mean marginal under which no language is taken to be known: none then holds half of the words.
MIN_LANGUAGE_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a known language, with lang as predicted: those without letters, or without a language of half their words, go.

    Null texts go; repeated rows are judged alike. Without a labelled document nothing is judged and all stay as they are.
    """
    small_batches(spark)
    model = lang_crf.fit(docs.filter(lang_crf.remainder("doc_id") != 1))
    if not model.labels:  # nothing to learn from, so nothing to judge by
        return docs
    return lang_crf.keep_known(docs, model, MIN_LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; null and wordless texts are copies of each other, null ids come last."""
    small_batches(spark)
    return simhash.drop_near_copies(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null texts hold none and stay, repeated rows go or stay alike."""
    small_batches(spark)
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stand as often as the mix takes them: not at all, once or twice; a null source is a source, texts without words stand once where their source is taken whole."""
    return mixing.repeat_to_targets(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of the mix in files, and a row for each document read back from them; a null text is the end id alone, null ids come last."""
    small_batches(spark)
    return tokens.read_token_files(tokens.write_token_files(docs, tokenizer_path()))


STAGES = [("language ID", language_id), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontaminate), ("mixing sources to target weights", mix_sources), ("token-ID / binary output", token_output)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
