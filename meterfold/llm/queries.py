"""The operators as named queries over whole tables, with production parameters."""

from pyspark.sql import DataFrame, SparkSession

from meterfold.llm import (
    decontaminate, language_id, line_dedup, mixing, periodic_runs, pii, repeats, simhash, token_counts, token_files,
    topk, toxicity, whitening,
)
from meterfold.llm.common import table

TOKENIZER = "piece_bpe_32k.model"
FILE_TOKENIZER = "word_bpe_49k.json"


def _tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), _tokenizer_path())


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeat_report(table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening_report(table(spark, sf_dir, "embeddings"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 49,408 ids fit two bytes; the tokenizer drops white space, so words may be encoded apart."""
    return token_files.token_file_report(
        table(spark, sf_dir, "documents"), _tokenizer_path(FILE_TOKENIZER), width=2, words_apart=True)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_planted_periods(table(spark, sf_dir, "documents"))
    return periodic_runs.run_report(docs)


QUERIES = {f.__name__: f for f in (
    op1_decontaminate, op2_topk, op3_pii, op4_language_id, op5_toxicity, op6_line_dedup, op7_mixing,
    op8_token_counts, op9_simhash, op10_repeats, op11_whitening, op12_token_files, op13_periodic_runs,
)}
