"""A training-data pipeline over ``documents``: five stages, each one operator on what the last one kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as
Parquet in the shared folder and reads it again as the next stage's documents. All stages but the last
return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession

from meterfold.llm import decontaminate, language_id, line_dedup, mixing, simhash
from meterfold.llm.common import table, written

# SQL cannot express code lengths, XXH64 fingerprints or hashed draws; tests compare with brute force.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters go."""
    return language_id.keep_known(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that at least five share (the last holder keeps them)."""
    return line_dedup.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id."""
    return simhash.keep_one_of_group(docs)


def drop_benchmark_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents by shard and place, repeated or left out to meet the sources' targets."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_benchmark_documents),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
