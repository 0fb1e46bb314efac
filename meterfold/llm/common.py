"""Helpers that the operators share."""

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from meterfold.session import ensure_checkpoint_dir, scratch_root

TABLE = "{dir}/{name}.parquet"
# ``[\x20\x09-\x0D]``: the white space that separates words and is stripped from lines.
BLANKS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(TABLE.format(dir=sf_dir.rstrip("/"), name=name))


def ship(module) -> None:
    """Send a kernel module's functions to executors by value, so they need no copy of the library."""
    cloudpickle.register_pickle_by_value(module)


def written(df: DataFrame, *partitions: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_root(spark)
    df.write.partitionBy(*partitions).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """``df`` checkpointed in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fold_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts
