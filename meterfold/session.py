"""Session settings that every job here relies on."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

CHECKPOINT_KEY = "spark.checkpoint.dir"

# Ids keep their leading zeros, partition overwrite touches only the partitions written.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("meterfold")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config(CHECKPOINT_KEY, tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; fall back only when it names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get(CHECKPOINT_KEY, None) or context.getConf().get(CHECKPOINT_KEY)
    if shared is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"{CHECKPOINT_KEY} must name a shared folder on a cluster")
        shared = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    context.setCheckpointDir(shared)


def scratch_root(spark: SparkSession) -> str:
    """A fresh directory inside the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"


def stored_once(df: DataFrame) -> DataFrame:
    """The rows computed once and kept as compressed columns, a fraction of what a checkpoint writes."""
    path, spark = f"{scratch_root(df.sparkSession)}/rows", df.sparkSession
    kept = [f for f in df.schema if not isinstance(f.dataType, T.NullType)]  # files hold no untyped nulls
    df.select(*[F.col(f.name) for f in kept]).write.parquet(path)
    names = {f.name for f in kept}
    return spark.read.schema(T.StructType(kept)).parquet(path).select(
        *[F.col(f.name) if f.name in names else F.lit(None).alias(f.name) for f in df.schema])
