"""Structured Streaming jobs: every micro-batch runs a batch operator and writes exactly once.

A micro-batch that is run again after a failure replaces what it wrote the first time: sinks are
partitioned by ``batch_id`` or merge by key.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from meterfold.operators import commands as ops
from meterfold.operators.quality import split_valid
from meterfold.operators.requests import PAIR, accept_spaced
from meterfold.sources import sinks
from meterfold.sources.lake import Layout, bucket_of, bucketed, find_parquet, in_buckets, read_parquet
from meterfold.sources.sinks import error_log_rows, write_measures, write_partitions


def _start(stream: DataFrame, handle, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _with_batch(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])


def stored_batches(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What earlier micro-batches wrote, with their ``batch_id``."""
    return read_parquet(spark, path, _with_batch(schema), absent_is_empty=True)


def _write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    write_partitions(df.withColumn("batch_id", F.lit(batch_id)), path, "batch_id")


def upsert_measures(
    stream: DataFrame, layout: Layout, now: datetime, arrival: str, checkpoint: str,
    buckets: int, available_now: bool = True,
) -> StreamingQuery:
    """Keep-latest measurements; the latest is the last to arrive and nothing is ever too late."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        write_measures(batch, layout, now, arrival, buckets, null_safe=True)

    return _start(stream, handle, checkpoint, available_now)


# --- commands ------------------------------------------------------------------------------

def write_registry(registry: DataFrame, layout: Layout, book, buckets: int) -> None:
    """Store a registry by bucket, as the command stream expects it."""
    sinks.write_registry(registry, layout, book.KEY, buckets)


def read_registry(spark: SparkSession, layout: Layout, book, schema: T.StructType) -> DataFrame:
    path = layout.silver(sinks.registry_table(book.KEY))
    return read_parquet(spark, path, bucketed(schema), absent_is_empty=True)


def log_path(layout: Layout, book, kind: str) -> str:
    return f"{layout.root}/log/{book.KEY}/{kind}"


def _is_logged(spark: SparkSession, path: str, batch_id: int) -> bool:
    done = stored_batches(spark, path, T.StructType([]))
    return not done.where(F.col("batch_id") == batch_id).isEmpty()


def apply_commands(
    stream: DataFrame, layout: Layout, book, registry_schema: T.StructType, now: datetime,
    checkpoint: str, buckets: int, available_now: bool = True,
) -> StreamingQuery:
    """Fold each micro-batch of commands into the bucketed registry.

    A batch first logs its outcomes, the state changes and then a completion mark; only then is
    the registry touched. A rerun finds the mark and only repeats the (idempotent) registry
    write; without the mark the registry is still untouched and the batch is computed afresh.
    A command seen before (same id and seq) is skipped; creations without an id are commands of their
    own and all get their outcome. Only buckets with changes are rewritten.
    """
    outcomes_at, changes_at, marks_at = (
        log_path(layout, book, kind) for kind in ("outcomes", "changes", "marks"))

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        stored = read_registry(spark, layout, book, registry_schema)
        key = F.col(book.KEY)
        if not _is_logged(spark, marks_at, batch_id):
            asked = ops.addressed(batch, book)
            seen = find_parquet(spark, outcomes_at, _with_batch(
                T.StructType([batch.schema["id"], batch.schema["seq"]])))
            if seen is not None:
                same = (F.col("a.id") == F.col("s.id")) & (F.col("a.seq") == F.col("s.seq"))
                earlier = seen.where(F.col("batch_id") < batch_id)
                asked = asked.alias("a").join(earlier.alias("s"), same, "left_anti")
            # Of several bodies under one id and seq the same one is kept in every run.
            total = [F.col("op"), F.to_json(F.array_sort(F.map_entries("body")))]
            # Stored once: outcomes and changes come from the same fold.
            outcomes, changes = ops.fold(
                asked, stored.drop("bucket"), book, now, store=True, total=total)
            _write_batch(outcomes, outcomes_at, batch_id)
            _write_batch(
                changes.withColumn("bucket", bucket_of(key, buckets)), changes_at, batch_id)
            _write_batch(spark.range(1), marks_at, batch_id)
        change_schema = T.StructType([
            T.StructField(book.KEY, T.StringType()),
            *[f for f in book.STATE_TYPE if f.name != "exists"],
            T.StructField("bucket", T.IntegerType()),
        ])
        changes = stored_batches(spark, changes_at, change_schema).where(
            F.col("batch_id") == batch_id).drop("batch_id")
        # At most ``buckets`` integers.
        touched = [r.bucket for r in changes.select("bucket").distinct().collect()]
        if touched:
            part = in_buckets(stored, touched).drop("bucket")
            unit = sinks.registry_unit(book.KEY, buckets)
            merged = ops.apply_changes(part, changes.drop("bucket"), book, unit)
            sinks.write_merged(merged, layout, book.KEY, buckets)

    return _start(stream, handle, checkpoint, available_now)


# --- request suppression -------------------------------------------------------------------

def suppress_requests(
    stream: DataFrame, path: str, days: int, checkpoint: str, available_now: bool = True,
) -> StreamingQuery:
    """Keep a request only when none was accepted for its (meter, code) in the last ``days`` days.

    The accepted requests are the state: each micro-batch reads those of its own pairs that are
    young enough to matter, reduced to one row per pair.
    """

    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = batch.where(F.col("datetime_requete").isNotNull()).select(
            *PAIR, "datetime_requete", "id_affaire")
        oldest = rows.agg(F.min("datetime_requete").alias("t")).head().t
        if oldest is None:
            return
        # Late requests look back from their own time, so nothing older than the oldest one matters.
        horizon = F.lit(oldest).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS")
        earlier = stored_batches(batch.sparkSession, path, rows.schema).where(
            (F.col("batch_id") < batch_id) & (F.col("datetime_requete") >= horizon)
        ).drop("batch_id")
        _write_batch(accept_spaced(rows, earlier, days), path, batch_id)

    return _start(stream, handle, checkpoint, available_now)


# --- valid / quarantine --------------------------------------------------------------------

def quarantine(
    stream: DataFrame, table: str, layout: Layout, now: datetime, code: Column, service: str,
    checkpoint: str, available_now: bool = True,
) -> StreamingQuery:
    """Valid rows to the table, broken rows to quarantine, one error-log row per broken row."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            valid, bad = split_valid(batch, table)
            errors = bad.select(
                F.coalesce("id_pdl", F.lit("")).alias("id_pdl"), code.alias("code_erreur"),
                F.array_join("row_errors", ",").alias("message_erreur"),
                F.lit(service).alias("service_appele"),
            )
            _write_batch(valid, layout.batches(table), batch_id)
            _write_batch(bad, f"{layout.root}/quarantine/{table}", batch_id)
            _write_batch(error_log_rows(errors, now), layout.batches("log_erreur"), batch_id)
        finally:
            batch.unpersist()

    return _start(stream, handle, checkpoint, available_now)
