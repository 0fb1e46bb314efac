"""Writers: validated append, snapshots, keep-latest measurements, archive, migration, audit logs."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from meterfold import fixed_values as fv
from meterfold.functions.dates import iso_stamp, parse_day, show_typed_stamp, stamp_literal
from meterfold.operators.merge import UPDATED_AT, merge_rows, packed_fields, partial_upsert
from meterfold.operators.dedup import keep_first, last_arrived, latest_right_order
from meterfold.operators.quality import require_valid
from meterfold.sources.lake import (
    GAS_BUCKETS, Layout, agreed_buckets, asked_buckets, bucket_of, bucketed, in_buckets, in_months, month_of,
    read_measures, read_parquet, read_table,
)
from meterfold.session import ensure_checkpoint_dir, stored_once
from meterfold.sources.schemas import GAS_PERIODS, KEYS, list_columns, schema_of

MEASURE_INPUT = ["id_pdl", "label", "val", "ts", "date_debut", "date_fin", "fmt", "uuid", "misc"]
BUCKET_SLICES = 64


def in_schema_order(df: DataFrame, table: str, *extra: Column) -> DataFrame:
    """Declared columns in declared order and type, then ``extra``; other columns are dropped."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema_of(table)], *extra)


def append_rows(df: DataFrame, layout: Layout, table: str, validate: bool = True) -> int:
    """Append after the strict schema check; returns the number of rows written."""
    if validate:
        require_valid(df, table)
    seen = Observation()
    rows = in_schema_order(df, table).observe(seen, F.count(F.lit(1)).alias("n"))
    rows.write.mode("append").parquet(layout.silver(table))
    return seen.get["n"]


def write_snapshot(df: DataFrame, layout: Layout, table: str, version: str) -> str:
    """Write a whole table as a new version; an existing version is never overwritten."""
    path = layout.snapshot(table, version)
    df.write.mode("errorifexists").option("compression", "snappy").parquet(path)
    return path


def rewrite_snapshot(current: DataFrame, change, layout: Layout, table: str, version: str) -> str:
    """Read-modify-write with a caller's DataFrame function."""
    return write_snapshot(current.transform(change), layout, table, version)


def prepare_measures(measures: DataFrame, now: datetime, *extra: Column) -> DataFrame:
    """Measurement rows in table form: required columns checked, ingestion stamp, other columns dropped."""
    missing = sorted(set(MEASURE_INPUT) - set(measures.columns))
    if missing:
        raise ValueError(f"colonnes manquantes dans les mesures : {missing}")
    stamped = measures.withColumn("ingestion_ts", stamp_literal(now))
    return in_schema_order(stamped, "donnees_mesures", *extra)


def write_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace the partitions that ``df`` has rows for and leave the others alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *partitions).parquet(path)


def write_buckets(df: DataFrame, path: str, key: str, *partitions: str) -> None:
    """Replace whole buckets, or whole (bucket, *partitions).

    The rebalance lets adaptive execution split a bucket that holds a very busy meter over
    several tasks and files; ids are sorted inside a file so that row groups can be skipped.
    """
    unit = ["bucket", *partitions]
    write_partitions(df.hint("rebalance", *unit).sortWithinPartitions(*unit, key), path, *unit)


def write_measures(
    measures: DataFrame,
    layout: Layout,
    now: datetime,
    arrival: str,
    buckets: int | None = None,
    null_safe: bool = False,
) -> int:
    """Keep-latest merge on (meter, label, ts); returns the number of rows merged in.

    Only (bucket, month) partitions that receive rows are read and rewritten; the batch itself is computed
    once. The bucket count is stored with the table; another one is refused. With ``null_safe`` a null label or
    stamp is a value like any other, so that writing the same rows again changes nothing.
    """
    keys = KEYS["donnees_mesures"]
    spark = measures.sparkSession
    buckets = agreed_buckets(spark, layout, "donnees_mesures", buckets, store=True)
    ensure_checkpoint_dir(spark)
    unit = {"bucket": bucket_of(F.col("id_pdl"), buckets), "month": month_of(F.col("ts"))}
    batch = prepare_measures(measures, now, F.col(arrival).alias("_arrival")).withColumns(unit).checkpoint()
    require_valid(batch.drop("_arrival", *unit), "donnees_mesures")
    # The partitions of one feed: at most ``buckets`` for each month it has rows of.
    touched = [(r.bucket, r.month) for r in batch.select(*unit).distinct().collect()]
    if not touched:
        return 0
    incoming = last_arrived(batch, keys, "_arrival", null_safe).drop("_arrival")
    stored = in_months(read_measures(spark, layout), touched)
    merged = merge_rows(
        stored.withColumn("incoming", F.lit(False)), incoming.withColumn("incoming", F.lit(True)),
        [*unit, *keys], null_safe=null_safe)
    seen = Observation()
    rows = merged.observe(seen, F.count_if("incoming").alias("n")).drop("incoming")
    write_buckets(rows, layout.silver("donnees_mesures"), "id_pdl", "month")
    return seen.get["n"]


def write_gas_periods(periods: DataFrame, layout: Layout, buckets: int | None = None) -> None:
    """Store published gas periods by bucket; buckets that receive rows are replaced whole."""
    buckets = agreed_buckets(periods.sparkSession, layout, GAS_BUCKETS, buckets, store=True)
    rows = periods.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in GAS_PERIODS])
    write_buckets(rows.withColumn("bucket", bucket_of(F.col("id_pce"), buckets)), layout.silver(GAS_BUCKETS), "id_pce")


# --- bucketed registry ---------------------------------------------------------------------

def registry_table(key: str) -> str:
    return f"registry_{key}"


def write_registry(registry: DataFrame, layout: Layout, key: str, buckets: int) -> None:
    """Store registry rows by bucket; buckets that receive rows are replaced whole."""
    rows = registry.withColumn("bucket", bucket_of(F.col(key), buckets))
    write_buckets(rows, layout.silver(registry_table(key)), key)


def registry_unit(key: str, buckets: int) -> list[Column]:
    """Where a registry row is merged and written: its bucket, in slices that tasks may share."""
    return [bucket_of(F.col(key), buckets), F.pmod(F.hash(key), F.lit(BUCKET_SLICES))]


def write_merged(merged: DataFrame, layout: Layout, key: str, buckets: int) -> None:
    """``write_registry`` for rows that a merge left in their places, see ``registry_unit``."""
    rows = merged.withColumn("bucket", bucket_of(F.col(key), buckets))
    write_partitions(rows.sortWithinPartitions("bucket", key), layout.silver(registry_table(key)), "bucket")


def upsert_registry(
    records: DataFrame, layout: Layout, schema, now: datetime, key: str = "id_pce",
    arrival: str = "input_ord", buckets: int | None = None,
) -> int:
    """Partial upsert into the bucketed registry; returns the number of ids written.

    Only buckets of the feed's ids are read and rewritten, each once: one shuffle brings what they hold
    and the feed to the places where they are merged and written. ``schema`` is the stored one; fields that it lacks are refused.
    """
    spark = records.sparkSession
    buckets = agreed_buckets(spark, layout, registry_table(key), buckets, store=True)
    unknown = sorted(set(records.columns) - {*schema.names, "fields_set", arrival})
    if unknown:
        raise ValueError(f"colonnes inconnues : {unknown}")
    named = packed_fields(records.where(F.coalesce(F.col(key), F.lit("")) != ""), key, arrival)
    feed = stored_once(keep_first(named, [F.col(key)], latest_right_order(arrival)).drop(arrival))
    touched = asked_buckets(feed, key, buckets)
    if not touched:
        return 0
    stored = read_parquet(spark, layout.silver(registry_table(key)), bucketed(schema), absent_is_empty=True)
    merged = partial_upsert(in_buckets(stored, touched).drop("bucket"), feed, now, key, arrival=None,
                            unit=registry_unit(key, buckets))
    seen = Observation()
    rows = merged.select(*schema.names).observe(seen, F.count_if(F.col(UPDATED_AT) == iso_stamp(now)).alias("n"))
    write_merged(rows, layout, key, buckets)
    return seen.get["n"]


def archive_path(layout: Layout, stamp: Column) -> Column:
    """``bronze/<source>/<endpoint>/<meter>/<stamp>[__<suffix>].xml``"""
    suffix = F.when(F.coalesce("suffix", F.lit("")) != "", F.concat(F.lit("__"), F.col("suffix")))
    name = F.concat(
        F.translate(show_typed_stamp(stamp), " :", "T-"), F.coalesce(suffix, F.lit("")),
        F.lit(".xml"),
    )
    return F.concat_ws("/", F.lit(layout.bronze()), F.col("endpoint"), F.col("id_pdl"), name)


def archive_rows(responses: DataFrame, layout: Layout, stamp: Column) -> DataFrame:
    """Raw responses with their archive path; the first of equal paths is kept (never overwrite)."""
    named = responses.select(
        "endpoint", "id_pdl", "suffix", "xml", "arrival", archive_path(layout, stamp).alias("blob_path")
    )
    return keep_first(named, [F.col("blob_path")], [F.col("arrival").asc()])


def archive_day(blob_path: Column) -> Column:
    """The day in the file name of an archive path, a fixed word where there is none."""
    day = F.substring(F.substring_index(blob_path, "/", -1), 1, 10)
    return F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day).otherwise(F.lit("sans_date"))


def write_archive(responses: DataFrame, layout: Layout, stamp: Column) -> int:
    """Append raw responses by day and endpoint; paths already archived are left as they are.

    Equal paths have equal days, so only the paths stored for the batch's days are read.
    """
    spark, path = responses.sparkSession, f"{layout.bronze()}/responses"
    ensure_checkpoint_dir(spark)
    rows = archive_rows(responses, layout, stamp).withColumn("day", archive_day(F.col("blob_path"))).checkpoint()
    days = [r.day for r in rows.select("day").distinct().collect()]
    stored = read_parquet(spark, path, rows.schema, absent_is_empty=True).where(F.col("day").isin(days))
    fresh = rows.join(stored.select("blob_path"), "blob_path", "left_anti")
    seen = Observation()
    fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").partitionBy(
        "day", "endpoint").parquet(path)
    return seen.get["n"]


def add_backfilled(df: DataFrame, table: str, column: str, value: str) -> DataFrame:
    """The table with a new column, equal for all stored rows, in declared order."""
    limit = schema_of(table)[column].metadata.get("max_length")
    if limit is not None and len(value) > limit:
        raise ValueError(f"'{value}' dépasse {limit} caractères")
    if column in df.columns:
        return df
    return df.withColumn(column, F.lit(value)).select(*list_columns(table))


def with_defaults(df: DataFrame, table: str) -> DataFrame:
    """Required columns that hold nothing take their declared default, as a stored table has it."""
    declared = {f.name: f.metadata.get("default") for f in schema_of(table) if not f.nullable}
    return df.withColumns({
        c: F.coalesce(c, F.lit(value)) for c, value in declared.items() if value is not None and c in df.columns})


def migrate(
    df: DataFrame, layout: Layout, table: str, column: str, version: str,
    value: str = fv.BACKFILL_PLATFORM_CODE, apply: bool = False,
) -> str | None:
    """Schema migration to a new snapshot; a dry run unless ``apply``, a no-op when done before."""
    if column in df.columns:
        return None
    migrated = require_valid(add_backfilled(df, table, column, value), table)
    return write_snapshot(migrated, layout, table, version) if apply else None


def error_log_rows(errors: DataFrame, now: datetime) -> DataFrame:
    """Error-log rows; a missing timestamp becomes the run's time."""
    given = F.col("timestamp") if "timestamp" in errors.columns else F.lit(None)
    stamped = errors.withColumn(
        "timestamp", F.coalesce(given.cast("timestamp_ntz"), stamp_literal(now))
    )
    return in_schema_order(stamped, "log_erreur")


def log_errors(errors: DataFrame, layout: Layout, now: datetime) -> int:
    return append_rows(error_log_rows(errors, now), layout, "log_erreur")


def history_request_rows(requests: DataFrame, now: datetime) -> DataFrame:
    """Sent history requests as table rows: not yet processed, made now."""
    step = F.col("mesures_pas") if "mesures_pas" in requests.columns else F.lit(None)
    rows = requests.withColumns({
        "mesures_pas": step,
        "date_debut_demandee": parse_day(F.col("date_debut_demandee")),
        "date_fin_demandee": parse_day(F.col("date_fin_demandee")),
        "datetime_requete": stamp_literal(now),
        "date_premiere_valeur": F.lit(None),
        "fichier_traite": F.lit("false"),
    })
    return in_schema_order(rows, "demandes_historique")


def log_history_requests(
    requests: DataFrame, layout: Layout, now: datetime, ignore_known: bool = False
) -> int:
    """Append history requests; with ``ignore_known`` case numbers already stored are skipped."""
    rows = history_request_rows(requests, now)
    if ignore_known:
        stored = read_parquet(rows.sparkSession, layout.silver("demandes_historique"),
                              schema_of("demandes_historique"), absent_is_empty=True)
        order = [F.col(c).asc_nulls_last() for c in sorted(rows.columns)]
        rows = keep_first(rows, [F.col("id_affaire")], order).join(
            stored.select("id_affaire"), "id_affaire", "left_anti")
    return append_rows(rows, layout, "demandes_historique")


def count_rows(spark: SparkSession, layout: Layout, table: str) -> int:
    return read_table(spark, layout, table, absent_is_empty=True).count()
