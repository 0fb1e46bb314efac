"""Lake layout and readers.

Tables are parquet directories. Large tables are partitioned by ``bucket``, a hash of the meter
id, instead of one directory per meter: the number of directories stays fixed while a one-meter
read still opens a single bucket, where min/max statistics on the sorted id skip row groups. Measurements
are partitioned by month as well, so that a merge leaves the months alone that it brings nothing for.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from meterfold.sources.schemas import GAS_PERIODS, GAS_REGISTRY, schema_of

BUCKETS = 1024
GAS_BUCKETS = "consos_publiees_par_bucket"


@dataclass(frozen=True)
class Layout:
    """Paths below one root, on any file system Spark can reach."""

    root: str

    def silver(self, table: str) -> str:
        return f"{self.root}/silver/{table}"

    def bronze(self, source: str = "enedis") -> str:
        return f"{self.root}/bronze/{source}"

    def snapshot(self, table: str, version: str) -> str:
        return f"{self.root}/snapshots/{table}/version={version}"

    def batches(self, table: str) -> str:
        """Rows written by micro-batches, one ``batch_id`` folder each."""
        return f"{self.root}/batches/{table}"

    def settings(self, table: str) -> str:
        return f"{self.root}/settings/{table}"


def bucket_of(meter: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(meter), F.lit(buckets)).cast("int")


def month_of(stamp: Column) -> Column:
    """Month of a stamp as text; rows without a stamp share one of their own."""
    return F.coalesce(F.date_format(stamp, "yyyy-MM"), F.lit("none"))


def in_buckets(rows: DataFrame, buckets: list[int]) -> DataFrame:
    """Rows of some buckets: a filter on the partition column, so other buckets are not opened."""
    return rows.where(F.col("bucket").isin(buckets))


def in_months(rows: DataFrame, touched: list[tuple[int, str]]) -> DataFrame:
    """Rows of exactly these (bucket, month) partitions."""
    by_month: dict[str, list[int]] = {}
    for bucket, month in touched:
        by_month.setdefault(month, []).append(bucket)
    wanted = [(F.col("month") == month) & F.col("bucket").isin(buckets) for month, buckets in by_month.items()]
    return rows.where(reduce(lambda a, b: a | b, wanted, F.lit(False)))


def asked_buckets(ids: DataFrame, key: str, buckets: int) -> list[int]:
    """The buckets of some ids: at most ``buckets`` integers."""
    return [r.bucket for r in ids.select(bucket_of(F.col(key), buckets).alias("bucket")).distinct().collect()]


def _missing(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def find_parquet(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame | None:
    """Read with a declared schema; None where nothing was ever written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if _missing(error):
            return None
        raise


def read_parquet(spark: SparkSession, path: str, schema: T.StructType,
                 absent_is_empty: bool = False) -> DataFrame:
    """Read with a declared schema (ids keep leading zeros, nothing is inferred)."""
    if not absent_is_empty:
        return spark.read.schema(schema).parquet(path)
    found = find_parquet(spark, path, schema)
    return spark.createDataFrame([], schema) if found is None else found


def read_table(spark: SparkSession, layout: Layout, table: str, absent_is_empty: bool = False) -> DataFrame:
    """All rows of a table: those appended and those that micro-batches wrote.

    The two kinds of writers have folders of their own, since Spark would not see plain files beside
    partition folders. A table that was never written raises, unless ``absent_is_empty``.
    """
    schema = schema_of(table)
    streamed = find_parquet(spark, layout.batches(table), schema)
    appended = read_parquet(spark, layout.silver(table), schema, absent_is_empty or streamed is not None)
    return appended if streamed is None else appended.unionByName(streamed.select(*schema.names))


def stored_buckets(spark: SparkSession, layout: Layout, table: str) -> int | None:
    """The bucket count a table was first written with; None before that."""
    rows = read_parquet(spark, layout.settings(table), T.StructType([T.StructField("buckets", T.IntegerType())]),
                        absent_is_empty=True).distinct().collect()
    if len(rows) > 1:
        raise ValueError(f"{table}: several bucket counts {sorted(r.buckets for r in rows)}")
    return rows[0].buckets if rows else None


def agreed_buckets(spark: SparkSession, layout: Layout, table: str, buckets: int | None,
                   store: bool = False) -> int:
    """The stored bucket count; another one is refused. A writer stores the first one."""
    stored = stored_buckets(spark, layout, table)
    if stored is not None and buckets not in (None, stored):
        raise ValueError(f"{table} has {stored} buckets, not {buckets}")
    if stored is None and store:
        spark.createDataFrame([(buckets or BUCKETS,)], "buckets int").coalesce(1).write.mode(
            "errorifexists").parquet(layout.settings(table))
    return stored or buckets or BUCKETS


def read_registry(spark: SparkSession, layout: Layout, version: str) -> DataFrame:
    """Gas registry snapshot; an absent one is an empty registry, extra columns are kept."""
    path = layout.snapshot("droits_acces", version)
    try:
        stored = spark.read.parquet(path)
    except AnalysisException as error:
        if _missing(error):
            return spark.createDataFrame([], GAS_REGISTRY)
        raise
    declared = [
        (F.col(f.name) if f.name in stored.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in GAS_REGISTRY
    ]
    extra = [c for c in stored.columns if c not in GAS_REGISTRY.fieldNames()]
    return stored.select(*declared, *extra)


def bucketed(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType())])


def read_measures(spark: SparkSession, layout: Layout) -> DataFrame:
    """Measurement table with its partition columns ``bucket`` and ``month``."""
    schema = bucketed(schema_of("donnees_mesures")).add(T.StructField("month", T.StringType()))
    return read_parquet(spark, layout.silver("donnees_mesures"), schema, absent_is_empty=True)


def read_gas_buckets(spark: SparkSession, layout: Layout) -> DataFrame:
    """Published gas periods by bucket, with their ``bucket`` column."""
    return read_parquet(spark, layout.silver(GAS_BUCKETS), bucketed(GAS_PERIODS), absent_is_empty=True)


def read_asked(spark: SparkSession, layout: Layout, ids: DataFrame, key: str = "sensor_id") -> tuple[DataFrame, DataFrame]:
    """(gas periods, measurements) of the buckets that hold the asked ids; no other bucket is opened."""
    gas, measures = read_gas_buckets(spark, layout), read_measures(spark, layout)
    found = []
    for rows, table in ((gas, GAS_BUCKETS), (measures, "donnees_mesures")):
        found.append(in_buckets(rows, asked_buckets(ids, key, agreed_buckets(spark, layout, table, None))))
    return found[0].drop("bucket"), found[1].drop("bucket", "month")


def read_gas_meter(spark: SparkSession, layout: Layout, id_pce: str) -> DataFrame:
    """Periods of one gas meter: one bucket directory; no rows for a meter that is not stored."""
    buckets = agreed_buckets(spark, layout, GAS_BUCKETS, None)
    return read_gas_buckets(spark, layout).where(
        (F.col("bucket") == bucket_of(F.lit(id_pce), buckets)) & (F.col("id_pce") == id_pce)).drop("bucket")


def read_meter(spark: SparkSession, layout: Layout, id_pdl: str, buckets: int | None = None) -> DataFrame:
    """Measurements of one meter: one bucket directory, row groups skipped by id."""
    rows = read_measures(spark, layout)
    buckets = agreed_buckets(spark, layout, "donnees_mesures", buckets)
    return rows.where(
        (F.col("bucket") == bucket_of(F.lit(id_pdl), buckets)) & (F.col("id_pdl") == id_pdl)
    ).drop("bucket", "month")


def read_meter_directories(spark: SparkSession, path: str, table: str = "donnees_mesures") -> DataFrame:
    """The one-directory-per-meter layout (``id_pdl=...``); filters on the id prune directories."""
    return read_parquet(spark, path, schema_of(table))


def read_gas_periods(spark: SparkSession, layout: Layout) -> DataFrame:
    """Published gas periods, one directory per meter (``id_pce=...``)."""
    return read_parquet(spark, layout.silver("consos_publiees"), GAS_PERIODS, absent_is_empty=True)


def read_commands(requests: DataFrame, body: str = "body") -> DataFrame:
    """JSON request rows to command rows: the body as a map, so absent and null differ."""
    return requests.withColumn(
        body, F.from_json(F.col(body), T.MapType(T.StringType(), T.StringType()))
    )
