from datetime import date, datetime

import pytest
from conftest import plan_of
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from meterfold.functions.dates import stamp_literal
from meterfold.operators import quality
from meterfold.plans import adapters
from meterfold.plans.queries import QUERIES
from meterfold.sources import lake, schemas, sinks

NOW = datetime(2026, 6, 16, 9, 3, 16)
MEASURE = ("id_pdl string, label string, val double, ts timestamp_ntz, date_debut date, date_fin date, fmt int, "
           "uuid string, misc string, arrival int, surplus string")


def measures(spark, *rows):
    full = [(m, label, v, datetime(2024, 1, 31), date(2024, 1, 1), date(2024, 2, 1), 1, f"enedis_CM_{m}", None, i, "x")
            for i, (m, label, v) in enumerate(rows)]
    return spark.createDataFrame(full, MEASURE)


def stored(spark, layout):
    return sorted((r.id_pdl, r.label, r.val) for r in lake.read_measures(spark, layout).collect())


def test_measures_keep_latest_and_touch_only_their_buckets(spark, tmp_path):
    layout = lake.Layout(str(tmp_path))
    meters = [f"{i:014d}" for i in range(40)]
    first = measures(spark, *[(m, "TOTAL", 1.0) for m in meters], (meters[0], "TOTAL", 2.0))
    assert sinks.write_measures(first, layout, NOW, "arrival", buckets=8) == 40
    files = {p: p.stat().st_mtime_ns for p in tmp_path.rglob("*.parquet")}
    second = measures(spark, (meters[0], "TOTAL", 3.0), (meters[0], "FRN_P", 4.0))
    assert sinks.write_measures(second, layout, NOW, "arrival", buckets=8) == 2
    rows = stored(spark, layout)
    assert len(rows) == 41 and (meters[0], "TOTAL", 3.0) in rows and (meters[0], "FRN_P", 4.0) in rows
    kept = [p for p in files if p.exists() and p.stat().st_mtime_ns == files[p]]
    assert len({p.parent for p in kept}) == len({p.parent for p in files}) - 1
    assert sinks.write_measures(second.limit(0), layout, NOW, "arrival", buckets=8) == 0

    one = lake.read_meter(spark, layout, meters[0], buckets=8)
    assert sorted(r.label for r in one.collect()) == ["FRN_P", "TOTAL"]
    plan = plan_of(one)
    filters = plan[plan.index("PartitionFilters"):]
    assert "bucket" in filters.split("]")[0] and "EqualTo(id_pdl" in plan


def test_measures_are_checked(spark, tmp_path):
    layout = lake.Layout(str(tmp_path))
    with pytest.raises(ValueError, match="misc"):
        sinks.write_measures(measures(spark, ("1", "TOTAL", 1.0)).drop("misc"), layout, NOW, "arrival")
    with pytest.raises(quality.SchemaViolation):
        sinks.write_measures(measures(spark, ("9" * 15, "TOTAL", 1.0)), layout, NOW, "arrival")


def test_meter_directories_keep_leading_zeros(spark, tmp_path):
    rows = sinks.prepare_measures(measures(spark, ("00000000001965", "TOTAL", 1.0), ("00000000000002", "TOTAL", 2.0)), NOW)
    rows.write.partitionBy("id_pdl").parquet(f"{tmp_path}/m")
    read = lake.read_meter_directories(spark, f"{tmp_path}/m").where("id_pdl = '00000000001965'")
    assert [r.id_pdl for r in read.collect()] == ["00000000001965"]
    assert "PartitionFilters: [isnotnull(id_pdl" in plan_of(read)


def test_gas_periods_layout(spark, tmp_path):
    layout = lake.Layout(str(tmp_path))
    assert lake.read_gas_periods(spark, layout).count() == 0
    rows = spark.createDataFrame([("0012", "2024-01-01", "2024-02-01", "1M", 5.0, "kWh")], schemas.GAS_PERIODS)
    rows.write.partitionBy("id_pce").parquet(layout.silver("consos_publiees"))
    assert lake.read_gas_periods(spark, layout).head().id_pce == "0012"


def files_below(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def test_a_merge_leaves_other_months_alone(spark, tmp_path):
    layout = lake.Layout(str(tmp_path))
    rows = spark.range(60).selectExpr(
        "lpad(CAST(id % 6 AS STRING), 14, '0') AS id_pdl", "'TOTAL' AS label", "CAST(id AS DOUBLE) AS val",
        "CASE WHEN id % 20 < 18 THEN CAST(DATE '2024-01-15' + CAST(id % 20 AS INT) * 20 AS TIMESTAMP_NTZ) END AS ts",
        "DATE '2024-01-01' AS date_debut", "DATE '2024-01-02' AS date_fin", "1 AS fmt", "'u' AS uuid", "'m' AS misc", "id AS arrival")
    sinks.write_measures(rows, layout, NOW, "arrival", buckets=4, null_safe=True)
    before = files_below(tmp_path / "silver")
    feed = rows.where("id_pdl LIKE '%3' AND ts = TIMESTAMP_NTZ '2024-01-15 00:00:00'").withColumn("val", F.lit(-1.0))
    again = rows.where("id_pdl LIKE '%3'").withColumn("ts", F.lit(None).cast("timestamp_ntz")).withColumn("val", F.lit(-2.0)).limit(1)
    touched = feed.unionByName(again)
    n = touched.select("ts").distinct().count()
    sinks.write_measures(touched, layout, NOW, "arrival", null_safe=True)
    after = files_below(tmp_path / "silver")
    changed = {f.rsplit("/", 1)[0] for f, _ in before.items() ^ after.items()}
    assert 0 < len(changed) <= n and all("month=2024-01" in f or "month=none" in f for f in changed)
    got = {(r.id_pdl, r.ts): r.val for r in lake.read_measures(spark, layout).collect()}
    want = {(r.id_pdl, r.ts): r.val for r in rows.orderBy("arrival").collect()}
    want |= {(r.id_pdl, r.ts): r.val for r in touched.orderBy("arrival").collect()}
    assert got == want


def test_requests_open_their_buckets_only(spark, tmp_path):
    layout = lake.Layout(str(tmp_path))
    periods = spark.range(200).selectExpr(
        "lpad(CAST(id AS STRING), 4, '0') AS id_pce", "'2024-01-01' AS date_debut", "'2024-02-01' AS date_fin",
        "'1M' AS frequence", "CAST(id AS DOUBLE) AS consommation", "'kWh' AS unite")
    sinks.write_gas_periods(periods, layout, 16)
    assert lake.read_gas_buckets(spark, layout).drop("bucket").exceptAll(periods).isEmpty()
    asked = spark.createDataFrame([("0007",), ("0042",), ("absent",)], "sensor_id string")
    found, measures_found = lake.read_asked(spark, layout, asked)
    assert {"0007", "0042"} <= {r.id_pce for r in found.collect()} and measures_found.isEmpty()
    assert "bucket#" in plan_of(found).split("PartitionFilters")[1].split("]")[0]
    assert found.select("id_pce").distinct().count() < 100
    assert [r.consommation for r in lake.read_gas_meter(spark, layout, "0042").collect()] == [42.0]
    assert lake.read_gas_meter(spark, layout, "absent").isEmpty()


def test_a_feed_rewrites_only_its_buckets_of_the_registry(spark, tmp_path):
    layout = lake.Layout(str(tmp_path))
    schema = schemas.GAS_REGISTRY
    base = dict.fromkeys(schema.names)
    rows = spark.createDataFrame(
        [tuple({**base, "id_pce": f"P{i}", "etat_droit_acces": "Active"}.values()) for i in range(50)], schema)
    sinks.agreed_buckets(spark, layout, sinks.registry_table("id_pce"), 8, store=True)
    sinks.write_registry(rows, layout, "id_pce", 8)
    before = files_below(tmp_path / "silver")
    feed = spark.createDataFrame(
        [("P3", "x", None, 1), ("P3", "y", None, 2), ("NEW", "z", "2024-01-01", 3), (None, "w", None, 4), ("", "w", None, 5)],
        "id_pce string, nom_titulaire string, date_debut_droit_acces string, input_ord int").withColumn(
        "date_creation", F.lit(None).cast("string")).withColumn("fields_set", F.array(F.lit("nom_titulaire")))
    assert sinks.upsert_registry(feed, layout, schema, NOW) == 2
    changed = {f.split("bucket=")[1].split("/")[0] for f, _ in before.items() ^ files_below(tmp_path / "silver").items()}
    assert len(changed) <= 2
    got = {r.id_pce: (r.etat_droit_acces, r.nom_titulaire) for r in spark.read.parquet(layout.silver("registry_id_pce")).collect()}
    assert len(got) == 51 and got["P3"] == ("Active", "x") and got["NEW"] == (None, "z") and got["P4"] == ("Active", None)
    assert sinks.upsert_registry(feed.limit(0), layout, schema, NOW) == 0
    with pytest.raises(ValueError, match="inconnu"):
        sinks.upsert_registry(feed.withColumn("autre", F.lit(1)), layout, schema, NOW)


def test_append_and_count(spark, tmp_path):
    layout = lake.Layout(str(tmp_path))
    errors = spark.createDataFrame([("1", "SGT1", "m", "S", None), ("2", "SGT2", "m", "S", datetime(2024, 1, 1))],
                                   "id_pdl string, code_erreur string, message_erreur string, service_appele string, timestamp timestamp_ntz")
    assert sinks.count_rows(spark, layout, "log_erreur") == 0
    assert sinks.log_errors(errors, layout, NOW) == 2
    assert sinks.append_rows(lake.read_table(spark, layout, "log_erreur").limit(0), layout, "log_erreur") == 0
    assert sinks.count_rows(spark, layout, "log_erreur") == 2
    assert {r.timestamp for r in lake.read_table(spark, layout, "log_erreur").collect()} == {NOW, datetime(2024, 1, 1)}
    with pytest.raises(quality.SchemaViolation):
        sinks.log_errors(errors.withColumn("id_pdl", F.lit(None).cast("string")), layout, NOW)
    with pytest.raises(AnalysisException):
        lake.read_table(spark, layout, "dtc")


def test_history_requests(spark, tmp_path):
    layout = lake.Layout(str(tmp_path))
    sent = spark.createDataFrame([("AFF1", "P1", "R63_BRUTE_SOUTIRAGE", "false", "COURBES", "2024-1-5", "2024-02-30")],
                                 "id_affaire string, id_pdl string, code_prestation string, mesures_corrigees string, "
                                 "mesures_type_code string, date_debut_demandee string, date_fin_demandee string")
    assert sinks.log_history_requests(sent, layout, NOW) == 1
    assert sinks.log_history_requests(sent, layout, NOW, ignore_known=True) == 0
    row = lake.read_table(spark, layout, "demandes_historique").head()
    assert (row.date_debut_demandee, row.date_fin_demandee, row.datetime_requete, row.fichier_traite) == (
        date(2024, 1, 5), None, NOW, "false")


def test_snapshots(spark, tmp_path):
    layout = lake.Layout(str(tmp_path))
    assert lake.read_registry(spark, layout, "0").columns == schemas.GAS_REGISTRY.fieldNames()
    rows = spark.createDataFrame([("0012", "Active", "x")], "id_pce string, etat_droit_acces string, motif string")
    sinks.write_snapshot(rows, layout, "droits_acces", "1")
    read = lake.read_registry(spark, layout, "1")
    assert read.columns == [*schemas.GAS_REGISTRY.fieldNames(), "motif"]
    assert (read.head().id_pce, read.head().motif) == ("0012", "x")
    sinks.rewrite_snapshot(read, lambda df: df.withColumn("motif", F.lit("y")), layout, "droits_acces", "2")
    assert lake.read_registry(spark, layout, "2").head().motif == "y"
    with pytest.raises(AnalysisException):
        sinks.write_snapshot(rows, layout, "droits_acces", "1")


def test_archive_never_overwrites(spark, tmp_path):
    layout = lake.Layout(str(tmp_path))
    rows = spark.createDataFrame([("dtc", "P1", None, "<a/>", 1), ("dtc", "P1", "", "<b/>", 2), ("dtc", "P1", "R50", "<c/>", 3)],
                                 "endpoint string, id_pdl string, suffix string, xml string, arrival int")
    assert sinks.write_archive(rows, layout, stamp_literal(NOW)) == 2
    assert sinks.write_archive(rows.withColumn("xml", F.lit("<z/>")), layout, stamp_literal(NOW)) == 0
    kept = spark.read.parquet(f"{layout.bronze()}/responses").collect()
    assert {(r.blob_path.split("/bronze/")[1], r.xml) for r in kept} == {
        ("enedis/dtc/P1/2026-06-16T09-03-16.xml", "<a/>"), ("enedis/dtc/P1/2026-06-16T09-03-16__R50.xml", "<c/>")}


def test_archive_reads_and_writes_the_days_of_a_batch(spark, tmp_path):
    layout = lake.Layout(str(tmp_path))
    rows = spark.createDataFrame([("dtc", "P1", None, "<a/>", 1, "2024-03-01 10:00:00"), ("dtc", "P1", None, "<b/>", 2, "2024-03-02 10:00:00"),
                                  ("dtc", "P2", None, "<c/>", 3, None)],
                                 "endpoint string, id_pdl string, suffix string, xml string, arrival int, at string")
    rows = rows.withColumn("at", F.col("at").cast("timestamp_ntz"))
    stamp = F.coalesce("at", stamp_literal(NOW))
    assert sinks.write_archive(rows.limit(0), layout, stamp) == 0
    assert sinks.write_archive(rows.where("arrival <> 2"), layout, stamp) == 2
    old = list(tmp_path.rglob("day=2024-03-01/**/*.parquet"))
    assert len(old) == 1
    old.pop().write_bytes(b"broken")  # a batch of other days must not open it
    assert sinks.write_archive(rows.where("arrival > 1"), layout, stamp) == 1
    assert {p.name for p in (tmp_path / "bronze/enedis/responses").iterdir() if p.is_dir()} == {
        "day=2024-03-01", "day=2024-03-02", f"day={NOW:%Y-%m-%d}"}


def test_migration(spark, tmp_path):
    layout = lake.Layout(str(tmp_path))
    base = dict.fromkeys(schemas.PDL.fieldNames()) | {"id_pdl": "P1", "get_cdc": "true", "get_dm": "true", "statut": "traite"}
    del base["platform_code"]
    relaxed = schemas.T.StructType([schemas.T.StructField(f.name, f.dataType) for f in schemas.PDL if f.name != "platform_code"])
    old = spark.createDataFrame([tuple(base.values())], relaxed)
    assert sinks.migrate(old, layout, "pdl", "platform_code", "1") is None
    path = sinks.migrate(old, layout, "pdl", "platform_code", "1", apply=True)
    done = spark.read.parquet(path)
    assert done.columns == schemas.PDL.fieldNames() and done.head().platform_code == "LEGACY"
    assert sinks.migrate(done, layout, "pdl", "platform_code", "2", apply=True) is None
    with pytest.raises(ValueError):
        sinks.migrate(old, layout, "pdl", "platform_code", "3", value="x" * 11)


def test_appends_batches_and_snapshots_of_one_table_stay_apart(spark, tmp_path):
    layout = lake.Layout(str(tmp_path))
    error = lambda i: spark.createDataFrame([(i, "S1", "m", "s")], "id_pdl string, code_erreur string, message_erreur string, service_appele string")  # noqa: E731,E501
    sinks.log_errors(error("1"), layout, NOW)
    batch = sinks.error_log_rows(error("2"), NOW).withColumn("batch_id", F.lit(0))
    sinks.write_partitions(batch, layout.batches("log_erreur"), "batch_id")
    sinks.write_snapshot(sinks.error_log_rows(error("3"), NOW), layout, "log_erreur", "1")
    sinks.log_errors(error("4"), layout, NOW)
    assert sorted(r.id_pdl for r in lake.read_table(spark, layout, "log_erreur").collect()) == ["1", "2", "4"]
    assert sinks.count_rows(spark, layout, "log_erreur") == 3


def test_bucket_count_is_stored_with_the_table(spark, tmp_path):
    layout = lake.Layout(str(tmp_path))
    rows = measures(spark, ("00000000000001", "TOTAL", 1.0))
    sinks.write_measures(rows, layout, NOW, "arrival", buckets=16)
    assert lake.read_meter(spark, layout, "00000000000001").count() == 1
    with pytest.raises(ValueError, match="16 buckets"):
        lake.read_meter(spark, layout, "00000000000001", buckets=8)
    with pytest.raises(ValueError, match="16 buckets"):
        sinks.write_measures(rows, layout, NOW, "arrival", buckets=8)


def test_null_keys_can_be_written_twice(spark, tmp_path):
    layout = lake.Layout(str(tmp_path))
    rows = measures(spark, ("00000000000001", None, 1.0), ("00000000000002", None, 2.0))
    for _ in range(2):
        sinks.write_measures(rows, layout, NOW, "arrival", buckets=4, null_safe=True)
        assert len(stored(spark, layout)) == 2


def test_migration_of_a_table_with_flags_left_to_their_default(spark, tmp_path):
    orders = spark.createDataFrame(
        [(7, 1, "F", datetime(1995, 1, 1)), (1000003, 2, "O", datetime(1996, 1, 1))],
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    old = adapters.build(spark, str(tmp_path), adapters.PDL).drop("platform_code")
    assert old.where("get_cdc IS NULL").count() == 1
    with pytest.raises(quality.SchemaViolation):  # the gate itself stays strict
        sinks.migrate(old, lake.Layout(f"{tmp_path}/lake"), "pdl", "platform_code", "1", apply=True)
    got = {r.id_pdl: (r.platform_code, r.statut) for r in QUERIES["migrate_store"](spark, str(tmp_path)).collect()}
    assert got == {f"{7:014d}": ("LEGACY", "traite"), f"{1000003:014d}": ("LEGACY", "nouveau")}
