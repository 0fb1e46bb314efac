"""Several micro-batches give the batch result; running a batch again changes nothing."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from meterfold.operators import commands as ops
from meterfold.operators import gas
from meterfold.sources import schemas
from meterfold.sources.lake import Layout, read_measures
from meterfold.streaming import jobs
from test_commands import COMMANDS, STORED, gas_registry, random_commands
from test_lake import measures
from test_reads import HISTORY, spaced

NOW = datetime(2026, 6, 16, 9, 3, 16)


def feed(spark, path, *batches):
    """A directory with one file per batch, read one file per trigger in order."""
    for batch in batches:
        batch.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_measures_stream(spark, tmp_path):
    layout = Layout(f"{tmp_path}/lake")
    batches = [measures(spark, ("A", "TOTAL", 1.0), ("B", "TOTAL", 1.0), ("A", "TOTAL", 2.0)),
               measures(spark, ("A", "TOTAL", 3.0), ("C", "TOTAL", 1.0)),
               measures(spark, ("B", "FRN_P", 4.0))]
    stream = feed(spark, f"{tmp_path}/in", *batches)
    jobs.upsert_measures(stream, layout, NOW, "arrival", f"{tmp_path}/progress", 4).awaitTermination()
    got = sorted((r.id_pdl, r.label, r.val) for r in read_measures(spark, layout).collect())
    assert got == [("A", "TOTAL", 3.0), ("B", "FRN_P", 4.0), ("B", "TOTAL", 1.0), ("C", "TOTAL", 1.0)]


def test_command_stream_equals_the_batch_fold(spark, tmp_path):
    import random

    layout = Layout(f"{tmp_path}/lake")
    asked = random_commands(random.Random(4), ["GI1", "M1", "M2", "M3"], 60)
    registry = gas_registry(spark, STORED, {**STORED, "id_pce": "M1", "etat_droit_acces": "Refusée"})
    jobs.write_registry(registry, layout, gas, 4)
    frames = [spark.createDataFrame(part, COMMANDS) for part in (asked[:25], asked[25:], asked[20:40])]
    stream = feed(spark, f"{tmp_path}/in", *frames)
    jobs.apply_commands(
        stream, layout, gas, schemas.GAS_REGISTRY, NOW, f"{tmp_path}/progress", 4).awaitTermination()

    outcomes, changes = ops.fold(spark.createDataFrame(asked, COMMANDS), registry, gas, NOW)
    logged = spark.read.parquet(jobs.log_path(layout, gas, "outcomes"))
    # The repeated commands of the third file are skipped.
    assert sorted((r.seq, r.http_status) for r in logged.collect()) == sorted(
        (r.seq, r.http_status) for r in outcomes.collect())
    columns = schemas.GAS_REGISTRY.fieldNames()
    stored = jobs.read_registry(spark, layout, gas, schemas.GAS_REGISTRY).select(*columns)
    want = ops.apply_changes(registry, changes, gas).select(*columns)
    assert sorted(map(tuple, stored.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_rerun_of_a_logged_batch_only_repeats_the_registry_write(spark, tmp_path):
    layout = Layout(f"{tmp_path}/lake")
    jobs.write_registry(gas_registry(spark, STORED), layout, gas, 4)
    asked = spark.createDataFrame([(1, "GI1", "revoke", None)], COMMANDS)
    stream = feed(spark, f"{tmp_path}/in", asked)
    for progress in ("first", "second"):
        jobs.apply_commands(stream, layout, gas, schemas.GAS_REGISTRY, NOW,
                            f"{tmp_path}/{progress}", 4).awaitTermination()
    logged = spark.read.parquet(jobs.log_path(layout, gas, "outcomes")).collect()
    assert [r.http_status for r in logged] == [200]
    stored = jobs.read_registry(spark, layout, gas, schemas.GAS_REGISTRY).collect()
    assert [r.etat_droit_acces for r in stored] == ["Révoquée"]


def test_suppression_stream(spark, tmp_path):
    rows = [("A", "x", NOW + timedelta(days=d), f"{d:02d}") for d in (0, 3, 8, 9, 16, 30)]
    rows += [("B", "x", NOW + timedelta(days=d), f"b{d:02d}") for d in (1, 2, 20)]
    frames = [spark.createDataFrame(part, HISTORY) for part in (rows[:2] + rows[6:8], rows[2:5], rows[5:6] + rows[8:])]
    stream = feed(spark, f"{tmp_path}/in", *frames)
    jobs.suppress_requests(stream, f"{tmp_path}/accepted", 7, f"{tmp_path}/progress").awaitTermination()
    got = sorted(r.id_affaire for r in spark.read.parquet(f"{tmp_path}/accepted").collect())
    assert got == spaced(rows, [], 7)


def test_quarantine_stream(spark, tmp_path):
    layout = Layout(f"{tmp_path}/lake")
    rows = spark.createDataFrame([("A", "S1", "ok"), ("9" * 15, "S1", "long"), (None, "S1", "null")],
                                 "id_pdl string, service_appele string, message_erreur string")
    stream = feed(spark, f"{tmp_path}/in", rows)
    jobs.quarantine(stream, "log_erreur", Layout(f"{tmp_path}/lake"), NOW, F.lit("QUALITE"), "controle",
                    f"{tmp_path}/progress").awaitTermination()
    bad = spark.read.parquet(f"{layout.root}/quarantine/log_erreur")
    assert sorted(r.row_errors[0] for r in bad.collect()) == ["id_pdl:max_length", "id_pdl:not_null"]


def test_creations_without_an_id_all_get_an_outcome(spark, tmp_path):
    layout = Layout(f"{tmp_path}/lake")
    body = {"partner": "ifpeb"}
    rows = spark.createDataFrame(
        [(1, None, "create", {**body, "code_postal": str(i)}) for i in range(3)],
        "seq bigint, id string, op string, body map<string,string>")
    empty = spark.createDataFrame([], schemas.GAS_REGISTRY)
    jobs.write_registry(empty, layout, gas, 4)
    path = f"{tmp_path}/in"
    rows.write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).parquet(path)
    jobs.apply_commands(stream, layout, gas, empty.schema, NOW, f"{tmp_path}/progress", 4).awaitTermination()
    logged = spark.read.parquet(jobs.log_path(layout, gas, "outcomes"))
    assert logged.count() == 3
