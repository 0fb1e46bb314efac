"""Every registered query: (spark, sf_dir) -> DataFrame."""

from datetime import datetime
from functools import partial

from pyspark.sql import DataFrame, SparkSession, functions as F

from meterfold import fixed_values as fv
from meterfold.functions.booleans import bool_text, parse_bool
from meterfold.functions.dates import (
    lenient_iso_day, measure_format, measure_stamp, measure_uuid, show_stamp, show_typed_stamp,
    stamp_literal,
)
from meterfold.functions.payload import is_json_payload, payload_field, payload_text
from meterfold.operators import (
    access, commands, consumption, dedup, electricity, gas, merge, quality, registry, requests,
)
from meterfold.plans import adapters as a
from meterfold.session import scratch_root, stored_once
from meterfold.sources import sinks
from meterfold.sources.lake import (
    Layout, read_asked, read_commands, read_gas_meter, read_measures, read_meter, read_registry, read_table,
)
from meterfold.streaming import jobs

NOW = datetime.fromisoformat(a.NOW)
RECENT_NOW, RECENT_DAYS = datetime(2024, 1, 25), 7
FOLDED_STATE = [
    "id_pce", "etat_droit_acces", "code_postal", "courriel_titulaire", "date_debut_droit_acces",
    "date_fin_droit_acces", "raison_sociale_du_titulaire", "nom_titulaire",
    *fv.GAS_PERIMETERS, "nb_tentatives_declare", "message_erreur_declare",
]
RESULT = ["id", "op", "http_status", "erreur", "champ", "message", "statut"]


# --- consumption ---------------------------------------------------------------------------

def consumption_contained(spark: SparkSession, sf: str) -> DataFrame:
    """TOTAL periods of every meter inside one window."""
    low, high = F.lit("2024-01-05").cast("date"), F.lit("2024-02-05").cast("date")
    total = consumption.electricity_total(a.build(spark, sf, a.MEASURES))
    kept = total.where(consumption.contained(low, high))
    return consumption.present(kept).select(*consumption.SHAPE)


def meter_periods(spark, sf):
    """TOTAL periods of one meter inside a window, by their start as text."""
    return consumption.meter_periods(
        a.build(spark, sf, a.MEASURES), "00000000000007", "2024-01-03", "2024-02-20")


def measure_conventions(spark, sf):
    """Stamp, uuid and format of every measurement, derived from its meter and its last day."""
    return a.build(spark, sf, a.MEASURES).select(
        "arrival", measure_stamp(F.col("date_fin")).alias("ts"),
        measure_uuid(F.col("id_pdl")).alias("uuid"), measure_format().cast("int").alias("fmt"))


def _periods(spark, sf):
    return a.build(spark, sf, a.GAS_PERIODS), a.build(spark, sf, a.MEASURES)


def consumption_union(spark, sf):
    return consumption.present(consumption.all_periods(*_periods(spark, sf))).select(
        *consumption.SHAPE)


def consumption_requests(spark, sf):
    periods = consumption.all_periods(*_periods(spark, sf))
    return consumption.requested_periods(a.build(spark, sf, a.REQUESTS), periods)


def consumption_outcome(spark, sf):
    sources = _periods(spark, sf)
    return consumption.request_outcomes(
        a.build(spark, sf, a.REQUESTS), consumption.all_periods(*sources),
        consumption.known_sensors(*sources))


# --- measurements --------------------------------------------------------------------------

def _halves(spark, sf):
    """Stored measurements, and the arrivals to merge into them."""
    rows = a.build(spark, sf, a.MEASURES)
    return (
        dedup.last_arrived(rows.where("arrival % 2 = 0"), ["id_pdl", "label", "ts"], "arrival"),
        rows.where("arrival % 2 = 1"),
    )


def measures_keep_latest(spark, sf):
    stored, arrivals = _halves(spark, sf)
    keys = ["id_pdl", "label", "ts"]
    return merge.merge_rows(stored, arrivals, keys, "arrival")


def measures_merge_stats(spark, sf):
    stored, arrivals = _halves(spark, sf)
    return merge.merge_stats(stored, arrivals, ["id_pdl", "label", "ts"], "arrival")


# --- gas registry merges -------------------------------------------------------------------

def rights_dedup(spark, sf):
    return dedup.latest_rights(a.build(spark, sf, a.RIGHTS_FEED))


def _upsert_feed(spark, sf):
    table, columns = a.UPSERT_FEED
    fields = {c: f"CASE WHEN {on} THEN {v} END" for c, (on, v) in a.UPSERT_FIELDS.items()}
    present = ", ".join(f"CASE WHEN {on} THEN '{c}' END" for c, (on, _) in a.UPSERT_FIELDS.items())
    return a.build(spark, sf, (
        table, {**columns, **fields, "fields_set": f"array_compact(array({present}))"}))


def registry_upsert_partial(spark, sf):
    merged = merge.partial_upsert(
        a.build(spark, sf, a.GAS_REGISTRY), _upsert_feed(spark, sf), NOW)
    return merged.select("id_pce", "partner", *a.UPSERT_FIELDS, "derniere_maj")


def upsert_one(spark, sf):
    """One record for a stored meter, then one for a new meter."""
    rows, fields = a.build(spark, sf, a.GAS_REGISTRY), {"nom_titulaire": None, "motif": "essai"}
    for id_pce in ("PCE00000000007", "NEUF"):
        rows = merge.upsert_one(rows, id_pce, fields, NOW)
    return rows.select("id_pce", "partner", "nom_titulaire", "motif", "derniere_maj")


def registry_upsert_stats(spark, sf):
    return merge.upsert_stats(a.build(spark, sf, a.GAS_REGISTRY), _upsert_feed(spark, sf))


def _offered(spark, sf):
    """Rows offered for insertion, several per id."""
    table, seq, target = a.GAS_STRAYS
    return a.read(spark, sf, table).selectExpr(
        f"{target} AS id_pce", "'proposé' || l_linestatus AS etat_droit_acces",
        f"{a.spark_sql(seq)} AS seq")


def insert_if_absent(spark, sf):
    table, _ = merge.insert_if_absent(
        a.build(spark, sf, a.GAS_REGISTRY), _offered(spark, sf), "id_pce", "seq", "etat_droit_acces")
    return table.select("id_pce", "partner", "etat_droit_acces")


def insert_conflicts(spark, sf):
    _, conflicts = merge.insert_if_absent(
        a.build(spark, sf, a.GAS_REGISTRY), _offered(spark, sf), "id_pce", "seq", "etat_droit_acces")
    return conflicts.select("seq.*", "id_pce", "etat_droit_acces", "existing_status")


def insert_errors(spark, sf):
    return merge.insert_errors(a.build(spark, sf, a.RIGHTS_FEED), "id_pce").select("id_pce", "input_ord")


def delete_keys(spark, sf):
    returned = a.read(spark, sf, "lineitem").where("l_returnflag = 'R'").selectExpr(
        f"{a.GAS_LINES[2]} AS id_pce")
    kept = merge.delete_keys(a.build(spark, sf, a.GAS_REGISTRY), returned, "id_pce")
    return registry.dump_view(kept)


def delete_rows(spark, sf):
    rows = a.build(spark, sf, a.GAS_REGISTRY)
    return registry.dump_view(merge.delete_where(rows, "date_fin_droit_acces < '1998-01-01'"))


def update_rows(spark, sf):
    rows = a.build(spark, sf, a.PDL)
    changed = merge.update_where(rows, "statut = 'erreur' AND get_dm = 'true'", {
        "statut": "'partiel'", "commentaire": "concat('suite à ', statut)"})
    return changed.select("id_pdl", "statut", "commentaire", "get_dm")


# --- reads ---------------------------------------------------------------------------------

def filter_six_ops(spark, sf):
    rows = a.build(spark, sf, a.GAS_REGISTRY)
    found = None
    for op in ("=", "!=", "<", ">", "<=", ">="):
        part = registry.filter_by(rows, "date_fin_droit_acces", op, "1998-03-15").select(
            F.lit(op).alias("op"), "id_pce", "date_fin_droit_acces")
        found = part if found is None else found.unionByName(part)
    return found


def _plain_payload(view: DataFrame) -> DataFrame:
    """The variant payload as JSON text."""
    return view.withColumn("message_erreur", F.to_json("message_erreur"))


def lookup_batch(spark, sf):
    rows = a.build(spark, sf, a.GAS_REGISTRY)
    ids = a.read(spark, sf, "lineitem").selectExpr(
        "'PCE' || lpad(CAST(l_orderkey * 2 AS STRING), 11, '0') AS id_pce").distinct()
    return commands.lookup(ids, rows, gas, _plain_payload(registry.gas_view(rows)))


def lookup_batch_elec(spark, sf):
    rows = a.build(spark, sf, a.PDL)
    ids = a.read(spark, sf, "lineitem").selectExpr(
        "lpad(CAST(l_orderkey * 2 AS STRING), 14, '0') AS id_pdl").distinct()
    return commands.lookup(ids, rows, electricity, _plain_payload(registry.elec_view(rows)))


def existence(spark, sf):
    ids = a.read(spark, sf, "lineitem").selectExpr(f"{a.GAS_STRAYS[2]} AS id_pce").distinct()
    return registry.with_existence(ids, a.build(spark, sf, a.GAS_REGISTRY), "id_pce")


def by_state(spark, sf):
    return registry.dump_view(
        registry.in_state(a.build(spark, sf, a.GAS_REGISTRY), "A revérifier"))


def active_without_field(spark, sf):
    rows = a.build(spark, sf, a.GAS_REGISTRY)
    with_column = registry.active_without(rows, "dernier_appel_techniques")
    without_column = registry.active_without(rows, "date_onboard_history")
    return with_column.select(F.lit("techniques").alias("todo"), "id_pce").unionByName(
        without_column.select(F.lit("onboard").alias("todo"), "id_pce"))


def list_page(spark, sf):
    rows = a.build(spark, sf, a.GAS_REGISTRY)
    wanted = registry.page_request(spark, " Active ", "100", "40")
    return _plain_payload(registry.gas_page(rows, wanted))


def list_page_elec(spark, sf):
    rows = a.build(spark, sf, a.PDL)
    wanted = registry.page_request(spark, "traite", None, "120", fv.ELEC_STATES)
    return _plain_payload(registry.elec_page(rows, wanted))


def list_page_deep(spark, sf):
    rows = a.build(spark, sf, a.GAS_REGISTRY)
    wanted = registry.page_request(spark, None, "100", "13500")
    return _plain_payload(registry.gas_page(rows, wanted))


def list_page_deep_elec(spark, sf):
    rows = a.build(spark, sf, a.PDL)
    wanted = registry.page_request(spark, None, "70", "14100", fv.ELEC_STATES)
    return _plain_payload(registry.elec_page(rows, wanted))


def listing_checks(spark, sf):
    """The parameters of listing requests, checked as a table."""
    checked = registry.check_listings(a.build(spark, sf, a.LISTINGS))
    return checked.select("req_id", "statut", "limit", "offset", "err.*")


def list_after_key(spark, sf):
    rows = a.build(spark, sf, a.GAS_REGISTRY)
    return registry.page_after(registry.dump_view(rows), "id_pce", "PCE00000000700", 50)


def count_by_status(spark, sf):
    rows = a.build(spark, sf, a.GAS_REGISTRY)
    return registry.count_by_status(rows, "etat_droit_acces")


def row_counts(spark, sf):
    return a.build(spark, sf, a.PDL).agg(F.count(F.lit(1)).alias("n"))


def collected_meters(spark, sf):
    return registry.collected(a.build(spark, sf, a.PDL)).select("id_pdl", "statut")


def gas_views(spark, sf):
    return _plain_payload(registry.gas_view(a.build(spark, sf, a.GAS_REGISTRY)))


def elec_views(spark, sf):
    return _plain_payload(registry.elec_view(a.build(spark, sf, a.PDL)))


# --- quality -------------------------------------------------------------------------------

def dq_report(spark, sf):
    return quality.quality_report(a.build(spark, sf, a.FAULTY_PDL), "pdl").unionByName(
        quality.quality_report(a.build(spark, sf, a.FAULTY_DTC), "dtc"))


def dq_quarantine(spark, sf):
    _, bad = quality.split_valid(a.build(spark, sf, a.FAULTY_PDL), "pdl")
    return bad.select("partner", "id_pdl", F.array_join("row_errors", ",").alias("row_errors"))


# --- commands ------------------------------------------------------------------------------

def _validation(book, body, spark, sf):
    asked = a.commands(spark, sf, a.CREATES, body, "'create'")
    return commands.validate_creations(asked, book).select("seq", "erreur", "champ", "message")


def _create_folded(book, body, spark, sf):
    rows = a.build(spark, sf, a.GAS_REGISTRY if book is gas else a.PDL)
    asked = a.commands(spark, sf, a.CREATES, body, "'create'")
    outcomes, _ = commands.fold(asked, rows, book, NOW)
    return outcomes.select("seq", *RESULT)


def _judged(book, lines, body, op, spark, sf):
    rows = a.build(spark, sf, a.GAS_REGISTRY if book is gas else a.PDL)
    asked = a.commands(spark, sf, lines, body, f"'{op}'")
    return commands.judge(asked, rows, book).select("seq.*", *RESULT)


def _folded(book, lines, body, spark, sf):
    rows = a.build(spark, sf, a.GAS_REGISTRY if book is gas else a.PDL)
    return rows, commands.fold(a.commands(spark, sf, lines, body, a.LINE_OP), rows, book, NOW)


def command_fold(spark, sf):
    _, (outcomes, _) = _folded(gas, a.GAS_LINES, a.GAS_PATCH, spark, sf)
    return outcomes.select("seq.*", *RESULT)


def command_fold_hot(spark, sf):
    """One meter gets a hundredth of all commands: its sequence is cut into chunks."""
    _, (outcomes, _) = _folded(gas, a.GAS_HOT, a.GAS_PATCH, spark, sf)
    return outcomes.select("seq.*", *RESULT)


def command_fold_state(spark, sf):
    """Registry after all commands."""
    rows, (_, changes) = _folded(gas, a.GAS_LINES, a.GAS_PATCH, spark, sf)
    return commands.apply_changes(rows, changes, gas).select(*FOLDED_STATE)


def command_fold_elec(spark, sf):
    _, (outcomes, _) = _folded(electricity, a.ELEC_LINES, a.ELEC_PATCH, spark, sf)
    return outcomes.select("seq.*", *RESULT)


# --- requests, bookkeeping -----------------------------------------------------------------

def recent_request(spark, sf):
    return requests.recent_requests(
        a.build(spark, sf, a.ASKED), a.build(spark, sf, a.HISTORY), RECENT_NOW, RECENT_DAYS
    ).withColumn("datetime_requete", show_typed_stamp(F.col("datetime_requete")))


def suppress_recent(spark, sf):
    return requests.not_recent(
        a.build(spark, sf, a.ASKED), a.build(spark, sf, a.HISTORY), RECENT_NOW, RECENT_DAYS)


def accept_spaced(spark, sf):
    asked = a.build(spark, sf, a.HISTORY).where("datetime_requete IS NOT NULL")
    return requests.accept_spaced(asked, asked.limit(0), RECENT_DAYS).select(
        "id_pdl", "code_prestation", "id_affaire")


def mark_collected(spark, sf):
    rows = a.build(spark, sf, a.GAS_REGISTRY)
    marked = registry.mark_collected(rows, a.build(spark, sf, a.CALLS), NOW)
    return marked.select("id_pce", *fv.COLLECTION_STAMPS.values(), "api_response_code", "derniere_maj")


def mark_onboarded(spark, sf):
    rows = a.build(spark, sf, a.GAS_REGISTRY)
    marked = registry.mark_onboarded(rows, a.build(spark, sf, a.CALLS), NOW)
    return marked.select("id_pce", "date_onboard_history", "api_response_onboard_history", "derniere_maj")


def status_update(spark, sf):
    updated = registry.update_status(
        a.build(spark, sf, a.PDL), a.build(spark, sf, a.STATUS_UPDATES), NOW)
    return updated.select(
        "id_pdl", "statut", "statut_cdc", "commentaire",
        show_typed_stamp(F.col("date_modification")).alias("date_modification"))


def error_set_clear(spark, sf):
    rows = registry.set_errors(a.build(spark, sf, a.PDL), a.build(spark, sf, a.ERRORS), NOW)
    cleared = registry.clear_errors(rows, F.col("statut") == "traite", NOW)
    return cleared.select(
        "id_pdl",
        payload_field(F.col("erreur"), "code_statut_traitement").alias("code"),
        payload_field(F.col("erreur"), "message_retour_traitement").alias("message"),
        show_typed_stamp(F.col("date_modification")).alias("date_modification"))


def error_log(spark, sf):
    errors = a.build(spark, sf, a.ERRORS).selectExpr(
        "id_pdl", "code AS code_erreur", "message AS message_erreur",
        "'ConsultationMesures' AS service_appele",
        "CASE WHEN code LIKE '%1' THEN TIMESTAMP_NTZ '2024-05-05 10:00:00' END AS timestamp")
    return sinks.error_log_rows(errors, NOW).withColumn(
        "timestamp", show_typed_stamp(F.col("timestamp")))


def append_log(spark, sf):
    """Two appends to one table, read back whole."""
    layout = Layout(scratch_root(spark))
    errors = a.build(spark, sf, a.ERRORS).selectExpr(
        "id_pdl", "code AS code_erreur", "message AS message_erreur",
        "'ConsultationMesures' AS service_appele",
        "CASE WHEN code LIKE '%1' THEN TIMESTAMP_NTZ '2024-05-05 10:00:00' END AS timestamp")
    first = F.coalesce(F.col("code_erreur"), F.lit("")).endswith("1")
    for part in (errors.where(first), errors.where(~first)):
        sinks.log_errors(part, layout, NOW)
    return read_table(spark, layout, "log_erreur").withColumn(
        "timestamp", show_typed_stamp(F.col("timestamp")))


def snapshot_roundtrip(spark, sf):
    """A registry written as one version, changed into the next, and that one read back."""
    layout = Layout(scratch_root(spark))
    sinks.write_snapshot(a.build(spark, sf, a.GAS_REGISTRY), layout, "droits_acces", "1")
    sinks.rewrite_snapshot(
        read_registry(spark, layout, "1"), lambda df: df.withColumn("partner", F.upper("partner")),
        layout, "droits_acces", "2")
    return read_registry(spark, layout, "2").select("id_pce", "partner", "etat_droit_acces")


def read_one_meter(spark, sf):
    """Measurements stored by bucket, one meter read back without naming the bucket count."""
    layout = Layout(scratch_root(spark))
    sinks.write_measures(a.build(spark, sf, a.MEASURES), layout, NOW, "arrival", buckets=16)
    return read_meter(spark, layout, "00000000000007").select("id_pdl", "label", "val", "ts")


def gas_meter(spark, sf):
    """Gas periods stored by bucket, one meter read back."""
    layout = Layout(scratch_root(spark))
    sinks.write_gas_periods(a.build(spark, sf, a.GAS_PERIODS), layout, buckets=16)
    return read_gas_meter(spark, layout, "PCE00000000007")


def consumption_lake(spark, sf):
    """Request outcomes from stored tables, of which only the asked buckets are read."""
    layout = Layout(scratch_root(spark))
    gas_periods, measures = _periods(spark, sf)
    sinks.write_gas_periods(gas_periods, layout, buckets=32)
    sinks.write_measures(measures, layout, NOW, "arrival", buckets=32)
    asked = a.build(spark, sf, a.REQUESTS)
    checked = stored_once(consumption.check_requests(asked))
    sources = read_asked(spark, layout, checked.where("err IS NULL"))
    return consumption.request_outcomes(
        asked, consumption.all_periods(*sources), consumption.known_sensors(*sources), checked)


def lake_upsert(spark, sf):
    """A feed of partial records merged into the stored registry, bucket by bucket."""
    layout, rows = Layout(scratch_root(spark)), a.build(spark, sf, a.GAS_REGISTRY)
    stored = rows.withColumn("motif", F.lit(None).cast("string"))
    sinks.agreed_buckets(spark, layout, sinks.registry_table("id_pce"), 16, store=True)
    sinks.write_registry(stored, layout, "id_pce", 16)
    sinks.upsert_registry(_upsert_feed(spark, sf), layout, stored.schema, NOW)
    return jobs.read_registry(spark, layout, gas, stored.schema).select(
        "id_pce", "partner", *a.UPSERT_FIELDS, "derniere_maj")


def history_requests(spark, sf):
    sent = a.build(spark, sf, a.HISTORY).selectExpr(
        "id_affaire", "id_pdl", "code_prestation", "'false' AS mesures_corrigees",
        "'COURBES' AS mesures_type_code", "'2024-1-5' AS date_debut_demandee",
        "CAST(CAST(datetime_requete AS DATE) AS STRING) AS date_fin_demandee")
    return sinks.history_request_rows(sent, NOW).withColumn(
        "datetime_requete", show_typed_stamp(F.col("datetime_requete"))
    ).withColumn("date_premiere_valeur", show_typed_stamp(F.col("date_premiere_valeur")))


def history_requests_store(spark, sf):
    """Sent requests stored in two batches, the second of which repeats the first."""
    layout = Layout(scratch_root(spark))
    sent = a.build(spark, sf, a.HISTORY).selectExpr(
        "id_affaire", "id_pdl", "code_prestation", "'false' AS mesures_corrigees",
        "'COURBES' AS mesures_type_code", "'2024-1-5' AS date_debut_demandee",
        "CAST(CAST(datetime_requete AS DATE) AS STRING) AS date_fin_demandee")
    sinks.log_history_requests(sent.where(F.col("id_affaire").endswith("3")), layout, NOW)
    sinks.log_history_requests(sent, layout, NOW, ignore_known=True)
    return read_table(spark, layout, "demandes_historique").withColumns({
        c: show_typed_stamp(F.col(c)) for c in ("datetime_requete", "date_premiere_valeur")})


# --- scalar functions ----------------------------------------------------------------------

def error_payload(spark, sf):
    raw = F.col("raw")
    return a.build(spark, sf, a.PAYLOADS).select(
        "event_id", payload_text(raw).alias("text"), is_json_payload(raw).alias("is_json"),
        payload_field(raw, "k").alias("k"))


def json_commands(spark, sf):
    """Request bodies from JSON: an absent field differs from a null one."""
    body = F.col("body")
    return read_commands(a.build(spark, sf, a.JSON_BODIES)).select(
        "l_orderkey", "l_linenumber", body["code_postal"].alias("code_postal"),
        body["nom_titulaire"].alias("nom_titulaire"),
        F.map_contains_key(body, "nom_titulaire").alias("has_nom"),
        body["perim_donnees_publiees"].alias("perim_donnees_publiees"))


def lenient_days(spark, sf):
    return a.build(spark, sf, a.STAMPS).select("event_id", lenient_iso_day(F.col("raw")).alias("day"))


def format_timestamps(spark, sf):
    return a.build(spark, sf, a.STAMPS).select("event_id", show_stamp(F.col("raw")).alias("shown"))


def bool_dialects(spark, sf):
    return a.build(spark, sf, a.WORDS).select(
        "doc_id", *[parse_bool(F.col("word"), d).alias(d) for d in fv.BOOLEAN_DIALECTS],
        bool_text(F.col("word"), F.lit("true")).alias("stored_text"))


# --- migration, archive, access ------------------------------------------------------------

def migrate_backfill(spark, sf):
    old = a.build(spark, sf, a.PDL).drop("platform_code")
    return sinks.add_backfilled(old, "pdl", "platform_code", fv.BACKFILL_PLATFORM_CODE).select(
        "id_pdl", "platform_code", "statut")


def migrate_store(spark, sf):
    """The migrated table, written as a snapshot and read back; the stored one has its declared defaults."""
    old = sinks.with_defaults(a.build(spark, sf, a.PDL).drop("platform_code"), "pdl")
    path = sinks.migrate(old, Layout(scratch_root(spark)), "pdl", "platform_code", "1", apply=True)
    return spark.read.parquet(path).select("id_pdl", "platform_code", "statut")


def archive_store(spark, sf):
    """Responses archived in two batches, the second of which repeats the first."""
    layout, responses = Layout(scratch_root(spark)), a.build(spark, sf, a.RESPONSES)
    for batch in (responses.where("arrival % 3 = 0"), responses):
        sinks.write_archive(batch, layout, stamp_literal(NOW))
    kept = spark.read.parquet(f"{layout.bronze()}/responses")
    return kept.select("endpoint", "id_pdl", "arrival", F.md5("xml").alias("xml_md5"),
                       F.date_format("day", "yyyy-MM-dd").alias("day"))


def bronze_archive(spark, sf):
    kept = sinks.archive_rows(a.build(spark, sf, a.RESPONSES), Layout("lake"), stamp_literal(NOW))
    return kept.select("blob_path", "arrival", F.md5("xml").alias("xml_md5"))


def access_audit(spark, sf):
    audited = access.audit_access(a.build(spark, sf, a.ACCESS_LOG), a.ALLOWED_IPS)
    return audited.select("event_id", "client_hex", "allowed")


def access_refusals(spark, sf):
    audited = access.audit_access(a.build(spark, sf, a.ACCESS_LOG), a.ALLOWED_IPS)
    return access.refusals(audited).select("event_id", "client_hex", "http_status", "erreur", "message")


def access_audit_many(spark, sf):
    """The audit with a list of more than a thousand networks."""
    audited = access.audit_access(a.build(spark, sf, a.ACCESS_LOG), a.MANY_IPS)
    return audited.select("event_id", "client_hex", "allowed")


# --- streams: each reads a benchmark file as a stream and returns what the job stored --------

def _stream(spark, sf, table, *columns):
    schema = a.read(spark, sf, table).schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf)
    return rows.select(*columns) if columns else rows


def _spec_stream(spark, sf, spec):
    table, columns = spec
    return _stream(spark, sf, table).selectExpr(
        *[f"{a.spark_sql(sql)} AS `{name}`" for name, sql in columns.items()])


def stream_measures(spark, sf):
    layout = Layout(scratch_root(spark))
    jobs.upsert_measures(
        _spec_stream(spark, sf, a.MEASURES), layout, NOW, "arrival", f"{layout.root}/progress", 16
    ).awaitTermination()
    stored = read_measures(spark, layout).drop("bucket", "month")
    return stored.withColumn("ingestion_ts", show_typed_stamp(F.col("ingestion_ts")))


def stream_commands(spark, sf):
    layout = Layout(scratch_root(spark))
    rows = a.build(spark, sf, a.GAS_REGISTRY)
    jobs.write_registry(rows, layout, gas, 16)
    table, seq, target = a.GAS_LINES
    asked = _stream(
        spark, sf, table, F.expr(a.spark_sql(seq)).alias("seq"), F.expr(target).alias("id"),
        F.expr(a.LINE_OP).alias("op"), a.body_map(a.GAS_PATCH).alias("body"))
    jobs.apply_commands(
        asked, layout, gas, rows.schema, NOW, f"{layout.root}/progress", 16
    ).awaitTermination()
    stored = jobs.read_registry(spark, layout, gas, rows.schema)
    return stored.select(*FOLDED_STATE)


def stream_suppress(spark, sf):
    root = scratch_root(spark)
    jobs.suppress_requests(
        _spec_stream(spark, sf, a.HISTORY), f"{root}/accepted", RECENT_DAYS, f"{root}/progress"
    ).awaitTermination()
    return spark.read.parquet(f"{root}/accepted").select("id_pdl", "code_prestation", "id_affaire")


def stream_quarantine(spark, sf):
    layout = Layout(scratch_root(spark))
    jobs.quarantine(
        _spec_stream(spark, sf, a.FAULTY_PDL), "pdl", layout, NOW, F.lit("QUALITE"), "controle",
        f"{layout.root}/progress"
    ).awaitTermination()
    kept = read_table(spark, layout, "pdl").select(
        F.lit("valid").alias("kind"), "id_pdl", F.lit(None).cast("string").alias("detail"))
    logged = read_table(spark, layout, "log_erreur").select(
        F.lit("error").alias("kind"), "id_pdl", F.col("message_erreur").alias("detail"))
    return kept.unionByName(logged)


QUERIES = {
    "consumption_contained": consumption_contained,
    "meter_periods": meter_periods,
    "measure_conventions": measure_conventions,
    "consumption_union": consumption_union,
    "consumption_requests": consumption_requests,
    "consumption_outcome": consumption_outcome,
    "measures_keep_latest": measures_keep_latest,
    "measures_merge_stats": measures_merge_stats,
    "rights_dedup": rights_dedup,
    "registry_upsert_partial": registry_upsert_partial,
    "upsert_one": upsert_one,
    "registry_upsert_stats": registry_upsert_stats,
    "insert_if_absent": insert_if_absent,
    "insert_conflicts": insert_conflicts,
    "insert_errors": insert_errors,
    "append_log": append_log,
    "snapshot_roundtrip": snapshot_roundtrip,
    "read_one_meter": read_one_meter,
    "gas_meter": gas_meter,
    "consumption_lake": consumption_lake,
    "lake_upsert": lake_upsert,
    "delete_keys": delete_keys,
    "delete_rows": delete_rows,
    "update_rows": update_rows,
    "filter_six_ops": filter_six_ops,
    "lookup_batch": lookup_batch,
    "lookup_batch_elec": lookup_batch_elec,
    "existence": existence,
    "by_state": by_state,
    "active_without_field": active_without_field,
    "list_page": list_page,
    "list_page_elec": list_page_elec,
    "list_page_deep": list_page_deep,
    "list_page_deep_elec": list_page_deep_elec,
    "listing_checks": listing_checks,
    "list_after_key": list_after_key,
    "count_by_status": count_by_status,
    "row_counts": row_counts,
    "collected_meters": collected_meters,
    "gas_views": gas_views,
    "elec_views": elec_views,
    "dq_report": dq_report,
    "dq_quarantine": dq_quarantine,
    "validate_create_gas": partial(_validation, gas, a.GAS_CREATE),
    "validate_create_elec": partial(_validation, electricity, a.ELEC_CREATE),
    "create_gas": partial(_create_folded, gas, a.GAS_CREATE),
    "create_elec": partial(_create_folded, electricity, a.ELEC_CREATE),
    "validate_patch_gas": partial(_judged, gas, a.GAS_STRAYS, a.GAS_PATCH, "patch"),
    "validate_patch_elec": partial(_judged, electricity, a.ELEC_STRAYS, a.ELEC_PATCH, "patch"),
    "state_revoke_gas": partial(_judged, gas, a.GAS_STRAYS, a.GAS_PATCH, "revoke"),
    "state_revoke_elec": partial(_judged, electricity, a.ELEC_STRAYS, a.ELEC_PATCH, "revoke"),
    "state_retry_gas": partial(_judged, gas, a.GAS_STRAYS, a.GAS_PATCH, "retry"),
    "state_retry_elec": partial(_judged, electricity, a.ELEC_STRAYS, a.ELEC_PATCH, "retry"),
    "command_fold": command_fold,
    "command_fold_state": command_fold_state,
    "command_fold_elec": command_fold_elec,
    "command_fold_hot": command_fold_hot,
    "recent_request": recent_request,
    "suppress_recent": suppress_recent,
    "accept_spaced": accept_spaced,
    "mark_collected": mark_collected,
    "mark_onboarded": mark_onboarded,
    "status_update": status_update,
    "error_set_clear": error_set_clear,
    "error_log": error_log,
    "history_requests": history_requests,
    "history_requests_store": history_requests_store,
    "error_payload": error_payload,
    "json_commands": json_commands,
    "lenient_days": lenient_days,
    "format_timestamps": format_timestamps,
    "bool_dialects": bool_dialects,
    "migrate_backfill": migrate_backfill,
    "migrate_store": migrate_store,
    "bronze_archive": bronze_archive,
    "archive_store": archive_store,
    "access_audit": access_audit,
    "access_audit_many": access_audit_many,
    "access_refusals": access_refusals,
    "stream_measures": stream_measures,
    "stream_commands": stream_commands,
    "stream_suppress": stream_suppress,
    "stream_quarantine": stream_quarantine,
}
