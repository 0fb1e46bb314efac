"""Declared table schemas; constraints travel as ``StructField`` metadata."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from meterfold import fixed_values as fv


def _field(name, kind, native, required=False, **meta):
    return T.StructField(name, kind, not required, {"native_type": native, **meta})


def _text(name, length=None, required=False, enum=None, default=None, native=None):
    meta = {}
    if length is not None:
        meta["max_length"] = length
    if enum is not None:
        meta["enum_values"] = list(enum)
    if default is not None:
        meta["default"] = default
    return _field(name, T.StringType(), native or f"varchar({length})", required, **meta)


def _flag(name, required=False, default=None):
    return _text(name, required=required, enum=fv.TRUE_FALSE, default=default,
                 native="enum('true','false')")


def _day(name):
    return _field(name, T.DateType(), "date")


def _moment(name, default=None):
    meta = {"default": default} if default else {}
    return _field(name, T.TimestampNTZType(), "datetime", **meta)


PDL = T.StructType([
    _text("id_pdl", 14, required=True),
    _text("partner", 100),
    _text("platform_code", 10, required=True),
    _day("date_signature_mandat"),
    _day("date_debut_autorisation"),
    _day("date_fin_autorisation"),
    _text("raison_sociale", 100),
    _text("civilite", 20),
    _text("nom", 50),
    _text("prenom", 50),
    _moment("date_creation", "CURRENT_TIMESTAMP"),
    _moment("date_modification", "CURRENT_TIMESTAMP ON UPDATE CURRENT_TIMESTAMP"),
    _flag("injection"),
    _flag("soutirage"),
    _flag("get_cdc", required=True, default="true"),
    _flag("get_dm", required=True, default="true"),
    _flag("statut_cdc"),
    _flag("statut_dm"),
    _day("date_premiere_valeur_dm"),
    _text("statut", required=True, enum=fv.ELEC_STATES, default=fv.NEW_STATE,
          native="enum('nouveau','traite','revoque','erreur','partiel','processing','résilié')"),
    _text("commentaire", 50),
    _text("erreur", native="string (JSON)", default="null"),
])

DTC = T.StructType([
    _text("id_pdl", 14, required=True),
    _text("etat_contractuel", 6),
    _text("segment", 5, enum=fv.SEGMENTS),
    _field("niveau_ouverture_services", T.LongType(), "int(11)"),
    *[_text(name, length) for name, length in (
        ("matricule", 50), ("type_compteur", 6), ("tension_livraison", 10),
        ("puissance_souscrite_max_valeur", 10), ("puissance_souscrite_max_unite", 4),
        ("longue_utilisation_contexte", 4), ("mode_traitement", 5), ("periodicite_releve", 6),
        ("plage_releve", 4), ("mode_releve", 4), ("media_releve", 3),
        ("escalier_etage_appartement", 255), ("batiment", 255), ("numero_voie", 255),
        ("lieu_dit", 255), ("code_postal", 5), ("commune", 255), ("code_insee", 5),
    )],
])

# mesures_type_code is declared shorter than some of its own enum values; kept as declared.
SERVICES = T.StructType([
    _text("id_pdl", 14, required=True),
    _text("id_service_souscrit", 10, required=True),
    _text("code_prestation", 5, enum=fv.SERVICE_CODES),
    _text("code_flux", 4, enum=fv.FLOW_CODES),
    _text("service_souscrit_type", 8, enum=fv.SERVICE_TYPES),
    _text("mesures_type_code", 3, enum=fv.MEASURE_TYPES),
    _text("mesures_pas", 5),
    _flag("mesures_corrigees"),
    _text("periodicite_transmission", 3),
    _text("etat_activation", 7, enum=fv.ACTIVATION_STATES),
    _day("date_debut"),
    _day("date_fin"),
    _flag("soutirage"),
    _flag("injection"),
])

HISTORY_REQUESTS = T.StructType([
    _text("id_affaire", 50, required=True),
    _text("id_pdl", 14, required=True),
    _text("code_prestation", 50, enum=fv.REQUEST_CODES),
    _flag("mesures_corrigees"),
    _text("mesures_type_code", 50, enum=fv.MEASURE_TYPES),
    _text("mesures_pas", 10),
    _day("date_debut_demandee"),
    _day("date_fin_demandee"),
    _moment("datetime_requete", "CURRENT_TIMESTAMP"),
    _moment("date_premiere_valeur"),
    _flag("fichier_traite", default="false"),
])

ERROR_LOG = T.StructType([
    _text("id_pdl", 14, required=True),
    _text("code_erreur", native="varchar"),
    _text("message_erreur", native="text"),
    _moment("timestamp"),
    _text("service_appele", native="varchar"),
])

MEASURES = T.StructType([
    _text("id_pdl", 14, required=True),
    _text("label", 100),
    _field("val", T.DoubleType(), "double"),
    _moment("ts"),
    _day("date_debut"),
    _day("date_fin"),
    _field("fmt", T.IntegerType(), "int"),
    _text("uuid", 50),
    _text("misc", 20),
    _moment("ingestion_ts"),
])

# Electricity tables, addressed by name.
TABLES: dict[str, T.StructType] = {
    "pdl": PDL,
    "dtc": DTC,
    "services_souscrits": SERVICES,
    "demandes_historique": HISTORY_REQUESTS,
    "log_erreur": ERROR_LOG,
    "donnees_mesures": MEASURES,
}
KEYS = {
    "pdl": ["id_pdl"],
    "dtc": ["id_pdl"],
    "services_souscrits": ["id_pdl", "id_service_souscrit"],
    "demandes_historique": ["id_affaire"],
    "donnees_mesures": ["id_pdl", "label", "ts"],
}


def _plain(kind, *names):
    return [T.StructField(name, kind) for name in names]


# Gas registry: dates and timestamps are stored as text, more columns may appear.
GAS_REGISTRY = T.StructType([
    *_plain(T.StringType(), "id_pce", "partner", "platform_code", "courriel_titulaire",
            "code_postal", "date_debut_droit_acces", "date_fin_droit_acces",
            "perim_donnees_conso_debut", "perim_donnees_conso_fin",
            "raison_sociale_du_titulaire", "nom_titulaire"),
    *_plain(T.BooleanType(), *fv.GAS_PERIMETERS),
    *_plain(T.StringType(), "role_tiers", "etat_droit_acces", "date_creation", "derniere_maj"),
    *_plain(T.IntegerType(), "nb_tentatives_declare"),
    *_plain(T.StringType(), "message_erreur_declare", *fv.COLLECTION_STAMPS.values()),
    *_plain(T.IntegerType(), "api_response_code"),
    *_plain(T.StringType(), "date_onboard_history"),
    *_plain(T.IntegerType(), "api_response_onboard_history"),
])

GAS_PERIODS = T.StructType([
    *_plain(T.StringType(), "id_pce", "date_debut", "date_fin", "frequence"),
    *_plain(T.DoubleType(), "consommation"),
    *_plain(T.StringType(), "unite"),
])

COMMANDS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("id", T.StringType()),
    T.StructField("op", T.StringType()),
    T.StructField("body", T.MapType(T.StringType(), T.StringType())),
])


def schema_of(table: str) -> T.StructType:
    if table not in TABLES:
        raise ValueError(f"Table inconnue : '{table}'. Tables disponibles : {list(TABLES)}")
    return TABLES[table]


def list_columns(table: str) -> list[str]:
    return schema_of(table).fieldNames()


def describe_schema(spark: SparkSession, *tables: str) -> DataFrame:
    """One row per declared column: type, nullability, native type, enum, default."""
    rows = [
        (table, position, f.name, f.dataType.simpleString(), f.nullable,
         f.metadata.get("native_type"), f.metadata.get("max_length"),
         ",".join(f.metadata["enum_values"]) if "enum_values" in f.metadata else None,
         f.metadata.get("default"))
        for table in (tables or TABLES)
        for position, f in enumerate(schema_of(table), start=1)
    ]
    return spark.createDataFrame(
        rows,
        "table_name string, position int, column_name string, type string, nullable boolean, "
        "native_type string, max_length int, enum_values string, default_value string",
    )
