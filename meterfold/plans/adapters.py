"""Benchmark tables as domain tables.

Each domain table is a mapping column -> SQL expression over one benchmark table. The expressions
are plain SQL that Spark and the checking engine read alike, so both sides start from equal rows.
Bodies map field -> (SQL condition "the field is present", SQL value).
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

NOW = "2026-05-12 10:41:07.203118"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spark_sql(text: str) -> str:
    return re.sub(r"\{struct: ([^}]*)\}", r"struct(\1)", text).replace("{ntz}", "TIMESTAMP_NTZ")


def build(spark: SparkSession, sf_dir: str, spec: tuple[str, dict]) -> DataFrame:
    table, columns = spec
    return read(spark, sf_dir, table).selectExpr(
        *[f"{spark_sql(sql)} AS `{name}`" for name, sql in columns.items()]
    )


def body_map(body: dict) -> Column:
    """Body fields as a map that holds only the present ones."""
    entries = F.array(*[
        F.when(F.expr(present), F.struct(F.lit(name).alias("key"),
                                         F.expr(f"CAST({value} AS STRING)").alias("value")))
        for name, (present, value) in body.items()
    ])
    return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))


def commands(spark: SparkSession, sf_dir: str, spec: tuple, body: dict, op: str) -> DataFrame:
    table, seq, target = spec
    return read(spark, sf_dir, table).select(
        F.expr(spark_sql(seq)).alias("seq"), F.expr(target).alias("id"), F.expr(op).alias("op"),
        body_map(body).alias("body"),
    )


def _pad(value: str, width: int) -> str:
    return f"lpad(CAST({value} AS STRING), {width}, '0')"


def _iso(day: str) -> str:
    return f"CAST({day} AS STRING)"


_EVENT_DAY = "CAST(ts AS DATE)"
_EVENT_END = f"({_EVENT_DAY} + CAST(event_id % 40 AS INT))"
MEASURES = ("events", {
    "id_pdl": _pad("user_id", 14),
    "label": "CASE event_type WHEN 'purchase' THEN 'TOTAL' WHEN 'click' THEN 'TURPE_HCB' "
             "ELSE upper(event_type) END",
    "val": "value",
    # {ntz}: the zone-less timestamp type, spelled differently by the two engines.
    "ts": f"CAST({_EVENT_END} - 1 AS {{ntz}})",
    "date_debut": _EVENT_DAY,
    "date_fin": _EVENT_END,
    "fmt": "1",
    "uuid": f"'enedis_CM_' || {_pad('user_id', 14)}",
    "misc": "CASE WHEN event_id % 3 = 0 THEN 'RECTIFIEE' ELSE 'INITIALE' END",
    "arrival": "event_id",
})

_SHIP = "CAST(l_shipdate AS DATE)"
GAS_PERIODS = ("lineitem", {
    "id_pce": f"'PCE' || {_pad('l_partkey', 11)}",
    "date_debut": f"CASE WHEN l_partkey % 11 = 0 THEN CAST(year({_SHIP}) AS STRING) || '-' || "
                  f"CAST(month({_SHIP}) AS STRING) || '-' || CAST(day({_SHIP}) AS STRING) "
                  f"WHEN l_suppkey % 13 = 0 THEN 'bientôt' ELSE {_iso(_SHIP)} END",
    "date_fin": f"CASE WHEN l_suppkey % 17 = 0 THEN NULL ELSE "
                f"{_iso(f'({_SHIP} + CAST(l_quantity AS INT))')} END",
    "frequence": "'1M'",
    "consommation": "l_extendedprice",
    "unite": "CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN 'kWh' ELSE ' m3 ' END",
})

_ELEC_REQ = "c_custkey % 8 < 3"
REQUESTS = ("customer", {
    "req_id": "c_custkey",
    "provider": "CASE c_custkey % 8 WHEN 0 THEN '  ENEDIS ' WHEN 1 THEN 'enedis' WHEN 2 THEN 'Enedis' "
                "WHEN 3 THEN NULL WHEN 4 THEN 'grdf' WHEN 5 THEN ' GRDF' WHEN 6 THEN 'grdf' "
                "ELSE 'edf' END",
    "sensor_id": f"CASE WHEN c_custkey % 17 = 0 THEN '  ' WHEN {_ELEC_REQ} "
                 f"THEN {_pad('c_custkey % 200', 14)} ELSE 'PCE' || {_pad('c_custkey', 11)} END",
    "from": f"CASE WHEN c_custkey % 13 = 0 THEN '01/01/2024' WHEN {_ELEC_REQ} "
            f"THEN '2024-01-' || {_pad('1 + c_custkey % 20', 2)} "
            "ELSE CAST(1995 + c_custkey % 5 AS STRING) || '-1-1' END",
    "to": f"CASE WHEN c_custkey % 23 = 0 THEN '1990-01-01' WHEN c_custkey % 29 = 0 THEN NULL "
          f"WHEN {_ELEC_REQ} THEN ' 2024-02-' || {_pad('1 + c_custkey % 28', 2)} "
          "ELSE CAST(1996 + c_custkey % 6 AS STRING) || '-12-31' END",
})

_ORDERED = "CAST(o_orderdate AS DATE)"
RIGHTS_FEED = ("orders", {
    "id_pce": f"CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN '' "
              f"ELSE 'PCE' || {_pad('o_custkey', 11)} END",
    "date_debut_droit_acces": f"CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE {_iso(_ORDERED)} END",
    "date_creation": "CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE o_orderpriority END",
    "etat_droit_acces": "o_orderstatus",
    "input_ord": "o_orderkey",
})

_STATE_GAS = (
    "CASE WHEN o_orderkey % 29 = 0 THEN 'Révoquée' WHEN o_orderkey % 31 = 0 THEN 'résilié' "
    "WHEN o_orderkey % 37 = 0 THEN 'Refusée' WHEN o_orderkey % 41 = 0 THEN NULL "
    "WHEN o_orderkey % 43 = 0 THEN ' Active ' WHEN o_orderstatus = 'F' THEN 'Active' "
    "WHEN o_orderstatus = 'O' THEN 'nouveau' ELSE 'A revérifier' END"
)
_ERROR_JSON = (
    "'{\"code_statut_traitement\":\"C' || CAST(o_orderkey % 7 AS STRING) || "
    "'\",\"message_retour_traitement\":\"Une erreur\"}'"
)
GAS_REGISTRY = ("orders", {
    "id_pce": f"'PCE' || {_pad('o_orderkey', 11)}",
    "partner": "'ifpeb'",
    "platform_code": f"'PF' || {_pad('o_custkey % 100', 2)}",
    "courriel_titulaire": "'u' || CAST(o_custkey AS STRING) || '@exemple.fr'",
    "code_postal": _pad("o_custkey % 100000", 5),
    "date_debut_droit_acces": _iso(_ORDERED),
    "date_fin_droit_acces":
        "CASE WHEN o_orderkey % 53 = 0 THEN NULL WHEN o_orderkey % 59 = 0 THEN 'n/a' ELSE "
        + _iso(f"({_ORDERED} + CAST(o_orderkey % 500 - 50 AS INT))") + " END",
    "perim_donnees_conso_debut": "'2023-01-01'",
    "perim_donnees_conso_fin": "'2029-05-01'",
    "raison_sociale_du_titulaire":
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '  ' "
        "ELSE 'Client ' || CAST(o_custkey AS STRING) END",
    "nom_titulaire": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Nom ' || CAST(o_custkey AS STRING) END",
    "perim_donnees_contractuelles": "o_orderkey % 2 = 0",
    "perim_donnees_techniques": "o_orderkey % 3 = 0",
    "perim_donnees_informatives": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE FALSE END",
    "perim_donnees_publiees": "o_orderkey % 13 = 0",
    "role_tiers": "'AUTORISE_CONTRAT_FOURNITURE'",
    "etat_droit_acces": _STATE_GAS,
    "date_creation": _iso(_ORDERED) + " || 'T09:03:16.415174+00:00'",
    "derniere_maj": "CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 17 = 0 THEN 'hier' ELSE "
                    + _iso(_ORDERED) + " || ' 10:00:59Z' END",
    "nb_tentatives_declare": "CAST(o_orderkey % 4 AS INT)",
    "message_erreur_declare":
        f"CASE o_orderkey % 5 WHEN 0 THEN {_ERROR_JSON} WHEN 1 THEN ' Champ manquant : nom ' "
        "WHEN 2 THEN 'null' WHEN 3 THEN '  ' ELSE NULL END",
    "dernier_appel_techniques":
        "CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE "
        + _iso(_ORDERED) + " || 'T08:00:00+00:00' END",
})

_STATE_ELEC = (
    "CASE WHEN o_orderkey % 29 = 0 THEN 'revoque' WHEN o_orderkey % 31 = 0 THEN 'résilié' "
    "WHEN o_orderkey % 37 = 0 THEN 'processing' WHEN o_orderkey % 41 = 0 THEN 'partiel' "
    "WHEN o_orderstatus = 'F' THEN 'traite' WHEN o_orderstatus = 'O' THEN 'nouveau' ELSE 'erreur' END"
)
_FLAG = "CASE WHEN o_orderkey % {n} = 0 THEN 'true' WHEN o_orderkey % {m} = 0 THEN NULL ELSE 'false' END"
PDL = ("orders", {
    "id_pdl": _pad("o_orderkey", 14),
    "partner": "'ifpeb'",
    "platform_code": f"'PF' || {_pad('o_custkey % 100', 2)}",
    "date_signature_mandat": _ORDERED,
    "date_debut_autorisation": _ORDERED,
    "date_fin_autorisation": f"CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE "
                             f"{_ORDERED} + CAST(o_orderkey % 500 - 50 AS INT) END",
    "raison_sociale": "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN '  ' "
                      "ELSE 'Client ' || CAST(o_custkey AS STRING) END",
    "civilite": "CASE WHEN o_orderkey % 2 = 0 THEN 'M' ELSE 'MME' END",
    "nom": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'Nom ' || CAST(o_custkey AS STRING) END",
    "prenom": "CAST(NULL AS STRING)",
    "date_creation": "CAST(o_orderdate AS {ntz})",
    "date_modification": "CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS {ntz}) END",
    "injection": _FLAG.format(n=2, m=7),
    "soutirage": _FLAG.format(n=3, m=11),
    "get_cdc": _FLAG.format(n=5, m=1000003),
    "get_dm": _FLAG.format(n=4, m=1000003),
    "statut_cdc": _FLAG.format(n=6, m=4),
    "statut_dm": _FLAG.format(n=9, m=5),
    "date_premiere_valeur_dm": "CAST(NULL AS DATE)",
    "statut": _STATE_ELEC,
    "commentaire": "CAST(NULL AS STRING)",
    "erreur": f"CASE o_orderkey % 5 WHEN 0 THEN {_ERROR_JSON} WHEN 1 THEN 'texte libre' ELSE NULL END",
})

# --- commands ------------------------------------------------------------------------------

# {struct: a, b}: a struct of those columns; an order number may be of any orderable type.
_LINE = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate"
_LINE_SEQ, _ORDER_LINE_SEQ = f"{{struct: {_LINE}}}", f"{{struct: l_orderkey, {_LINE}}}"
LINE_OP = "CASE l_returnflag WHEN 'A' THEN 'revoke' WHEN 'R' THEN 'retry' ELSE 'patch' END"
GAS_LINES = ("lineitem", _LINE_SEQ, f"'PCE' || {_pad('l_orderkey', 11)}")
ELEC_LINES = ("lineitem", _LINE_SEQ, _pad("l_orderkey", 14))
# One meter gets a hundredth of all commands.
GAS_HOT = ("lineitem", _ORDER_LINE_SEQ,
           f"CASE WHEN l_partkey % 100 = 0 THEN 'PCE00000000007' ELSE 'PCE' || {_pad('l_orderkey', 11)} END")
# Every third line addresses a meter that is not registered.
GAS_STRAYS = ("lineitem", _ORDER_LINE_SEQ,
              f"CASE WHEN l_partkey % 3 = 0 THEN 'XX' || {_pad('l_orderkey', 11)} "
              f"ELSE 'PCE' || {_pad('l_orderkey', 11)} END")
ELEC_STRAYS = ("lineitem", _ORDER_LINE_SEQ,
               f"CASE WHEN l_partkey % 3 = 0 THEN 'X' || {_pad('l_orderkey', 13)} "
               f"ELSE {_pad('l_orderkey', 14)} END")

_Q = "CAST(l_quantity AS INT)"
_UNPADDED = (f"CAST(year({_SHIP}) AS STRING) || '-' || CAST(month({_SHIP}) AS STRING) || '-' || "
             f"CAST(day({_SHIP}) AS STRING)")
GAS_PATCH = {
    "courriel_titulaire": (
        "l_partkey % 3 = 0",
        "CASE WHEN l_partkey % 33 = 0 THEN 'pas-un-email' ELSE ' u' || CAST(l_partkey AS STRING) || '@mail.fr' END"),
    "code_postal": ("l_partkey % 5 = 0",
                    f"CASE WHEN l_partkey % 35 = 0 THEN '7500' ELSE {_pad('l_partkey % 100000', 5)} END"),
    "date_debut_droit_acces": (
        "l_suppkey % 4 = 0",
        f"CASE WHEN l_suppkey % 28 = 0 THEN '2024-02-30' WHEN l_suppkey % 8 = 0 THEN {_UNPADDED} "
        f"ELSE {_iso(_SHIP)} END"),
    "date_fin_droit_acces": ("l_suppkey % 3 = 0", _iso(f"({_SHIP} + {_Q} * 20 - 100)")),
    "perim_donnees_conso_debut": (
        "l_partkey % 7 = 0",
        "CASE WHEN l_partkey % 49 = 0 THEN '01/02/2023' ELSE '  2023-01-01 ' END"),
    "raison_sociale_du_titulaire": (
        f"{_Q} % 4 = 0",
        f"CASE WHEN {_Q} % 20 = 0 THEN repeat('x', 201) WHEN {_Q} % 8 = 0 THEN '  ' "
        "ELSE 'Société ' || CAST(l_partkey AS STRING) END"),
    "nom_titulaire": (f"{_Q} % 5 = 0",
                      f"CASE WHEN {_Q} % 10 = 0 THEN NULL ELSE 'Nom ' || CAST(l_suppkey AS STRING) END"),
    "perim_donnees_contractuelles": (f"{_Q} % 6 = 0", "CASE WHEN l_partkey % 2 = 0 THEN 'Faux' ELSE '0' END"),
    "perim_donnees_techniques": (f"{_Q} % 7 = 0", "CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE ' false' END"),
    "perim_donnees_informatives": (f"{_Q} % 9 = 0", f"CASE WHEN {_Q} % 27 = 0 THEN 'peut-être' ELSE 'Yes' END"),
    "perim_donnees_publiees": (f"{_Q} % 6 = 0", "'no'"),
    "partner": ("l_partkey % 41 = 0", "'ifpeb'"),
}
ELEC_PATCH = {
    "date_signature_mandat": ("l_partkey % 5 = 0",
                              "CASE WHEN l_partkey % 25 = 0 THEN 'hier' ELSE '2025-6-5' END"),
    "date_debut_autorisation": ("l_suppkey % 4 = 0",
                                f"CASE WHEN l_suppkey % 8 = 0 THEN {_UNPADDED} ELSE {_iso(_SHIP)} END"),
    "date_fin_autorisation": ("l_suppkey % 3 = 0", _iso(f"({_SHIP} + {_Q} * 20 - 100)")),
    "raison_sociale": (f"{_Q} % 4 = 0",
                       f"CASE WHEN {_Q} % 20 = 0 THEN repeat('é', 101) WHEN {_Q} % 8 = 0 THEN NULL "
                       "ELSE 'Société ' || CAST(l_partkey AS STRING) END"),
    "civilite": ("l_partkey % 7 = 0",
                 "CASE l_partkey % 4 WHEN 0 THEN 'mme ' WHEN 1 THEN 'X' WHEN 2 THEN ' ' ELSE 'M' END"),
    "nom": (f"{_Q} % 5 = 0", f"CASE WHEN {_Q} % 10 = 0 THEN ' ' ELSE 'Nom ' || CAST(l_suppkey AS STRING) END"),
    "prenom": ("l_partkey % 11 = 0", "CASE WHEN l_partkey % 33 = 0 THEN repeat('p', 51) ELSE 'Ana' END"),
    "injection": (f"{_Q} % 6 = 0", f"CASE WHEN {_Q} % 24 = 0 THEN 'oui' ELSE 'false' END"),
    "soutirage": (f"{_Q} % 9 = 0", "CASE WHEN l_partkey % 2 = 0 THEN 'VRAI' ELSE 'faux' END"),
    "get_cdc": (f"{_Q} % 7 = 0", "'0'"),
    "get_dm": (f"{_Q} % 14 = 0", "'No'"),
    "id_pdl": ("l_partkey % 43 = 0", "'1'"),
}

_BODY_START = f"({_ORDERED} + 9000)"
CREATES = ("orders", "o_orderkey", "CAST(NULL AS STRING)")
# Several creations address the same meter, most of them already registered.
_NEW_ID = "o_custkey * 12"
GAS_CREATE = {
    "id_pce": ("o_orderkey % 83 <> 0",
               f"CASE WHEN o_orderkey % 79 = 0 THEN repeat('9', 21) ELSE ' PCE' || {_pad(_NEW_ID, 11)} END"),
    "partner": ("o_orderkey % 73 <> 0", "CASE WHEN o_orderkey % 71 = 0 THEN 'autre' ELSE 'IFPEB' END"),
    "platform_code": ("TRUE", "CASE WHEN o_orderkey % 67 = 0 THEN 'PLATEFORME1' "
                              "WHEN o_orderkey % 61 = 0 THEN ' ' ELSE 'PF01' END"),
    "courriel_titulaire": ("o_orderkey % 59 <> 0",
                           "CASE WHEN o_orderkey % 53 = 0 THEN 'a b@c.fr' WHEN o_orderkey % 47 = 0 "
                           "THEN repeat('a', 95) || '@mail.fr' ELSE 'accueil@mairie.example' END"),
    "code_postal": ("TRUE", "CASE WHEN o_orderkey % 43 = 0 THEN '7500A' ELSE '75001 ' END"),
    "date_debut_droit_acces": ("TRUE", f"CASE WHEN o_orderkey % 41 = 0 THEN '2026/05/01' "
                                       f"ELSE {_iso(_BODY_START)} END"),
    "date_fin_droit_acces": ("o_orderkey % 37 <> 0", _iso(f"({_BODY_START} + CAST(o_orderkey % 900 - 30 AS INT))")),
    "perim_donnees_conso_debut": ("TRUE", "CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE '2023-1-1' END"),
    "perim_donnees_conso_fin": ("TRUE", "CASE WHEN o_orderkey % 29 = 0 THEN '2029-02-29' ELSE '2029-05-01' END"),
    "raison_sociale_du_titulaire": ("o_orderkey % 3 = 0",
                                    "CASE WHEN o_orderkey % 57 = 0 THEN repeat('s', 201) "
                                    "WHEN o_orderkey % 9 = 0 THEN ' ' ELSE 'Ville' END"),
    "nom_titulaire": ("o_orderkey % 4 <> 0",
                      "CASE WHEN o_orderkey % 23 = 0 THEN repeat('n', 41) ELSE 'Dupont' END"),
    "perim_donnees_contractuelles": ("o_orderkey % 2 = 0", "CASE WHEN o_orderkey % 38 = 0 THEN 'oui' ELSE 'false' END"),
    "perim_donnees_techniques": ("o_orderkey % 4 = 0", "'0'"),
    "perim_donnees_informatives": ("o_orderkey % 5 = 0", "CASE WHEN o_orderkey % 25 = 0 THEN NULL ELSE 'vrai' END"),
    "perim_donnees_publiees": ("o_orderkey % 4 = 0", "'Faux'"),
    "role_tiers": ("o_orderkey % 89 = 0", "'X'"),
}
ELEC_CREATE = {
    "id_pdl": ("o_orderkey % 83 <> 0",
               f"CASE WHEN o_orderkey % 79 = 0 THEN repeat('9', 15) ELSE {_pad(_NEW_ID, 14)} || ' ' END"),
    "partner": ("o_orderkey % 73 <> 0", "CASE WHEN o_orderkey % 71 = 0 THEN 'autre' ELSE ' ifpeb' END"),
    "platform_code": ("TRUE", "CASE WHEN o_orderkey % 67 = 0 THEN 'PLATEFORME1' ELSE 'PF01' END"),
    "date_signature_mandat": ("o_orderkey % 61 <> 0", "CASE WHEN o_orderkey % 59 = 0 THEN 'x' ELSE '2025-06-05' END"),
    "date_debut_autorisation": ("TRUE", _iso(_BODY_START)),
    "date_fin_autorisation": ("TRUE", _iso(f"({_BODY_START} + CAST(o_orderkey % 900 - 30 AS INT))")),
    "raison_sociale": ("o_orderkey % 3 = 0", "CASE WHEN o_orderkey % 57 = 0 THEN repeat('s', 101) ELSE 'Ville' END"),
    "nom": ("o_orderkey % 4 <> 0", "CASE WHEN o_orderkey % 23 = 0 THEN repeat('n', 51) ELSE 'Dupont' END"),
    "prenom": ("o_orderkey % 6 = 0", "CASE WHEN o_orderkey % 48 = 0 THEN repeat('p', 51) ELSE ' ' END"),
    "civilite": ("o_orderkey % 2 = 0", "CASE WHEN o_orderkey % 34 = 0 THEN 'DR' ELSE 'mme' END"),
    "injection": ("o_orderkey % 53 <> 0", "CASE WHEN o_orderkey % 47 = 0 THEN 'oui' WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'no' END"),
    "soutirage": ("TRUE", "CASE WHEN o_orderkey % 43 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN 'faux' ELSE '1' END"),
    "get_cdc": ("o_orderkey % 3 = 0", "CASE WHEN o_orderkey % 33 = 0 THEN 'maybe' ELSE 'false' END"),
    "get_dm": ("o_orderkey % 7 = 0", "CASE WHEN o_orderkey % 49 = 0 THEN NULL ELSE 'FALSE' END"),
    "statut": ("o_orderkey % 89 = 0", "'traite'"),
}

# Feed of partial records: which fields a record carries depends on the row.
UPSERT_FIELDS = {
    "date_debut_droit_acces": ("TRUE", _iso(_SHIP)),
    "date_creation": ("l_suppkey % 2 = 0", "CASE WHEN l_suppkey % 6 = 0 THEN NULL ELSE CAST(l_linenumber AS STRING) END"),
    "etat_droit_acces": ("l_partkey % 2 = 0", "CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE 'Obsolète' END"),
    "nom_titulaire": ("l_partkey % 3 = 0", "'Feed ' || CAST(l_suppkey AS STRING)"),
    "motif": ("l_partkey % 5 = 0", "'nouveau champ'"),
}
UPSERT_FEED = ("lineitem", {
    "id_pce": f"CASE WHEN l_partkey % 101 = 0 THEN NULL WHEN l_partkey % 103 = 0 THEN '' "
              f"WHEN l_partkey % 10 = 0 THEN 'NEW' || {_pad('l_orderkey', 11)} "
              f"ELSE 'PCE' || {_pad('l_orderkey', 11)} END",
    "input_ord": _ORDER_LINE_SEQ,
})

LISTINGS = ("customer", {
    "req_id": "c_custkey",
    "statut": "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '  ' WHEN 2 THEN ' Active ' WHEN 3 THEN 'nouveau' "
              "WHEN 4 THEN 'Cloturé' ELSE 'Révoquée' END",
    "limit": "CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN ' 20 ' WHEN 2 THEN '-4' WHEN 3 THEN '101' "
             "WHEN 4 THEN 'dix' WHEN 5 THEN '' ELSE CAST(c_custkey % 130 AS STRING) END",
    "offset": "CASE c_custkey % 5 WHEN 0 THEN '-1' WHEN 1 THEN NULL WHEN 2 THEN '1.5' "
              "ELSE CAST(c_custkey AS STRING) END",
})

HISTORY = ("events", {
    "id_affaire": f"'AFF' || {_pad('event_id', 12)}",
    "id_pdl": _pad("user_id", 14),
    "code_prestation": "CASE event_type WHEN 'purchase' THEN 'R63_BRUTE_SOUTIRAGE' WHEN 'click' THEN "
                       "'R63_BRUTE_INJECTION' WHEN 'view' THEN 'R64_BRUTE_SOUTIRAGE' WHEN 'error' THEN "
                       "'R66_PMAX_SOUTIRAGE' ELSE 'R64_BRUTE_INJECTION' END",
    "datetime_requete": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE ts END",
})
ASKED = ("customer", {
    "ask_id": "c_custkey",
    "id_pdl": _pad("c_custkey % 200", 14),
    "code_prestation": "CASE c_nationkey % 4 WHEN 0 THEN 'R63_BRUTE_SOUTIRAGE' WHEN 1 THEN "
                       "'R63_BRUTE_INJECTION' WHEN 2 THEN 'R64_BRUTE_SOUTIRAGE' ELSE 'R66_PMAX_SOUTIRAGE' END",
})
CALLS = ("events", {
    "id_pce": f"'PCE' || {_pad('CAST(floor(event_id / 2) AS BIGINT)', 11)}",
    "collection_type": "CASE event_type WHEN 'purchase' THEN 'publiee' WHEN 'click' THEN 'informative' "
                       "WHEN 'view' THEN 'techniques' WHEN 'error' THEN 'contractuelles' ELSE 'replay' END",
    "status_code": "CAST(200 + (event_id % 5) * 50 AS INT)",
    "call_ord": "event_id",
})
ACCESS_LOG = ("events", {
    "event_id": "event_id",
    "x_forwarded_for":
        "CASE event_id % 8 WHEN 0 THEN NULL WHEN 1 THEN '192.0.2.1, ' "
        "WHEN 2 THEN '192.0.2.7, 198.51.' || CAST(100 + user_id % 4 AS STRING) || '.' || CAST(event_id % 256 AS STRING) || ':49152' "
        "WHEN 3 THEN '203.0.113.' || CAST(event_id % 256 AS STRING) "
        "WHEN 4 THEN '192.0.2.9, 100.64.' || CAST(event_id % 300 AS STRING) || '.8:8080' "
        "WHEN 5 THEN '[2001:db8::' || CAST(event_id % 100 AS STRING) || ']:443' "
        "WHEN 6 THEN '2001:DB8:1:0:0:0:0:' || CAST(event_id % 100 AS STRING) ELSE 'localhost' END",
})
ALLOWED_IPS = "198.51.101.0/24, 203.0.113.0/25,100.64.8.8, 198.51.102.77/32, 2001:db8::/64, pas-une-ip, 300.1.1.1"
MANY_IPS = ",".join([
    *[f"198.51.{100 + i}.{j}" for i in range(4) for j in range(0, 256, 2)],
    *[f"100.64.{k}.0/24" for k in range(0, 256, 3)],
    *[f"172.{i}.{j}.0/24" for i in range(16, 32) for j in range(64)],
])
JSON_BODIES = ("lineitem", {
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "body":
        "'{' || CASE WHEN l_partkey % 5 = 0 THEN '\"code_postal\": \"' || " + _pad("l_partkey % 100000", 5)
        + " || '\", ' ELSE '' END || CASE l_suppkey % 3 WHEN 0 THEN '\"nom_titulaire\": null, ' "
        "WHEN 1 THEN '\"nom_titulaire\": \"Nom ' || CAST(l_suppkey AS STRING) || '\", ' ELSE '' END "
        "|| '\"perim_donnees_publiees\": ' || CASE WHEN l_partkey % 2 = 0 THEN 'true' ELSE '\"non\"' END || '}'",
})
PAYLOADS = ("events", {
    "event_id": "event_id",
    "raw": "CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN ' Champ manquant ' WHEN 2 THEN 'NULL' ELSE '  ' END",
})
STAMPS = ("events", {
    "event_id": "event_id",
    "raw": "CASE event_id % 6 "
           "WHEN 0 THEN '2024-01-' || " + _pad("1 + event_id % 31", 2) + " || 'T09:03:16.415174+02:00' "
           "WHEN 1 THEN ' 2024-02-' || " + _pad("1 + event_id % 31", 2) + " || ' 23:59:59Z' "
           "WHEN 2 THEN CAST(CAST(ts AS DATE) AS STRING) WHEN 3 THEN 'bientôt' WHEN 4 THEN '  ' ELSE NULL END",
})
WORDS = ("labels", {
    "doc_id": "doc_id",
    "word": "CASE doc_id % 10 WHEN 0 THEN 'Vrai' WHEN 1 THEN ' faux ' WHEN 2 THEN '1' WHEN 3 THEN '0' "
            "WHEN 4 THEN 'yes' WHEN 5 THEN 'NO' WHEN 6 THEN 'peut-être' WHEN 7 THEN 'TRUE' "
            "WHEN 8 THEN 'false' ELSE NULL END",
})
STATUS_UPDATES = ("orders", {
    "id_pdl": f"CASE WHEN o_orderkey % 3 = 0 THEN 'X' || {_pad('o_orderkey', 13)} ELSE {_pad('o_orderkey', 14)} END",
    "statut": "CASE WHEN o_orderkey % 2 = 0 THEN 'traite' ELSE 'partiel' END",
    "statut_cdc": "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'true' END",
    "commentaire": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE repeat('à', 40 + CAST(o_orderkey % 20 AS INT)) END",
})
ERRORS = ("orders", {
    "id_pdl": f"CASE WHEN o_orderkey % 3 = 0 THEN 'X' || {_pad('o_orderkey', 13)} ELSE {_pad('o_orderkey', 14)} END",
    "code": "'SGT' || CAST(o_orderkey % 600 AS STRING)",
    "message": "CASE WHEN o_orderkey % 7 = 0 THEN 'Erreur \"inattendue\"' ELSE 'Délai dépassé' END",
})
RESPONSES = ("pages", {
    "endpoint": "CASE page_id % 3 WHEN 0 THEN 'consultation_dtc' WHEN 1 THEN 'recherche_services' "
                "ELSE 'commande_collecte' END",
    "id_pdl": _pad("page_id % 100", 14),
    "suffix": "CASE page_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE 'R' || CAST(50 + page_id % 2 AS STRING) END",
    "xml": "html",
    "arrival": "page_id",
})
# A consent table with faults, and a technical table with faults.
FAULTY_PDL = ("customer", {
    "id_pdl": f"CASE WHEN c_custkey % 50 = 0 THEN NULL WHEN c_custkey % 49 = 0 THEN {_pad('c_custkey', 15)} "
              f"ELSE {_pad('c_custkey', 14)} END",
    "partner": "c_mktsegment",
    "platform_code": "CASE WHEN c_nationkey = 3 THEN c_name ELSE 'PF01' END",
    "injection": "CASE WHEN c_custkey % 40 = 0 THEN 'oui' ELSE 'true' END",
    "get_cdc": "CASE WHEN c_custkey % 60 = 0 THEN NULL ELSE 'false' END",
    "statut": "CASE c_nationkey % 5 WHEN 0 THEN 'nouveau' WHEN 1 THEN 'Actif' ELSE 'traite' END",
    "commentaire": "repeat('é', 45 + CAST(c_custkey % 10 AS INT))",
    "extra_col": "c_acctbal",
})
FAULTY_DTC = ("part", {
    "id_pdl": _pad("p_partkey", 14),
    "segment": "p_brand",
    "etat_contractuel": "p_type",
    "matricule": "p_name",
    "niveau_ouverture_services": "CAST(p_size AS BIGINT)",
})
