"""Vocabularies, limits, patterns, codes and texts the results must carry verbatim.

Everything here is data. The rules that use it live in ``functions`` and ``operators``.
"""

# --- providers of the common consumption shape ---------------------------------------------
GAS = "grdf"
ELECTRICITY = "enedis"
PROVIDERS = (GAS, ELECTRICITY)
DEFAULT_UNIT = "kWh"
TOTAL_LABEL = "TOTAL"
MEASURE_UUID_PREFIX = "enedis_CM_"
MEASURE_FORMAT = 1

# --- states --------------------------------------------------------------------------------
GAS_STATES = (
    "nouveau", "A valider", "A revérifier", "Active",
    "Refusée", "Révoquée", "Obsolète", "résilié",
)
GAS_RETRYABLE = ("A revérifier", "Refusée")
GAS_REVOCABLE = ("Active", "nouveau", "A valider")
GAS_ALREADY_REVOKED = ("Révoquée", "résilié")

ELEC_STATES = ("nouveau", "processing", "traite", "erreur", "partiel", "revoque", "résilié")
ELEC_RETRYABLE = ("erreur",)
ELEC_REVOCABLE = ("traite",)
ELEC_ALREADY_REVOKED = ("revoque", "résilié")
ELEC_NOT_COLLECTED = ("nouveau", "résilié")

NEW_STATE = "nouveau"
GAS_ACTIVE = "Active"
GAS_REVOKED = "Révoquée"
ELEC_REVOKED = "revoque"
GAS_ROLE = "AUTORISE_CONTRAT_FOURNITURE"

# --- other closed vocabularies -------------------------------------------------------------
PARTNERS = ("ifpeb",)
CIVILITIES = ("M", "MME")
TRUE_FALSE = ("true", "false")
SEGMENTS = ("C1", "C2", "C3", "C4", "C5", "P1", "P2", "P3", "P4")
MEASURE_TYPES = ("CDC", "IDX", "PMAX", "COURBES", "INDEX")
SERVICE_CODES = ("F300B", "F300C", "F305", "F305A", "P300B", "P305A")
FLOW_CODES = ("R50", "R151", "R4Q", "R4H", "R171")
REQUEST_CODES = (
    "R63_BRUTE_SOUTIRAGE", "R63_BRUTE_INJECTION",
    "R63_CORRIGEE_SOUTIRAGE", "R63_CORRIGEE_INJECTION",
    "R64_BRUTE_SOUTIRAGE", "R64_BRUTE_INJECTION", "R66_PMAX_SOUTIRAGE",
)
SERVICE_TYPES = ("TRANSREC",)
ACTIVATION_STATES = ("ACTIF", "DEMANDE", "ANNULE", "RESILIE")

# --- boolean spellings (dialect -> true words, false words) --------------------------------
BOOLEAN_DIALECTS = {
    "feed": (("vrai",), ("faux",)),
    "input": (("true", "vrai", "1", "yes"), ("false", "faux", "0", "no")),
    "view": (("true", "vrai", "1"), ("false", "faux", "0")),
    "existing": (("true", "vrai", "1"), ()),
    "existing_text": (("true",), ("false",)),
}

# --- fields --------------------------------------------------------------------------------
GAS_PERIMETERS = (
    "perim_donnees_contractuelles", "perim_donnees_techniques",
    "perim_donnees_informatives", "perim_donnees_publiees",
)
GAS_PERIMETER_DEFAULTS = (True, True, False, True)
GAS_PATCH_FIELDS = (
    "courriel_titulaire", "code_postal",
    "date_debut_droit_acces", "date_fin_droit_acces",
    "perim_donnees_conso_debut", "perim_donnees_conso_fin",
    "raison_sociale_du_titulaire", "nom_titulaire",
    *GAS_PERIMETERS,
)
GAS_CREATE_FIELDS = ("id_pce", "partner", "platform_code", *GAS_PATCH_FIELDS)

ELEC_FLAGS = ("injection", "soutirage", "get_cdc", "get_dm")
ELEC_DATES = ("date_signature_mandat", "date_debut_autorisation", "date_fin_autorisation")
ELEC_PATCH_FIELDS = (*ELEC_DATES, "raison_sociale", "civilite", "nom", "prenom", *ELEC_FLAGS)
ELEC_CREATE_FIELDS = ("id_pdl", "partner", "platform_code", *ELEC_PATCH_FIELDS)

COLLECTION_STAMPS = {
    "publiee": "derniere_collecte_publiee",
    "informative": "derniere_collecte_informative",
    "techniques": "dernier_appel_techniques",
    "contractuelles": "dernier_appel_contractuelles",
    "replay": "derniere_replay_trimestrielle",
}

# --- limits and patterns -------------------------------------------------------------------
MAX_LENGTH = {
    "id_pce": 20, "id_pdl": 14, "platform_code": 10, "courriel_titulaire": 100,
    "raison_sociale_du_titulaire": 200, "nom_titulaire": 40,
    "raison_sociale": 100, "nom": 50, "prenom": 50, "commentaire": 50,
}
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
POSTAL_CODE_PATTERN = r"^[0-9]{5}$"
PAGE_LIMIT_DEFAULT, PAGE_LIMIT_MAX = 50, 100
RECENT_DAYS = 30
BACKFILL_PLATFORM_CODE = "LEGACY"
# The characters a text strip removes at both ends.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- outcome codes -------------------------------------------------------------------------
INVALID_FIELD = "CHAMP_INVALIDE"
UNKNOWN_FIELD = "CHAMP_INCONNU"
READ_ONLY_FIELD = "CHAMP_NON_MODIFIABLE"
WRONG_STATE = "STATUT_INCOMPATIBLE"
SENSOR_NOT_FOUND = "SENSOR_INTROUVABLE"
IP_REFUSED = "IP_NON_AUTORISEE"
GAS_CODES = {"exists": "PCE_EXISTANT", "missing": "PCE_INTROUVABLE", "revoked": "PCE_DEJA_REVOQUE"}
ELEC_CODES = {"exists": "PDL_EXISTANT", "missing": "PDL_INTROUVABLE", "revoked": "PDL_DEJA_REVOQUE"}

# --- texts ---------------------------------------------------------------------------------
# Comparison operators of a filter, as its error text lists them.
OPERATORS = ["=", "!=", "<", ">", "<=", ">="]
TEXT = {
    "operator_choice": "Opérateur '{operator}' non supporté. Choix : {choices}",
    "required": "Le champ {champ} est obligatoire.",
    "too_long": "Le champ {champ} ne doit pas dépasser {n} caractères.",
    "one_of": "Le champ {champ} doit être l'un de : {choices}.",
    "email": "Le champ {champ} doit être un email valide (max {n} caractères).",
    "postal": "Le code postal doit contenir exactement 5 chiffres.",
    "date": "Le champ {champ} doit être une date au format YYYY-MM-DD.",
    "boolean": "Le champ {champ} doit être un booléen (true/false).",
    "order": "La {end} doit être strictement postérieure à {start}.",
    "holder": "Au moins un des champs {a} ou {b} doit être renseigné.",
    "civility": "Le champ civilite doit être 'M' ou 'MME'.",
    "perimeter": "Au moins un périmètre (contractuelles, techniques, informatives, publiees) doit être à true.",
    "pair": "Au moins un des champs {a} / {b} doit être à true.",
    "unknown": "Le champ {champ} n'est pas reconnu (hors schéma de création).",
    "read_only": "Le champ {champ} ne peut pas être modifié.",
    "empty_patch": "Aucun champ modifiable fourni.",
    "provider_choice": "Le champ provider doit être 'grdf' ou 'enedis'.",
    "window": "La date to doit être strictement supérieure à from.",
    "sensor_missing": "Aucune donnée trouvée pour ce sensor_id.",
    "ip_refused": "Votre adresse IP n'est pas autorisée à accéder à cette API.",
    "int_between": "{champ} doit être un entier {bound}.",
    "int_bound": "{champ} doit être {bound}.",
    "status_choice": "statut doit être l'un de : {choices}.",
}
QUALITY_TEXT = {
    "missing": "Colonnes manquantes : {names}",
    "extra": "Colonnes inattendues : {names}",
    "not_null": "Colonne '{column}' : {n} valeur(s) NULL interdite(s) (NOT NULL).",
    "max_length": "Colonne '{column}' : {n} valeur(s) dépassent max_length={limit}. "
                  "Ex : '{example}' (len={length}).",
    "enum": "Colonne '{column}' : {n} valeur(s) hors enum {choices}. Ex : '{example}'.",
    "failed": "❌ Validation échouée pour la table '{table}' :\n  - {errors}",
}
GAS_TEXT = {
    "created": "Droit d'accès enregistré. Traitement prévu lors du prochain batch de nuit.",
    "exists": "Un droit d'accès existe déjà pour ce PCE.",
    "missing": "Aucun droit d'accès trouvé pour ce PCE.",
    "already_revoked": "Ce PCE a déjà été révoqué, il n'est plus révocable.",
    "not_revocable": "Seul un droit d'accès Active, nouveau ou A valider peut être révoqué.",
    "revoked": "Révocation enregistrée. La résiliation auprès de GRDF sera traitée par un batch ultérieur.",
    "not_retryable": "Seul un droit d'accès en erreur (A revérifier) ou Refusée peut être relancé.",
    "retried": "Relance enregistrée. Re-traitement prévu lors du prochain batch de nuit.",
}
ELEC_TEXT = {
    "created": "Consentement enregistré. Traitement au prochain cycle SGE.",
    "exists": "Un consentement existe déjà pour ce PDL.",
    "missing": "Aucun consentement trouvé pour ce PDL.",
    "already_revoked": "Ce PDL a déjà été révoqué, il n'est plus révocable.",
    "not_revocable": "Seul un consentement avec statut traite peut être révoqué.",
    "revoked": "Révocation enregistrée. La résiliation auprès de SGE sera traitée par un batch ultérieur.",
    "not_retryable": "Seul un consentement en statut erreur peut être relancé.",
    "retried": "Relance enregistrée. Re-traitement au prochain cycle SGE.",
}
