"""Values that results carry: the SQL counterparts read the same module, so a slip there shows only here."""

import pytest

from meterfold import fixed_values as fv


def test_states_and_what_they_allow():
    assert set(fv.GAS_STATES) == {
        "nouveau", "A valider", "A revérifier", "Active", "Refusée", "Révoquée", "Obsolète", "résilié"}
    assert set(fv.ELEC_STATES) == {"nouveau", "processing", "traite", "erreur", "partiel", "revoque", "résilié"}
    assert set(fv.GAS_REVOCABLE) == {"Active", "nouveau", "A valider"}
    assert set(fv.GAS_RETRYABLE) == {"A revérifier", "Refusée"}
    assert set(fv.GAS_ALREADY_REVOKED) == {"Révoquée", "résilié"}
    assert (set(fv.ELEC_REVOCABLE), set(fv.ELEC_RETRYABLE)) == ({"traite"}, {"erreur"})
    assert set(fv.ELEC_ALREADY_REVOKED) == {"revoque", "résilié"}
    assert set(fv.ELEC_NOT_COLLECTED) == {"nouveau", "résilié"}


def test_codes_limits_and_defaults():
    assert (fv.INVALID_FIELD, fv.WRONG_STATE) == ("CHAMP_INVALIDE", "STATUT_INCOMPATIBLE")
    assert fv.SENSOR_NOT_FOUND == "SENSOR_INTROUVABLE"
    assert fv.GAS_CODES == {"exists": "PCE_EXISTANT", "missing": "PCE_INTROUVABLE", "revoked": "PCE_DEJA_REVOQUE"}
    assert fv.ELEC_CODES == {"exists": "PDL_EXISTANT", "missing": "PDL_INTROUVABLE", "revoked": "PDL_DEJA_REVOQUE"}
    assert (fv.PAGE_LIMIT_DEFAULT, fv.PAGE_LIMIT_MAX) == (50, 100)
    assert dict(zip(fv.GAS_PERIMETERS, fv.GAS_PERIMETER_DEFAULTS)) == {
        "perim_donnees_contractuelles": True, "perim_donnees_techniques": True,
        "perim_donnees_informatives": False, "perim_donnees_publiees": True}
    assert (fv.MAX_LENGTH["id_pce"], fv.MAX_LENGTH["id_pdl"], fv.MAX_LENGTH["courriel_titulaire"]) == (20, 14, 100)
    assert fv.TOTAL_LABEL == "TOTAL" and fv.DEFAULT_UNIT == "kWh"


@pytest.mark.parametrize("texts,name,text", [
    (fv.GAS_TEXT, "created", "Droit d'accès enregistré. Traitement prévu lors du prochain batch de nuit."),
    (fv.GAS_TEXT, "exists", "Un droit d'accès existe déjà pour ce PCE."),
    (fv.GAS_TEXT, "missing", "Aucun droit d'accès trouvé pour ce PCE."),
    (fv.GAS_TEXT, "not_revocable", "Seul un droit d'accès Active, nouveau ou A valider peut être révoqué."),
    (fv.ELEC_TEXT, "created", "Consentement enregistré. Traitement au prochain cycle SGE."),
    (fv.ELEC_TEXT, "already_revoked", "Ce PDL a déjà été révoqué, il n'est plus révocable."),
    (fv.ELEC_TEXT, "retried", "Relance enregistrée. Re-traitement au prochain cycle SGE."),
    (fv.TEXT, "read_only", "Le champ {champ} ne peut pas être modifié."),
    (fv.TEXT, "sensor_missing", "Aucune donnée trouvée pour ce sensor_id."),
    (fv.TEXT, "ip_refused", "Votre adresse IP n'est pas autorisée à accéder à cette API."),
])
def test_texts(texts, name, text):
    assert texts[name] == text
