"""Request rules case by case, and the ordered fold against a sequential model."""

import random
from datetime import date, datetime

import pytest
from conftest import plan_of
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterfold import fixed_values as fv
from meterfold.operators import commands as ops
from meterfold.operators import electricity, gas
from meterfold.sources import schemas

NOW = datetime(2026, 6, 16, 9, 3, 16)
COMMANDS = "seq bigint, id string, op string, body map<string,string>"
GAS_BODY = {
    "perim_donnees_publiees": "false", "perim_donnees_informatives": "true",
    "perim_donnees_techniques": "false", "perim_donnees_contractuelles": "true",
    "nom_titulaire": "Tessier", "raison_sociale_du_titulaire": "Hôpital du Nord",
    "code_postal": "33400", "courriel_titulaire": "energie@hopital-nord.example",
    "perim_donnees_conso_debut": "2024-03-01", "perim_donnees_conso_fin": "2028-12-31",
    "date_debut_droit_acces": "2027-02-10", "date_fin_droit_acces": "2028-08-20",
    "platform_code": "AB12", "partner": "ifpeb", "id_pce": "PCE-90007",
}
ELEC_BODY = {
    "get_dm": "false", "get_cdc": "true", "soutirage": "true", "injection": "false",
    "nom": "Tessier", "raison_sociale": "Lycée des Pins",
    "date_signature_mandat": "2018-11-23", "date_debut_autorisation": "2019-07-01",
    "date_fin_autorisation": "2031-03-31",
    "platform_code": "AB12", "partner": "ifpeb", "id_pdl": "00000000082350",
}
DROP = object()


def changed(base, **over):
    return {k: v for k, v in {**base, **over}.items() if v is not DROP}


def creation_fields(spark, book, bodies):
    rows = [(i, None, "create", b) for i, b in enumerate(bodies)]
    out = ops.validate_creations(spark.createDataFrame(rows, COMMANDS), book)
    return [(r.erreur, r.champ) for r in out.orderBy("seq").collect()]


def test_gas_creation_rules(spark):
    bad, unknown = fv.INVALID_FIELD, fv.UNKNOWN_FIELD
    perims_off = dict.fromkeys(fv.GAS_PERIMETERS, "false")
    cases = [(GAS_BODY, (None, None))]
    required = [k for k in GAS_BODY if not k.startswith("perim_donnees_") or "conso" in k]
    required = [k for k in required if k not in ("raison_sociale_du_titulaire", "nom_titulaire")]
    cases += [(changed(GAS_BODY, **{k: DROP}), (bad, k)) for k in required]
    cases += [(changed(GAS_BODY, **{k: " \t"}), (bad, k)) for k in required]
    cases += [
        (changed(GAS_BODY, id_pce="9" * 21), (bad, "id_pce")),
        (changed(GAS_BODY, id_pce=" " + "9" * 20 + " "), (None, None)),
        (changed(GAS_BODY, partner=" IFPEB "), (None, None)),
        (changed(GAS_BODY, partner="autre"), (bad, "partner")),
        (changed(GAS_BODY, platform_code="PLATEFORME1"), (bad, "platform_code")),
        (changed(GAS_BODY, courriel_titulaire="pas-un-email"), (bad, "courriel_titulaire")),
        (changed(GAS_BODY, code_postal="7500"), (bad, "code_postal")),
        (changed(GAS_BODY, date_fin_droit_acces="2027-02-10"), (bad, "date_fin_droit_acces")),
        (changed(GAS_BODY, date_debut_droit_acces="01/05/2026"), (bad, "date_debut_droit_acces")),
        (changed(GAS_BODY, perim_donnees_conso_debut="2040-01-01"), (None, None)),
        (changed(GAS_BODY, raison_sociale_du_titulaire=DROP, nom_titulaire=" "),
         (bad, "raison_sociale_du_titulaire")),
        (changed(GAS_BODY, raison_sociale_du_titulaire=None), (None, None)),
        (changed(GAS_BODY, raison_sociale_du_titulaire="x" * 201), (bad, "raison_sociale_du_titulaire")),
        (changed(GAS_BODY, nom_titulaire="x" * 41), (bad, "nom_titulaire")),
        (changed(GAS_BODY, perim_donnees_publiees="oui"), (bad, "perim_donnees_publiees")),
        (changed(GAS_BODY, perim_donnees_publiees=" "), (bad, "perim_donnees_publiees")),
        (changed(GAS_BODY, **perims_off), (bad, None)),
        (changed(GAS_BODY, **{**perims_off, "perim_donnees_publiees": None}), (None, None)),
        (changed(GAS_BODY, role_tiers="X", id_pce=DROP), (unknown, "role_tiers")),
        ({}, (bad, "id_pce")),
    ]
    assert creation_fields(spark, gas, [c[0] for c in cases]) == [c[1] for c in cases]


def test_electricity_creation_rules(spark):
    bad = fv.INVALID_FIELD
    cases = [
        (ELEC_BODY, (None, None)),
        (changed(ELEC_BODY, id_pdl="9" * 15), (bad, "id_pdl")),
        (changed(ELEC_BODY, id_pdl="PDL-1"), (None, None)),
        (changed(ELEC_BODY, platform_code="9" * 11), (bad, "platform_code")),
        (changed(ELEC_BODY, date_signature_mandat=DROP), (bad, "date_signature_mandat")),
        (changed(ELEC_BODY, date_fin_autorisation="2015-01-01"), (bad, "date_fin_autorisation")),
        (changed(ELEC_BODY, raison_sociale=DROP, nom=DROP), (bad, "raison_sociale")),
        (changed(ELEC_BODY, raison_sociale="x" * 101), (bad, "raison_sociale")),
        (changed(ELEC_BODY, nom="x" * 51), (bad, "nom")),
        (changed(ELEC_BODY, prenom="x" * 51), (bad, "prenom")),
        (changed(ELEC_BODY, civilite="X"), (bad, "civilite")),
        (changed(ELEC_BODY, civilite=" mme"), (None, None)),
        (changed(ELEC_BODY, civilite=" "), (None, None)),
        (changed(ELEC_BODY, injection=DROP), (bad, "injection")),
        (changed(ELEC_BODY, soutirage="oui"), (bad, "soutirage")),
        (changed(ELEC_BODY, soutirage="false"), (bad, None)),
        (changed(ELEC_BODY, get_cdc="false", get_dm="0"), (bad, None)),
        (changed(ELEC_BODY, get_cdc=DROP, get_dm="0"), (None, None)),
        (changed(ELEC_BODY, get_cdc=""), (bad, "get_cdc")),
        (changed(ELEC_BODY, statut="traite"), (fv.UNKNOWN_FIELD, "statut")),
    ]
    assert creation_fields(spark, electricity, [c[0] for c in cases]) == [c[1] for c in cases]


def gas_registry(spark, *rows):
    base = {f.name: None for f in schemas.GAS_REGISTRY}
    return spark.createDataFrame(
        [tuple({**base, **r}.values()) for r in rows], schemas.GAS_REGISTRY)


STORED = {
    "id_pce": "GI1", "partner": "ifpeb", "platform_code": "PF01", "etat_droit_acces": "Active",
    "date_debut_droit_acces": "2024-01-01", "date_fin_droit_acces": "2026-01-01",
    "nom_titulaire": "Moreau", "perim_donnees_publiees": True, "nb_tentatives_declare": 3,
    "message_erreur_declare": "texte", "derniere_collecte_publiee": "2025-01-01",
}


def judged(spark, registry, book, *asked):
    rows = [(i, *a) for i, a in enumerate(asked)]
    out = ops.judge(spark.createDataFrame(rows, COMMANDS), registry, book, NOW).orderBy("seq")
    return out.collect()


def test_gas_patch_rules(spark):
    registry = gas_registry(spark, STORED, {**STORED, "id_pce": "BAD", "date_fin_droit_acces": "n/a"})
    cases = [
        ("GI1", {"code_postal": "75002"}, 200, None, None),
        ("ZZ", {"code_postal": "75002"}, 404, "PCE_INTROUVABLE", None),
        ("GI1", {}, 400, "CHAMP_INVALIDE", None),
        ("GI1", {"partner": "ifpeb"}, 400, "CHAMP_NON_MODIFIABLE", "partner"),
        ("GI1", {"courriel_titulaire": None}, 400, "CHAMP_INVALIDE", "courriel_titulaire"),
        ("GI1", {"date_fin_droit_acces": "2024-01-01"}, 400, "CHAMP_INVALIDE", "date_fin_droit_acces"),
        ("GI1", {"date_fin_droit_acces": "2024-1-2"}, 200, None, None),
        ("GI1", {"date_debut_droit_acces": "2026-01-01"}, 400, "CHAMP_INVALIDE", "date_fin_droit_acces"),
        ("BAD", {"date_debut_droit_acces": "2026-01-01"}, 200, None, None),
        ("GI1", {"nom_titulaire": " "}, 400, "CHAMP_INVALIDE", "raison_sociale_du_titulaire"),
        ("GI1", {"nom_titulaire": None, "raison_sociale_du_titulaire": "Ville"}, 200, None, None),
        ("GI1", {"nom_titulaire": "x" * 41}, 400, "CHAMP_INVALIDE", "nom_titulaire"),
        ("GI1", {"perim_donnees_publiees": None}, 400, "CHAMP_INVALIDE", "perim_donnees_publiees"),
        ("GI1", {"perim_donnees_publiees": "false"}, 400, "CHAMP_INVALIDE", None),
        ("GI1", {"perim_donnees_publiees": "false", "perim_donnees_techniques": "1"}, 200, None, None),
    ]
    out = judged(spark, registry, gas, *[(c[0], "patch", c[1]) for c in cases])
    assert [(r.http_status, r.erreur, r.champ) for r in out] == [c[2:] for c in cases]
    applied = out[0].state
    assert (applied.code_postal, applied.etat_droit_acces, applied.nb_tentatives_declare,
            applied.message_erreur_declare) == ("75002", "nouveau", 0, None)
    assert out[6].state.date_fin_droit_acces == "2024-01-02"
    assert out[2].state.etat_droit_acces == "Active"


def test_state_machines(spark):
    states = [*fv.GAS_STATES, None, " Active "]
    registry = gas_registry(spark, *[
        {**STORED, "id_pce": str(i), "etat_droit_acces": s} for i, s in enumerate(states)])
    retry = judged(spark, registry, gas, *[(str(i), "retry", None) for i in range(len(states))])
    assert [r.http_status for r in retry] == [409, 409, 200, 409, 200, 409, 409, 409, 409, 409]
    revoke = judged(spark, registry, gas, *[(str(i), "revoke", None) for i in range(len(states))])
    assert [r.http_status for r in revoke] == [200, 200, 409, 200, 409, 404, 409, 404, 409, 200]
    assert {r.erreur for r in revoke if r.http_status == 404} == {"PCE_DEJA_REVOQUE"}
    assert revoke[0].state.etat_droit_acces == "Révoquée"

    pdl = spark.createDataFrame([(str(i), s) for i, s in enumerate(fv.ELEC_STATES)], "id_pdl string, statut string")
    retry = judged(spark, pdl, electricity, *[(str(i), "retry", None) for i in range(7)])
    assert [r.http_status for r in retry] == [409, 409, 409, 200, 409, 409, 409]
    assert (retry[3].state.statut, retry[3].state.erreur, retry[3].state.date_modification) == (
        "nouveau", None, NOW)
    revoke = judged(spark, pdl, electricity, *[(str(i), "revoke", None) for i in range(7)])
    assert [r.http_status for r in revoke] == [409, 409, 200, 409, 409, 404, 404]


def test_electricity_patch_rules(spark):
    row = dict.fromkeys(schemas.PDL.fieldNames()) | {
        "id_pdl": "P", "platform_code": "PF", "statut": "traite", "nom": "Moreau", "get_cdc": "true",
        "get_dm": "false", "soutirage": "true", "injection": None, "erreur": "texte",
        "date_debut_autorisation": date(2020, 1, 1), "date_fin_autorisation": date(2022, 1, 1)}
    relaxed = T.StructType([T.StructField(f.name, f.dataType) for f in schemas.PDL])
    pdl = spark.createDataFrame([tuple(row.values())], relaxed)
    cases = [
        ({"civilite": "mme"}, 200, None), ({"civilite": "DR"}, 400, "civilite"), ({"civilite": None}, 200, None),
        ({"nom": None}, 400, "raison_sociale"), ({"nom": "x" * 51, "raison_sociale": " "}, 400, "nom"),
        ({"date_debut_autorisation": "2022-01-01"}, 400, "date_fin_autorisation"),
        ({"prenom": "p" * 51}, 400, "prenom"), ({"injection": "oui"}, 400, "injection"),
        ({"soutirage": "0"}, 400, None), ({"soutirage": "0", "injection": "1"}, 200, None),
        ({"get_cdc": "false"}, 400, None), ({"get_cdc": "false", "get_dm": "vrai"}, 200, None),
        ({"statut": "traite"}, 400, "statut"),
    ]
    out = judged(spark, pdl, electricity, *[("P", "patch", c[0]) for c in cases])
    assert [(r.http_status, r.champ) for r in out] == [c[1:] for c in cases]
    assert (out[0].state.civilite, out[0].state.statut, out[0].state.erreur) == ("MME", "nouveau", None)


# --- fold ----------------------------------------------------------------------------------

class Model:
    """One gas right changed by one command after the other."""

    def __init__(self, state):
        self.state = state

    def run(self, op, body):
        s = self.state
        if op == "create":
            if s is not None:
                return 409
            self.state = {"etat": "nouveau", "debut": body["date_debut_droit_acces"],
                          "fin": body["date_fin_droit_acces"], "nom": body["nom_titulaire"], "pub": True,
                          "tech": True}
            return 201
        if s is None:
            return 404
        if op == "retry":
            if s["etat"] not in fv.GAS_RETRYABLE:
                return 409
            s["etat"] = "nouveau"
            return 200
        if op == "revoke":
            if s["etat"] in fv.GAS_ALREADY_REVOKED:
                return 404
            if s["etat"] not in fv.GAS_REVOCABLE:
                return 409
            s["etat"] = "Révoquée"
            return 200
        merged = dict(s)
        for name, key in (("date_debut_droit_acces", "debut"), ("date_fin_droit_acces", "fin"),
                          ("nom_titulaire", "nom")):
            if name in body:
                merged[key] = body[name]
        for name, key in (("perim_donnees_publiees", "pub"), ("perim_donnees_techniques", "tech")):
            if name in body:
                merged[key] = body[name] == "true"
        dates = "date_debut_droit_acces" in body or "date_fin_droit_acces" in body
        if dates and merged["fin"] <= merged["debut"]:
            return 400
        if "nom_titulaire" in body and not merged["nom"]:
            return 400
        if ({"perim_donnees_publiees", "perim_donnees_techniques"} & set(body)) and not (
                merged["pub"] or merged["tech"]):
            return 400
        self.state = {**merged, "etat": "nouveau"}
        return 200


def random_commands(rng, ids, n):
    day = lambda: f"20{rng.randint(20, 30)}-0{rng.randint(1, 9)}-15"
    asked = []
    for seq in range(n):
        meter = rng.choice(ids)
        op = rng.choice(["create", "patch", "patch", "patch", "retry", "revoke"])
        body = None
        if op == "create":
            body = changed(GAS_BODY, id_pce=meter, date_debut_droit_acces="2021-01-15",
                           date_fin_droit_acces=day(), raison_sociale_du_titulaire=DROP,
                           perim_donnees_contractuelles="false", perim_donnees_informatives="false",
                           perim_donnees_techniques="true", perim_donnees_publiees="true")
            if body["date_fin_droit_acces"] <= "2021-01-15":
                body["date_fin_droit_acces"] = "2025-01-15"
        elif op == "patch":
            body = {k: v for k, v in {
                "date_debut_droit_acces": day(), "date_fin_droit_acces": day(),
                "nom_titulaire": rng.choice(["A", None]),
                "perim_donnees_publiees": rng.choice(["true", "false"]),
                "perim_donnees_techniques": rng.choice(["true", "false"]),
            }.items() if rng.random() < 0.3} or {"code_postal": "75002"}
        asked.append((seq, None if op == "create" else meter, op, body))
    return asked


@pytest.mark.parametrize("chunk_rows", [1000, 7])
def test_fold_equals_the_sequential_model(spark, chunk_rows):
    rng = random.Random(11)
    # One meter gets a third of the commands.
    ids = ["HOT"] * 5 + [f"M{i}" for i in range(10)]
    asked = random_commands(rng, ids, 300)
    stored = [{"id_pce": k, "etat_droit_acces": e, "date_debut_droit_acces": "2022-01-15",
               "date_fin_droit_acces": "2026-01-15", "nom_titulaire": "N", "perim_donnees_publiees": True,
               "perim_donnees_techniques": False, "derniere_collecte_publiee": "gardé"}
              for k, e in (("HOT", "Refusée"), ("M1", "Active"), ("M2", "A revérifier"), ("M3", "résilié"))]
    models = {r["id_pce"]: Model({"etat": r["etat_droit_acces"], "debut": "2022-01-15", "fin": "2026-01-15",
                                  "nom": "N", "pub": True, "tech": False}) for r in stored}
    want = {}
    for seq, meter, op, body in asked:
        model = models.setdefault(meter or body["id_pce"], Model(None))
        want[seq] = model.run(op, body)
    registry = gas_registry(spark, *stored)
    rows = spark.createDataFrame(asked, COMMANDS).repartition(5)
    outcomes, changes = ops.fold(rows, registry, gas, NOW, chunk_rows)
    assert {r.seq: r.http_status for r in outcomes.collect()} == want
    final = {r.id_pce: r for r in ops.apply_changes(registry, changes, gas).collect()}
    assert set(final) == {k for k, m in models.items() if m.state}
    for key, model in models.items():
        if model.state:
            r, s = final[key], model.state
            assert (r.etat_droit_acces, r.date_debut_droit_acces, r.date_fin_droit_acces, r.nom_titulaire,
                    r.perim_donnees_publiees, r.perim_donnees_techniques) == (
                s["etat"], s["debut"], s["fin"], s["nom"], s["pub"], s["tech"])
    assert final["HOT"].derniere_collecte_publiee == "gardé"


def test_an_early_write_reaches_all_chunks_in_few_rounds(spark, monkeypatch):
    """One postal code, then only addresses: the rounds do not grow with the chunks."""
    rounds = []
    handed = ops._handed
    monkeypatch.setattr(ops, "_handed", lambda *args: rounds.append(1) or handed(*args))
    asked = [(0, "HOT", "patch", {"code_postal": "59000"})] + [
        (i, "HOT", "patch", {"courriel_titulaire": f"u{i}@mail.example"}) for i in range(1, 400)]
    asked += [(400, "NEUF", "retry", {})] + [
        (401 + i, "HOT", op, {}) for i, op in enumerate(["revoke", "retry", "patch"])]
    registry = gas_registry(spark, {"id_pce": "HOT", "etat_droit_acces": "Active", "nom_titulaire": "N",
                                    "perim_donnees_publiees": True})
    rows = spark.createDataFrame(asked, COMMANDS).repartition(5)
    outcomes, changes = ops.fold(rows, registry, gas, NOW, 10)
    assert len(rounds) <= 4
    got = {r.seq: r.http_status for r in outcomes.collect()}
    assert len(got) == len(asked) and {got[i] for i in range(400)} == {200}
    row = changes.head()
    assert (row.code_postal, row.courriel_titulaire) == ("59000", "u399@mail.example")


def test_fold_keeps_refused_creations_apart(spark):
    asked = [(i, None, "create", {}) for i in range(30)] + [(40, None, "create", ELEC_BODY)]
    outcomes, changes = ops.fold(
        spark.createDataFrame(asked, COMMANDS), spark.createDataFrame([], schemas.PDL), electricity, NOW, 5)
    assert sorted(r.http_status for r in outcomes.collect()) == [201] + [400] * 30
    row = changes.head()
    assert row.asDict() | ELEC_BODY_STORED == row.asDict()
    assert changes.columns == schemas.PDL.fieldNames()


ELEC_BODY_STORED = {
    **ELEC_BODY, "date_signature_mandat": date(2018, 11, 23), "date_debut_autorisation": date(2019, 7, 1),
    "date_fin_autorisation": date(2031, 3, 31), "statut": "nouveau", "date_creation": NOW,
    "date_modification": NOW, "statut_cdc": None, "erreur": None,
}


def test_lookup(spark):
    registry = gas_registry(spark, STORED)
    from meterfold.operators.registry import gas_view
    ids = spark.createDataFrame([("GI1",), ("ZZ",)], "id_pce string")
    out = {r.id_pce: r for r in ops.lookup(ids, registry, gas, gas_view(registry).drop("message_erreur")).collect()}
    assert (out["GI1"].http_status, out["GI1"].statut) == (200, "Active")
    assert (out["ZZ"].http_status, out["ZZ"].erreur, out["ZZ"].statut) == (404, "PCE_INTROUVABLE", None)


def test_json_requests_keep_absent_and_null_apart(spark):
    from meterfold.sources.lake import read_commands
    rows = spark.createDataFrame([(1, "GI1", "patch", '{"nom_titulaire": null, "perim_donnees_publiees": true}')],
                                 "seq bigint, id string, op string, body string")
    body = read_commands(rows).select(F.col("body")).head().body
    assert body == {"nom_titulaire": None, "perim_donnees_publiees": "true"}


def test_a_filter_on_the_fold_does_not_fold_again(spark):
    rows = spark.createDataFrame(
        [(i, f"P{i % 3}", "retry", None) for i in range(9)], COMMANDS)
    registry = spark.createDataFrame(
        [("P0", "A revérifier"), ("P1", "nouveau")], "id_pce string, etat_droit_acces string")
    for df in ops.fold(rows, registry, gas, NOW):
        plan = plan_of(df.where("id_pce IS NOT NULL" if "id_pce" in df.columns else "id IS NOT NULL"))
        assert plan.count("aggregate(commands") == 1
    assert [r.op for r in ops.fold(rows, registry, gas, NOW)[0].collect()] == ["retry"] * 9


def test_commands_without_rules_on_their_body_travel_without_it(spark):
    body = {"nom_titulaire": "x"}
    rows = spark.createDataFrame(
        [(i, "P", op, body) for i, op in enumerate(["create", "patch", "retry", "revoke", None])], COMMANDS)
    assert {r.seq: len(r.body) for r in ops.addressed(rows, gas).collect()} == {0: 1, 1: 1, 2: 0, 3: 0, 4: 0}


@pytest.mark.parametrize("chunk_rows", [2, 256])
def test_repeated_commands_count_once_inside_the_fold(spark, chunk_rows):
    rows = [(seq, meter, "patch", {"nom_titulaire": f"{name}{seq}"})
            for meter in ("P", "Q") for seq in range(5) for name in ("b", "a", "c")]
    rows += [(9, None, "create", {"nom_titulaire": "x"})] * 2
    asked = ops.addressed(spark.createDataFrame(rows, COMMANDS), gas)
    registry = spark.createDataFrame(
        [("P", "Active", True), ("Q", "Active", True)],
        "id_pce string, etat_droit_acces string, perim_donnees_publiees boolean")
    total = [F.col("op"), F.to_json(F.array_sort(F.map_entries("body")))]
    outcomes, changes = ops.fold(asked, registry, gas, NOW, chunk_rows=chunk_rows, total=total)
    assert sorted(r.seq for r in outcomes.where("id IS NOT NULL").collect()) == sorted([*range(5)] * 2)
    assert outcomes.where("id IS NULL").count() == 2
    assert {(r.id_pce, r.nom_titulaire) for r in changes.collect()} == {("P", "a4"), ("Q", "a4")}
