import pytest
from pyspark.sql import functions as F

from meterfold.operators import quality
from meterfold.sources import schemas


def pdl(spark, *changes):
    base = {f.name: None for f in schemas.PDL}
    base |= {"id_pdl": "00000000001965", "platform_code": "PF01", "get_cdc": "true", "get_dm": "true",
             "statut": "nouveau"}
    relaxed = schemas.T.StructType([schemas.T.StructField(f.name, f.dataType) for f in schemas.PDL])
    return spark.createDataFrame([tuple((base | c).values()) for c in changes], relaxed)


def test_valid_table_has_no_violation(spark):
    rows = pdl(spark, {}, {"statut": "résilié", "commentaire": "é" * 50})
    assert quality.violations(rows, "pdl") == []
    assert quality.require_valid(rows, "pdl") is rows


def test_report_counts_every_rule_once(spark):
    rows = pdl(spark, {"id_pdl": None}, {"id_pdl": "9" * 15}, {"statut": "Actif"}, {"statut": "Zut"},
               {"commentaire": "x" * 51}, {"get_cdc": None})
    report = {(r.column_name, r.rule): (r.n_violations, r.example)
              for r in quality.quality_report(rows.drop("nom").withColumn("plus", F.lit(1)), "pdl").collect()}
    assert report == {
        ("nom", "missing"): (None, None), ("plus", "extra"): (None, None),
        ("id_pdl", "not_null"): (1, None), ("id_pdl", "max_length"): (1, "9" * 15),
        ("statut", "enum"): (2, "Actif"), ("commentaire", "max_length"): (1, "x" * 51),
        ("get_cdc", "not_null"): (1, None),
    }


def test_strict_reports_all_messages(spark):
    rows = pdl(spark, {"id_pdl": None}, {"statut": "Actif"}).drop("nom")
    with pytest.raises(quality.SchemaViolation) as failure:
        quality.require_valid(rows, "pdl")
    text = str(failure.value)
    assert "Colonnes manquantes : ['nom']" in text
    assert "Colonne 'id_pdl' : 1 valeur(s) NULL interdite(s) (NOT NULL)." in text
    assert "hors enum" in text and "Ex : 'Actif'" in text


def test_declared_width_may_contradict_the_enum(spark):
    rows = spark.createDataFrame([("00000000001965", "S1", "COURBES")],
                                 "id_pdl string, id_service_souscrit string, mesures_type_code string")
    rules = {r.rule for r in quality.quality_report(rows, "services_souscrits").collect()
             if r.column_name == "mesures_type_code"}
    assert rules == {"max_length"}


def test_split_valid(spark):
    valid, bad = quality.split_valid(pdl(spark, {}, {"statut": "x", "injection": "oui"}), "pdl")
    assert valid.count() == 1 and valid.columns == schemas.PDL.fieldNames()
    assert bad.head().row_errors == ["injection:enum", "statut:enum"]


def test_catalogue(spark):
    catalogue = schemas.describe_schema(spark)
    assert catalogue.count() == 22 + 22 + 14 + 11 + 5 + 10
    row = catalogue.where("table_name = 'pdl' AND column_name = 'get_dm'").head()
    assert (row.nullable, row.enum_values, row.default_value) == (False, "true,false", "true")
    with pytest.raises(ValueError, match="Table inconnue"):
        schemas.schema_of("absente")
    assert schemas.list_columns("log_erreur")[0] == "id_pdl"
