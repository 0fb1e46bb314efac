"""Error payloads: a JSON document, free text, or nothing."""

from pyspark.sql import Column, functions as F

from meterfold.functions.text import clean


def payload_text(c: Column) -> Column:
    """Stored payload without the spellings that mean "no error" (blank, ``null``)."""
    s = clean(c)
    return F.when(F.lower(s) != "null", s)


def payload(c: Column) -> Column:
    """VARIANT: the JSON document when it parses, else the text as a string."""
    s = payload_text(c)
    return F.coalesce(F.try_parse_json(s), s.cast("variant"))


def payload_field(c: Column, key: str) -> Column:
    """One top-level key of the payload, null for free text."""
    return F.get_json_object(payload_text(c), f"$.{key}")


def is_json_payload(c: Column) -> Column:
    return F.try_parse_json(payload_text(c)).isNotNull()


def build_error(code: Column, message: Column) -> Column:
    return F.to_json(
        F.struct(code.alias("code_statut_traitement"), message.alias("message_retour_traitement")),
        {"ignoreNullFields": "false"},
    )
