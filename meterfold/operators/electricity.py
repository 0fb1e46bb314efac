"""Electricity consents: request rules and state changes as column expressions.

Same shape as the gas rules: body-only facts, then a verdict against the stored state.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from meterfold import fixed_values as fv
from meterfold.functions.binding import apart
from meterfold.functions.booleans import any_true, parse_bool
from meterfold.functions.dates import parse_day, stamp_literal
from meterfold.functions.text import clean, is_filled, longer_than, one_of, strip_flat
from meterfold.operators.outcomes import (
    error, fill, first_error, first_unlisted, invalid, outcome, rejected,
)
from meterfold.sources.schemas import PDL

KEY = "id_pdl"
STATUS = "statut"
CODES, TEXTS = fv.ELEC_CODES, fv.ELEC_TEXT
_SIGNED, _START, _END = fv.ELEC_DATES
_HOLDER = {"a": "raison_sociale", "b": "nom"}
_ORDER = {"start": _START, "end": _END}
_DRAW = {"a": "soutirage", "b": "injection"}
_SERIES = {"a": "get_cdc", "b": "get_dm"}

STATE_COLUMNS = [c for c in PDL.fieldNames() if c != KEY]
STATE_TYPE = T.StructType(
    [T.StructField("exists", T.BooleanType())]
    + [T.StructField(c, PDL[c].dataType) for c in STATE_COLUMNS]
)


FACT_ERRORS = ["create_error", "guard_error", "name_error", "spelling_error"]
PATCH_FIELDS = fv.ELEC_PATCH_FIELDS
VALUE_COLUMNS = ["partner", "platform_code", *fv.ELEC_PATCH_FIELDS]
_TEXTS = ("partner", "platform_code", "raison_sociale", "civilite", "nom", "prenom")


def _text(c: str) -> Column:
    return F.col(f"text_{c}")


def _too_long(champ: str) -> Column:
    n = fv.MAX_LENGTH[champ]
    return invalid(longer_than(_text(champ), n), champ, "too_long", n=n)


def _civility_error() -> Column:
    given = F.upper(_text("civilite"))
    return invalid(given.isNotNull() & ~one_of(given, fv.CIVILITIES), "civilite", "civility")


def _stored_flag(state: Column, c: str) -> Column:
    return parse_bool(state[c], "existing_text").cast("string")


def _create_error() -> Column:
    day = lambda c: F.col(f"day_{c}")
    flag = lambda c: F.col(f"flag_{c}")
    required = lambda c: invalid(_text(c).isNull(), c, "required")
    unreadable = lambda c: invalid(
        F.col(f"raw_{c}").isNotNull() & flag(c).isNull(), c, "boolean")
    unknown = F.col("not_creatable")
    by_default = lambda c: F.coalesce(flag(c), F.lit(True))
    return first_error(
        F.when(unknown.isNotNull(), error(fv.UNKNOWN_FIELD, unknown, fill("unknown", unknown))),
        required(KEY), _too_long(KEY),
        required("partner"),
        invalid(~one_of(F.lower(_text("partner")), fv.PARTNERS), "partner", "one_of",
                choices=", ".join(fv.PARTNERS)),
        required("platform_code"), _too_long("platform_code"),
        *[rule for c in fv.ELEC_DATES
          for rule in (required(c), invalid(day(c).isNull(), c, "date"))],
        invalid(day(_END) <= day(_START), _END, "order", **_ORDER),
        invalid(_text("raison_sociale").isNull() & _text("nom").isNull(),
                "raison_sociale", "holder", **_HOLDER),
        *[_too_long(c) for c in ("raison_sociale", "nom", "prenom")],
        _civility_error(),
        required("injection"), unreadable("injection"),
        required("soutirage"), unreadable("soutirage"),
        unreadable("get_cdc"), unreadable("get_dm"),
        invalid(~any_true(flag("injection"), flag("soutirage")), None, "pair", **_DRAW),
        invalid(~any_true(by_default("get_cdc"), by_default("get_dm")), None, "pair", **_SERIES),
    )


def _patch_errors() -> dict[str, Column]:
    has = lambda c: F.col(f"has_{c}")
    unlisted = F.col("not_patchable")
    return {
        "guard_error": first_error(
            F.when(unlisted.isNotNull(),
                   error(fv.READ_ONLY_FIELD, unlisted, fill("read_only", unlisted))),
            F.when(F.size("body") == 0, error(fv.INVALID_FIELD, None, fv.TEXT["empty_patch"])),
            *[invalid(has(c) & F.col(f"day_{c}").isNull(), c, "date") for c in fv.ELEC_DATES],
        ),
        "name_error": first_error(_civility_error(), _too_long("raison_sociale"), _too_long("nom")),
        "spelling_error": first_error(_too_long("prenom"), *[
            invalid(has(c) & F.col(f"flag_{c}").isNull(), c, "boolean") for c in fv.ELEC_FLAGS
        ]),
    }


def add_facts(commands: DataFrame) -> DataFrame:
    """What the body alone decides: fields it writes (``has``), their normal form, the body's own errors."""
    body, creating, patching = F.col("body"), F.col("op") == "create", F.col("op") == "patch"
    raw = commands.withColumns({f"raw_{c}": body[c] for c in fv.ELEC_CREATE_FIELDS})
    texts = raw.withColumns({
        **{f"text_{c}": F.nullif(strip_flat(F.col(f"raw_{c}")), F.lit("")) for c in fv.ELEC_CREATE_FIELDS},
        **{f"has_{c}": F.when(patching, F.map_contains_key(body, c)).otherwise(creating)
           for c in fv.ELEC_PATCH_FIELDS},
        "not_creatable": first_unlisted(body, fv.ELEC_CREATE_FIELDS),
        "not_patchable": first_unlisted(body, fv.ELEC_PATCH_FIELDS),
    })
    texts = texts.withColumns({
        "op": apart(F.col("op")),
        **{f"day_{c}": parse_day(_text(c)) for c in fv.ELEC_DATES},
        **{f"flag_{c}": parse_bool(_text(c), "input", stripped=True) for c in fv.ELEC_FLAGS},
    })
    as_text = lambda c: F.col(f"flag_{c}").cast("string")
    return texts.withColumns({
        "op": apart(F.col("op")),
        "create_error": F.when(creating, _create_error()),
        **{name: F.when(patching, rules) for name, rules in _patch_errors().items()},
        **{f"value_{c}": _text(c) for c in _TEXTS},
        "value_partner": F.lower("text_partner"),
        "value_civilite": F.upper("text_civilite"),
        **{f"value_{c}": F.col(f"day_{c}") for c in fv.ELEC_DATES},
        **{f"value_{c}": as_text(c) for c in ("injection", "soutirage")},
        **{f"value_{c}": F.coalesce(as_text(c), F.when(creating, F.lit("true")))
           for c in ("get_cdc", "get_dm")},
    })


def patch_error(f: Column, state: Column) -> Column:
    has, value = f["has"], f["value"]
    merged = lambda c: F.when(has[c], value[c]).otherwise(state[c])
    flag = lambda c: F.when(has[c], value[c]).otherwise(_stored_flag(state, c)) == "true"
    touched = lambda *cs: any_true(*[has[c] for c in cs])
    pair = lambda names: invalid(
        touched(*names.values()) & ~any_true(*[flag(c) for c in names.values()]),
        None, "pair", **names)
    return F.coalesce(
        f["guard_error"],
        invalid(touched(_START, _END) & (merged(_END) <= merged(_START)), _END, "order", **_ORDER),
        f["name_error"],
        invalid(touched("raison_sociale", "nom")
                & ~any_true(is_filled(merged("raison_sociale")), is_filled(merged("nom"))),
                "raison_sociale", "holder", **_HOLDER),
        f["spelling_error"],
        pair(_DRAW),
        pair(_SERIES),
    )


def verdict(f: Column, state: Column, bad_patch: Column, status: Column | None = None) -> Column:
    op, status = f["op"], clean(state[STATUS]) if status is None else status
    t, codes = TEXTS, CODES
    wrong = lambda text: outcome(409, fv.WRONG_STATE, None, t[text], status)
    return (
        F.when(op == "create",
               F.when(f["create_error"].isNotNull(), rejected(f["create_error"]))
               .when(state["exists"],
                     outcome(409, codes["exists"], None, t["exists"], state[STATUS]))
               .otherwise(outcome(201, None, None, t["created"], fv.NEW_STATE)))
        .when(~state["exists"], outcome(404, codes["missing"], None, t["missing"]))
        .when(op == "patch",
              F.when(bad_patch.isNotNull(), rejected(bad_patch))
              .otherwise(outcome(200, None, None, None, fv.NEW_STATE)))
        .when(op == "retry",
              F.when(~one_of(status, fv.ELEC_RETRYABLE), wrong("not_retryable"))
              .otherwise(outcome(200, None, None, t["retried"], fv.NEW_STATE)))
        .when(op == "revoke",
              F.when(one_of(status, fv.ELEC_ALREADY_REVOKED),
                     outcome(404, codes["revoked"], None, t["already_revoked"]))
              .when(~one_of(status, fv.ELEC_REVOCABLE), wrong("not_revocable"))
              .otherwise(outcome(200, None, None, t["revoked"], fv.ELEC_REVOKED)))
        .otherwise(outcome(400, fv.INVALID_FIELD, "op", None))
    )


def next_state(f: Column, state: Column, result: Column, now: datetime) -> Column:
    op = f["op"]
    creating = op == "create"
    stamp = stamp_literal(now)
    kept = {c: state[c] for c in STATE_COLUMNS}
    changed = {
        **kept,
        **{c: F.when(f["has"][c], f["value"][c]).otherwise(state[c])
           for c in fv.ELEC_PATCH_FIELDS},
        **{c: F.when(creating, f["value"][c]).otherwise(state[c])
           for c in ("partner", "platform_code")},
        "date_creation": F.when(creating, stamp).otherwise(state["date_creation"]),
        "date_modification": stamp,
        STATUS: F.when(op == "revoke", fv.ELEC_REVOKED).otherwise(F.lit(fv.NEW_STATE)),
        "erreur": F.when(op == "revoke", state["erreur"]),
    }
    return F.when(
        result["http_status"].isin(200, 201),
        F.struct(F.lit(True).alias("exists"), *[changed[c].alias(c) for c in STATE_COLUMNS]),
    ).otherwise(state)

