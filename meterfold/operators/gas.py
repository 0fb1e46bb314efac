"""Gas rights: request rules and state changes as column expressions.

A command's *facts* depend on its body only and are computed once per command. The *verdict*
combines facts with the stored state (a struct), so the same rules serve a snapshot join and an
ordered fold over several commands of one meter.
"""

from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from meterfold import fixed_values as fv
from meterfold.functions.binding import apart
from meterfold.functions.booleans import any_true, parse_bool
from meterfold.functions.dates import iso_day, iso_stamp, parse_day
from meterfold.functions.text import (
    clean, is_email, is_filled, is_postal_code, longer_than, one_of, strip_flat,
)
from meterfold.operators.outcomes import (
    error, fill, first_error, first_unlisted, invalid, outcome, rejected,
)
from meterfold.sources.schemas import GAS_REGISTRY

KEY = "id_pce"
STATUS = "etat_droit_acces"
CODES, TEXTS = fv.GAS_CODES, fv.GAS_TEXT
_START, _END = "date_debut_droit_acces", "date_fin_droit_acces"
_USE_START, _USE_END = "perim_donnees_conso_debut", "perim_donnees_conso_fin"
_COMPANY, _NAME = "raison_sociale_du_titulaire", "nom_titulaire"
_MAIL, _POSTAL = "courriel_titulaire", "code_postal"
_DAYS = (_START, _END, _USE_START, _USE_END)
_TEXTS = ("partner", "platform_code", _MAIL, _POSTAL, _COMPANY, _NAME)

# Registry columns a command can change, in registry order.
STATE_COLUMNS = [
    "partner", "platform_code", _MAIL, _POSTAL, *_DAYS, _COMPANY, _NAME, *fv.GAS_PERIMETERS,
    "role_tiers", STATUS, "date_creation", "derniere_maj",
    "nb_tentatives_declare", "message_erreur_declare",
]
STATE_TYPE = T.StructType(
    [T.StructField("exists", T.BooleanType())]
    + [T.StructField(c, GAS_REGISTRY[c].dataType) for c in STATE_COLUMNS]
)

_NO_ORDER = {"start": _START, "end": _END}


def _too_long(value: Column, champ: str) -> Column:
    n = fv.MAX_LENGTH[champ]
    return invalid(longer_than(value, n), champ, "too_long", n=n)


def _mail_error(value: Column) -> Column:
    return invalid(~is_email(value), _MAIL, "email", n=fv.MAX_LENGTH[_MAIL])


def _holder_error(broken: Column) -> Column:
    return invalid(broken, _COMPANY, "holder", a=_COMPANY, b=_NAME)


FACT_ERRORS = ["create_error", "guard_error", "length_error", "spelling_error"]
PATCH_FIELDS = fv.GAS_PATCH_FIELDS
VALUE_COLUMNS = ["partner", "platform_code", *fv.GAS_PATCH_FIELDS]


def _create_error() -> Column:
    """First broken creation rule (null when the body is acceptable)."""
    text = lambda c: F.col(f"text_{c}")
    day = lambda c: F.col(f"day_{c}")
    required = lambda c: invalid(text(c).isNull(), c, "required")
    dated = lambda c: [required(c), invalid(day(c).isNull(), c, "date")]
    unknown = F.col("not_creatable")
    flags = [
        F.coalesce(F.col(f"flag_{c}"), F.lit(default))
        for c, default in zip(fv.GAS_PERIMETERS, fv.GAS_PERIMETER_DEFAULTS)
    ]
    return first_error(
        F.when(unknown.isNotNull(), error(fv.UNKNOWN_FIELD, unknown, fill("unknown", unknown))),
        required(KEY), _too_long(text(KEY), KEY),
        required("partner"),
        invalid(~one_of(F.lower(text("partner")), fv.PARTNERS), "partner", "one_of",
                choices=", ".join(fv.PARTNERS)),
        required("platform_code"), _too_long(text("platform_code"), "platform_code"),
        required(_MAIL), _mail_error(text(_MAIL)),
        required(_POSTAL), invalid(~is_postal_code(text(_POSTAL)), _POSTAL, "postal"),
        *dated(_START), *dated(_END), invalid(day(_END) <= day(_START), _END, "order", **_NO_ORDER),
        *dated(_USE_START), *dated(_USE_END),
        _holder_error(text(_COMPANY).isNull() & text(_NAME).isNull()),
        _too_long(text(_COMPANY), _COMPANY), _too_long(text(_NAME), _NAME),
        *[invalid(F.col(f"raw_{c}").isNotNull() & F.col(f"flag_{c}").isNull(), c, "boolean")
          for c in fv.GAS_PERIMETERS],
        invalid(~any_true(*flags), None, "perimeter"),
    )


def _patch_errors() -> dict[str, Column]:
    """Patch rules that the body alone decides, in three groups around the cross checks."""
    has = lambda c: F.col(f"has_{c}")
    text = lambda c: F.col(f"text_{c}")
    unlisted = F.col("not_patchable")
    return {
        "guard_error": first_error(
            F.when(unlisted.isNotNull(),
                   error(fv.READ_ONLY_FIELD, unlisted, fill("read_only", unlisted))),
            F.when(F.size("body") == 0, error(fv.INVALID_FIELD, None, fv.TEXT["empty_patch"])),
            F.when(has(_MAIL), _mail_error(text(_MAIL))),
            F.when(has(_POSTAL), invalid(~is_postal_code(text(_POSTAL)), _POSTAL, "postal")),
            *[invalid(has(c) & F.col(f"day_{c}").isNull(), c, "date")
              for c in (_USE_START, _USE_END, _START, _END)],
        ),
        "length_error": first_error(_too_long(text(_COMPANY), _COMPANY), _too_long(text(_NAME), _NAME)),
        "spelling_error": first_error(*[
            invalid(has(c) & F.col(f"flag_{c}").isNull(), c, "boolean") for c in fv.GAS_PERIMETERS
        ]),
    }


def add_facts(commands: DataFrame) -> DataFrame:
    """What the body alone decides: fields it writes (``has``), their normal form, the body's own errors."""
    body, creating, patching = F.col("body"), F.col("op") == "create", F.col("op") == "patch"
    raw = commands.withColumns({f"raw_{c}": body[c] for c in fv.GAS_CREATE_FIELDS})
    texts = raw.withColumns({
        **{f"text_{c}": F.nullif(strip_flat(F.col(f"raw_{c}")), F.lit("")) for c in fv.GAS_CREATE_FIELDS},
        **{f"has_{c}": F.when(patching, F.map_contains_key(body, c)).otherwise(creating)
           for c in fv.GAS_PATCH_FIELDS},
        "not_creatable": first_unlisted(body, fv.GAS_CREATE_FIELDS),
        "not_patchable": first_unlisted(body, fv.GAS_PATCH_FIELDS),
    })
    texts = texts.withColumns({
        "op": apart(F.col("op")),
        **{f"day_{c}": parse_day(F.col(f"text_{c}")) for c in _DAYS},
        **{f"flag_{c}": parse_bool(F.col(f"text_{c}"), "input", stripped=True)
           for c in fv.GAS_PERIMETERS},
    })
    return texts.withColumns({
        "op": apart(F.col("op")),
        "create_error": F.when(creating, _create_error()),
        **{name: F.when(patching, rules) for name, rules in _patch_errors().items()},
        **{f"value_{c}": F.col(f"text_{c}") for c in _TEXTS},
        "value_partner": F.lower("text_partner"),
        **{f"value_{c}": iso_day(F.col(f"day_{c}")) for c in _DAYS},
        **{f"value_{c}": F.coalesce(F.col(f"flag_{c}"), F.when(creating, F.lit(default)))
           for c, default in zip(fv.GAS_PERIMETERS, fv.GAS_PERIMETER_DEFAULTS)},
    })


def _merged(f: Column, state: Column, c: str) -> Column:
    return F.when(f["has"][c], f["value"][c]).otherwise(state[c])


def patch_error(f: Column, state: Column) -> Column:
    """First broken patch rule; cross checks look at the stored row with the patch applied."""
    has = f["has"]
    day = lambda c: F.when(has[c], f["value"][c].try_cast("date")).otherwise(
        parse_day(state[c]))
    start, end = day(_START), day(_END)
    touched = lambda *cs: any_true(*[has[c] for c in cs])
    return F.coalesce(
        f["guard_error"],
        invalid(touched(_START, _END) & (end <= start), _END, "order", **_NO_ORDER),
        _holder_error(touched(_COMPANY, _NAME) & ~any_true(
            is_filled(_merged(f, state, _COMPANY)), is_filled(_merged(f, state, _NAME)))),
        f["length_error"],
        f["spelling_error"],
        invalid(touched(*fv.GAS_PERIMETERS) & ~any_true(
            *[_merged(f, state, c) for c in fv.GAS_PERIMETERS]), None, "perimeter"),
    )


def verdict(f: Column, state: Column, bad_patch: Column, status: Column | None = None) -> Column:
    """Outcome of one command against one stored state."""
    op, status = f["op"], clean(state[STATUS]) if status is None else status
    t, codes = TEXTS, CODES
    wrong = lambda text: outcome(409, fv.WRONG_STATE, None, t[text], status)
    return (
        F.when(op == "create",
               F.when(f["create_error"].isNotNull(), rejected(f["create_error"]))
               .when(state["exists"], outcome(409, codes["exists"], None, t["exists"],
                                              F.coalesce(status, F.lit(fv.NEW_STATE))))
               .otherwise(outcome(201, None, None, t["created"], fv.NEW_STATE)))
        .when(~state["exists"], outcome(404, codes["missing"], None, t["missing"]))
        .when(op == "patch",
              F.when(bad_patch.isNotNull(), rejected(bad_patch))
              .otherwise(outcome(200, None, None, None, fv.NEW_STATE)))
        .when(op == "retry",
              F.when(~one_of(status, fv.GAS_RETRYABLE), wrong("not_retryable"))
              .otherwise(outcome(200, None, None, t["retried"], fv.NEW_STATE)))
        .when(op == "revoke",
              F.when(one_of(status, fv.GAS_ALREADY_REVOKED),
                     outcome(404, codes["revoked"], None, t["already_revoked"]))
              .when(~one_of(status, fv.GAS_REVOCABLE), wrong("not_revocable"))
              .otherwise(outcome(200, None, None, t["revoked"], fv.GAS_REVOKED)))
        .otherwise(outcome(400, fv.INVALID_FIELD, "op", None))
    )


def next_state(f: Column, state: Column, result: Column, now: datetime) -> Column:
    """The stored state after the command (unchanged when it was refused)."""
    op = f["op"]
    creating = op == "create"
    requeued = op.isin("patch", "retry")
    stamp = F.lit(iso_stamp(now))
    changed = {
        **{c: F.when(f["has"][c], f["value"][c]).otherwise(state[c])
           for c in fv.GAS_PATCH_FIELDS},
        **{c: F.when(creating, f["value"][c]).otherwise(state[c])
           for c in ("partner", "platform_code")},
        "role_tiers": F.when(creating, fv.GAS_ROLE).otherwise(state["role_tiers"]),
        STATUS: F.when(op == "revoke", fv.GAS_REVOKED).otherwise(F.lit(fv.NEW_STATE)),
        "date_creation": F.when(creating, stamp).otherwise(state["date_creation"]),
        "derniere_maj": stamp,
        "nb_tentatives_declare": F.when(requeued, 0).otherwise(state["nb_tentatives_declare"]),
        "message_erreur_declare": F.when(~requeued, state["message_erreur_declare"]),
    }
    return F.when(
        result["http_status"].isin(200, 201),
        F.struct(F.lit(True).alias("exists"), *[changed[c].alias(c) for c in STATE_COLUMNS]),
    ).otherwise(state)

