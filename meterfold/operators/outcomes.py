"""Outcome rows shared by both registries: first error wins, then the verdict of the operation."""

from pyspark.sql import Column, functions as F

from meterfold import fixed_values as fv

ERROR_TYPE = "struct<erreur:string,champ:string,message:string>"
OUTCOME_TYPE = "struct<http_status:int,erreur:string,champ:string,message:string,statut:string>"


def sql_text(value) -> str:
    """A Python value as a SQL literal."""
    if value is None:
        return "CAST(NULL AS STRING)"
    if isinstance(value, int):
        return str(value)
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _struct(**fields) -> Column:
    """A struct of constants as one expression, of columns and constants otherwise."""
    if not any(isinstance(v, Column) for v in fields.values()):
        return F.expr("named_struct(" + ", ".join(
            f"'{name}', {sql_text(v)}" for name, v in fields.items()) + ")")
    return F.struct(*[
        (v if isinstance(v, Column) else F.expr(sql_text(v))).alias(name)
        for name, v in fields.items()
    ])


def error(erreur, champ, message) -> Column:
    return _struct(erreur=erreur, champ=champ, message=message)


def invalid(broken: Column, champ: str | None, text: str, **values) -> Column:
    """The error when the rule is broken, else null."""
    message = fv.TEXT[text].format(champ=champ, **values)
    return F.when(broken, error(fv.INVALID_FIELD, champ, message))


def first_error(*rules: Column) -> Column:
    return F.coalesce(*rules, F.lit(None).cast(ERROR_TYPE))


def fill(text: str, champ: Column) -> Column:
    """A message whose field name is only known per row."""
    before, after = fv.TEXT[text].split("{champ}")
    return F.concat(F.lit(before), champ, F.lit(after))


def first_unlisted(body: Column, allowed) -> Column:
    """First key of the request that is not in the list."""
    return F.get(F.filter(F.map_keys(body), lambda k: ~k.isin(*allowed)), 0)


def outcome(status: int, erreur=None, champ=None, message=None, statut=None) -> Column:
    return _struct(http_status=status, erreur=erreur, champ=champ, message=message, statut=statut)


def rejected(err: Column) -> Column:
    return outcome(400, err["erreur"], err["champ"], err["message"])


class Facts:
    """Command facts kept as flat columns, addressed like the struct that the fold collects.

    ``f["has"][x]`` and ``f["value"][x]`` are the columns ``has_x`` and ``value_x``. Flat columns
    are computed once; Catalyst would inline a struct's fields into every use.
    """

    def __init__(self, prefix: str = ""):
        self.prefix = prefix

    def __getitem__(self, name: str):
        if not self.prefix and name in ("has", "value"):
            return Facts(f"{name}_")
        return F.col(self.prefix + name)


def fact_struct(errors: list[str], fields, values) -> Column:
    """The flat fact columns as one struct."""
    return F.struct(
        "op", *errors,
        F.struct(*[F.col(f"has_{c}").alias(c) for c in fields]).alias("has"),
        F.struct(*[F.col(f"value_{c}").alias(c) for c in values]).alias("value"),
    )
