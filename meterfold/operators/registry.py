"""Registry reads and bookkeeping: filters, views, pages, status updates, collection stamps."""

from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window, functions as F
from pyspark.sql import types as T

from meterfold import fixed_values as fv
from meterfold.functions.booleans import parse_bool
from meterfold.functions.dates import iso_stamp, show_stamp, show_typed_stamp, stamp_literal
from meterfold.functions.payload import build_error, payload
from meterfold.functions.text import bounded_int, clean, strip, truncate, whole_number
from meterfold.operators.merge import partial_upsert, update_where
from meterfold.operators.outcomes import error, first_error, invalid
from meterfold.session import ensure_checkpoint_dir

TOP_ROWS = 10_000  # rows a page may bring together as a top-k

# --- filters -------------------------------------------------------------------------------

def filter_by(df: DataFrame, column: str, operator: str, value) -> DataFrame:
    """One comparison; the value takes the column's type so the filter reaches the files."""
    stored, typed = F.col(column), F.lit(value).cast(df.schema[column].dataType)
    comparisons = {
        "=": stored == typed,
        "!=": ~stored.eqNullSafe(typed),  # a null differs from any value
        "<": stored < typed,
        "<=": stored <= typed,
        ">": stored > typed,
        ">=": stored >= typed,
    }
    if operator not in comparisons:
        raise ValueError(fv.TEXT["operator_choice"].format(operator=operator, choices=fv.OPERATORS))
    return df.where(comparisons[operator])


def select_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose id is requested."""
    return df.join(ids.select(key).distinct(), key, "left_semi")


def with_existence(ids: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Each requested id with a boolean ``known``."""
    # The registry is narrowed to the asked ids before anything of it is made distinct.
    known = df.select(key).join(ids.select(key), key, "left_semi").distinct().withColumn("known", F.lit(True))
    return ids.join(known, key, "left").withColumn("known", F.coalesce("known", F.lit(False)))


def in_state(df: DataFrame, state: str, status: str = "etat_droit_acces") -> DataFrame:
    return df.where(F.col(status) == state)


def active_without(df: DataFrame, field: str) -> DataFrame:
    """Active rights that lack a value in ``field``; all of them while the column does not exist."""
    active = in_state(df, fv.GAS_ACTIVE)
    if field not in df.columns:
        return active
    value = F.col(field).cast("string")
    return active.where(value.isNull() | (strip(value) == ""))


def collected(df: DataFrame) -> DataFrame:
    """Electricity meters whose measurements are collected (revoked ones still are)."""
    return df.where(~F.col("statut").isin(*fv.ELEC_NOT_COLLECTED))


def count_by_status(df: DataFrame, status: str = "statut") -> DataFrame:
    return df.groupBy(F.coalesce(F.col(status), F.lit("None")).alias(status)).agg(
        F.count(F.lit(1)).alias("n")
    )


# --- views ---------------------------------------------------------------------------------

def _shown_bool(df: DataFrame, c: str) -> Column:
    if isinstance(df.schema[c].dataType, T.BooleanType):
        return F.col(c)
    return parse_bool(F.col(c), "view")


def gas_view(df: DataFrame, light: bool = False) -> DataFrame:
    """The 13 exposed fields of a gas right; the light form leaves out two dates."""
    shown = {
        "id_pce": clean(F.col("id_pce")),
        "partner": clean(F.col("partner")),
        "platform_code": clean(F.col("platform_code")),
        "statut": F.coalesce(clean(F.col("etat_droit_acces")), F.lit(fv.NEW_STATE)),
        **{c: _shown_bool(df, c) for c in fv.GAS_PERIMETERS},
        "date_debut_droit_acces": clean(F.col("date_debut_droit_acces")),
        "date_fin_droit_acces": clean(F.col("date_fin_droit_acces")),
        "date_creation": show_stamp(F.col("date_creation")),
        "derniere_maj": show_stamp(F.col("derniere_maj")),
        "message_erreur": payload(F.col("message_erreur_declare")),
    }
    if light:
        del shown["date_debut_droit_acces"], shown["date_creation"]
    return df.select(*[c.alias(name) for name, c in shown.items()])


def elec_view(df: DataFrame) -> DataFrame:
    """The 9 exposed fields of an electricity consent."""
    return df.select(
        *[clean(F.col(c)).alias(c) for c in ("id_pdl", "partner", "platform_code", "statut")],
        *[_shown_bool(df, c).alias(c) for c in ("statut_cdc", "statut_dm")],
        payload(F.col("erreur")).alias("message_erreur"),
        *[show_typed_stamp(F.col(c)).alias(c) for c in ("date_creation", "date_modification")],
    )


def dump_view(df: DataFrame) -> DataFrame:
    return df.select("id_pce", "etat_droit_acces", "role_tiers", "raison_sociale_du_titulaire",
                     "derniere_maj")


# --- pages ---------------------------------------------------------------------------------

class InvalidParameter(ValueError):
    """A refused listing parameter; carries the outcome fields."""

    def __init__(self, erreur: str, champ: str, message: str):
        super().__init__(message)
        self.erreur, self.champ, self.message = erreur, champ, message


def check_listings(requests: DataFrame, states=fv.GAS_STATES) -> DataFrame:
    """Listing requests (req_id, statut, limit, offset as text) with typed parameters and ``err``.

    ``err`` is the first broken rule, null when fine; blank parameters take their defaults.
    """
    texts = requests.select("req_id", *[clean(F.col(c)).alias(c) for c in ("statut", "limit", "offset")])
    statut = F.col("statut")
    rules = [F.when(~statut.isin(*states), error(
        fv.INVALID_FIELD, "statut", fv.TEXT["status_choice"].format(choices=", ".join(states))))]
    numbers = {}
    for c, (low, high, default, bound) in {
        "limit": (1, fv.PAGE_LIMIT_MAX, fv.PAGE_LIMIT_DEFAULT, f"entre 1 et {fv.PAGE_LIMIT_MAX}"),
        "offset": (0, None, 0, "≥ 0"),
    }.items():
        given = F.col(c)
        rules += [invalid(given.isNotNull() & whole_number(given).isNull(), c, "int_between", bound=bound),
                  invalid(given.isNotNull() & bounded_int(given, low, high).isNull(), c, "int_bound", bound=bound)]
        numbers[c] = F.when(given.isNull(), F.lit(default)).otherwise(bounded_int(given, low, high)).cast("bigint")
    return texts.select("req_id", "statut", *[v.alias(c) for c, v in numbers.items()], first_error(*rules).alias("err"))


def page_request(spark: SparkSession, statut=None, limit=None, offset=None, states=fv.GAS_STATES) -> Row:
    """The checked parameters of one request: statut, limit, offset."""
    asked = spark.createDataFrame([(0, statut, limit, offset)], "req_id int, statut string, limit string, offset string")
    checked = check_listings(asked, states).head()
    if checked.err is not None:
        raise InvalidParameter(**checked.err.asDict())
    return checked


def gas_listing(df: DataFrame, statut: str | None) -> DataFrame:
    """Rows of the gas list; the stored state is compared trimmed."""
    return df if statut is None else df.where(clean(F.col("etat_droit_acces")) == statut)


def elec_listing(df: DataFrame, statut: str | None) -> DataFrame:
    return df if statut is None else df.where(F.col("statut") == statut)


def page(df: DataFrame, place: Column, request: Row) -> DataFrame:
    """Offset/limit slice of a listing in the order of ``place``.

    A shallow page is a top-k, which brings offset + limit rows of every task together; a deeper one
    is located by counts, with the same rows.
    """
    if request.offset + request.limit > TOP_ROWS:
        return deep_page(df, place, request)
    return df.orderBy(place).offset(request.offset).limit(request.limit)


def deep_page(df: DataFrame, place: Column, request: Row) -> DataFrame:
    """The slice found by order statistics: nothing ahead of the page reaches the driver or one task.

    The places are counted and sorted into ranges once. Rows per range tell which ranges the page
    lies in, only their places are ranked, and whole rows are read for the places on the page alone.
    Rows of one place have no order among themselves.
    """
    first, end = request.offset, request.offset + request.limit
    ensure_checkpoint_dir(df.sparkSession)
    # Sort ranges differ from one run to the next, so they are kept before they are counted.
    places = df.groupBy(place.alias("_at")).agg(F.count(F.lit(1)).alias("n")).repartitionByRange(
        "_at").withColumn("part", F.spark_partition_id()).checkpoint()
    ahead = (Window.unboundedPreceding, -1)
    parts = places.groupBy("part").agg(F.sum("n").alias("held")).withColumn(
        "before", F.coalesce(F.sum("held").over(Window.orderBy("part").rowsBetween(*ahead)), F.lit(0)))
    parts = parts.where((F.col("before") < end) & (F.col("before") + F.col("held") > first)).drop("held")
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("_at").rowsBetween(*ahead))
    ranked = places.join(parts, "part").withColumn("less", F.col("before") + F.coalesce(inside, F.lit(0)))
    shown = ranked.where((F.col("less") < end) & (F.col("less") + F.col("n") > first)).select("_at", "less")
    rows = df.withColumn("_at", place).join(shown, "_at")
    rank = F.row_number().over(Window.partitionBy("_at").orderBy("_at"))
    rows = rows.withColumn("_rank", F.col("less") + rank - 1).where(F.col("_rank").between(first, end - 1))
    return rows.orderBy("_rank").select(*df.columns)


def page_after(df: DataFrame, key: str, last: str | None, limit: int) -> DataFrame:
    """Keyset page: the cost does not grow with the depth and the bound reaches the files."""
    rest = df if last is None else df.where(F.col(key) > last)
    return rest.orderBy(key).limit(limit)


def with_total(page_rows: DataFrame, listing: DataFrame) -> DataFrame:
    """Page rows with the row count of the whole listing."""
    total = listing.agg(F.count(F.lit(1)))
    return page_rows.withColumn("total", total.scalar())


def gas_place() -> Column:
    return F.coalesce("id_pce", F.lit(""))


def elec_place() -> Column:
    """Rows without an id come last."""
    return F.struct(F.col("id_pdl").isNull().alias("none"), F.coalesce("id_pdl", F.lit("")).alias("id"))


def gas_page(df: DataFrame, request: Row) -> DataFrame:
    """The asked page of the gas list, with the row count of the whole list."""
    listing = gas_listing(df, request.statut)
    return with_total(gas_view(page(listing, gas_place(), request), light=True), listing)


def elec_page(df: DataFrame, request: Row) -> DataFrame:
    listing = elec_listing(df, request.statut)
    return with_total(elec_view(page(listing, elec_place(), request)), listing)


# --- bookkeeping by the collecting jobs -----------------------------------------------------

def mark_collected(registry: DataFrame, calls: DataFrame, now: datetime) -> DataFrame:
    """Stamp collected meters; ``calls``: id_pce, collection_type, status_code (any number per id).

    Per meter and type one stamp is set; the response code is that of the meter's last call
    (``call_ord``). Unknown types are refused before any work.
    """
    known = list(fv.COLLECTION_STAMPS)
    wrong = calls.where(~F.coalesce(F.col("collection_type").isin(*known), F.lit(False)))
    example = wrong.select("collection_type").head(1)
    if example:
        raise ValueError(f"collection_type invalide : {example[0][0]}. Valeurs attendues : {known}")
    done = {
        column: F.max(F.col("collection_type") == kind)
        for kind, column in fv.COLLECTION_STAMPS.items()
    }
    per_id = calls.groupBy("id_pce").agg(
        *[flag.alias(column) for column, flag in done.items()],
        F.max_by("status_code", "call_ord").cast("int").alias("api_response_code"),
    )
    present = F.array_compact(F.array(
        F.lit("api_response_code"), *[F.when(F.col(c), F.lit(c)) for c in done]
    ))
    records = per_id.withColumn("fields_set", present).withColumns(
        {c: F.when(F.col(c), F.lit(iso_stamp(now))) for c in done}
    )
    return partial_upsert(registry, records, now, arrival=None)


def mark_onboarded(registry: DataFrame, calls: DataFrame, now: datetime) -> DataFrame:
    """Stamp meters whose history was fetched; ``calls``: id_pce, status_code, call_ord."""
    records = calls.groupBy("id_pce").agg(
        F.lit(iso_stamp(now)).alias("date_onboard_history"),
        F.max_by("status_code", "call_ord").cast("int").alias("api_response_onboard_history"),
    )
    return partial_upsert(registry, records, now, arrival=None)


def update_status(pdl: DataFrame, updates: DataFrame, now: datetime) -> DataFrame:
    """Set the status and the non-null optional fields of meters; ``updates`` is unique by id_pdl.

    Columns: id_pdl, statut, and optionally statut_cdc, statut_dm, commentaire, erreur.
    """
    optional = [c for c in ("statut_cdc", "statut_dm", "commentaire", "erreur")
                if c in updates.columns]
    given = {c: F.col(f"s.{c}") for c in optional}
    if "commentaire" in given:
        given["commentaire"] = truncate(given["commentaire"], fv.MAX_LENGTH["commentaire"])
    s = updates.withColumn("_in", F.lit(True)).alias("s")
    joined = pdl.alias("t").join(s, F.col("t.id_pdl") == F.col("s.id_pdl"), "left")
    hit = F.col("s._in")
    new = {
        "statut": F.when(hit, F.col("s.statut")).otherwise(F.col("t.statut")),
        "date_modification": F.when(hit, stamp_literal(now)).otherwise(F.col("t.date_modification")),
        **{c: F.coalesce(F.when(hit, v), F.col(f"t.{c}")) for c, v in given.items()},
    }
    return joined.select(*[new.get(c, F.col(f"t.{c}")).alias(c) for c in pdl.columns])


def set_errors(pdl: DataFrame, errors: DataFrame, now: datetime) -> DataFrame:
    """Store the last error of meters; ``errors`` (id_pdl, code, message) is unique by id_pdl."""
    s = errors.select(
        "id_pdl", build_error(F.col("code"), F.col("message")).alias("json")
    ).alias("s")
    joined = pdl.alias("t").join(s, F.col("t.id_pdl") == F.col("s.id_pdl"), "left")
    hit = F.col("s.json").isNotNull()
    new = {
        "erreur": F.coalesce(F.col("s.json"), F.col("t.erreur")),
        "date_modification": F.when(hit, stamp_literal(now)).otherwise(F.col("t.date_modification")),
    }
    return joined.select(*[new.get(c, F.col(f"t.{c}")).alias(c) for c in pdl.columns])


def clear_errors(pdl: DataFrame, hit: Column, now: datetime) -> DataFrame:
    """Forget the error of the meters that satisfy ``hit``."""
    return update_where(pdl, hit, {
        "erreur": F.lit(None).cast("string"), "date_modification": stamp_literal(now),
    })
