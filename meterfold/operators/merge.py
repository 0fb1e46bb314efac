"""Merges as DataFrame algebra: partial upsert, full-row merge, insert-if-absent, update, delete.

Joins are on keys that are unique on both sides (after deduplication), so no key can skew them.
The incoming side of an upsert or a merge is where Spark may broadcast it after its own size check:
with a small input the target is scanned in place and not shuffled. ``outer_merge`` is for incoming
rows that are costly to compute: it reads each side once in a full outer join. ``stacked_merge`` does the
same for a table that is written by bucket.
"""

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterfold.functions.dates import iso_stamp
from meterfold.operators.dedup import keep_first, last_arrived, latest_right_order

UPDATED_AT = "derniere_maj"
GIVEN = "_given"


def _equal(keys: list[str], null_safe: bool) -> Column:
    pairs = [(F.col(f"t.{k}"), F.col(f"s.{k}")) for k in keys]
    same = [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs]
    return reduce(lambda x, y: x & y, same)


def _has_id(key: str) -> Column:
    return F.coalesce(F.col(key), F.lit("")) != ""


def packed_fields(
    records: DataFrame, key: str, arrival: str | None = None, fields_set: str = "fields_set",
) -> DataFrame:
    """``fields_set`` as one flag character per field, in column order: a few bytes to sort and shuffle."""
    if fields_set not in records.columns:
        return records
    names = [c for c in records.columns if c not in (key, arrival, fields_set)]
    flags = [F.when(F.array_contains(fields_set, c), "1").otherwise("0") for c in names]
    return records.select(*[c for c in records.columns if c != fields_set], F.concat(*flags).alias(GIVEN))


def partial_upsert(
    target: DataFrame,
    records: DataFrame,
    now: datetime,
    key: str = "id_pce",
    arrival: str | None = "input_ord",
    fields_set: str = "fields_set",
    unit: list[Column] | None = None,
) -> DataFrame:
    """Overwrite only the fields each record carries; insert records with new ids.

    ``fields_set`` names the fields present in a record (a present null overwrites with null);
    without that column every field of the record is present. ``arrival`` orders repeated ids;
    pass ``None`` when ids are already unique. Records without an id are left out. With ``unit``
    the target is read once and stays placed by these columns (see ``stacked_merge``), for targets that are
    narrowed to what the records touch.
    """
    # The plain null test spells out what the joins below would each infer: one shuffle serves both.
    records = packed_fields(records.where(F.col(key).isNotNull() & _has_id(key)), key, arrival, fields_set)
    if arrival is not None:
        records = keep_first(records, [F.col(key)], latest_right_order(arrival)).drop(arrival)
    fields = [c for c in records.columns if c not in (key, GIVEN)]
    records = records.withColumn(UPDATED_AT, F.lit(iso_stamp(now)))

    def given(c: str) -> Column:
        if c == UPDATED_AT or GIVEN not in records.columns:
            return F.col("s._in")
        return F.col("s._in") & (F.substring(F.col(f"s.{GIVEN}"), fields.index(c) + 1, 1) == "1")

    overwrite = {c: given(c) for c in records.columns if c not in (key, GIVEN)}
    if unit is not None:
        return stacked_merge(target, records, key, overwrite, unit)
    t, s = target.alias("t"), records.withColumn("_in", F.lit(True)).alias("s")
    same = F.col(f"t.{key}") == F.col(f"s.{key}")
    stored = t.join(s, same, "left").select(
        F.col(f"t.{key}").alias(key), *_merged_columns(target, key, overwrite))
    # The rows of new ids: an id column of the target is all that is read again.
    new = s.join(target.select(key).alias("t"), same, "left_anti").select(
        F.col(f"s.{key}").alias(key),
        *[F.when(overwrite[c], F.col(f"s.{c}")).alias(c) if c in overwrite
          else F.lit(None).cast(target.schema[c].dataType).alias(c)
          for c in stored.columns if c != key])
    return stored.unionByName(new)


def _merged_columns(target: DataFrame, key: str, overwrite: dict) -> list[Column]:
    """The columns but the key: the source's where its condition holds, else the target's."""
    stored = lambda c: F.col(f"t.{c}") if c in target.columns else F.lit(None)
    kept = [F.col(f"t.{c}") for c in target.columns if c != key and c not in overwrite]
    return kept + [
        F.when(condition, F.col(f"s.{c}")).otherwise(stored(c)).alias(c)
        for c, condition in overwrite.items()
    ]


def outer_merge(target: DataFrame, source: DataFrame, key: str, overwrite: dict) -> DataFrame:
    """Rows of both sides by key; a column is the source's where its condition holds.

    ``overwrite`` maps source column -> condition over ``s`` (``s._in`` marks a source row).
    """
    t, s = target.alias("t"), source.withColumn("_in", F.lit(True)).alias("s")
    return t.join(s, F.col(f"t.{key}") == F.col(f"s.{key}"), "full_outer").select(
        F.coalesce(f"t.{key}", f"s.{key}").alias(key), *_merged_columns(target, key, overwrite))


def stacked_merge(target: DataFrame, source: DataFrame, key: str, overwrite: dict, unit: list[Column]) -> DataFrame:
    """``outer_merge`` as one shuffle of both sides by ``unit``, columns that follow from the key.

    The rows stay where the merge put them, so that a writer by these units shuffles nothing again. Rows of
    both sides meet in a window on the key: the source has few rows for each, as a rule one.
    """
    places = [u.alias(f"_unit{i}") for i, u in enumerate(unit)]
    names = [f"_unit{i}" for i in range(len(unit))]
    t = target.select(F.col(key), *places, F.struct(*target.columns).alias("t"))
    s = source.select(F.col(key), *places, F.struct(*source.columns, F.lit(True).alias("_in")).alias("s"))
    t = t.withColumn("s", F.lit(None).cast(s.schema["s"].dataType))
    s = s.withColumn("t", F.lit(None).cast(t.schema["t"].dataType))
    # Null keys meet nothing on the other side.
    same = Window.partitionBy(*names, key, F.col(key).isNull() & F.col("t").isNull())
    rows = t.unionByName(s).repartition(*names).select(
        key, "t", "s", F.collect_list("s").over(same).alias("_all"), F.count("t").over(same).alias("_n"))
    met = rows.where(F.col("t").isNotNull() | (F.col("_n") == 0)).select(
        key, "t", F.explode_outer(F.when(F.col("t").isNotNull(), F.col("_all")).otherwise(F.array("s"))).alias("s"))
    return met.select(key, *_merged_columns(target, key, overwrite))


def upsert_stats(target: DataFrame, records: DataFrame, key: str = "id_pce") -> DataFrame:
    """One row: created, updated, errors (no id), deduped (repeats of an id)."""
    per_id = records.groupBy(F.nullif(F.col(key), F.lit("")).alias(key)).agg(
        F.count(F.lit(1)).alias("n")
    )
    known = target.select(key, F.lit(True).alias("known"))
    has_id = F.col(key).isNotNull()
    count = lambda cond: F.count_if(cond)
    return per_id.join(known, key, "left").agg(
        count(has_id & F.col("known").isNull()).alias("created"),
        count(has_id & F.col("known")).alias("updated"),
        F.coalesce(F.sum(F.when(~has_id, F.col("n"))), F.lit(0)).alias("errors"),
        F.coalesce(F.sum(F.when(has_id, F.col("n") - 1)), F.lit(0)).alias("deduped"),
    )


def upsert_one(target: DataFrame, id_value: str, fields: dict, now: datetime,
               key: str = "id_pce") -> DataFrame:
    """Partial upsert of a single record given as literals."""
    spark = target.sparkSession
    known = {c: target.schema[c].dataType for c in target.columns}
    # The id is a row of a table: a literal would turn the join into a nested loop.
    row = spark.createDataFrame([(id_value,)], f"{key} string").select(
        key,
        *[F.lit(v).cast(known[c]).alias(c) if c in known else F.lit(v).alias(c)
          for c, v in fields.items()],
    )
    return partial_upsert(target, row, now, key, arrival=None)


def merge_rows(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    arrival: str | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """Replace matching rows whole and insert the others; the last arrival of a key wins."""
    if arrival is not None:
        source = last_arrived(source, keys, arrival, null_safe)
    source = source.select(*target.columns)
    kept = target.alias("t").join(source.alias("s"), _equal(keys, null_safe), "left_anti")
    return kept.unionByName(source)


def merge_stats(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    arrival: str | None = None,
    null_safe: bool = False,
) -> DataFrame:
    """One row: inserted, updated."""
    if arrival is not None:
        source = last_arrived(source, keys, arrival, null_safe)
    known = target.select(*keys, F.lit(True).alias("known")).alias("t")
    joined = source.select(*keys).alias("s").join(known, _equal(keys, null_safe), "left")
    return joined.agg(
        F.count_if(F.col("known").isNull()).alias("inserted"),
        F.count_if(F.col("known")).alias("updated"),
    )


def insert_errors(rows: DataFrame, key: str) -> DataFrame:
    """Rows that can neither be inserted nor conflict, because they have no id."""
    return rows.where(~_has_id(key))


def insert_if_absent(
    target: DataFrame, rows: DataFrame, key: str, seq: str, status: str
) -> tuple[DataFrame, DataFrame]:
    """(target with the new rows, conflicts with the status that stood in the way).

    The first row of an id wins inside the batch; later ones conflict with it. Rows without an id are
    in neither; ``insert_errors`` returns them. The rows meet one row per id, reduced per task first:
    the busy side is the one that adaptive execution may split.
    """
    rows = rows.where(_has_id(key))
    stored = target.select(key, F.struct(F.col(status).alias("v")).alias("_existing"))
    per_id = rows.groupBy(key).agg(
        F.min(F.struct(F.col(seq).alias("seq"), F.col(status).alias("v"))).alias("_first"))
    judged = rows.join(per_id, key).join(stored, key, "left")
    wins = F.col("_existing").isNull() & (F.col(seq) == F.col("_first.seq"))
    conflicts = judged.where(~wins).withColumn(
        "existing_status",
        F.when(F.col("_existing").isNull(), F.col("_first.v")).otherwise(F.col("_existing.v")))
    new = judged.where(wins).drop(seq, "_first", "_existing")
    return target.unionByName(new, allowMissingColumns=True), conflicts.drop("_first", "_existing")


def _column(value) -> Column:
    return F.expr(value) if isinstance(value, str) else value


def update_where(df: DataFrame, predicate, updates: dict) -> DataFrame:
    """SET column = expression on rows that satisfy the predicate (SQL text or Column)."""
    hit = _column(predicate)
    return df.withColumns({
        c: F.when(hit, _column(v)).otherwise(F.col(c)) for c, v in updates.items()
    })


def delete_where(df: DataFrame, predicate) -> DataFrame:
    """Drop rows that satisfy the predicate; an unknown predicate keeps the row."""
    return df.where(~F.coalesce(_column(predicate), F.lit(False)))


def delete_keys(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return df.join(keys.select(key), key, "left_anti")
