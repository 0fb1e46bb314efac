from datetime import datetime

from conftest import plan_of
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterfold.operators import dedup, merge

NOW = datetime(2026, 6, 16, 9, 3, 16)
STAMP = "2026-06-16T09:03:16.000000+00:00"
RECORD = "id_pce string, date_debut_droit_acces string, date_creation string, input_ord int"
few = settings(max_examples=12, deadline=None)

records = st.lists(st.tuples(
    st.sampled_from(["A", "B", "C", "", " ", None]),
    st.sampled_from(["2024-01-01", "2023-05-05", "", None]),
    st.sampled_from(["2024-01-01T00:00:00", "", None])), max_size=12)


def latest(rows):
    """The right to keep per id: largest dates, earliest on a tie; idless rows all stay."""
    best, idless = {}, []
    for i, (key, start, made) in enumerate(rows):
        if not key:
            idless.append((key, start, made, i))
            continue
        rank = (start or "", made or "")
        if key not in best or rank > best[key][0]:
            best[key] = (rank, (key, start, made, i))
    return [row for _, row in best.values()] + idless


@given(records)
@few
def test_latest_rights_equals_the_model(spark, rows):
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], RECORD)
    got = [tuple(r) for r in dedup.latest_rights(df).collect()]
    assert sorted(got, key=repr) == sorted(latest(rows), key=repr)


def test_latest_rights_cuts_keys_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr(
        "CAST(id % 3 AS STRING) AS id_pce", "CAST(id AS STRING) AS date_debut_droit_acces",
        "CAST(id AS STRING) AS date_creation", "id AS input_ord")
    plan = plan_of(dedup.latest_rights(df))
    final, exchange, partial = (
        plan.index(word) for word in ("1, Final", "Exchange hashpartitioning", "1, Partial"))
    assert final < exchange < partial


FEED = "id_pce string, date_debut_droit_acces string, date_creation string, nom string, extra string, " \
       "fields_set array<string>, input_ord int"
TARGET = "id_pce string, nom string, derniere_maj string"
fields = st.sets(st.sampled_from(["date_debut_droit_acces", "date_creation", "nom", "extra"]))


@given(st.lists(st.tuples(records.filter(bool).map(lambda r: r[0]), st.sampled_from(["n", None]), fields),
                min_size=1, max_size=10), st.sets(st.sampled_from(["A", "B", "Z"])))
@few
def test_partial_upsert_equals_the_model(spark, feed, known):
    names = ["date_debut_droit_acces", "date_creation", "nom", "extra"]
    rows = []
    for i, ((key, start, made), nom, present) in enumerate(feed):
        values = dict(zip(names, (start, made, nom, f"e{i}")))
        rows.append((key, *[values[c] if c in present else None for c in names], sorted(present), i))
    target = spark.createDataFrame([(k, "ancien", "avant") for k in sorted(known)], TARGET)
    source = spark.createDataFrame(rows, FEED)

    want = {k: {"nom": "ancien", "derniere_maj": "avant"} for k in known}
    kept = latest([r[:3] for r in rows])
    stats = dict(created=0, updated=0, errors=0, deduped=len(rows) - len(kept))
    for key, _, _, i in kept:
        if not key:
            stats["errors"] += 1
            continue
        stats["updated" if key in want else "created"] += 1
        row = want.setdefault(key, {})
        row |= {c: rows[i][1 + names.index(c)] for c in rows[i][5]}
        row["derniere_maj"] = STAMP

    columns = [*names, "derniere_maj"]
    got = merge.partial_upsert(target, source, NOW)
    assert {r.id_pce: tuple(r[c] for c in columns) for r in got.collect()} == {
        k: tuple(v.get(c) for c in columns) for k, v in want.items()}
    assert got.count() == len(want)
    assert merge.upsert_stats(target, source).head().asDict() == stats


def test_present_null_overwrites_and_absent_keeps(spark):
    target = spark.createDataFrame([("A", "x", "avant")], TARGET)
    row = spark.createDataFrame([("A", None, ["nom"])], "id_pce string, nom string, fields_set array<string>")
    assert merge.partial_upsert(target, row, NOW, arrival=None).head().nom is None
    row = row.withColumn("fields_set", F.array().cast("array<string>"))
    assert merge.partial_upsert(target, row, NOW, arrival=None).head().nom == "x"


def test_upsert_one_and_new_column(spark):
    target = spark.createDataFrame([("A", "x", "avant")], TARGET)
    got = merge.upsert_one(target, "A", {"nom": None, "motif": "m"}, NOW).head()
    assert (got.nom, got.motif, got.derniere_maj) == (None, "m", STAMP)
    assert merge.upsert_one(target, "B", {"nom": "b"}, NOW).count() == 2


def test_merge_rows_null_keys_always_insert(spark):
    schema = "k string, ts int, v string"
    target = spark.createDataFrame([("a", 1, "old"), ("a", None, "old"), ("b", 1, "old")], schema)
    source = spark.createDataFrame(
        [("a", 1, "first", 0), ("a", 1, "last", 1), ("a", None, "n1", 2), ("a", None, "n2", 3)],
        schema + ", ord int")
    got = sorted(tuple(r) for r in merge.merge_rows(target, source, ["k", "ts"], "ord").fillna(-1).collect())
    assert got == [("a", -1, "n1"), ("a", -1, "n2"), ("a", -1, "old"), ("a", 1, "last"), ("b", 1, "old")]
    assert merge.merge_stats(target, source, ["k", "ts"], "ord").head().asDict() == {
        "inserted": 2, "updated": 1}
    safe = merge.merge_rows(target, source, ["k", "ts"], "ord", null_safe=True).fillna(-1)
    assert sorted(tuple(r) for r in safe.collect()) == [("a", -1, "n2"), ("a", 1, "last"), ("b", 1, "old")]


def test_insert_if_absent(spark):
    target = spark.createDataFrame([("A", "Active")], "id string, etat string")
    rows = spark.createDataFrame([(1, "A", "n1"), (2, "B", "n2"), (3, "B", "n3")], "seq int, id string, etat string")
    table, conflicts = merge.insert_if_absent(target, rows, "id", "seq", "etat")
    assert sorted((r.id, r.etat) for r in table.collect()) == [("A", "Active"), ("B", "n2")]
    assert sorted((r.seq, r.existing_status) for r in conflicts.collect()) == [(1, "Active"), (3, "n2")]


def test_insert_accounts_for_rows_without_an_id(spark):
    target = spark.createDataFrame([("A", "Active")], "id string, etat string")
    rows = spark.createDataFrame([(1, "A", "n1"), (2, None, "n2"), (3, "", "n3"), (4, "B", "n4")],
                                 "seq int, id string, etat string")
    table, conflicts = merge.insert_if_absent(target, rows, "id", "seq", "etat")
    errors = merge.insert_errors(rows, "id")
    assert sorted(r.id for r in table.collect()) == ["A", "B"]
    assert [r.seq for r in conflicts.collect()] == [1]
    assert sorted(r.seq for r in errors.collect()) == [2, 3]


def test_update_and_delete(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 3)], "k string, v int")
    changed = merge.update_where(df, "v > 2", {"k": "upper(k)", "v": F.lit(0)})
    assert sorted(map(tuple, changed.collect()), key=repr) == [("C", 0), ("a", 1), ("b", None)]
    assert {r.k for r in merge.delete_where(df, "v = 1").collect()} == {"b", "c"}
    assert {r.k for r in merge.delete_keys(df, df.where("v = 3"), "k").collect()} == {"a", "b"}


def test_small_source_does_not_shuffle_the_target(spark, tmp_path):
    spark.range(10000).selectExpr("CAST(id AS STRING) AS id_pce", "'x' AS nom").write.parquet(
        f"{tmp_path}/target")
    target = spark.read.parquet(f"{tmp_path}/target")
    source = target.where("id_pce < '5'")
    plan = plan_of(merge.merge_rows(target, source, ["id_pce"]))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_both_halves_of_an_upsert_share_the_shuffled_feed(spark):
    target = spark.createDataFrame([(f"P{i}", "ancien", "avant") for i in range(20)], TARGET)
    feed = spark.createDataFrame(
        [(f"P{i % 30}", "2024-01-01", None, "n", None, ["nom"], i) for i in range(60)], FEED)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = merge.partial_upsert(target, feed, NOW)
        assert len(got.collect()) == 30
        plan = plan_of(got).split("Initial Plan")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange" in plan and "fields_set" not in plan.split("Exchange hashpartitioning", 1)[0]


def test_a_stacked_merge_equals_the_outer_join_with_one_shuffle(spark):
    target = spark.createDataFrame(
        [("A", 1, "a"), ("A", 2, "b"), ("B", 3, None), (None, 4, "c"), (None, 5, "d")], "id string, n int, x string")
    source = spark.createDataFrame([("A", "z", 9), ("A", "w", 3), ("B", None, 8), ("C", "y", 7), ("C", "v", 6), (None, "u", 5)], "id string, x string, extra int")
    overwrite = {"x": F.col("s._in"), "extra": F.col("s._in") & (F.col("s.extra") > 7)}
    stacked = merge.stacked_merge(target, source, "id", overwrite, [F.pmod(F.hash("id"), F.lit(4))])
    joined = merge.outer_merge(target, source, "id", overwrite)
    assert stacked.columns == joined.columns
    assert sorted(map(str, stacked.collect())) == sorted(map(str, joined.collect()))
    assert plan_of(stacked).split("Initial Plan")[0].count("Exchange") == 1
