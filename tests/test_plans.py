"""Plans at scale, the registered queries, and a sample of them against SQL."""

import os
import re
from datetime import datetime

import pytest
from conftest import plan_of

import __spark_entry__ as entry
import check_oracle
from meterfold.operators import merge
from meterfold.plans.oracle import ORACLES
from meterfold.plans.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="benchmark tables absent")


def test_every_query_has_a_counterpart():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0


@needs_data
def test_no_cross_joins_and_no_python_in_the_plans(spark):
    eager = {name for name in QUERIES if name.startswith("stream_")} | {"accept_spaced"}
    for name, query in QUERIES.items():
        if name in eager:
            continue
        plan = plan_of(query(spark, SMALL))
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert not re.search("ArrowEvalPython|BatchEvalPython|FlatMapGroupsInPandas", plan), name


@needs_data
def test_scans_read_only_what_they_need(spark):
    plan = plan_of(entry.queries()["row_counts"](spark, SMALL))
    assert re.search(r"ReadSchema: struct<>", plan)
    plan = plan_of(entry.queries()["count_by_status"](spark, SMALL))
    assert "o_totalprice" not in plan and "o_orderpriority" not in plan


@needs_data
def test_a_small_upsert_feed_leaves_the_registry_in_place(spark):
    rows = spark.read.parquet(f"{SMALL}/orders.parquet").selectExpr(
        "CAST(o_orderkey AS STRING) AS id_pce", "o_orderstatus AS etat_droit_acces")
    feed = spark.sql("SELECT * FROM VALUES ('1', 'x'), ('new', 'y') AS v(id_pce, etat_droit_acces)")
    merged = merge.partial_upsert(rows, feed, datetime(2024, 1, 1), arrival=None)
    left = plan_of(merged.where("etat_droit_acces IS NOT NULL"))
    assert "BroadcastHashJoin" in left and "SortMergeJoin" not in left and "FullOuter" not in left


@needs_data
@pytest.mark.parametrize("name", [
    "consumption_outcome", "rights_dedup", "registry_upsert_partial", "insert_conflicts", "dq_report",
    "create_elec", "validate_patch_gas", "command_fold", "accept_spaced", "access_audit"])
def test_counterparts_agree(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in check_oracle.TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    cursor = db.execute(entry.oracle_sql()[name])
    want = check_oracle.canonical(cursor.fetchall(), [c[0] for c in cursor.description])
    assert check_oracle.canonical([tuple(r) for r in df.collect()], df.columns) == want
