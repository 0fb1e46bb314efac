"""Recent-duplicate lookup of history requests, and their spacing.

Only the latest stored request of a (meter, code) can decide whether a recent one exists, so
the history is reduced to one row per pair (combined per task first) before the join: no pairs
of a busy meter's requests are ever formed.
"""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterfold.fixed_values import RECENT_DAYS
from meterfold.functions.dates import stamp_literal
from meterfold.session import ensure_checkpoint_dir

PAIR = ["id_pdl", "code_prestation"]


def latest_requests(history: DataFrame, since: Column) -> DataFrame:
    """Latest request per (meter, code) made at or after ``since``."""
    return history.where(F.col("datetime_requete") >= since).groupBy(*PAIR).agg(
        F.max(F.struct("datetime_requete", "id_affaire")).alias("last")
    ).select(*PAIR, "last.*")


def recent_requests(
    asked: DataFrame, history: DataFrame, now: datetime, days: int = RECENT_DAYS
) -> DataFrame:
    """Each asked (meter, code) with the recent request that already covers it, else nulls."""
    latest = latest_requests(history, stamp_literal(now - timedelta(days=days)))
    return asked.join(latest, PAIR, "left")


def not_recent(
    asked: DataFrame, history: DataFrame, now: datetime, days: int = RECENT_DAYS
) -> DataFrame:
    """The asked pairs that have no recent request."""
    latest = latest_requests(history, stamp_literal(now - timedelta(days=days)))
    return asked.join(latest.select(*PAIR), PAIR, "left_anti")


def _blocked_before(asked: DataFrame, accepted: DataFrame, days: int) -> DataFrame:
    """The asked requests without those that an accepted one of the ``days`` days before them blocks."""
    columns = [*PAIR, "datetime_requete", "id_affaire"]
    both = asked.select(*columns, F.lit(True).alias("_asked")).unionByName(
        accepted.join(asked.select(*PAIR).distinct(), PAIR, "left_semi").select(
            *columns, F.lit(False).alias("_asked")))
    # At equal times the accepted one comes first (false sorts before true). The running maximum is taken
    # inside each sort task, and each task hands on one maximum per pair, so no window holds a whole pair.
    order = ["datetime_requete", "_asked"]
    rows = both.repartitionByRange(*PAIR, *order).withColumn("_part", F.spark_partition_id()).withColumn(
        "_at", F.when(~F.col("_asked"), F.col("datetime_requete"))).checkpoint()
    near = Window.partitionBy(*PAIR, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    far = Window.partitionBy(*PAIR).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*PAIR, "_part").agg(F.max("_at").alias("_end")).select(
        *PAIR, "_part", F.max("_end").over(far).alias("_far"))
    last = F.greatest("_near", "_far")
    free = last.isNull() | (F.col("datetime_requete") > last + F.expr(f"INTERVAL {days} DAYS"))
    # A left join: a request without a meter or code meets no accepted one and is free.
    return rows.withColumn("_near", F.max("_at").over(near)).where("_asked").join(
        ends, [*PAIR, "_part"], "left").where(free).select(*columns)


def _numbered(free: DataFrame) -> DataFrame:
    """The requests that can be accepted, as nodes numbered in order of (pair, time).

    Of requests of one pair at one time only the first can be accepted, so a node is a pair and a time.
    """
    nodes = free.groupBy(*PAIR, "datetime_requete").agg(F.min("id_affaire").alias("id_affaire"))
    order = [*PAIR, "datetime_requete"]
    return nodes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "node", F.monotonically_increasing_id()).checkpoint()


def _following(nodes: DataFrame, days: int) -> DataFrame:
    """(node, next): the first node of the same pair more than ``days`` days later.

    Nodes and the ends of their blocked times are range-sorted together; the next node is sought in
    the same sort task, then among the tasks after it, so no window holds a whole pair.
    """
    until = F.col("datetime_requete") + F.expr(f"INTERVAL {days} DAYS")
    both = nodes.select(*PAIR, F.col("datetime_requete").alias("at"), F.lit(False).alias("is_end"), "node").unionByName(
        nodes.select(*PAIR, until.alias("at"), F.lit(True).alias("is_end"), "node"))
    # At equal times the node comes first, so that an end does not find it.
    rows = both.repartitionByRange(*PAIR, "at", "is_end").withColumn("part", F.spark_partition_id()).checkpoint()
    begun = F.when(~F.col("is_end"), F.col("node"))
    near = Window.partitionBy(*PAIR, "part").orderBy("at", "is_end").rowsBetween(1, Window.unboundedFollowing)
    far = Window.partitionBy(*PAIR).orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    firsts = rows.groupBy(*PAIR, "part").agg(F.min(begun).alias("first")).select(
        *PAIR, "part", F.min("first").over(far).alias("later")).alias("f")
    found = rows.select("*", F.min(begun).over(near).alias("sooner")).where("is_end").alias("r")
    same = (F.col("r.part") == F.col("f.part"))
    for c in PAIR:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}"))
    return found.join(firsts, same).select("node", F.coalesce("sooner", "later").alias("next")).where("next IS NOT NULL")


def accept_spaced(asked: DataFrame, accepted: DataFrame, days: int = RECENT_DAYS) -> DataFrame:
    """Requests accepted when each accepted one blocks its pair for the ``days`` days after it.

    ``asked``: id_pdl, code_prestation, datetime_requete, id_affaire; ``accepted`` has the same
    columns and holds what was accepted before. A request is refused if one was accepted in the
    ``days`` days before it (bounds included); one that arrives late is judged by its own time, so an
    accepted request after it does not block it.

    The accepted requests of a pair are a chain: its first free request, then always the first one past
    the horizon. Every request points to its successor; pointer doubling marks the chains of all
    pairs at once: when the first 2**k links are marked and pointers span 2**k links, one join marks as many
    again and one join doubles the pointers. Rounds are the logarithm of the longest chain.
    """
    ensure_checkpoint_dir(asked.sparkSession)
    nodes = _numbered(_blocked_before(asked, accepted, days))
    jumps = _following(nodes, days).checkpoint()
    marked = nodes.groupBy(*PAIR).agg(F.min("node").alias("node")).select("node").checkpoint()
    while True:
        reached = marked.join(jumps, "node").select(F.col("next").alias("node")).checkpoint()
        if reached.isEmpty():
            break
        marked = marked.unionByName(reached)
        over = jumps.select(F.col("node").alias("next"), F.col("next").alias("over"))
        jumps = jumps.join(over, "next").select("node", F.col("over").alias("next")).checkpoint()
    return nodes.join(marked, "node").select(*PAIR, "datetime_requete", "id_affaire")
