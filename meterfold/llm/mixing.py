"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes per source; targets by raising one common level until nothing is above its cap.
2. The documents of a source fall into blocks by a hash of their id. Whole passes over a source take
   every block; the rest of its target takes blocks in a permuted order, and documents in a permuted
   order inside the block where the target ends. Every (source, pass, block) taken is one draw.
3. The quotas of draws per source are split down a binary tree over the output shards: at each node
   the draws are put in random order and cut at the node's share, which is a multivariate
   hypergeometric split of the node's quota vector.
4. A shard takes the next draws of each source's permuted order, as many as its quota, so shards are
   disjoint; inside a shard documents are ordered by a hash.

The number of blocks over all sources is at most ``MAX_BLOCKS`` plus the number of sources, whatever
the size of the corpus (blocks grow instead), so the windows over blocks and draws hold a bounded
number of rows per source, while documents only meet them in a join on (source, block): a source
with a third of all rows is spread over all its blocks.

Only DataFrame functions. Documents are taken whole. The last pass leaves out documents longer than what it
is to take; where its end falls inside a block, documents that still fit are taken in ``CUTS`` sweeps, and
then single free documents of nearest size, one after another, as long as one brings the source nearer.

Defined cases: a null source is a source of its own, last in order; null or blank texts have size 0 and are
never taken; rows with the same doc_id and text fall into the same block and are rows of their own, but are not
used to fill (they could not be told apart); the seed fixes all choices, so reruns agree.
"""

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from meterfold.llm.common import cut, written

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
MAX_BLOCKS = 8192
SHARDS = 16
CUTS = 3
SEED = 42


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, cap: int = MAX_REPEAT) -> DataFrame:
    """(source, _key, size) to the same with their target.

    Sorted order gives the weights. One level L is raised: a source gets min(cap * size, weight * L),
    and L is the total left divided by the weights left, until no further source is above its cap.
    Each round is one aggregate; a source that reaches its cap stays there, so rounds end.
    """
    # A range sort numbers the sources: position in the task plus the rows of the tasks before.
    placed = cut(sizes.sort(F.col("source").asc_nulls_last()).withColumn(
        "at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    before = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.pmod(F.col("before") + F.col("place"), F.lit(len(weights))) + 1).cast("int"))
    rows = cut(placed.withColumns({"part": part, "place": place}).join(before, "part").select(
        "source", "_key", "size", weight.alias("weight")))
    total = rows.agg(F.sum("size")).head()[0] or 0
    level, full = 0.0, None
    while True:
        capped = F.col("weight") * level >= F.col("size") * cap
        x = rows.agg(
            F.sum(F.when(capped, F.col("size") * cap)).alias("taken"),
            F.sum(F.when(~capped, F.col("weight"))).alias("open"),
            F.count_if(capped).alias("full")).head()
        if x.full == full or not x.open:
            break
        full = x.full
        level = (total - (x.taken or 0)) / x.open
    target = F.least(F.col("size") * F.lit(float(cap)), F.col("weight") * F.lit(float(level)))
    return rows.select("source", "_key", "size", target.alias("target"))


def _hash(seed: int, tag: int, *columns) -> Column:
    return F.xxhash64(F.lit(seed), F.lit(tag), *columns)


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(_key, quota) to (_key, shard, quota): quota vectors split down the tree, level by level."""
    node = quotas.select("_key", F.lit(0).alias("lo"), F.lit(shards).alias("hi"),
                         F.col("quota").cast("long").alias("quota"))
    width, level = shards, 0
    by_node = Window.partitionBy("lo", "hi")
    while width > 1:
        tickets = node.select("_key", "lo", "hi", F.explode(
            F.sequence(F.lit(1).cast("long"), F.col("quota"))).alias("ticket"))
        order = by_node.orderBy(_hash(seed, 100 + level, "lo", "_key", "ticket"), "_key", "ticket")
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        leaf = F.col("hi") - F.col("lo") <= 1
        share = F.floor(F.count(F.lit(1)).over(by_node) * (mid - F.col("lo"))
                        / (F.col("hi") - F.col("lo")))
        sided = tickets.select(
            "_key", "lo", "hi", mid.alias("mid"), leaf.alias("leaf"),
            (leaf | (F.row_number().over(order) <= share)).alias("left"))
        node = sided.groupBy(
            "_key",
            F.when(F.col("left"), F.col("lo")).otherwise(F.col("mid")).alias("lo2"),
            F.when(F.col("leaf") | ~F.col("left"), F.col("hi")).otherwise(F.col("mid")).alias("hi2"),
        ).agg(F.count(F.lit(1)).alias("quota")).select(
            "_key", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), "quota")
        width, level = (width + 1) // 2, level + 1
    return node.select("_key", F.col("lo").alias("shard"), "quota")


def _passes() -> Column:
    """Whole passes over a source; none over one without words."""
    return F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("int")


def _rest() -> Column:
    """Words that the last pass takes."""
    return F.col("target") - _passes() * F.col("source_size")


def draw_blocks(blocks: DataFrame, shards: int, seed: int) -> DataFrame:
    """(_key, block, draws, limit) from (_key, block, fit, source_size, target).

    draws: the (pass, shard) in which the block is taken; limit: the words that the last pass takes
    from it, null if all of those in documents that fit.
    """
    by_source = Window.partitionBy("_key")
    passes, rest = _passes(), _rest()
    permuted = _hash(seed, 3, "pass", "_key", "block")
    last = blocks.withColumns({"pass": passes, "rest": rest}).withColumn(
        "until", F.sum("fit").over(by_source.orderBy(permuted, "block").rowsBetween(
            Window.unboundedPreceding, 0)))
    before = F.col("until") - F.col("fit")
    last = last.where((F.col("fit") > 0) & (before < F.col("rest"))).select(
        "_key", "block", "pass",
        F.when(F.col("until") > F.col("rest"), F.col("rest") - before).alias("limit"))
    whole = blocks.where(passes > 0).select(
        "_key", "block", F.explode(F.sequence(F.lit(0), passes - 1)).alias("pass"),
        F.lit(None).cast("double").alias("limit"))
    draws = written(whole.unionByName(last).withColumn(
        "at", F.row_number().over(by_source.orderBy("pass", permuted, "block")).cast("long")))
    # Few rows (sources times shards), cut off so that their levels are not planned again with the draws.
    quotas = cut(split_quotas(
        draws.groupBy("_key").agg(F.count(F.lit(1)).alias("quota")), shards, seed))
    until = F.sum("quota").over(by_source.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0))
    places = quotas.withColumn("until", until).select("_key", "shard", F.explode(
        F.sequence(F.col("until") - F.col("quota") + 1, F.col("until"))).alias("at"))
    return draws.join(places, ["_key", "at"]).groupBy("_key", "block").agg(
        F.array_sort(F.collect_list(F.struct("pass", "shard"))).alias("draws"),
        F.max("limit").alias("limit"))


def _sized(docs: DataFrame, keep: list[str]) -> DataFrame:
    key = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), "source"))
    carried = [F.struct(*[F.col(c) for c in keep]).alias("_doc")] if keep else []
    return docs.select(*carried, "doc_id", "source", key.alias("_key"),
                       F.xxhash64("text").alias("text_hash"), word_count(F.col("text")).alias("size"))


def _placed(sized: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    return sized.join(targets, "_key").withColumns({
        "block": F.pmod(_hash(seed, 1, "doc_id", "text_hash"), F.col("blocks")).cast("int"),
        "inner": _hash(seed, 2, "doc_id", "text_hash")})


def _met(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """Documents with the draws of their block; the last pass takes only those that fit."""
    none = F.array().cast(plan.schema["draws"].dataType)
    in_last = F.filter("draws", lambda d: d["pass"] < _passes())
    met = placed.join(plan, ["_key", "block"], "left").withColumn(
        "draws", F.when((F.col("size") > 0) & F.col("draws").isNotNull(), F.col("draws")).otherwise(none)
    ).withColumn("draws", F.when(F.col("size") <= _rest(), F.col("draws")).otherwise(in_last))
    # Only the one block per source in which its target ends is ordered document by document.
    by_source = Window.partitionBy("_key")
    order = by_source.orderBy("inner", "doc_id", "size", "text_hash").rowsBetween(Window.unboundedPreceding, 0)
    cut_off = met.where(F.col("limit").isNotNull()).withColumns({"_in": F.lit(False), "_missing": F.col("limit")})
    for _ in range(CUTS):
        fits = ~F.col("_in") & (F.col("size") <= F.col("_missing"))
        cut_off = cut_off.withColumn("_until", F.sum(F.when(fits, F.col("size"))).over(order)).withColumn(
            "_in", F.col("_in") | (fits & (F.col("_until") <= F.col("_missing")))).withColumn(
            "_missing", F.col("limit") - F.sum(F.when(F.col("_in"), F.col("size")).otherwise(F.lit(0))).over(by_source))
    cut_off = cut_off.withColumn("draws", F.when(F.col("_in"), F.col("draws")).otherwise(in_last))
    return met.where(F.col("limit").isNull()).unionByName(cut_off.drop("_in", "_missing", "_until"))


def _fills(met: DataFrame, plan: DataFrame) -> DataFrame:
    """(_key, doc_id, text_hash, end): documents that fill what the last pass still misses.

    Per source and round the free document whose size is nearest to what is missing, if it brings the source
    nearer. What is missing is less than the shortest free document of the end block, so rounds are few.
    """
    ends = plan.where(F.col("limit").isNotNull()).select("_key", F.element_at("draws", -1).alias("end"))
    last = F.exists("draws", lambda d: d["pass"] == _passes())
    used = F.when(last, F.col("size")).otherwise(F.lit(0))
    # One row per source, written: with its size known the documents need no shuffle by source.
    left = written(met.where(F.col("limit").isNotNull()).join(ends, "_key").groupBy("_key").agg(
        F.max("end").alias("end"), (F.max("limit") - F.sum(used)).alias("missing")))
    free = written(met.where((F.col("size") > 0) & ~last).join(left.select("_key"), "_key", "left_semi").groupBy(
        "_key", "doc_id", "text_hash").agg(F.max("size").alias("size"), F.max("inner").alias("inner"),
                                           F.count(F.lit(1)).alias("rows")).where("rows = 1").drop("rows"))
    chosen = left.limit(0).select("_key", F.lit(None).cast(met.schema["doc_id"].dataType).alias("doc_id"),
                                  F.lit(0).cast("long").alias("text_hash"), "end")
    # What a source took goes along with it, so every round reads two tables and its plan stays as small as the first.
    fill = free.select(F.struct("doc_id", "text_hash")).schema[0].dataType
    left = left.withColumn("taken", F.array().cast(T.ArrayType(fill)))
    while True:
        off = F.abs(F.col("size") - F.col("missing"))
        is_taken = F.exists("taken", lambda t: t["doc_id"].eqNullSafe(F.col("doc_id")) & (t["text_hash"] == F.col("text_hash")))
        near = free.join(left, "_key").where((off < F.col("missing")) & ~is_taken)
        best = written(near.groupBy("_key").agg(
            F.any_value("end").alias("end"), F.any_value("missing").alias("missing"), F.any_value("taken").alias("taken"),
            F.min_by(F.struct("doc_id", "text_hash", "size"), F.struct(off, "inner", "text_hash")).alias("fill")).select(
            "_key", "end", "missing", "taken", "fill.*"))
        if best.isEmpty():
            return chosen
        chosen = chosen.unionByName(best.select(*chosen.columns))
        left = best.select("_key", "end", (F.col("missing") - F.col("size")).alias("missing"),
                           F.array_append("taken", F.struct("doc_id", "text_hash")).alias("taken"))


def drawn(docs: DataFrame, keep: list[str], shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Every document with its columns ``keep`` in _doc, size, source_size, target and its draws."""
    sized = written(_sized(docs, []))
    per_source = written(sized.groupBy("source", "_key").agg(F.sum("size").alias("size")))
    total = per_source.agg(F.sum("size")).head()[0] or 0
    blocks = F.greatest(F.lit(1), F.ceil(F.col("size") * MAX_BLOCKS / F.lit(max(total, 1)))).cast("int")
    targets = written(source_targets(per_source).select(
        "_key", F.col("size").alias("source_size"), "target", blocks.alias("blocks")))
    placed = _placed(sized, targets, seed)
    fit = F.when(F.col("size") <= _rest(), F.col("size")).otherwise(F.lit(0))
    sums = written(placed.where(F.col("size") > 0).groupBy("_key", "block").agg(
        F.sum(fit).alias("fit"), F.max("source_size").alias("source_size"), F.max("target").alias("target")))
    plan = written(draw_blocks(sums, shards, seed))
    # Without the documents' columns: some bytes a row, read again instead of planned and computed again.
    slim = written(_met(placed, plan))
    fills = written(_fills(slim, plan)).alias("f")
    met = (slim if not keep else _met(_placed(_sized(docs, keep), targets, seed), plan)).alias("d")
    is_fill = ((F.col("d._key") == F.col("f._key")) & F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
               & (F.col("d.text_hash") == F.col("f.text_hash")))
    return met.join(fills, is_fill, "left").select(
        *[F.col(f"d.{c}") for c in met.columns if c != "draws"],
        F.when(F.col("f.end").isNotNull(), F.array_append("d.draws", F.col("f.end"))).otherwise(
            F.col("d.draws")).alias("draws"))


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, and the shards that take the document."""
    rows = drawn(docs, [], **options)
    return rows.select(
        "doc_id", "size", "source_size", "target",
        (F.size("draws") * F.col("size")).cast("long").alias("taken"),
        F.array_join(F.transform("draws", lambda d: d["shard"].cast("string")), ",").alias("shards"))


def mix(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix: the documents' columns, once per draw, with ``mix_shard``, ``mix_pass``, ``mix_place``.

    Rows are ordered by shard and, inside a shard, by a hash; a reader of one shard gets a shuffle.
    """
    rows = drawn(docs, docs.columns, shards, seed).select("_doc", "doc_id", F.explode("draws").alias("d"))
    place = _hash(seed, 4, "d.pass", "doc_id")
    added = ("mix_shard", "mix_pass", "mix_place")
    return rows.select(
        *[F.col("_doc").getField(c).alias(c) for c in docs.columns if c not in added],
        F.col("d.shard").alias("mix_shard"), F.col("d.pass").alias("mix_pass"),
        place.alias("mix_place"),
    ).repartitionByRange("mix_shard", "mix_place").sortWithinPartitions("mix_shard", "mix_place")
