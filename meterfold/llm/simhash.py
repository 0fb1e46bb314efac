"""SimHash near-dedup: exact tiled comparison, tile pairs skipped by population counts.

Distinct fingerprints are gathered into tiles of equal population counts in each 16-bit quarter.
Two fingerprints within ``radius`` bits have counts whose differences add up to at most ``radius``,
so a tile meets only the tiles that near it (65 of them for radius 3, counting each pair once);
every other pair of tiles is skipped without a look. Inside a pair of tiles all fingerprints are
compared by exclusive-or and bit counts. Nothing is approximate: no link is lost.

A fingerprint travels to 65 tiles as eight bytes in a packed array, so the shuffle grows in
proportion to the number of distinct fingerprints. A tile holds at most about ``TILE`` fingerprints;
fuller count cells are cut into several by a hash. Copies with one fingerprint are one node. From a
tile pair at most a spanning star per component leaves the task, so thousands of near copies do not
become all their pairs. Components are then found by alternating star contractions, checkpointed.

Defined cases: a text without words has fingerprint zero and links like any other; null ids take
part (a component's id is its smallest non-null doc_id); repeated rows are copies; further columns
are ignored by ``near_duplicates`` and kept by the others. ``keep_first_of_group`` drops by doc_id alone, so rows
without an id and rows that repeat the smallest one stay; ``keep_one_of_group`` (the pipeline's) leaves one row.
"""

from itertools import product

from pyspark.sql import DataFrame, Window, functions as F

from meterfold.llm import simhash_kernels as kernels
from meterfold.llm.common import cut, free_name, written

WIDTH = 3
RADIUS = 3
TILE = 4096
QUARTERS = 4
BASE = 17  # a quarter has 0 to 16 bits set


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, fp): the 64 majority bits of the shingles' XXH64, as a signed long."""
    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(
        kernels.fingerprints(width), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fp long")


def _offsets(radius: int) -> list[tuple[int, ...]]:
    """Count differences that may hold a link, one of each pair of opposite ones."""
    steps = range(-radius, radius + 1)
    near = [d for d in product(steps, repeat=QUARTERS) if sum(map(abs, d)) <= radius]
    return [d for d in near if d >= (0,) * QUARTERS]


def tile_pairs(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(own, visitor, same) from distinct (fp): all pairs of tiles that may hold a link."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * k).bitwiseAND(0xFFFF)) for k in range(QUARTERS)]
    cells = nodes.select("fp", *[c.alias(f"c{k}") for k, c in enumerate(counts)])
    names = [f"c{k}" for k in range(QUARTERS)]
    # At most 17 ** 4 rows, whatever the data.
    full = cells.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / tile).alias("parts")).where("parts > 1")
    cut_by = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1)))
    tiles = written(
        cells.join(full, names, "left").groupBy(*names, cut_by.alias("part"))
        .agg(F.array_sort(F.collect_list("fp")).alias("fps")))
    code = lambda cs: sum((c * BASE ** k for k, c in enumerate(cs)), F.lit(0)).cast("int")
    own = tiles.select(code([F.col(n) for n in names]).alias("cell"), F.col("part").alias("own_part"),
                       F.col("fps").alias("own"))
    offsets = F.array(*[F.struct(*[F.lit(x).alias(f"d{k}") for k, x in enumerate(d)])
                        for d in _offsets(radius)])
    there = [F.col(n) + F.col(f"o.d{k}") for k, n in enumerate(names)]
    inside = F.lit(True)
    for c in there:
        inside = inside & c.between(0, BASE - 1)
    visitors = tiles.select(*names, "part", "fps", F.explode(offsets).alias("o")).where(inside).select(
        code(there).alias("cell"), F.col("part").alias("visitor_part"), F.col("fps").alias("visitor"),
        (F.abs("o.d0") + F.abs("o.d1") + F.abs("o.d2") + F.abs("o.d3") == 0).alias("home"))
    # Spark takes the visitors for as small as the tiles they are copied from and would gather all copies in the driver.
    pairs = own.join(visitors.hint("merge"), "cell").where(~F.col("home") | (F.col("own_part") <= F.col("visitor_part")))
    return pairs.select(
        "own", "visitor", (F.col("home") & (F.col("own_part") == F.col("visitor_part"))).alias("same"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge (u, v), root the smallest node of its component.

    Rounds of large-star and small-star: each node's neighbours are tied to its smallest one, first
    the larger neighbours, then the smaller ones. Rounds grow with the logarithm of the longest path.
    """
    def tied(pairs: DataFrame) -> DataFrame:
        low = pairs.groupBy("u").agg(F.min("v").alias("low")).withColumn("low", F.least("low", "u"))
        return pairs.join(low, "u")

    def rows_of(pairs: DataFrame, *sides) -> DataFrame:
        """Several (u, v) of each row, without a second copy of what ``pairs`` comes from in the plan."""
        return pairs.select(F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in sides])))

    now, before = cut(edges.where("u <> v").distinct()), None
    while True:
        both = rows_of(now, ("u", "v"), ("v", "u"))
        # Checkpointed between the stars: a plan of both would hold the first one four times. Here u > v.
        large = cut(tied(both).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct())
        now = cut(rows_of(tied(large), ("v", "low"), ("u", "low")).where("u <> v").distinct())
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    fps = written(fingerprints(docs, width))
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges = tile_pairs(nodes.select("fp"), radius).mapInArrow(kernels.links(radius), "u long, v long")
    stars = components(edges)
    rooted = nodes.join(stars.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    named = rooted.join(
        rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "component_id")
    return fps.join(named, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first_of_group(docs: DataFrame, **options) -> DataFrame:
    """The documents without those that a smaller doc_id of their group stands for."""
    copies = near_duplicates(docs, **options).where(F.col("doc_id") != F.col("component_id"))
    return docs.join(copies.select("doc_id"), "doc_id", "left_anti").select(*docs.columns)


def keep_one_of_group(docs: DataFrame, **options) -> DataFrame:
    """One document of each group: the smallest by (doc_id, nulls last, text hash), once if it is repeated."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("h"))
    # Names that no column of the documents has.
    name, place = free_name(docs, "_key"), free_name(docs, "_n")
    rows = docs.withColumn(name, key)
    found = written(near_duplicates(rows.select(F.col(name).alias("doc_id"), "text"), **options).select(
        F.col("doc_id").alias(name), F.col("component_id").alias("first")))
    is_first = F.col(name) == F.col("first")
    copies = found.where(~is_first).select(name).distinct()
    again = written(found.where(is_first).groupBy(name).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select(name))
    kept = rows.join(copies, name, "left_anti")
    # Only rows whose id and text are repeated are numbered.
    order = Window.partitionBy(name).orderBy(F.xxhash64(*docs.columns))
    once = kept.join(again, name, "left_semi").withColumn(place, F.row_number().over(order)).where(F.col(place) == 1)
    return kept.join(again, name, "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))
