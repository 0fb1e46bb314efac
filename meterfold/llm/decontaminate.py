"""Benchmark decontamination with suffix arrays over the training documents.

Every task builds word-level suffix arrays over shards of its documents (prefix doubling, numpy) and
binary-searches the benchmark's suffixes in them, all at once: the range of a window in a shard's
suffix array is the list of its verbatim occurrences, and the neighbours of a suffix's place give
its longest match. A suffix array holds only the runs of words that the benchmark has at all and that
are long enough for a window; a suffix with a foreign word inside its window matches nothing.

The benchmark is the query set. It travels to the tasks in blocks of at most ``BLOCK_CHARS``
characters of text: its size is summed before anything is fetched, and a larger benchmark is searched
block by block over all documents; the results meet per distinct (doc_id, text) and are joined back to
the rows, so any size gives the same result. Documents are never shuffled for a benchmark of one block.

Defined cases: a null or wordless text has no words and no hits; an item without words is no window;
items without an id are searched and their hits count, but they are not listed; items with one id
are listed once; repeated documents are judged row by row; without any item nothing is hit; further
columns are ignored by ``contamination`` and kept by ``clean``.
"""

from pyspark.sql import DataFrame, Window, functions as F, types as T

from meterfold.llm import suffix_kernels as kernels
from meterfold.llm.common import written

WINDOW = 10
BLOCK_CHARS = 16 << 20
WORDS = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def blocks(benchmark: DataFrame, limit: int = BLOCK_CHARS):
    """The items block by block: lists of (number, text) and of the items' names."""
    rows = benchmark.where(F.length("text") > 0).select(
        F.col("item_id").cast("string").alias("item"), "text")
    total = rows.agg(F.sum(F.length("text"))).head()[0] or 0
    if total <= limit:
        parts = [rows]
    else:
        n = 2 * -(-total // limit)
        spread = F.pmod(F.xxhash64("item", "text"), F.lit(n))
        placed = written(rows.withColumn("part", spread))
        parts = [placed.where(F.col("part") == k) for k in range(n)]
    for part in parts:
        items = part.orderBy("item", "text").select("item", "text").collect()
        yield [(k, r.text) for k, r in enumerate(items)], [r.item for r in items]


def _run(documents: DataFrame, benchmark: DataFrame, kernel, schema, window: int, limit: int):
    found = None
    for items, names in blocks(benchmark, limit):
        part = documents.mapInArrow(kernel(items, window, names), schema)
        found = part if found is None else found.unionByName(part)
    return found


def _hits_schema(rows: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_words", T.LongType()),
        T.StructField("hit_from", T.ArrayType(T.LongType())), T.StructField("hit_to", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType()))])


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  limit: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, n_words, hit ranges (hit_from, hit_to) and the distinct items found, one row per row."""
    rows = documents.select("doc_id", "text")
    listed = F.array_sort(F.array_distinct(F.filter("items", lambda x: x.isNotNull()))).alias("items")
    total = benchmark.agg(F.sum(F.length("text"))).head()[0] or 0
    if total <= limit:
        return _run(rows, benchmark, kernels.hits, _hits_schema(rows), window, limit).select(
            "doc_id", "n_words", "hit_from", "hit_to", listed)
    keyed = rows.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("doc_id"), "text")
    found = _run(keyed, benchmark, kernels.hits, _hits_schema(keyed), window, limit)
    # Equal rows give equal results in a block, which the sets hold once.
    hit = F.when(F.size("hit_from") > 0, F.struct(F.arrays_zip("hit_from", "hit_to").alias("ranges"), "items"))
    met = found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.collect_set(hit).alias("hits")).select(
        F.col("doc_id").alias("_key"), "n_words", F.flatten("hits.items").alias("items"),
        F.array_sort(F.flatten("hits.ranges")).alias("ranges"))
    # Ranges of different blocks that overlap or touch are one range, as in a single block.
    pair = "struct<hit_from:bigint,hit_to:bigint>"
    merged = F.aggregate(
        "ranges", F.struct(F.array().cast(f"array<{pair}>").alias("out"), F.lit(None).cast(pair).alias("last")),
        lambda acc, r: F.when(acc["last"].isNull(), F.struct(acc["out"].alias("out"), r.alias("last"))).when(
            r["hit_from"] <= acc["last"]["hit_to"], F.struct(acc["out"].alias("out"), F.struct(
                acc["last"]["hit_from"].alias("hit_from"),
                F.greatest(acc["last"]["hit_to"], r["hit_to"]).alias("hit_to")).alias("last"))).otherwise(
            F.struct(F.array_append(acc["out"], acc["last"]).alias("out"), r.alias("last"))),
        lambda acc: F.when(acc["last"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], acc["last"])))
    met = met.select("_key", "n_words", merged.alias("r"), listed)
    same = F.struct("doc_id", F.xxhash64("text").alias("h")) == F.col("_key")
    return rows.join(met, same).select(
        "doc_id", "n_words", F.col("r.hit_from").alias("hit_from"), F.col("r.hit_to").alias("hit_to"), "items")


def contamination_report(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contamination(documents, benchmark, **options)
    lengths = F.zip_with("hit_from", "hit_to", lambda a, b: b - a)
    n_hit = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"))


def longest_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                    limit: int = BLOCK_CHARS) -> DataFrame:
    """Every test suffix (item, item_pos) that occurs with at least ``least`` words: its longest match and where.

    ``least`` is the length of the shortest window of the whole benchmark: ``window``, or the words of
    the shortest item if it has fewer. Shorter matches are not given. Of equally long matches the one in the smallest (doc_id, doc_pos) is given.
    """
    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    words = F.regexp_count("text", F.lit(WORDS))
    shortest = benchmark.where(words > 0).agg(F.min(words)).head()[0] or window
    least = min(window, shortest)
    found = _run(rows, benchmark, lambda *block: kernels.longest(*block, least),
                 f"item string, item_pos long, length long, doc_id {kind}, doc_pos long", window, limit)
    best = Window.partitionBy("item", "item_pos").orderBy(F.desc("length"), "doc_id", "doc_pos")
    return found.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def clean(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that hold no benchmark window; rows without an id go with any equal text.

    Only the (few) hit documents are joined, by id and text hash.
    """
    rows = documents.withColumn("doc_id", F.struct("doc_id", F.xxhash64("text").alias("h")))
    hit = contamination(rows, benchmark, **options).where(F.size("hit_from") > 0).select(
        F.col("doc_id.doc_id").alias("hit_id"), F.col("doc_id.h").alias("hit_h")).distinct()
    same = F.col("d.doc_id").eqNullSafe(F.col("h.hit_id")) & (F.xxhash64("d.text") == F.col("h.hit_h"))
    return documents.alias("d").join(hit.alias("h"), same, "left_anti").select("d.*")
