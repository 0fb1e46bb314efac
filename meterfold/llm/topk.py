"""Exact top-k search by pivot-table elimination.

Vectors are packed in blocks of at most about ``BLOCK`` rows. Every block carries its pivot table: the
distances of its rows to ``PIVOTS`` pivots, computed once. For a query the largest difference of
pivot distances bounds the distance to a candidate from below, and so the inner product from above;
the candidates of a block are evaluated in the order of that bound, until the k-th best score
exceeds the next bound. Results are exact whatever the pivots; they only decide how early it stops.

The queries are a stated set that meets all rows in blocks: query blocks (copied, packed) are joined
by candidate block and lane with candidate blocks; query blocks are dealt to lanes, so that few candidate
blocks keep all cores at work. Each pair of blocks returns at most k rows a query, and a window
keeps the k best over all blocks.

Pivots are chosen farthest-first among the ``SAMPLE`` rows with the smallest hashes.

Defined cases: vectors that are null or hold a null or non-finite component, and rows without an id,
take no part; shorter vectors are filled with zeros; rows equal in id and vector are rows of their
own (up to k + 1 of them can matter and are kept); a query with fewer candidates than k returns
all. Components must fit a long after scaling, and scores a long.
"""

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from meterfold.llm import topk_kernels as kernels
from meterfold.llm.common import written

SCALE = 64
K = 20
EVERY = 20
BLOCK = 8192
QUERY_BLOCK = 1024
PIVOTS = 16
SAMPLE = 1024
_PACKED = "block long, ids binary, copies binary, keys binary, vectors binary, near binary"


def quantized(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v): floor(64 x) of every component of the vectors that take part."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return embeddings.where(F.col("vec_id").isNotNull() & x.isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * SCALE)).alias("v"))


def top_k(embeddings: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK,
          query_block: int = QUERY_BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for every query (vec_id divisible by ``every``)."""
    rows = quantized(embeddings).groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("copies"))
    rows = written(rows.withColumn("key", F.xxhash64("v")))
    size = rows.agg(F.sum(F.least("copies", F.lit(k + 1))).alias("n"),
                    F.count_if(F.col("vec_id") % every == 0).alias("q"),
                    F.max(F.size("v")).alias("width")).head()
    width = max(size.width or 0, 1)
    sample = rows.orderBy(F.xxhash64(F.lit(3), "vec_id", "key"), "vec_id", "key").limit(SAMPLE).select("v").collect()
    points = np.zeros((len(sample), width))
    for i, r in enumerate(sample):
        points[i, :len(r.v)] = r.v
    chosen = kernels.choose_pivots(points, pivots)
    n_blocks, n_queries = (max(1, -(-(n or 0) // b)) for n, b in ((size.n, block), (size.q, query_block)))

    def packed(part: DataFrame, n: int) -> DataFrame:
        spread = F.pmod(F.xxhash64(F.lit(5), "vec_id", "key", "copies"), F.lit(n)).alias("block")
        return part.select(spread, "vec_id", "copies", "key", "v").groupBy("block").applyInArrow(
            kernels.pack(chosen, width), _PACKED)

    each = F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k + 1)))).alias("copies")
    candidates = written(packed(rows.select("vec_id", "key", "v", each), n_blocks))
    # Candidate blocks travel once per lane: few blocks still make work for every core.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    lanes = min(n_queries, -(-2 * cores // n_blocks))
    queries = packed(rows.where(F.col("vec_id") % every == 0), n_queries).select(
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("other"),
        F.pmod("block", F.lit(lanes)).alias("lane"),
        *[F.col(c).alias(f"q_{c}") for c in ("ids", "copies", "keys", "vectors", "near")]
    ).withColumnRenamed("other", "block")
    dealt = candidates.withColumn(
        "lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    # A stated number of partitions, so that small but costly pairs are not merged into one task.
    unit = ["block", "lane"]
    n_tasks = min(4 * n_blocks * lanes, max(16 * cores, int(
        rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    pairs = queries.repartition(n_tasks, *unit).join(
        dealt.repartition(n_tasks, *unit).hint("shuffle_merge"), unit)
    found = pairs.mapInArrow(
        kernels.search(k, width, len(chosen)),
        "query_id long, query_key long, copies long, vec_id long, score long")
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score", F.explode(
        F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy")).drop("_copy")
