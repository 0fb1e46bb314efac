"""Token-id files with a minimal perfect hash index from document keys to places.

1. Documents are range-sorted by doc_id into shards; every task encodes its documents and writes their
   ids as one raw payload file, and returns one small row per document.
2. Shard sizes, added up in order, give every document its place among all ids; rows that repeat a doc_id
   are told apart by their number, carried over shards that an id fills.
3. Keys (doc_id, number) are hashed into buckets of about ``BUCKET_KEYS``; every bucket gets a minimal
   perfect hash by hash and displace: no stored keys, one pilot for four keys, and one slot per key with a
   64-bit fingerprint, shard, offset, global start and length. Index files hold runs of buckets.
4. Access by key reads one bucket position, one bucket and one payload range, whatever the size of the
   corpus. A batch of keys is sorted by bucket for the look-up and by place for the read, so neighbours share reads.

Files are written under a name of their own and then renamed; an attempt that runs again makes equal bytes,
so lost executors leave at most unused ``part-`` files. The folder must be on a file system that Spark
and pyarrow both reach (a mounted one, hdfs, s3, gs).

Defined cases: a null or empty text has the end id alone; null ids come last and are a key like any other;
rows with the same doc_id are numbered in the order of their text's hash and lie beside each other; an unknown key has
null places (an unknown key passes its fingerprint with probability 2**-64); further columns are ignored; an
empty table makes no files. A hot doc_id is split over shards by text hash and a random number.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from meterfold.llm import token_files_kernels as kernels
from meterfold.llm.common import written
from meterfold.session import scratch_root

END_ID = 1
SHARD_CHARS = 1 << 26
BUCKET_KEYS = 2048
FILE_BUCKETS = 1024


@dataclass(frozen=True)
class TokenFiles:
    """A written folder."""

    root: str
    width: int
    shards: int
    buckets: int
    per_file: int

    def _hashed(self, keys: DataFrame) -> DataFrame:
        return _hashed(keys, self.buckets, self.per_file)

    def look_up(self, keys: DataFrame) -> DataFrame:
        """Keys (doc_id, nth) with start, n_tokens, shard, offset; null where unknown."""
        kind = keys.schema["doc_id"].dataType.simpleString()
        hashed = self._hashed(keys.select("doc_id", F.col("nth").cast("long").alias("nth")))
        return hashed.repartition("bucket").sortWithinPartitions("bucket").select(
            "doc_id", "nth", "bucket", "h1", "h2").mapInArrow(
            kernels.look_up(self.root, self.per_file, ["doc_id", "nth"]),
            f"doc_id {kind}, nth long, start long, n_tokens long, shard long, offset long")

    def read(self, keys: DataFrame) -> DataFrame:
        """doc_id, nth, start, n_tokens, ids (little-endian unsigned 32-bit) of the keys that are stored."""
        kind = keys.schema["doc_id"].dataType.simpleString()
        keep = ["doc_id", "nth", "start", "n_tokens"]
        # A stated number: the rows are few and short, what they make a task read is not.
        placed = self.look_up(keys).where(F.col("shard").isNotNull()).repartition(max(self.shards, 1), "shard")
        return placed.sortWithinPartitions("shard", "offset").mapInArrow(
            kernels.read_ids(self.root, self.width, keep),
            f"doc_id {kind}, nth long, start long, n_tokens long, ids binary")


def _hashed(keys: DataFrame, buckets: int, per_file: int) -> DataFrame:
    bucket = F.pmod("h1", F.lit(buckets))
    return keys.withColumns({
        "h1": F.xxhash64(F.lit(1), F.col("doc_id").isNull(), "doc_id", "nth"),
        "h2": F.xxhash64(F.lit(2), F.col("doc_id").isNull(), "doc_id", "nth"),
    }).withColumn("bucket", bucket).withColumn("file", F.floor(F.col("bucket") / per_file).cast("int"))


def _numbered(entries: DataFrame) -> DataFrame:
    """Entries with their global start, and ``nth`` counted over shards; one row per shard is ordered."""
    shards = entries.groupBy("shard").agg(
        F.sum("n_tokens").alias("ids"), F.min_by("doc_id", "offset").alias("first"),
        F.max_by("doc_id", "offset").alias("last"), (F.max_by("nth", "offset") + 1).alias("n_last"))
    in_order = Window.orderBy("shard")
    ended = F.sum("n_last").over(Window.partitionBy("last").orderBy("shard"))
    carried = shards.withColumn("ended", ended).select(
        "shard", F.col("first").alias("head"), (F.sum("ids").over(in_order) - F.col("ids")).alias("base"),
        F.when((F.lag(F.lit(True)).over(in_order)) & F.lag("last").over(in_order).eqNullSafe(F.col("first")),
               F.lag("ended").over(in_order)).otherwise(F.lit(0)).alias("carry"))
    nth = F.col("nth") + F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.col("carry")).otherwise(F.lit(0))
    return entries.join(carried, "shard").select(
        "doc_id", nth.alias("nth"), "shard", "offset", (F.col("base") + F.col("offset")).alias("start"), "n_tokens")


def write_files(docs: DataFrame, tokenizer_path: str, root: str, end_id: int = END_ID, width: int = 4,
                words_apart: bool = False, shard_chars: int = SHARD_CHARS,
                bucket_keys: int = BUCKET_KEYS) -> tuple[TokenFiles, DataFrame]:
    """Write payload and index files; returns them and the keys (doc_id, nth) that they hold.

    ``tokenizer_path`` is on every executor. ``width``: bytes of an id, 2 if all ids are below 65,536.
    ``words_apart``: the tokenizer's tokens never reach over ASCII white space, so that words may be
    encoded one by one.
    """
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = docs.agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("n")).head()
    shards = max(1, min(2 * cores, size.n), -(-(size.chars or 0) // shard_chars))
    kind = docs.schema["doc_id"].dataType.simpleString()
    order = [F.col("doc_id").asc_nulls_last(), F.col("text_hash")]
    placed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).repartitionByRange(
        shards, *order, F.rand(7)).sortWithinPartitions(*order)
    entries = written(placed.select("doc_id", "text").mapInArrow(
        kernels.write_ids(root, tokenizer_path, end_id, width, words_apart),
        f"doc_id {kind}, nth long, shard int, offset long, n_tokens long"))
    buckets = max(1, -(-size.n // bucket_keys))
    per_file = max(1, min(FILE_BUCKETS, -(-buckets // (2 * cores))))
    keys = written(_numbered(entries))
    written(_hashed(keys, buckets, per_file).drop("doc_id", "nth").groupBy("file").applyInArrow(
        kernels.write_index(root, per_file), "file int, keys long"))
    return TokenFiles(root, width, shards, buckets, per_file), keys.select("doc_id", "nth")


def token_file_report(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from files by key."""
    files, keys = write_files(docs, tokenizer_path, scratch_root(docs.sparkSession), **options)
    return files.read(keys).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
